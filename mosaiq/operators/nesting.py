"""Which region lies in a hole of which: the containment forest.

The pixel left of a region's first pixel belongs to a region that started before it. If the
side between them is on the outer ring of that region, both lie in the same hole (or in
none); if it is on an inner ring, that region is the one around. So all regions of a hole
hang together by links to earlier ones, down to the first, whose link says where they lie.
Pixels without a region are regions of their own while this is found out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.spatial import x_of, y_of
from mosaiq.operators.components import connected_components, label_components
from mosaiq.operators.crossings import segments
from mosaiq.operators.vector import arcs, polygons, unit_sides
from mosaiq.plans.lineage import Rounds, materialize


def completed(members: DataFrame, width: int, height: int) -> DataFrame:
    """``(pix, node, blank)``: members, and the 4-connected patches of pixels without a region."""
    spark = members.sparkSession
    missing = spark.range(width * height).withColumnRenamed("id", "pix").join(members, "pix", "left_anti").withColumn("label", F.lit(0))
    blank = label_components(missing, width, height)
    return members.select("pix", "node", F.lit(False).alias("blank")).unionByName(blank.select("pix", "node", F.lit(True).alias("blank")))


def left_links(members: DataFrame, width: int, height: int) -> DataFrame:
    """``(node, left, around)``: the region left of each region's first pixel (null: none), and whether it lies around it."""
    rings = polygons(arcs(unit_sides(members.select("pix", "node"), width, height)))
    each = rings.select("node", F.posexplode("rings").alias("ring", "line"))
    east = segments(each, ["node", "ring"]).where("x0 = x1 and y1 > y0").select(F.col("node").alias("left"), F.col("x0").alias("x"), "y0", "y1", (F.col("ring") > 0).alias("around"))
    nodes = members.select("node").distinct()
    x, y = x_of(F.col("node"), width), y_of(F.col("node"), width)
    first = nodes.select("node", x.alias("x"), y.alias("y"), F.when(x > 0, F.col("node") - 1).alias("pix"))
    beside = first.where("pix is not null").join(members.select("pix", F.col("node").alias("left")), "pix")
    side = beside.join(east, ["left", "x"]).where("y >= y0 and y < y1").select("node", "left", "around")
    return nodes.join(side, "node", "left").select("node", "left", F.coalesce("around", F.lit(False)).alias("around"))


def enclosing_regions(members: DataFrame, width: int, height: int) -> DataFrame:
    """``(node, parent)``: the innermost region with a hole that each region lies in; -1 if it lies in none.

    A hole is a 4-connected patch of pixels that aren't the region's, cut off from the image's outside by it.
    """
    whole = materialize(completed(members, width, height))
    links = materialize(left_links(whole, width, height))
    # A link leads to an earlier region, so the first of those that hang together is the least key.
    beside = connected_components(links.where("left is not null and not around").select("node", "left"), "node", "left")
    heads = links.select("node").join(beside, "node", "left").select("node", F.coalesce("component", "node").alias("head"))
    parents = links.select(F.col("node").alias("head"), F.when(F.col("around"), F.col("left")).alias("parent"))
    rounds = Rounds(members.sparkSession)
    found = rounds.cut(heads.join(parents, "head").select("node", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent")))[0]
    blanks = whole.where("blank").select("node").distinct()
    above = found.join(blanks, "node", "left_semi").select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    above, result = rounds.cut(above, found.join(blanks, "node", "left_anti"))
    while not result.join(above, "parent", "left_semi").isEmpty():  # once for each blank patch that lies directly in another
        above, result = rounds.cut(above, result.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")))
    return result.select("node", "parent")
