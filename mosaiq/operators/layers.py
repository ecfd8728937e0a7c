"""Simplification of a polygon layer: lines that features share are found from their rings alone.

Rings become directed segments with their feature to the right, cut wherever a corner of
any ring lies on them, so sides that overlap in part match in full. The feature on the
other side is the one with the same segment the other way round. From there on a layer is
like a label image: segments are chained to arcs between junctions, arcs are simplified
once and as a plane graph, and each serves both its features. Corners are whole numbers;
features must not overlap (``repair.clean_layer`` mends single ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.crossings import CELL, cells, segments, side_of
from mosaiq.operators.vector import Simplifier, arcs, douglas_peucker, plane_lines, polygons
from mosaiq.plans.lineage import materialize, unsized


def signed_area(ring: Column) -> Column:
    """Positive for rings that run clockwise with y downwards."""
    cross = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda k: ring[k]["x"] * ring[k + 1]["y"] - ring[k + 1]["x"] * ring[k]["y"])
    return F.when(F.size(ring) < 2, 0.0).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2)


def directed_segments(layer: DataFrame, key: str = "start") -> DataFrame:
    """``(node, ring, k, x0, y0, x1, y1)``: all sides with the feature to the right, whichever way its rings run (the first is the outer one)."""
    rings = layer.select(F.col(key).alias("node"), F.posexplode("rings").alias("ring", "line"))
    turned = (signed_area(F.col("line")) > 0) != (F.col("ring") == 0)
    return segments(rings.withColumn("line", F.when(turned, F.reverse("line")).otherwise(F.col("line"))), ["node", "ring"]).where("x0 != x1 or y0 != y1")


def cut_at_corners(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Segments ``keys, x0, y0, x1, y1`` cut at every corner of another one that lies inside them."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    corners = sides.select(F.explode(F.array(F.struct(x0.alias("px"), y0.alias("py")), F.struct(x1.alias("px"), y1.alias("py")))).alias("p")).select("p.*").distinct()
    placed = corners.withColumns({"cx": F.floor(F.col("px") / CELL), "cy": F.floor(F.col("py") / CELL)})
    passed = sides.select(*keys, "x0", "y0", "x1", "y1", F.explode(cells(x0, y0, x1, y1, CELL)).alias("c")).select("*", "c.cx", "c.cy")
    px, py = F.col("px"), F.col("py")
    at_end = ((px == x0) & (py == y0)) | ((px == x1) & (py == y1))
    on = (side_of(x0, y0, x1, y1, px, py) == 0) & px.between(F.least(x0, x1), F.greatest(x0, x1)) & py.between(F.least(y0, y1), F.greatest(y0, y1)) & ~at_end
    along = F.abs(px - x0) + F.abs(py - y0)
    cuts = unsized(passed).join(placed, ["cx", "cy"]).where(on).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(along.alias("d"), px.alias("x"), py.alias("y")))).alias("cuts"))
    point = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    line = F.concat(F.array(point(x0, y0)), F.coalesce(F.transform("cuts", lambda c: point(c["x"], c["y"])), F.array().cast("array<struct<x:bigint,y:bigint>>")), F.array(point(x1, y1)))
    return segments(sides.join(cuts, keys, "left").select(*keys, line.alias("line")), keys).drop("k")


def layer_sides(layer: DataFrame, key: str = "start") -> DataFrame:
    """``(node, other, x0, y0, x1, y1)``: sides of all features and the feature beyond each, -1 if there is none."""
    sides = directed_segments(layer, key).withColumnRenamed("k", "side")
    cut = materialize(cut_at_corners(sides, ["node", "ring", "side"]).select("node", "x0", "y0", "x1", "y1"))
    back = cut.groupBy(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(F.min("node").alias("other"))
    return cut.join(back, ["x0", "y0", "x1", "y1"], "left").select("node", F.coalesce("other", F.lit(-1).cast("long")).alias("other"), *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


def shared_lengths(sides: DataFrame) -> DataFrame:
    """``(lo, hi, length)``: the length that two features share; ``lo`` is -1 against none."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return sides.where("other < node").groupBy(F.col("other").alias("lo"), F.col("node").alias("hi")).agg(F.sum(length).alias("length"))


def simplify_layer(layer: DataFrame, tolerance: float = 1.0, key: str = "start", simplifier: Simplifier = douglas_peucker) -> DataFrame:
    """The features with simplified ``rings`` and ``is_valid``; lines against no feature and those of rectangles stay as they are."""
    found = materialize(arcs(materialize(layer_sides(layer, key))))
    xs = lambda f, c: f(F.transform(F.col("rings")[0], lambda p: p[c]))
    around = (xs(F.array_max, "x") - xs(F.array_min, "x")) * (xs(F.array_max, "y") - xs(F.array_min, "y"))
    boxes = layer.where((F.size("rings") == 1) & (F.abs(signed_area(F.col("rings")[0])) == around)).select(F.col(key).alias("node"))
    of = lambda end: boxes.select(F.col("node").alias(end), F.lit(True).alias(f"is_{end}"))
    fixed = F.coalesce("is_lo", "is_hi", F.lit(False)) | (F.col("lo") < 0)
    made = polygons(plane_lines(found.join(of("lo"), "lo", "left").join(of("hi"), "hi", "left").select("lo", "hi", "line", fixed.alias("fixed")), tolerance, simplifier))
    others = [c for c in layer.columns if c not in ("rings", "is_valid")]
    return layer.select(*others).join(made.select(F.col("node").alias(key), F.col("valid").cast("string").alias("is_valid"), "rings"), key).select(*others, "is_valid", "rings")
