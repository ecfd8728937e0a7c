"""Label rasters of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.spatial import x_of, y_of
from mosaiq.operators.graph import dense_ids


def scan_order_labels(members: DataFrame) -> DataFrame:
    """``(node, label)``: labels from 1 in the order in which regions first appear row by row.

    A region's key is its first pixel in that order, so labels are ranks of keys.
    """
    ids = dense_ids(members.select("node").distinct())
    return ids.select("node", (F.col("id") + 1).cast("long").alias("label"))


def label_image(members: DataFrame, width: int) -> DataFrame:
    """``(pix, x, y, label)`` of all pixels of regions; what is missing is no-data, label 0."""
    pix = F.col("pix")
    return members.join(scan_order_labels(members), "node").select("pix", x_of(pix, width).alias("x"), y_of(pix, width).alias("y"), "label")


def filled(labels: DataFrame, width: int, height: int) -> DataFrame:
    """The whole image, with label 0 where there is no region."""
    grid = labels.sparkSession.range(width * height).select(F.col("id").alias("pix"))
    pix = F.col("pix")
    return grid.join(labels.select("pix", "label"), "pix", "left").select("pix", x_of(pix, width).alias("x"), y_of(pix, width).alias("y"), F.coalesce("label", F.lit(0)).alias("label"))


def window_labels(members: DataFrame, width: int, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Labels of a window only; they are those of the whole image."""
    pix = F.col("pix")
    x, y = x_of(pix, width), y_of(pix, width)
    inside = members.where(x.between(x0, x0 + w - 1) & y.between(y0, y0 + h - 1))
    return inside.join(scan_order_labels(members), "node").select("pix", x.alias("x"), y.alias("y"), "label")


def colours(labels: DataFrame) -> DataFrame:
    """Labels with red, green and blue columns made from a hash of the label."""
    channel = lambda k: F.when(F.col("label") == 0, 0).otherwise(F.pmod(F.xxhash64("label", F.lit(k)), F.lit(256))).cast("int")
    return labels.withColumns({"red": channel(1), "green": channel(2), "blue": channel(3)})


def write_label_tiles(labels: DataFrame, path: str, tile_width: int, tile_height: int) -> None:
    """The label raster as Parquet in folders by tile row and column."""
    tiled = labels.withColumn("ty", F.floor(F.col("y") / tile_height).cast("int")).withColumn("tx", F.floor(F.col("x") / tile_width).cast("int"))
    tiled.repartition("ty", "tx").sortWithinPartitions("pix").write.partitionBy("ty", "tx").parquet(path)
