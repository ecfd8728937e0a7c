"""Rasters as tables ``pixels(pix, x, y, bands)``, one row a pixel, ``pix = y * width + x``."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.spatial import x_of, y_of


@dataclass(frozen=True)
class Meta:
    """What is known of an image without its pixels. The origin keeps full precision."""

    width: int
    height: int
    bands: int
    origin_x: float = 0.0
    origin_y: float = 0.0
    projection: str = ""
    nodata: float | list[float] | None = None


def pixels_of(table: DataFrame, pix: str, width: int, bands: list[Column]) -> DataFrame:
    """A raster from any table with a dense key in raster order."""
    key = F.col(pix).cast("long")
    return table.select(key.alias("pix"), x_of(key, width).alias("x"), y_of(key, width).alias("y"), F.array(*[b.cast("double") for b in bands]).alias("bands"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A raster stored as Parquet with the columns above; filters on x and y reach the files' statistics."""
    return spark.read.parquet(path).select("pix", "x", "y", "bands")


def write_pixels(pixels: DataFrame, path: str, tile_width: int, tile_height: int) -> None:
    """Parquet in folders by tile column and row, so a window reads only the tiles that it meets."""
    tiled = pixels.withColumn("tx", F.floor(F.col("x") / tile_width).cast("int")).withColumn("ty", F.floor(F.col("y") / tile_height).cast("int"))
    tiled.repartition("ty", "tx").sortWithinPartitions("pix").write.partitionBy("ty", "tx").parquet(path)


def metadata(pixels: DataFrame) -> DataFrame:
    """One row ``(width, height, n_bands, n_pixels)``."""
    return pixels.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.max(F.size("bands")).alias("n_bands"), F.count(F.lit(1)).alias("n_pixels"))


def with_meta(pixels: DataFrame, meta: Meta) -> DataFrame:
    """The raster with origin, projection and no-data value kept in the schema, so that Parquet files carry them."""
    kept = {k: v for k, v in asdict(meta).items() if k in ("origin_x", "origin_y", "projection", "nodata") and v is not None}
    return pixels.withMetadata("bands", {"raster": json.dumps(kept)})


def read_metadata(pixels: DataFrame) -> Meta:
    row = metadata(pixels).first()
    kept = json.loads(pixels.schema["bands"].metadata.get("raster", "{}"))
    return Meta(row["width"] or 0, row["height"] or 0, row["n_bands"] or 0, **kept)


def window(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The pixels of a rectangle."""
    return pixels.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))


def is_nodata(bands: Column, value: float | list[float], rule: str = "all") -> Column:
    """Whether a pixel is no-data: ``all`` or ``any`` of its bands equal the value (one value, or one a band)."""
    if rule not in ("all", "any"):
        raise ValueError("rule is all or any")
    test = F.forall if rule == "all" else F.exists
    if isinstance(value, list):
        return test(F.zip_with(bands, F.array(*[F.lit(float(v)) for v in value]), lambda b, v: b == v), lambda same: same)
    return test(bands, lambda b: b == float(value))


def without_nodata(pixels: DataFrame, value: float | list[float] | None, rule: str = "all") -> DataFrame:
    return pixels if value is None else pixels.where(~is_nodata(F.col("bands"), value, rule))
