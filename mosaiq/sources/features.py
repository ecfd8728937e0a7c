"""Vector features: Parquet and GML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layer(features: DataFrame, path: str, layer: str) -> None:
    """A layer as Parquet under ``path/layer=<name>``."""
    features.write.parquet(f"{path}/layer={layer}")


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """The layer of that name, and no other."""
    return spark.read.parquet(f"{path}/layer={layer}")


def write_tiles(features: DataFrame, path: str) -> None:
    """Features with columns ``ty`` and ``tx``, in folders by tile."""
    features.repartition("ty", "tx").write.partitionBy("ty", "tx").parquet(path)


def wkt(rings: Column) -> Column:
    """``POLYGON ((x y, ...), ...)`` of rings."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))), ", "), F.lit(")"))


#: The XML element that holds all features of a GML file, and its namespaces.
COLLECTION = 'ogr:FeatureCollection xmlns:ogr="http://ogr.maptools.org/" xmlns:gml="http://www.opengis.net/gml"'
MEMBER = "gml:featureMember"


def gml_member(features: DataFrame, layer: str = "layer", origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """One column, a struct nested and named as the elements of a GML feature member; lists are joined by commas."""
    point = lambda p: F.concat_ws(",", (p["x"] + origin_x).cast("string"), (p["y"] + origin_y).cast("string"))
    ring = lambda r: F.struct(F.struct(F.array_join(F.transform(r, point), " ").alias("gml:coordinates")).alias("gml:LinearRing"))
    holes = F.slice("rings", 2, F.greatest(F.size("rings"), F.lit(1)))
    polygon = F.struct(ring(F.col("rings")[0]).alias("gml:outerBoundaryIs"), F.transform(holes, ring).alias("gml:innerBoundaryIs"))
    plain = [(c, kind) for c, kind in features.dtypes if not kind.startswith("array<array") and c != "rings"]
    fields = [(F.array_join(c, ",") if kind.startswith("array") else F.col(c)).alias(f"ogr:{c}") for c, kind in plain]
    return features.select(F.struct(F.struct(polygon.alias("gml:Polygon")).alias("ogr:geometryProperty"), *fields).alias(f"ogr:{layer}"))


def write_gml(features: DataFrame, path: str, layer: str = "layer", origin_x: float = 0.0, origin_y: float = 0.0) -> None:
    """GML files written by all tasks; each is a whole feature collection."""
    out = gml_member(features, layer, origin_x, origin_y).write.format("xml").option("rootTag", COLLECTION).option("rowTag", MEMBER).option("validateName", "false")
    out.option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def read_gml(spark: SparkSession, path: str, layer: str = "layer") -> DataFrame:
    """The fields of a GML layer, and ``rings`` of its polygons, outer ring first."""
    rows = spark.read.format("xml").option("rowTag", MEMBER).load(path).select(F.col(f"`ogr:{layer}`.*"))
    coordinates = lambda b: b["gml:LinearRing"]["gml:coordinates"]
    polygon = F.col("`ogr:geometryProperty`.`gml:Polygon`")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["ogr:geometryProperty"].dataType["gml:Polygon"].dataType}
    inner = kinds.get("gml:innerBoundaryIs", "")  # absent if no polygon has a hole, an array if one has several
    holes = F.array().cast("array<string>")
    if inner:
        found = polygon["gml:innerBoundaryIs"]
        listed = F.transform(found, coordinates) if inner.startswith("array") else F.array(coordinates(found))
        holes = F.when(found.isNull(), holes).otherwise(listed)
    texts = F.concat(F.array(coordinates(polygon["gml:outerBoundaryIs"])), holes)
    point = lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y"))
    rings = F.transform(texts, lambda t: F.transform(F.split(t, " "), point))
    return rows.select(*[F.col(f"`{c}`").alias(c.removeprefix("ogr:")) for c in rows.columns if c != "ogr:geometryProperty"], rings.alias("rings"))
