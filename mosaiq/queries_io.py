"""Queries of sources, sinks, subgraphs and predicates, and the same in SQL; ``queries`` has the rasters that they use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.functions import spatial
from mosaiq.operators import graph, labels, merge, tiling, vector, zonal
from mosaiq.plans.lineage import materialize, shared_dir
from mosaiq.queries import _NODE_SQL, _nodes_sql, BORDER, DIM, HOPS, PAIRS, PX, REGION_EDGES, REGIONS, SIZE, THRESHOLD, flat_nodes, height_of, query, raster_e, region_graph_e, table_of
from mosaiq.sources import dat, features, raster


def folder(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# Graph files.


def graph_files(spark, sf_dir, tiles_of=None) -> tuple[DataFrame, int]:
    """Rows read back from graph files of raster E's patches, one file a tile of their first pixels (or of ``tiles_of(node, tile)``)."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    rows = dat.graph_rows(whole, 100, layout.height)
    at = tiles_of(whole, layout) if tiles_of else whole.nodes.select("node", layout.tile_of(F.col("x"), F.col("y")).alias("tile"))
    path = folder(spark, "graphs")
    dat.write_files(dat.encoded_files(rows.join(at, "node"), "tile"), path, "tile")
    return dat.read_files(spark, path), layout.height


_FILE_NODES = f"{REGIONS}, {_NODE_SQL}, m AS (SELECT node, CAST(CAST(avg(b0) AS FLOAT) AS DOUBLE) AS mean0 FROM comp JOIN px USING (pix) GROUP BY node)"


@query(f"{_FILE_NODES} SELECT node, x, y, w, h, area, 4 * area - 2 * coalesce(inside, 0) AS perimeter, m.mean0, 2 AS n_bands FROM shape LEFT JOIN inner_pairs USING (node) JOIN m USING (node)")
def graph_file_nodes(spark, sf_dir):
    """Nodes written to graph files by tile and read back (means have single precision there)."""
    return graph_files(spark, sf_dir)[0].select("node", "x", "y", "w", "h", "area", "perimeter", F.col("mean")[0].alias("mean0"), F.size("std").alias("n_bands"))


@query(f"{REGIONS}, {REGION_EDGES} SELECT lo AS node, hi AS dst, boundary FROM re UNION ALL SELECT hi, lo, boundary FROM re")
def graph_file_edges(spark, sf_dir):
    return graph_files(spark, sf_dir)[0].select("node", F.explode("edges").alias("e")).select("node", "e.dst", "e.boundary")


@query(f"{REGIONS}, {_NODE_SQL} SELECT node, 4 * area - 2 * coalesce(inside, 0) >= len AS outer_only, len % 2 = 0 AS closed FROM (SELECT node, area, inside, 2 * (w + h) AS len FROM shape LEFT JOIN inner_pairs USING (node))")
def graph_file_contours(spark, sf_dir):
    """Contours of the files: closed, at least as long as their box's border, at most as long as the perimeter."""
    steps = lambda k: F.size(F.filter("moves", lambda m: m == k))
    return graph_files(spark, sf_dir)[0].select("node", ((F.size("moves") <= F.col("perimeter")) & (F.size("moves") >= 2 * (F.col("w") + F.col("h")))).alias("outer_only"), ((steps(0) == steps(2)) & (steps(1) == steps(3))).alias("closed"))


@query(
    f"""{REGIONS}, {DIM}, {BORDER}, {REGION_EDGES}, both_ways AS (SELECT lo AS a, hi AS b FROM re UNION ALL SELECT hi, lo FROM re),
    hop(tile_id, node, depth) AS (SELECT tile_id, node, 0 FROM border UNION SELECT tile_id, b, depth + 1 FROM hop JOIN both_ways ON a = node WHERE depth < {HOPS})
    SELECT DISTINCT CAST(tile_id AS VARCHAR) AS tile, node FROM hop"""
)
def margin_files(spark, sf_dir):
    """What each tile's margin file tells other tiles, read back from the files."""
    rows, _ = graph_files(spark, sf_dir, lambda whole, layout: tiling.stability_margin(whole, layout, HOPS).select("node", F.col("tile_id").alias("tile")))
    return rows.select(F.regexp_extract("file", r"Graph_(\d+)\.dat", 1).alias("tile"), "node")


@query("""SELECT 'image of Bands' AS image, 100 AS width, CAST(max(event_id // 100) + 1 AS INTEGER) AS height, 2 AS bands, CAST(0.1 AS DOUBLE) AS origin_x, CAST(-4321.123456789012 AS DOUBLE) AS origin_y, 'PROJCS["a", b]' AS projection FROM events""")
def graph_header(spark, sf_dir):
    """A sidecar, written and read back."""
    path = folder(spark, "header")
    spark.range(1).write.parquet(f"{path}/made")
    meta = raster.Meta(100, height_of(raster_e(spark, sf_dir)), 2, 0.1, -4321.123456789012, 'PROJCS["a", b]')
    dat.write_header(f"{path}/Graph.dat.hdr", "image of Bands", meta)
    image, read = dat.read_header(spark, f"{path}/Graph.dat.hdr")
    return spark.createDataFrame([(image, read.width, read.height, read.bands, read.origin_x, read.origin_y, read.projection)], "image string, width int, height int, bands int, origin_x double, origin_y double, projection string")


@query(f"{REGIONS}, {_NODE_SQL}, {REGION_EDGES}, d AS (SELECT lo AS a, boundary FROM re UNION ALL SELECT hi, boundary FROM re), s AS (SELECT a AS node, count(*) AS n_edges, sum(boundary) AS b FROM d GROUP BY a) SELECT node, area, coalesce(n_edges, 0) AS n_edges, CAST(coalesce(b, 0) AS BIGINT) AS boundary FROM shape LEFT JOIN s USING (node)")
def graph_tables(spark, sf_dir):
    """The graph as Parquet tables, written and read back."""
    whole, _, _ = region_graph_e(spark, sf_dir)
    path = folder(spark, "tables")
    dat.write_tables(whole, path)
    back = dat.read_tables(spark, path)
    each = graph.both_ways(back.edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("boundary").alias("boundary"))
    return back.nodes.select("node", "area").join(each, "node", "left").na.fill(0, ["n_edges", "boundary"])


# Vector layers.


def features_e(spark, sf_dir) -> tuple[DataFrame, graph.Graph, tiling.Layout]:
    whole, _, layout = region_graph_e(spark, sf_dir)
    return materialize(vector.features(whole, vector.polygonize(whole, 100, layout.height, None))), whole, layout


_LABELS = "l AS (SELECT node, dense_rank() OVER (ORDER BY node) AS label FROM (SELECT DISTINCT node FROM comp))"


@query(f"{REGIONS}, {_NODE_SQL}, {_LABELS} SELECT CAST(label AS INTEGER) AS label, node AS start, CAST(area AS DOUBLE) AS area, true AS same_adj FROM l JOIN shape USING (node)")
def gml_features(spark, sf_dir):
    """Features written as GML collections and read back: fields, neighbours, and areas of the rings."""
    table, _, _ = features_e(spark, sf_dir)
    path = folder(spark, "gml")
    features.write_gml(table, path, "Reconstructed", 10.0, 20.0)
    back = features.read_gml(spark, path, "Reconstructed")
    cross = lambda r: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda k: r[k]["x"] * r[k + 1]["y"] - r[k + 1]["x"] * r[k]["y"]), F.lit(0.0), lambda s, v: s + v)
    area = F.aggregate(F.transform("rings", cross), F.lit(0.0), lambda s, v: s + v) / 2
    made = back.select(F.col("label").cast("int").alias("label"), F.col("start").cast("long").alias("start"), F.round(area, 6).alias("area"), F.coalesce(F.col("adj").cast("string"), F.lit("")).alias("adj"))
    known = table.select("start", F.array_join("adj", ",").alias("known"))
    return made.join(known, "start").select("label", "start", "area", (F.col("adj") == F.col("known")).alias("same_adj"))


@query(f"{REGIONS}, {_LABELS} SELECT CAST(label AS INTEGER) AS label, node AS start, CAST(node % 100 // {SIZE} AS INTEGER) AS tx, CAST(node // 100 // {SIZE} AS INTEGER) AS ty FROM l")
def vector_tiles(spark, sf_dir):
    """A layer written by name and by tile; other layers in the same place aren't read."""
    table, _, _ = features_e(spark, sf_dir)
    path = folder(spark, "layers")
    features.write_layer(table.where("label < 0"), path, "Other")
    features.write_layer(table, path, "Reconstructed")
    layer = features.read_layer(spark, path, "Reconstructed")
    tiled = layer.withColumn("tx", F.floor(F.col("start") % 100 / SIZE).cast("int")).withColumn("ty", F.floor(F.floor(F.col("start") / 100) / SIZE).cast("int"))
    features.write_tiles(tiled, f"{path}-tiles")
    return spark.read.parquet(f"{path}-tiles").select("label", "start", "tx", "ty")


@query(f"{REGIONS}, {_LABELS} SELECT DISTINCT CAST(l.label AS INTEGER) AS label, node AS start FROM comp JOIN px USING (pix) JOIN l USING (node) WHERE x BETWEEN 30 AND 59 AND y BETWEEN 0 AND 29")
def features_of_tile(spark, sf_dir):
    table, whole, layout = features_e(spark, sf_dir)
    return vector.inside_tile(vector.valid_features(table), whole.members, 100, 30, 0, 30, 30).select("label", "start")


@query(f"{REGIONS}, {_LABELS} SELECT CAST(label AS INTEGER) AS label, node AS start FROM l WHERE label = 7")
def features_by_field(spark, sf_dir):
    return vector.features_at(features_e(spark, sf_dir)[0], "label", 7).select("label", "start")


# Label rasters.


@query(f"{REGIONS}, {_LABELS} SELECT pix, x, y, CAST(l.label AS BIGINT) AS label, x // {SIZE} AS tx, y // {SIZE} AS ty FROM comp JOIN px USING (pix) JOIN l USING (node)")
def label_raster_files(spark, sf_dir):
    """The label image, written by tiles and read back."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    path = folder(spark, "labels")
    labels.write_label_tiles(labels.filled(labels.label_image(whole.members, 100), 100, layout.height).where(F.col("label") > 0), path, SIZE, SIZE)
    return spark.read.parquet(path).select("pix", "x", "y", "label", "tx", "ty")


@query(f"{REGIONS}, {_LABELS} SELECT CAST(label AS BIGINT) AS label, 1 AS n_colours, true AS within FROM l")
def label_colours(spark, sf_dir):
    """Each label has one colour, the same wherever it is computed."""
    whole, _, _ = region_graph_e(spark, sf_dir)
    coloured = labels.colours(labels.label_image(whole.members, 100).repartition(5))
    within = F.min(F.least("red", "green", "blue") >= 0) & F.min(F.greatest("red", "green", "blue") <= 255)
    return coloured.groupBy("label").agg(F.countDistinct("red", "green", "blue").cast("int").alias("n_colours"), within.alias("within"))


# Subgraphs.


@query(f"{REGIONS}, {_NODE_SQL}, {REGION_EDGES} SELECT lo, hi, boundary FROM re JOIN shape a ON a.node = lo JOIN shape b ON b.node = hi WHERE a.area > 1 AND b.area > 1")
def removed_nodes_edges(spark, sf_dir):
    """Edges that stay when all regions of one pixel go."""
    whole, _, _ = region_graph_e(spark, sf_dir)
    return graph.remove_nodes(whole, whole.nodes.where("area = 1").select("node")).edges


@query(f"{REGIONS}, {_NODE_SQL} SELECT pix, node FROM comp JOIN shape USING (node) WHERE area > 1")
def removed_nodes_members(spark, sf_dir):
    whole, _, _ = region_graph_e(spark, sf_dir)
    return graph.remove_nodes(whole, whole.nodes.where("area = 1").select("node")).members.select("pix", "node")


@query(f"{REGIONS}, {_NODE_SQL}, {REGION_EDGES} SELECT lo, hi, boundary FROM re JOIN shape a ON a.node = lo JOIN shape b ON b.node = hi WHERE (a.area > 2) = (b.area > 2)")
def appended_graphs(spark, sf_dir):
    """The subgraphs of small and of other regions, side by side: edges between them are gone."""
    whole, _, _ = region_graph_e(spark, sf_dir)
    part = lambda test: graph.induced(whole, whole.nodes.where(test).select("node"))
    return graph.append(part("area > 2"), part("area <= 2")).edges


@query(f"{REGIONS}, {_NODE_SQL} SELECT node, CAST(area AS DOUBLE) / (w * h) AS filling, x + w AS x1 FROM shape")
def node_columns(spark, sf_dir):
    whole, _, _ = region_graph_e(spark, sf_dir)
    made = graph.for_each_node(whole, filling=F.col("area") / (F.col("w") * F.col("h")), x1=F.col("x") + F.col("w"))
    return made.nodes.select("node", "filling", "x1")


@query("SELECT * FROM (VALUES ('area', 1), ('boundary over perimeter', 1), ('dangling edge', 2), ('edge order', 1), ('key', 1), ('repeated edge', 1), ('repeated node', 1)) AS t(rule, n)")
def broken_graph_violations(spark, sf_dir):
    """Each rule on a chain of four pixels that breaks it."""
    pixels = raster_e(spark, sf_dir).where("pix < 4")
    good = graph.initial_graph(pixels, 100, height_of(raster_e(spark, sf_dir)))
    edge = lambda *rows: spark.createDataFrame(rows, "lo long, hi long, boundary long")
    cases = {
        "edge order": graph.Graph(good.nodes, edge((1, 0, 1)), good.members),
        "repeated edge": graph.Graph(good.nodes, edge((0, 1, 1), (0, 1, 1)), good.members),
        "dangling edge": graph.Graph(good.nodes, edge((5, 6, 1)), good.members),
        "repeated node": graph.Graph(good.nodes.union(good.nodes.where("node = 2")), good.edges, good.members),
        "area": graph.Graph(good.nodes.withColumn("area", F.when(F.col("node") == 3, 9).otherwise(F.col("area"))), good.edges, good.members),
        "key": graph.Graph(good.nodes, good.edges, good.members.withColumn("pix", F.when(F.col("pix") == 3, -3).otherwise(F.col("pix")))),
        "boundary over perimeter": graph.Graph(good.nodes.withColumn("perimeter", F.when(F.col("node") == 0, 0).otherwise(F.col("perimeter")).cast("long")), good.edges, good.members),
    }
    out = None
    for rule, broken in cases.items():
        found = graph.violations(broken).where(F.col("rule") == rule).select("rule", F.col("n").cast("int").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH all_px AS ({PX[7:-1]}), px AS (SELECT * FROM all_px WHERE b1 <> 5), {PAIRS} SELECT lo, hi, CAST(1 AS BIGINT) AS boundary FROM pe")
def nodata_from_metadata(spark, sf_dir):
    """The no-data value that a stored raster carries leaves out its pixels."""
    pixels = raster_e(spark, sf_dir)
    path = folder(spark, "raster")
    one = pixels.withColumn("bands", F.array(F.col("bands")[1]))
    raster.write_pixels(raster.with_meta(one, raster.Meta(100, height_of(pixels), 1, 1.5, 2.5, "P", 5.0)), path, 40, 40)
    back = raster.read_pixels(spark, path)
    meta = raster.read_metadata(back)
    if (meta.origin_x, meta.origin_y, meta.projection, meta.nodata) != (1.5, 2.5, "P", 5.0):
        raise ValueError("the metadata did not come back")
    return graph.initial_edges(raster.without_nodata(back, meta.nodata), meta.width, meta.height)


# Workflows.


def _segment(spark, sf_dir, aggregate: bool) -> DataFrame:
    method = api.Baatz(THRESHOLD**0.5, 0.5, 0.5, most_rounds=3, first_rounds=2, then_rounds=1, aggregate=aggregate)
    return flat_nodes(api.segment(raster_e(spark, sf_dir), method, api.Processing(SIZE, SIZE)).nodes)


@query(_nodes_sql(3))
def segment_with_aggregation(spark, sf_dir):
    """The workflow: two rounds by tiles, then the whole graph."""
    return _segment(spark, sf_dir, True)


@query(_nodes_sql(3))
def segment_without_aggregation(spark, sf_dir):
    """The workflow by tiles to its end."""
    return _segment(spark, sf_dir, False)


@query("SELECT CAST(count(*) AS BIGINT) AS area, true AS none_left FROM events")
def srm_left_over(spark, sf_dir):
    """After small regions have merged, none that has a neighbour is left, and no pixel is lost."""
    start, _, _ = region_graph_e(spark, sf_dir)
    done = api.merge_small_regions(start, 3).graph
    return done.nodes.agg(F.sum("area").alias("area")).withColumn("none_left", F.lit(merge.has_no_small_regions(done, 3)))


# Zones and predicates.


@query(f"{REGIONS}, z AS (SELECT node, max(b0) AS m0, max(b1) AS m1, count(DISTINCT b0) AS d0, count(DISTINCT b1) AS d1 FROM comp JOIN px USING (pix) GROUP BY node) SELECT node, round((m0 + m1) / 2, 6) AS highest, (d0 + d1) / 2 AS values FROM z")
def zonal_user_aggregates(spark, sf_dir):
    """Aggregates that a user brings."""
    whole, pixels, layout = region_graph_e(spark, sf_dir)
    own = [zonal.ZonalAggregate("highest", F.max), zonal.ZonalAggregate("values", F.count_distinct)]
    return zonal.zonal(whole.members, pixels, own, 100, layout.height).select("node", F.round("highest", 6).alias("highest"), "values")


@query(
    """SELECT p_partkey, p_partkey % 3 = 0 AS parallelogram, p_partkey % 2 = 0 OR p_partkey % 5 = 0 AS axis_parallel,
    abs(p_retailprice - p_retailprice * (1 + (p_partkey % 4) * 0.001)) <= greatest(abs(p_retailprice), abs(p_retailprice * (1 + (p_partkey % 4) * 0.001))) * 0.0015 AS near FROM part"""
)
def shape_predicates(spark, sf_dir):
    """Parallelograms (one corner moved in two rings of three), lines along an axis, and nearly equal numbers."""
    part = table_of(spark, sf_dir, "part")
    k, w = F.col("p_partkey"), F.col("p_size").cast("double") + 1
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.array(point(zero, zero), point(w, zero), point(w + 2 + (k % 3) * w, F.lit(3.0) + k % 3), point(F.lit(2.0), F.lit(3.0)), point(zero, zero))
    line = F.array(point(zero, zero), point(k % 2, k % 5))
    price, other = F.col("p_retailprice"), F.col("p_retailprice") * (1 + (k % 4) * 0.001)
    return part.select("p_partkey", vector.is_parallelogram(ring).alias("parallelogram"), vector.is_axis_parallel(line).alias("axis_parallel"), spatial.almost_equal(price, other, 0.0015).alias("near"))


@query("SELECT p_partkey, CAST(p_size + 7 AS INTEGER) AS x, CAST(p_size % 4 + 9 AS INTEGER) AS y, CAST(3 AS INTEGER) AS w, CAST(p_size AS INTEGER) AS h FROM part")
def tile_boxes(spark, sf_dir):
    """Boxes of a tile at (7, 9), in the image."""
    size = F.col("p_size")
    moved = spatial.tile_to_image_box(spatial.box(size, size % 4, F.lit(3), size), 7, 9)
    return table_of(spark, sf_dir, "part").select("p_partkey", moved.alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")
