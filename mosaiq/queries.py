"""Queries over rasters made of the driver's tables, and the same in SQL.

Raster E: ``events`` by ``event_id``, 100 wide, bands value and user_id % 100, labels
event_type. O: ``orders``, 100 wide. P: ``part``, 20 wide. V: ``embeddings``, 25 wide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import spatial
from mosaiq.operators import components, graph, labels, merge, meanshift, tiling, vector, zonal
from mosaiq.plans import tile_plan
from mosaiq.plans.lineage import materialize
from mosaiq.sources import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

THRESHOLD, SIZE, MARGIN, HOPS = 10.0, 30, 6, 2


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Rasters.

WIDTHS = {"E": 100, "O": 100, "P": 20, "V": 25}


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels_of(table_of(spark, sf_dir, "events"), "event_id", 100, [F.col("value"), F.col("user_id") % 100])


def labels_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "events").select(F.col("event_id").alias("pix"), F.col("event_type").alias("label"))


def raster_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels_of(table_of(spark, sf_dir, "orders"), "o_orderkey", 100, [F.col("o_totalprice")])


def raster_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels_of(table_of(spark, sf_dir, "part"), "p_partkey", 20, [F.col("p_size"), F.col("p_retailprice")])


def raster_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "embeddings")
    pix = F.col("vec_id")
    return table.select(pix.alias("pix"), spatial.x_of(pix, 25).alias("x"), spatial.y_of(pix, 25).alias("y"), F.transform("embedding", lambda b: b.cast("double")).alias("bands"))


def height_of(pixels: DataFrame) -> int:
    return raster.read_metadata(pixels).height


def layout_e(pixels: DataFrame) -> tiling.Layout:
    return tiling.Layout(100, height_of(pixels), SIZE, SIZE)


def regions_e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Pixels of E, membership in patches of equal event_type, height."""
    pixels = raster_e(spark, sf_dir)
    height = height_of(pixels)
    return pixels, components.label_components(labels_e(spark, sf_dir), 100, height), height


def region_graph_e(spark: SparkSession, sf_dir: str) -> tuple[graph.Graph, DataFrame, tiling.Layout]:
    pixels, members, height = regions_e(spark, sf_dir)
    return graph.region_graph(materialize(members), pixels, 100, height), pixels, tiling.Layout(100, height, SIZE, SIZE)


# SQL of the rasters and of patches.

PX = "px AS (SELECT event_id AS pix, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, CAST(value AS DOUBLE) AS b0, CAST(user_id % 100 AS DOUBLE) AS b1, event_type AS label FROM events)"
PAIRS = "pe AS (SELECT a.pix AS lo, b.pix AS hi FROM px a JOIN px b ON b.pix = a.pix + 1 WHERE a.x < 99 UNION ALL SELECT a.pix, b.pix FROM px a JOIN px b ON b.pix = a.pix + 100)"
REACH = """same AS (SELECT lo, hi FROM pe JOIN px a ON a.pix = lo JOIN px b ON b.pix = hi WHERE a.label = b.label),
adj AS (SELECT lo AS a, hi AS b FROM same UNION ALL SELECT hi, lo FROM same),
reach(pix, root) AS (SELECT pix, pix FROM px UNION SELECT adj.b, reach.root FROM reach JOIN adj ON adj.a = reach.pix),
comp AS (SELECT pix, min(root) AS node FROM reach GROUP BY pix)"""
REGIONS = f"WITH RECURSIVE {PX}, {PAIRS}, {REACH}"
REGION_EDGES = "re AS (SELECT least(a.node, b.node) AS lo, greatest(a.node, b.node) AS hi, count(*) AS boundary FROM pe JOIN comp a ON a.pix = lo JOIN comp b ON b.pix = hi WHERE a.node <> b.node GROUP BY 1, 2)"
DIM = "dim AS (SELECT max(y) + 1 AS h FROM px)"
TILE = f"CAST((y // {SIZE}) * {-(-100 // SIZE)} + x // {SIZE} AS INTEGER)"
COLUMNS = -(-100 // SIZE)


def tile_sql(tile: str = "tile_id") -> str:
    """``x0, y0, x1, y1`` (inclusive) of a tile column, clipped to the image."""
    return f"({tile} % {COLUMNS}) * {SIZE} AS x0, ({tile} // {COLUMNS}) * {SIZE} AS y0, least(({tile} % {COLUMNS}) * {SIZE} + {SIZE - 1}, 99) AS x1, least(({tile} // {COLUMNS}) * {SIZE} + {SIZE - 1}, h - 1) AS y1"


BORDER = f"""placed AS (SELECT pix, node, x, y, {TILE} AS tile_id FROM comp JOIN px USING (pix)),
framed AS (SELECT placed.*, h, {tile_sql()} FROM placed, dim),
border AS (SELECT DISTINCT tile_id, node FROM framed WHERE (x0 > 0 AND x = x0) OR (y0 > 0 AND y = y0) OR (x1 < 99 AND x = x1) OR (y1 < h - 1 AND y = y1))"""


# Sources and projections.


@query("SELECT CAST(max(event_id % 100) + 1 AS INTEGER) AS width, CAST(max(event_id // 100) + 1 AS INTEGER) AS height, 2 AS n_bands, count(*) AS n_pixels FROM events")
def image_metadata(spark, sf_dir):
    return raster.metadata(raster_e(spark, sf_dir))


@query(f"WITH {PX} SELECT pix, x, y, b0, b1 FROM px WHERE x BETWEEN 10 AND 49 AND y BETWEEN 2 AND 31 AND NOT b1 = 7")
def pixels_window(spark, sf_dir):
    window = raster.window(raster_e(spark, sf_dir), 10, 2, 40, 30)
    kept = window.where(~raster.is_nodata(F.array(F.col("bands")[1]), 7.0))
    return kept.select("pix", "x", "y", F.col("bands")[0].alias("b0"), F.col("bands")[1].alias("b1"))


def _neighbours_sql(steps) -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {dx} AS dx, {dy} AS dy" for k, (dx, dy) in enumerate(steps))
    return f"""WITH px AS (SELECT p_partkey AS pix, p_partkey % 20 AS x, p_partkey // 20 AS y FROM part), dim AS (SELECT max(y) + 1 AS h FROM px), s AS ({rows})
    SELECT pix, CAST(k AS INTEGER) AS k, CAST(CASE WHEN x + dx BETWEEN 0 AND 19 AND y + dy BETWEEN 0 AND h - 1 THEN pix + dy * 20 + dx ELSE -1 END AS BIGINT) AS n FROM px, dim, s"""


@query(_neighbours_sql(spatial.FOUR))
def neighbours4(spark, sf_dir):
    pixels = raster_p(spark, sf_dir)
    return pixels.select("pix", F.posexplode(spatial.neighbours(F.col("pix"), 20, height_of(pixels))).alias("k", "n"))


@query(_neighbours_sql(spatial.EIGHT))
def neighbours8(spark, sf_dir):
    pixels = raster_p(spark, sf_dir)
    return pixels.select("pix", F.posexplode(spatial.neighbours(F.col("pix"), 20, height_of(pixels), spatial.EIGHT)).alias("k", "n"))


_BOXES = f"""WITH {PX}, b AS (SELECT pix, x, y, CAST(1 + b1 % 5 AS INTEGER) AS w, CAST(1 + b1 % 7 AS INTEGER) AS h FROM px)"""


def _boxes(spark, sf_dir):
    return raster_e(spark, sf_dir).select("pix", spatial.box(F.col("x"), F.col("y"), 1 + F.col("bands")[1] % 5, 1 + F.col("bands")[1] % 7).alias("b"))


@query(
    f"""{_BOXES} SELECT pix, x >= 20 AND y >= 3 AND x + w - 1 <= 60 AND y + h - 1 <= 40 AS inside, x > 20 AND y > 3 AND x + w - 1 < 60 AND y + h - 1 < 40 AS strictly,
    x > 60 OR y > 40 OR x + w - 1 < 20 OR y + h - 1 < 3 AS outside, least(x, 30) AS mx, least(y, 5) AS my, greatest(x + w, 34) - least(x, 30) AS mw, greatest(y + h, 12) - least(y, 5) AS mh,
    (pix // 30 + 5) * 100 + pix % 30 + 7 AS moved, x IN (3, 50) OR y IN (0, 4) AS lines FROM b"""
)
def box_predicates(spark, sf_dir):
    b, lit = F.col("b"), F.lit
    joined = spatial.merged_box(b, spatial.box(lit(30), lit(5), lit(4), lit(7)))
    return _boxes(spark, sf_dir).select(
        "pix",
        spatial.box_inside(b, 20, 3, 60, 40).alias("inside"),
        spatial.box_strictly_inside(b, 20, 3, 60, 40).alias("strictly"),
        spatial.box_outside(b, 20, 3, 60, 40).alias("outside"),
        joined["x"].alias("mx"), joined["y"].alias("my"), joined["w"].alias("mw"), joined["h"].alias("mh"),
        spatial.tile_to_image_pixel(F.col("pix"), 30, 7, 5, 100).alias("moved"),
        spatial.on_lines(b["x"], b["y"], [3, 50], [0, 4]).alias("lines"),
    )


# Graph construction.


def flat_nodes(nodes: DataFrame, digits: int | None = None) -> DataFrame:
    value = lambda c: F.round(c, digits) if digits is not None else c
    stats = [value(F.col(c)[k]).alias(f"{c}{k}") for c in ("mean", "std") for k in (0, 1)]
    return nodes.select("node", *[F.col(c).cast("int").alias(c) for c in "xywh"], "area", "perimeter", *stats)


@query(f"WITH {PX} SELECT pix AS node, x, y, 1 AS w, 1 AS h, CAST(1 AS BIGINT) AS area, CAST(4 AS BIGINT) AS perimeter, b0 AS mean0, b1 AS mean1, CAST(0 AS DOUBLE) AS std0, CAST(0 AS DOUBLE) AS std1 FROM px")
def initial_nodes(spark, sf_dir):
    return flat_nodes(graph.initial_nodes(raster_e(spark, sf_dir)))


@query(f"WITH {PX}, {PAIRS} SELECT lo AS src, hi AS dst, CAST(1 AS BIGINT) AS boundary FROM pe UNION ALL SELECT hi, lo, CAST(1 AS BIGINT) FROM pe")
def initial_edges(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    return graph.both_ways(graph.initial_edges(pixels, 100, height_of(pixels)))


@query(f"WITH all_px AS ({PX[7:-1]}), px AS (SELECT * FROM all_px WHERE NOT b1 IN (3, 5)), {PAIRS} SELECT lo, hi, CAST(1 AS BIGINT) AS boundary FROM pe")
def initial_edges_nodata(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    kept = pixels.where(~F.col("bands")[1].isin(3.0, 5.0))
    return graph.initial_edges(kept, 100, height_of(pixels))


# Merging. The SQL of a round is generated, so that it can be unrolled.


def _round_sql(k: int) -> str:
    """CTEs ``n<k>`` and ``e<k>`` from those of round k - 1."""
    n, e = f"n{k - 1}", f"e{k - 1}"
    mean = lambda b: f"((a.m{b} * a.area + b.m{b} * b.area) / (a.area + b.area))"
    std = lambda b: f"sqrt((a.area * a.s{b} * a.s{b} + b.area * b.s{b} * b.s{b} + a.area * (a.m{b} - {mean(b)}) * (a.m{b} - {mean(b)}) + b.area * (b.m{b} - {mean(b)}) * (b.m{b} - {mean(b)})) / (a.area + b.area))"
    grown = lambda b: f"((a.area + b.area) * t{b} - (a.area * a.s{b} + b.area * b.s{b}))"
    return f"""p{k} AS (SELECT e.lo, e.hi, e.boundary, {mean(0)} AS u0, {mean(1)} AS u1, {std(0)} AS t0, {std(1)} AS t1,
      least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h,
      a.area + b.area AS area, a.per + b.per - 2.0 * e.boundary AS per FROM {e} e JOIN {n} a ON a.node = e.lo JOIN {n} b ON b.node = e.hi),
    h{k} AS (SELECT p.*, 0.5 * ({grown(0)} + {grown(1)}) AS hetero,
      p.area * p.per / CAST(2 * (p.w + p.h) AS DOUBLE) - (a.area * a.per / CAST(2 * (a.w + a.h) AS DOUBLE) + b.area * b.per / CAST(2 * (b.w + b.h) AS DOUBLE)) AS smooth,
      p.area * p.per / sqrt(p.area) - (a.area * a.per / sqrt(a.area) + b.area * b.per / sqrt(b.area)) AS compact
      FROM p{k} p JOIN {n} a ON a.node = p.lo JOIN {n} b ON b.node = p.hi),
    c{k} AS (SELECT *, CASE WHEN hetero >= {THRESHOLD} THEN hetero ELSE hetero + 0.5 * (0.5 * compact + 0.5 * smooth) END AS cost FROM h{k}),
    d{k} AS (SELECT lo AS node, hi AS other, cost FROM c{k} UNION ALL SELECT hi, lo, cost FROM c{k}),
    b{k} AS (SELECT node, other, cost FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, other) AS r FROM d{k}) WHERE r = 1),
    m{k} AS (SELECT a.node AS lo, a.other AS hi FROM b{k} a JOIN b{k} b ON a.other = b.node AND b.other = a.node WHERE a.node < a.other AND a.cost < {THRESHOLD}),
    n{k} AS (SELECT * FROM {n} WHERE node NOT IN (SELECT lo FROM m{k} UNION SELECT hi FROM m{k}) UNION ALL SELECT lo, x, y, w, h, area, per, u0, u1, t0, t1 FROM c{k} JOIN m{k} USING (lo, hi)),
    w{k} AS (SELECT least(coalesce(a.lo, e.lo), coalesce(b.lo, e.hi)) AS lo, greatest(coalesce(a.lo, e.lo), coalesce(b.lo, e.hi)) AS hi, boundary FROM {e} e LEFT JOIN m{k} a ON a.hi = e.lo LEFT JOIN m{k} b ON b.hi = e.hi),
    e{k} AS (SELECT lo, hi, sum(boundary) AS boundary FROM w{k} WHERE lo <> hi GROUP BY lo, hi)"""


START = "n0 AS (SELECT pix AS node, x, y, 1 AS w, 1 AS h, CAST(1 AS DOUBLE) AS area, CAST(4 AS DOUBLE) AS per, b0 AS m0, b1 AS m1, CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS s1 FROM px), e0 AS (SELECT lo, hi, CAST(1 AS DOUBLE) AS boundary FROM pe)"


def _rounds_sql(k: int) -> str:
    return f"WITH {PX}, {PAIRS}, {START}, " + ", ".join(_round_sql(i) for i in range(1, k + 1))


def _nodes_sql(k: int) -> str:
    return f"{_rounds_sql(k)} SELECT node, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(area AS BIGINT) AS area, CAST(per AS BIGINT) AS perimeter, m0 AS mean0, m1 AS mean1, s0 AS std0, s1 AS std1 FROM n{k}"


def _criterion() -> merge.MergeCriterion:
    return merge.baatz(THRESHOLD, 0.5, 0.5)


def _merged(spark, sf_dir, rounds: int) -> merge.Outcome:
    pixels = raster_e(spark, sf_dir)
    return merge.iterate(graph.initial_graph(pixels, 100, height_of(pixels)), _criterion(), rounds)


def _settled(outcome: merge.Outcome) -> DataFrame:
    """The nodes of a merging that went on until nothing was left to merge."""
    if not outcome.over:
        raise RuntimeError(f"merging did not settle in {outcome.rounds} rounds")
    return outcome.graph.nodes


def _costed(spark, sf_dir) -> DataFrame:
    pixels = raster_e(spark, sf_dir)
    start = graph.initial_graph(pixels, 100, height_of(pixels))
    return merge.costed(start.edges, start.nodes, _criterion())


@query(f"{_rounds_sql(1)} SELECT lo, hi, cost FROM c1")
def edge_cost(spark, sf_dir):
    return _costed(spark, sf_dir).select("lo", "hi", "cost")


@query(
    """WITH px AS (SELECT vec_id AS pix, vec_id % 25 AS x, embedding AS b FROM embeddings),
    pe AS (SELECT a.pix AS lo, b.pix AS hi, a.b AS p, b.b AS q FROM px a JOIN px b ON b.pix = a.pix + 1 WHERE a.x < 24 UNION ALL SELECT a.pix, b.pix, a.b, b.b FROM px a JOIN px b ON b.pix = a.pix + 25),
    d AS (SELECT lo, hi, sum(2 * sqrt(((CAST(u AS DOUBLE) - (CAST(u AS DOUBLE) + CAST(v AS DOUBLE)) / 2) ** 2 + (CAST(v AS DOUBLE) - (CAST(u AS DOUBLE) + CAST(v AS DOUBLE)) / 2) ** 2) / 2)) AS s FROM (SELECT lo, hi, unnest(p) AS u, unnest(q) AS v FROM pe) GROUP BY lo, hi)
    SELECT lo, hi, round(s, 6) AS cost FROM d"""
)
def edge_cost_multiband(spark, sf_dir):
    pixels = raster_v(spark, sf_dir)
    start = graph.initial_graph(pixels, 25, height_of(pixels))
    # With all weight on the spectrum there is no shape term.
    costs = merge.costed(start.edges, start.nodes, merge.baatz(1e18, 1.0, 0.5))
    return costs.select("lo", "hi", F.round("cost", 6).alias("cost"))


@query(f"{_rounds_sql(1)} SELECT node, other, cost FROM b1")
def best_neighbour(spark, sf_dir):
    return merge.best_neighbours(_costed(spark, sf_dir)).select("node", "other", "cost")


@query(f"{_rounds_sql(1)} SELECT lo, hi FROM m1")
def mutual_pairs(spark, sf_dir):
    return _criterion().choose(_costed(spark, sf_dir), None)


@query(_nodes_sql(1))
def baatz_iter1_nodes(spark, sf_dir):
    return flat_nodes(_merged(spark, sf_dir, 1).graph.nodes)


@query(f"{_rounds_sql(1)} SELECT lo, hi, CAST(boundary AS BIGINT) AS boundary FROM e1")
def baatz_iter1_edges(spark, sf_dir):
    return _merged(spark, sf_dir, 1).graph.edges


@query(_nodes_sql(3))
def baatz_iter3_nodes(spark, sf_dir):
    return flat_nodes(_merged(spark, sf_dir, 3).graph.nodes)


@query(f"{_rounds_sql(3)} SELECT px.pix, coalesce(c3.lo, c2.lo, c1.lo, px.pix) AS node FROM px LEFT JOIN (SELECT hi, lo FROM m1 UNION ALL SELECT lo, lo FROM m1) c1 ON c1.hi = px.pix LEFT JOIN (SELECT hi, lo FROM m2 UNION ALL SELECT lo, lo FROM m2) c2 ON c2.hi = coalesce(c1.lo, px.pix) LEFT JOIN (SELECT hi, lo FROM m3 UNION ALL SELECT lo, lo FROM m3) c3 ON c3.hi = coalesce(c2.lo, c1.lo, px.pix)")
def baatz_iter3_members(spark, sf_dir):
    return _merged(spark, sf_dir, 3).graph.members


@query()
def baatz_converged(spark, sf_dir):
    return flat_nodes(_settled(_merged(spark, sf_dir, 40)))


@query(_nodes_sql(3))
def baatz_tiled_iter3(spark, sf_dir):
    """Three rounds by padded tiles, stitched: the same regions as without tiles."""
    pixels = raster_e(spark, sf_dir)
    layout = layout_e(pixels)
    state = tiling.partial_segmentation(pixels, layout, _criterion(), 2, 1, 3)
    return flat_nodes(tiling.stitched(state.graph, layout).nodes)


@query(f"{_rounds_sql(3)} SELECT lo, hi, CAST(boundary AS BIGINT) AS boundary FROM e3")
def baatz_tiled_iter3_edges(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    layout = layout_e(pixels)
    return tiling.stitched(tiling.partial_segmentation(pixels, layout, _criterion(), 3, 1, 3).graph, layout).edges


_SRM = f"""WITH {PX}, {PAIRS}, c AS (SELECT lo, hi, (a.b0 - b.b0) * (a.b0 - b.b0) + (a.b1 - b.b1) * (a.b1 - b.b1) AS cost FROM pe JOIN px a ON a.pix = lo JOIN px b ON b.pix = hi)"""
_SRM_PAIRS = """d AS (SELECT lo AS s, hi AS t, cost FROM c UNION ALL SELECT hi, lo, cost FROM c),
    best AS (SELECT s, t, cost FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY cost, t) AS r FROM d) WHERE r = 1),
    cand AS (SELECT DISTINCT least(a.s, a.t) AS lo, greatest(a.s, a.t) AS hi, a.cost FROM best a JOIN best b ON b.s = a.t AND b.t = a.s),
    ends AS (SELECT lo AS node, cost, lo, hi FROM cand UNION ALL SELECT hi, cost, lo, hi FROM cand),
    won AS (SELECT lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, lo, hi) AS r FROM ends) WHERE r = 1)"""


@query(f"{_SRM} SELECT lo, hi, cost AS distance FROM c")
def srm_edge_distance(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    start = graph.initial_graph(pixels, 100, height_of(pixels))
    return merge.costed(start.edges, start.nodes, merge.small_regions(1)).select("lo", "hi", F.col("cost").alias("distance"))


@query(f"{_SRM}, {_SRM_PAIRS} SELECT lo, hi FROM won GROUP BY lo, hi HAVING count(*) = 2")
def srm_pairs_round1(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    start = graph.initial_graph(pixels, 100, height_of(pixels))
    criterion = merge.small_regions(1)
    return criterion.choose(merge.costed(start.edges, start.nodes, criterion), start.nodes)


@query(
    f"""{REGIONS}, {REGION_EDGES}, n AS (SELECT node, count(*) AS area, avg(b0) AS m0, avg(b1) AS m1 FROM comp JOIN px USING (pix) GROUP BY node),
    c AS (SELECT lo, hi, (a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) AS cost FROM re JOIN n a ON a.node = lo JOIN n b ON b.node = hi),
    d AS (SELECT lo AS s, hi AS t, cost FROM c UNION ALL SELECT hi, lo, cost FROM c),
    near AS (SELECT s, t, cost FROM (SELECT d.*, row_number() OVER (PARTITION BY s ORDER BY cost, t) AS r FROM d JOIN n ON n.node = s WHERE n.area <= 3) WHERE r = 1),
    small AS (SELECT s, t FROM (SELECT d.*, row_number() OVER (PARTITION BY s ORDER BY cost, t) AS r FROM d JOIN n ON n.node = t WHERE n.area <= 3) WHERE r = 1),
    cand AS (SELECT DISTINCT least(a.s, a.t) AS lo, greatest(a.s, a.t) AS hi, a.cost FROM near a JOIN small b ON b.s = a.t AND b.t = a.s),
    ends AS (SELECT lo AS node, cost, lo, hi FROM cand UNION ALL SELECT hi, cost, lo, hi FROM cand),
    won AS (SELECT lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, lo, hi) AS r FROM ends) WHERE r = 1)
    SELECT lo, hi FROM won GROUP BY lo, hi HAVING count(*) = 2"""
)
def srm_pairs_regions(spark, sf_dir):
    """Pairs of a round over regions of many sizes, where the best small neighbour isn't always the best one."""
    start, _, _ = region_graph_e(spark, sf_dir)
    criterion = merge.small_regions(3)
    return criterion.choose(materialize(merge.costed(start.edges, start.nodes, criterion)), start.nodes)


@query()
def srm_converged(spark, sf_dir):
    start, _, _ = region_graph_e(spark, sf_dir)
    return flat_nodes(_settled(merge.iterate(start, merge.small_regions(3))), 6)


# Components and regions.


@query(f"{REGIONS} SELECT pix, node FROM comp")
def label_components(spark, sf_dir):
    return regions_e(spark, sf_dir)[1]


@query(
    """WITH RECURSIVE px AS (SELECT o_orderkey AS pix, o_orderkey % 100 AS x, o_orderpriority AS label FROM orders),
    pe AS (SELECT a.pix AS lo, b.pix AS hi FROM px a JOIN px b ON b.pix = a.pix + 1 WHERE a.x < 99 AND a.label = b.label UNION ALL SELECT a.pix, b.pix FROM px a JOIN px b ON b.pix = a.pix + 100 WHERE a.label = b.label),
    adj AS (SELECT lo AS a, hi AS b FROM pe UNION ALL SELECT hi, lo FROM pe),
    reach(pix, root) AS (SELECT pix, pix FROM px UNION SELECT adj.b, reach.root FROM reach JOIN adj ON adj.a = reach.pix)
    SELECT pix, min(root) AS node FROM reach GROUP BY pix"""
)
def label_components_orders(spark, sf_dir):
    pixels = raster_o(spark, sf_dir)
    marked = table_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pix"), F.col("o_orderpriority").alias("label"))
    return components.label_components(marked, 100, height_of(pixels))


@query(f"{REGIONS} SELECT a AS pix, min(b) AS neighbour FROM adj GROUP BY a")
def same_label_neighbour(spark, sf_dir):
    return components.same_label_neighbour(labels_e(spark, sf_dir), 100, height_of(raster_e(spark, sf_dir)))


@query(
    """WITH RECURSIVE px AS (SELECT p_partkey AS pix, p_partkey % 20 AS x, CAST(p_size AS DOUBLE) AS b0, CAST(p_retailprice AS DOUBLE) AS b1 FROM part),
    pe AS (SELECT a.pix AS lo, b.pix AS hi, a.b0 - b.b0 AS d0, a.b1 - b.b1 AS d1 FROM px a JOIN px b ON b.pix = a.pix + 1 WHERE a.x < 19 UNION ALL SELECT a.pix, b.pix, a.b0 - b.b0, a.b1 - b.b1 FROM px a JOIN px b ON b.pix = a.pix + 20),
    near AS (SELECT lo, hi FROM pe WHERE sqrt(d0 * d0 + d1 * d1) < 40), adj AS (SELECT lo AS a, hi AS b FROM near UNION ALL SELECT hi, lo FROM near),
    reach(pix, root) AS (SELECT pix, pix FROM px UNION SELECT adj.b, reach.root FROM reach JOIN adj ON adj.a = reach.pix)
    SELECT pix, min(root) AS node FROM reach GROUP BY pix"""
)
def threshold_components(spark, sf_dir):
    pixels = raster_p(spark, sf_dir)
    return components.threshold_components(pixels, 20, height_of(pixels), 40.0)


_NODE_SQL = """inner_pairs AS (SELECT a.node, count(*) AS inside FROM pe JOIN comp a ON a.pix = lo JOIN comp b ON b.pix = hi WHERE a.node = b.node GROUP BY a.node),
    shape AS (SELECT node, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, round(avg(b0), 6) AS mean0, round(avg(b1), 6) AS mean1, round(stddev_pop(b0), 6) AS std0, round(stddev_pop(b1), 6) AS std1 FROM comp JOIN px USING (pix) GROUP BY node)"""


@query(f"{REGIONS}, {_NODE_SQL} SELECT node, x, y, w, h, area, 4 * area - 2 * coalesce(inside, 0) AS perimeter, mean0, mean1, std0, std1 FROM shape LEFT JOIN inner_pairs USING (node)")
def component_nodes(spark, sf_dir):
    return flat_nodes(region_graph_e(spark, sf_dir)[0].nodes, 6)


@query(f"{REGIONS}, {REGION_EDGES} SELECT lo, hi, boundary FROM re")
def component_edges(spark, sf_dir):
    return region_graph_e(spark, sf_dir)[0].edges


@query("SELECT CAST('' AS VARCHAR) AS rule, CAST(0 AS BIGINT) AS n WHERE false")
def graph_violations(spark, sf_dir):
    return graph.violations(_merged(spark, sf_dir, 2).graph)


@query(f"{REGIONS}, {REGION_EDGES} SELECT (SELECT count(DISTINCT node) FROM comp) AS n_nodes, 2 * count(*) AS n_edges, (SELECT count(DISTINCT node) FROM comp) * 96 + 2 * count(*) * 24 AS bytes FROM re")
def graph_memory_estimate(spark, sf_dir):
    return graph.memory_estimate(region_graph_e(spark, sf_dir)[0], 2)


# Labels.


@query(f"{REGIONS} SELECT node, dense_rank() OVER (ORDER BY node) AS label FROM (SELECT DISTINCT node FROM comp)")
def relabel_scan_order(spark, sf_dir):
    return labels.scan_order_labels(regions_e(spark, sf_dir)[1])


@query(f"{REGIONS}, l AS (SELECT pix, dense_rank() OVER (ORDER BY node) AS label FROM comp) SELECT pix, x, y, l.label AS label FROM l JOIN px USING (pix) WHERE x BETWEEN 20 AND 59 AND y BETWEEN 1 AND 8")
def window_labels(spark, sf_dir):
    return labels.window_labels(regions_e(spark, sf_dir)[1], 100, 20, 1, 40, 8)


# Tiles.


@query(
    f"""WITH {PX}, {DIM}, t AS (SELECT tx, ty, h FROM (SELECT h, unnest(range(CAST((h + {SIZE - 1}) // {SIZE} AS BIGINT))) AS ty FROM dim), (SELECT unnest(range({COLUMNS})) AS tx)),
    f AS (SELECT ty * {COLUMNS} + tx AS tile_id, tx, ty, tx * {SIZE} AS x0, ty * {SIZE} AS y0, least({SIZE}, 100 - tx * {SIZE}) AS w, least({SIZE}, h - ty * {SIZE}) AS hh, h FROM t)
    SELECT CAST(tile_id AS INTEGER) AS tile_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(w AS INTEGER) AS w, CAST(hh AS INTEGER) AS h,
    CAST(least({MARGIN}, y0) AS INTEGER) AS m_top, CAST(least({MARGIN}, 100 - x0 - w) AS INTEGER) AS m_right, CAST(least({MARGIN}, h - y0 - hh) AS INTEGER) AS m_bottom, CAST(least({MARGIN}, x0) AS INTEGER) AS m_left FROM f"""
)
def tiles(spark, sf_dir):
    return tile_plan.tiles(spark, 100, height_of(raster_e(spark, sf_dir)), SIZE, SIZE, MARGIN)


@query(f"WITH {PX} SELECT pix, {TILE} AS tile_id FROM px")
def tile_of_pixel(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    return tiling.tile_pixels(pixels, layout_e(pixels)).select("pix", "tile_id")


@query(
    f"""WITH {PX}, {DIM}, t AS (SELECT DISTINCT {TILE} AS tile_id FROM px), f AS (SELECT tile_id, {tile_sql()} FROM t, dim)
    SELECT tile_id, count(*) AS n, sum(pix) AS pixels FROM f JOIN px ON x BETWEEN x0 - {MARGIN} AND x1 + {MARGIN} AND y BETWEEN y0 - {MARGIN} AND y1 + {MARGIN} GROUP BY tile_id"""
)
def padded_tiles(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    dealt = tiling.tile_pixels(pixels, layout_e(pixels), MARGIN)
    return dealt.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pix").alias("pixels"))


@query(f"{REGIONS} SELECT DISTINCT {TILE} AS tile_id, node FROM comp JOIN px USING (pix)")
def split_graph(spark, sf_dir):
    _, members, height = regions_e(spark, sf_dir)
    return tiling.node_tiles(members, tiling.Layout(100, height, SIZE, SIZE))


@query(
    f"""{REGIONS}, {DIM}, t AS (SELECT DISTINCT {TILE} AS tile_id FROM px), f AS (SELECT tile_id, {tile_sql()} FROM t, dim),
    seen AS (SELECT DISTINCT tile_id, node FROM f JOIN px ON x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2 JOIN comp USING (pix))
    SELECT tile_id, node FROM seen EXCEPT SELECT {TILE}, node FROM comp JOIN px USING (pix)"""
)
def unstable_nodes(spark, sf_dir):
    whole, pixels, layout = region_graph_e(spark, sf_dir)
    near = tiling.tile_pixels(pixels, layout, 2).join(whole.members, "pix").select("tile_id", "node").distinct()
    found = tiling.unstable_nodes(tiling._keyed(whole, near), layout)
    return found.select("node.tile_id", "node.node")


@query(f"{REGIONS}, {DIM}, {BORDER} SELECT tile_id, node FROM border")
def tile_border_nodes(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    return tiling.border_nodes(whole, layout)


@query(
    f"""{REGIONS}, {DIM}, {BORDER}, {REGION_EDGES}, both_ways AS (SELECT lo AS a, hi AS b FROM re UNION ALL SELECT hi, lo FROM re),
    hop(tile_id, node, depth) AS (SELECT tile_id, node, 0 FROM border UNION SELECT tile_id, b, depth + 1 FROM hop JOIN both_ways ON a = node WHERE depth < {HOPS})
    SELECT tile_id, node, min(depth) AS depth FROM hop GROUP BY tile_id, node"""
)
def stability_margin(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    return tiling.stability_margin(whole, layout, HOPS)


@query(
    f"""{REGIONS}, {DIM} SELECT pix, node FROM comp JOIN px USING (pix), dim WHERE (x % {SIZE} = 0 AND x > 0) OR (x % {SIZE} = {SIZE - 1} AND x < 99) OR (y % {SIZE} = 0 AND y > 0) OR (y % {SIZE} = {SIZE - 1} AND y < h - 1)"""
)
def border_map(spark, sf_dir):
    _, members, height = regions_e(spark, sf_dir)
    found = tiling.border_map(members, tiling.Layout(100, height, SIZE, SIZE))
    return found.select("pix", F.explode("nodes").alias("node"))


@query(f"{REGIONS}, {REGION_EDGES} SELECT lo, hi, boundary FROM re")
def stitched_edges(spark, sf_dir):
    """Regions cut into tiles and stitched: edges that only cross tile sides are found again."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    return tiling.stitched(tiling.split_graph(whole, layout), layout).edges


@query(f"{REGIONS} SELECT tile_id, count(*) AS n_nodes FROM (SELECT DISTINCT {TILE} AS tile_id, node FROM comp JOIN px USING (pix)) GROUP BY tile_id")
def tile_sums(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    return tiling.tile_sums(tiling.split_graph(whole, layout)).select("tile_id", "n_nodes")


# Zones and polygons.


@query(f"{REGIONS}, z AS (SELECT node, avg(b0) AS m0, avg(b1) AS m1 FROM comp JOIN px USING (pix) GROUP BY node) SELECT node, round((m0 + m1) / 2, 6) AS mean FROM z")
def zonal_mean(spark, sf_dir):
    pixels, members, height = regions_e(spark, sf_dir)
    return zonal.zonal(materialize(members), pixels, [zonal.MEAN], 100, height).select("node", F.round("Mean", 6).alias("mean"))


_EDGE_PIXELS = """beside AS (SELECT lo AS pix FROM pe JOIN comp a ON a.pix = lo JOIN comp b ON b.pix = hi WHERE a.node <> b.node UNION SELECT hi FROM pe JOIN comp a ON a.pix = lo JOIN comp b ON b.pix = hi WHERE a.node <> b.node
    UNION SELECT pix FROM px, dim WHERE x IN (0, 99) OR y IN (0, h - 1))"""


@query(f"{REGIONS}, {DIM}, {_EDGE_PIXELS}, z AS (SELECT node, avg(b0) AS m0, avg(b1) AS m1 FROM beside JOIN comp USING (pix) JOIN px USING (pix) GROUP BY node) SELECT node, round((m0 + m1) / 2, 6) AS border_mean FROM z")
def zonal_border_mean(spark, sf_dir):
    pixels, members, height = regions_e(spark, sf_dir)
    return zonal.zonal(materialize(members), pixels, [zonal.BORDER_MEAN], 100, height).select("node", F.round("BorderMean", 6).alias("border_mean"))


@query(
    f"""{REGIONS}, {DIM}, {REGION_EDGES}, outer_sides AS (SELECT node, CAST((x = 0) AS INTEGER) + CAST((x = 99) AS INTEGER) + CAST((y = 0) AS INTEGER) + CAST((y = h - 1) AS INTEGER) AS n FROM comp JOIN px USING (pix), dim)
    SELECT lo, hi, boundary AS length FROM re UNION ALL SELECT -1, node, CAST(sum(n) AS BIGINT) FROM outer_sides GROUP BY node HAVING sum(n) > 0"""
)
def arc_lengths(spark, sf_dir):
    _, members, height = regions_e(spark, sf_dir)
    return vector.shared_sides(vector.unit_sides(materialize(members), 100, height))


@query(f"{REGIONS}, {_NODE_SQL} SELECT node, area, 4 * area - 2 * coalesce(inside, 0) AS perimeter FROM shape LEFT JOIN inner_pairs USING (node)")
def polygon_area_perimeter(spark, sf_dir):
    _, members, height = regions_e(spark, sf_dir)
    return vector.polygon_measures(vector.unit_sides(materialize(members), 100, height))


@query(f"{REGIONS}, {_NODE_SQL} SELECT node, CAST(area AS DOUBLE) AS area, true AS valid FROM shape")
def polygon_rings(spark, sf_dir):
    """Polygons traced from arcs; the area is the shoelace sum over their rings."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    made = vector.polygonize(whole, 100, layout.height, None)
    cross = lambda r: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda k: r[k]["x"] * r[k + 1]["y"] - r[k + 1]["x"] * r[k]["y"]), F.lit(0.0), lambda s, v: s + v)
    return made.select("node", (F.aggregate(F.transform("rings", cross), F.lit(0.0), lambda s, v: s + v) / 2).alias("area"), "valid")


@query(f"{REGIONS} SELECT pix, node FROM comp")
def rasterized_polygons(spark, sf_dir):
    """Polygons turned back into pixels give the regions they came from."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    return zonal.rasterize(vector.polygonize(whole, 100, layout.height, None), 100, layout.height)


@query(f"{REGIONS}, {REGION_EDGES}, l AS (SELECT node, dense_rank() OVER (ORDER BY node) AS label FROM (SELECT DISTINCT node FROM comp)), d AS (SELECT lo AS a, hi AS b FROM re UNION ALL SELECT hi, lo FROM re) SELECT CAST(l.label AS INTEGER) AS label, l.node AS start, d.b AS other, CAST(o.label AS INTEGER) AS other_label FROM l JOIN d ON d.a = l.node JOIN l o ON o.node = d.b")
def adjacent_features(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    table = materialize(vector.features(whole, vector.polygonize(whole, 100, layout.height, None)))
    near = vector.adjacent_features(table).withColumnRenamed("label", "other_label")
    return near.join(table.select("start", "label"), "start").select("label", "start", "other", "other_label")


_SOLID_SQL = """blocks AS (SELECT a.node, count(*) AS n FROM comp a JOIN px p ON p.pix = a.pix AND p.x < 99 JOIN comp b ON b.pix = a.pix + 1 AND b.node = a.node JOIN comp c ON c.pix = a.pix + 100 AND c.node = a.node JOIN comp d ON d.pix = a.pix + 101 AND d.node = a.node GROUP BY a.node)"""


def solid_areas(spark, sf_dir, traced: int):
    """Pixels in the contours of all regions without holes (pixels - pairs + blocks = 1); a contour takes in the holes of others."""
    from mosaiq.sources.dat import members_of_contours

    pixels, members, height = regions_e(spark, sf_dir)
    members = materialize(members)
    inside = members_of_contours(vector.contours(members, 100, height, traced), 100).groupBy("node").agg(F.count(F.lit(1)).alias("area"))
    beside = lambda step: F.when((F.col("pix") % 100 < 99) | (step == 100), F.col("pix") + step)
    member = lambda k: members.select(F.col("pix").alias(k), F.col("node").alias(f"node{k}"))
    four = members.withColumns({"r": beside(1), "d": beside(100), "rd": beside(101)}).join(member("r"), "r", "left").join(member("d"), "d", "left").join(member("rd"), "rd", "left")
    same = [F.coalesce(F.col(f"node{k}") == F.col("node"), F.lit(False)) for k in ("r", "d", "rd")]
    solid = four.groupBy("node").agg(F.sum(1 - same[0].cast("int") - same[1].cast("int") + (same[0] & same[1] & same[2]).cast("int")).alias("euler")).where("euler = 1")
    return inside.join(solid, "node", "left_semi")


@query(f"{REGIONS}, {_NODE_SQL}, {_SOLID_SQL} SELECT node, area FROM shape LEFT JOIN inner_pairs USING (node) LEFT JOIN blocks USING (node) WHERE area - coalesce(inside, 0) + coalesce(n, 0) = 1")
def contour_areas(spark, sf_dir):
    """Contours of regions without holes, decoded to pixels again."""
    return solid_areas(spark, sf_dir, vector.TRACED)


@query()
def meanshift_labels(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    return meanshift.mean_shift_segments(pixels, layout_e(pixels), 2, 15.0, 0.1, 4, 10.0)


@query(
    f"""{REGIONS}, {DIM}, {BORDER}, {REGION_EDGES}, shape AS (SELECT node, count(*) AS area FROM comp GROUP BY node), ways AS (SELECT lo AS a, hi AS b FROM re UNION ALL SELECT hi, lo FROM re),
    grown(tile_id, node, area) AS (SELECT tile_id, node, area FROM border JOIN shape USING (node) UNION SELECT tile_id, b, grown.area + shape.area FROM grown JOIN ways ON a = grown.node JOIN shape ON shape.node = b WHERE grown.area + shape.area <= 6)
    SELECT tile_id, node, min(area) AS area FROM grown GROUP BY tile_id, node"""
)
def small_region_margins(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    return tiling.small_region_margin(whole, layout, 6)
