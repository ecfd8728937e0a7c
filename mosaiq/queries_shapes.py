"""Queries of crossings, simplified polygons and layers, repair, absorption, nesting and windows, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import components, crossings, graph, layers, merge, nesting, ranges, repair, tiling, vector, zonal
from mosaiq.plans.lineage import materialize
from mosaiq.queries import _NODE_SQL, DIM, ORACLE_SQL, PAIRS, PX, REGION_EDGES, REGIONS, flat_nodes, height_of, layout_e, query, raster_e, raster_p, region_graph_e, solid_areas, table_of
from mosaiq.sources import dat

# Crossings.


def _side(s: str, p: str, e: int) -> str:
    """On which side of segment ``s`` end ``e`` of segment ``p`` lies."""
    return f"sign(({s}.x1 - {s}.x0) * ({p}.y{e} - {s}.y0) - ({s}.y1 - {s}.y0) * ({p}.x{e} - {s}.x0))"


def _inside(s: str, p: str, e: int) -> str:
    x, y = f"{p}.x{e}", f"{p}.y{e}"
    return f"({_side(s, p, e)} = 0 AND {x} BETWEEN least({s}.x0, {s}.x1) AND greatest({s}.x0, {s}.x1) AND {y} BETWEEN least({s}.y0, {s}.y1) AND greatest({s}.y0, {s}.y1) AND NOT (({x} = {s}.x0 AND {y} = {s}.y0) OR ({x} = {s}.x1 AND {y} = {s}.y1)))"


_MEET = " OR ".join(
    [
        f"({_side('a', 'b', 0)} * {_side('a', 'b', 1)} < 0 AND {_side('b', 'a', 0)} * {_side('b', 'a', 1)} < 0)",
        *(_inside(s, p, e) for s, p in (("a", "b"), ("b", "a")) for e in (0, 1)),
        "(a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1)",
        "(a.x0 = b.x1 AND a.y0 = b.y1 AND a.x1 = b.x0 AND a.y1 = b.y0)",
    ]
)


@query(
    f"""WITH s AS (SELECT p_partkey AS id, p_partkey % 211 AS x0, CAST(p_size AS BIGINT) * 2 AS y0, p_partkey % 211 + p_partkey % 13 - 6 AS x1, CAST(p_size AS BIGINT) * 2 + p_partkey % 11 - 4 AS y1 FROM part),
    t AS (SELECT * FROM s WHERE x0 <> x1 OR y0 <> y1) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id WHERE {_MEET}"""
)
def segment_crossings(spark, sf_dir):
    """Pairs of segments, made from parts, that share a point which isn't an end of both."""
    key = F.col("p_partkey")
    x, y = key % 211, F.col("p_size").cast("long") * 2
    made = table_of(spark, sf_dir, "part").select(key.alias("id"), F.lit(0).alias("k"), x.alias("x0"), y.alias("y0"), (x + key % 13 - 6).alias("x1"), (y + key % 11 - 4).alias("y1"))
    made = made.where("x0 <> x1 or y0 <> y1")
    return crossings.crossing_pairs(made, made, once=True).select("a", "b")


_RINGS_SQL = """corners AS (SELECT DISTINCT node, x + dx AS cx, y + dy AS cy FROM comp JOIN px USING (pix), (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)),
    cornered AS (SELECT node, count(*) AS v FROM corners GROUP BY node)"""


@query(f"{REGIONS}, {_NODE_SQL}, {_RINGS_SQL} SELECT node, CAST(2 - (v - (4 * area - coalesce(inside, 0)) + area) AS INTEGER) AS n_rings, true AS valid FROM shape JOIN cornered USING (node) LEFT JOIN inner_pairs USING (node)")
def simplified_polygons(spark, sf_dir):
    """Polygons simplified by 2 pixels are valid and have a ring for their outside and for each hole (by Euler's count in SQL)."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    made = vector.polygonize(whole, 100, layout.height, 2.0)
    return made.select("node", F.size("rings").alias("n_rings"), "valid")


@query(ORACLE_SQL["contour_areas"])
def ranked_contour_areas(spark, sf_dir):
    """As ``contour_areas``, with every contour put in order by joins."""
    return solid_areas(spark, sf_dir, 0)


@query(ORACLE_SQL["arc_lengths"])
def ranked_arc_lengths(spark, sf_dir):
    """As ``arc_lengths``, from lines that are all put in order by joins; corners are whole and sides level or upright."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    made = vector.arcs(materialize(vector.unit_sides(whole.members, 100, layout.height)), 0)
    step = lambda k: F.abs(F.col("line")[k + 1]["x"] - F.col("line")[k]["x"]) + F.abs(F.col("line")[k + 1]["y"] - F.col("line")[k]["y"])
    length = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("line") - 2), step), F.lit(0.0), lambda s, v: s + v)
    return made.groupBy("lo", "hi").agg(F.sum(length).cast("long").alias("length"))


def _patches(spark, sf_dir):
    """Large patches over raster E: neighbouring pixels of nearly equal blocks, as a region graph."""
    whole, pixels, layout = region_graph_e(spark, sf_dir)
    return merge.absorb(whole, 12).graph, pixels, layout


@query(f"WITH {PX} SELECT pix, CAST(1 AS BIGINT) AS n_polygons FROM px")
def simplified_cover(spark, sf_dir):
    """How many polygons of large regions, simplified by 5 pixels, hold each pixel's centre."""
    large, pixels, layout = _patches(spark, sf_dir)
    made = vector.polygonize(large, 100, layout.height, 5.0)
    held = zonal.rasterize(made, 100, layout.height).groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    return pixels.select("pix").join(held, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n_polygons"))


# Absorption of many regions into one.

_ABSORBED = f"""{REGIONS}, {REGION_EDGES}, {_NODE_SQL}, means AS (SELECT node, avg(b0) AS m0, avg(b1) AS m1 FROM comp JOIN px USING (pix) GROUP BY node),
    n AS (SELECT shape.node, area, 4 * area - 2 * coalesce(inside, 0) AS perimeter, m0, m1 FROM shape JOIN means USING (node) LEFT JOIN inner_pairs ON inner_pairs.node = shape.node),
    d AS (SELECT lo AS a, hi AS b FROM re UNION ALL SELECT hi, lo FROM re),
    link AS (SELECT a, b FROM (SELECT d.a, d.b, row_number() OVER (PARTITION BY d.a ORDER BY (x.m0 - y.m0) * (x.m0 - y.m0) + (x.m1 - y.m1) * (x.m1 - y.m1), d.b) AS r FROM d JOIN n x ON x.node = d.a JOIN n y ON y.node = d.b WHERE x.area <= 3) WHERE r = 1),
    linked AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    grown(node, root) AS (SELECT node, node FROM n UNION SELECT linked.b, grown.root FROM grown JOIN linked ON linked.a = grown.node),
    grp AS (SELECT node, min(root) AS root FROM grown GROUP BY node),
    joined AS (SELECT x.root AS lo, y.root AS hi, boundary FROM re JOIN grp x ON x.node = lo JOIN grp y ON y.node = hi)"""


def _absorbed(spark, sf_dir):
    whole, _, _ = region_graph_e(spark, sf_dir)
    nodes, edges = materialize(whole.nodes), materialize(whole.edges)
    links = materialize(merge.absorption_links(nodes, edges, 3))
    return merge.contract_groups(nodes, edges, materialize(components.connected_components(links, "node", "other")), 2)


@query(
    f"""{_ABSORBED}, total AS (SELECT root AS node, CAST(sum(area) AS BIGINT) AS area, sum(perimeter) AS around, round(sum(area * m0) / sum(area), 6) AS mean0, round(sum(area * m1) / sum(area), 6) AS mean1 FROM n JOIN grp USING (node) GROUP BY root),
    spread AS (SELECT root AS node, round(stddev_pop(b0), 6) AS std0, round(stddev_pop(b1), 6) AS std1, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM comp JOIN px USING (pix) JOIN grp USING (node) GROUP BY root),
    gone AS (SELECT lo AS node, sum(boundary) AS inside FROM joined WHERE lo = hi GROUP BY lo)
    SELECT total.node, x, y, w, h, area, CAST(around - 2 * coalesce(gone.inside, 0) AS BIGINT) AS perimeter, mean0, mean1, std0, std1 FROM total JOIN spread USING (node) LEFT JOIN gone USING (node)"""
)
def absorbed_nodes(spark, sf_dir):
    """One round in which all regions of up to three pixels join their nearest neighbours at once."""
    return flat_nodes(_absorbed(spark, sf_dir)[0], 6)


@query(f"{_ABSORBED} SELECT least(lo, hi) AS lo, greatest(lo, hi) AS hi, CAST(sum(boundary) AS BIGINT) AS boundary FROM joined WHERE lo <> hi GROUP BY 1, 2")
def absorbed_edges(spark, sf_dir):
    return _absorbed(spark, sf_dir)[1]


@query()
def absorbed_converged(spark, sf_dir):
    whole, _, _ = region_graph_e(spark, sf_dir)
    done = merge.absorb(whole, 3)
    if not done.over:
        raise RuntimeError("small regions were left")
    return flat_nodes(done.graph.nodes, 6)


# Own columns of nodes, and an own cost.


def _histogram_rounds(k: int) -> str:
    """CTEs of rounds in which mutual best neighbours by the distance of their histograms merge."""
    out = ["g0 AS (SELECT pix AS node, CAST(1 AS DOUBLE) AS area, " + ", ".join(f"CAST(CAST(floor(b0) AS BIGINT) % 3 = {b} AS BIGINT) AS h{b}" for b in range(3)) + " FROM px), f0 AS (SELECT lo, hi FROM pe)"]
    for i in range(1, k + 1):
        g, f = f"g{i - 1}", f"f{i - 1}"
        cost = " + ".join(f"abs(a.h{b} / a.area - b.h{b} / b.area)" for b in range(3))
        out.append(
            f"""c{i} AS (SELECT f.lo, f.hi, {cost} AS cost FROM {f} f JOIN {g} a ON a.node = f.lo JOIN {g} b ON b.node = f.hi),
            d{i} AS (SELECT lo AS node, hi AS other, cost FROM c{i} UNION ALL SELECT hi, lo, cost FROM c{i}),
            b{i} AS (SELECT node, other, cost FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, other) AS r FROM d{i}) WHERE r = 1),
            m{i} AS (SELECT a.node AS lo, a.other AS hi FROM b{i} a JOIN b{i} b ON a.other = b.node AND b.other = a.node WHERE a.node < a.other AND a.cost < 1),
            g{i} AS (SELECT coalesce(m.lo, n.node) AS node, sum(area) AS area, {', '.join(f'CAST(sum(h{b}) AS BIGINT) AS h{b}' for b in range(3))} FROM {g} n LEFT JOIN m{i} m ON m.hi = n.node GROUP BY 1),
            f{i} AS (SELECT DISTINCT least(x, y) AS lo, greatest(x, y) AS hi FROM (SELECT coalesce(a.lo, f.lo) AS x, coalesce(b.lo, f.hi) AS y FROM {f} f LEFT JOIN m{i} a ON a.hi = f.lo LEFT JOIN m{i} b ON b.hi = f.hi) WHERE x <> y)"""
        )
    return f"WITH {PX}, {PAIRS}, " + ", ".join(out)


def histogram_criterion() -> merge.MergeCriterion:
    """Regions with like histograms merge: an own column, its sum for the survivor, and an own cost."""

    def cost(a, b, boundary):
        part = lambda s, k: s["histogram"][k] / s["area"].cast("double")
        each = [F.abs(part(a, k) - part(b, k)) for k in range(3)]
        return each[0] + each[1] + each[2]

    pairs = lambda edges, nodes: merge.mutual_pairs(merge.best_neighbours(edges).where("cost < 1"))
    return merge.MergeCriterion(cost, pairs, own={"histogram": lambda a, b, boundary: F.zip_with(a["histogram"], b["histogram"], lambda x, y: x + y)})


def histogram_of() -> dict:
    """The histogram of a node of one pixel: a count for each remainder of its first band."""
    return {"histogram": F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.floor(F.col("mean")[0]) % 3 == k).cast("long"))}


_HISTOGRAMS_SQL = f"{_histogram_rounds(2)} SELECT node, CAST(area AS BIGINT) AS area, h0, h1, h2 FROM g2"


def _flat_histograms(nodes):
    return nodes.select("node", "area", *[F.col("histogram")[k].alias(f"h{k}") for k in range(3)])


@query(_HISTOGRAMS_SQL)
def histogram_merging(spark, sf_dir):
    pixels = raster_e(spark, sf_dir)
    start = graph.initial_graph(pixels, 100, height_of(pixels))
    start = graph.Graph(start.nodes.withColumns(histogram_of()), start.edges, start.members)
    return _flat_histograms(merge.iterate(start, histogram_criterion(), 2).graph.nodes)


@query(_HISTOGRAMS_SQL)
def histogram_merging_tiled(spark, sf_dir):
    """The same by padded tiles: own columns go along from tile to tile."""
    pixels = raster_e(spark, sf_dir)
    layout = layout_e(pixels)
    state = tiling.partial_segmentation(pixels, layout, histogram_criterion(), 1, 1, 2, own=histogram_of())
    return _flat_histograms(tiling.stitched(state.graph, layout).nodes)


# Nesting.

_PATCHES_P = """WITH RECURSIVE px AS (SELECT p_partkey AS pix, p_partkey % 20 AS x, p_partkey // 20 AS y, p_size % 2 AS label FROM part), dim AS (SELECT max(y) + 1 AS h FROM px),
    pe AS (SELECT a.pix AS lo, b.pix AS hi, a.label = b.label AS same FROM px a JOIN px b ON b.pix = a.pix + 1 WHERE a.x < 19 UNION ALL SELECT a.pix, b.pix, a.label = b.label FROM px a JOIN px b ON b.pix = a.pix + 20),
    adj AS (SELECT lo AS a, hi AS b FROM pe WHERE same UNION ALL SELECT hi, lo FROM pe WHERE same),
    reach(pix, root) AS (SELECT pix, pix FROM px UNION SELECT adj.b, reach.root FROM reach JOIN adj ON adj.a = reach.pix),
    comp AS (SELECT pix, min(root) AS node FROM reach GROUP BY pix)"""


@query(
    f"""{_PATCHES_P}, beside AS (SELECT DISTINCT x.node AS a, y.node AS b FROM pe JOIN comp x ON x.pix = lo JOIN comp y ON y.pix = hi WHERE x.node <> y.node),
    blank AS (SELECT pix FROM (SELECT unnest(range(CAST((SELECT h * 20 FROM dim) AS BIGINT))) AS pix) WHERE pix NOT IN (SELECT pix FROM px)),
    open AS (SELECT DISTINCT node FROM comp JOIN px USING (pix), dim WHERE x IN (0, 19) OR y IN (0, h - 1) OR pix + 1 IN (FROM blank) OR pix - 1 IN (FROM blank) OR pix + 20 IN (FROM blank) OR pix - 20 IN (FROM blank)),
    ways AS (SELECT a, b FROM beside UNION SELECT b, a FROM beside),
    outside(wall, node) AS (SELECT w.node, o.node FROM (SELECT DISTINCT node FROM comp) w, open o WHERE w.node <> o.node UNION SELECT outside.wall, ways.b FROM outside JOIN ways ON ways.a = outside.node WHERE ways.b <> outside.wall),
    within AS (SELECT w.node AS wall, r.node FROM (SELECT DISTINCT node FROM comp) w, (SELECT DISTINCT node FROM comp) r WHERE w.node <> r.node AND NOT EXISTS (SELECT 1 FROM outside o WHERE o.wall = w.node AND o.node = r.node)),
    depth AS (SELECT node, count(*) AS d FROM within GROUP BY node)
    SELECT c.node, coalesce((SELECT arg_max(wall, coalesce(depth.d, 0)) FROM within LEFT JOIN depth ON depth.node = within.wall WHERE within.node = c.node), -1) AS parent FROM (SELECT DISTINCT node FROM comp) c"""
)
def enclosing_region(spark, sf_dir):
    """The innermost region around each patch of raster P; in SQL, patches that can't be reached from outside when it is taken away."""
    pixels = raster_p(spark, sf_dir)
    marked = table_of(spark, sf_dir, "part").select(F.col("p_partkey").alias("pix"), (F.col("p_size") % 2).alias("label"))
    height = height_of(pixels)
    return nesting.enclosing_regions(materialize(components.label_components(marked, 20, height)), 20, height)


@query(f"{REGIONS} SELECT pix, node FROM comp")
def contour_members(spark, sf_dir):
    """Every pixel goes back to its region from the contours alone, holes and pinched corners too."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    rows = vector.contours(whole.members, 100, layout.height)
    return dat.innermost(dat.members_of_contours(rows, 100))


# Layers.


def _layer(spark, sf_dir):
    whole, _, layout = region_graph_e(spark, sf_dir)
    return materialize(vector.features(whole, vector.polygonize(whole, 100, layout.height, None)))


@query(
    f"""{REGIONS}, {DIM}, {REGION_EDGES}, outer_sides AS (SELECT node, CAST((x = 0) AS INTEGER) + CAST((x = 99) AS INTEGER) + CAST((y = 0) AS INTEGER) + CAST((y = h - 1) AS INTEGER) AS n FROM comp JOIN px USING (pix), dim)
    SELECT lo, hi, CAST(boundary AS DOUBLE) AS length FROM re UNION ALL SELECT -1, node, CAST(sum(n) AS DOUBLE) FROM outer_sides GROUP BY node HAVING sum(n) > 0"""
)
def layer_arcs(spark, sf_dir):
    """The length of line that features share, found from a layer's rings alone."""
    return layers.shared_lengths(layers.layer_sides(_layer(spark, sf_dir)))


@query(f"{REGIONS}, {_NODE_SQL}, {_RINGS_SQL} SELECT node AS start, CAST(2 - (v - (4 * area - coalesce(inside, 0)) + area) AS INTEGER) AS n_rings, 'true' AS is_valid FROM shape JOIN cornered USING (node) LEFT JOIN inner_pairs USING (node)")
def simplified_layer(spark, sf_dir):
    """A layer simplified by 2 pixels: valid features, with a ring for the outside and for each hole."""
    return layers.simplify_layer(_layer(spark, sf_dir), 2.0).select("start", F.size("rings").alias("n_rings"), "is_valid")


def _ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _faulty(spark, sf_dir):
    """A feature a part: a bow-tie, a rectangle with a spike, one wound twice, one with a ring in its corner, two that overlap."""
    a, b, zero, kind = 4 + F.col("p_size") % 7, 3 + F.col("p_partkey") % 6, F.lit(0), F.col("p_partkey") % 5
    box = lambda w, h, x=0, y=0: [(F.lit(x), F.lit(y)), (w + x, F.lit(y)), (w + x, h + y), (F.lit(x), h + y), (F.lit(x), F.lit(y))]
    corners = box(a, b)
    tie = F.array(_ring(corners[0], corners[2], corners[3], corners[1], corners[0]))
    spike = F.array(_ring(*corners[:3], (a + 5, b), *corners[2:]))
    twice = F.array(_ring(*corners, *corners[1:]))
    nested = F.array(_ring(*corners), _ring(*box(F.lit(2), F.lit(2))))
    both = F.array(_ring(*corners), _ring(*box(a, b, 2, 1)))
    rings = F.when(kind == 0, tie).when(kind == 1, spike).when(kind == 2, twice).when(kind == 3, nested).otherwise(both)
    return table_of(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"), rings.alias("rings"))


@query(
    """WITH p AS (SELECT p_partkey AS start, p_partkey % 5 AS kind, CAST(4 + p_size % 7 AS DOUBLE) AS a, CAST(3 + p_partkey % 6 AS DOUBLE) AS b FROM part)
    SELECT start, CASE WHEN kind IN (0, 4) THEN 2 ELSE 1 END AS parts, CASE kind WHEN 0 THEN a * b / 2 WHEN 1 THEN a * b WHEN 3 THEN a * b - 4 ELSE 2 * (a * b - (a - 2) * (b - 1)) END AS area FROM p WHERE kind <> 2"""
)
def repaired_polygons(spark, sf_dir):
    """Parts and areas of repaired features, none of which is faulty any more; those without area are gone."""
    clean = materialize(repair.clean_layer(_faulty(spark, sf_dir)).select("start", "rings", "part", F.concat_ws("/", "start", "part").alias("id")))
    area = F.aggregate(F.transform("rings", layers.signed_area), F.lit(0.0), lambda s, v: s + v)
    whole = clean.join(repair.faulty_features(_on_grid(clean), "id"), "id", "left_anti")
    return whole.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("parts"), F.round(F.sum(area), 3).alias("area"))


def _on_grid(layer):
    """Crossing points are half a pixel apart here, so twice the size brings them to whole corners."""
    return layer.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] * 2).alias("x"), (p["y"] * 2).alias("y")))))


@query(
    """WITH p AS (SELECT p_partkey AS start, p_partkey // 2 AS pair, p_partkey % 2 AS second, CAST(4 + p_size % 7 AS DOUBLE) AS a, CAST(3 + p_partkey % 6 AS DOUBLE) AS b FROM part)
    SELECT s.start, s.a * s.b - CASE WHEN s.second = 1 AND f.start IS NOT NULL THEN greatest(0, least(f.a, 2 + s.a) - 2) * greatest(0, least(f.b, 1 + s.b) - 1) ELSE 0 END AS area FROM p s LEFT JOIN p f ON f.pair = s.pair AND f.second = 0"""
)
def overlap_free_areas(spark, sf_dir):
    """Rectangles of which each second one overlaps the one before, after overlaps have gone to the first."""
    key = F.col("p_partkey")
    a, b, x, y = 4 + F.col("p_size") % 7, 3 + key % 6, F.floor(key / 2) * 40 + key % 2 * 2, key % 2
    corners = [(x, y), (x + a, y), (x + a, y + b), (x, y + b), (x, y)]
    layer = table_of(spark, sf_dir, "part").select(key.alias("start"), F.array(_ring(*corners)).alias("rings"))
    area = F.aggregate(F.transform("rings", layers.signed_area), F.lit(0.0), lambda s, v: s + v)
    return repair.without_overlaps(layer).groupBy("start").agg(F.sum(area).alias("area"))


# Windows.

_WINDOWS = """win AS (SELECT p_partkey AS win, p_partkey * 7 % 95 AS wx, p_partkey * 3 % h AS wy, CAST(1 + p_size % 20 AS BIGINT) * (1 + p_partkey % 3) AS ww, CAST(1 + p_size % 13 AS BIGINT) AS wh FROM part, dim)"""


def _windows(spark, sf_dir, height: int):
    key = F.col("p_partkey")
    return table_of(spark, sf_dir, "part").select(key.alias("window"), (key * 7 % 95).alias("x"), (key * 3 % height).alias("y"), ((1 + F.col("p_size") % 20) * (1 + key % 3)).alias("w"), (1 + F.col("p_size") % 13).alias("h"))


@query(
    f"""{REGIONS}, {DIM}, {_NODE_SQL}, {_WINDOWS} SELECT win AS "window", count(*) AS n_nodes, least(min(x), min(wx)) AS x, least(min(y), min(wy)) AS y, greatest(max(x + w), max(wx + ww)) - least(min(x), min(wx)) AS w, greatest(max(y + h), max(wy + wh)) - least(min(y), min(wy)) AS h
    FROM (SELECT node, x, y, w, shape.h AS h FROM shape) JOIN (SELECT win, wx, wy, ww, wh FROM win) ON x < wx + ww AND wx < x + w AND y < wy + wh AND wy < y + h GROUP BY win"""
)
def widened_windows(spark, sf_dir):
    """Windows from a table, each widened to hold the regions that it meets whole."""
    whole, _, layout = region_graph_e(spark, sf_dir)
    found = ranges.widened(_windows(spark, sf_dir, layout.height), whole.nodes)
    return found.select("window", "n_nodes", *[F.col(c).cast("long").alias(c) for c in "xywh"])


@query(f"{REGIONS}, {DIM}, {_WINDOWS} SELECT win AS \"window\", pix, node FROM comp JOIN px USING (pix) JOIN (SELECT win, wx, wy, ww, wh FROM win) ON x BETWEEN wx AND wx + ww - 1 AND y BETWEEN wy AND wy + wh - 1")
def many_window_labels(spark, sf_dir):
    """The label image of every window of a table, in one plan."""
    whole, pixels, layout = region_graph_e(spark, sf_dir)
    placed = pixels.select("pix", "x", "y").join(whole.members, "pix")
    return ranges.pixels_in_windows(placed, _windows(spark, sf_dir, layout.height)).select("window", "pix", "node")
