import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.operators import components, graph, labels, vector, zonal
from mosaiq.sources import dat, features, raster
from tests_common import pixels_of


def regions(spark, rows):
    """Pixels, and the graph of patches of equal letters."""
    width, height = len(rows[0]), len(rows)
    pixels = pixels_of(spark, [[ord(c) - 97 for c in row] for row in rows])
    marked = spark.createDataFrame([(y * width + x, c) for y, row in enumerate(rows) for x, c in enumerate(row)], "pix long, label string")
    return pixels, graph.region_graph(components.label_components(marked, width, height), pixels, width, height), width, height


HOLE = ["aaaaa", "abbba", "abcba", "abbba", "aaaaa"]
PINCH = ["aaab", "abab", "aaca", "bbaa"]


@pytest.mark.parametrize("rows", [HOLE, PINCH, ["ab", "ba"], ["aab", "abb", "ccb"]])
@pytest.mark.parametrize("tolerance", [None, 1.0])
def test_polygons_cover_regions(spark, rows, tolerance):
    pixels, g, width, height = regions(spark, rows)
    made = vector.polygonize(g, width, height, tolerance)
    shapes = {r.node: [np.array([(p.x, p.y) for p in ring]) for ring in r.rings] for r in made.collect()}
    assert all(r.valid for r in made.collect())
    areas = {n: sum(map(vector.ring_area, rings)) for n, rings in shapes.items()}
    assert abs(sum(areas.values()) - width * height) < 1e-9  # shared arcs leave no gaps and no overlaps
    if tolerance is None:
        assert areas == {r.node: r.area for r in g.nodes.collect()}
        assert {tuple(r) for r in zonal.rasterize(made, width, height).collect()} == {tuple(r) for r in g.members.collect()}


def test_holes_are_inner_rings(spark):
    _, g, width, height = regions(spark, HOLE)
    rings = {r.node: len(r.rings) for r in vector.polygonize(g, width, height, None).collect()}
    assert rings == {0: 2, 6: 2, 12: 1}


def test_diagonal_patches_are_apart(spark):
    assert regions(spark, ["ab", "ba"])[1].nodes.count() == 4


def test_douglas_peucker():
    line = np.array([(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (3, 3)], float)
    assert vector.douglas_peucker(line, 1.0).tolist() == [[0, 0], [3, 3]]
    assert len(vector.douglas_peucker(line, 0.1)) == 7


def test_predicates(spark):
    rings = {"square": [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], "slanted": [(0, 0), (4, 0), (5, 2), (1, 2), (0, 0)], "kite": [(0, 0), (2, 1), (0, 5), (-2, 1), (0, 0)], "triangle": [(0, 0), (1, 0), (0, 1), (0, 0)]}
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in rings.items()], f"k string, ring {vector.LINE}")
    assert {r.k for r in df.where(vector.is_parallelogram(F.col("ring"))).collect()} == {"square", "slanted"}
    assert not vector.is_simple(np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float))


def test_features_attributes_and_gml(spark, tmp_path):
    pixels, g, width, height = regions(spark, HOLE)
    table = api.polygonize(g, width, height, None)
    rows = {r.start: r for r in api.compute_attributes(table, pixels).collect()}
    assert (rows[0].Mean, rows[6].Mean, rows[12].BorderMean, rows[6].adj, rows[0].label) == (0.0, 1.0, 2.0, [0, 12], 1)
    features.write_gml(table, str(tmp_path / "gml"), "patch")
    back = {r.start: r for r in features.read_gml(spark, str(tmp_path / "gml"), "patch").collect()}
    known = {r.start: r for r in table.collect()}
    assert {k: r.rings for k, r in back.items()} == {k: r.rings for k, r in known.items()} and {k: len(r.rings) for k, r in back.items()} == {0: 2, 6: 2, 12: 1}
    assert {k: (r.label, str(r.adj).split(",")) for k, r in back.items()} == {k: (r.label, [str(v) for v in r.adj]) for k, r in known.items()}
    features.write_layer(table, str(tmp_path / "f"), "cleaned")
    features.write_layer(table.limit(1), str(tmp_path / "f"), "nodata")
    assert features.read_layer(spark, str(tmp_path / "f"), "cleaned").count() == 3


def test_user_aggregates(spark):
    pixels, g, width, height = regions(spark, HOLE)
    largest = zonal.ZonalAggregate("Largest", F.max)
    assert {r.node: r.Largest for r in zonal.zonal(g.members, pixels, [largest], width, height).collect()} == {0: 0.0, 6: 1.0, 12: 2.0}


@pytest.mark.parametrize("rows", [["aabb", "acbb", "ccdd"], HOLE, PINCH, ["aaab", "abaa", "aaba", "caaa"], ["aaaaaaa", "abbbbba", "abcccba", "abcdcba", "abcccba", "abbbbba", "aaaaaaa"]])
def test_graph_files_round_trip(spark, tmp_path, rows):
    _, g, width, height = regions(spark, rows)
    rows = dat.graph_rows(g, width, height).withColumn("tile", F.lit("0_0"))
    dat.write_files(dat.encoded_files(rows, "tile"), str(tmp_path), "tile")
    back = dat.read_graph(spark, str(tmp_path), width)
    assert sorted(map(tuple, back.members.collect())) == sorted(map(tuple, g.members.collect()))
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert {(r.node, r.area, r.perimeter, r.x, r.w) for r in back.nodes.collect()} == {(r.node, r.area, r.perimeter, r.x, r.w) for r in g.nodes.collect()}
    meta = raster.Meta(width, height, 1, 4409712.25, -1.5, 'PROJCS["x"]')
    dat.write_header(str(tmp_path / "g.dat.hdr"), "image.tif", meta)
    assert dat.read_header(spark, str(tmp_path / "g.dat.hdr")) == ("image.tif", meta)
    dat.write_tables(g, str(tmp_path / "tables"))
    assert dat.read_tables(spark, str(tmp_path / "tables")).edges.count() == g.edges.count()


def test_contours_take_in_holes_and_nothing_behind_corners(spark):
    _, g, width, height = regions(spark, ["aaa", "aba", "aab"])
    moves = {r.node: r.moves for r in vector.contours(g.members, width, height).collect()}
    inside = dat.members_of_contours(spark.createDataFrame(list(moves.items()), "node long, moves array<int>"), width)
    assert {r.node: r.n for r in inside.groupBy("node").agg(F.count("pix").alias("n")).collect()} == {0: 7, 4: 1, 8: 1}
    _, ring, width, height = regions(spark, HOLE)
    filled = dat.members_of_contours(vector.contours(ring.members, width, height), width)
    assert {r.node: r["count"] for r in filled.groupBy("node").count().collect()} == {0: 25, 6: 9, 12: 1}


def test_one_pixel_walks_right_down_left_up(spark):
    _, g, width, height = regions(spark, ["ab", "ba"])
    assert {tuple(r.moves) for r in vector.contours(g.members, width, height).collect()} == {(1, 2, 3, 0)}
    assert dat.unpack_moves(dat.pack_moves([1, 2, 3, 0, 1]), 1) == [1, 2, 3, 0, 1]


def test_label_images(spark, tmp_path):
    pixels, g, width, height = regions(spark, ["aab", "cab"])
    some = labels.filled(labels.label_image(g.members.where("node != 2"), width), width, height)
    assert [r.label for r in sorted(some.collect())] == [1, 1, 0, 2, 1, 0]
    labels.write_label_tiles(some, str(tmp_path / "l"), 2, 2)
    assert spark.read.parquet(str(tmp_path / "l")).where("tx = 1").count() == 2
    raster.write_pixels(pixels, str(tmp_path / "p"), 2, 2)
    assert raster.window(raster.read_pixels(spark, str(tmp_path / "p")), 1, 0, 2, 1).count() == 2
    assert raster.without_nodata(pixels, 0.0).count() == 3


def test_mean_shift_segments(spark):
    rng = np.random.default_rng(0)
    grid = [[float((50 if x >= 10 else 0) + rng.normal(0, 1)) for x in range(20)] for _ in range(12)]
    g = api.segment(pixels_of(spark, grid), api.MeanShift(rounds=5, spatial_radius=2, spectral_radius=10.0, join_below=10.0), api.Processing(tile_width=7, tile_height=5))
    assert {(r.node, r.area) for r in g.nodes.collect()} == {(0, 120), (10, 120)}
