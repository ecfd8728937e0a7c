"""Crossings, plane simplification, absorption of many regions and nesting, against plain Python."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.operators import components, crossings, graph, layers, meanshift, merge, nesting, ranges, repair, tiling, vector, zonal
from mosaiq.plans import lineage
from mosaiq.sources import features
from test_vector_and_sources import HOLE, PINCH, regions
from tests_common import pixels_of


def meets(p, q):
    """Whether two segments share a point that isn't an end of both, in whole numbers."""
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    within = lambda a, b, c: c not in (a, b) and side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    (a, b), (c, d) = p, q
    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
        return True
    return {a, b} == {c, d} or within(a, b, c) or within(a, b, d) or within(c, d, a) or within(c, d, b)


def test_crossing_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    point = lambda size: (rng.randrange(-size, size), rng.randrange(-size, size))
    made = [(point(25), point(25)) for _ in range(60)] + [((x, y), (x + rng.randrange(-4, 5), y + rng.randrange(-4, 5))) for x, y in (point(20) for _ in range(150))]
    made += [((0, 0), (10, 10)), ((10, 10), (0, 0)), ((2, 2), (5, 5)), ((10, 10), (20, 20)), ((4, -30), (4, 30)), ((-30, 8), (30, 8)), ((8, 8), (8, 12)), ((1_000_000, 3_000_001), (2_999_999, 1)), ((1_999_999, 1_500_001), (2_000_000, 1_500_000))]
    made = [s for s in made if s[0] != s[1]]
    rows = spark.createDataFrame([(i, 0, *a, *b) for i, (a, b) in enumerate(made) if max(map(abs, (*a, *b))) < 1000], "id long, k int, x0 long, y0 long, x1 long, y1 long")
    expected = {(i, j) for i, j in combinations(range(len(made) - 2), 2) if meets(made[i], made[j])}
    for size in (4, 7.5, 100):
        assert {(r.a, r.b) for r in crossings.crossing_pairs(rows, rows, size=size).where("a < b").collect()} == expected
    far = spark.createDataFrame([(i, 0, *a, *b) for i, (a, b) in enumerate(made[-2:])], rows.schema)
    assert crossings.crossing_pairs(far, far, size=50_000).count() == 2 * meets(*made[-2:])


@pytest.mark.parametrize("block", [7, 1024])
def test_many_pairs_of_few_rows_are_dealt_by_cells(spark, monkeypatch, block):
    monkeypatch.setattr(crossings, "BLOCK", block)
    rows = spark.createDataFrame([(k, 0, k % 9, 0, 9 - k % 7, 9) for k in range(80)], "id long, k int, x0 long, y0 long, x1 long, y1 long")
    made = crossings.crossing_pairs(rows, rows, once=True)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    found = [(r.a, r.b) for r in made.collect()]
    both = {(r.a, r.b) for r in crossings.crossing_pairs(rows, rows).collect()}
    assert len(found) == len(set(found)) > 500 and set(found) == {p for p in both if p[0] < p[1]} and len(both) == 2 * len(found)


def smooth(width, height, seed, levels=2, passes=3):
    """Rows of letters in large patches of winding outline."""
    values = np.random.default_rng(seed).random((height, width))
    for _ in range(passes):
        around = np.pad(values, 1, mode="edge")
        values = sum(around[dy : dy + height, dx : dx + width] for dy in range(3) for dx in range(3)) / 9
    marks = np.searchsorted(np.quantile(values, np.arange(1, levels) / levels), values)
    return ["".join("abcdef"[v] for v in row) for row in marks]


def sides_of(rings):
    return [tuple(sorted((a, b))) for ring in rings for a, b in zip(ring[:-1], ring[1:])]


@pytest.mark.parametrize("tolerance, seed, levels", [(1.0, 1, 2), (2.0, 2, 2), (2.0, 5, 4), (5.0, 3, 2), (5.0, 4, 3)])
def test_simplified_polygons_stay_a_plane_graph(spark, tolerance, seed, levels):
    rows = smooth(44, 36, seed, levels)
    _, g, width, height = regions(spark, rows)
    made = lineage.materialize(vector.polygonize(g, width, height, tolerance))
    full = {r.node: r.rings for r in vector.polygonize(g, width, height, None).collect()}
    shapes = {r.node: [[(int(p.x), int(p.y)) for p in ring] for ring in r.rings] for r in made.collect()}
    assert all(r.valid for r in made.collect()) and {n: len(r) for n, r in shapes.items()} == {n: len(r) for n, r in full.items()}
    assert sum(len(r) for rings in shapes.values() for r in rings) < sum(len(r) for rings in full.values() for r in rings)
    sides = sorted({s for rings in shapes.values() for s in sides_of(rings)})
    assert not any(meets(p, q) for p, q in combinations(sides, 2))
    held = zonal.rasterize(made, width, height).groupBy("pix").count()
    assert held.count() == width * height and held.where("count != 1").isEmpty()


def test_lines_that_jump_over_an_island_are_refined(spark):
    """A bay as deep as the tolerance with an island in it: its shore must not be cut off."""
    rows = ["aaaaaaaaaaaa", "aaaaaaaaaaaa", "aaaabbbaaaaa", "aaaabcbaaaaa", "aaaabbbaaaaa", "bbbbbbbbbbbb", "bbbbbbbbbbbb"]
    _, g, width, height = regions(spark, rows)
    made = vector.polygonize(g, width, height, 5.0)
    held = zonal.rasterize(made, width, height).groupBy("pix").count()
    assert held.count() == width * height and held.where("count != 1").isEmpty() and made.where("not valid").isEmpty()
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([(1, line((0, 5), (4, 5), (4, 2), (7, 2), (7, 5), (12, 5)), line((0, 5), (12, 5))), (2, line((5, 3), (6, 3), (6, 4), (5, 4), (5, 3)), line((5, 3), (6, 3), (6, 4), (5, 4), (5, 3))), (3, line((9, 1), (9, 2)), line((9, 1), (9, 2)))], f"id long, full {vector.LINE}, line {vector.LINE}")
    assert [r.id for r in crossings.jumped(lines, lines, 5.0).collect()] == [1]


def test_ends_that_change_places(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    full = [line((0, 0), (3, 0), (3, 3)), line((0, 0), (0, 3)), line((0, 0), (-3, 0), (-3, 1))]
    short = [line((0, 0), (3, 3)), line((0, 0), (0, 3)), line((0, 0), (-3, 1))]
    swapped = [line((0, 0), (-1, 3)), short[1], line((0, 0), (-3, 1))]
    for lines, bad in ((short, set()), (swapped, {0, 1, 2})):
        df = spark.createDataFrame([(k, f, s) for k, (f, s) in enumerate(zip(full, lines))], f"id long, full {vector.LINE}, line {vector.LINE}")
        assert {r.id for r in crossings.reordered_ends(df).collect()} == bad


def test_own_simplifier(spark):
    _, g, width, height = regions(spark, smooth(30, 24, 8))
    made = vector.polygonize(g, width, height, 3.0, simplifier=lambda points, tolerance: points[[0, *range(3, len(points) - 1, 3), len(points) - 1]])
    held = zonal.rasterize(made, width, height).groupBy("pix").count()
    assert held.count() == width * height and held.where("count != 1").isEmpty()


# Absorption.


def all_to_nearest(near, small):
    """``{region: region it joins}``: every small one its nearest neighbour."""
    return {r: min(near[r])[1] for r in small if r in near}


def mutual_pairs_of(near, small):
    """A small region and its nearest neighbour, if it is that one's nearest small neighbour; of conflicting pairs the first by cost and keys."""
    found = set()
    for r in small:
        if r in near:
            cost, other = min(near[r])
            if min(n for n in near[other] if n[1] in small)[1] == r:
                found.add((cost, min(r, other), max(r, other)))
    return {high: low for cost, low, high in found if all((cost, low, high) <= f for f in found if {low, high} & {f[1], f[2]})}


def absorbed(grid, most, rule=all_to_nearest):
    """``{pixel: region}`` after all rounds, a plain model over pixel sets."""
    height, width = len(grid), len(grid[0])
    of = {y * width + x: y * width + x for y in range(height) for x in range(width)}
    value = {y * width + x: grid[y][x] for y in range(height) for x in range(width)}
    for p in sorted(of):  # patches of equal value to start with
        for q in ([p - 1] if p % width else []) + ([p - width] if p >= width else []):
            if value[q] == value[p] and of[q] != of[p]:
                low, high = sorted((of[p], of[q]))
                of = {k: low if v == high else v for k, v in of.items()}
    rounds = 0
    while True:
        rounds += 1
        members, near = {}, {}
        for p, r in of.items():
            members.setdefault(r, []).append(p)
        mean = {r: sum(value[p] for p in ps) / len(ps) for r, ps in members.items()}
        for p in of:
            for q in ([p + 1] if p % width < width - 1 else []) + ([p + width] if p + width < width * height else []):
                if of[p] != of[q]:
                    near.setdefault(of[p], set()).add(of[q])
                    near.setdefault(of[q], set()).add(of[p])
        costs = {r: {(round((mean[r] - mean[s]) ** 2, 9), s) for s in others} for r, others in near.items()}
        links = rule(costs, {r for r in members if len(members[r]) <= most})
        if not links:
            return of, rounds
        root = {r: r for r in members}

        def find(r):
            while root[r] != r:
                r = root[r]
            return r

        for a, b in links.items():
            low, high = sorted((find(a), find(b)))
            root[high] = low
        of = {p: find(r) for p, r in of.items()}


@pytest.mark.parametrize("seed, most", [(1, 1), (2, 3), (3, 6), (4, 500)])
def test_absorption_against_the_model(spark, seed, most):
    rng = random.Random(seed)
    grid = [[rng.choice((1, 2, 4)) if rng.random() < 0.7 else 10 + rng.randrange(1000) / 8 for _ in range(16)] for _ in range(12)]
    pixels = pixels_of(spark, grid)
    marked = pixels.select("pix", F.col("bands")[0].alias("label"))
    start = graph.region_graph(components.label_components(marked, 16, 12), pixels, 16, 12)
    done = api.merge_small_regions(start, most, many_to_one=True)
    of, rounds = absorbed(grid, most)
    assert {r.pix: r.node for r in done.graph.members.collect()} == of and done.rounds == rounds
    again = graph.region_graph(done.graph.members, pixels, 16, 12)
    value = lambda r: (r.node, r.x, r.y, r.w, r.h, r.area, r.perimeter, round(r.mean[0], 6), round(r.std[0], 4))
    assert sorted(map(value, done.graph.nodes.collect())) == sorted(map(value, again.nodes.collect()))
    assert sorted(map(tuple, done.graph.edges.collect())) == sorted(map(tuple, again.edges.collect()))
    assert merge.has_no_small_regions(done.graph, most) and graph.violations(done.graph).isEmpty()


@pytest.mark.parametrize("seed, most", [(5, 2), (6, 4)])
def test_pairwise_absorption_against_the_model(spark, seed, most):
    rng = random.Random(seed)
    grid = [[rng.choice((1, 2, 4)) if rng.random() < 0.8 else 10 + rng.randrange(1000) / 8 for _ in range(11)] for _ in range(8)]
    pixels = pixels_of(spark, grid)
    start = graph.region_graph(components.label_components(pixels.select("pix", F.col("bands")[0].alias("label")), 11, 8), pixels, 11, 8)
    done = api.merge_small_regions(start, most)
    of, rounds = absorbed(grid, most, mutual_pairs_of)
    assert {r.pix: r.node for r in done.graph.members.collect()} == of and done.rounds == rounds


def test_ten_thousand_islands_join_at_once(spark, monkeypatch):
    size = 203
    island = (F.col("x") % 2 == 1) & (F.col("y") % 2 == 1)
    pixels = spark.range(size * size).select(F.col("id").alias("pix"), (F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    pixels = pixels.withColumn("bands", F.array(F.when(island, 5.0 + F.col("pix") % 7).otherwise(1.0)))
    members = lineage.materialize(pixels.select("pix", F.when(island, F.col("pix")).otherwise(0).alias("node")))
    start = graph.region_graph(members, pixels, size, size)
    for plenty in (10**6, 1000):
        monkeypatch.setattr(components, "PLENTY", plenty)
        done = api.merge_small_regions(start, 1, many_to_one=True)
        assert done.rounds == 2 and [(r.node, r.area, r.perimeter) for r in done.graph.nodes.collect()] == [(0, size * size, 4 * size)]


def test_rounds_that_run_out_raise(spark):
    rows = [[9.0 if x % 2 and y % 2 else 1.0 for x in range(9)] for y in range(9)]
    pixels = pixels_of(spark, rows)
    start = graph.region_graph(components.label_components(pixels.select("pix", F.col("bands")[0].alias("label")), 9, 9), pixels, 9, 9)
    for how in (False, True):
        with pytest.raises(RuntimeError, match="left after 1 rounds"):
            api.merge_small_regions(start, 1, 1, how)
    assert api.merge_small_regions(start, 1).rounds == 17  # an island a round


# Nesting.


def around(rows):
    """``{region: innermost region around it}`` by flooding the image from outside, without each region in turn."""
    height, width = len(rows), len(rows[0])
    cell = lambda p: rows[p // width][p % width]
    beside = lambda p: ([p + 1] if p % width < width - 1 else []) + ([p - 1] if p % width else []) + ([p + width] if p + width < width * height else []) + ([p - width] if p >= width else [])
    region = {}
    for p in range(width * height):
        if p not in region and cell(p) != ".":
            todo, region[p] = [p], p
            while todo:
                for n in beside(todo.pop()):
                    if n not in region and cell(n) == cell(p):
                        region[n] = p
                        todo.append(n)
    within = {r: set() for r in set(region.values())}
    for wall in within:
        seen = {p for p in range(width * height) if (p % width in (0, width - 1) or p // width in (0, height - 1)) and region.get(p) != wall}
        todo = list(seen)
        while todo:
            for n in beside(todo.pop()):
                if n not in seen and region.get(n) != wall:
                    seen.add(n)
                    todo.append(n)
        for r in within:
            if r != wall and r not in seen:
                within[r].add(wall)
    return {r: max(w, key=lambda v: len(within[v])) if w else -1 for r, w in within.items()}


NESTED = ["aaaaaaaaaaa", "abbbbbbbbba", "abcccccccba", "abcdedcfcba", "abcdddcccba", "abcccccgcba", "abbbbbbbbba", "aaaaaaaaaaa", "xx.yyyyy.zz", "xx.y...y.zz", "xx.y.q.y.zz", "xx.y...y.zz", "xx.yyyyy.zz"]


@pytest.mark.parametrize("rows", [HOLE, PINCH, NESTED, ["aaa", "aba", "aab"], smooth(30, 24, 2, 4, 1), smooth(24, 20, 6, 2, 1)])
def test_nesting_against_flooding(spark, rows):
    width, height = len(rows[0]), len(rows)
    marked = spark.createDataFrame([(y * width + x, c) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."], "pix long, label string")
    found = nesting.enclosing_regions(components.label_components(marked, width, height), width, height)
    assert {r.node: r.parent for r in found.collect()} == around(rows)


# Tiles.


def test_tile_numbers_may_be_large(spark):
    layout = tiling.Layout(3_000_000, 3_000_000, 100, 100)
    first = 2_999_950 * 3_000_000 + 2_999_899
    pixels = spark.createDataFrame([(first + k, 2_999_899 + k, 2_999_950, [float(k // 2)]) for k in range(3)], "pix long, x int, y int, bands array<double>")
    tiled = tiling.tiled_graph(pixels, layout, 1)
    assert max(r.tile_id for r in tiling.tile_sums(tiled).collect()) > 600_000
    done = tiling.stitched(tiling.partial_segmentation(pixels, layout, merge.baatz(1e-6, 1.0, 0.5), 1, 1, 1).graph, layout)
    assert {r.pix - first: r.node - first for r in done.members.collect()} == {0: 0, 1: 0, 2: 2}


# Layers.


@pytest.mark.parametrize("tolerance", [2.0, 5.0])
def test_layers_simplify_like_their_members(spark, tmp_path, tolerance):
    _, g, width, height = regions(spark, smooth(40, 30, 7, 3))
    table = lineage.materialize(api.polygonize(g, width, height, None))
    features.write_gml(table, str(tmp_path / "gml"), "patch")
    layer = features.read_gml(spark, str(tmp_path / "gml"), "patch").withColumn("start", F.col("start").cast("long"))
    made = layers.simplify_layer(layer, tolerance)
    known = vector.polygonize(g, width, height, tolerance)
    sides = lambda rows, key: {(r[key], frozenset((tuple(a), tuple(b)) for ring in r.rings for a, b in zip(ring[:-1], ring[1:]))) for r in rows}
    assert sides(made.collect(), "start") == sides(known.collect(), "node") and made.where("is_valid != 'true'").isEmpty()
    assert "label" in made.columns and made.count() == g.nodes.count()


def layer_of(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()], f"start long, rings array<{vector.LINE}>")


def test_sides_that_overlap_in_part_match(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    shapes = {1: [box(0, 0, 4, 6)], 2: [box(4, -2, 3, 5)[::-1]], 3: [box(4, 3, 5, 9)], 4: [box(20, 20, 9, 9), box(22, 22, 4, 4)], 5: [box(22, 22, 4, 4)[::-1]]}
    found = {(r.lo, r.hi): r.length for r in layers.shared_lengths(layers.layer_sides(layer_of(spark, shapes))).collect()}
    assert found == {(1, 2): 3.0, (1, 3): 3.0, (2, 3): 3.0, (4, 5): 16.0, (-1, 1): 14.0, (-1, 2): 10.0, (-1, 3): 22.0, (-1, 4): 36.0}


# Repair.

SQUARE = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)]
FAULTY = {
    1: [[(0, 0), (6, 6), (0, 6), (6, 0), (0, 0)]],  # a bow-tie
    2: [[(0, 0), (6, 0), (6, 6), (11, 6), (6, 6), (0, 6), (0, 0)]],  # a spike
    3: [SQUARE + SQUARE[1:]],  # wound twice
    4: [SQUARE, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]],  # a ring in a corner
    5: [SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(10, 0), (12, 0), (12, 2), (10, 0)]],  # a hole and an island
    6: [SQUARE, [(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]],  # nested
    7: [SQUARE, [(3, 3), (9, 3), (9, 9), (3, 9), (3, 3)]],  # overlapping
    8: [[(0, 0), (10, 4), (0, 8), (6, -2), (6, 10), (0, 0)]],  # a star
    9: [[(0, 0), (6, 0), (6, 6), (3, 0), (0, 6), (0, 0)]],  # touches its own side
    10: [[(0, 0), (6, 0), (3, 0), (0, 0)]],  # no area
    11: [SQUARE, [(0, 3), (3, 0), (6, 3), (3, 6), (0, 3)]],  # a hole that touches all sides
}


def even_odd_area(rings, steps=61):
    """The fill's share of a fine raster of points off all grid lines."""
    low, high = -3, 13
    at = low + (np.arange((high - low) * steps) + 0.5) / steps + 1e-7
    total = 0
    for y in at:
        xs = []
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                if (y0 > y) != (y1 > y):
                    xs.append(x0 + (y - y0) / (y1 - y0) * (x1 - x0))
        xs.sort()
        total += sum(b - a for a, b in zip(xs[::2], xs[1::2]))
    return total / steps


def test_repaired_polygons_are_the_even_odd_fill(spark):
    rng = random.Random(11)
    shapes = FAULTY | {k: [[*(points := [(rng.randrange(-3, 14), rng.randrange(-3, 14)) for _ in range(rng.randrange(3, 12))]), points[0]] for _ in range(rng.randrange(1, 3))] for k in range(100, 140)}
    layer = layer_of(spark, shapes)
    assert {r.id for r in repair.faulty_features(layer).collect()} >= {1, 2, 3, 4, 7, 8, 9, 10}
    assert {r.id for r in repair.faulty_features(layer).collect() if r.id < 100} <= {1, 2, 3, 4, 7, 8, 9, 10, 11}
    parts = {}
    for r in repair.repaired(layer).collect():
        parts.setdefault(r.id, []).append([[(p.x, p.y) for p in ring] for ring in r.rings])
    assert {len(parts.get(k, [])) for k in (3, 10)} == {0} and len(parts[1]) == 2 and len(parts[6]) == 2 and len(parts[5]) == 2 and len(parts[11]) == 4
    for k, rings in shapes.items():
        made = parts.get(k, [])
        area = 0.0
        for rings_of in made:
            areas = [vector.ring_area(np.array(r)) for r in rings_of]
            assert areas[0] > 0 and all(a < 0 for a in areas[1:])
            area += sum(areas)
            sides = [s for r in rings_of for s in zip(r[:-1], r[1:])]
            assert len({frozenset(s) for s in sides}) == len(sides) and all(len(set(r[:-1])) == len(r) - 1 for r in rings_of)
            for p, q in combinations(sides, 2):
                assert not proper(p, q)
        assert abs(area - even_odd_area(rings)) < 0.02, k


def test_sides_of_features_are_not_broadcast(spark):
    layer = layer_of(spark, FAULTY)
    for df in (repair.faulty_features(layer), repair.fill_edges(layer)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_features_of_few_and_of_many_sides(spark, monkeypatch):
    """Sides of small features meet each other at once, those of large ones by cells: the same rows."""
    layer = layer_of(spark, FAULTY)
    rows = lambda: (sorted(r.id for r in repair.faulty_features(layer).collect()), sorted(map(tuple, repair.fill_edges(layer).collect())))
    at_once = rows()
    monkeypatch.setattr(repair, "FEW", 0)
    assert rows() == at_once


def proper(p, q):
    """Whether two sides cross by more than rounding."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    (a, b), (c, d) = p, q
    one, two, three, four = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    return min(map(abs, (one, two, three, four))) > 1e-3 and one * two < 0 and three * four < 0


def test_clean_layers_keep_what_is_valid(spark):
    layer = layer_of(spark, {1: [SQUARE], 2: FAULTY[1], 3: FAULTY[3]}).withColumn("label", F.col("start") * 2)
    rows = sorted((r.start, r.part, r.label, len(r.rings[0])) for r in repair.clean_layer(layer).collect())
    assert rows == [(1, 0, 2, 5), (2, 0, 4, 4), (2, 1, 4, 4)]


def test_overlaps_go_to_the_first(spark):
    """Random polygons and a chain of squares: areas by a fine raster, and nothing is covered twice."""
    rng = random.Random(5)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    shapes = {1: [box(0, 0, 6, 6)], 2: [box(3, 3, 6, 6)], 3: [box(1, 1, 3, 3)], 4: [box(-2, 4, 14, 2)], 5: [box(50, 50, 3, 3)], 6: [box(5, -2, 2, 14), box(20, 0, 2, 2)], 7: [box(20, 20, 9, 9)], 9: [box(18, 18, 13, 13)]}
    shapes |= {k: [[*(points := [(rng.randrange(60, 74), rng.randrange(-3, 11)) for _ in range(rng.randrange(3, 8))]), points[0]]] for k in range(20, 26)}
    found = {}
    for r in repair.without_overlaps(layer_of(spark, shapes).withColumn("label", F.col("start"))).collect():
        assert r.label == r.start
        found.setdefault(r.start, []).append([[(p.x, p.y) for p in ring] for ring in r.rings])
    assert 3 not in found and 5 in found

    def inside(rings, x, y):
        return sum(1 for ring in rings for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]) if (y0 > y) != (y1 > y) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) < x) % 2 == 1

    for _ in range(4000):
        x, y = rng.uniform(-3, 32) if rng.random() < 0.6 else rng.uniform(59, 75), rng.uniform(-4, 32)
        first = min((k for k, rings in shapes.items() if inside(rings, x, y)), default=None)
        assert [k for k, parts in found.items() for rings in parts if inside(rings, x, y)] == ([] if first is None else [first])


# Windows.


def test_boxes_that_overlap_against_all_pairs(spark):
    rng = random.Random(4)
    box = lambda k: (k, rng.randrange(-20, 200), rng.randrange(-20, 200), *rng.choice([(1, 1), (rng.randrange(1, 9), rng.randrange(1, 40)), (300, 2), (1000, 1000)]))
    a, b = [box(k) for k in range(60)], [box(k) for k in range(80)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x long, y long, w long, h long")
    found = [(r.a_id, r.b_id) for r in ranges.overlapping(frame(a), frame(b)).collect()]
    expected = {(p[0], q[0]) for p in a for q in b if p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4]}
    assert len(found) == len(set(found)) and set(found) == expected
    pixels = spark.createDataFrame([(x, y) for x in range(-5, 40) for y in range(30)], "x long, y long")
    held = [(r.id, r.x, r.y) for r in ranges.pixels_in_windows(pixels, frame(a), "id").collect()]
    assert len(held) == len(set(held)) and set(held) == {(k, x, y) for k, x0, y0, w, h in a for x in range(-5, 40) for y in range(30) if x0 <= x < x0 + w and y0 <= y < y0 + h}
    assert ranges.pixels_in_windows(pixels, frame(a).limit(0), "id").count() == 0 == ranges.overlapping(frame([]), frame(b)).count()


# Components in two levels.


@pytest.mark.parametrize("width, height", [(1, 7), (9, 1), (13, 11), (32, 17)])
def test_grid_components_by_tiles(spark, monkeypatch, width, height):
    """Winding patches over many tiles, with no-data, against flooding; the labels' column may be text or number."""
    rng = random.Random(width)
    label = {p: rng.choice("aab") if rng.random() < 0.95 else None for p in range(width * height)}
    node = {}
    for p in range(width * height):
        if label[p] is not None and p not in node:
            todo, node[p] = [p], p
            while todo:
                q = todo.pop()
                for n in ([q + 1] if q % width < width - 1 else []) + ([q - 1] if q % width else []) + [q + width, q - width]:
                    if n not in node and label.get(n) == label[q]:
                        node[n] = p
                        todo.append(n)
    labels_ = spark.createDataFrame(list(label.items()), "pix long, label string").repartition(3)
    bands = labels_.where("label is not null").select("pix", F.array(F.when(F.col("label") == "a", 1.0).otherwise(9.0), F.lit(2.0)).alias("bands"))
    for side in (1, 4, 256):
        monkeypatch.setattr(components, "TILE", side)
        assert {r.pix: r.node for r in components.label_components(labels_, width, height).collect()} == node
    assert {r.pix: r.node for r in components.threshold_components(bands, width, height, 5.0).collect()} == node


# Mean shift.


@pytest.mark.parametrize("rounds, radius, search", [(100, 5, True), (7, 2, True), (4, 3, False), (0, 2, True)])
def test_mean_shift_in_batches_against_the_whole_image(spark, rounds, radius, search):
    """The API's defaults among others: windows that travel over many tiles, no-data, ties at half pixels."""
    rng = np.random.default_rng(rounds)
    width, height = 38, 27
    bands = np.stack([np.add.outer(np.arange(height) // 5, np.arange(width) // 6) * 4.0 + rng.integers(0, 9, (height, width)), rng.integers(0, 7, (height, width))], 2)
    valid = rng.random((height, width)) < 0.93
    ys, xs = np.nonzero(valid)
    _, colour, _ = meanshift.move_windows(bands, valid, (0, 0), np.stack([ys, xs], 1), bands[ys, xs], radius, 15.0, 0.1, rounds, search)
    pixels = pixels_of(spark, [[tuple(bands[y, x]) if valid[y, x] else None for x in range(width)] for y in range(height)])
    for layout in (tiling.Layout(width, height, 9, 7), tiling.Layout(width, height, 40, 30)):
        got = {r.pix: r.bands for r in meanshift.smooth(pixels, layout, radius, 15.0, 0.1, rounds, search).collect()}
        assert got == {int(y * width + x): c.tolist() for y, x, c in zip(ys, xs, colour)}
