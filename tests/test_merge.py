import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.operators import graph, merge, tiling
from mosaiq.plans import tile_plan
from tests_common import pixels_of


def model(grid, threshold, sw, shw, rounds):
    """Mutual-best merging of a small raster, a region at a time."""
    height, width = len(grid), len(grid[0])
    nodes = {y * width + x: dict(px={(x, y)}, v=[grid[y][x]]) for y in range(height) for x in range(width) if grid[y][x] is not None}
    owner = {(k % width, k // width): k for k in nodes}

    def shape(px):
        xs, ys = [p[0] for p in px], [p[1] for p in px]
        around = sum((x + dx, y + dy) not in px for x, y in px for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        return len(px), around, 2 * (max(xs) - min(xs) + 1 + max(ys) - min(ys) + 1)

    def cost(a, b):
        px = nodes[a]["px"] | nodes[b]["px"]
        (na, pa, la), (nb, pb, lb), (n, p, around) = shape(nodes[a]["px"]), shape(nodes[b]["px"]), shape(px)
        std = lambda k: np.std(nodes[k]["v"])
        h = sw * (n * np.std(nodes[a]["v"] + nodes[b]["v"]) - (na * std(a) + nb * std(b)))
        if h >= threshold:
            return round(h, 9)
        smooth = n * p / around - (na * pa / la + nb * pb / lb)
        compact = n * p / math.sqrt(n) - (na * pa / math.sqrt(na) + nb * pb / math.sqrt(nb))
        return round(h + (1 - sw) * (shw * compact + (1 - shw) * smooth), 9)

    for _ in range(rounds):
        near = {k: {owner[q] for x, y in nodes[k]["px"] for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if q in owner} - {k} for k in nodes}
        best = {k: min((cost(min(k, j), max(k, j)), j) for j in near[k]) for k in nodes if near[k]}
        pairs = [(k, j) for k, (c, j) in best.items() if k < j and c < threshold and best[j][1] == k]
        if not pairs:
            break
        for a, b in pairs:
            other = nodes.pop(b)
            nodes[a]["px"] |= other["px"]
            nodes[a]["v"] += other["v"]
            for p in other["px"]:
                owner[p] = a
    return {y * width + x: k for (x, y), k in owner.items()}


def members(g):
    return {r.pix: r.node for r in g.members.collect()}


def test_blocks_merge_to_two(spark):
    grid = [[0, 0, 100, 100]] * 4
    got = merge.iterate(graph.initial_graph(pixels_of(spark, grid), 4, 4), merge.baatz(300.0, 0.9, 0.5), 20)
    assert got.over and set(members(got.graph).values()) == {0, 2}


def test_nodata_leaves_a_node_without_edges(spark):
    grid = [[5] * 5, [5, None, None, None, 5], [5, None, 7, None, 5], [5, None, None, None, 5], [5] * 5]
    got = merge.iterate(graph.initial_graph(pixels_of(spark, grid), 5, 5), merge.baatz(1e9, 0.5, 0.5), 20)
    assert members(got.graph)[12] == 12 and set(members(got.graph).values()) == {0, 12}


def test_ties_go_to_the_lower_key(spark):
    got = merge.iterate(graph.initial_graph(pixels_of(spark, [[1] * 3] * 3), 3, 3), merge.baatz(1e9, 1.0, 0.5), 1)
    assert members(got.graph) == model([[1] * 3] * 3, 1e9, 1.0, 0.5, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rasters_against_the_model(spark, seed):
    rng = random.Random(seed)
    grid = [[None if rng.random() < 0.08 else rng.choice((1, 2, 9, 20)) + rng.random() for _ in range(9)] for _ in range(7)]
    got = merge.iterate(graph.initial_graph(pixels_of(spark, grid), 9, 7), merge.baatz(8.0, 0.7, 0.4), 30)
    assert members(got.graph) == model(grid, 8.0, 0.7, 0.4, 30) and graph.violations(got.graph).isEmpty()
    row = got.graph.nodes.join(got.graph.members, "node").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("area").alias("area")).where("n != area")
    assert row.isEmpty()


def test_tiles_change_nothing(spark):
    rng = random.Random(9)
    grid = [[rng.choice((1, 2, 9, 20)) + rng.random() for _ in range(24)] for _ in range(12)]
    pixels = pixels_of(spark, grid)
    criterion, layout = merge.baatz(8.0, 0.7, 0.4), tiling.Layout(24, 12, 8, 6)
    whole = merge.iterate(graph.initial_graph(pixels, 24, 12), criterion, 3).graph
    tiled = tiling.stitched(tiling.partial_segmentation(pixels, layout, criterion, 2, 1, 3).graph, layout)
    assert members(tiled) == members(whole)
    assert sorted(tiled.edges.collect()) == sorted(whole.edges.select("lo", "hi", "boundary").collect())


def test_small_regions_are_absorbed(spark):
    rng = random.Random(4)
    pixels = pixels_of(spark, [[rng.random() * 9 for _ in range(8)] for _ in range(6)])
    got = api.merge_small_regions(graph.initial_graph(pixels, 8, 6), 3)
    assert got.over and merge.has_no_small_regions(got.graph, 3) and graph.violations(got.graph).isEmpty()
    assert got.graph.nodes.agg(F.sum("area")).first()[0] == 48


def test_segment_by_tiles_and_whole(spark):
    rng = random.Random(6)
    pixels = pixels_of(spark, [[[rng.choice((1, 9)) + rng.random(), rng.random()] for _ in range(16)] for _ in range(8)])
    method = api.Baatz(scale=3, spectral_weight=0.8, shape_weight=0.5, most_rounds=4, first_rounds=2)
    assert members(api.segment(pixels, method)) == members(api.segment(pixels, method, api.Processing(tile_width=8, tile_height=4)))


def test_balanced_sizes():
    assert [tile_plan.balanced_size(*c) for c in ((1000, 300), (1000, 250), (100, 30), (90, 30), (7, 4), (9, 4))] == [251, 250, 26, 30, 4, 4]


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and giant components, with hubs apart and without, against union-find."""
    import random

    from mosaiq.operators import components as c

    rng = random.Random(6)
    edges = [(0, k) for k in range(1, 400)] + [(k, 5000) for k in range(1000, 1300)] + [(k, k + 1) for k in range(2000, 2060)] + [(3000 + rng.randrange(200), 3000 + rng.randrange(200)) for _ in range(150)] + [(7, 7), (7, None)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "src long, dst long")
    for plenty, hubs in ((10**6, 2000), (10, 20)):
        monkeypatch.setattr(c, "PLENTY", plenty)
        monkeypatch.setattr(c, "HUBS", hubs)
        assert {r.node: r.component for r in c.connected_components(df).collect()} == {x: find(x) for x in linked}


def test_what_is_broadcast_is_small(spark):
    from mosaiq.plans.lineage import BROADCAST, sized, unsized

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with sized(spark):
        assert int(spark.conf.get(name)) == BROADCAST
    assert spark.conf.get(name) == before
    few, many = spark.range(10), spark.range(100).selectExpr("explode(sequence(0, 99)) as id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(many.join(few, "id")) and "Broadcast" not in plan(unsized(many).join(few, "id"))


def test_scratch_deletes_what_it_wrote(spark):
    import os

    from mosaiq.plans.lineage import materialize, scratch, shared_dir

    kept = materialize(spark.range(5))
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    with scratch(spark):
        assert materialize(spark.range(3)).count() == 3
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before and kept.count() == 5
