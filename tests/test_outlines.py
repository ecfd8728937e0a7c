"""Outlines put in order by joins against those that one task traces, and list ranking against a walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import outlines, vector
from mosaiq.plans import lineage
from test_shapes import smooth
from test_vector_and_sources import HOLE, PINCH, regions


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_against_a_walk(spark, seed):
    """Lists and rings of 1 to 40 ids, in shuffled order."""
    rng = random.Random(seed)
    ids, groups = list(range(400)), []
    rng.shuffle(ids)
    while ids:
        size = min(len(ids), rng.choice([1, 2, 3, 4, 5, 8, 17, 40]))
        groups.append((ids[:size], rng.random() < 0.5))
        ids = ids[size:]
    rows, expected = [], {}
    for group, is_ring in groups:
        rows += [(a, b) for a, b in zip(group, group[1:] + [group[0] if is_ring else None])]
        chain = min(group) if is_ring else group[-1]
        at = group.index(chain)
        for k, i in enumerate(group):
            expected[i] = (chain, ((at - k - 1) % len(group) + 1) if is_ring else at - k)
    rng.shuffle(rows)
    found = outlines.ranked(spark.createDataFrame(rows, "id long, next long"))
    assert {r.id: (r.chain, r.left) for r in found.collect()} == expected
    assert outlines.ranked(spark.createDataFrame([], "id long, next long")).count() == 0


def comb(teeth, depth):
    """One region of ``teeth`` teeth on a back, and another one between them."""
    return ["a" * (2 * teeth)] + ["ab" * teeth] * depth


@pytest.mark.parametrize("rows", [HOLE, PINCH, ["ab", "ba"], ["aa", "aa"], comb(6, 3), smooth(40, 30, 3, 3, 1)])
def test_ranked_outlines_are_the_traced_ones(spark, rows):
    _, g, width, height = regions(spark, rows)
    sides = lineage.materialize(vector.unit_sides(g.members, width, height))
    lines = lambda traced: sorted((r.lo, r.hi, [tuple(p) for p in r.line], r.closed) for r in vector.arcs(sides, traced).collect())
    assert lines(0) == lines(vector.TRACED)
    moves = lambda traced: {r.node: (r.start, r.moves) for r in vector.contours(g.members, width, height, traced).collect()}
    assert moves(0) == moves(vector.TRACED) == moves(8)


def test_slanted_runs_of_layers(spark):
    """Slanted sides stay single, level ones go on until they stop; collinear points of a ranked line go."""
    sides = [(-1, 1, 0, 0, 3, 0, False), (-1, 1, 3, 0, 5, 0, False), (-1, 1, 5, 0, 7, 2, False), (-1, 1, 7, 2, 9, 4, False), (-1, 1, 9, 4, 9, 6, False), (-1, 1, 9, 6, 9, 9, True)]
    rows = spark.createDataFrame(sides, "lo long, hi long, x0 int, y0 int, x1 int, y1 int, stops boolean")
    runs = lineage.materialize(outlines.straight_runs(rows, ["lo", "hi"]))
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.stops) for r in runs.collect()) == [(0, 0, 5, 0, False), (5, 0, 7, 2, False), (7, 2, 9, 4, False), (9, 4, 9, 6, False), (9, 6, 9, 9, True)]
    made = sorted([tuple(p) for p in r.line] for r in vector.ranked_arcs(runs).collect())
    assert made == [[(0, 0), (5, 0), (9, 4), (9, 6)], [(9, 6), (9, 9)]]


def test_one_outline_of_a_million_sides(spark):
    """A comb of 1,000 columns: its outline has over a million sides, and no task puts together more than a quarter of them, or ranks more than a quarter of a list."""
    width, height = 1000, 1002
    pix = spark.range(width * height).withColumnRenamed("id", "pix")
    x, y = F.col("pix") % width, F.floor(F.col("pix") / width)
    members = lineage.materialize(pix.select("pix", F.when((y == 0) | ((x % 2 == 0) & (y < height - 1)) | ((y == height - 1) & (x == 0)), 0).otherwise(1).cast("long").alias("node")).where("node = 0"))
    sides = lineage.materialize(vector.unit_sides(members, width, height).withColumn("stops", F.lit(False)))
    n_sides = sides.count()
    assert n_sides > 10**6
    # Tasks are neither joined nor files read together because they are small.
    names = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "64k"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        n = 250_000
        line = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"))
        found = lineage.materialize(outlines.ranked(line).where(f"chain = {n - 1} and left = {n - 1} - id").withColumn("task", F.spark_partition_id()))
        assert found.count() == n and found.groupBy("task").count().agg(F.max("count")).first()[0] <= n / 4
        runs = lineage.materialize(outlines.straight_runs(sides, ["node"]).withColumn("task", F.spark_partition_id()))
        length = F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0")))
        assert runs.groupBy("task").agg(length.alias("n")).agg(F.max("n"), F.sum("n")).where(f"`max(n)` <= {n_sides} / 4 and `sum(n)` = {n_sides}").count() == 1
        moves = vector.contours(members, width, height, 100).first().moves
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    steps = np.array([(0, -1), (1, 0), (0, 1), (-1, 0)])[np.array(moves)]
    path = np.vstack([[0, 0], steps.cumsum(0)])
    assert len(moves) == n_sides and (path[-1] == 0).all() and vector.ring_area(path) == members.count()


def test_many_outlines_at_once_are_those_of_a_walk(monkeypatch):
    """Regions with holes and pinched corners, all together and cut into portions, against chains of each."""
    import pyarrow as pa

    from mosaiq.operators import vector
    from mosaiq.sources import dat

    rng = np.random.default_rng(8)
    rows, height, width = [], 40, 30
    image = (rng.random((height, width)) < 0.62).astype(int)
    label, seen = -np.ones((height, width), int), 0
    for y, x in np.ndindex(height, width):
        if label[y, x] < 0:
            todo = [(y, x)]
            label[y, x] = y * width + x
            while todo:
                b, a = todo.pop()
                for v, u in ((b - 1, a), (b, a + 1), (b + 1, a), (b, a - 1)):
                    if 0 <= v < height and 0 <= u < width and label[v, u] < 0 and image[v, u] == image[y, x]:
                        label[v, u] = y * width + x
                        todo.append((v, u))
    corner = lambda x, y: [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)]
    for y, x in np.ndindex(height, width):
        for (v, u), side in zip(((y - 1, x), (y, x + 1), (y + 1, x), (y, x - 1)), corner(x, y)):
            if not (0 <= v < height and 0 <= u < width and label[v, u] == label[y, x]):
                rows.append((label[y, x], *side))
    sides = rng.permutation(np.array(rows))
    nodes, g = np.unique(sides[:, 0], return_inverse=True)
    moves, sizes = vector.outer_moves(g, *sides[:, 1:].T, len(nodes))
    for k, (node, got) in enumerate(zip(nodes, np.split(moves, np.cumsum(sizes)[:-1]))):
        own = sides[g == k, 1:]
        ring = max(vector.chain_rings(list(own.reshape(-1, 2, 2)), rightmost=True), key=vector.ring_area)
        dx, dy = np.diff(ring, axis=0).T
        assert got.tolist() == np.select([dy < 0, dx > 0, dy > 0], [0, 1, 2], 3).tolist() and tuple(ring[0]) == (node % width, node // width)
    found = {}
    for most in (50, 1 << 20):
        monkeypatch.setattr(dat, "PIXELS", most)
        for pix, node in dat.pixels_within(nodes, sizes, moves, width):
            for p, n in zip(pix.tolist(), node.tolist()):
                found.setdefault((most, p), []).append(n)
    assert all(max(found[most, p]) == label[p // width, p % width] for most in (50, 1 << 20) for p in range(height * width))
    assert [(s.start, s.stop) for s in vector.portions(pa.array([[1] * 3, [1], [1] * 9, [], [1]]), 4)] == [(0, 2), (2, 3), (3, 5)]
