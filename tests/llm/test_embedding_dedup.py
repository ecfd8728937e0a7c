import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import embedding_dedup as e
from mosaiq.llm.queries import op7_embedding_dedup


def brute(vectors, labels, ids, threshold=0.93):
    v = np.array(vectors, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, True)
    component = np.array(ids)
    while True:
        new = np.array([component[n].min() for n in near])
        if (new == component).all():
            return {i: (n.sum() - 1, c) for i, n, c in zip(ids, near, component)}
        component = new


def check(rows, expected):
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == expected and all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(op7_embedding_dedup(spark, sf_dir).collect(), brute([r.embedding for r in table], [r.label for r in table], [r.vec_id for r in table]))


@pytest.mark.parametrize("leaf", [8, 40])
def test_clusters_copies_and_chains_over_many_leaves(spark, monkeypatch, leaf):
    monkeypatch.setattr(e, "LEAF", leaf)
    monkeypatch.setattr(e, "SAMPLE", 24)
    rng = np.random.default_rng(4)
    tight = rng.normal(0, 1, 6) + rng.normal(0, 0.03, (60, 6))
    loose = rng.normal(0, 1, (5, 1, 6)) + rng.normal(0, 0.25, (5, 20, 6))
    angle = np.linspace(0, 2, 40)
    chain = np.c_[np.cos(angle), np.sin(angle), np.zeros((40, 4))]
    v = np.concatenate([tight, loose.reshape(-1, 6), chain, np.repeat(rng.normal(0, 1, (1, 6)), 30, 0), rng.normal(0, 1, (40, 6))]).astype(np.float32)
    label = [1] * 150 + [k % 2 for k in range(len(v) - 150)]
    ids = rng.permutation(10_000)[: len(v)].tolist()
    df = spark.createDataFrame([(i, x.tolist(), c) for i, x, c in zip(ids, v, label)], "vec_id long, embedding array<float>, label int")
    check(e.near_vectors(df).collect(), brute(v, label, ids))


@pytest.mark.parametrize(("spread", "dims"), [(0.2, 4), (0.02, 6), (1.0, 16)])
def test_trees_agree_with_all_pairs(spread, dims):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, (140, dims)), rng.normal(0, 1, dims) + rng.normal(0, spread, (140, dims)), np.repeat(rng.normal(0, 1, (1, dims)), 20, 0)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    order, tree = e.cover_tree(v)
    v, tree = v[order], e.Tree.unpacked(tree.packed())
    assert sorted(order) == list(range(len(v))) and len(tree.radii) <= len(v)
    for k in range(len(tree.radii)):
        assert (np.linalg.norm(v[tree.starts[k] : tree.stops[k]] - v[tree.centres[k]], axis=1) <= tree.radii[k] + 1e-7).all()
        if tree.children[k]:
            below = np.arange(tree.first[k], tree.first[k] + tree.children[k])
            assert tree.centres[below[0]] == tree.centres[k] and (tree.radii[below] <= tree.radii[k] / 1.0).all()
            assert tree.starts[below[0]] == tree.starts[k] and tree.stops[below[-1]] == tree.stops[k] and (tree.stops[below[:-1]] == tree.starts[below[1:]]).all()
    near = v @ v.T >= 0.93
    for other in (np.arange(len(v)), np.arange(0, len(v), 3)):
        order, second = e.cover_tree(v[other])
        assert (e.traverse(tree, second, v, v[other][order], 0.93) == near[:, other[order]]).all()
    np.fill_diagonal(near, False)
    assert (e.traverse(tree, tree, v, v, 0.93, True) == near).all()


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Near copies over many leaves, linked throughout or just so: rows of a few times the members, not of their pairs."""
    monkeypatch.setattr(e, "LEAF", 16)
    monkeypatch.setattr(e, "PORTION", 64)
    rng = np.random.default_rng(2)
    for spread, n, times in ((0.05, 600, 1), (0.28, 600, 20)):
        v = rng.normal(0, 1, 8) + rng.normal(0, spread, (n, 8))
        df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
        points = df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("m"), F.lit("r").alias("node"), e.scaled(F.col("embedding")).alias("v"))
        leaves = e.materialize(e.pack(e.split_nodes(points), 0.93))
        pairs, above = e.upper_pairs(leaves, 0.14**0.5)
        assert above.count() + e.compare_leaves(pairs, leaves, 0.93).count() < times * n
    check(e.near_vectors(df).collect(), brute(v, [0] * n, list(range(n))))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (None, [1.0, 0.0], 0), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1e200, 1e199], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, kept string, node string")
    got = e.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert by[1] == (2, 1) and by[2] == (2, 1) and by[12] == (2, 1) and by[11] == (1, 11) and by[None] == (0, None)
    assert all(by[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert e.near_vectors(df.where("false")).count() == 0


def test_labels_of_similar_names_stay_apart(spark):
    rows = [(1, [1.0, 0.0], "a.b"), (2, [1.0, 0.01], "a_b"), (3, [1.0, 0.02], "a.b"), (4, [1.0, 0.0], "a/b"), (5, [1.0, 0.0], "")]
    got = e.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    check(got, {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5)})


def test_vectors_are_sent_out_within_their_label_and_nothing_stays(spark, monkeypatch):
    """A leaf goes to the pairs of its own label's tiles, floats stay floats, and only the result's table is left."""
    import os

    from mosaiq.plans.lineage import shared_dir

    monkeypatch.setattr(e, "LEAF", 8)
    monkeypatch.setattr(e, "TILE", 2)
    rng = np.random.default_rng(3)
    v, label = rng.normal(0, 1, (240, 6)).astype(np.float32), [k % 6 for k in range(240)]
    df = spark.createDataFrame([(k, x.tolist(), c) for k, (x, c) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int")
    shipped, sent = [], e.shipped_leaves

    def watched(tiled, leaves):
        rows = sent(tiled, leaves)
        shipped.append((rows.collect(), leaves.count()))
        return rows

    monkeypatch.setattr(e, "shipped_leaves", watched)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    check(e.near_vectors(df).collect(), brute(v, label, range(240)))
    rows, n = [r for wave, _ in shipped for r in wave], shipped[0][1]
    assert len(shipped) > 1 and n > 40 and all(len(r.vs) == 4 * 6 * len(r.reps) for r in rows)
    assert len(rows) <= n * (e.SIDE + 2) and all(len(wave) <= 3 * e.WAVE * n for wave, _ in shipped)
    assert len(set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before) == 1
