import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from mosaiq.llm import near_texts as n
from mosaiq.llm import simhash


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[k] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            del out[k]
        else:
            out.insert(k, f"more{rng.randrange(10**6)}")
    return out


def corpus(rng):
    """Texts with near copies at many similarities, a family of hundreds, and a passage that many share."""
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=120)
    texts = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice((40, 90, 200, 600)))
        texts.append(" ".join(words))
        for _ in range(rng.choice((0, 1, 3))):
            texts.append(" ".join(edited(rng, words, rng.randint(1, max(1, len(words) // 25)))))
    family = rng.choices(vocabulary, k=150)
    texts += [" ".join(edited(rng, family, rng.randint(1, 3))) for _ in range(150)]
    texts += [" ".join(rng.choices(vocabulary, k=60) + passage + rng.choices(vocabulary, k=60)) for _ in range(100)]
    return texts + ["", None, "one two", "one two", "One Two", "one two three"]


def brute(texts, groups):
    sets, at = [sets_of(t) for t in texts], list(groups)
    pairs = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 10 * both >= 8 * (len(x) + len(sets[j]) - both):
                pairs.append((i, j))
    while True:
        before = list(at)
        for i, j in pairs:
            at[i] = at[j] = min(at[i], at[j])
        least = {}
        for g, a in zip(groups, at):
            least[g] = min(least.get(g, a), a)
        at = [min(a, least[g]) for g, a in zip(groups, at)]
        if at == before:
            return at, pairs


def test_groups_against_all_pairs(spark):
    rng = random.Random(4)
    texts = corpus(rng)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = simhash.classed(docs, tid=n.text_id(F.col("text"))).cache()
    groups = {r.doc_id: r.component for r in found.collect()}
    of = found.where("tid is not null").groupBy("tid").agg(F.min("component").alias("group"))
    told = {r.doc_id: r.component for r in n.joined(found, n.links(docs, of)).collect()}
    ids = range(len(texts))
    whole, pairs = brute(texts, [groups[i] for i in ids])
    assert len(pairs) > 1000 and len(set(whole)) < len(set(groups.values()))
    # Never a link too many; of what all pairs join, at most a hundredth stays apart.
    assert all(whole[i] == whole[j] for i in ids for j in ids if told[i] == told[j])
    apart = sum(told[i] != told[j] for i, j in pairs)
    assert apart <= 0.01 * len(pairs)
    kept = p.near_dedup(spark, docs, "").collect()
    assert len(kept) == len(set(told.values())) and {r.doc_id for r in kept} == {min(i for i in ids if told[i] == c) for c in set(told.values())}


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_texts_of_a_similarity_share_a_key(share):
    rng, how, met = np.random.default_rng(1), n.multipliers(), 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
        both = round(200 * 2 * share / (1 + share))
        y = np.r_[x[:both], rng.integers(0, 1 << 63, 200 - both).astype(np.uint64)]
        met += bool(set(n.bands(x, *how)) & set(n.bands(y, *how)))
    assert met >= 0.99 * 400


def test_similarity_is_exact_at_the_limit(spark):
    make = lambda a, b: np.arange(a, b, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(0, make(0, 80)), (1, make(0, 100)), (2, make(1, 81)), (3, make(0, 79)), (4, make(500, 600))], "tid long, s binary")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (1, 4), (0, 3)], "a long, b long")
    assert sorted(map(tuple, n.similar(pairs, sets).collect())) == [(0, 1), (0, 3), (1, 2)]


def test_links_of_a_cell_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.choice(10**6, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(200, 300)], rng.integers(10**6, 10**7, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(60)]
    sets += [np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64), np.arange(1, 81, dtype=np.uint64), np.array([5], np.uint64)]
    groups = rng.integers(-20, 20, len(sets))
    for width in (n.WIDTH, 7):
        monkeypatch.setattr(n, "WIDTH", width)
        at = {int(g): int(g) for g in groups}
        for src, dst in zip(*n.reached(sets, groups)):
            at = {g: min(at[int(src)], at[int(dst)]) if c in (at[int(src)], at[int(dst)]) else c for g, c in at.items()}
        told = {int(g): int(g) for g in groups}
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if both and 10 * both >= 8 * (len(x) + len(sets[j]) - both):
                    a, b = told[int(groups[i])], told[int(groups[j])]
                    told = {g: min(a, b) if c in (a, b) else c for g, c in told.items()}
        assert at == told and len(set(at.values())) < len(at)


def test_crowded_keys_lose_nothing(spark, monkeypatch):
    """Small cells: keys are dealt, told again, made longer and compared in blocks; groups are those of all pairs."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    family, passage = rng.choices(vocabulary, k=150), rng.choices(vocabulary, k=150)
    texts = [" ".join(edited(rng, family, rng.randint(1, 4))) for _ in range(120)]
    texts += [" ".join(rng.choices(vocabulary, k=10) + passage + rng.choices(vocabulary, k=40)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = simhash.classed(docs, tid=n.text_id(F.col("text"))).cache()
    groups = {r.doc_id: r.component for r in found.collect()}
    of = found.groupBy("tid").agg(F.min("component").alias("group"))
    levels = []
    monkeypatch.setattr(n, "BLOCK", 8)
    monkeypatch.setattr(n, "_longer", lambda left, sets, level, f=n._longer: levels.append(level) or f(left, sets, level))
    told = {r.doc_id: r.component for r in n.joined(found, n.links(docs, of)).collect()}
    ids = range(len(texts))
    whole, pairs = brute(texts, [groups[i] for i in ids])
    assert levels and len(pairs) > 1000
    assert all(whole[i] == whole[j] for i in ids for j in ids if told[i] == told[j])
    assert sum(told[i] != told[j] for i, j in pairs) <= 0.002 * len(pairs)


def test_rows_of_a_family_grow_with_its_texts(spark, monkeypatch):
    """Four times the near copies in the same keys: what joins and deals make grows in proportion, not with the square."""
    rng = random.Random(6)
    family = [f"w{rng.randrange(3000)}" for _ in range(150)]
    monkeypatch.setattr(n, "BLOCK", 16)
    made = []
    monkeypatch.setattr(n, "compared", lambda cells, sets, f=n.compared: made.append(cells.count()) or f(cells, sets))
    rows = []
    for copies in (60, 240):
        texts = [" ".join(edited(rng, family, 1 + k % 2)) for k in range(copies)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        of = docs.select(n.text_id(F.col("text")).alias("tid"), F.col("doc_id").alias("group")).groupBy("tid").agg(F.min("group").alias("group"))
        made.clear()
        assert n.joined(of.withColumnRenamed("group", "component"), n.links(docs, of)).select("component").distinct().count() == 1
        rows.append(sum(made))
    assert rows[1] <= 6 * rows[0]


def test_long_texts_in_runs(monkeypatch):
    text, how = " ".join(f"w{k * k % 313}x{k % 97}" for k in range(5000)), n.multipliers()
    whole = n.bands(n.shingles(text), *how)
    monkeypatch.setattr(n, "RUN", 64)
    assert n.bands(n.shingles(text), *how) == whole and len(whole) == n.BANDS and n.bands(n.shingles(""), *how) == []


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        found = simhash.classed(docs, tid=n.text_id(F.col("text"))).cache()
        of = found.where("tid is not null").groupBy("tid").agg(F.min("component").alias("group"))
        assert n.links(docs, of).count() == 0 and n.joined(found, n.links(docs, of)).count() == docs.count()
