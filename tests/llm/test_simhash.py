import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaiq.llm import simhash as s
from mosaiq.llm.queries import op10_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    f = np.array(prints, np.uint64)
    near, c = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, np.array(ids)
    while True:
        new = np.array([c[n].min() for n in near])
        if (new == c).all():
            return c
        c = new


def test_query(spark, sf_dir, texts):
    rows = sorted(op10_simhash(spark, sf_dir).collect())
    prints = [plain(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == components(prints, [r.doc_id for r in rows]).tolist()


def test_golay_words_meet():
    code, rng = s.Golay(), np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 3000)
    near = code.codewords(words)
    assert (near[:, 0] >= 0).all() and set((near >= 0).sum(1)) == {1, 6}
    for bit in range(-1, 23):
        other = code.codewords(words ^ (1 << bit if bit >= 0 else 0))
        assert (near[:, :1] == other).any(1).all()


@pytest.mark.parametrize(("block", "crowded"), [(2048, 8192), (7, 8192), (7, 20)])
def test_links_of_random_and_crowded_fingerprints(spark, monkeypatch, block, crowded):
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s, "CROWDED", crowded)
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    middle = rng.getrandbits(64)
    prints |= {middle ^ sum(1 << b for b in c) for c in rng.sample(list(combinations(range(64), 2)), 120)}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = s.connected_components(s.links(df)).collect()
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    got = {r.node: r.component for r in found}
    assert [got.get(p, p) for p in signed] == components(prints, signed).tolist()
    assert s.links(df).count() < 30 * len(prints)


def test_keys_meet_wherever_the_errors_are(spark):
    """Every pair within 3 bits shares a key, for all ways that three errors fall on segments, pieces and ends."""
    rng, pairs = random.Random(7), []
    for e in [*combinations(range(0, 64, 3), 3), *combinations((0, 1, 10, 11, 21, 22, 42, 43, 63), 3), *combinations(range(64), 1)]:
        x = rng.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in e)))
    signed = [tuple(int(np.uint64(p).view(np.int64)) for p in pair) for pair in pairs]
    df = spark.createDataFrame([(p,) for pair in signed for p in pair], "fp long")
    keys = [{}, {}]
    for looks_up in (False, True):
        for r in s.postings(df, looks_up).collect():
            keys[looks_up].setdefault(r.fp, set()).add(r.key)
    assert all(keys[0][a] & keys[1][b] and keys[0][b] & keys[1][a] for a, b in signed)
    assert max(map(len, keys[0].values())) <= 18 and max(map(len, keys[1].values())) <= 48


def test_many_crowded_fingerprints(spark):
    """20,000 fingerprints within few bits of one another, against brute force; rows in hand grow with their number, not its square."""
    rng, middle = np.random.default_rng(3), np.uint64(0x9E3779B97F4A7C15)
    flips = rng.integers(0, 64, (20_000, 9)).astype(np.uint64)
    used = rng.integers(2, 10, 20_000)
    prints = np.unique(middle ^ np.bitwise_xor.reduce(np.where(np.arange(9) < used[:, None], np.uint64(1) << flips, np.uint64(0)), axis=1))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").repartition(4)
    got = {r.node: r.component for r in s.connected_components(s.links(df)).collect()}
    todo, whole = np.ones(len(prints), bool), {}
    for root in range(len(prints)):
        if todo[root]:
            todo[root], group, at = False, [root], 0
            while at < len(group):
                near = np.nonzero(todo & (np.bitwise_count(prints ^ prints[group[at]]) <= 3))[0]
                todo[near], at = False, at + 1
                group += near.tolist()
            signed = prints[group].view(np.int64).tolist()
            whole |= dict.fromkeys(signed, min(signed))
    assert {p: got.get(p, p) for p in whole} == whole


def test_odd_rows(spark, odd, empty):
    rows = s.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[3] == by[4] == by[6] == {(0, 3)} and by[1] == {(next(iter(by[1]))[0], 1)} and next(iter(by[2]))[1] == 1
    assert s.near_duplicates(empty).count() == 0
    kept = s.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for v in by.values() for _, c in v})
    twice = spark.createDataFrame([(1, "a b c d", "p"), (1, "a b c d", "p"), (1, "q r s t u v", "p"), (2, "q r s t u v", None), (3, None, "z"), (4, "", "z")], "doc_id long, text string, fp string")
    for n in (1, 5):
        assert sorted((r.doc_id, r.text) for r in s.keep_one(twice.repartition(n)).collect()) == [(1, "a b c d"), (1, "q r s t u v"), (3, None)]
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "z y x w v u")], "doc_id long, text string")
    assert s.keep_one(nameless).count() == 2 and s.keep_one(empty).count() == 0


def test_long_texts_in_runs(monkeypatch):
    text = " ".join(f"w{k * k % 313}" for k in range(5000))
    whole = s.fingerprint(text.encode())
    monkeypatch.setattr(s, "RUN", 64)
    assert s.fingerprint(text.encode()) == whole == int(np.uint64(plain(text)).view(np.int64))


def test_keys_are_not_broadcast(spark, monkeypatch):
    """A fingerprint has some sixty keys, but Spark plans with one; sides of such rows must not be sent to the driver."""
    plans, write = [], s.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(s, "materialize", watched)
    df = spark.range(500).select((F.col("id") * 7).alias("fp"))
    assert s.shared_keys(df) and sum("Join" in p for p in plans) > 1
    assert not any("Broadcast" in p for p in plans)
