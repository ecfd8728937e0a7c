import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from mosaiq.llm import sharding
from mosaiq.llm.queries import op6_sharding


def jump(key, shards):
    """The published loop, a key at a time."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@given(st.integers(-(2**63), 2**63 - 1), st.integers(1, 50))
def test_jump_hash(key, shards):
    here, more = (int(sharding.jump_hash(np.array([key]), n)[0]) for n in (shards, shards + 1))
    assert here == jump(key, shards) and more in (here, shards)


def check(rows, n):
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark, sf_dir, texts):
    rows = op6_sharding(spark, sf_dir).collect()
    check(rows, len(texts))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.shard) == (len(raw) + 1, zlib.crc32(raw), "key", jump(r.doc_id, 16))


def test_odd_rows(odd, empty, tmp_path, spark):
    rows = sharding.assign_shards(odd, 16).collect()
    check(rows, odd.count())
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 4} == {(1, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.assign_shards(empty, 16).count() == 0
    sharding.write_shards(odd.drop("Shard"), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()
