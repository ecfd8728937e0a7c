import re
from collections import defaultdict

from pyspark.sql import functions as F

from mosaiq.llm import mixing
from mosaiq.llm.queries import op3_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes):
    """Targets by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if target[s] > 3 * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, source_of, size_of):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size_of(r) and 0 <= r.taken <= 3 * r["size"]
        sizes[source_of(r)] += r["size"]
        taken[source_of(r)] += r.taken
    target = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[source_of(r)] and abs(r.target - target[source_of(r)]) <= 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 5), s


def test_query(spark, sf_dir, documents):
    source = {r.doc_id: r.source for r in documents.collect()}
    text = {r.doc_id: r.text for r in documents.collect()}
    rows = op3_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    check(rows, lambda r: source[r.doc_id], lambda r: len(WORD.findall(text[r.doc_id] or "")))
    assert sorted(rows) == sorted(op3_mixing(spark, sf_dir.rstrip("/")).collect())


def test_caps_are_reshared(spark):
    docs = spark.createDataFrame([(k, "w " * 10, None, s, 0) for k, s in enumerate(["a"] * 2 + ["b"] * 90 + ["c"] * 300)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.mixed_documents(docs).collect()
    check(rows, lambda r: r.source, lambda r: 10)
    assert {r.target for r in rows if r.source == "a"} == {60.0}


def test_schedule_is_the_mix(documents):
    docs = documents.limit(60).cache()
    mixed = {(r.doc_id): r.taken for r in mixing.mixed_documents(docs).collect()}
    total = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert total == {k: v for k, v in mixed.items() if v}


def test_words(spark):
    texts = ["", None, "a", " a", "a ", "\t a\x0b\x0cb \n", "\x85a b c", " \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(WORD.findall(r.t or "")) for r in rows]


def test_whole_documents(odd, empty):
    rows = mixing.mixed_documents(odd).collect()
    assert len(rows) == odd.count()
    check(rows, lambda r: r.source, lambda r: r["size"])
    repeated = mixing.repeated_documents(odd)
    assert repeated.columns == odd.columns and repeated.where("trim(coalesce(text, '')) = ''").count() == 3
    assert mixing.mixed_documents(empty).count() == 0 and mixing.repeated_documents(empty).count() == 0
