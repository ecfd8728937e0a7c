import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import fill_in_middle as fim
from mosaiq.llm import queries

ODD = [
    (1, "plain words, and more of them. A second line?\nYes! 12 of 3.5\t ok", "a"), (2, None, "b"), (3, "", "c"), (None, "no id here", "d"), (4, "x", "e"), (5, "has <S> inside", "f"), (5, "has <S> inside", "f"),
    (6, "a<P", "g"), (7, "<M<S<P S>M>", "h"), (8, "\U0001f600\U0001f601é́  \n\r\n\n", "i"), (9, "\n\n\n", "j"), (10, "  leading and trailing  ", "k"), (11, "long " * 30000, "l"), (12, "plain words", "m"), (12, "plain words", "m"),
]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, form string")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows_against_brute_force(spark):
    made = fim.transformed(docs_of(spark), fim.CHARACTERS)
    assert made.columns == ["doc_id", "text", "n_units", "form", "prefix", "middle", "suffix", "output"]
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, r.text)
        assert (r.n_units, r.form, r.output, r.back) == (n, form, out, r.text or "")
        assert (None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle)) == (p, m)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op12_fill_in_middle(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, digest(out), digest(texts[r.doc_id] or ""))


@pytest.mark.parametrize(
    "grammar, pattern",
    [(fim.CHARACTERS, r"(?s)."), (fim.WORDS, r"\s+(?=\S|$)|\S+\s*"), (fim.LINES, r"[^\n]*\n|[^\n]+$"), (fim.SENTENCES, r"(?s).+?(?<=[.!?])(?=[ \t\n\r\x0b\f])|(?s:.)+")],
)
def test_units_lose_nothing(spark, grammar, pattern):
    texts = [t for _, t, _ in ODD if t and len(t) < 1000 and " " not in t]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    for r in rows:
        assert "".join(r.u) == r.text and all(r.u)
        assert r.u == [m.group() for m in re.finditer(pattern.replace("(?s)", ""), r.text, re.S)]


def test_runs_end_where_the_class_changes(spark):
    row = spark.createDataFrame([("né12 +-x\n\n3",)], "t string").select(fim.units(F.col("t"), fim.RUNS).alias("u")).first()
    assert row.u == ["né", "12", " ", "+-", "x", "\n\n", "3"]


def test_empty_table_and_seed(spark):
    assert fim.transformed(docs_of(spark, []), fim.WORDS).count() == 0
    one = lambda seed: [r.output for r in fim.transformed(docs_of(spark), fim.CHARACTERS, seed=seed).collect()]
    assert one(2) == one(2) != one(1)
