import zlib

import numpy as np
from pyspark.sql import functions as F

from mosaiq.llm import quality_classifier as q
from mosaiq.llm.queries import op4_quality_classifier


def test_query_on_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rows = op4_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.train(documents, labels) == q.train(documents, flipped)


def test_columns_score_like_the_rules(spark, documents):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = q.fit_rules(x, y, ["p", "r"])
    assert model.rules and len(model.rules) < 60
    z = model.bias + sum(rule.weight * rule.holds(x) for rule in model.rules)
    got = [r[0] for r in spark.createDataFrame(x.tolist(), "p double, r double").coalesce(1).select(model.score()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and np.mean((np.array(got) > 0.5) == y) > 0.97


def test_odd_rows(spark, odd, empty, sf_dir):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (99, None, 0), (-9, 0, 1)], "doc_id long, quality int, toxic int")
    model = q.train(odd, labels)
    rows = q.scored(odd, model, "made").collect()
    assert len(rows) == odd.count() and all(0 < r.made < 1 for r in rows) and all(r.score == "score" for r in rows)
    assert q.scored(empty, q.train(empty, labels)).count() == 0
    trained = q.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert all(0 < r.made < 1 for r in q.scored(odd, trained, "made").collect())
