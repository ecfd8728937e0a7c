"""A corpus pipeline in five stages over ``documents``; each stage's rows are written as Parquet and reread.

quality classifier -> SimHash near-dedup -> secret scans -> mixing sources -> byte-level BPE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import mixing, near_texts, quality_classifier, secrets, simhash
from mosaiq.llm.queries import PREDICTED, byte_tokenizer
from mosaiq.plans.lineage import materialize, scratch, settled, shared_dir, sized

#: SQL can express neither the trained score nor the tokenizer, so tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1.

    Null text counts as empty and is scored like any other, so ties and repeated rows share one verdict; an
    empty table stays empty. The model learns from at most 20,000 labelled rows outside the held-out fold.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.scored(docs, model, "__score").where(F.col("__score") >= PREDICTED).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: op10's components, joined where texts of two are similar.

    Fingerprints of 3-word shingles link at 3 or fewer bits; sets of 5-word shingles at a similarity of 0.8 or more.
    The smallest id stays, rows without an id last; of several rows with that id it is settled by fingerprint,
    text and row. Null, empty and blank texts are one group; an empty table stays empty. Very long texts are
    compared whole; columns beside ``doc_id`` and ``text`` are not read.
    """

    def classes() -> DataFrame:
        found = materialize(simhash.classed(docs, tid=near_texts.text_id(F.col("text"))))
        groups = materialize(found.where("tid is not null").groupBy("tid").agg(F.min("component").alias("group")))
        return near_texts.joined(found, near_texts.links(docs, groups))

    return simhash.keep_one(docs, settled(spark, classes))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask and ``n_chars`` counted anew where that changed the text.

    Null text stays null; repeated rows are masked alike; an empty table stays empty. Each text is scanned once.
    """
    scanned = materialize(secrets.scan(docs, F.col("text"), "__scan"))
    found = scanned.withColumn("__spans", secrets.spans(F.col("__scan"), secrets.thresholds(scanned, "__scan")))
    masked = found.withColumn("text", F.when(F.size("__spans") > 0, secrets.masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    counted = masked.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return counted.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents (0 to 3 times); texts without words (null too) stay once.

    A null source is a source of its own, last in order; repeated rows are documents of their own; an empty table stays empty.
    """
    return mixing.repeated_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``n_tokens`` and ``token_ids``, unsigned 32-bit little-endian.

    Null text counts as empty and has no tokens; repeated rows are coded alike; an empty table stays empty.
    """
    coded = byte_tokenizer(spark).encode(docs)
    return coded.withColumn("n_tokens", F.floor(F.octet_length("token_ids") / 4).cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_masks),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; all stages' tables are in the shared folder, what they wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark), sized(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
