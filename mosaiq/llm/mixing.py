"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sizes: words of each text, summed by source. Sources in code-point order (null
   last) weigh 5, 2, 1, repeating; targets share all words by weight and stop at
   ``MOST_PASSES`` times the source, the excess going to the others by weight.
2. Blocks: each source's documents are laid end to end in the order of a hash and
   cut into blocks of equal tokens (the last one may be shorter).
3. Schedule: slot k takes the golden-ratio point frac(k * phi); the point's place
   among the cumulative weights names the source. Any stretch of slots holds every
   source close to its weight.
4. A source's slots are ranked; rank r takes the source's block r, starting over
   after the last one, at most ``MOST_PASSES`` times. Slots and blocks are joined.

Block size goes by source (``block_words``), so a small source still has many
blocks. Nothing is sorted in one task: ranks and running sums go by ranges.

Null text has size 0; documents of size 0 take nothing and are kept in results;
repeated rows are documents of their own; an empty table gives an empty result.
Reruns agree, since the order comes from hashes of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.text import SPACE
from mosaiq.plans.lineage import materialize
from mosaiq.plans.ranking import exclusive_prefix, unit

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Blocks of a source, unless they would have more words than the most below.
BLOCKS, MOST_BLOCK_WORDS = 1024, 4096
GOLDEN = (5**0.5 - 1) / 2
#: Cells of [0, 1) that slots and cumulative weights are joined by.
CELLS = 1024


def n_words(text: Column) -> Column:
    """Words of a text: pieces between white space, less the empty ones at its ends."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, f"{SPACE}+"))
    empty = F.when(text == "", 1).otherwise(text.rlike(f"^{SPACE}").cast("int") + text.rlike(rf"{SPACE}\z").cast("int"))
    return F.greatest(pieces - empty, F.lit(0)).cast("long")


def _place() -> Column:
    """A row's place in the shuffle of its source."""
    return unit(F.xxhash64("doc_id", "text", "source"))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, src, u)``: word counts, a source key that isn't null, a place in the shuffle."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("src"), _place().alias("u"))


def targets(sizes: DataFrame) -> DataFrame:
    """``(src, source_size, target, block_words, n_blocks, lo, hi)`` by source; ``[lo, hi)`` is its part of the slots.

    The level below solves the resharing in one pass: with sources by cap / weight,
    the level that the sources from k on would share is greatest where resharing ends.
    The windows here span one row a source.
    """
    by_source = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ordered = by_source.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("pos") - 1) % len(WEIGHTS) + 1).cast("double")
    everything, by_cap = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", "pos")
    capped = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_PASSES)).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    shared = capped.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    out = shared.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap")))
    words_of_block = F.least(F.greatest(F.ceil(F.col("source_size") / BLOCKS), F.lit(1)), F.lit(MOST_BLOCK_WORDS))
    out = out.withColumn("block_words", words_of_block.cast("long")).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    # A pass over n blocks holds source_size words, so slots go by target / source_size passes.
    out = out.withColumn("slots", F.coalesce(F.col("target") * F.col("n_blocks") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    upto = F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("upto", upto)
    total = F.nullif(F.max("upto").over(everything), F.lit(0.0))
    return out.withColumn("hi", F.col("upto") / total).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("pos")), F.lit(0.0))).select("src", "source_size", "target", "block_words", "n_blocks", "slots", "lo", "hi")


def schedule(sources: DataFrame) -> DataFrame:
    """``(slot, src, rank, epoch, block)``: which source's block fills each slot."""
    n = round(sources.agg(F.sum("slots")).first()[0] or 0)
    point = F.col("id") * F.lit(GOLDEN)
    slots = sources.sparkSession.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("at"))
    slots = slots.withColumn("cell", F.floor(F.col("at") * CELLS))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = sources.where("hi > lo").select("src", "n_blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last)).alias("c"))
    placed = slots.join(cells, (F.col("cell") == F.col("c")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    placed = placed.select("slot", "src", "n_blocks", (F.col("slot") / F.lit(float(max(n, 1)))).alias("u"))
    ranked = exclusive_prefix(placed, "src", "u", ["slot"], F.lit(1), "rank")
    epoch = F.floor(F.col("rank") / F.col("n_blocks"))
    return ranked.withColumn("epoch", epoch).where(epoch < MOST_PASSES).select("slot", "src", "rank", "epoch", (F.col("rank") % F.col("n_blocks")).alias("block"))


def blocks(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(src, block, u, doc_id, source, size, start, from_word, n)``: the pieces of documents that fill each block."""
    laid = exclusive_prefix(sizes.where("size > 0"), "src", "u", ["doc_id", "size"], F.col("size"), "start")
    cut = laid.join(sources.select("src", "block_words"), "src")
    each = F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")))
    cut = cut.withColumn("block", F.explode(each))
    first = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    after = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    return cut.select("src", "block", "u", "doc_id", "source", "size", "start", (first - F.col("start")).alias("from_word"), (after - first).alias("n"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: ``(slot, epoch, source, doc_id, from_word, n)``, by slot; slots of a source come in its own order."""
    sizes = materialize(sized(docs))
    sources = materialize(targets(sizes))
    return schedule(sources).join(blocks(sizes, sources), ["src", "block"]).select("slot", "epoch", "source", "doc_id", "from_word", "n")


def _taken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, u, doc_id, source, size, taken)`` for every row, and the sources."""
    sizes = materialize(sized(docs))
    sources = materialize(targets(sizes))
    times = schedule(sources).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = blocks(sizes, sources).join(times, ["src", "block"], "left")
    taken = pieces.groupBy("src", "start", "u", "doc_id", "source", "size").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = sizes.where("size = 0").select("src", "u", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    return taken.drop("start").unionByName(none), sources


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row: the words that the mix takes, repeats counted."""
    taken, sources = _taken(docs)
    return taken.join(sources.select("src", "source_size", "target"), "src").select("doc_id", "source", "size", "source_size", "target", "taken")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, to the nearest whole number.

    Rows without words stay once. Rows that are alike throughout are taken alike.
    """
    taken, _ = _taken(docs)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)))).cast("int")
    alike = taken.groupBy("src", "u", "doc_id", "size").agg(times.alias("__times")).where("__times > 0")
    alike = alike.select(F.col("u").alias("__u2"), F.col("doc_id").alias("__id"), F.col("size").alias("__size2"), "__times")
    placed = docs.withColumn("__u", _place()).withColumn("__size", n_words(F.col("text")))
    same = (F.col("__u") == F.col("__u2")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__size2"))
    return placed.join(alike, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)
