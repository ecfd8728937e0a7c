"""Quality rules whose cutoffs come from the corpus: one quantile sketch per language, source and measure.

Every document gets base measures from its whole text. Each measure, as a count in
parts per million (mean word length: thousandths of a character), goes into a
log-linear sketch: values below 32 have a bucket each, larger ones keep their five
leading bits, so a bucket is at most 1/16 of its values wide. A sketch is a table of
bucket counts, so sketches merge by adding counts: Spark sums them before the
shuffle, a group of any size ends as a few hundred rows, and the same rows always
give the same cutoffs.

The cutoffs of a group are tail quantiles (the last hundredth of either end) of its
core, in two rounds of sketches:

1. Quartiles of all documents that pass the base rules. A document is of the core if each
   measure lies within REACH * max(q3 - q1, noise) of them. Quartiles bear up to a quarter
   of junk in a group, which a tail quantile of everything would take for the norm.
2. Tail quantiles of the core's sketches. A document goes if a measure lies beyond its
   group's cutoff by more than REACH times its noise.

Sketches of small groups lean on larger ones: what a group lacks of ``PRIOR`` documents is
filled up with its language's sketch, and what a language lacks with the whole corpus's.

Noise is the standard error of the document's own measure, from its number of lines,
words or characters: one repeated line in a text of three is no outlier, half of 200
lines is. No measure has a fixed cutoff or a least spread.

Language and source may be null: null is a group of its own. Null text counts as
empty and fails the base rules; repeated rows are judged alike; an empty table gives
an empty result. Columns besides the four that are named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.text import SPACE, bind, words
from mosaiq.plans.lineage import materialize

#: Base rules: fewest words; most words of repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
REACH = 3
#: A tail is one part in so many of the core; documents that a sketch is filled up to; parts that a document's weight has.
TAIL, PRIOR, PARTS = 100, 100, 1000
#: Measure: (count, of what, scale, whether low values are fenced too).
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, False),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, False),
    "word_length": ("word_chars", "n_words", 1_000, True),
}
#: Counts that one event adds: symbols come in runs, and a window that occurs twice covers two windows' words.
EVENT = {"symbols": 3, "dup_lines": 1, "repeats": 2 * WINDOW}
#: Copies of a cutoff row that documents of a hot group are dealt over.
SALTS = 16


def repeated_words(ws: Column) -> Column:
    """Words inside windows that occur twice or more in the array, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        # Sorted (hash, start): a window is repeated if its neighbour has the same hash.
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, k: F.coalesce(F.try_element_at(s, k)["h"] == a["h"], F.lit(False))
            repeated = F.filter(s, lambda a, k: same(a, k + 2) | ((k > 0) & same(a, F.greatest(k, F.lit(1)))))
            return F.sort_array(F.transform(repeated, lambda a: a["i"]))

        # Consecutive starts less than a window apart share words.
        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(at, k + 2) - a, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

        return bind(placed, lambda s: bind(starts(s), total))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(WINDOW)]))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return bind(ws, lambda w: F.when(F.size(w) < WINDOW + 1, 0).otherwise(of(w))).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = words(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, f"{SPACE}+", "")) > 0)
    made = docs.select("doc_id", "lang", "source", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), ws.alias("__w"), lines.alias("__l"))
    made = made.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
    )
    return made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def bucket(value: Column) -> Column:
    """The sketch bucket of a count from 0: exact below 32, then five leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return bind(drop, lambda e: e * 32 + F.call_function("shiftright", value, e).cast("int"))


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    return F.call_function("shiftleft", (b % 32 + 1).cast("long"), F.floor(b / 32).cast("int")) - 1


def bucket_bottom(b: Column) -> Column:
    """The smallest value of a bucket."""
    return F.call_function("shiftleft", (b % 32).cast("long"), F.floor(b / 32).cast("int"))


def scaled(name: str) -> Column:
    top, bottom, scale, _ = MEASURES[name]
    return F.coalesce(F.floor(F.col(top) * scale / F.nullif(F.col(bottom), F.lit(0))), F.lit(0)).cast("long")


def noise(name: str, typical: Column) -> Column:
    """The standard error of a document's measure, in the measure's scale.

    Shares: that of the posterior of a binomial share, which isn't 0 at a share of 0.
    Mean word length: words' lengths spread by no more than their mean.
    """
    top, bottom, scale, _ = MEASURES[name]
    if name == "word_length":
        return typical / F.sqrt(F.greatest(F.col(bottom), F.lit(1)))
    n = F.col(bottom) / EVENT[name]
    share = (F.col(top) / EVENT[name] + 1) / (n + 2)
    return scale * F.sqrt(share * (1 - share) / (n + 3))


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, n)``: the mergeable sketches, as counts by bucket."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(scaled(m)).alias("bucket")) for m in MEASURES]))
    return measured.select("lang", "source", each.alias("s")).groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def leaning(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, w)`` of every group: its sketch, filled up to ``PRIOR`` documents from its language's, itself filled up from the corpus's.

    Weights are whole numbers, ``PARTS`` a document, so sums don't depend on their order.
    """
    share = lambda w, over: F.floor(F.col("lack") * PARTS * F.col(w) / F.sum(w).over(Window.partitionBy(*over))).cast("long")
    docs = F.sum(F.when(F.col("measure") == next(iter(MEASURES)), F.col("n")).otherwise(0))
    lack = lambda n: F.greatest(PRIOR - F.coalesce(n, F.lit(0)), F.lit(0))
    sizes = sketch.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(docs.alias("docs"))
    groups = groups.join(sizes, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").select("lang", "source", F.coalesce("docs", F.lit(0)).alias("docs"))
    corpus = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(lack(F.sum("docs")).alias("lack")).where("lack > 0")
    lent = langs.withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES)))).join(corpus, "measure").select("lang", "measure", "bucket", share("n", ["lang", "measure"]).alias("w"))
    by_lang = sketch.select("lang", "measure", "bucket", (F.col("n") * PARTS).alias("w")).unionByName(lent).groupBy(F.col("lang").alias("__lang"), "measure", "bucket").agg(F.sum("w").alias("w"))
    lent = groups.withColumn("lack", lack(F.col("docs"))).where("lack > 0").join(by_lang, F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", "source", "measure", "bucket", share("w", ["lang", "source", "measure"]).alias("w"))
    return sketch.select("lang", "source", "measure", "bucket", (F.col("n") * PARTS).alias("w")).unionByName(lent).groupBy("lang", "source", "measure", "bucket").agg(F.sum("w").alias("w"))


def quantiles(sketch: DataFrame, parts: int) -> DataFrame:
    """``(lang, source, <measure>_low, <measure>_high)`` by group: what 1 in ``parts`` lie at or below, and all but 1 in ``parts``.

    Rounded outwards, as both may lie in one bucket.
    """
    group = Window.partitionBy("lang", "source", "measure")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumn("upto", F.sum("w").over(run)).withColumn("all", F.sum("w").over(group))
    at = lambda m, name, q, end: F.min(F.when((F.col("measure") == m) & (F.col("upto") * parts >= F.col("all") * q), end(F.col("bucket")))).alias(f"{m}_{name}")
    return ranked.groupBy("lang", "source").agg(*[at(m, *x) for m in MEASURES for x in (("low", 1, bucket_bottom), ("high", parts - 1, bucket_top))])


def with_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with the columns of their group's row in ``limits``; documents of a hot group are dealt over copies of it."""
    named = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}).withColumn("__s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = measured.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    same = (F.col("lang").eqNullSafe(F.col("__lang"))) & (F.col("source").eqNullSafe(F.col("__source")))
    return salted.join(named, same & (F.col("__salt") == F.col("__s")), "left").drop("__lang", "__source", "__salt", "__s")


def within(margin: Callable[[str, Column], Column]) -> Column:
    """Whether each measure lies between its low and high limits, give or take ``margin(measure, limit)``; limits that are missing bind nothing."""
    out = F.lit(True)
    for m, (_, _, _, low_too) in MEASURES.items():
        low, high = F.col(f"{m}_low"), F.col(f"{m}_high")
        out &= F.coalesce(scaled(m) <= high + margin(m, high), F.lit(True))
        if low_too:
            out &= F.coalesce(scaled(m) >= low - margin(m, low), F.lit(True))
    return out


def core(fit: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows within ``REACH`` times their group's quartile range, or their own noise if that is more, of its quartiles."""
    quartered = with_limits(fit, quantiles(leaning(sketches(fit), groups), 4))
    spread = lambda m, limit: REACH * F.greatest((F.col(f"{m}_high") - F.col(f"{m}_low")).cast("double"), noise(m, limit))
    return quartered.where(within(spread))


def judge(docs: DataFrame) -> DataFrame:
    """The base measures of every document, its group's cutoffs ``<measure>_low`` and ``<measure>_high``, and ``kept``.

    The measures are written once: sketches and filter both read them, not the texts.
    """
    measured = materialize(base_measures(docs))
    groups = measured.select("lang", "source").distinct()
    cutoffs = quantiles(leaning(sketches(core(measured.where("not base_failed"), groups)), groups), TAIL)
    return with_limits(measured, cutoffs).withColumn("kept", ~F.col("base_failed") & within(lambda m, limit: REACH * noise(m, limit)))
