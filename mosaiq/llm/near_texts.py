"""Links of texts by the Jaccard similarity of their word shingles, for what fingerprints of few bits miss.

An edit of a short text moves more bits of a SimHash than codeword keys can reach, so the
pipeline's near-dedup adds to SimHash groups all pairs found here: sets of ``SHINGLE``
words, similarity ``LEAST`` or more, computed exactly.

Candidates come from ``BANDS`` keys a text, each a hash of ``ROWS`` minima over its
shingles; texts of similarity 0.8 share one with probability 0.998. Texts with fewer words
than a shingle have their whole sequence as one; those without words have no keys.

Texts equal in words are one row before anything is posted. Pairs that are alone in their key
are compared once, however many keys they share. Other keys are compared in cells of about
``BLOCK`` texts: a task counts the shingles that each two texts of a cell share, and keeps of the
links only what spans the groups, so a cell yields fewer rows than it has texts.

A key too large for a cell is dealt over cells once. Groups that hang together by links so far
become one, so of a large family of near copies only outliers are apart. All texts outside a
key's largest group are then compared with the whole key: rows in proportion to texts times
blocks of outliers. A key with more outliers than a cell holds (texts that share a passage, but
are not similar) is made longer by ``BANDS`` further keys, up to ``LEVELS`` times, and starts
anew; what is still crowded is compared in blocks, whole. No two texts of a key stay uncompared
but in keys made longer, where texts of similarity 0.8 share one with probability 0.998.

Texts are told apart by a 64-bit hash of their words. Null, empty and blank texts link
with nothing here; repeated rows are one text; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.text import words
from mosaiq.operators.components import connected_components, joined_inside
from mosaiq.plans.lineage import materialize, unsized

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SEED = 12, 4, 7
#: Shingles in hand at a time while minima are taken.
RUN = 4096
#: Texts of a cell, and bytes of their shingles; times that a crowded key is made longer; shingles that are counted at a time.
BLOCK, BLOCK_BYTES, LEVELS, WIDTH = 512, 4 << 20, 3, 4096


def plain(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_join(words(F.translate(text, upper, upper.lower())), " ")


def text_id(text: Column) -> Column:
    """The hash that tells texts apart; null for those without words."""
    return F.when(plain(text) != "", F.xxhash64(plain(text)))


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a plain text as sorted 64-bit hashes."""
    raw = text.encode()
    parts = raw.split(b" ") if raw else []
    if not parts:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.r_[0, ends[:-1]].tolist()
    stops = ((ends[SHINGLE - 1 :] if len(parts) >= SHINGLE else ends[-1:]) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(raw[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def multipliers(level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the summands that make one order of the shingles for each minimum, others at each level."""
    rng = np.random.default_rng(SEED + level)
    factors, summands = rng.integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64)
    return factors * np.uint64(2) + np.uint64(1), summands


def bands(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> list[int]:
    """The keys of a set of shingles."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), RUN):
        least = np.minimum(least, (hashes[at : at + RUN, None] * factors + summands).min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def keyed(texts: DataFrame) -> DataFrame:
    """``(tid, key)`` of ``texts(tid, plain)``."""

    @F.pandas_udf("array<long>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        how = multipliers()
        for part in parts:
            yield pd.Series([bands(shingles(t), *how) for t in part], dtype=object)

    return texts.select("tid", F.explode(keys(F.col("plain"))).alias("key"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose texts' shingles (``sets(tid, s)``, hashes as bytes) are similar."""

    @F.pandas_udf("boolean")
    def reach(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            least, most = sorted((len(x), len(y)))
            both = len(np.intersect1d(x, y, assume_unique=True)) if least >= LEAST * most else 0
            # In whole numbers of tenths, so that a similarity of just 0.8 counts.
            out.append(both > 0 and 10 * both >= round(10 * LEAST) * (least + most - both))
        return pd.Series(out, dtype=bool)

    n = F.octet_length("s")
    left, right = sets.select(F.col("tid").alias("a"), F.col("s").alias("x")), sets.select(F.col("tid").alias("b"), F.col("s").alias("y"))
    sizes = sets.select("tid", n.alias("n"))
    # Sizes first: they rule out most chance pairs before any set is moved.
    sized = pairs.join(sizes.select(F.col("tid").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("tid").alias("b"), F.col("n").alias("nb")), "b")
    near = sized.where(10 * F.least("na", "nb") >= round(10 * LEAST) * F.greatest("na", "nb")).select("a", "b")
    return near.join(left, "a").join(right, "b").where(reach(F.col("x"), F.col("y"))).select("a", "b")


def reached(parts: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups which similar texts join; ``parts`` has each text's shingles, ``groups`` its group."""
    n = np.array([len(part) for part in parts])
    every, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.r_[True, every[1:] != every[:-1]]) - 1
    # A shingle of one text alone adds to no count.
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((len(parts), len(parts)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, (at, at + WIDTH))
        has = np.zeros((len(parts), int(column[hi - 1]) + 1 - at), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        both += (has @ has.T).astype(np.int64)
    near = (both > 0) & (10 * both >= round(10 * LEAST) * (n[:, None] + n - both)) & (groups[:, None] != groups)
    names, at = np.unique(groups, return_inverse=True)
    root = joined_inside(len(names), *(at[end] for end in np.nonzero(near)))
    return names[root != np.arange(len(names))], names[root[root != np.arange(len(names))]]


def compared(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """``(src, dst)``: groups joined by similar texts of one cell; ``cells(key, a, b, tid, group)``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            for cell in batch.column(0):
                groups, texts = cell.values.flatten()
                found.append(reached([np.frombuffer(t.as_py(), np.uint64) for t in texts], groups.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["src", "dst"])

    texts = unsized(cells).join(sets, "tid").groupBy("key", "a", "b").agg(F.collect_list(F.struct("group", "s")).alias("texts"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    return materialize(texts.where("lo != hi").select("texts").mapInArrow(compare, "src long, dst long").distinct())


def _blocks(n: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")


def _told(left: DataFrame) -> DataFrame:
    """``left(key, tid, group, bytes)`` of keys with several groups, with ``blocks`` (that its texts fill), ``largest`` (group) and ``rest`` (blocks outside it)."""
    of_group = left.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    most = F.max(F.struct("n", "size", "group"))
    of_key = of_group.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), most.alias("l"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    of_key = of_key.withColumn("n_rest", F.col("n") - F.col("l.n")).withColumn("size_rest", F.col("size") - F.col("l.size"))
    # Written before it is joined, so that a large key can be split.
    of_key = materialize(of_key.select("key", _blocks("n", "size").alias("blocks"), F.col("l.group").alias("largest"), F.greatest(_blocks("n_rest", "size_rest"), F.lit(1)).alias("rest")))
    return unsized(left.select("key", "tid", "group", "bytes")).join(of_key, "key")


def _outliers_with_all(left: DataFrame) -> DataFrame:
    """Cells in which each text outside its key's largest group meets every text of the key."""
    own = lambda n: F.pmod(F.xxhash64("tid"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole = F.transform(every("rest"), lambda a: cell(a, own("blocks")))
    apart = F.transform(every("blocks"), lambda b: cell(own("rest"), b))
    dealt = F.when(F.col("group") == F.col("largest"), whole).otherwise(F.array_union(whole, apart))
    return left.withColumn("cell", F.explode(dealt)).select("key", "cell.a", "cell.b", "tid", "group")


def _longer(left: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """``left`` with each key in ``BANDS`` longer ones."""

    @F.pandas_udf("array<long>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        how = multipliers(level)
        for part in parts:
            yield pd.Series([bands(np.frombuffer(s, np.uint64), *how) for s in part], dtype=object)

    more = materialize(sets.join(left.select("tid").distinct(), "tid", "left_semi").select("tid", keys(F.col("s")).alias("more")))
    return left.join(more, "tid").withColumn("more", F.explode("more")).select(F.xxhash64("key", "more").alias("key"), "tid", "group", "bytes")


def links(docs: DataFrame, of: DataFrame) -> DataFrame:
    """``(src, dst)``: groups that hang together by similar texts.

    ``of(tid, group)`` has a row for each ``text_id`` and the group (a long) that it is known to be in.
    """
    told = docs.select(plain(F.col("text")).alias("plain")).where("plain != ''").withColumn("tid", F.xxhash64("plain"))
    posted = materialize(keyed(told.select("tid", "plain")).groupBy("key", "tid").agg(F.lit(1).alias("n")).drop("n"))
    several = posted.groupBy("key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo != hi").select("key")
    left = materialize(posted.join(several, "key").join(of, "tid"))
    # Keys whose texts are all of one group have nothing to tell.
    of_key = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("a"), F.max("tid").alias("b"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    of_key = materialize(of_key.where("lo != hi").select("key", "n", "a", "b"))
    pairs = of_key.where("n = 2").select("a", "b").distinct()
    left = left.join(of_key.select("key", "n"), "key")

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles(t).tobytes() for t in part], dtype=object)

    # Equal texts have equal sets, so any of them will do; they are made one before they are joined, as there may be very many.
    sought = told.groupBy("tid").agg(F.first("plain").alias("plain")).join(left.select("tid").distinct(), "tid", "left_semi")
    sets = materialize(sought.select("tid", packed(F.col("plain")).alias("s")))
    end = lambda name, tid: of.select(F.col("tid").alias(tid), F.col("group").alias(name))
    every = materialize(similar(pairs, sets).join(end("src", "a"), "a").join(end("dst", "b"), "b").select("src", "dst"))
    left = materialize(_told(left.where("n > 2").join(sets.select("tid", F.octet_length("s").cast("long").alias("bytes")), "tid")))
    for level in range(1, LEVELS + 2):
        one = F.pmod(F.xxhash64("tid"), F.col("blocks"))
        every = every.unionByName(compared(left.select("key", F.lit(0).alias("a"), one.alias("b"), "tid", "group"), sets))
        left = left.where("blocks > 1")
        if left.isEmpty():
            break
        left = materialize(_told(joined(left.withColumnRenamed("group", "component"), every).withColumnRenamed("component", "group")))
        crowded = (F.col("rest") > 1) & F.lit(level <= LEVELS)
        every = every.unionByName(compared(_outliers_with_all(left.where(~crowded)), sets))
        left = left.where(crowded)
        if left.isEmpty():
            break
        left = materialize(_told(_longer(left, sets, level)))
    return every.where("src != dst").distinct()


def joined(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found(.., component)`` with components that ``pairs(src, dst)`` join made one, named by the smallest."""
    linked = materialize(connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("__joined")))
    return found.join(linked, "component", "left").withColumn("component", F.coalesce("__joined", "component")).drop("__joined")
