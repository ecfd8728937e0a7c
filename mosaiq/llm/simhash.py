"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: A-Z lower-cased, words between white space, 3-word shingles (repeats
included); bit b is set if more than half of the shingles' XXH64 values (seed 42)
have it. A text of fewer words has its whole sequence as one shingle; a text without
words, or null, has fingerprint 0, which links like any other.

Candidates for ``MOST_BITS`` = 3 differing bits: the 64 bits are cut into segments of
22, 21 and 21. Three errors either leave one segment whole and another with at most one
error, or put just one error into each. In the perfect [23, 12] Golay code every word is
within 3 of one codeword; the codewords within 4 of a word (one, or six if the nearest is
3 away) hold the nearest one of every word that differs in at most one bit. So a segment
with at most one error is met by "nearest codeword" on one side and "codewords within 4"
on the other. The keys, each joined by equality and then verified bit by bit:

* for each ordered pair of segments: one whole, and a codeword of the other (33 bits at
  least);
* for one error in each: codewords of the last two segments, and either half of the
  first, of which one is whole (35 bits). Here each side posts the nearest codeword of
  one segment with all those within 4 of the other.

Scale: keys of 33 bits and more keep chance meetings rare (about 60 N / 2^33 a
fingerprint); the number of keys a fingerprint posts is fixed. Equal fingerprints are one
row before anything is posted. A key that more than ``CROWDED`` fingerprints share is
made longer: of any four disjoint pieces of the bits, three errors leave one whole, so its
members are dealt over (piece, value) for four pieces, up to three times (pieces by the
three base-4 digits of a bit's place, so each time cuts across the last). Near copies
scatter over these; what is still crowded is compared in blocks of ``BLOCK``. Of each
comparison only a spanning forest of the links is kept, so a group of near copies yields
rows in proportion to its members, and no link between components is lost.

Documents without an id stay rows of their own and never name a component: it is the
smallest id reachable, or null if there is none. Repeated rows link like any others; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.forest import spanning_forest
from mosaiq.operators.components import connected_components
from mosaiq.plans.lineage import materialize, unsized

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: Fingerprints of a side that are compared at once; of a key, before it is made longer.
BLOCK, CROWDED = 2048, 8192
#: Shingles in hand at a time.
RUN = 100_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Places of the bits of each piece, by level.
PIECES = [[[b for b in range(64) if b // 4**level % 4 == piece] for piece in range(4)] for level in range(3)]

# Fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the [23, 12] Golay code.
GENERATOR = 0b110001110101


def fingerprint(raw: bytes | None) -> int:
    """The 64-bit SimHash of UTF-8 bytes, as a signed integer."""
    words = (raw or b"").lower().split()  # bytes: only ASCII is lowered, only U+0020 and U+0009-000D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    last = max(len(words) - SHINGLE + 1, 1)
    stops = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]) - 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, RUN):
        span = zip(starts[at : min(at + RUN, last)].tolist(), stops[at : at + RUN].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in span], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<i8")[0])


def simhash(text: Column) -> Column:
    """The fingerprint of a string column, as a long."""

    @F.arrow_udf("long")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array((fingerprint(t.as_py()) for t in part), pa.int64())

    return fingerprints(text.cast("binary"))


class Golay:
    """Tables of the code: remainders, the error of each remainder, and the errors of weight 4 that share it."""

    def __init__(self):
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        self.low = np.array([remainder(w) for w in range(1 << 12)])
        self.high = np.array([remainder(w << 12) for w in range(1 << 11)])
        bits = lambda places: sum(1 << p for p in places)
        of = lambda e: int(self.low[e & 4095] ^ self.high[e >> 12])
        # Errors by remainder: first the one of weight up to 3, then (where that is 3) five of weight 4.
        self.errors = np.full((1 << 11, 6), -1)
        used = np.zeros(1 << 11, int)
        for weight in range(5):
            for e in map(bits, combinations(range(23), weight)):
                if (s := of(e)) and weight == 4 and bin(self.errors[s, 0]).count("1") < 3:
                    continue
                self.errors[s, used[s]] = e
                used[s] += 1

    def codewords(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit indices of the codewords within 4 of each word, the nearest first; -1 pads."""
        errors = self.errors[self.low[words & 4095] ^ self.high[words >> 12]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def postings(fingerprints: DataFrame, looks_up: bool) -> DataFrame:
    """``(key, fp)`` of distinct fingerprints ``fp``: the keys each is found under, or those that it looks up."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for part in np.array_split(every := batch.column(0).to_numpy(), max(1, len(every) // 4096)):
                bits = part.view(np.uint64)
                words = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
                near = [code.codewords(w) for w in words]
                keys, owners = [], []

                def put(tag: int, whole: np.ndarray, codes: np.ndarray, there: np.ndarray) -> None:
                    keys.append(((tag << 48) | (whole[:, None] << 24) | codes)[there])  # noqa: B023
                    owners.append(part[np.nonzero(there)[0]])  # noqa: B023

                sought = lambda c, many: c if many else c[:, :1]
                for tag, (i, j) in enumerate(permutations(range(3), 2)):
                    codes = sought(near[j], looks_up)
                    put(tag, words[i], codes, codes >= 0)
                a, b = sought(near[1], looks_up), sought(near[2], not looks_up)
                both, there = ((a[:, :, None] << 12) | b[:, None, :]).reshape(len(part), -1), ((a[:, :, None] >= 0) & (b[:, None, :] >= 0)).reshape(len(part), -1)
                for half in (0, 1):
                    put(6 + half, words[0] >> 11 * half & 2047, both, there)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners)], ["key", "fp"])

    return fingerprints.select("fp").mapInArrow(post, "key long, fp long")


#: Whether a key has both sides and more than one fingerprint.
MEETS = "n_index > 0 and n_met > 0 and lo != hi"


def counted(sides: DataFrame) -> DataFrame:
    """``sides(key, fp, looks_up)`` with ``n_index`` and ``n_met`` of their key, where a fingerprint may meet another."""
    sizes = sides.groupBy("key").agg(F.count(F.when(~F.col("looks_up"), 1)).alias("n_index"), F.count(F.when(F.col("looks_up"), 1)).alias("n_met"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    return unsized(sides).join(materialize(sizes.where(MEETS).select("key", "n_index", "n_met")), "key")


def shared_keys(fingerprints: DataFrame) -> list[DataFrame]:
    """Tables ``(key, fp, looks_up, n_index, n_met)`` of keys by which fingerprints may meet others; crowded ones are made longer."""
    index = postings(fingerprints, False)  # many rows a fingerprint, so joins of these must not go by their planned size
    # Tables are written before they are joined: both sides then come straight from a shuffle, and large keys can be split.
    there = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n_index"), F.min("fp").alias("least"), F.max("fp").alias("most")))
    met = materialize(unsized(postings(fingerprints, True)).join(there, "key"))
    of_key = [F.first("n_index").alias("n_index"), F.count(F.lit(1)).alias("n_met"), F.min(F.least("fp", "least")).alias("lo"), F.max(F.greatest("fp", "most")).alias("hi")]
    sizes = materialize(met.groupBy("key").agg(*of_key).where(MEETS).select("key", "n_index", "n_met"))
    sides = materialize(unsized(index.withColumn("looks_up", F.lit(False)).unionByName(met.select("key", "fp", F.lit(True).alias("looks_up")))).join(sizes, "key"))
    is_crowded, out = F.greatest("n_index", "n_met") > CROWDED, []
    for pieces in PIECES:
        crowded = sides.where(is_crowded)
        if crowded.isEmpty():
            break
        out.append(sides.where(~is_crowded))
        masks = [int(np.uint64(sum(1 << b for b in places)).view(np.int64)) for places in pieces]
        values = F.explode(F.array(*[F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]))
        sides = materialize(counted(crowded.select(values.alias("key"), "fp", "looks_up")))
    return [*out, sides]


def links(fingerprints: DataFrame) -> DataFrame:
    """``(src, dst)`` of distinct fingerprints within ``MOST_BITS``: enough links to span every component."""
    sides = reduce(DataFrame.unionByName, shared_keys(fingerprints))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    dealt = sides.withColumn("a", F.explode(F.when(F.col("looks_up"), every("n_index")).otherwise(F.array(own("n_index")))))
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("looks_up"), F.array(own("n_met"))).otherwise(every("n_met"))))
    side = lambda looks: F.collect_list(F.when(F.col("looks_up") == looks, F.col("fp")))
    pairs = dealt.groupBy("key", "a", "b").agg(side(False).alias("xs"), side(True).alias("ys"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = (np.asarray(side.values) for side in (left, right))
                if not len(x) or not len(y):
                    continue
                apart = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64))  # of signed numbers it counts the absolute value's
                for i, j in spanning_forest((apart > 0) & (apart <= MOST_BITS)):
                    src.append(x[i])
                    dst.append(y[j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return pairs.select("xs", "ys").mapInArrow(compare, "src long, dst long").distinct()


def classed(docs: DataFrame, **more: Column) -> DataFrame:
    """``(doc_id, fp, component, component_id)`` for every row; ``component`` is a fingerprint. Fingerprints are computed once and written.

    Columns named in ``more`` are computed with them and come last.
    """
    marked = materialize(docs.select("doc_id", simhash(F.col("text")).alias("fp"), *[c.alias(name) for name, c in more.items()]))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(distinct)).select(F.col("node").alias("fp"), "component")
    classes = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written, so that the join's sides come straight from a shuffle and a text with very many copies can be split.
    ids = materialize(classes.join(least, "component").select("fp", "component", "component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component", "component_id", *more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row."""
    return classed(docs).drop("component")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest id, rows without an id last.

    ``found`` is what ``classed`` tells of ``docs``, if some of its components were joined since.

    Of several rows with that id the smallest fingerprint stays, then the smallest XXH64 of the text,
    then of the row, so reruns keep the same row. Null, empty and blank texts are one component.
    """
    found = materialize(classed(docs)) if found is None else found
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.fp").alias("__fp"))
    kept = materialize(kept)
    unclear = materialize(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __id is null").select("__id"))
    same = docs["doc_id"].eqNullSafe(F.col("__id"))
    if unclear.isEmpty():
        return docs.join(kept.select("__id"), same, "left_semi")
    clear = kept.join(unclear.withColumnRenamed("__id", "__u"), F.col("__id").eqNullSafe(F.col("__u")), "left_anti").select("__id")
    several = docs.join(unclear, same, "left_semi").withColumn("__print", simhash(F.col("text")))
    several = several.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__fp")), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(row)), F.to_json(row)))
    one = several.groupBy("doc_id", "__print").agg(first.alias("row")).select("row.*")
    return docs.join(clear, same, "left_semi").unionByName(one)
