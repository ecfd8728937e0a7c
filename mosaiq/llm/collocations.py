"""Phrase collocations from count tries: built per shard, merged by prefix range, linked by suffix.

A shard (some megabytes of one language's texts) becomes a trie of its phrases of up to
``DEPTH`` words, by levels: the nodes of a level are sorted by words, and each has its
parent, its last word and its count. Splitters, taken from a bounded sample of phrases,
cut the order of all phrases into ranges of about equal work; they balance and never
change a result. A shard sends each range the part of its trie that lies there, with the
ancestors of the range's first phrase. One task merges the sorted parts of a range level
by level, and goes below those nodes alone whose total reaches the least count, since no
phrase is more frequent than its beginning. A hot word or pair is cut by ranges like any
other prefix, and its repeats are one number a shard.

A node's ancestors give the left parts of its cuts. Right parts come by suffix links: a
phrase without its first word is a phrase too, one level up, and hands on its own.

Defined results: null text counts as empty; null language is ``und``, one with the rows of
that name. Repeated rows count each time; ties go by the stated order, down to the phrase, which is
unique in a language. Texts of any length are cut into shards between words, with the
words needed to finish phrases. An empty table, or one without frequent phrases, gives no
rows. Columns beside the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.lineage import materialize

#: Words in the longest phrase.
DEPTH = 4
#: Bytes of text in a shard, and in a range on average.
SHARD_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Phrases sampled for each range's splitter, and documents that they come from at most (on average).
SAMPLED, SAMPLED_DOCS = 40, 4000

# No byte of UTF-8 text is 0xFF, so it stands for the end of a piece.
BREAK = b"\xff"
# What ends a piece, and what lies between words.
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", BREAK * 10 + b" abcdefghijklmnopqrstuvwxyz")

Level = tuple[np.ndarray, np.ndarray, np.ndarray]
Path = tuple[bytes, ...]


def word_array(text: bytes) -> pa.Array:
    """Lower-cased words in order, with ``BREAK`` between pieces."""
    spaced = text.translate(_FOLD).replace(BREAK, b" \xff ")
    words = pc.split_pattern(pa.array([spaced], pa.binary()), b" ").flatten()
    return words.filter(pc.not_equal(words, b""))


def words_of(text: bytes) -> list[bytes]:
    return word_array(text).to_pylist()


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in byte order, and the place of each word among them."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


def portions(text: bytes, size: int = SHARD_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(text) - at > size:
        end = min((k for k in (text.find(b" ", at + size), text.find(b"\n", at + size)) if k >= 0), default=len(text))
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


@dataclass
class Trie:
    """Levels ``(parent, word, count)``, each sorted by path; words are places in the sorted ``vocabulary``."""

    vocabulary: pa.Array
    levels: list[Level]

    @classmethod
    def of(cls, words: pa.Array | list[bytes], starts: int | None = None) -> Trie:
        """Counts of the phrases that start at the first ``starts`` words (all, if None)."""
        vocabulary, places = ranked(pa.array(words, pa.binary()) if isinstance(words, list) else words)
        ids = np.zeros(len(places) + DEPTH, np.int64)  # words from 1, and 0 where a piece ends
        ids[: len(places)] = places + 1
        if len(vocabulary) and vocabulary[-1].as_py() == BREAK:  # it comes after all words
            vocabulary = vocabulary.slice(0, len(vocabulary) - 1)
            ids[ids == len(vocabulary) + 1] = 0
        at, node, levels = np.flatnonzero(ids[: len(places) if starts is None else starts]), np.int64(0), []
        for k in range(DEPTH):
            keys, node, counts = np.unique(node * np.int64(len(vocabulary)) + ids[at + k] - 1, return_inverse=True, return_counts=True)
            levels.append((keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), counts))
            on = ids[at + k + 1] > 0
            at, node = at[on], node[on]
        return cls(vocabulary, levels)

    def cut(self, splitter: Path) -> tuple[list[int], int]:
        """How many nodes of each level come before the splitter, and how many of its proper prefixes are nodes."""
        before, found, low, high = [], 0, 0, len(self.levels[0][0])
        matched = True
        for k, (_, word, _) in enumerate(self.levels):
            here = low
            matched = matched and k < len(splitter)
            if matched:
                w = bisect_left(self.vocabulary, splitter[k], key=lambda v: v.as_py())
                here = low + int(np.searchsorted(word[low:high], w))
                matched = here < high and w < len(self.vocabulary) and self.vocabulary[w].as_py() == splitter[k] and int(word[here]) == w
            prefix = matched and k + 1 < len(splitter)
            found += prefix
            before.append(here + prefix)
            if k + 1 < len(self.levels):
                parents = self.levels[k + 1][0]
                low = int(np.searchsorted(parents, here))
                high = int(np.searchsorted(parents, here + 1)) if matched else low
        return before, found

    def parts(self, splitters: list[Path]) -> Iterator[tuple[int, bytes]]:
        """``(range, packed part)``: range ``k`` starts at splitter ``k - 1``; its part has that splitter's ancestors first."""
        sizes = [len(level[0]) for level in self.levels]
        cuts = [([0] * len(sizes), 0), *map(self.cut, splitters), (sizes, 0)]
        for k in range(len(splitters) + 1):
            (low, carried), (high, _) = cuts[k], cuts[k + 1]
            first = [a - (level < carried) for level, a in enumerate(low)]
            if any(b > a for a, b in zip(first, high)):
                yield k, self.packed(first, high, carried)

    def packed(self, low: list[int], high: list[int], carried: int) -> bytes:
        """A part as bytes: sizes, then numbers by planes (parents as differences), then its words."""
        used = np.unique(np.concatenate([word[a:b] for (_, word, _), a, b in zip(self.levels, low, high)]))
        words = self.vocabulary.take(pa.array(used))
        ends = np.frombuffer(words.buffers()[1], np.int32, len(used) + 1)
        out = [np.array([carried, len(used), *(b - a for a, b in zip(low, high))], "<u4").tobytes()]
        for k, (parent, word, count) in enumerate(self.levels):
            a, b = low[k], high[k]
            above = np.diff(parent[a:b] - (low[k - 1] if k else 0), prepend=0)
            out += [_planes(v) for v in (above, np.searchsorted(used, word[a:b]), count[a:b])]
        raw = b"".join([*out, _planes(np.diff(ends)), words.buffers()[2].to_pybytes()[: ends[-1]]])
        return len(raw).to_bytes(4, "little") + CODEC.compress(raw, asbytes=True)


CODEC = pa.Codec("zstd", 1)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, all their lowest bytes first."""
    return np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(part: bytes) -> tuple[pa.Array, list[Level], int]:
    """``(words, levels, carried)`` of a packed part."""
    raw = CODEC.decompress(part[4:], int.from_bytes(part[:4], "little"), asbytes=True)
    carried, n_words, *sizes = np.frombuffer(raw, "<u4", DEPTH + 2).tolist()
    at = 4 * (DEPTH + 2)

    def taken(n: int) -> np.ndarray:
        nonlocal at
        at += 4 * n
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at - 4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64)

    levels = [(np.cumsum(taken(n)), taken(n), taken(n)) for n in sizes]
    ends = np.concatenate([[0], np.cumsum(taken(n_words))]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(ends), pa.py_buffer(raw[at:])]), levels, carried


def merged(parts: list[bytes], least: int) -> tuple[int, list[tuple[int, bytes, int, list[int]]]]:
    """The words counted in a range, and its phrases of ``least`` or more: ``(depth, phrase, count, counts of its beginnings)``."""
    runs = [unpacked(p) for p in parts]
    vocabulary, places = ranked(pa.concat_arrays([words for words, _, _ in runs]))
    to = np.split(places, np.cumsum([len(words) for words, _, _ in runs])[:-1])
    above: list[np.ndarray] = [np.zeros(1, np.int64) for _ in runs]
    total, out, paths = 0, [], [(b"", [])]
    for k in range(DEPTH):
        ups = [up[levels[k][0]] for up, (_, levels, _) in zip(above, runs)]
        keys = np.concatenate([np.where(up < 0, -1, up * len(vocabulary) + t[levels[k][1]]) for up, t, (_, levels, _) in zip(ups, to, runs)])
        counts = np.concatenate([levels[k][2] for _, levels, _ in runs])
        # A part's first node is an ancestor that an earlier range reports.
        carried = np.concatenate([np.arange(len(levels[k][0])) < (k < c) for _, levels, c in runs])
        order = np.argsort(keys, kind="stable")  # merges the sorted runs
        order = order[keys[order] >= 0]
        if not len(order):
            break
        firsts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        sums, is_carried = np.add.reduceat(counts[order], firsts), carried[order][firsts]
        if k == 0:
            total = int(sums[~is_carried].sum())
        kept = sums >= least
        rank = np.full(len(keys), -1)
        rank[order] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1), np.diff(firsts, append=len(order)))
        above = np.split(rank, np.cumsum([len(levels[k][0]) for _, levels, _ in runs])[:-1])
        nodes = []
        found = keys[order][firsts][kept]
        last = vocabulary.take(pa.array(found % len(vocabulary))).to_pylist()
        for up, word, n, ancestor in zip((found // len(vocabulary)).tolist(), last, sums[kept].tolist(), is_carried[kept].tolist()):
            begun, counted = paths[up]
            phrase = begun + b" " + word if k else word
            nodes.append((phrase, [*counted, n]))
            if not ancestor:
                out.append((k + 1, phrase, n, counted))
        paths = nodes
    return total, out


def _splitters(texts: DataFrame, n_bytes: int, n_rows: int, range_bytes: int) -> list[tuple[str, Path]]:
    """``(lang, path)`` at about equal distances in the order of all phrases; none for a table of one range."""
    n_ranges = -(-n_bytes // range_bytes)
    if n_ranges < 2:
        return []
    every = max(1, n_rows // SAMPLED_DOCS)
    share = min(1.0, 6.0 * SAMPLED * n_ranges * every / n_bytes)  # a word and what follows it take six bytes or more

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, langs = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                raw = text.as_py()
                rng = random.Random(zlib.crc32(raw))
                for part in portions(raw):
                    words = words_of(part)
                    for k, word in enumerate(words):
                        if word != BREAK and rng.random() < share:
                            phrase = words[k : k + DEPTH]
                            paths.append(b" ".join(phrase[: phrase.index(BREAK)] if BREAK in phrase else phrase))
                            langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(paths, pa.binary())], ["lang", "path"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    found = some.mapInArrow(sample, "lang string, path binary").distinct().collect()
    order = sorted((r.lang, tuple(bytes(r.path).split(b" "))) for r in found)
    return [order[k * len(order) // n_ranges] for k in range(1, n_ranges)] if len(order) >= n_ranges else order


def frequent_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(lang, depth, phrase, n, beginnings)``: phrases of up to ``DEPTH`` words that occur ``least`` times or more.

    ``beginnings`` has the counts of the phrase's first 1, 2, ... words. Rows of depth 0 have parts of the count of all words.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")
    n_bytes, n_rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    splitters = _splitters(texts, n_bytes, n_rows, range_bytes)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def rows(name: str, trie: Trie) -> pa.RecordBatch:
            first = bisect_left(splitters, (name, ()))
            own = [path for at, path in splitters[first:] if at == name]
            made = [(first + k, name, part) for k, part in trie.parts(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else ((), (), ()), (pa.int32(), pa.string(), pa.binary()))], ["range", "lang", "part"])

        def flush(name: str) -> Iterator[pa.RecordBatch]:
            held.pop(name)
            before = pa.array([], pa.binary())
            for part in portions(b" \xff ".join(waiting.pop(name)), shard_bytes):
                words = word_array(part)
                if len(before) and len(words) >= DEPTH - 1:  # the words that begin this part end phrases of the one before
                    yield rows(name, Trie.of(pa.concat_arrays([before, words.slice(0, DEPTH - 1)]), len(before)))
                    before = words
                else:
                    before = pa.concat_arrays([before, words])
            yield rows(name, Trie.of(before))

        for batch in batches:
            for name, raw in zip(batch["lang"].to_pylist(), batch["text"]):
                value = raw.as_py()
                waiting.setdefault(name, []).append(value)
                held[name] = held.get(name, 0) + len(value) + 3
                if held[name] >= shard_bytes:
                    yield from flush(name)
                elif sum(held.values()) >= 2 * shard_bytes:
                    yield from flush(max(held, key=held.get))
        for name in list(waiting):
            yield from flush(name)

    def merge(table: pa.Table) -> pa.Table:
        by_lang: dict[str, list[bytes]] = {}
        for name, part in zip(table["lang"].to_pylist(), table["part"].to_pylist()):
            by_lang.setdefault(name, []).append(part)
        out = []
        for name in sorted(by_lang):
            total, phrases = merged(by_lang[name], least)
            out += [(name, 0, "", total, []), *((name, depth, phrase.decode(), n, counted) for depth, phrase, n, counted in phrases)]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["lang", "depth", "phrase", "n", "beginnings"])

    parts = texts.mapInArrow(shards, "range int, lang string, part binary")
    return parts.groupBy("range").applyInArrow(merge, "lang string, depth int, phrase string, n long, beginnings array<long>")


def with_endings(phrases: DataFrame) -> DataFrame:
    """``(lang, depth, phrase, n, beginnings, endings)``: endings are the counts of a phrase without its first 1, 2, ... words.

    All endings of a phrase in the table are in it too.
    """
    level = phrases.where("depth = 1").withColumn("endings", F.array().cast("array<long>"))
    out = level
    for depth in range(2, DEPTH + 1):
        linked = level.select("lang", F.col("phrase").alias("link"), F.concat(F.array("n"), "endings").alias("endings"))
        own = phrases.where(F.col("depth") == depth).withColumn("link", F.substring("phrase", F.instr("phrase", " ") + 1, F.length("phrase")))
        level = own.join(linked, ["lang", "link"]).drop("link").select(*phrases.columns, "endings")
        out = out.unionByName(level)
    return out


def best_cut(a: Column, beginnings: Column, endings: Column) -> Column:
    """The lowest-scoring cut, ties to the first: ``(score, k, l, r)``, ``score`` being floor(2000000 a / (l + r)) in whole numbers."""
    exact = lambda x: x.cast("decimal(38,0)")
    one = lambda l, r, k: F.struct(F.call_function("div", exact(a) * exact(F.lit(2000000)), exact(l) + exact(r)).cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))  # noqa: E731,E741
    cuts = F.transform(F.arrays_zip(beginnings.alias("l"), endings.alias("r")), lambda c, k: one(c["l"], c["r"], k + 1))
    return F.array_min(cuts)


def within_longer(phrases: DataFrame, percent: int) -> DataFrame:
    """``(lang, phrase)`` of those whose words lie in a longer phrase that is ``percent`` or more as frequent."""
    words = F.split("phrase", " ", -1)
    spans = [(at, n) for n in range(2, DEPTH) for at in range(DEPTH - n + 1)]
    inner = F.filter(F.array(*[F.when((F.col("depth") > n) & (F.col("depth") >= at + n), F.array_join(F.slice("words", at + 1, n), " ")) for at, n in spans]), lambda s: s.isNotNull())
    inside = phrases.where("depth > 2").withColumn("words", words).select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    near = 100 * F.col("longer").cast("decimal(38,0)") >= percent * F.col("n").cast("decimal(38,0)")
    return phrases.join(most, ["lang", "phrase"]).where(near).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, most: int = 2000, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``most`` best phrases of 2 to ``DEPTH`` words of each language."""
    found = materialize(frequent_phrases(docs, least, text, lang, shard_bytes, range_bytes))
    phrases = found.where("depth > 0")
    totals = found.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("words"))
    scored = with_endings(phrases).where("depth > 1").withColumn("cut", best_cut(F.col("n"), F.col("beginnings"), F.col("endings")))
    free = scored.join(within_longer(phrases, percent), ["lang", "phrase"], "left_anti")
    rank = F.expr("row_number() over (partition by lang order by cut.score desc, n desc, phrase)")
    first = free.withColumn("rank", rank).where(F.col("rank") <= most)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("words").alias("n"), F.col("cut.score").alias("score"))
