import random
import re
from collections import Counter, defaultdict

import pytest

from mosaiq.llm import collocations as c
from mosaiq.llm import queries

UP = {k: k + 32 for k in range(65, 91)}


def brute(rows, least=30, percent=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for at in range(len(words) - k + 1):
                    f[lang][tuple(words[at : at + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, longer in candidates.items():
            for k in range(2, len(p)):
                for at in range(len(p) - k + 1):
                    if 100 * longer >= percent * counts[p[at : at + k]]:
                        gone.add(p[at : at + k])
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def made_rows(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "über", "new york", "a\x01", "a", "a-b", "x\x1cy", "\U0001f600", *(f"w{k}" for k in range(30))]
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.5 else rng.choice(vocabulary[:5])
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? ", "\r\n"]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words += ["over", "and", "over", "again"] if rng.random() < 0.05 else [word()]
        rows.append(("".join(w + rng.choice(ends) for w in words), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (None, None), ("...", "fr"), ("one " * 3000, "long"), *[("same row of words here", "en")] * 40]


@pytest.mark.parametrize("shard_bytes, range_bytes", [(c.SHARD_BYTES, c.RANGE_BYTES), (700, 900), (100, 5000)])
def test_against_brute_force(spark, shard_bytes, range_bytes):
    rows = made_rows()
    docs = spark.createDataFrame([(t, v, 1, "clash") for t, v in rows], "text string, lang string, phrase int, part string").repartition(3)
    for least, percent, most in ((30, 80, 2000), (3, 60, 25)):
        found = got(c.collocations(docs, least, percent, most, shard_bytes=shard_bytes, range_bytes=range_bytes))
        assert found == brute(rows, least, percent, most) and found


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.op13_collocations(spark, sf_dir)) == brute(rows)


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("a b", "en")]):
        assert c.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_tries_are_cut_without_loss():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b", b"c", b"d", c.BREAK]) for _ in range(500)]
    trie = c.Trie.of(words)
    paths = {tuple(words[k : k + 4]) for k in range(490) if c.BREAK not in words[k : k + 4]}
    for splitters in ([], [(b"b",)], sorted(rng.sample(sorted(paths), 6)) + [(b"zz", b"a")], [(b"a", b"b"), (b"a", b"b", b"a"), (b"aa",), (b"c", b"c", b"b", b"d")]):
        splitters.sort()
        whole = c.merged([part for _, part in trie.parts([])], 1)
        pieces = [c.merged([part, part], 2) for _, part in trie.parts(splitters)]
        doubled = sorted((depth, phrase, n // 2, [v // 2 for v in before]) for _, found in pieces for depth, phrase, n, before in found)
        assert doubled == sorted(whole[1]) and sum(t for t, _ in pieces) == 2 * whole[0]


def test_long_texts_are_cut_between_words():
    text = b"word and more, " * 50
    parts = list(c.portions(text, 40))
    assert b"".join(parts) == text and all(len(p) < 60 for p in parts) and [w for p in parts for w in c.words_of(p)] == c.words_of(text)
    assert list(c.portions(b"x" * 100, 10)) == [b"x" * 100]
