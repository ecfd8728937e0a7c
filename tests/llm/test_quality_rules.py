import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mosaiq.llm import quality_rules as q
from mosaiq.llm.queries import op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, covered, lines, dup = Counter(windows), set(), set(), 0
    for k, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(k, k + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(rows, texts):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts(r))
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r.base_failed and r.kept)


def test_query(spark, sf_dir, texts):
    rows = op2_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, lambda r: texts[r.doc_id])


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    judged = op2_quality_rules(spark, sf_dir.replace("0.001", "0.01"))
    rows = judged.join(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert all(clean) and sum(junk) < 0.2 * len(junk)


def test_repeats_and_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f g", "x a b c d e y a b c d e f a b c d e f", "a b c d e", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", q.repeated_words(F.split("text", " ")).alias("n")).collect()
    assert [r.n for r in rows] == [base(r.text)[4] for r in rows]


def test_sketches_merge_and_bound_quantiles(spark):
    values = spark.range(5000).select((F.col("id") * 37 % 4999).alias("v"))
    counted = values.select(q.bucket(F.col("v")).alias("b"), "v").groupBy("b").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("*", q.bucket_top(F.col("b")).alias("top")).collect()
    assert all(r.high <= r.top and r.top - r.low <= max(1, r.low / 16) for r in counted)


def test_odd_rows(odd, empty):
    rows = q.judge(odd).collect()
    assert len(rows) == odd.count() and all(r.kept is not None for r in rows)
    alike = [r.kept for r in rows if r.n_words == 11 and r.lang == "en"]
    assert len(alike) == 3 and len(set(alike)) == 1
    assert q.judge(empty).count() == 0


def test_each_cutoff_rejects_alone(spark):
    """For each measure and side, a row that passes the base rules and every other cutoff; rows with a little of it stay."""
    vocabulary = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}xy" for k in range(17576)]
    distinct = lambda n, at=0: vocabulary[at : at + n]
    lines = lambda ws: "\n".join(" ".join(ws[k : k + 10]) for k in range(0, len(ws), 10))
    single = " ".join(vocabulary[k][j] for k in range(0, 6000, 40) for j in (0, 1))
    rows = {
        "symbols_high": lines(distinct(200)) + " " + "#" * 100,
        "dup_lines_high": "\n".join(x for k in range(100) for x in (lines(distinct(10, 10 * k)), "zz")),
        "repeats_high": lines(distinct(900)) + " " + " ".join(distinct(90)),
        "word_length_high": " ".join(w * 4 for w in distinct(200)),
        "word_length_low": single,
        "one line of three": "\n".join(["a b c", lines(distinct(10)), "a b c"]),
        "one repeat": lines(distinct(60)) + " " + " ".join(distinct(5)),
        "a few symbols": lines(distinct(30)) + " ###",
    }
    docs = [(k, lines(distinct(100 + k, 100 * k))) for k in range(170)] + [(1000 + k, t) for k, t in enumerate(rows.values())]
    judged = {r.doc_id: r for r in q.judge(spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("a").alias("source"))).collect()}
    assert all(judged[k].kept for k in range(170))
    for k, name in enumerate(rows):
        r = judged[1000 + k]
        out = outside(measures(r), {(m, end): r[f"{m}_{end}"] for m in q.MEASURES for end in ("low", "high")})
        assert not r.base_failed and out == ([name] if name.endswith(("_high", "_low")) else []) and r.kept == (not out), (name, out)


# By brute force: measures as (count, of how many), sketches as Counters of buckets.


def measures(r):
    return {m: (r[top], r[bottom]) for m, (top, bottom, _, _) in q.MEASURES.items()}


def value(m, counts):
    return counts[0] * q.MEASURES[m][2] // counts[1] if counts[1] else 0


def noise(m, counts, typical):
    top, n = counts
    if m == "word_length":
        return typical / math.sqrt(max(n, 1))
    n, share = n / q.EVENT[m], (top / q.EVENT[m] + 1) / (n / q.EVENT[m] + 2)
    return q.MEASURES[m][2] * math.sqrt(share * (1 - share) / (n + 3))


def outside(row, limits, spread=None):
    out = []
    for m, (_, _, _, low_too) in q.MEASURES.items():
        margin = lambda limit: 3 * max(spread[m] if spread else 0, noise(m, row[m], limit))  # noqa: B023, E731
        low, high = limits[m, "low"], limits[m, "high"]
        if high is not None and value(m, row[m]) > high + margin(high):
            out.append(f"{m}_high")
        if low_too and low is not None and value(m, row[m]) < low - margin(low):
            out.append(f"{m}_low")
    return out


def place(v):
    e = max(v.bit_length() - 5, 0)
    return 32 * e + (v >> e)


def cutoffs(rows, groups, parts):
    """By group and (measure, end), from rows (group, measures)."""
    limits = {g: {} for g in groups}
    for m in q.MEASURES:
        sketch = {g: Counter() for g in groups}
        for g, row in rows:
            sketch[g][place(value(m, row[m]))] += 1
        corpus = sum(sketch.values(), Counter())
        filled = lambda c, wider: Counter({b: n * q.PARTS for b, n in c.items()}) + Counter({b: int(max(q.PRIOR - c.total(), 0) * q.PARTS * n / wider.total()) for b, n in wider.items()})
        languages = {}
        for g in groups:
            languages.setdefault(g[0], Counter()).update(sketch[g])
        languages = {lang: filled(c, corpus) for lang, c in languages.items()}
        for g in groups:
            leaning = filled(sketch[g], languages[g[0]])
            upto = lambda share: next((b for b in sorted(leaning) if sum(n for x, n in leaning.items() if x <= b) * parts >= leaning.total() * share), None)  # noqa: B023, E731
            low, high = upto(1), upto(parts - 1)
            limits[g][m, "low"] = None if low is None else (low % 32) << low // 32
            limits[g][m, "high"] = None if high is None else (high % 32 + 1 << high // 32) - 1
    return limits


def brute_force(rows):
    fit, groups = [(r.lang_source, measures(r)) for r in rows if not r.base_failed], {r.lang_source for r in rows}
    quartiles = cutoffs(fit, groups, 4)
    spread = {g: {m: quartiles[g][m, "high"] - quartiles[g][m, "low"] for m in q.MEASURES} for g in groups} if fit else {}
    tails = cutoffs([(g, row) for g, row in fit if not outside(row, quartiles[g], spread[g])], groups, q.TAIL)
    return tails, [not r.base_failed and not outside(measures(r), tails[r.lang_source]) for r in rows]


def test_verdicts_by_brute_force(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    rows = q.judge(docs).select("*", F.struct("lang", "source").alias("lang_source")).collect()
    tails, kept = brute_force(rows)
    assert len(rows) == docs.count() and [r.kept for r in rows] == kept and 0 < sum(kept) < len(kept)
    assert all({(m, end): r[f"{m}_{end}"] for m in q.MEASURES for end in ("low", "high")} == tails[r.lang_source] for r in rows)


def test_groups_with_other_norms_have_other_cutoffs(spark):
    """Code holds symbols in every text and tables repeat lines: these stay there, and go elsewhere. Small groups lean on their language."""
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(a, b)))
    prose = lambda n, a=2, b=9: " ".join(word(a, b) for _ in range(n))
    code = lambda share: " ".join(word(2, 9) + ("##" if rng.random() < share else "") for _ in range(200))
    table = lambda k: "\n".join([f"{prose(12)}" for _ in range(40)] + ["--- ---"] * k)
    docs = [(k, prose(200), "en", "web") for k in range(400)] + [(1000 + k, code(rng.uniform(0.2, 0.5)), "en", "code") for k in range(400)]
    docs += [(2000 + k, table(rng.randint(10, 30)), "en", "tables") for k in range(400)] + [(3000 + k, prose(200, 8, 14), "fi", "web") for k in range(400)]
    strays = [(9000, code(0.4), "en", "web"), (9001, table(20), "en", "web"), (9002, prose(200, 8, 14), "en", "web"), (9003, prose(200), "fi", "web"), (9004, prose(200), "en", "new"), (9005, code(0.4), "en", "new"), (9006, table(20), "fi", "new")]
    judged = {r.doc_id: r for r in q.judge(spark.createDataFrame(docs + strays, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(judged[k].kept for k, *_ in docs) > 0.99 * len(docs)
    assert [judged[k].kept for k in range(9000, 9007)] == [False, False, False, False, True, True, False]
    assert judged[0].symbols_high < 5_000 < judged[1000].symbols_high and judged[0].dup_lines_high < 100_000 < judged[2000].dup_lines_high and judged[0].word_length_high < judged[3000].word_length_low
