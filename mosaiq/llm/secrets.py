"""Secret scans: three fixed patterns, and a battery of randomness tests for the rest.

Base spans are the whole matches of the patterns, leftmost and non-overlapping by
kind; matches whose tested part is too short are dropped but still use up their text.

Further spans ("random") come from runs of 20 or more base64 characters outside the base
spans. A run with '+' or '/' and also '-' or '_' fits no encoding: its pieces between the
former and between the latter are taken instead (a token behind a path, a key behind a
prefix). The characters tell the encoding, the smallest alphabet that has them all (hex,
letters, base32, base36, base64); then a battery of tests is run.

A run is out if one of these tells it from random characters of its alphabet (level
``ORDER_LEVEL``, divided by their number):

* chi-squared uniformity over the alphabet;
* chi-squared over upper case, lower case and the rest;
* runs above and below the alphabet's middle;
* lag-1 serial correlation.

How surely it isn't written language is the p-value, by Fisher's method, of three tests
against what words and names have. It falls with length, so a short run must be clearer
than a long one:

* equal pairs of characters, which is the chi-squared statistic again: words have at
  least a share ``COLLIDES``, far over 1/alphabet;
* vowels, too few among the letters (if there are any);
* runs of letters and of digits, too many (if there are digits).

Which p-values count as found is settled by false-discovery control (Benjamini and
Hochberg) inside each encoding and length class, over all runs of the corpus. The
p-values are counted in tenths of decades, down to 1e-30, so the control reads a small
table of counts whatever the size of the corpus.

Positions are in code points, ends exclusive. Null text counts as empty and has no
spans; repeated rows are found alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.text import bind, cut, portions, running

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PIECES = (r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9+/]{20,}={0,2}")
# The alphabets in the order of their digits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "LETTERS": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32lower": "abcdefghijklmnopqrstuvwxyz234567",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "Letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Equal pairs of characters that names and words have at least, by alphabet size.
COLLIDES = {16: 0.12, 26: 0.07, 32: 0.075, 36: 0.072, 52: 0.055, 64: 0.055}
# Fixed values, of written English: the sum of cubed letter frequencies over the squared sum of squares, less 1; the share of
# vowels among letters. And the share of neighbours of which one is a letter and one a digit, in names with numbers in them.
CLUMPS, VOWELS, SWITCHES = 0.25, 0.38, 0.06
#: False discoveries allowed; level of the order tests; least tenth of a decade that counts.
Q, ORDER_LEVEL, MOST_BIN = 0.01, 0.001, 300


SPANS = "array<struct<start:int,end:int,s:string>>"


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, s>>`` of all matches: what lies between them gives their places."""

    def places(pieces: Column, found: Column) -> Column:
        both = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
        ends = running(F.transform(both, lambda x: F.length(x["p"]) + F.length(x["m"])))
        end = lambda e, k: F.element_at(e, k + 1).cast("int")
        return bind(ends, lambda e: F.transform(found, lambda m, k: F.struct((end(e, k) - F.length(m)).alias("start"), end(e, k).alias("end"), m.alias("s"))))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), bind(whole, lambda m: places(F.split(text, pattern, -1), m))).otherwise(F.from_json(F.lit("[]"), SPANS))


def replaced(text: Column, found: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with spans, sorted by start, replaced: ``by`` gets whether no earlier span reaches into one, and the number of its code points that none covers."""

    def parts(spans: Column, tops: Column, text_parts: Column) -> Column:
        before = lambda k: F.when(k > 0, F.element_at(tops, F.greatest(k, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        left = lambda s, k: F.greatest(s["end"] - F.greatest(s["start"], before(k)), F.lit(0))
        each = F.transform(spans, lambda s, k: F.concat(cut(text_parts, before(k), s["start"]), by(s["start"] >= before(k), left(s, k).cast("int"))))
        return F.concat(F.array_join(each, ""), cut(text_parts, F.element_at(tops, F.lit(-1)), F.length(text).cast("long")))

    tops = running(F.transform(found, lambda s: s["end"]), F.greatest)
    return F.when(F.size(found) == 0, text).otherwise(bind(tops, lambda t: bind(portions(text), lambda p: parts(found, t, p))))


def base_spans(text: Column) -> Column:
    """``array<struct<start, k, end>>`` of the three patterns (``k``: place in ``KINDS``), by start, then kind as listed."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = bind(values, lambda v: F.filter(located(text, ASSIGN), lambda x, i: F.length(F.try_element_at(v, i + 1)) >= 6))
    none = F.from_json(F.lit("[]"), SPANS)
    each = [F.when(text.rlike(ASSIGN), assign).otherwise(none), located(text, ACCESS), located(text, HEX)]

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("k"), s["end"].alias("end")))

    return F.sort_array(F.concat(*[tagged(x, kind) for kind, x in enumerate(each)]))


def _normal(z: Column) -> Column:
    """The normal distribution function, by a logistic fit that keeps order in the tails."""
    # Coefficients of the published approximation (Bowling and others, 2009).
    return 1 / (1 + F.exp(-F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-600.0)), F.lit(600.0))))


def battery(run: Column) -> Column:
    """``struct<encoding, length_class, bin>`` of a run of characters; null where no encoding fits or a test tells it from random ones."""
    gone = lambda s, pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    product = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def counted(s: Column) -> Column:
        """What the tests count, once a run."""
        classes = F.regexp_replace(F.regexp_replace(s, "[A-Za-z]", "l"), "[0-9]", "d")
        switches = (gone(classes, "ld") + gone(classes, "dl")) / 2
        equal = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2)))
        return F.struct(F.length(s).cast("double").alias("n"), equal.alias("equal"), switches.alias("switches"), gone(s, "[AEIOUaeiou]").alias("vowels"), gone(s, "[A-Z]").alias("upper"), gone(s, "[a-z]").alias("lower"), gone(s, "[0-9]").alias("digits"))

    def tests(s: Column, c: Column, e: Column) -> Column:
        """The battery over a run, what it counts, and its encoding: written once, with the encoding's numbers as values."""
        k, n, letters, collides = e["k"], c["n"], c["upper"] + c["lower"], e["collides"]
        # Against written language.
        pairs, due = n * (n - 1) / 2, n * (n - 1) / 2 * collides
        p_equal = _normal(((c["equal"] - n) / 2 + 0.5 - due) / F.sqrt(due * (1 - collides) + pairs * 2 * (n - 2) * CLUMPS * e["collides2"]))
        p_vowels = F.when(letters > 0, _normal((c["vowels"] + 0.5 - letters * VOWELS) / F.sqrt(F.greatest(letters, F.lit(1)) * VOWELS * (1 - VOWELS)))).otherwise(1.0)
        p_switches = F.when(c["switches"] > 0, _normal(((n - 1) * SWITCHES + 0.5 - c["switches"]) / F.sqrt((n - 1) * SWITCHES * (1 - SWITCHES)))).otherwise(1.0)
        half_x = -sum((F.log(F.greatest(p, F.lit(1e-90))) for p in (p_equal, p_vowels, p_switches)), F.lit(0.0))
        # Chi-squared with two degrees of freedom for each test that applies: without letters or digits one tells nothing.
        apply = 1 + (letters > 0).cast("int") + (c["digits"] > 0).cast("int")
        p_words = bind(half_x, lambda x: F.exp(-x) * (1 + F.when(apply >= 2, x).otherwise(0.0) + F.when(apply >= 3, x * x / 2).otherwise(0.0)))
        # Against random characters; uniformity by the cube-root approximation of chi-squared.
        p_uniform = _normal((1 - e["shape"] - F.pow(F.greatest(c["equal"] * k / n - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3))) / F.sqrt(e["shape"]))

        def turning(half: Column) -> Column:
            ones = F.length(F.replace(half, F.lit("0"), F.lit(""))).cast("double")
            turns = (gone(half, "01") + gone(half, "10")) / 2
            expected = 2 * ones * (n - ones) / n
            return 2 * _normal(-F.abs((turns - expected) / F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))))

        def serial(v: Column) -> Column:
            around = bind(product(v) / n, lambda m: F.transform(v, lambda x: x - m))  # once a run: a run may be a whole file
            return bind(around, lambda d: product(F.transform(d, lambda x, i: x * F.coalesce(F.try_element_at(d, i + 2), F.lit(0.0)))) / F.greatest(product(F.transform(d, lambda x: x * x)), F.lit(1e-9)))

        p_runs = bind(F.call_function("translate", s, e["alphabet"], e["halves"]), turning)
        values = F.transform(F.split(s, ""), lambda c: F.instr(e["alphabet"], c).cast("double"))
        p_serial = 2 * _normal(-F.abs(bind(values, serial)) * F.sqrt(n))
        share = lambda seen, size: F.when(size > 0, (seen - n * size / k) * (seen - n * size / k) / (n * size / k)).otherwise(0.0)
        uneven = share(c["upper"], e["upper"]) + share(c["lower"], e["lower"]) + share(n - letters, e["rest"])
        p_kinds = bind(uneven, lambda u: F.when((e["upper"] > 0) & (e["lower"] > 0) & (e["rest"] > 0), F.exp(-u / 2)).otherwise(2 * _normal(-F.sqrt(u))))
        told = (4 * F.least(p_uniform, p_runs, p_serial, p_kinds)) < ORDER_LEVEL
        tenth = F.least(F.floor(-10 * F.log10(p_words)), F.lit(MOST_BIN)).cast("int")
        made = F.struct(e["name"].alias("encoding"), F.length(F.bin(F.length(s))).alias("length_class"), F.greatest(tenth, F.lit(0)).alias("bin"))
        return F.when(~told, made)

    def encoding(s: Column) -> Column:
        """The smallest alphabet that has all characters, with the numbers that the tests need; null if none has."""
        fits = {"hex": "0-9a-f", "HEX": "0-9A-F", "LETTERS": "A-Z", "letters": "a-z", "base32": "A-Z2-7", "base32lower": "a-z2-7", "BASE36": "0-9A-Z", "base36": "0-9a-z", "Letters": "A-Za-z", "base64": "A-Za-z0-9+/", "base64url": "A-Za-z0-9_-"}
        chosen = F
        for name, characters in fits.items():
            alphabet = ALPHABETS[name]
            k = len(alphabet)
            numbers = {"k": float(k), "collides": COLLIDES[k], "collides2": COLLIDES[k] ** 2, "shape": 2 / (9 * (k - 1)), "upper": sum(x.isupper() for x in alphabet), "lower": sum(x.islower() for x in alphabet), "rest": sum(not x.isalpha() for x in alphabet)}
            words = {"name": name, "alphabet": alphabet, "halves": "0" * (k // 2) + "1" * (k // 2)}
            chosen = chosen.when(s.rlike(f"^[{characters}]+$"), F.struct(*[F.lit(v).alias(n) for n, v in (words | numbers).items()]))
        return chosen

    return bind(F.rtrim(run, F.lit("=")), lambda s: bind(counted(s), lambda c: bind(encoding(s), lambda e: tests(s, c, e))))


def pieces(run: Column) -> Column:
    """The run itself, or, where it mixes characters of base64 and base64url, its pieces of either."""

    def cut(pattern: str) -> Column:
        return F.transform(located(run["s"], pattern), lambda p: F.struct((run["start"] + p["start"]).alias("start"), (run["start"] + p["end"]).alias("end"), p["s"].alias("s")))

    mixed = run["s"].rlike("[+/]") & run["s"].rlike("[_-]")
    return F.when(mixed, F.concat(*map(cut, PIECES))).otherwise(F.array(run))


def scan(rows: DataFrame, text: Column, column: str = "scan") -> DataFrame:
    """The rows with ``struct<base, runs>``: base spans, and the tested runs outside them. Step by step, so that plans stay shallow."""
    made = rows.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__base", base_spans(F.col("__text")))
    made = made.withColumn("__outside", replaced(F.col("__text"), F.col("__base"), lambda fresh, n: F.repeat(F.lit(" "), n)))
    made = made.withColumn("__found", located(F.col("__outside"), RANDOM)).withColumn("__runs", F.flatten(F.transform("__found", pieces)))
    tested = F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), battery(r["s"]).alias("t")))
    return made.withColumn(column, F.struct(F.col("__base").alias("base"), F.filter(tested, lambda r: r["t"].isNotNull()).alias("runs"))).drop("__text", "__base", "__outside", "__found", "__runs")


def thresholds(scanned: DataFrame, column: str = "scan") -> dict[tuple[str, int], int]:
    """By encoding and length class, the least bin that false-discovery control lets through.

    The result has at most eleven encodings times 32 length classes, whatever the corpus.
    """
    from pyspark.sql import Window

    counts = scanned.select(F.explode(F.col(column)["runs"]["t"]).alias("t")).groupBy("t.encoding", "t.length_class", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    stratum = Window.partitionBy("encoding", "length_class")
    found = F.sum("n").over(stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passing = counts.select("encoding", "length_class", "bin", (F.pow(F.lit(10.0), -F.col("bin") / 10) <= Q * found / F.sum("n").over(stratum)).alias("ok"))
    return {(r[0], r[1]): r[2] for r in passing.where("ok").groupBy("encoding", "length_class").agg(F.min("bin")).collect()}


def spans(scanned: Column, limits: dict[tuple[str, int], int]) -> Column:
    """``array<struct<start, k, end>>``: the base spans and the runs that pass, in order."""
    passed = F.lit(False)
    if limits:
        least = F.create_map(*[x for (name, size), b in sorted(limits.items()) for x in (F.lit(f"{name}:{size}"), F.lit(b))])
        stratum = lambda t: F.concat_ws(":", t["encoding"], t["length_class"].cast("string"))
        passed = lambda t: F.coalesce(t["bin"] >= F.try_element_at(least, stratum(t)), F.lit(False))
    runs = F.filter(scanned["runs"], lambda r: passed(r["t"]) if limits else passed)
    added = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("k"), r["end"].alias("end")))
    return F.sort_array(F.concat(scanned["base"], added))


def joined(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    return replaced(text, found, lambda fresh, n: F.when(fresh, F.lit(mask)).otherwise(F.lit("")))
