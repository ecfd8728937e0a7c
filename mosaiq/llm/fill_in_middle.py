"""Fill-in-middle samples: a text's units are cut into prefix, middle and suffix and put in another order.

A unit grammar says between which neighbouring characters one unit ends and the next
begins. It becomes a regular expression of zero width, a look behind and a look ahead at
one character each, so Spark's ``split`` at it loses nothing: the pieces are the units, and
put together they are the text. Splitting empty text gives one empty piece, so such texts
are held apart and have no unit.

Where a text is cut, and its form, follow from a SHA-256 of seed and id alone, so reruns,
retried tasks and other partitionings agree.

Defined results: null text counts as empty, and a null id as an empty one; empty texts, and
those with a control string in them, stay plain. Rows with equal id and text get the same
cuts; rows repeat as they came. Texts of any length are cut whole, in one row. An empty
table stays empty. Other columns stay, unless they have the name of a new one, which takes their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.text import bind

# What marks the parts, and what share of texts (in per cent) gets a form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

ANY = "(?s:.)"


@dataclass(frozen=True)
class UnitGrammar:
    """Pairs of character classes ``(last of a unit, first of the next)`` in the syntax of Java's regular expressions."""

    breaks: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The places between units, as a regular expression of zero width."""
        return "|".join(f"(?<={before})(?={after})" for before, after in self.breaks)


#: Code points; words with the white space after them; lines with their ends; sentences with the space after them;
#: runs of letters, of digits, of white space and of other characters.
CHARACTERS = UnitGrammar(((ANY, ANY),))
WORDS = UnitGrammar(((r"\s", r"\S"),))
LINES = UnitGrammar(((r"\n", ANY),))
SENTENCES = UnitGrammar(((r"[.!?]", r"\s"),))
RUNS = UnitGrammar(tuple((c, f"[^{c[1:-1]}]") for c in (r"[\p{L}\p{M}]", r"[\p{N}]", r"[\s]")) + ((r"[^\p{L}\p{M}\p{N}\s]", r"[\p{L}\p{M}\p{N}\s]"),))


def units(text: Column, grammar: UnitGrammar) -> Column:
    """The units of a text in order; none for empty or null text."""
    return F.when(F.length(text) > 0, F.split(text, grammar.boundary(), -1)).otherwise(F.array().cast("array<string>"))


def _with_draws(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows with four numbers of 32 bits, ``__h1`` to ``__h4``, from seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("__digest", 8 * k + 1, 8), 16, 10).cast("long")
    return docs.withColumn("__digest", digest).withColumns({f"__h{k + 1}": number(k) for k in range(4)})


def transformed(docs: DataFrame, grammar: UnitGrammar, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """The rows with ``n_units``, ``form`` (plain, psm, spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``."""
    h1, h2, h3, h4 = (F.col(f"__h{k}") for k in range(1, 5))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when((whole == "") | marked | (h3 % 100 >= TRANSFORMED), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")

    def parts(pieces: Column) -> Column:
        n = F.size(pieces)
        one, other = (h1 % (n + 1)).cast("int"), (h2 % (n + 1)).cast("int")
        a, b = F.least(one, other), F.greatest(one, other)
        span = lambda start, end: F.array_join(F.slice(pieces, start + 1, end - start), "")
        return F.struct(n.cast("long").alias("n_units"), *[F.when(F.col("__form") != "plain", span(*at)).alias(name) for name, at in (("prefix", (F.lit(0), a)), ("middle", (a, b)), ("suffix", (b, n)))])

    cut = _with_draws(docs, key, seed).withColumn("__form", form).withColumn("__cut", bind(units(whole, grammar), parts))
    p, m, s = (F.col("__cut")[name] for name in ("prefix", "middle", "suffix"))
    psm, spm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(whole)
    made = {"n_units": F.col("__cut.n_units"), "form": F.col("__form"), "prefix": p, "middle": m, "suffix": s, "output": output}
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[c.alias(name) for name, c in made.items()])


def restored(output: Column, form: Column) -> Column:
    """The text of an output, exactly; no part has a control string in it, so the first of each kind is the marker."""
    pieces = F.split(output, MARKER, -1)
    back = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    return F.when(form == "plain", output).otherwise(bind(pieces, back))
