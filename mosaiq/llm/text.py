"""Word expressions that several operators share. White space is U+0020 and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


#: Values in a part of a running total; code points in a part of a text that is cut up.
PART, PORTION = 256, 512


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals (or maxima and the like) of an array, without copying what is done at each step.

    Totals are first made inside parts of ``PART`` values, then over the parts, so the work is about
    ``PART`` times the length, and only over many thousands of parts more.
    """
    both = lambda total, x: F.coalesce(merge(total, x), x)

    def totals(part: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(both(F.try_element_at(done, F.lit(-1)), x)))
        return F.aggregate(part, F.from_json(F.lit("[]"), "array<long>"), step)

    def over(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda c: totals(F.slice(v, c * PART + 1, F.lit(PART))))
        whole = lambda done: bind(totals(F.transform(done, lambda part: F.element_at(part, F.lit(-1)))), lambda before: shifted(done, before))
        shifted = lambda done, before: F.flatten(F.transform(done, lambda part, c: F.when(c > 0, F.transform(part, lambda x: both(F.element_at(before, F.greatest(c, F.lit(1))), x))).otherwise(part)))
        return F.when(F.size(v) <= PART, totals(v)).otherwise(bind(parts, whole))

    return bind(F.transform(values, lambda x: x.cast("long")), over)


def portions(text: Column) -> Column:
    """A text in parts of ``PORTION`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PORTION}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text given in parts; the text before them is not walked through."""
    first, last = F.floor(start / PORTION).cast("int"), F.floor((end - 1) / PORTION).cast("int")
    part = lambda k: F.element_at(parts, k + 1)
    at = (start - first * PORTION + 1).cast("int")
    across = F.concat(F.substring(part(first), at, F.lit(PORTION)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(part(last), F.lit(1), (end - last * PORTION).cast("int")))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(part(first), at, (end - start).cast("int"))).otherwise(across)
