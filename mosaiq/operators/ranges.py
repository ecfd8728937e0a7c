"""Joins of boxes with boxes and with pixels by grids of several cell sizes; no cross join.

A box belongs to the level of its longer side, ``2 ** level`` pixels or less, and meets four
cells of that size at most. Two boxes are compared at the higher of their levels, in the one
cell that holds the upper left corner of what they share, so each pair is found once.
Boxes have columns ``x, y, w, h``, with ``w`` and ``h`` of 1 or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels there can be; the cells of the last are wider than any image.
MOST_LEVELS = 48


def level_of(w: Column, h: Column) -> Column:
    """The least level whose cells are as wide as the box."""
    return F.ceil(F.log2(F.greatest(w, h, F.lit(1)).cast("double"))).cast("int")


def levels_in(boxes: DataFrame) -> list[int]:
    """The levels of a table of boxes: ``MOST_LEVELS`` at most, whatever its size."""
    return sorted(r.level for r in boxes.select(level_of(F.col("w"), F.col("h")).alias("level")).distinct().limit(MOST_LEVELS).collect())


def _span(at: Column, length: Column, level: Column) -> Column:
    """The cells of a level, from the first to the last, that ``length`` pixels from ``at`` on pass."""
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(at / size), F.floor((at + length - 1) / size))


def dealt(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """Boxes with ``own``, their level, once for each cell ``(level, cx, cy)`` of their level and of the given ones above it."""
    own = level_of(F.col("w"), F.col("h"))
    above = F.array_distinct(F.concat(F.array("own"), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v > F.col("own"))))
    each = boxes.withColumn("own", own).withColumn("level", F.explode(above))
    each = each.withColumn("cx", F.explode(_span(F.col("x"), F.col("w"), F.col("level"))))
    return each.withColumn("cy", F.explode(_span(F.col("y"), F.col("h"), F.col("level"))))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes that share a pixel: the columns of both, those of ``a`` as ``a_*`` and those of ``b`` as ``b_*``."""
    named = lambda df, name: df.select(*[F.col(c).alias(c if c in ("level", "cx", "cy") else f"{name}_{c}") for c in df.columns])
    met = named(dealt(a, levels_in(b)), "a").join(named(dealt(b, levels_in(a)), "b"), ["level", "cx", "cy"])
    x, y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    shared = (x < F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w"))) & (y < F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")))
    size = F.pow(F.lit(2.0), F.col("level"))
    once = (F.col("level") == F.greatest("a_own", "b_own")) & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy"))
    return met.where(shared & once).drop("level", "cx", "cy", "a_own", "b_own")


def widened(windows: DataFrame, nodes: DataFrame, key: str = "window") -> DataFrame:
    """``(key, n_nodes, x, y, w, h)``: how many regions' boxes meet each window, and the window widened to hold them whole."""
    pairs = overlapping(windows.select(key, "x", "y", "w", "h"), nodes.select("node", "x", "y", "w", "h"))
    low = lambda c: F.min(F.least(f"a_{c}", f"b_{c}"))
    high = lambda c, size: F.max(F.greatest(F.col(f"a_{c}") + F.col(f"a_{size}"), F.col(f"b_{c}") + F.col(f"b_{size}")))
    hull = pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.count(F.lit(1)).alias("n_nodes"), low("x").alias("x"), low("y").alias("y"), high("x", "w").alias("x1"), high("y", "h").alias("y1"))
    return hull.select(key, "n_nodes", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def pixels_in_windows(pixels: DataFrame, windows: DataFrame, key: str = "window") -> DataFrame:
    """``(key, ...)``: the rows ``pixels(x, y, ...)`` of every window that holds them; a pixel has one cell a level, a window four at most."""
    levels = levels_in(windows)
    if not levels:
        return pixels.withColumn(key, F.lit(None).cast(windows.schema[key].dataType)).where(F.lit(False)).select(key, *pixels.columns)
    size = F.pow(F.lit(2.0), F.col("level"))
    placed = pixels.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    cells = dealt(windows.select(key, F.col("x").alias("wx"), F.col("y").alias("wy"), "x", "y", "w", "h"), []).select(key, "wx", "wy", "w", "h", "level", "cx", "cy")
    inside = F.col("x").between(F.col("wx"), F.col("wx") + F.col("w") - 1) & F.col("y").between(F.col("wy"), F.col("wy") + F.col("h") - 1)
    return placed.join(cells, ["level", "cx", "cy"]).where(inside).select(key, *pixels.columns)
