"""Prefix sums and gapless ranks inside groups of any size.

A plain window over a group puts the whole group in one task. Here each group is
cut into ``GRID`` ranges of a uniform order key; range totals are summed first
(one small row per range), and the window only spans one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 4096


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


def exclusive_prefix(df: DataFrame, group: str, order: str, ties: list[str], weight: Column, out: str, grid: int = GRID) -> DataFrame:
    """Add ``out``: the weights of all rows before this one in its group.

    ``group`` must not be null; ``order`` is a double in [0, 1), spread evenly;
    ``ties`` settle equal keys. Weight 1 gives gapless ranks from 0.
    """
    df = df.withColumn("__range", F.least(F.floor(F.col(order) * grid), F.lit(grid - 1)).cast("int")).withColumn("__w", weight.cast("long"))
    totals = df.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("__g", "__r", (F.sum("__t").over(before) - F.col("__t")).alias("__offset"))
    inside = Window.partitionBy(group, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn(out, F.col("__offset") + F.sum("__w").over(inside) - F.col("__w")).drop("__range", "__w", "__g", "__r", "__offset")
