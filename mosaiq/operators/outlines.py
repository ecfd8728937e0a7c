"""Outlines of any length: sides are put together to straight runs, and runs are ranked along their outline.

Runs are found by a window over one pixel row or column of one outline. Their order along the
outline comes from pointer doubling (list ranking): every run knows the run a power of two ahead,
so an outline of n runs takes log2(n) joins on unique keys, spread over all tasks. No row or task
holds an outline before its runs are in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.plans.lineage import Rounds

SIDE = ("x0", "y0", "x1", "y1")


def straight_runs(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, x0, y0, x1, y1, stops)``: sides that go on in one direction along a row or column, as one.

    A run begins anew at a side that ``stops`` (no line goes on across its first corner). Slanted sides stay as they are.
    """
    x0, y0, x1, y1 = (F.col(c) for c in SIDE)
    level, upright = y0 == y1, x0 == x1
    way = F.when(level, F.signum(x1 - x0)).when(upright, 2 * F.signum(y1 - y0)).otherwise(0).cast("int")
    place = F.when(level, y0.cast("long")).when(upright, x0.cast("long")).otherwise(F.xxhash64(x0, y0, x1, y1))
    along = F.when(level, x0 * F.signum(x1 - x0)).otherwise(y0 * F.signum(y1 - y0))
    placed = sides.select(*keys, *SIDE, "stops", way.alias("way"), place.alias("place"), along.alias("along"))
    line = Window.partitionBy(*keys, "way", "place").orderBy("along")
    goes_on = (F.lag("x1").over(line) == x0) & (F.lag("y1").over(line) == y0) & ~F.col("stops") & (F.col("way") != 0)
    marked = placed.withColumn("begins", F.coalesce((~goes_on).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("begins").over(line)).groupBy(*keys, "way", "place", "run")
    first, last = (lambda c: F.min_by(c, "along").alias(c)), (lambda c: F.max_by(c, "along").alias(c))
    return runs.agg(first("x0"), first("y0"), last("x1"), last("y1"), first("stops")).select(*keys, *SIDE, "stops")


def run_id(keys: list[str]) -> Column:
    """A run's key, in the order of its outline and then of its first corner, by rows."""
    return F.struct(*keys, "y0", "x0", "y1", "x1")


def ranked(links: DataFrame) -> DataFrame:
    """``(id, chain, left)`` from ``links(id, next)``, where no two ids have the same ``next``; null ends a list.

    ``chain`` is the last id of a list, or the least of a ring; ``left`` counts the steps to it, so that within a
    chain the order is that of falling ``left``, and a ring begins at its least id (a whole turn from itself).
    Each round a row takes over what the row that it points to has seen: ``least`` id and how far it is. The same
    least id in both halves of a way means that the way has gone round.
    """
    rounds = Rounds(links.sparkSession)
    is_last, one = F.col("next").isNull(), F.lit(1).cast("long")
    start = links.select("id", F.col("next").alias("jump"), one.alias("span"), F.col("next").alias("least"), one.alias("far"), F.when(is_last, F.col("id")).alias("chain"), F.when(is_last, F.lit(0).cast("long")).alias("left"))
    state = rounds.cut(start)[0]
    while not state.where("chain is null").isEmpty():
        there = state.select(F.col("id").alias("jump"), *[F.col(c).alias(f"{c}_there") for c in ("jump", "span", "least", "far", "chain", "left")])
        met = state.where("chain is null").join(there, "jump")
        known, round_it = F.col("chain_there").isNotNull(), F.col("least") == F.col("least_there")
        seen = F.when(known & (F.col("least") == F.col("chain_there")), F.col("far")).when(known, F.col("span") + F.col("left_there")).when(round_it, F.col("far"))
        ahead = met.select(
            "id",
            F.col("jump_there").alias("jump"),
            (F.col("span") + F.col("span_there")).alias("span"),
            F.least("least", "least_there").alias("least"),
            F.when(F.col("least_there") < F.col("least"), F.col("span") + F.col("far_there")).otherwise(F.col("far")).alias("far"),
            F.coalesce("chain_there", F.when(round_it, F.col("least"))).alias("chain"),
            seen.alias("left"),
        )
        state = rounds.cut(state.where("chain is not null").unionByName(ahead))[0]
    return state.select("id", "chain", "left")


def in_order(runs: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, chain, runs)``: the runs of each list or ring, in order, as an array; ``links`` hold their ``run_id``."""
    placed = runs.withColumn("id", run_id(keys)).join(ranked(links), "id")
    step = F.struct((-F.col("left")).alias("at"), *SIDE)
    return placed.groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(step)).alias("runs"))
