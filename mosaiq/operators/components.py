"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations (``min``, so partial sums shrink hubs before the
shuffle) and two equi-joins; the number of rounds grows with the logarithm of the
component size, not with its diameter.

A hub's edges would all meet its minimum in one task. Once there are more than
``PLENTY`` edges, vertices with more than one in ``HUBS`` of all ends are hubs: there
are at most ``HUBS`` of them, whatever the size of the table, so their minima are sent
to every task and their edges stay where they are.

Components of a raster come in two levels, inside tiles and then across their sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.lineage import Rounds, materialize

#: Edges up to which a task may get all of a vertex; hubs at most, beyond.
PLENTY, HUBS = 1_000_000, 2_000


def _with_least(ends: DataFrame, least: DataFrame, n_ends: int) -> DataFrame:
    """``ends(u, v)`` with ``m`` of ``least(u, m, n)``, hubs apart from the other vertices."""
    if n_ends <= PLENTY:
        return ends.join(least.select("u", "m"), "u")
    is_hub = F.col("n") > n_ends / HUBS
    hubs = F.broadcast(least.where(is_hub).select("u", "m"))
    return ends.join(hubs, "u").unionByName(ends.join(hubs.select("u"), "u", "left_anti").join(least.where(~is_hub).select("u", "m"), "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another; component is the smallest node.

    Direction, repeats, self edges and null ends of the edges don't matter. An
    empty edge table gives an empty result.
    """
    pair = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    rounds = Rounds(edges.sparkSession)
    stars, mark = rounds.cut(pair.where(pair[2]).select("u", "v").distinct())[0], None
    n_edges = stars.count()
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, least, 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, n_edges).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = rounds.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())[0]
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, n_edges = seen, seen[0]
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Side of the tiles inside which components are found first; a task holds one at a time.
TILE = 256


def joined_inside(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` numbers hangs together with, by the pairs ``a, b``."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (further := root[root]) is not root and (further != root).any():
            root = further


def grid_components(pixels: DataFrame, width: int, height: int, values: list[str], linked: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], linked_columns: Callable[[str, str], Column]) -> DataFrame:
    """``(pix, node)``: components of linked 4-neighbours, keyed by their smallest pixel, in two levels.

    Components inside tiles are found first, each tile in one task. Then only pixel pairs across tile sides
    are left: the stars run over pairs of tile components, so their edges go with tile sides and not with
    pixels, and one join brings the result back. ``linked`` tells which rows of two frames with the columns
    ``values`` are linked, ``linked_columns`` the same for columns with the prefixes ``lo_`` and ``hi_``.
    """
    size = TILE
    columns = -(-width // size)
    x, y = F.col("pix") % width, F.floor(F.col("pix") / width)
    tile = (F.floor(y / size) * columns + F.floor(x / size)).cast("long")

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pix", ignore_index=True)
        pix = part["pix"].to_numpy()
        pairs = []
        column = pix % width
        for step, ahead in ((1, (column % size < size - 1) & (column < width - 1)), (width, np.ones(len(pix), bool))):
            at = np.searchsorted(pix, pix + step)
            here = np.flatnonzero(ahead & (at < len(pix)) & (pix[np.minimum(at, len(pix) - 1)] == pix + step))
            pairs.append((here, at[here]))
        a, b = (np.concatenate(side) for side in zip(*pairs))
        near = linked(part.iloc[a].reset_index(drop=True), part.iloc[b].reset_index(drop=True)) if len(a) else np.zeros(0, bool)
        return pd.DataFrame({"pix": pix, "part": pix[joined_inside(len(pix), a[near], b[near])]})

    parts = materialize(pixels.select(tile.alias("tile"), "pix", *values).groupBy("tile").applyInPandas(inside, "pix long, part long"))
    side = (x % size == 0) | (x % size == size - 1) | (y % size == 0) | (y % size == size - 1)
    beside = materialize(pixels.select("pix", *values).where(side).join(parts.where(side), "pix"))
    across = F.array_compact(F.array(F.when((x % size == size - 1) & (x < width - 1), F.col("pix") + 1), F.when((y % size == size - 1) & (y < height - 1), F.col("pix") + width)))
    low = beside.select(*[F.col(c).alias(f"lo_{c}") for c in ("part", *values)], F.explode(across).alias("hi"))
    met = low.join(beside.select(F.col("pix").alias("hi"), *[F.col(c).alias(f"hi_{c}") for c in ("part", *values)]), "hi")
    found = connected_components(met.where(linked_columns("lo_", "hi_")), "lo_part", "hi_part").select(F.col("node").alias("part"), "component")
    return parts.join(found, "part", "left").select("pix", F.coalesce("component", "part").alias("node"))


def label_components(labels: DataFrame, width: int, height: int) -> DataFrame:
    """4-connected components of equal labels: ``labels(pix, label)`` to ``(pix, node)``; null labels are no-data."""
    same = lambda a, b: (a["label"] == b["label"]).to_numpy()
    return grid_components(labels.where("label is not null").select("pix", "label"), width, height, ["label"], same, lambda a, b: F.col(f"{a}label") == F.col(f"{b}label"))


def same_label_neighbour(labels: DataFrame, width: int, height: int) -> DataFrame:
    """``(pix, neighbour)``: the lowest 4-neighbour with the same label, where there is one."""
    from mosaiq.operators.graph import adjacent_pixels

    pairs = adjacent_pixels(labels.where("label is not null"), width, height, ["label"]).where("lo_label = hi_label")
    both = pairs.select(F.col("lo").alias("pix"), F.col("hi").alias("n")).union(pairs.select("hi", "lo"))
    return both.groupBy("pix").agg(F.min("n").alias("neighbour"))


def threshold_components(pixels: DataFrame, width: int, height: int, most: float) -> DataFrame:
    """Components of 4-neighbours whose bands are less than ``most`` apart (Euclidean)."""

    def near(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        one, other = np.stack(a["bands"].to_numpy()), np.stack(b["bands"].to_numpy())
        total = np.zeros(len(one))
        for k in range(one.shape[1]):  # in the order of the columns' sum
            total += (one[:, k] - other[:, k]) ** 2
        return np.sqrt(total) < most

    def near_columns(a: str, b: str) -> Column:
        squares = F.zip_with(f"{a}bands", f"{b}bands", lambda u, v: (u - v) * (u - v))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d)) < most

    return grid_components(pixels.select("pix", "bands"), width, height, ["bands"], near, near_columns)
