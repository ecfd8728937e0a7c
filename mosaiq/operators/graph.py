"""Region adjacency graphs as tables.

``nodes(node, x, y, w, h, area, perimeter, mean, std)``; a node's key is its smallest
pixel. ``edges(lo, hi, boundary)``: one row a pair of neighbours, ``lo < hi``, with the
number of shared pixel sides. ``members(pix, node)`` is kept instead of contours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.spatial import neighbours

NODE_COLUMNS = ("node", "x", "y", "w", "h", "area", "perimeter", "mean", "std")


class Graph:
    """The three tables. Membership may be given as a function, which runs when it is first asked for."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, members: DataFrame | Callable[[], DataFrame]):
        self.nodes, self.edges, self._members = nodes, edges, members

    @property
    def members(self) -> DataFrame:
        if not isinstance(self._members, DataFrame):
            self._members = self._members()
        return self._members


def initial_nodes(pixels: DataFrame) -> DataFrame:
    """A node a pixel."""
    zero = F.transform("bands", lambda b: F.lit(0.0))
    one = F.lit(1)
    return pixels.select(F.col("pix").alias("node"), "x", "y", one.alias("w"), one.alias("h"), F.lit(1).cast("long").alias("area"), F.lit(4).cast("long").alias("perimeter"), F.col("bands").alias("mean"), zero.alias("std"))


def adjacent_pixels(pixels: DataFrame, width: int, height: int, more: list[str] | None = None) -> DataFrame:
    """``(lo, hi)`` of 4-neighbouring pixels that are both there; ``more`` columns come from both, prefixed lo_ and hi_.

    Each pixel looks right and down only, so each pair is made once.
    """
    more = more or []
    ahead = F.slice(neighbours(F.col("pix"), width, height), 2, 2)
    lo = pixels.select(F.col("pix").alias("lo"), *[F.col(c).alias(f"lo_{c}") for c in more], F.explode(F.filter(ahead, lambda n: n >= 0)).alias("hi"))
    if not more:
        return lo.join(pixels.select(F.col("pix").alias("hi")), "hi", "left_semi").select("lo", "hi")
    return lo.join(pixels.select(F.col("pix").alias("hi"), *[F.col(c).alias(f"hi_{c}") for c in more]), "hi").select("lo", "hi", *[f"lo_{c}" for c in more], *[f"hi_{c}" for c in more])


def initial_edges(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return adjacent_pixels(pixels, width, height).select("lo", "hi", F.lit(1).cast("long").alias("boundary"))


def initial_graph(pixels: DataFrame, width: int, height: int) -> Graph:
    """A node a pixel, an edge a side; no-data pixels must have been filtered out."""
    return Graph(initial_nodes(pixels), initial_edges(pixels, width, height), pixels.select("pix", F.col("pix").alias("node")))


def both_ways(edges: DataFrame) -> DataFrame:
    """The symmetric form ``(src, dst, boundary)``."""
    one = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "boundary")
    return one.unionByName(edges.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "boundary"))


def region_nodes(members: DataFrame, pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of any membership, from the pixels themselves: ``edges`` are the pixel pairs (lo, hi)."""
    rows = members.join(pixels, "pix")
    each = rows.select("node", "pix", "x", "y", F.posexplode("bands").alias("band", "value"))
    bands = each.groupBy("node", "band").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    stats = bands.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "m", "s"))).alias("b"))
    shape = rows.groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count(F.lit(1)).alias("area"))
    a, b = members.select(F.col("pix").alias("lo"), F.col("node").alias("na")), members.select(F.col("pix").alias("hi"), F.col("node").alias("nb"))
    inner = edges.join(a, "lo").join(b, "hi").where("na = nb").groupBy(F.col("na").alias("node")).agg(F.count(F.lit(1)).alias("inside"))
    out = shape.join(stats, "node").join(inner, "node", "left")
    return out.select("node", "x", "y", "w", "h", "area", (4 * F.col("area") - 2 * F.coalesce("inside", F.lit(0))).alias("perimeter"), F.col("b.m").alias("mean"), F.col("b.s").alias("std"))


def region_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between regions, with the number of pixel sides that they share."""
    a, b = members.select(F.col("pix").alias("lo"), F.col("node").alias("na")), members.select(F.col("pix").alias("hi"), F.col("node").alias("nb"))
    met = edges.select("lo", "hi").join(a, "lo").join(b, "hi").where("na != nb")
    return met.groupBy(F.least("na", "nb").alias("lo"), F.greatest("na", "nb").alias("hi")).agg(F.count(F.lit(1)).alias("boundary"))


def region_graph(members: DataFrame, pixels: DataFrame, width: int, height: int) -> Graph:
    """The graph of any membership of pixels in regions."""
    pairs = adjacent_pixels(pixels, width, height)
    return Graph(region_nodes(members, pixels, pairs), region_edges(members, pairs), members)


def remove_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without the nodes of ``gone(node)`` and all their edges."""
    keep = lambda key: gone.select(F.col("node").alias(key))
    edges = graph.edges.join(keep("lo"), "lo", "left_anti").join(keep("hi"), "hi", "left_anti")
    return Graph(graph.nodes.join(keep("node"), "node", "left_anti"), edges.select("lo", "hi", "boundary"), graph.members.join(keep("node"), "node", "left_anti"))


def induced(graph: Graph, kept: DataFrame) -> Graph:
    """The subgraph of the nodes of ``kept(node)``; edges that leave it are dropped."""
    keep = lambda key: kept.select(F.col("node").alias(key))
    edges = graph.edges.join(keep("lo"), "lo", "left_semi").join(keep("hi"), "hi", "left_semi")
    return Graph(graph.nodes.join(keep("node"), "node", "left_semi"), edges.select("lo", "hi", "boundary"), graph.members.join(keep("node"), "node", "left_semi"))


def append(a: Graph, b: Graph) -> Graph:
    """Both graphs side by side; node keys stay as they are."""
    return Graph(a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges), a.members.unionByName(b.members))


def for_each_node(graph: Graph, **columns: Column) -> Graph:
    """The graph with node columns added or replaced."""
    return Graph(graph.nodes.withColumns(columns), graph.edges, lambda: graph.members)


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``(node, id)``: ids from 0 in the order of keys, for consumers that need them."""
    from mosaiq.plans.ranking import exclusive_prefix

    most = nodes.agg(F.max("node")).first()[0] or 0
    placed = nodes.select("node", F.lit(0).alias("all"), (F.col("node") / F.lit(float(most + 1))).alias("u"))
    return exclusive_prefix(placed, "all", "u", ["node"], F.lit(1), "id", grid=1 << 16).select("node", "id")


def memory_estimate(graph: Graph, n_bands: int) -> DataFrame:
    """One row ``(n_nodes, n_edges, bytes)``: what the tables' rows take in memory, roughly."""
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = graph.edges.agg((2 * F.count(F.lit(1))).alias("n_edges"))
    size = F.col("n_nodes") * (64 + 16 * n_bands) + F.col("n_edges") * 24
    return nodes.select("n_nodes", F.lit(0).alias("k")).join(edges.withColumn("k", F.lit(0)), "k").select("n_nodes", "n_edges", size.alias("bytes"))


def violations(graph: Graph) -> DataFrame:
    """``(rule, n)`` of broken invariants: order of edges, repeats, ends that aren't nodes, area, key, box."""
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"))
    nodes, edges = graph.nodes, graph.edges
    ends = edges.select(F.col("lo").alias("node")).union(edges.select("hi"))
    counted = graph.members.groupBy("node").agg(F.count(F.lit(1)).alias("pixels"), F.min("pix").alias("first"))
    found = [
        rule("edge order", edges.where("lo >= hi")),
        rule("repeated edge", edges.groupBy("lo", "hi").count().where("count > 1")),
        rule("dangling edge", ends.join(nodes, "node", "left_anti")),
        rule("repeated node", nodes.groupBy("node").count().where("count > 1")),
        rule("area", nodes.join(counted, "node", "left").where("pixels is null or pixels != area")),
        rule("key", nodes.join(counted, "node").where("first != node")),
        rule("boundary over perimeter", both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("boundary").alias("b")).join(nodes, "node").where("b > perimeter")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("n > 0")
