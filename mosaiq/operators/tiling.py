"""Graphs cut into tiles, margins around them, and their stitching.

A tile's graph is a graph whose keys carry the tile: structs ``(tile_id, node)``. One
DataFrame then holds the graphs of all tiles, and every operator of this package works
on it as it is, tile by tile, without tasks that hold a tile each.

Pixels are dealt to tiles by arithmetic (the tile's column and row, and those whose
margins reach the pixel), so no range join is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.spatial import EIGHT, at_tile_border, box, box_outside, box_strictly_inside, in_tile, neighbours, x_of, y_of
from mosaiq.operators.graph import Graph, append, both_ways, initial_graph
from mosaiq.operators.merge import MergeCriterion, iterate
from mosaiq.plans.lineage import Rounds
from mosaiq.plans.tile_plan import merging_margin

@dataclass(frozen=True)
class Layout:
    """An image and its grid of tiles."""

    width: int
    height: int
    tile_width: int
    tile_height: int

    @property
    def columns(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_height)

    def frame(self, tile_id: Column) -> dict[str, Column]:
        """``x0, y0, w, h`` of a tile."""
        x0, y0 = tile_id % self.columns * self.tile_width, F.floor(tile_id / self.columns) * self.tile_height
        return {"x0": x0, "y0": y0, "w": F.least(F.lit(self.tile_width), self.width - x0), "h": F.least(F.lit(self.tile_height), self.height - y0)}

    def tile_of(self, x: Column, y: Column) -> Column:
        return (F.floor(y / self.tile_height) * self.columns + F.floor(x / self.tile_width)).cast("int")

    def tiles_of(self, x: Column, y: Column, margin: int) -> Column:
        """Array of all tiles whose frame, widened by the margin, holds the pixel."""
        span = lambda at, size, count: F.sequence(F.greatest(F.floor((at - margin) / size), F.lit(0)), F.least(F.floor((at + margin) / size), F.lit(count - 1)))
        columns, rows = span(x, self.tile_width, self.columns), span(y, self.tile_height, self.rows)
        return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: (r * self.columns + c).cast("int"))))


def tile_pixels(pixels: DataFrame, layout: Layout, margin: int = 0) -> DataFrame:
    """``pixels`` once for each tile that reads them, with ``tile_id``."""
    return pixels.withColumn("tile_id", F.explode(layout.tiles_of(F.col("x"), F.col("y"), margin)))


def node_tiles(members: DataFrame, layout: Layout) -> DataFrame:
    """``(tile_id, node)``: every tile in which a node has a pixel."""
    x, y = x_of(F.col("pix"), layout.width), y_of(F.col("pix"), layout.width)
    return members.select(layout.tile_of(x, y).alias("tile_id"), "node").distinct()


def border_nodes(graph: Graph, layout: Layout) -> DataFrame:
    """``(tile_id, node)`` of nodes with a pixel on a side of the tile that isn't a side of the image."""
    x, y = x_of(F.col("pix"), layout.width), y_of(F.col("pix"), layout.width)
    placed = graph.members.select("node", x.alias("x"), y.alias("y"), layout.tile_of(x, y).alias("tile_id"))
    return placed.where(at_tile_border(F.col("x"), F.col("y"), layout.frame(F.col("tile_id")), layout.width, layout.height)).select("tile_id", "node").distinct()


def unstable_nodes(tiled: Graph, layout: Layout) -> DataFrame:
    """Keys of a tiled graph's nodes that have no pixel in their own tile: the box decides first, then the pixels."""
    tile = F.col("node.tile_id")
    frame = layout.frame(tile)
    outside = box_outside(box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), frame["x0"], frame["y0"], frame["x0"] + frame["w"] - 1, frame["y0"] + frame["h"] - 1)
    suspects = tiled.nodes.where(outside).select("node")
    pix = F.col("pix.node")
    within = tiled.members.where(in_tile(x_of(pix, layout.width), y_of(pix, layout.width), layout.frame(F.col("pix.tile_id")))).select("node").distinct()
    return suspects.union(tiled.nodes.where(~outside).select("node").join(within, "node", "left_anti")).distinct()


def _keyed(graph: Graph, tiles_of_node: DataFrame) -> Graph:
    """The graph of every tile in one: each tile's nodes, the edges inside it, and its members, keyed by tile."""
    key = lambda c: F.struct("tile_id", F.col(c).alias("node")).alias(c)
    nodes = graph.nodes.join(tiles_of_node, "node").select(key("node"), *[c for c in graph.nodes.columns if c != "node"])
    lo, hi = tiles_of_node.select("tile_id", F.col("node").alias("lo")), tiles_of_node.select(F.col("tile_id").alias("t2"), F.col("node").alias("hi"))
    edges = graph.edges.join(lo, "lo").join(hi.withColumnRenamed("t2", "tile_id"), ["tile_id", "hi"]).select(key("lo"), key("hi"), "boundary")
    return Graph(nodes, edges, graph.members.join(tiles_of_node, "node").select(key("pix"), key("node")))


def tiled_graph(pixels: DataFrame, layout: Layout, margin: int, own: dict[str, Column] | None = None) -> Graph:
    """The initial graphs of all padded tiles, one node a pixel and tile; ``own`` has further node columns, made of those of a pixel's node."""
    plain = initial_graph(pixels, layout.width, layout.height)
    plain = Graph(plain.nodes.withColumns(own or {}), plain.edges, plain.members)
    dealt = tile_pixels(pixels, layout, margin).select("tile_id", F.col("pix").alias("node"))
    return _keyed(plain, dealt)


def split_graph(graph: Graph, layout: Layout) -> Graph:
    """A graph cut into tiles: each tile keeps the nodes with a pixel in it; keys carry the tile."""
    return _keyed(graph, node_tiles(graph.members, layout))


def unkeyed(tiled: Graph) -> Graph:
    """The tiled graph with keys of the image again; nodes that several tiles hold are there several times."""
    plain = lambda c: F.col(f"{c}.node").alias(c)
    return Graph(tiled.nodes.select(plain("node"), *[c for c in tiled.nodes.columns if c != "node"]), tiled.edges.select(plain("lo"), plain("hi"), "boundary"), tiled.members.select(plain("pix"), plain("node")))


def without_copies(graph: Graph) -> Graph:
    """Copies of nodes, edges and memberships from several tiles become one; boundaries are copied, not summed."""
    edges = graph.edges.groupBy("lo", "hi").agg(F.max("boundary").alias("boundary"))
    return Graph(graph.nodes.dropDuplicates(["node"]), edges, graph.members.distinct())


def border_map(members: DataFrame, layout: Layout) -> DataFrame:
    """``(pix, nodes)`` for pixels on, or next to, tile sides inside the image; nodes in ascending order."""
    x, y = x_of(F.col("pix"), layout.width), y_of(F.col("pix"), layout.width)
    near = lambda at, size, length: ((at % size == 0) & (at > 0)) | ((at % size == size - 1) & (at < length - 1))
    beside = near(x, layout.tile_width, layout.width) | near(y, layout.tile_height, layout.height)
    return members.where(beside).groupBy("pix").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def contacts(members: DataFrame, layout: Layout) -> DataFrame:
    """``(lo, hi, boundary)`` of different nodes with neighbouring pixels across or beside tile sides."""
    near = border_map(members, layout).select("pix", F.explode("nodes").alias("node"))
    ahead = near.select("node", F.explode(F.filter(F.slice(neighbours(F.col("pix"), layout.width, layout.height), 2, 2), lambda n: n >= 0)).alias("n"))
    met = ahead.join(near.select(F.col("pix").alias("n"), F.col("node").alias("other")), "n").where("node != other")
    return met.groupBy(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi")).agg(F.count(F.lit(1)).alias("boundary"))


def stitched(tiled: Graph, layout: Layout) -> Graph:
    """One graph from those of all tiles: copies removed, edges added between nodes that only touch across tiles."""
    once = without_copies(unkeyed(tiled))
    fresh = contacts(once.members, layout).join(once.edges.select("lo", "hi"), ["lo", "hi"], "left_anti")
    return Graph(once.nodes, once.edges.unionByName(fresh), once.members)


def within_hops(graph: Graph, seeds: DataFrame, hops: int) -> DataFrame:
    """``(tile_id, node, depth)``: nodes at most ``hops`` edges from a tile's seeds ``(tile_id, node)``, with the least depth."""
    rounds = Rounds(graph.nodes.sparkSession)
    edges = both_ways(graph.edges).select(F.col("src").alias("node"), F.col("dst").alias("next"))
    found = seeds.select("tile_id", "node", F.lit(0).alias("depth")).distinct()
    for depth in range(1, hops + 1):
        found = rounds.cut(found)[0]
        fresh = found.where(F.col("depth") == depth - 1).join(edges, "node").select("tile_id", F.col("next").alias("node")).distinct()
        fresh = fresh.join(found.select("tile_id", "node"), ["tile_id", "node"], "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(fresh)
    return found


def stability_margin(graph: Graph, layout: Layout, hops: int) -> DataFrame:
    """``(tile_id, node, depth)``: what other tiles must know of each tile: nodes near its inner sides."""
    return within_hops(graph, border_nodes(graph, layout), hops)


def margins_for(graph: Graph, layout: Layout, hops: int) -> DataFrame:
    """``(tile_id, node)``: each tile's own nodes and those that the eight tiles around it hand over."""
    own = node_tiles(graph.members, layout)
    near = stability_margin(graph, layout, hops).select("tile_id", "node")
    columns, rows = layout.columns, layout.rows
    around = F.filter(neighbours(F.col("tile_id").cast("long"), columns, rows, EIGHT), lambda t: t >= 0).cast("array<int>")
    return own.unionByName(near.select(F.explode(around).alias("tile_id"), "node")).distinct()


def small_region_margin(graph: Graph, layout: Layout, most_area: int) -> DataFrame:
    """``(tile_id, node, area)``: nodes reached from a tile's border nodes while the areas on the way add up to ``most_area`` at most."""
    rounds = Rounds(graph.nodes.sparkSession)
    areas = graph.nodes.select("node", "area")
    edges = both_ways(graph.edges).select(F.col("src").alias("node"), F.col("dst").alias("next")).join(areas.select(F.col("node").alias("next"), F.col("area").alias("more")), "next")
    found = border_nodes(graph, layout).join(areas, "node").select("tile_id", "node", "area")
    for _ in range(most_area):
        before = rounds.cut(found)[0]
        step = before.join(edges, "node").select("tile_id", F.col("next").alias("node"), (F.col("area") + F.col("more")).alias("area")).where(F.col("area") <= most_area)
        found = rounds.cut(before.unionByName(step).groupBy("tile_id", "node").agg(F.min("area").alias("area")))[0]
        if found.exceptAll(before).isEmpty():
            break
    return found


def tile_sums(tiled: Graph) -> DataFrame:
    """``(tile_id, n_nodes, n_edges)``: what each tile holds."""
    nodes = tiled.nodes.groupBy(F.col("node.tile_id").alias("tile_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = tiled.edges.groupBy(F.col("lo.tile_id").alias("tile_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(edges, "tile_id", "left").select("tile_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def without_unstable(tiled: Graph, layout: Layout) -> Graph:
    from mosaiq.operators.graph import remove_nodes

    return remove_nodes(tiled, unstable_nodes(tiled, layout))


@dataclass
class Tiled:
    """Graphs of all tiles after merging, the rounds run, and whether no tile merged any more."""

    graph: Graph
    rounds: int
    over: bool


def first_partial(pixels: DataFrame, layout: Layout, criterion: MergeCriterion, rounds: int, own: dict[str, Column] | None = None) -> Tiled:
    """Each padded tile merged by itself for so many rounds; nodes outside their tile are dropped."""
    done = iterate(tiled_graph(pixels, layout, merging_margin(rounds), own), criterion, rounds)
    return Tiled(without_unstable(done.graph, layout), done.rounds, done.over)


def next_partial(tiled: Tiled, layout: Layout, criterion: MergeCriterion, rounds: int) -> Tiled:
    """A further batch: margins are exchanged with the tiles around, each tile merges by itself, unstable nodes go."""
    whole = stitched(tiled.graph, layout)
    nodes, edges, members = Rounds(whole.nodes.sparkSession).cut(whole.nodes, whole.edges, whole.members)
    whole = Graph(nodes, edges, members)
    own = _keyed(whole, margins_for(whole, layout, merging_margin(rounds)))
    done = iterate(own, criterion, rounds)
    return Tiled(without_unstable(done.graph, layout), tiled.rounds + done.rounds, done.over)


def partial_segmentation(pixels: DataFrame, layout: Layout, criterion: MergeCriterion, first: int, then: int, most: int, least_decrease: float = 0.0, own: dict[str, Column] | None = None) -> Tiled:
    """Batches of rounds until ``most`` of them, until nothing merges, or until the nodes fall by less than ``least_decrease`` percent.

    ``own`` has the first values of the criterion's own columns, which go along with nodes from tile to tile.
    """
    state = first_partial(pixels, layout, criterion, min(first, most), own)
    count = lambda s: s.graph.nodes.select("node.node").distinct().count()
    before = count(state) if least_decrease else 0
    while not state.over and state.rounds < most:
        state = next_partial(state, layout, criterion, min(then, most - state.rounds))
        if least_decrease:
            now = count(state)
            if (before - now) * 100.0 < least_decrease * before:
                break
            before = now
    return state


