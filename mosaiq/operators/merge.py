"""Region merging: costs, best neighbours, disjoint pairs, contraction, until nothing merges.

One round is a pure function of ``(nodes, edges)``, since the pairs are chosen before
any merge and don't overlap. The criterion is made of columns: what an edge costs, who
may merge, how the survivor's attributes follow. Costs stay on the edges and are only
recomputed where an end has just merged; the membership of pixels is not rewritten
round by round but resolved once from the log of merges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.spatial import box, merged_box
from mosaiq.operators import components
from mosaiq.operators.components import connected_components
from mosaiq.operators.graph import NODE_COLUMNS, Graph
from mosaiq.plans.lineage import Rounds

Side = dict[str, Column]


def side(name: str, columns=NODE_COLUMNS) -> Side:
    """The columns of one end of an edge, named ``<name>_<column>``."""
    return {c: F.col(f"{name}_{c}") for c in columns}


def edge_columns() -> tuple[Side, Side, Column]:
    """What a criterion's functions take: both ends of an edge, and its boundary."""
    return side("a"), side("b"), F.col("boundary")


def with_ends(edges: DataFrame, nodes: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Edges with the attributes of both ends, as ``a_*`` (lower) and ``b_*``."""
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns])
    return edges.join(a, F.col(lo) == F.col("a_node")).join(b, F.col(hi) == F.col("b_node"))


def pooled_mean(a: Side, b: Side) -> Column:
    return F.zip_with(a["mean"], b["mean"], lambda x, y: (x * a["area"] + y * b["area"]) / (a["area"] + b["area"]))


def _quad(a: Side, b: Side) -> Column:
    """Per band: means and deviations of both ends."""
    return F.arrays_zip(a["mean"].alias("ma"), b["mean"].alias("mb"), a["std"].alias("sa"), b["std"].alias("sb"))


def pooled_std(a: Side, b: Side) -> Column:
    area_a, area_b = a["area"], b["area"]

    def one(q: Column) -> Column:
        m = (q["ma"] * area_a + q["mb"] * area_b) / (area_a + area_b)
        spread = area_a * q["sa"] * q["sa"] + area_b * q["sb"] * q["sb"] + area_a * (q["ma"] - m) * (q["ma"] - m) + area_b * (q["mb"] - m) * (q["mb"] - m)
        return F.sqrt(spread / (area_a + area_b))

    return F.transform(_quad(a, b), one)


def spectral_distance(a: Side, b: Side) -> Column:
    """Squared distance of the band means."""
    return F.aggregate(F.zip_with(a["mean"], b["mean"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def baatz_cost(threshold: float, spectral_weight: float = 0.5, shape_weight: float = 0.5, band_weights: list[float] | None = None) -> Callable[[Side, Side, Column], Column]:
    """Baatz and Schaepe: growth of spectral heterogeneity, and of smoothness and compactness if the first is below the threshold."""

    def cost(a: Side, b: Side, boundary: Column) -> Column:
        area_a, area_b = a["area"].cast("double"), b["area"].cast("double")
        area = area_a + area_b
        bands = F.zip_with(pooled_std(a, b), F.arrays_zip(a["std"].alias("sa"), b["std"].alias("sb")), lambda s, q: area * s - (area_a * q["sa"] + area_b * q["sb"]))
        if band_weights is not None:
            bands = F.zip_with(bands, F.array(*[F.lit(float(w)) for w in band_weights]), lambda d, w: d * w)
        spectral = spectral_weight * F.aggregate(bands, F.lit(0.0), lambda s, d: s + d)
        pa, pb = a["perimeter"].cast("double"), b["perimeter"].cast("double")
        p = pa + pb - 2.0 * boundary.cast("double")
        both = merged_box(box(a["x"], a["y"], a["w"], a["h"]), box(b["x"], b["y"], b["w"], b["h"]))
        around = lambda w, h: (2 * (w + h)).cast("double")
        smooth = area * p / around(both["w"], both["h"]) - (area_a * pa / around(a["w"], a["h"]) + area_b * pb / around(b["w"], b["h"]))
        compact = area * p / F.sqrt(area) - (area_a * pa / F.sqrt(area_a) + area_b * pb / F.sqrt(area_b))
        shaped = spectral + (1 - spectral_weight) * (shape_weight * compact + (1 - shape_weight) * smooth)
        return F.when(spectral >= threshold, spectral).otherwise(shaped)

    return cost


def pooled(a: Side, b: Side, boundary: Column) -> Side:
    """Attributes of the merged node: the survivor is the lower key."""
    both = merged_box(box(a["x"], a["y"], a["w"], a["h"]), box(b["x"], b["y"], b["w"], b["h"]))
    return {
        "node": a["node"],
        "x": both["x"],
        "y": both["y"],
        "w": both["w"],
        "h": both["h"],
        "area": a["area"] + b["area"],
        "perimeter": a["perimeter"] + b["perimeter"] - 2 * boundary,
        "mean": pooled_mean(a, b),
        "std": pooled_std(a, b),
    }


@dataclass(frozen=True)
class MergeCriterion:
    """What merges: ``cost(a, b, boundary)``; ``choose(costed edges)`` gives disjoint pairs; ``update`` the survivor's columns.

    ``cost`` and ``update`` get the columns of both ends; ``choose`` gets edges
    ``(lo, hi, boundary, cost)`` and nodes, and returns ``(lo, hi)``.
    """

    cost: Callable[[Side, Side, Column], Column]
    choose: Callable[[DataFrame, DataFrame], DataFrame]
    update: Callable[[Side, Side, Column], Side] = pooled
    #: Columns that nodes have besides the common ones, and what the survivor's become: ``merge(a, b, boundary)``.
    own: dict[str, Callable[[Side, Side, Column], Column]] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return (*NODE_COLUMNS, *self.own)

    def ends(self) -> tuple[Side, Side, Column]:
        """What the functions take: both ends of an edge, own columns too, and its boundary."""
        return side("a", self.columns), side("b", self.columns), F.col("boundary")

    def priced(self) -> Column:
        return self.cost(*self.ends())

    def survivor(self) -> Side:
        return self.update(*self.ends()) | {name: merge(*self.ends()) for name, merge in self.own.items()}


def best_neighbours(edges: DataFrame) -> DataFrame:
    """``(node, cost, other)``: the cheapest neighbour of each node, ties to the lower key."""
    one = edges.select(F.col("lo").alias("node"), F.struct("cost", F.col("hi").alias("other")).alias("best"))
    both = one.unionByName(edges.select(F.col("hi").alias("node"), F.struct("cost", F.col("lo").alias("other")).alias("best")))
    return both.groupBy("node").agg(F.min("best").alias("best")).select("node", "best.cost", "best.other")


def mutual_pairs(best: DataFrame) -> DataFrame:
    """``(lo, hi)`` of nodes that are each other's best."""
    back = best.select(F.col("node").alias("hi"), F.col("other").alias("back"))
    return best.where("node < other").select(F.col("node").alias("lo"), F.col("other").alias("hi")).join(back, "hi").where("back = lo").select("lo", "hi")


def baatz(threshold: float, spectral_weight: float = 0.5, shape_weight: float = 0.5, band_weights: list[float] | None = None) -> MergeCriterion:
    """Mutual best neighbours below the threshold (scale squared)."""
    return MergeCriterion(baatz_cost(threshold, spectral_weight, shape_weight, band_weights), lambda edges, nodes: mutual_pairs(best_neighbours(edges).where(F.col("cost") < threshold)))


def small_region_candidates(edges: DataFrame, nodes: DataFrame, most_area: int) -> DataFrame:
    """``(lo, hi, cost)``: a small node and its nearest neighbour, if the small node is that neighbour's nearest small one."""
    areas = nodes.select("node", (F.col("area") <= most_area).alias("small"))
    one = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "cost").unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"), "cost"))
    known = one.join(areas, "node").join(areas.select(F.col("node").alias("other"), F.col("small").alias("other_small")), "other")
    best = known.groupBy("node", "small").agg(F.min(F.struct("cost", "other")).alias("best"), F.min(F.when(F.col("other_small"), F.struct("cost", "other"))).alias("best_small"))
    nearest = best.where("small").select(F.col("node").alias("s"), F.col("best.other").alias("t"), F.col("best.cost").alias("cost"))
    back = best.select(F.col("node").alias("t"), F.col("best_small.other").alias("back"))
    return nearest.join(back, "t").where("back = s").select(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), "cost").distinct()


def without_conflicts(candidates: DataFrame) -> DataFrame:
    """Pairs that are first by (cost, lo, hi) among all candidates that touch either of their ends."""
    rank = F.struct("cost", "lo", "hi")
    ends = candidates.select(F.col("lo").alias("node"), rank.alias("r")).unionByName(candidates.select(F.col("hi").alias("node"), rank.alias("r")))
    first = ends.groupBy("node").agg(F.min("r").alias("r"))
    won = first.select(F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    return won.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("lo", "hi")


def small_regions(most_area: int) -> MergeCriterion:
    """Regions of at most ``most_area`` pixels join their spectrally nearest neighbour; conflicts wait a round."""
    return MergeCriterion(lambda a, b, boundary: spectral_distance(a, b), lambda edges, nodes: without_conflicts(small_region_candidates(edges, nodes, most_area)))


def costed(edges: DataFrame, nodes: DataFrame, criterion: MergeCriterion, cost: Column | None = None) -> DataFrame:
    """Edges with ``cost``; those that have one keep it. Callers with many rounds pass the criterion's column, built once."""
    ends = with_ends(edges if "cost" not in edges.columns else edges.where("cost is null").drop("cost"), nodes)
    fresh = ends.select("lo", "hi", "boundary", (criterion.priced() if cost is None else cost).alias("cost"))
    return fresh if "cost" not in edges.columns else edges.where("cost is not null").unionByName(fresh)


def contract(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, criterion: MergeCriterion, survivor: Side | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the pairs ``(lo, hi, boundary)`` have merged; edges of merged nodes lose their cost."""
    survivor, columns = criterion.survivor() if survivor is None else survivor, criterion.columns
    merged = with_ends(pairs, nodes).select(*[survivor[c].cast(nodes.schema[c].dataType).alias(c) for c in columns])
    gone = pairs.select(F.explode(F.array("lo", "hi")).alias("node"))
    kept = nodes.select(*columns).join(gone, "node", "left_anti").select(*columns)
    moved = pairs.select(F.explode(F.array("lo", "hi")).alias("old"), F.col("lo").alias("new"))
    at = lambda end: moved.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"))
    both = edges.join(at("lo"), "lo", "left").join(at("hi"), "hi", "left")
    a, b = F.coalesce("new_lo", "lo"), F.coalesce("new_hi", "hi")
    stale = F.col("new_lo").isNotNull() | F.col("new_hi").isNotNull()
    mapped = both.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "boundary", F.when(~stale, F.col("cost")).alias("cost"), stale.alias("stale")).where("lo != hi")
    summed = mapped.groupBy("lo", "hi").agg(F.sum("boundary").alias("boundary"), F.when(~F.max("stale"), F.max("cost")).alias("cost"))
    return kept.unionByName(merged), summed


@dataclass
class Outcome:
    """The graph after merging, rounds run, whether merging has ended, and seconds by phase."""

    graph: Graph
    rounds: int
    over: bool
    seconds: dict[str, float] = field(default_factory=dict)


def merged_members(graph: Graph, log: DataFrame | None) -> Callable[[], DataFrame]:
    """The membership after the merges ``log(lo, hi)`` of all rounds, found when it is first asked for."""

    def members() -> DataFrame:
        plain = graph.members.select("pix", "node")
        if log is None:
            return plain
        # A survivor is the lower key, so the end of a chain of merges is the least node of its component.
        ends = connected_components(log, "lo", "hi").select("node", F.col("component").alias("to"))
        return plain.join(ends, "node", "left").select("pix", F.coalesce("to", "node").alias("node"))

    return members


def iterate(graph: Graph, criterion: MergeCriterion, most_rounds: int | None = None) -> Outcome:
    """Rounds of merging, at most ``most_rounds`` (if given), until one merges nothing."""
    spark = graph.nodes.sparkSession
    cost, survivor = criterion.priced(), criterion.survivor()  # the same in every round
    tables, logs = Rounds(spark), Rounds(spark, keep=10**9)
    seconds, log, over, done = {"costs": 0.0, "pairs": 0.0, "merging": 0.0}, None, False, 0
    nodes, edges = tables.cut(graph.nodes.select(*criterion.columns), graph.edges.select("lo", "hi", "boundary", F.lit(None).cast("double").alias("cost")))

    def timed(phase: str, start: float) -> float:
        seconds[phase] += perf_counter() - start
        return perf_counter()

    while most_rounds is None or done < most_rounds:
        start = perf_counter()
        edges = tables.cut(costed(edges, nodes, criterion, cost))[0]
        start = timed("costs", start)
        pairs = logs.cut(criterion.choose(edges, nodes).join(edges, ["lo", "hi"]).select("lo", "hi", "boundary"))[0]
        over = pairs.isEmpty()
        start = timed("pairs", start)
        done += 1
        if over:
            break
        log = pairs.select("lo", "hi") if log is None else log.unionByName(pairs.select("lo", "hi"))
        nodes, edges = tables.cut(*contract(nodes, edges, pairs, criterion, survivor))
        timed("merging", start)

    return Outcome(Graph(nodes, edges.select("lo", "hi", "boundary"), merged_members(graph, log)), done, over, seconds)


def looked_up(rows: DataFrame, key: str, table: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of ``table(key, ...)``, left join; rows of ``hubs(node)``, which are few, stay where they are."""
    if hubs is None:
        return rows.join(table, key, "left")
    few = F.broadcast(hubs.select(F.col("node").alias(key)))
    of_hubs = F.broadcast(table.join(few, key, "left_semi"))
    return rows.join(few, key, "left_semi").join(of_hubs, key, "left").unionByName(rows.join(few, key, "left_anti").join(table, key, "left"))


def hubs_of(edges: DataFrame) -> DataFrame | None:
    """Nodes with more than one in ``HUBS`` of all edge ends: ``HUBS`` at most, whatever the size; none in a small graph."""
    n_edges = edges.count()
    if n_edges <= components.PLENTY:
        return None
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return ends.where(F.col("n") > 2 * n_edges / components.HUBS).select("node")


def absorption_links(nodes: DataFrame, edges: DataFrame, most_area: int, hubs: DataFrame | None = None) -> DataFrame:
    """``(node, other)``: each region of at most ``most_area`` pixels, and its spectrally nearest neighbour, ties to the lower key."""
    end = lambda name: nodes.select(F.col("node").alias(name), F.col("mean").alias(f"mean_{name}"), (F.col("area") <= most_area).alias(f"small_{name}"))
    known = looked_up(looked_up(edges.select("lo", "hi"), "lo", end("lo"), hubs), "hi", end("hi"), hubs)
    cost = spectral_distance({"mean": F.col("mean_lo")}, {"mean": F.col("mean_hi")})
    way = lambda a, b: F.when(F.col(f"small_{a}"), F.struct(F.col(a).alias("node"), F.struct(cost.alias("cost"), F.col(b).alias("other")).alias("to")))
    each = known.where("small_lo or small_hi").select(F.explode(F.filter(F.array(way("lo", "hi"), way("hi", "lo")), lambda w: w.isNotNull())).alias("w"))
    return each.groupBy("w.node").agg(F.min("w.to").alias("to")).select("node", "to.other")


def contract_groups(nodes: DataFrame, edges: DataFrame, groups: DataFrame, n_bands: int, hubs: DataFrame | None = None, own: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the nodes of each group ``(node, component)`` have become one, keyed by the component.

    Attributes are pooled over any number of nodes by sums, so a group of any size is added up where its rows are;
    ``own`` has an aggregate for each column that nodes have besides the common ones.
    """
    own = own or {}
    to = lambda name: groups.select(F.col("node").alias(name), F.col("component").alias(f"{name}_to"))
    moved = looked_up(looked_up(edges.select("lo", "hi", "boundary"), "lo", to("lo"), hubs), "hi", to("hi"), hubs)
    a, b = F.coalesce("lo_to", "lo"), F.coalesce("hi_to", "hi")
    summed = moved.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.sum("boundary").alias("boundary"))
    inner = summed.where("lo = hi").select(F.col("lo").alias("component"), F.col("boundary").alias("inside"))
    area = F.col("area").cast("double")
    band = lambda c, k: F.col(c)[k]
    sums = [F.sum(area * band("mean", k)).alias(f"m{k}") for k in range(n_bands)]
    squares = [F.sum(area * (band("std", k) * band("std", k) + band("mean", k) * band("mean", k))).alias(f"q{k}") for k in range(n_bands)]
    box_of = [F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")]
    pooled_rows = nodes.join(groups, "node").groupBy("component").agg(*box_of, F.sum("area").alias("area"), F.sum("perimeter").alias("around"), *sums, *squares, *[c.alias(f"__{name}") for name, c in own.items()]).join(inner, "component", "left")
    mean = lambda k: F.col(f"m{k}") / F.col("area")
    std = lambda k: F.sqrt(F.greatest(F.col(f"q{k}") / F.col("area") - mean(k) * mean(k), F.lit(0.0)))
    made = {
        "node": F.col("component"), "x": F.col("x"), "y": F.col("y"), "w": F.col("x1") - F.col("x"), "h": F.col("y1") - F.col("y"), "area": F.col("area"),
        "perimeter": F.col("around") - 2 * F.coalesce("inside", F.lit(0)), "mean": F.array(*[mean(k) for k in range(n_bands)]), "std": F.array(*[std(k) for k in range(n_bands)]),
    }
    made |= {name: F.col(f"__{name}") for name in own}
    merged = pooled_rows.select(*[made[c].cast(nodes.schema[c].dataType).alias(c) for c in made])
    kept = nodes.join(groups, "node", "left_anti").select(*made)
    return kept.unionByName(merged), summed.where("lo != hi").select("lo", "hi", "boundary")


def absorb(graph: Graph, most_area: int, most_rounds: int | None = None, own: dict[str, Column] | None = None) -> Outcome:
    """All regions of at most ``most_area`` pixels join their nearest neighbours at once, round by round, until none is left with a neighbour.

    Every small region points to its nearest neighbour. Pointers lead to ever nearer pairs, so they end
    in a large region or in two small ones that point at each other; regions that hang together become one,
    however many they are. A round at least halves the small regions that can merge. ``own`` has an aggregate for
    each further column of the nodes, of the same type (a sum of counts, say).
    """
    tables, logs = Rounds(graph.nodes.sparkSession), Rounds(graph.nodes.sparkSession, keep=10**9)
    nodes, edges = tables.cut(graph.nodes.select(*NODE_COLUMNS, *(own or {})), graph.edges.select("lo", "hi", "boundary"))
    first = nodes.select(F.size("mean").alias("n")).first()
    log, done, over = None, 0, False
    while most_rounds is None or done < most_rounds:
        hubs = hubs_of(edges)
        links = logs.cut(absorption_links(nodes, edges, most_area, hubs).select(F.col("node").alias("lo"), F.col("other").alias("hi")))[0]
        done, over = done + 1, links.isEmpty()
        if over:
            break
        log = links if log is None else log.unionByName(links)
        groups = logs.cut(connected_components(links, "lo", "hi"))[0]
        nodes, edges = tables.cut(*contract_groups(nodes, edges, groups, first["n"], hubs, own))
    return Outcome(Graph(nodes, edges, merged_members(graph, log)), done, over)


def has_no_small_regions(graph: Graph, most_area: int) -> bool:
    """Whether every region of at most ``most_area`` pixels is without neighbours (nothing is left to merge)."""
    ends = graph.edges.select(F.col("lo").alias("node")).union(graph.edges.select("hi"))
    return graph.nodes.where(F.col("area") <= most_area).join(ends, "node", "left_semi").isEmpty()
