"""Regions as polygons: unit sides, arcs shared by two regions, simplified once, and rings.

Every pixel side between two regions belongs to one arc, whichever region asks, so
simplifying arcs keeps neighbours without gaps or overlaps. Vertices are pixel corners
``(x, y)``; the region lies to the right of a directed side (clockwise, y downwards).
The outside of the image and no-data are region -1; arcs against it stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.spatial import neighbours, x_of, y_of
from mosaiq.operators.crossings import crossing_pairs, jumped, reordered_ends, segments
from mosaiq.operators.graph import Graph, both_ways
from mosaiq.operators.outlines import in_order, run_id, straight_runs
from mosaiq.plans.lineage import Rounds, materialize

LINE = "array<struct<x:double,y:double>>"


def per_group(df: DataFrame, keys: list[str], columns: list[str], f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows ``f(*keys, *columns)`` of each group, its columns as arrays: groups are packed first, so small ones cost little."""
    packed = df.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in columns])
    names = T.StructType.fromDDL(schema).names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for values in zip(*(part[c] for c in (*keys, *columns))) for row in f(*values)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return packed.mapInPandas(run, schema)


def points_of(xy: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in xy.astype(float).tolist()]


def unit_sides(members: DataFrame, width: int, height: int) -> DataFrame:
    """``(node, other, x0, y0, x1, y1)``: every pixel side with another region, or none, beyond it."""
    x, y = x_of(F.col("pix"), width), y_of(F.col("pix"), width)
    beyond = neighbours(F.col("pix"), width, height)
    each = members.select("node", x.alias("x"), y.alias("y"), F.posexplode(beyond).alias("side", "n"))
    other = members.select(F.col("pix").alias("n"), F.col("node").alias("other"))
    met = each.join(other, "n", "left").withColumn("other", F.coalesce("other", F.lit(-1).cast("long"))).where("node != other")
    corner = lambda *at: F.element_at(F.array(*at), F.col("side") + 1).cast("int")
    sx, sy = F.col("x"), F.col("y")
    return met.select("node", "other", corner(sx, sx + 1, sx + 1, sx).alias("x0"), corner(sy, sy, sy + 1, sy + 1).alias("y0"), corner(sx + 1, sx + 1, sx, sx).alias("x1"), corner(sy, sy + 1, sy + 1, sy).alias("y1"))


def shared_sides(sides: DataFrame) -> DataFrame:
    """``(lo, hi, length)``: sides that two regions share; ``lo`` is -1 against no region."""
    return sides.where("other < node").groupBy(F.col("other").alias("lo"), F.col("node").alias("hi")).agg(F.count(F.lit(1)).alias("length"))


def polygon_measures(sides: DataFrame) -> DataFrame:
    """``(node, area, perimeter)`` from the sides alone, by the shoelace sum over all rings."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return sides.groupBy("node").agg((F.sum(cross) / 2).cast("long").alias("area"), F.count(F.lit(1)).alias("perimeter"))


def _chains(x0, y0, x1, y1, stops: np.ndarray) -> list[np.ndarray]:
    """Runs of sides, each starting where the last one ended; a run ends at a vertex that stops. Indices in order."""
    ahead: dict[tuple, int] = {(a, b): k for k, (a, b) in enumerate(zip(x0, y0))}
    left, out = np.ones(len(x0), bool), []
    order = np.lexsort((x0, y0))
    for first in [*order[stops[order]], *order[~stops[order]]]:
        if not left[first]:
            continue
        run, at = [first], first
        left[first] = False
        while (at := ahead.get((x1[at], y1[at]), -1)) >= 0 and left[at] and not stops[at]:
            run.append(at)
            left[at] = False
        out.append(np.array(run))
    return out


#: Straight runs of an outline that are put in order in one task; the runs of longer outlines are ranked by joins.
TRACED = 1 << 14


def by_length(runs: DataFrame, keys: list[str], traced: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs of outlines to trace, and those of outlines to rank, if there are any."""
    many = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > traced).select(*keys)
    if many.isEmpty():
        return runs, None
    return runs.join(many, keys, "left_anti"), materialize(runs.join(many, keys, "left_semi"))


def arcs(sides: DataFrame, traced: int = TRACED) -> DataFrame:
    """``(lo, hi, line, closed)``: maximal lines between two regions, cut where more than two meet; directed with ``hi`` to the right."""
    corners = sides.select(F.col("x0").alias("x"), F.col("y0").alias("y"), "node", "other")
    # Two sides of a region start at a corner where it touches itself; others meet where three regions do.
    met = corners.select("x", "y", F.explode(F.array("node", "other")).alias("r")).groupBy("x", "y").agg(F.collect_set("r").alias("regions"))
    twice = corners.groupBy("x", "y", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("x", "y").agg(F.max("n").alias("n"))
    stops = met.join(twice, ["x", "y"]).where((F.size("regions") > 2) | (F.col("n") > 1)).select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(True).alias("stops"))
    own = sides.where("other < node").join(stops, ["x0", "y0"], "left").select(F.col("other").alias("lo"), F.col("node").alias("hi"), "x0", "y0", "x1", "y1", F.coalesce("stops", F.lit(False)).alias("stops"))

    def trace(lo, hi, x0, y0, x1, y1, stops) -> list[tuple]:
        out = []
        for run in _chains(x0, y0, x1, y1, np.asarray(stops, bool)):
            xy = np.c_[np.r_[x0[run], x1[run[-1]]], np.r_[y0[run], y1[run[-1]]]]
            (dx, dy) = np.diff(xy, axis=0).T
            bend = np.r_[True, dx[:-1] * dy[1:] - dy[:-1] * dx[1:] != 0, True]
            out.append((lo, hi, points_of(xy[bend]), bool((xy[0] == xy[-1]).all())))
        return out

    short, long = by_length(materialize(straight_runs(own, ["lo", "hi"])), ["lo", "hi"], traced)
    found = per_group(short, ["lo", "hi"], ["x0", "y0", "x1", "y1", "stops"], trace, f"lo long, hi long, line {LINE}, closed boolean")
    return found if long is None else found.unionByName(ranked_arcs(long))


def ranked_arcs(runs: DataFrame) -> DataFrame:
    """``arcs`` from straight runs ``(lo, hi, x0, y0, x1, y1, stops)``, put in order by joins."""
    keys = ["lo", "hi"]
    ahead = runs.where("not stops").select(*keys, F.col("x0").alias("x1"), F.col("y0").alias("y1"), run_id(keys).alias("next"))
    links = runs.withColumn("id", run_id(keys)).join(ahead, [*keys, "x1", "y1"], "left").select("id", "next")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    last = F.element_at("runs", -1)
    line = F.concat(F.transform("runs", lambda r: point(r["x0"], r["y0"])), F.array(point(last["x1"], last["y1"])))

    def bends(p: Column, k: Column) -> Column:
        before, after = F.get("line", k - 1), F.get("line", k + 1)
        turn = (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"])
        return F.coalesce(turn != 0, F.lit(True))  # both ends stay

    made = in_order(runs, links, keys).withColumn("line", line)
    return made.select(*keys, F.filter("line", bends).alias("line"), (F.col("line")[0] == F.element_at("line", -1)).alias("closed"))


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that stay: ends, and whatever lies farther than the tolerance from the line kept so far."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    if len(points) > 3 and (points[0] == points[-1]).all():  # a loop: its farthest point is kept too
        far = int(((points - points[0]) ** 2).sum(1).argmax())
        keep[far], todo = True, [(0, far), (far, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*base)
        apart = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(*inner.T)
        k = int(apart.argmax())
        if apart[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


Simplifier = Callable[[np.ndarray, float], np.ndarray]


def simplify_lines(line: Column, tolerance: Column | float = 1.0, simplifier: Simplifier = douglas_peucker) -> Column:
    """Lines with fewer points, each by its own tolerance (0: as it is); loops keep at least a triangle.

    Any function of points and tolerance may be given that keeps both ends.
    """

    @F.pandas_udf(LINE)
    def simplified(lines: pd.Series, tolerances: pd.Series) -> pd.Series:
        out = []
        for line, most in zip(lines, tolerances):
            points = np.array([(p["x"], p["y"]) for p in line])
            fewer = simplifier(points, most) if len(points) > 2 and most > 0 else points
            if (points[0] == points[-1]).all() and len(fewer) < 4:
                fewer = points
            out.append([{"x": float(x), "y": float(y)} for x, y in fewer])
        return pd.Series(out)

    return simplified(line, F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance)


#: A tolerance below this keeps a line as it is.
LEAST_TOLERANCE = 0.25


def plane_lines(lines: DataFrame, tolerance: float, simplifier: Simplifier = douglas_peucker) -> DataFrame:
    """``lines(lo, hi, line, fixed)`` simplified as far as they stay a plane graph: no two cross, touch, change places or jump over another.

    All lines that aren't fixed start with the tolerance; those in a conflict get half of it, round by round,
    down to their full form. Full lines never conflict with each other, so each round refines a line, and the
    rounds end. Only lines that changed in the round before are tested again.
    """
    rounds = Rounds(lines.sparkSession)
    start = lines.select(F.monotonically_increasing_id().alias("id"), "lo", "hi", F.col("line").alias("full"), F.when(F.col("fixed"), 0.0).otherwise(float(tolerance)).alias("tolerance"))
    state = rounds.cut(rounds.cut(start)[0].withColumn("line", simplify_lines(F.col("full"), F.col("tolerance"), simplifier)).withColumn("fresh", F.col("tolerance") > 0))[0]
    while True:
        fresh = state.where("fresh")
        pairs = crossing_pairs(segments(fresh, ["id"]), segments(state, ["id"])).select(F.explode(F.array("a", "b")).alias("id"))
        found = pairs.union(reordered_ends(state)).union(jumped(fresh, state, tolerance)).distinct()
        marked = rounds.cut(state.where("tolerance > 0").select("id").join(found, "id", "left_semi"))[0]
        if marked.isEmpty():
            return state.select("lo", "hi", "line")
        half = F.when(F.col("tolerance") / 2 < LEAST_TOLERANCE, 0.0).otherwise(F.col("tolerance") / 2)
        finer = state.join(marked, "id", "left_semi").withColumn("tolerance", half).withColumn("line", simplify_lines(F.col("full"), F.col("tolerance"), simplifier)).withColumn("fresh", F.lit(True))
        state = rounds.cut(state.join(marked, "id", "left_anti").withColumn("fresh", F.lit(False)).unionByName(finer))[0]


def is_parallelogram(ring: Column) -> Column:
    """A ring of four corners whose opposite sides are equally long."""
    side = lambda a, b: F.hypot(ring[a]["x"] - ring[b]["x"], ring[a]["y"] - ring[b]["y"])
    equal = lambda p, q: F.abs(p - q) <= 1e-9 * F.greatest(p, q)
    return (F.size(ring) == 5) & equal(side(0, 1), side(2, 3)) & equal(side(1, 2), side(3, 4))


def is_axis_parallel(line: Column) -> Column:
    """Two points on one row or column."""
    return (F.size(line) == 2) & ((line[0]["x"] == line[1]["x"]) | (line[0]["y"] == line[1]["y"]))


def chain_rings(lines: list[np.ndarray], rightmost: bool = False) -> list[np.ndarray]:
    """Lines put end to end as closed rings; where several go on, the one farthest to the left does (or to the right).

    Where a region touches itself at a corner, going left makes what lies behind the corner a ring of its own;
    going right keeps to the pixel, so it stays part of the same ring, which then meets itself there.
    """
    starts: dict[tuple, list[int]] = {}
    for k, line in enumerate(lines):
        starts.setdefault(tuple(line[0]), []).append(k)
    used, rings = np.zeros(len(lines), bool), []
    for k in sorted(range(len(lines)), key=lambda k: (lines[k][0][1], lines[k][0][0])):
        if used[k]:
            continue
        ring, at = [lines[k]], k
        used[k] = True
        while tuple(lines[at][-1]) != tuple(ring[0][0]):
            ends = [j for j in starts.get(tuple(lines[at][-1]), []) if not used[j]]
            if not ends:
                break
            into = lines[at][-1] - lines[at][-2]

            def turn(j: int) -> float:
                out = lines[j][1] - lines[j][0]
                return float(np.arctan2(into[0] * out[1] - into[1] * out[0], into @ out))

            at = (max if rightmost else min)(ends, key=turn)  # y downwards: the smallest angle is the leftmost turn
            used[at] = True
            ring.append(lines[at])
        rings.append(np.concatenate([r[:-1] for r in ring] + [ring[0][:1]]))
    return rings


def ring_area(ring: np.ndarray) -> float:
    """Positive for rings that run clockwise with y downwards."""
    return float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum() / 2)


def is_simple(ring: np.ndarray) -> bool:
    """Whether no two sides of a ring cross, a side at a time against all others."""
    a, b = ring[:-1], ring[1:]
    cross = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for k in range(len(a) - 1):
        c, d = a[k + 1 :], b[k + 1 :]
        s1, s2 = cross(a[k], b[k], c), cross(a[k], b[k], d)
        t1, t2 = cross(c, d, a[k]), cross(c, d, b[k])
        if ((s1 * s2 < 0) & (t1 * t2 < 0)).any():
            return False
    return ring_area(ring) != 0 and len(ring) >= 4


def polygons(lines: DataFrame) -> DataFrame:
    """``(node, rings, valid)`` from the lines of a plane graph: outer ring first. Each line serves both its regions, turned round for the lower one."""
    hi = lines.where("hi >= 0").select(F.col("hi").alias("node"), "line")
    lo = lines.where("lo >= 0").select(F.col("lo").alias("node"), F.reverse("line").alias("line"))

    def build(node, lines) -> list[tuple]:
        rings = chain_rings([np.array([(p["x"], p["y"]) for p in line["line"]]) for line in lines])
        rings.sort(key=lambda r: -ring_area(r))
        closed = all((r[0] == r[-1]).all() for r in rings)
        areas = [ring_area(r) for r in rings]
        valid = closed and areas[0] > 0 and all(a < 0 for a in areas[1:])  # one outer ring; all others are holes
        return [(node, [points_of(r) for r in rings], bool(valid))]

    # In a struct, lines of different lengths stay apart.
    return per_group(hi.unionByName(lo).withColumn("line", F.struct("line")), ["node"], ["line"], build, f"node long, rings array<{LINE}>, valid boolean")


def simplified_arcs(graph: Graph, full: DataFrame, tolerance: float, simplifier: Simplifier = douglas_peucker) -> DataFrame:
    """``(lo, hi, line)``: a graph's arcs, simplified; those against no region and those of rectangular regions stay."""
    rectangles = graph.nodes.where(F.col("area") == F.col("w") * F.col("h"))
    of = lambda end: rectangles.select(F.col("node").alias(end), F.lit(True).alias(f"is_{end}"))
    fixed = F.coalesce("is_lo", "is_hi", F.lit(False)) | (F.col("lo") < 0)
    return plane_lines(full.join(of("lo"), "lo", "left").join(of("hi"), "hi", "left").select("lo", "hi", "line", fixed.alias("fixed")), tolerance, simplifier)


def polygonize(graph: Graph, width: int, height: int, tolerance: float | None = 1.0, simplifier: Simplifier = douglas_peucker) -> DataFrame:
    """``(node, rings, valid)`` of every region; a tolerance simplifies the arcs between two regions.

    Neighbours share their arcs, and simplified arcs stay a plane graph, so polygons neither overlap nor leave gaps.
    """
    full = materialize(arcs(unit_sides(graph.members, width, height)))
    return polygons(full if tolerance is None else simplified_arcs(graph, full, tolerance, simplifier))


def contours(members: DataFrame, width: int, height: int, traced: int = TRACED) -> DataFrame:
    """``(node, start, moves)``: the outer border as steps from the first pixel's upper left corner (0 up, 1 right, 2 down, 3 left).

    It keeps to its pixels where a region touches itself at a corner, so it takes in true holes and nothing else.
    """

    sides = unit_sides(members, width, height).withColumn("stops", F.lit(False))
    if traced <= 0:
        return ranked_contours(materialize(straight_runs(sides, ["node"])))
    sides = materialize(sides)
    # Most outlines are short: their sides are traced as they are, many outlines at a time.
    short, longer = by_length(sides, ["node"], traced)
    found = traced_contours(short)
    if longer is None:
        return found
    short, longer = by_length(materialize(straight_runs(longer, ["node"])), ["node"], traced)
    found = found.unionByName(traced_contours(short))
    return found if longer is None else found.unionByName(ranked_contours(longer))


#: Sides or steps of outlines that are traced at once.
AT_ONCE = 1 << 20


def portions(lists: pa.ListArray, most: int = AT_ONCE) -> Iterator[slice]:
    """Rows of a batch in turn, so many that their lists hold about ``most`` values together."""
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(start, stop)
        start = stop


def outer_moves(g: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps around ``n`` regions, and how many each has; ``g`` tells whose side each is. As ``chain_rings`` with ``rightmost``, for all at once.

    Every side knows the next one; sides of a ring and their order are found by doubling how far each looks ahead.
    """
    order = np.lexsort((x0, y0, g))
    g, x0, y0, x1, y1 = (v[order].astype(np.int64) for v in (g, x0, y0, x1, y1))
    low, left = min(y0.min(), y1.min()), min(x0.min(), x1.min())
    wide, high = max(x0.max(), x1.max()) - left + 1, max(y0.max(), y1.max()) - low + 1
    starts, ends = ((g * high + y - low) * wide + x - left for x, y in ((x0, y0), (x1, y1)))
    dx, dy = np.sign(x1 - x0), np.sign(y1 - y0)
    ahead, last = np.searchsorted(starts, ends), np.searchsorted(starts, ends, "right")
    second = np.minimum(ahead + 1, len(g) - 1)
    turn = lambda k: dx * dy[k] - dy * dx[k]
    # y downwards: the largest cross product is the rightmost turn; at a corner where a region meets itself two sides go on.
    ahead = np.where((last - ahead > 1) & (turn(second) > turn(ahead)), second, ahead)
    rounds = int(np.bincount(g, minlength=n).max()).bit_length()
    ring, jump = np.arange(len(g)), ahead
    for _ in range(rounds):
        ring, jump = np.minimum(ring, ring[jump]), jump[jump]
    by_ring = np.argsort(ring, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ring[by_ring]) > 0])
    area = np.add.reduceat((x0 * y1 - x1 * y0)[by_ring], first)
    heads = ring[by_ring][first]
    # The largest ring of each region; of equal ones the first.
    best = np.lexsort((heads, -area, g[heads]))
    outer = np.zeros(len(g), bool)
    outer[heads[best[np.r_[True, np.diff(g[heads][best]) > 0]]]] = True
    back, jump = (ahead != ring).astype(np.int64), np.where(ahead == ring, np.arange(len(g)), ahead)
    for _ in range(rounds):
        back, jump = back + back[jump], jump[jump]
    kept = np.flatnonzero(outer[ring])
    kept = kept[np.lexsort((-back[kept], g[kept]))]
    length = (np.abs(x1 - x0) + np.abs(y1 - y0))[kept]
    way = np.select([dy < 0, dx > 0, dy > 0], [0, 1, 2], 3)[kept]
    return np.repeat(way, length), np.bincount(g[kept], weights=length, minlength=n).astype(np.int64)


def traced_contours(sides: DataFrame) -> DataFrame:
    """``contours`` from sides or straight runs ``(node, x0, y0, x1, y1)``; a region's must fit a task."""
    packed = sides.groupBy("node").agg(*[F.collect_list(c).alias(c) for c in ("x0", "y0", "x1", "y1")])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                g = np.repeat(np.arange(len(part)), np.diff(part.column(1).offsets.to_numpy()))
                moves, sizes = outer_moves(g, *(part.column(c).flatten().to_numpy() for c in range(1, 5)), len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(moves.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(0), lists], ["node", "start", "moves"])

    return packed.mapInArrow(trace, "node long, start long, moves array<int>")


def ranked_contours(runs: DataFrame) -> DataFrame:
    """``contours`` from straight runs ``(node, x0, y0, x1, y1)``, put in order by joins."""
    keys, dx, dy = ["node"], F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ahead = runs.select("node", F.col("x0").alias("x1"), F.col("y0").alias("y1"), dx.alias("out_x"), dy.alias("out_y"), run_id(keys).alias("next"))
    met = runs.select("node", "x1", "y1", dx.alias("in_x"), dy.alias("in_y"), run_id(keys).alias("id")).join(ahead, ["node", "x1", "y1"])
    # y downwards: the largest cross product is the rightmost turn.
    links = met.groupBy("id").agg(F.max_by("next", F.expr("in_x * out_y - in_y * out_x")).alias("next"))
    rings = materialize(in_order(runs, links, keys))
    area = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["x0"].cast("long") * r["y1"] - r["x1"].cast("long") * r["y0"])
    outer = rings.groupBy("node").agg(F.min(F.struct((-area).alias("area"), "chain")).alias("k")).select("node", F.col("k.chain").alias("chain"))
    way = lambda r: F.when(r["y1"] < r["y0"], 0).when(r["x1"] > r["x0"], 1).when(r["y1"] > r["y0"], 2).otherwise(3)
    length = lambda r: F.abs(r["x1"] - r["x0"]) + F.abs(r["y1"] - r["y0"])
    moves = F.flatten(F.transform("runs", lambda r: F.array_repeat(way(r), length(r))))
    return rings.join(outer, ["node", "chain"]).select("node", F.col("node").alias("start"), moves.alias("moves"))


def features(graph: Graph, shapes: DataFrame) -> DataFrame:
    """``(label, is_valid, start, adj, rings)``: polygons with their label, key and sorted neighbours."""
    from mosaiq.operators.labels import scan_order_labels

    beside = both_ways(graph.edges).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("adj"))
    rows = shapes.join(scan_order_labels(graph.members), "node").join(beside, "node", "left")
    return rows.select(F.col("label").cast("int").alias("label"), F.col("valid").cast("string").alias("is_valid"), F.col("node").alias("start"), F.coalesce("adj", F.array().cast("array<bigint>")).alias("adj"), "rings")


def valid_features(table: DataFrame) -> DataFrame:
    return table.where("is_valid = 'true'")


def features_at(table: DataFrame, field: str, value) -> DataFrame:
    """All features whose field has the value."""
    return table.where(F.col(field) == value)


def adjacent_features(table: DataFrame) -> DataFrame:
    """``(start, other, label)``: each feature's neighbours, by an equi-join on their keys; order by ``start, other`` for lists."""
    each = table.select("start", F.explode("adj").alias("other"))
    return each.join(table.select(F.col("start").alias("other"), "label"), "other").select("start", "other", "label")


def inside_tile(table: DataFrame, members: DataFrame, width: int, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Features with a pixel in the rectangle."""
    x, y = x_of(F.col("pix"), width), y_of(F.col("pix"), width)
    kept = members.where(x.between(x0, x0 + w - 1) & y.between(y0, y0 + h - 1)).select(F.col("node").alias("start")).distinct()
    return table.join(kept, "start", "left_semi")
