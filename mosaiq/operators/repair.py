"""Repair of polygons whose rings cross, touch, overlap or run back on themselves.

A feature's area is its even-odd fill: what a ray from outside enters an odd number of times.
Sides are cut where they meet others of the same feature (a join by grid cells), and
pieces that lie on each other an even number of times go, for the fill doesn't change
there. What is left bounds the fill everywhere; its faces are walked, and each face inside
becomes a polygon with its holes. Where sides cross between corners, the point is rounded
to ``1 / GRID`` pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.crossings import CELL, cells, meet, segments, side_of
from mosaiq.operators.layers import signed_area
from mosaiq.operators.outlines import SIDE
from mosaiq.operators.ranges import overlapping
from mosaiq.operators.vector import LINE, per_group, points_of, ring_area
from mosaiq.plans.lineage import materialize, unsized

#: Crossing points have this many places to a pixel.
GRID = 1 << 20


def _own_segments(layer: DataFrame, key: str) -> DataFrame:
    """``(id, n, x0, y0, x1, y1)``: the sides of each feature, numbered by ring and place."""
    rings = layer.select(F.col(key).alias("id"), F.posexplode("rings").alias("ring", "line")).where(F.size("line") > 1)
    return segments(rings, ["id", "ring"]).where("x0 != x1 or y0 != y1").withColumn("n", F.struct("ring", "k")).drop("ring", "k")


#: Sides of a feature up to which all are held against all; those of larger ones meet by grid cells.
FEW = 64


def _meeting(sides: DataFrame) -> DataFrame:
    """Pairs of different sides of one feature that meet, as ``a_*`` and ``b_*`` with ``a_n < b_n``; a pair may come several times."""
    few = F.count(F.lit(1)).over(Window.partitionBy("id")) <= FEW
    one = F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
    here = F.when(few, one).otherwise(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), CELL))
    dealt = sides.withColumn("cells", here).select("*", F.explode("cells").alias("cell")).select("id", "n", *SIDE, "cell.cx", "cell.cy")
    named = lambda name: dealt.select("id", "cx", "cy", *[F.col(c).alias(f"{name}_{c}") for c in ("n", *SIDE)])
    return unsized(named("a")).join(named("b"), ["id", "cx", "cy"]).where((F.col("a_n") < F.col("b_n")) & meet()).drop("cx", "cy")


def _near_pairs(sides: DataFrame) -> DataFrame:
    """Pairs of different sides of one feature that meet, each once and both ways round, as ``a_*`` and ``b_*``."""
    way = lambda a, b: F.struct(*[F.col(f"{x}_{c}").alias(f"{y}_{c}") for x, y in ((a, "a"), (b, "b")) for c in ("n", *SIDE)])
    return _meeting(sides).distinct().select("id", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("id", "p.*")


def faulty_features(layer: DataFrame, key: str = "start") -> DataFrame:
    """``(id)`` of features with sides that meet elsewhere than at ends of both, open rings, or no area."""
    crossing = _meeting(_own_segments(layer, key)).select("id")
    broken = F.exists("rings", lambda r: (F.size(r) < 4) | (r[0] != F.element_at(r, -1)) | (signed_area(r) == 0))
    return crossing.union(layer.where(broken | (F.size("rings") == 0)).select(F.col(key).alias("id"))).distinct()


def cut_sides(sides: DataFrame) -> DataFrame:
    """``(id, n, a, b)``: sides ``(id, n, x0, y0, x1, y1)`` cut where others of the same id meet them, from the lesser end to the greater."""
    p = {c: F.col(f"a_{c}").cast("double") for c in ("x0", "y0", "x1", "y1")}
    q = {c: F.col(f"b_{c}").cast("double") for c in ("x0", "y0", "x1", "y1")}
    swapped = F.col("a_n") > F.col("b_n")  # both sides of a pair must find the same point
    one, other = ({c: F.when(swapped, s[c]).otherwise(r[c]) for c in p} for r, s in ((p, q), (q, p)))
    across = (one["x1"] - one["x0"]) * (other["y1"] - other["y0"]) - (one["y1"] - one["y0"]) * (other["x1"] - other["x0"])
    share = ((other["x0"] - one["x0"]) * (other["y1"] - other["y0"]) - (other["y0"] - one["y0"]) * (other["x1"] - other["x0"])) / across
    whole = lambda v: F.round(v * GRID) / GRID
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = [[(F.col(f"{s}_x{e}"), F.col(f"{s}_y{e}")) for e in (0, 1)] for s in ("a", "b")]
    apart = (side_of(*a[0], *a[1], *b[0]) * side_of(*a[0], *a[1], *b[1]) < 0) & (side_of(*b[0], *b[1], *a[0]) * side_of(*b[0], *b[1], *a[1]) < 0)
    found = [F.when(apart, point(whole(one["x0"] + share * (one["x1"] - one["x0"])), whole(one["y0"] + share * (one["y1"] - one["y0"]))))]
    for x, y in b:
        inside = (side_of(*a[0], *a[1], x, y) == 0) & x.between(F.least(a[0][0], a[1][0]), F.greatest(a[0][0], a[1][0])) & y.between(F.least(a[0][1], a[1][1]), F.greatest(a[0][1], a[1][1]))
        found.append(F.when(inside, point(x.cast("double"), y.cast("double"))))
    cuts = _near_pairs(sides).select("id", F.col("a_n").alias("n"), F.explode(F.filter(F.array(*found), lambda c: c.isNotNull())).alias("c")).groupBy("id", "n").agg(F.collect_set("c").alias("cuts"))
    ends = F.array(point(F.col("x0").cast("double"), F.col("y0").cast("double")), point(F.col("x1").cast("double"), F.col("y1").cast("double")))
    along = lambda c: F.struct((F.abs(c["x"] - F.col("x0")) + F.abs(c["y"] - F.col("y0"))).alias("d"), c["x"].alias("x"), c["y"].alias("y"))
    stops = F.array_sort(F.transform(F.array_union(ends, F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>"))), along))
    pieces = sides.join(cuts, ["id", "n"], "left").withColumn("stops", stops)
    each = pieces.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda k: F.struct(_plain(F.col("stops")[k]).alias("a"), _plain(F.col("stops")[k + 1]).alias("b")))).alias("e"))
    return each.select("id", "n", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).where("a != b")


def _ends() -> list[Column]:
    return [F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]


def fill_edges(layer: DataFrame, key: str = "start") -> DataFrame:
    """``(id, ax, ay, bx, by)``: the pieces of sides between which the even-odd fill of a feature changes."""
    pieces = cut_sides(materialize(_own_segments(layer, key)))
    return pieces.groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("times")).where("times % 2 = 1").select("id", *_ends())


def _plain(stop: Column) -> Column:
    return F.struct(stop["x"].alias("x"), stop["y"].alias("y"))


def _loops(walk: list[int]) -> list[list[int]]:
    """A closed walk split where it comes back to a corner."""
    out, path, at = [], [], {}
    for corner in walk:
        if corner in at:
            out.append(path[at[corner] :])
            for gone in path[at[corner] :]:
                at.pop(gone)
            path = path[: len(path) - len(out[-1])]
        at[corner] = len(path)
        path.append(corner)
    return [*out, path]


@dataclass
class Faces:
    """The faces of a plane graph: closed walks of half-edges with the face to their right, and a state for each.

    Half-edge ``k`` and its way back ``k + n`` belong to edge ``k``; ``outers`` are the walks around whole pieces.
    """

    corners: np.ndarray
    tail: np.ndarray
    face: np.ndarray
    walks: list[list[int]]
    areas: list[float]
    outers: list[int]
    state: list[int]

    def ring(self, loop: list[int]) -> np.ndarray:
        return self.corners[[*loop, loop[0]]]

    def loops(self, f: int) -> list[np.ndarray]:
        return [self.ring(loop) for loop in _loops([int(self.tail[k]) for k in self.walks[f]])]

    def leftmost(self, f: int) -> list[float]:
        return min(self.corners[self.tail[k]].tolist() for k in self.walks[f])


def walked_faces(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, toggles: list[int]) -> Faces:
    """Faces of edges that meet at their ends alone. The face outside has state 0, and an edge flips the bits of its toggle."""
    corners, ends = np.unique(np.concatenate([np.c_[ax, ay], np.c_[bx, by]]), axis=0, return_inverse=True)
    n = len(ax)
    tail = ends.ravel()
    head, twin = np.r_[tail[n:], tail[:n]], np.r_[np.arange(n, 2 * n), np.arange(n)]
    step = corners[head] - corners[tail]
    order = np.lexsort((np.arctan2(step[:, 1], step[:, 0]), tail))
    first = np.searchsorted(tail[order], np.arange(len(corners) + 1))
    place = np.empty(2 * n, int)
    place[order] = np.arange(2 * n)
    # With the face to the right, the next side is the one before the way back, by angle.
    low, high = first[head], first[head + 1]
    ahead = order[low + (place[twin] - low - 1) % (high - low)]
    face, walks = np.full(2 * n, -1), []
    for k in range(2 * n):
        if face[k] < 0:
            walk = []
            while face[k] < 0:
                face[k] = len(walks)
                walk.append(k)
                k = int(ahead[k])
            walks.append(walk)
    made = Faces(corners, tail, face, walks, [], [], [0] * len(walks))
    made.areas = [ring_area(made.ring([int(tail[k]) for k in walk])) for walk in walks]
    piece = np.full(len(walks), -1)
    for f in range(len(walks)):
        if made.areas[f] < 0 and piece[f] < 0:  # each piece has one walk around it
            made.outers.append(f)
            todo, piece[f] = [f], f
            while todo:
                for k in walks[todo.pop()]:
                    g = face[twin[k]]
                    if piece[g] < 0:
                        piece[g] = f
                        todo.append(g)
    edge_piece = piece[face[:n]]
    for f in made.outers:  # what is around a piece is what a ray to its left passes
        x, y = made.leftmost(f)
        crossed = np.flatnonzero((edge_piece != f) & ((ay > y) != (by > y)))
        at = ax[crossed] + (y - ay[crossed]) / (by - ay)[crossed] * (bx - ax)[crossed]
        for k in crossed[at < x].tolist():
            made.state[f] ^= toggles[k]
        todo, seen = [f], {f}
        while todo:
            g = todo.pop()
            for k in walks[g]:
                h = int(face[twin[k]])
                if h not in seen:
                    seen.add(h)
                    made.state[h] = made.state[g] ^ toggles[k % n]
                    todo.append(h)
    return made


def fill_polygons(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> list[list[np.ndarray]]:
    """The faces inside the fill that edges bound, each as its outer ring and its holes; every edge is between inside and outside."""
    faces = walked_faces(ax, ay, bx, by, [1] * len(ax))
    made = []
    for f, area in enumerate(faces.areas):
        if area > 0 and faces.state[f] == 1:
            made.append((area, sorted(faces.loops(f), key=lambda r: -ring_area(r))))
    made.sort(key=lambda m: (m[0], m[1][0].tolist()))
    for f in faces.outers:
        if faces.state[f] == 1:  # a piece in a face inside is a hole of the smallest one around it
            around = next(loops for _, loops in made if _held(loops[0], *faces.leftmost(f)))
            around += faces.loops(f)
    return [loops for _, loops in reversed(made)]


def uncovered_polygons(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, toggles: list[int]) -> list[list[np.ndarray]]:
    """The fill of the owner of bit 0 where no other owner's fill is, as polygons; toggles are the owners whose fill changes at an edge."""
    faces = walked_faces(ax, ay, bx, by, toggles)
    wanted = np.array([s == 1 for s in faces.state])
    n = len(ax)
    edge = wanted[faces.face[:n]] != wanted[faces.face[n:]]
    return fill_polygons(ax[edge], ay[edge], bx[edge], by[edge]) if edge.any() else []


def _held(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a point lies in a ring."""
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    crossed = (y0 > y) != (y1 > y)
    return int((x0[crossed] + (y - y0[crossed]) / (y1 - y0)[crossed] * (x1 - x0)[crossed] < x).sum()) % 2 == 1


def repaired(layer: DataFrame, key: str = "start") -> DataFrame:
    """``(id, part, rings)``: the even-odd fill of each feature as polygons that are valid each by itself, largest first; none if the fill is empty."""

    def build(name, ax, ay, bx, by) -> list[tuple]:
        return [(name, k, [points_of(r) for r in loops]) for k, loops in enumerate(fill_polygons(ax, ay, bx, by))]

    kind = layer.schema[key].dataType.simpleString()
    return per_group(fill_edges(layer, key), ["id"], ["ax", "ay", "bx", "by"], build, f"id {kind}, part int, rings array<{LINE}>")


def clean_layer(layer: DataFrame, key: str = "start") -> DataFrame:
    """The features with ``part`` and valid rings: faulty ones are repaired, in as many parts as they have; those without area go."""
    faulty = materialize(faulty_features(layer, key)).withColumnRenamed("id", key)
    good = layer.join(faulty, key, "left_anti").withColumn("part", F.lit(0))
    bad = layer.join(faulty, key, "left_semi")
    fixed = repaired(bad, key).withColumnRenamed("id", key)
    return good.unionByName(bad.drop("rings").join(fixed, key))


def _boxes(layer: DataFrame, key: str) -> DataFrame:
    """``(id, x, y, w, h)``: the box of whole pixels around each feature."""
    xs = lambda c: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c])))
    low = lambda c: F.floor(F.array_min(xs(c)))
    return layer.where(F.size(F.flatten("rings")) > 0).select(F.col(key).alias("id"), *[low(c).alias(c) for c in "xy"], *[F.greatest(F.ceil(F.array_max(xs(c))) - low(c), F.lit(1)).alias(s) for c, s in (("x", "w"), ("y", "h"))])


def without_overlaps(layer: DataFrame, key: str = "start") -> DataFrame:
    """The features with ``part`` and rings such that no point lies in two: it stays with the least key.

    A feature whose box meets that of an earlier one is cut against all of those at once; others stay as they are.
    What lies in earlier features entirely goes. A feature's earlier neighbours must fit a task with it.
    """
    boxes = materialize(_boxes(layer, key))
    pairs = materialize(overlapping(boxes, boxes).where("a_id > b_id").select(F.col("a_id").alias("id"), F.col("b_id").alias("owner")))
    touched = pairs.select("id").distinct()
    owners = pairs.unionByName(touched.select("id", F.col("id").alias("owner")))
    rings = owners.join(layer.select(F.col(key).alias("owner"), "rings"), "owner").select("id", "owner", F.posexplode("rings").alias("ring", "line")).where(F.size("line") > 1)
    sides = segments(rings, ["id", "owner", "ring"]).where("x0 != x1 or y0 != y1").withColumn("n", F.struct("owner", "ring", "k")).drop("owner", "ring", "k")
    pieces = cut_sides(materialize(sides)).groupBy("id", "a", "b", F.col("n.owner").alias("owner")).agg(F.count(F.lit(1)).alias("times")).where("times % 2 = 1")
    edges = pieces.groupBy("id", "a", "b").agg(F.collect_set("owner").alias("owners")).select("id", *_ends(), F.struct("owners").alias("owners"))

    def build(name, ax, ay, bx, by, owners) -> list[tuple]:
        bit = {name: 1}
        toggles = [sum(bit.setdefault(o, 1 << len(bit)) for o in each["owners"]) for each in owners]
        return [(name, k, [points_of(r) for r in loops]) for k, loops in enumerate(uncovered_polygons(ax, ay, bx, by, toggles))]

    kind = layer.schema[key].dataType.simpleString()
    cut = per_group(edges, ["id"], ["ax", "ay", "bx", "by", "owners"], build, f"id {kind}, part int, rings array<{LINE}>").withColumnRenamed("id", key)
    alone = layer.join(touched.withColumnRenamed("id", key), key, "left_anti").withColumn("part", F.lit(0))
    return alone.unionByName(layer.drop("rings").join(cut, key))
