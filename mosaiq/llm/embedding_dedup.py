"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors are compared only within a label. Scaled to length 1, cosine >= t means a
distance of at most sqrt(2 - 2t), so the triangle inequality prunes: two nodes whose
centres are farther apart than that plus both covering radii hold no link, and two
nodes that lie within it by both radii are linked throughout, without any pair in it
being looked at. What is left is compared in double precision.

The tree is nested: a node is named after its centre, and its first child has the same
centre. Its upper levels are Spark tables: nodes of more than ``LEAF`` points are split
around the farthest points, one after another, of a bounded sample (with the node's own
centre), until the radius has halved or there are ``CHILDREN``; assignment is by node and
salt, so a label of any size is dealt out. Radii are computed from all members, so a
sample makes no pair be missed. In high dimensions radii may not halve with so few
centres: a node still too large after ``MOST_SPLITS`` levels is cut by a hash. Each leaf
gets its own nested levels of halving radii, once; nodes whose children would hold few
points stay whole, as a product of matrices is cheaper there.

Pairs of nodes go down level by level as joins of parent and child tables, and end where
they are pruned or linked throughout, at whatever level. Surviving pairs of leaves are
traversed together, dealt out in tiles of leaves that follow each other in the tree of one
label, so a leaf is sent out once for each tile of its label at most. Vectors keep their
own precision until a task scales them, so tables and shuffles hold no wider numbers than
the input. Counts are added up by node, leaf and tile, and a pair of leaves yields only links between parts that aren't known as connected
inside a leaf, so a group of near copies makes about as many rows as it has members.

Equal vectors of a label are one class from the start. Vectors that are null, zero, of
another size, or hold null or non-finite components, and vectors without label or id,
link with nothing and stay. Rows that share an id are one node of the components, and
their links are added up. Repeated rows are vectors of their own and link with each
other. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.forest import spanning_forest
from mosaiq.operators.components import connected_components
from mosaiq.plans.lineage import Rounds, materialize, settled
from mosaiq.plans.ranking import unit

THRESHOLD = 0.93
#: Points of a leaf; children of an upper node; sampled points that its centres come from; points assigned in a task.
LEAF, CHILDREN, SAMPLE, PORTION = 512, 64, 256, 512
MOST_SPLITS = 8
#: Leaves on a side of a tile, whose pairs are compared in one task: the least, and the most where a label has more than ``SIDE`` tiles.
TILE, MOST_TILE, SIDE = 16, 128, 6
#: Columns of tiles whose leaves are sent out at a time, so that their copies take a few times the disk of the leaves, however many tiles there are.
WAVE = 2
#: What names a pair of tiles.
TILES = ["root", "ta", "tb"]
#: Points that children of a leaf's node have on average, or it isn't split.
FEW = 8
#: Slack of bounds against rounding; what lies within it is decided by the cosine itself.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """The vector at length 1, in doubles."""
    v = F.transform(vector, lambda x: x.cast("double"))
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    v = F.transform(F.array(F.struct(v.alias("v"), most.alias("m"))), lambda s: F.transform(s["v"], lambda x: x / s["m"]))[0]
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(v), lambda w: F.transform(F.array(norm(w)), lambda n: F.transform(w, lambda x: x / n))[0])[0]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _units(rows: np.ndarray) -> np.ndarray:
    """Each row at length 1, in doubles, as ``scaled`` does."""
    rows = rows.astype(float)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def split_nodes(points: DataFrame) -> DataFrame:
    """``points(rep, m, node, v)`` with ``node`` a path of centres from its root, leaves of about ``LEAF`` points; ``v`` of any length."""

    def centres(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The node's own centre, then the point farthest from all so far, until the radius has halved or there are enough."""
        part = part.sort_values("rep").reset_index(drop=True)
        v, most = _units(_matrix(part["v"])), int(part["k"].iloc[0])
        chosen = [int((part["rep"].astype(str) == key[0].rpartition(".")[2]).to_numpy().argmax())]
        far = _apart(v, v[chosen])[:, 0]
        stop = far.max() / 2
        while len(chosen) < most and far.max() > max(stop, SLACK):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _apart(v, v[chosen[-1:]])[:, 0])
        return pd.DataFrame({"node": key[0], "salts": int(part["salts"].iloc[0]), "child": part["rep"].to_numpy()[chosen], "centre": list(v[chosen])})

    def assign(key: tuple, part: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        part = part[["rep", "m", "node", "v"]]
        if len(around) and len(part):
            around = around.sort_values("child")
            near = _apart(_units(_matrix(part["v"])), _matrix(around["centre"])).argmin(1)
            part = part.assign(node=[f"{n}.{around['child'].iloc[k]}" for n, k in zip(part["node"], near)])
        return part

    kind = points.schema["v"].dataType.simpleString()
    rounds, schema = Rounds(points.sparkSession), f"rep long, m long, node string, v {kind}"
    for _ in range(MOST_SPLITS):
        sizes = materialize(points.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF))
        if sizes.isEmpty():
            break
        big = sizes.select("node", "n", F.least(F.ceil(F.col("n") / LEAF) * 2, F.lit(CHILDREN)).cast("int").alias("k"), F.ceil(F.col("n") / PORTION).cast("int").alias("salts"))
        large = points.join(big, "node")
        sampled = (unit(F.xxhash64("rep", F.lit(1))) * F.col("n") < SAMPLE) | (F.col("rep").cast("string") == F.substring_index("node", ".", -1))
        around = large.where(sampled).select("node", "rep", "v", "k", "salts").groupBy("node").applyInPandas(centres, "node string, salts int, child long, centre array<double>")
        around = around.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = large.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
        moved = dealt.groupBy("node", "salt").cogroup(around.groupBy("node", "salt")).applyInPandas(assign, schema)
        points = rounds.cut(points.join(big, "node", "left_anti").select("rep", "m", "node", "v").unionByName(moved))[0]
    sizes = points.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("parts"))
    return points.join(sizes, "node").withColumn("node", F.concat("node", F.lit("."), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string"))).drop("parts")


@dataclass
class Tree:
    """A leaf's nested levels. Points are in the order of the tree, so a node is a range of them; children have following numbers."""

    starts: np.ndarray
    stops: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def packed(self) -> bytes:
        return np.stack([self.starts, self.stops, self.centres, self.first, self.children, self.radii.view(np.int64)]).tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> "Tree":
        rows = np.frombuffer(raw, np.int64).reshape(6, -1)
        return Tree(rows[0], rows[1], rows[2], rows[5].view(np.float64), rows[3], rows[4])


def cover_tree(v: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of the points, and their tree: of a level's centres the first is its parent's, the next ones are the first points not covered."""
    between, order = _apart(v, v), np.arange(len(v))
    nodes = [[0, len(v), 0, 1.0, 0, 0]]  # start, stop, centre, level's radius, first child, children
    radii, at = [], 0
    while at < len(nodes):
        start, stop, centre, r, _, _ = nodes[at]
        left, parts, near = order[start:stop], [], centre
        radii.append(float(between[centre, left].max()))
        while radii[at] > SLACK and r >= radii[at]:
            r /= 2
        if radii[at] > SLACK and len(left) > FEW:
            while len(left) and (len(parts) + 1) * FEW <= stop - start:
                covered = between[near, left] <= r
                parts.append((near, left[covered]))
                left = left[~covered]
                near = int(left[0]) if len(left) else near
            if not len(left):
                nodes[at][4:] = len(nodes), len(parts)
                for c, members in parts:
                    order[start : start + len(members)] = members
                    nodes.append([start, start + len(members), c, r / 2, 0, 0])
                    start += len(members)
        at += 1
    place = np.argsort(order)
    columns = [np.array(x, np.int64) for x in zip(*[(a, b, place[c], f, n) for a, b, c, _, f, n in nodes])]
    return order, Tree(*columns[:3], np.array(radii), *columns[3:])


def traverse(a: Tree, b: Tree, va: np.ndarray, vb: np.ndarray, threshold: float, own: bool = False) -> np.ndarray | None:
    """Which points of two trees are linked, as a matrix; none if no points are. ``own``: a tree with itself."""
    reach = float(np.sqrt(2 - 2 * threshold))
    apart, near = _apart(va[a.centres], vb[b.centres]), None
    x = y = np.zeros(1, np.int64)
    rest = []
    while len(x):
        bound, d = a.radii[x] + b.radii[y], apart[x, y]
        same = (x == y) & own
        alive = same | (d <= reach + bound + SLACK)
        whole = np.where(same, 2 * a.radii[x], d + bound) <= reach - SLACK
        for i, j in zip(x[whole], y[whole]):
            near = np.zeros((len(va), len(vb)), bool) if near is None else near
            near[a.starts[i] : a.stops[i], b.starts[j] : b.stops[j]] = True
        x, y = x[alive & ~whole], y[alive & ~whole]
        bottom = (a.children[x] == 0) & (b.children[y] == 0)
        rest.append((x[bottom], y[bottom]))
        x, y = x[~bottom], y[~bottom]
        # Children of both; a node without any stays as it is.
        nx, ny = np.maximum(a.children[x], 1), np.maximum(b.children[y], 1)
        k = np.arange((nx * ny).sum()) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
        fx, fy = np.where(a.children[x] > 0, a.first[x], x), np.where(b.children[y] > 0, b.first[y], y)
        same, ny = np.repeat((x == y) & own, nx * ny), np.repeat(ny, nx * ny)
        fx, fy = np.repeat(fx, nx * np.maximum(b.children[y], 1)), np.repeat(fy, nx * np.maximum(b.children[y], 1))
        x, y = fx + k // ny, fy + k % ny
        x, y = x[~same | (x <= y)], y[~same | (x <= y)]
    x, y = map(np.concatenate, zip(*rest))
    if len(x):
        cells = (a.stops[x] - a.starts[x]) * (b.stops[y] - b.starts[y])
        if cells.sum() * 8 > len(va) * len(vb):  # a single product does it faster
            near = va @ vb.T >= threshold
        else:
            near = np.zeros((len(va), len(vb)), bool) if near is None else near
            for i, j in zip(x, y):
                rows, columns = slice(a.starts[i], a.stops[i]), slice(b.starts[j], b.stops[j])
                near[rows, columns] = va[rows] @ vb[columns].T >= threshold
    if near is not None and own:
        near |= near.T
        np.fill_diagonal(near, False)
    return near if near is not None and near.any() else None


def _precision(vector: T.ArrayType) -> str:
    """The numpy type in which vectors are kept."""
    return "<f4" if isinstance(vector.elementType, T.FloatType) else "<f8"


def pack(points: DataFrame, threshold: float) -> DataFrame:
    """A row a leaf: its bounds, points and tree, its points' links inside it (``own``) and the first point of their components there (``roots``)."""

    precision = _precision(points.schema["v"].dataType)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        raw = np.stack(part["v"].to_numpy()).astype(precision)
        v = _units(raw)
        order, tree = cover_tree(v)
        v, reps, ms = v[order], part["rep"].to_numpy(np.int64)[order], part["m"].to_numpy(np.int64)[order]
        centre = v.mean(0)
        radius = float(_apart(v, centre[None])[:, 0].max())
        near, roots, own = traverse(tree, tree, v, v, threshold, True), np.arange(len(v)), np.zeros(len(v), np.int64)
        if near is not None:
            own = near @ ms
            for i, j in spanning_forest(near, True):  # each component in turn, from its root on
                roots[j] = roots[i]
        return pd.DataFrame({"node": [key[0]], "centre": [centre], "radius": [radius], "m": [ms.sum()], "rep": [reps[0]], "reps": [reps], "ms": [ms], "own": [own], "roots": [roots], "vs": [raw[order].tobytes()], "tree": [tree.packed()]})

    return points.groupBy("node").applyInPandas(one, "node string, centre array<double>, radius double, m long, rep long, reps array<long>, ms array<long>, own array<long>, roots array<int>, vs binary, tree binary")


def upper_pairs(leaves: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The upper part of the dual traversal.

    Pairs ``(a, b)`` of leaves that may hold links, ``a < b``; and, by leaf, each node above it (or
    itself) that is linked throughout with another or with itself: ``(leaf, rep, gain)`` with one point
    to link to, and the number of vectors outside the leaf that each of its points is linked with.
    """

    def above(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        c = _matrix(part["centre"])
        centre = c.mean(0)
        radius = float((_apart(c, centre[None])[:, 0] + part["radius"].to_numpy()).max())
        return pd.DataFrame({"node": [key[0]], "centre": [centre], "radius": [radius], "m": [part["m"].sum()], "rep": [part["rep"].min()]})

    schema = "node string, centre array<double>, radius double, m long, rep long"
    deepest = leaves.agg(F.max(F.size(F.split("node", r"\.")))).first()[0] or 0
    # A leaf that ends early is its own child on the levels below.
    level = leaves.select(F.concat("node", F.repeat(F.lit(".0"), deepest - F.size(F.split("node", r"\.")))).alias("node"), "centre", "radius", "m", "rep", F.col("node").alias("leaf"))
    levels = [materialize(level)]
    parent = F.regexp_replace("node", r"\.[^.]*$", "")
    for _ in range(deepest - 1):
        levels.append(materialize(levels[-1].drop("leaf").withColumn("node", parent).groupBy("node").applyInPandas(above, schema)))
    distance = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rounds, whole = Rounds(leaves.sparkSession, keep=deepest + 1), []
    pairs, up = levels[-1].select(F.lit("").alias("a"), F.lit("").alias("b"), F.col("node").alias("na"), F.col("node").alias("nb")), None
    for level in levels[::-1]:
        side = lambda s: level.select(F.col("node").alias(f"n{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("m").alias(f"m{s}"), F.col("rep").alias(f"rep{s}"), *[F.col("leaf").alias(f"leaf{s}")] * ("leaf" in level.columns))  # noqa: E731, B023
        if up is not None:
            child = level.select(parent.alias("up"), "node")
            of = lambda s: child.select(F.col("up").alias(s), F.col("node").alias(f"n{s}"))  # noqa: E731, B023
            pairs = up.join(of("a"), "a").join(of("b"), "b").where("na <= nb")
        met = pairs.select("na", "nb").join(side("a"), "na").join(side("b"), "nb").withColumn("d", distance).where(F.col("d") <= F.col("ra") + F.col("rb") + F.lit(reach + SLACK))
        met = rounds.cut(met.withColumn("whole", F.when(F.col("na") == F.col("nb"), 2 * F.col("ra")).otherwise(F.col("d") + F.col("ra") + F.col("rb")) <= F.lit(reach - SLACK)).drop("ca", "cb", "ra", "rb", "d"))[0]
        whole.append(met.where("whole").select("na", "nb", "ma", "mb", "repa", "repb"))
        up = met.where("not whole").select(F.col("na").alias("a"), F.col("nb").alias("b"), *[c for c in met.columns if c.startswith("leaf")])
    found = up.where("leafa < leafb").select(F.col("leafa").alias("a"), F.col("leafb").alias("b")) if deepest else leaves.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if not deepest:
        return found, leaves.select(F.col("node").alias("leaf"), "rep", F.col("m").alias("gain"))
    linked = whole[0]
    for w in whole[1:]:
        linked = linked.unionByName(w)
    other = linked.where("na != nb")
    # By node: a point to link to, and what its points gain; with itself that is all but what the leaf itself counts.
    gains = linked.where("na = nb").select(F.col("na").alias("node"), F.col("repa").alias("rep"), F.col("ma").alias("gain"), F.lit(1).alias("itself"))
    for s, t in ("ab", "ba"):
        gains = gains.unionByName(other.select(F.col(f"n{s}").alias("node"), F.col("repa").alias("rep"), F.col(f"m{t}").alias("gain"), F.lit(0).alias("itself")))
    # A tie of "rep" of both nodes of a pair follows from each linking to the same point.
    gains = gains.groupBy("node", "rep").agg(F.sum("gain").alias("gain"), F.sum("itself").alias("itself"))
    ancestors = levels[0].select("leaf", "m", F.explode(F.transform(F.sequence(F.lit(1), F.lit(deepest)), lambda k: F.array_join(F.slice(F.split("node", r"\."), F.lit(1), k), "."))).alias("node"))
    return found, ancestors.join(gains, "node").select("leaf", "rep", (F.col("gain") - F.col("itself") * F.col("m")).alias("gain"))


def tiled_pairs(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of leaves with their ``root`` and the tiles ``ta`` and ``tb``: leaves of a root that follow each other by path."""
    of_root = Window.partitionBy("root")  # a row a leaf
    size = F.least(F.greatest(F.ceil(F.count(F.lit(1)).over(of_root) / SIDE), F.lit(TILE)), F.lit(MOST_TILE))
    placed = leaves.select("node", F.substring_index("node", ".", 1).alias("root"))
    tiles = materialize(placed.select("node", "root", F.floor((F.row_number().over(of_root.orderBy("node")) - 1) / size).alias("tile")))
    of = lambda s: tiles.select(F.col("node").alias(s), F.col("tile").alias(f"t{s}"), *["root"] * (s == "a"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(*TILES, "a", "b")


def shipped_leaves(tiled: DataFrame, leaves: DataFrame) -> DataFrame:
    """The leaves that each pair of tiles needs, once."""
    needed = tiled.select(*TILES, F.explode(F.array("a", "b")).alias("node")).distinct()
    return needed.join(leaves.select("node", "reps", "ms", "roots", "vs", "tree"), "node")


def compare_leaves(pairs: DataFrame, leaves: DataFrame, threshold: float, precision: str = "<f8") -> DataFrame:
    """``(src, dst, links)``: link counts of classes (``dst`` null), and links that span the components of each pair's parts."""

    def compare(key: tuple, pairs: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        known = {}
        for r in leaves.itertuples():
            roots, part = np.unique(np.asarray(r.roots), return_inverse=True)
            by_part = np.argsort(part, kind="stable")
            known[r.node] = (np.asarray(r.reps), np.asarray(r.ms), _units(np.frombuffer(r.vs, precision).reshape(len(r.reps), -1)), Tree.unpacked(r.tree), roots, by_part, np.searchsorted(part[by_part], np.arange(len(roots))), np.zeros(len(r.reps), np.int64))
        src, dst = [], []
        for a, b in sorted(zip(pairs["a"], pairs["b"])):
            (ra, ma, va, ta, fa, oa, sa, na), (rb, mb, vb, tb, fb, ob, sb, nb) = known[a], known[b]
            near = traverse(ta, tb, va, vb, threshold)
            if near is None:
                continue
            na += near @ mb
            nb += near.T @ ma
            # Between parts that are connected inside their leaf.
            parts = np.logical_or.reduceat(np.logical_or.reduceat(near[np.ix_(oa, ob)], sa, 0), sb, 1)
            for i, j in spanning_forest(parts):
                src.append(ra[fa[i]])
                dst.append(rb[fb[j]])
        counted = [(reps[n > 0], n[n > 0]) for reps, *_, n in known.values()]
        rows = [*zip(src, dst, [0] * len(src)), *[(int(r), None, int(n)) for reps, ns in counted for r, n in zip(reps, ns)]]
        return pd.DataFrame(rows, columns=["src", "dst", "links"]).astype("Int64")

    tiled = materialize(tiled_pairs(pairs, leaves))

    def wave(at: int) -> DataFrame:
        part = tiled.where(F.col("ta").between(at, at + WAVE - 1))
        shipped = shipped_leaves(part, leaves).withColumnsRenamed({c: f"{c}_of" for c in TILES})
        return part.groupBy(*TILES).cogroup(shipped.groupBy(*[f"{c}_of" for c in TILES])).applyInPandas(compare, "src long, dst long, links long")

    last = tiled.agg(F.max("ta")).first()[0] or 0
    return reduce(DataFrame.unionByName, [settled(tiled.sparkSession, lambda at=at: wave(at)) for at in range(0, last + 1, WAVE)])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark = vectors.sparkSession
    return settled(spark, lambda: _near_vectors(spark, vectors, threshold))


def _near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float) -> DataFrame:
    rows = vectors.select("vec_id", "label", "embedding", (usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("fit"))
    classes = materialize(rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")))
    # In hexadecimal, so that no label holds the dots of a path and different labels never share a root.
    root = F.concat_ws("/", F.hex(F.col("label").cast("string").cast("binary")), F.size("embedding").cast("string"))
    narrow = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    points = classes.select("rep", "m", root.alias("node"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("v"))
    # What each step writes on its way goes with it, vectors above all.
    leaves = settled(spark, lambda: pack(split_nodes(points), threshold))
    pairs, above = upper_pairs(leaves, (2 - 2 * threshold) ** 0.5)
    above, compared = materialize(above), compare_leaves(pairs, leaves, threshold, _precision(points.schema["v"].dataType))
    member = F.explode(F.arrays_zip("reps", "own", F.transform("roots", lambda k: F.element_at("reps", k + 1)).alias("root"))).alias("p")
    inside = materialize(leaves.select("node", F.col("rep").alias("first"), member).select("node", "first", F.col("p.reps").alias("rep"), F.col("p.own").alias("own"), F.col("p.root").alias("root")))
    gained = inside.join(above.groupBy(F.col("leaf").alias("node")).agg(F.sum("gain").alias("gain")), "node", "left")
    counts = gained.select(F.col("rep").alias("src"), (F.col("own") + F.coalesce("gain", F.lit(0))).alias("links")).unionByName(compared.where("dst is null").select("src", "links"))
    counts = counts.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    # Points of a leaf that is linked throughout with something meet in its first point; that links to the other's.
    edges = [inside.select(F.col("rep").alias("src"), F.col("root").alias("dst")), gained.where("gain is not null").select(F.col("rep").alias("src"), F.col("first").alias("dst"))]
    edges += [compared.where("dst is not null").select("src", "dst"), leaves.select(F.col("node").alias("leaf"), F.col("rep").alias("src")).join(above.select("leaf", F.col("rep").alias("dst")), "leaf").select("src", "dst")]
    linked = connected_components(edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3]))
    known = classes.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    # Written, so that both sides of the join come straight from a shuffle and a vector with very many copies can be split.
    known = materialize(known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    alike = rows.where("fit").join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alike.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
