"""Exact near-duplicate embeddings by cover trees and their dual traversal.

Vectors of one label are split by nearest pivot, again and again, into cells that fit a task; the splits form a
tree of cells, each with a center and a covering radius. That tree is traversed against itself, level by level:
of a pair of cells the children's pairs go on unless they lie too far apart for their radii. Each cell has a
cover tree: nested levels whose covering radii halve, a node covering its members within its radius. The
pairs of cells that are left are traversed from both roots in the same way, down to pairs of vectors; node
pairs that lie close enough are taken whole. What leaves a task is a count per vector and a spanning forest of
the links, not the pairs.

Vectors of one direction are one node with a multiplicity. Vectors that are null, empty, zero or hold null or
non-finite components, and those with a null label, link with nothing and stay alone; so do vectors of
different lengths. Repeated rows link with one another. A row without a key links like any other; it is kept if
its component has no key. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, stash, temporary
from .graph import components

COSINE = 0.98
#: Members of a cell at most; pivots of a split, about: at least and at most.
CELL, LEAST_PIVOTS, PIVOTS = 2048, 6, 32
#: Members of a tree node that isn't split further.
LEAF = 64
#: By how much bounds may be off: distances come from dot products, whose rounding they magnify.
SLACK = 1e-6
#: Dot products with pivots that count as equal.
TIE = 1e-12


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class CoverTree:
    """Node i: center[i], a member; radius[i]; members order[first[i]:last[i]]; children, empty for leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.center, self.radius, self.first, self.last, self.children = [], [], [], [], []
        away = self._away(0, self.order)
        self._build(0, self.order, away, 0)

    def _away(self, i: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.points[members] @ self.points[i])))

    def _node(self, center: int, radius: float, at: int, size: int) -> int:
        for column, x in ((self.center, center), (self.radius, radius), (self.first, at), (self.last, at + size), (self.children, [])):
            column.append(x)
        return len(self.center) - 1

    def _build(self, center: int, members: np.ndarray, away: np.ndarray, at: int) -> int:
        """members in any order with their distances from center; their final places start at `at`."""
        todo = [(None, center, members, away, at)]
        while todo:
            parent, center, members, away, at = todo.pop()
            radius = float(away.max(initial=0.0))
            node = self._node(center, radius, at, len(members))
            if parent is not None:
                self.children[parent].append(node)
            self.order[at : at + len(members)] = members
            if len(members) <= LEAF or radius < 1e-6:
                continue
            left, distance, next_center = members, away, center
            while len(left):  # a net of half the radius; the node's own center comes first
                near = distance <= radius / 2
                near[left == next_center] = True
                todo.append((node, next_center, left[near], distance[near], at))
                at += int(near.sum())
                left = left[~near]
                if len(left):
                    next_center = int(left[0])
                    distance = self._away(next_center, left)
        return 0


class Links:
    """Counts and a forest over the members of one tree, or of two side by side."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))

    def add(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        self.counts[rows] += linked @ self.weights[columns]
        self.counts[columns] += self.weights[rows] @ linked
        self._join(rows, columns, linked)

    def add_same(self, rows: np.ndarray, linked: np.ndarray) -> None:
        np.fill_diagonal(linked, False)
        self.counts[rows] += linked @ self.weights[rows]
        self._join(rows, rows, linked)

    def _join(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        for i in np.flatnonzero(linked.any(1)).tolist():
            labels = np.append(self.label[columns[linked[i]]], self.label[rows[i]])
            least = labels.min()
            if labels.max() != least:
                self.label[np.isin(self.label, labels)] = least

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def traverse(a: CoverTree, b: CoverTree | None, links: Links, cosine: float) -> None:
    """Adds every pair of members within the cosine; b None: the pairs inside a. b's members count from len(a.points)."""
    far = np.sqrt(2 - 2 * cosine) + SLACK
    sure = np.sqrt(2 - 2 * cosine) - SLACK
    same, shift = b is None, 0 if b is None else len(a.points)
    b = a if same else b
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        inside = same and x == y
        p, q = a.order[a.first[x] : a.last[x]], b.order[b.first[y] : b.last[y]]
        apart = float(np.sqrt(max(0.0, 2 - 2 * float(a.points[a.center[x]] @ b.points[b.center[y]]))))
        if not inside and apart > a.radius[x] + b.radius[y] + far:
            continue
        close = (2 * a.radius[x] if inside else apart + a.radius[x] + b.radius[y]) <= sure
        if close or not (a.children[x] or b.children[y]) or len(p) * len(q) <= LEAF * LEAF * 4:
            linked = np.ones((len(p), len(q)), bool) if close else a.points[p] @ b.points[q].T >= cosine
            links.add_same(p, linked) if inside else links.add(p, q + shift, linked)
            continue
        if inside:
            kids = others = a.children[x]
        elif not b.children[y] or a.children[x] and a.radius[x] >= b.radius[y]:
            kids, others = a.children[x], [y]
        else:
            kids, others = [x], b.children[y]
        u, v = np.array(kids), np.array(others)
        gap = np.sqrt(np.maximum(0, 2 - 2 * (a.points[_take(a.center, u)] @ b.points[_take(b.center, v)].T)))
        alive = gap <= _take(a.radius, u)[:, None] + _take(b.radius, v)[None, :] + far
        if inside:
            alive = np.triu(alive)
            alive[np.diag_indices(len(u))] = _sizes(a, u) > 1
        single = np.outer(_sizes(a, u) == 1, _sizes(b, v) == 1)
        both = np.argwhere(alive & single)
        for i in np.unique(both[:, 0]).tolist():  # pairs of single members are decided here
            j = both[both[:, 0] == i, 1]
            row, columns = _take(a.center, u[[i]]), _take(b.center, v[j])
            linked = (a.points[row] @ b.points[columns].T) >= cosine
            if linked.any():
                links.add(row, columns + shift, linked)
        todo += [(int(u[i]), int(v[j])) for i, j in np.argwhere(alive & ~single).tolist()]


def _take(values: list, at: np.ndarray) -> np.ndarray:
    return np.array([values[i] for i in at.tolist()])


def _sizes(tree: CoverTree, at: np.ndarray) -> np.ndarray:
    return _take(tree.last, at) - _take(tree.first, at)


def split(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """points with `cell` refined until no cell holds more than CELL of them; the splits, as (parent, cell, center, radius).

    Pivots are drawn by a hash of the node and the round, so a round that draws too few in a cell is
    followed by another draw. Points that lie as near to several pivots are dealt among these, so every split
    makes cells smaller, however close its points are.
    """
    splits: list[DataFrame] = []
    turn = 0
    while True:
        turn += 1
        sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
        sizes = stash(sizes, "sizes")
        if not sizes.head(1):
            return points, splits
        wanted = F.greatest(F.lit(float(LEAST_PIVOTS)), F.least(F.lit(float(PIVOTS)), F.ceil(2 * F.col("n") / F.lit(CELL)))) / F.col("n")
        chance = F.pmod(F.xxhash64("node", "cell", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = points.join(sizes, "cell").where(chance < wanted).groupBy("cell").agg(F.collect_list("vector").alias("pivots"))
        chosen = stash(chosen.where(F.size("pivots") > 1), "pivots")  # about PIVOTS of each cell
        columns = points.columns
        schema = T.StructType([*points.schema, T.StructField("parent", T.LongType()), T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())])

        def step(rows: dict) -> dict:
            out = {n: list(rows[n]) for n in columns} | {n: [None] * len(rows["cell"]) for n in ("parent", "pivot", "away")}
            by_cell: dict[int, list[int]] = {}
            for i, p in enumerate(rows["pivots"]):
                if p:
                    by_cell.setdefault(rows["cell"][i], []).append(i)
            for cell, at in by_cell.items():
                dots = unit(np.array([rows["vector"][i] for i in at])) @ unit(np.array(rows["pivots"][at[0]])).T
                best = nearest(dots, np.array([rows["node"][i] for i in at]), turn)
                for i, k, d in zip(at, best.tolist(), dots[np.arange(len(at)), best].tolist()):
                    out["cell"][i], out["parent"][i], out["pivot"][i], out["away"][i] = _child(cell, k), cell, k, max(0.0, 2 - 2 * d) ** 0.5
            return out

        refined = points.join(chosen, "cell", "left").select(*columns, "pivots")
        refined = stash(_by_batches(refined, step, schema), "cells")
        made = refined.where("parent is not null").groupBy("parent", "cell", "pivot").agg(F.max("away").alias("radius"))
        made = made.join(chosen.withColumnRenamed("cell", "of"), F.col("parent") == F.col("of"))
        splits.append(stash(made.select("parent", "cell", unit_of(F.element_at("pivots", F.col("pivot") + 1)).alias("center"), "radius"), "splits"))
        points = refined.select(*columns)


def nearest(dots: np.ndarray, nodes: np.ndarray, turn: int) -> np.ndarray:
    """Per row the place of the largest dot product; of several that count as equal one by the node's number."""
    tied = dots >= dots.max(1, keepdims=True) - TIE
    drawn = (nodes.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    wanted = (drawn % tied.sum(1).astype(np.uint64)).astype(np.int64)
    return (np.cumsum(tied, axis=1) > wanted[:, None]).argmax(1)


def scaled_of(vector):
    """The vector by its largest component: the same doubles for all vectors of one direction that are multiples of one another."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.element_at(F.transform(F.array(F.array_max(F.transform(wide, F.abs))), lambda most: F.transform(wide, lambda x: x / most)), 1)


def unit_of(vector):
    scaled = scaled_of(vector)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(scaled), lambda v: F.transform(v, lambda x: x / length(v))), 1)


def _child(cell: int, k: int) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(f"{cell}/{k}")).view(np.int64))


def _by_batches(df: DataFrame, step, schema: T.StructType) -> DataFrame:
    return map_arrow(df.withColumn("_size", F.lit("x" * 256)), step, schema, "_size", 256 * 1024)


def cells_of(points: DataFrame) -> DataFrame:
    """One row per cell: its number, and the pickled tree with nodes and weights."""
    schema = "cell long, tree binary"

    def build(rows: pa.Table) -> pa.Table:
        given = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        tree = CoverTree(unit(given))
        tree.points = given  # as stored: half the bytes; scaled again on arrival
        packed = pickle.dumps((tree, np.array(rows.column("node").to_pylist()), np.array(rows.column("copies").to_pylist())))
        return pa.table({"cell": rows.column("cell")[:1].to_pylist(), "tree": [packed]})

    return points.groupBy("cell").applyInArrow(build, schema)


def meetings(roots: DataFrame, splits: list[DataFrame], cosine: float) -> DataFrame:
    """(a, b), a <= b, of undivided cells that may have links, by traversing the tree of cells against itself."""
    frontier = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    if not splits:
        return frontier
    tree = splits[0]
    for x in splits[1:]:
        tree = tree.union(x)
    known = roots.select("cell", F.lit(None).cast("array<double>").alias("center"), F.lit(None).cast("double").alias("radius")).union(tree.drop("parent"))
    ends = known.join(tree.select(F.col("parent").alias("of")).distinct(), F.col("cell") == F.col("of"), "left_anti")
    below = stash(tree.select(F.col("parent").alias("of"), "cell", "center", "radius").union(ends.select(F.col("cell").alias("of"), "cell", "center", "radius")), "tree")
    dot = F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    reach = F.col("radius_a") + F.col("radius_b") + F.lit(float(np.sqrt(2 - 2 * cosine)) + SLACK)
    for _ in splits:  # as many levels at most
        left, right = (below.toDF(*(f"{c}_{side}" for c in below.columns)) for side in "ab")
        met = frontier.join(left, F.col("a") == F.col("of_a")).join(right, F.col("b") == F.col("of_b"))
        met = met.where((F.col("a") < F.col("b")) | (F.col("cell_a") <= F.col("cell_b"))).where((F.col("cell_a") == F.col("cell_b")) | (apart <= reach))
        frontier = stash(met.select(F.least("cell_a", "cell_b").alias("a"), F.greatest("cell_a", "cell_b").alias("b")), "meetings")
    return frontier


def link(points: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(node, n) partial counts and (a, b) edges of points (node, label, vector, copies)."""
    placed = points.withColumn("cell", F.xxhash64("label", F.size("vector"))).select("node", "vector", "copies", "cell")
    roots = stash(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "roots")
    placed, splits = split(placed)
    trees = stash(cells_of(placed), "trees")
    met = meetings(roots, splits, cosine).toDF("cell_a", "cell_b")
    work = met.join(trees.select(F.col("cell").alias("cell_a"), F.col("tree").alias("tree_a")), "cell_a")
    other = trees.select(F.col("cell").alias("cell_b"), F.col("tree").alias("tree_b"))
    work = work.join(other, "cell_b")
    schema = "node long, n long, root long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a, nodes, copies = pickle.loads(row["tree_a"])
                a.points, b = unit(a.points), None
                if row["cell_a"] != row["cell_b"]:
                    b, more, extra = pickle.loads(row["tree_b"])
                    b.points = unit(b.points)
                    nodes, copies = np.append(nodes, more), np.append(copies, extra)
                links = Links(copies)
                traverse(a, b, links, cosine)
                some = np.flatnonzero(links.counts)
                yield pa.record_batch([pa.array(nodes[some]), pa.array(links.counts[some]), pa.array(nodes[links.label[some]])], names=["node", "n", "root"])

    found = stash(work.mapInArrow(run, schema), "links")
    return found.select("node", "n"), found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def valid(label: str, vector: str):
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))


def classes(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id (smallest key reachable) and kept of every row."""
    rows = df.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), valid(label, vector).alias("_valid"))
    good = rows.where("_valid").drop("_valid").withColumn("scaled", scaled_of(F.col("vector")))
    with temporary() as keep:
        distinct = good.groupBy("label", "scaled").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        distinct = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
        counts, edges = link(distinct.select("node", "label", "vector", "copies"), cosine)
        near = counts.groupBy("node").agg(F.sum("n").alias("n"))
        rooted = distinct.join(near, "node", "left").join(components(edges).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        rooted = stash(rooted.select("label", "scaled", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
        # Written, so that the join shuffles both sides anew and can split a large component; likewise many vectors of one direction.
        smallest = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
        found = keep(rooted.join(smallest, "root").select("label", "scaled", "n_links", "component_id"), "found")
    done = good.join(found, ["label", "scaled"]).select("_key", "n_links", "component_id")
    alone = rows.where("not _valid").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return done.union(alone).select(F.col("_key").alias(key), "n_links", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))
