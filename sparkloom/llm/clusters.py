"""Clusters of similar records by bisecting k-means; dense groups of any shape as chains of its leaves.

1. Bisecting k-means divides the points into compact leaves. All points are one node; the node of the largest dispersion
   is split in two, again and again, until every node keeps the compactness limit. Nodes of more than ``per_task`` points are split
   across the cluster: a round splits the ``per_round`` nodes of largest dispersion among them, in two passes that sum, per node, count, mean,
   covariance and radius inside the tasks. Smaller nodes are each sent to one task as a whole, which goes on splitting them, the
   one of largest dispersion first. Points of nodes that are done take no further part.
2. Leaves are the clusters of bisecting k-means: ``describe_leaves`` reports their sizes and the members nearest to their centres.
3. A separate step on the leaves: those whose centres are within the link distance belong to one group, since a plain
   bisecting k-means cuts long or bent groups. Groups are separated by gaps wider than the link distance, or there would be no clear gap.

Bounds: whether a leaf is dense does not depend on the number of rows, so a group is found in a large table as in a small
one. The number of leaves is about that of the balls of the compactness limit that hold points; they are held by the driver and every task,
rows never are. A task of the second kind holds ``per_task`` points at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise

PER_TASK = 20_000
PER_ROUND = 1024
_LOCAL = 20  # bits of a leaf's number below those of the node it lies in

@dataclass
class Tree:
    """Nodes by number: centre, children (-1 for a leaf). Node 0 is the root."""

    centre: np.ndarray
    left: np.ndarray
    right: np.ndarray
    closed: set = field(default_factory=set)

    def assign(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.left[node] >= 0)
            if not len(inner):
                return node
            a, b = self.left[node[inner]], self.right[node[inner]]
            x = points[inner]
            node[inner] = np.where(((x - self.centre[a]) ** 2).sum(1) <= ((x - self.centre[b]) ** 2).sum(1), a, b)


def _pass(df: DataFrame, tree: Tree, wanted: set, dims: int) -> dict[int, tuple]:
    """node -> (count, mean, covariance, farthest squared distance from the node's centre) of the wanted nodes."""
    shipped = df.sparkSession.sparkContext.broadcast((tree.centre, tree.left, tree.right))  # the nodes of the tree, no rows
    keep = np.array(sorted(wanted))
    width = 2 + dims + dims * dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shipped.value)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            node = tree.assign(points)
            mine = np.isin(node, keep)
            points, node = points[mine], node[mine]
            order = np.argsort(node, kind="stable")
            points, node = points[order], node[order]
            for at, to in _runs(node):
                x, n = points[at:to], int(node[at])
                d = x - tree.centre[n]
                row = np.r_[len(x), (d * d).sum(1).max(), d.sum(0), (d.T @ d).ravel()]
                if n in sums:
                    farthest = max(sums[n][1], row[1])
                    sums[n] += row
                    sums[n][1] = farthest
                else:
                    sums[n] = row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([r.tolist() for r in sums.values()], pa.list_(pa.float64()))], ["node", "sums"])

    parts = df.mapInArrow(run, "node long, sums array<double>")
    columns: list[Column] = [F.max(F.col("sums")[1]).alias("s1") if i == 1 else F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    out = {}
    for r in parts.groupBy("node").agg(*columns).collect():
        v = np.array(r[1:], float)
        n, shift = v[0], v[2 : 2 + dims] / v[0]
        out[r.node] = (n, tree.centre[r.node] + shift, v[2 + dims :].reshape(dims, dims) / n - np.outer(shift, shift), v[1])
    shipped.unpersist()
    return out


def _runs(sorted_codes: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_codes):
        edges = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1], True])
        yield from zip(edges[:-1], edges[1:])


def _halves(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres to start from, on either side of the mean along the principal axis."""
    values, axes = np.linalg.eigh(cov)
    step = axes[:, -1] * np.sqrt(max(values[-1], 1e-18)) * 0.8
    return mean - step, mean + step


def bisect_local(x: np.ndarray, radius: float, min_count: int, lloyd: int = 2) -> np.ndarray:
    """Leaf number of each point, by bisecting k-means in memory: the node of the largest dispersion is split first."""
    leaf = np.zeros(len(x), np.int64)
    heap: list[tuple] = []
    made = 0

    def push(number: int, index: np.ndarray) -> None:
        if len(index) < min_count:
            return
        mean = x[index].mean(0)
        d = x[index] - mean
        square = (d * d).sum(1)
        if square.max() > radius * radius:
            heapq.heappush(heap, (-square.sum(), number, index, mean, d.T @ d / len(index)))

    push(0, np.lexsort(x.T))
    while heap:
        _, number, index, mean, cov = heapq.heappop(heap)
        a, b = _halves(mean, cov)
        points = x[index]
        for step in range(lloyd + 1):
            left = ((points - a) ** 2).sum(1) <= ((points - b) ** 2).sum(1)
            if left.all() or not left.any():
                break
            if step < lloyd:
                a, b = points[left].mean(0), points[~left].mean(0)
        if left.all() or not left.any():
            continue  # points that cannot be told apart
        made += 1
        leaf[index[~left]] = made
        push(number, index[left])
        push(made, index[~left])
    return leaf


def _split_large(points: DataFrame, radius: float, min_count: int, per_task: int, per_round: int) -> tuple[Tree, set[int]]:
    """(tree, its leaves that still must be split): nodes of more than ``per_task`` points split across the cluster until compact."""
    dims = len(points.columns)
    tree = Tree(np.zeros((1, dims)), np.array([-1]), np.array([-1]))
    stats = _pass(points, tree, {0}, dims)
    if 0 not in stats:
        return tree, set()
    tree.centre[0] = stats[0][1]
    stats = _pass(points, tree, {0}, dims)

    def wide(n: int) -> bool:
        return tree.left[n] < 0 and n not in tree.closed and stats[n][3] > radius * radius and stats[n][0] >= min_count

    while True:
        large = [n for n in stats if wide(n) and stats[n][0] > per_task]
        if not large:
            return tree, {n for n in stats if wide(n)}
        large.sort(key=lambda n: (-np.trace(stats[n][2]) * stats[n][0], n))  # the largest dispersion first
        split = large[:per_round]
        at, halves = len(tree.left), []
        tree.left, tree.right = (np.r_[side, np.full(2 * len(split), -1)] for side in (tree.left, tree.right))
        for n in split:
            halves += _halves(stats[n][1], stats[n][2])
            tree.left[n], tree.right[n] = at, at + 1
            at += 2
        tree.centre = np.vstack([tree.centre, *halves])
        young = {int(c) for n in split for c in (tree.left[n], tree.right[n])}
        for c, found in _pass(points, tree, young, dims).items():
            tree.centre[c] = found[1]
        found = _pass(points, tree, young, dims)
        stats |= found
        for n in split:  # all points in one half: identical points, or a tie; no further split is possible
            a, b = int(tree.left[n]), int(tree.right[n])
            if a not in found or b not in found:
                tree.closed |= {a, b}


def bisect(rows: DataFrame, names: list[str], radius: float, min_count: int = 4, per_task: int = PER_TASK, per_round: int = PER_ROUND) -> DataFrame:
    """id, the features ``names`` (doubles, no nulls) and the leaf of every row of ``rows`` (id and features), by bisecting k-means.

    A node is split while its farthest point is more than ``radius`` from its centre and it holds at least
    ``min_count`` points. An empty input gives no rows.
    """
    tree, wide = _split_large(rows.select(*names), radius, min_count, per_task, per_round)
    shipped = rows.sparkSession.sparkContext.broadcast((tree.centre, tree.left, tree.right))  # nodes of the tree, no rows
    open_nodes = np.array(sorted(wide), np.int64)

    def place(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Tree(*shipped.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                node = tree.assign(points)
                mine = np.isin(node, open_nodes) == inside
                kept = batch.filter(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(node[mine] << _LOCAL)], [*kept.schema.names, "leaf"])

        return run

    def split(table: pa.Table) -> pa.Table:
        x = np.column_stack([table[n].to_numpy() for n in names])
        return table.set_column(table.schema.get_field_index("leaf"), "leaf", pa.array(table["leaf"].to_numpy() + bisect_local(x, radius, min_count)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", leaf long"
    done = rows.mapInArrow(place(False), schema)
    return done.unionAll(rows.mapInArrow(place(True), schema).groupBy("leaf").applyInArrow(split, schema))


def link_leaves(centres: np.ndarray, weights: np.ndarray, link: float) -> np.ndarray:
    """Cluster number of each leaf: components of leaves whose centres are within ``link``, heaviest cluster first.

    Leaves are hashed into cells of the link distance, so only neighbouring cells are compared.
    """
    n, dims = centres.shape
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    cells: dict[tuple, list[int]] = {}
    for i, cell in enumerate(map(tuple, np.floor(centres / link).astype(np.int64))):
        cells.setdefault(cell, []).append(i)
    offsets = np.stack(np.meshgrid(*[(-1, 0, 1)] * dims), -1).reshape(-1, dims)
    for cell, members in cells.items():
        near = [j for o in offsets for j in cells.get(tuple(np.array(cell) + o), ())]
        for i in members:
            for j in np.array(near)[((centres[near] - centres[i]) ** 2).sum(1) <= link * link]:
                root[find(i)] = find(int(j))
    roots = np.array([find(i) for i in range(n)], np.int64)
    heavy = np.flatnonzero(np.bincount(roots, minlength=n))
    sums = np.bincount(roots, weights, n)
    heavy = sorted(heavy.tolist(), key=lambda r: (-sums[r], r))
    number = {r: k for k, r in enumerate(heavy)}
    return np.array([number[r] for r in roots], np.int64)


def cluster(rows: DataFrame, id_col: str, features: list[Column], radius: float = 0.15, link: float = 0.6, min_count: int = 4, min_cluster: int = 10, per_task: int = PER_TASK) -> DataFrame:
    """id, cluster, leaf, distance of every row; cluster is null for isolated rows.

    ``features`` are columns on comparable scales in which clusters are separated by gaps wider than ``link``.
    Rows with a null or NaN feature or a null id are left out (clean impossible values to null first). A leaf with
    fewer than ``min_count`` rows is sparse; rows of sparse leaves belong to the cluster of a dense
    leaf within ``link`` of them, else they are isolated. Components of fewer than ``min_cluster`` rows are no cluster.
    distance is to the centre of the row's leaf. Equal rows get equal clusters; an empty input gives no rows.
    """
    names = [f"x{i}" for i in range(len(features))]
    data = rows.select(F.col(id_col).alias("id"), *[f.cast("double").alias(n) for f, n in zip(features, names)])
    for n in names:
        data = data.withColumn(n, F.when(F.abs(F.col(n)) < float("inf"), F.nanvl(F.col(n), F.lit(None).cast("double"))))
    data = data.na.drop("any").persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks are computed again
    placed = materialise(bisect(data, names, radius, min_count, per_task), "leaves")
    data.unpersist()
    found = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names]).toArrow().sort_by("leaf")  # one row per leaf
    leaves, weights = found["leaf"].to_numpy(), found["n"].to_numpy()
    middle = np.column_stack([found[n].to_numpy() for n in names]).reshape(-1, len(names))
    is_dense = weights >= min_count
    groups = link_leaves(middle[is_dense], weights[is_dense], link)
    small = np.bincount(groups, weights[is_dense], 1) < min_cluster
    of_leaf = np.full(len(leaves), -1, np.int64)
    of_leaf[is_dense] = np.where(small[groups], -1, groups)
    model = placed.sparkSession.sparkContext.broadcast((leaves, middle, of_leaf, is_dense))  # one entry per leaf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, middle, of_leaf, is_dense = model.value
        centres, of_centre = middle[is_dense], of_leaf[is_dense]
        cells: dict[tuple, list[int]] = {}  # only centres of the cells around a point can be within the link distance
        for i, cell in enumerate(map(tuple, np.floor(centres / link).astype(np.int64))):
            cells.setdefault(cell, []).append(i)
        around = np.stack(np.meshgrid(*[(-1, 0, 1)] * len(names)), -1).reshape(-1, len(names))
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            at = np.searchsorted(leaves, batch.column("leaf").to_numpy())
            cluster = of_leaf[at]
            distance = np.sqrt(((points - middle[at]) ** 2).sum(1))
            for i in np.flatnonzero(~is_dense[at]) if len(centres) else ():
                near = sorted(j for cell in map(tuple, np.floor(points[i] / link).astype(np.int64) + around) for j in cells.get(cell, ()))
                d = ((centres[near] - points[i]) ** 2).sum(1)
                if near and d.min() <= link * link:
                    cluster[i] = of_centre[near[d.argmin()]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32(), mask=cluster < 0), batch.column("leaf"), pa.array(distance)], ["id", "cluster", "leaf", "distance"])

    return placed.mapInArrow(run, f"id {dict(placed.dtypes)['id']}, cluster int, leaf long, distance double")


def describe_leaves(assigned: DataFrame, typical: int = 3) -> DataFrame:
    """leaf, cluster, size, radius, members: each leaf of the bisecting k-means with the ``typical`` members nearest to its centre, ties by id.

    cluster is the group most of its rows belong to (a row of a sparse leaf may belong to a neighbour's), null if they are isolated.
    """
    size = assigned.groupBy("leaf").agg(F.mode("cluster", True).alias("cluster"), F.count(F.lit(1)).alias("size"), F.max("distance").alias("radius"))
    ranked = assigned.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy("distance", "id"))).filter(F.col("rank") <= typical)
    members = ranked.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m"))
    return size.join(members, "leaf").select("leaf", "cluster", "size", "radius", F.expr("transform(m, x -> x.id)").alias("members"))


def describe(assigned: DataFrame, typical: int = 3) -> DataFrame:
    """cluster, size, leaves, members: each cluster with its ``typical`` most typical members.

    The most typical are those nearest to the centre of the cluster's heaviest leaf, ties by id.
    """
    leaves = assigned.filter("cluster is not null").groupBy("cluster", "leaf").agg(F.count(F.lit(1)).alias("n"))
    heaviest = leaves.groupBy("cluster").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("leaves"), F.max(F.struct("n", (-F.col("leaf")).alias("order"), "leaf"))["leaf"].alias("leaf"))
    # the row_number filter is pushed below the shuffle as a top-k per task (WindowGroupLimit)
    near = assigned.join(F.broadcast(heaviest.select("cluster", "leaf")), ["cluster", "leaf"])  # one row per cluster
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id"))).filter(F.col("rank") <= typical)
    members = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m"))
    return heaviest.join(members, "cluster").select("cluster", "size", F.col("leaves").cast("long").alias("leaves"), F.expr("transform(m, x -> x.id)").alias("members"))
