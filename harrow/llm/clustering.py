"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round the driver builds a tree over the k centroids and broadcasts it: a node holds one centroid, the nearer half
of the others under it and the farther half, each with the range of their distances to it. A vector visits nodes best
first, by a lower bound of its distance to all that lies under a node, and stops when no open node's bound is within
its best distance; a bound equal to it is still visited, as a tie goes to the smaller number. Distances to centroids
are exact integers. Bounds are floating-point roots, so they are lowered by more than their error.

Vectors of a batch are searched together: every vector has its own queue of open nodes, and each step takes the best
node of each vector that is not done. Tasks hand on one sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored
from .vectors import integers, matrix, quoted

SCALE, WIDTH, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Vectors searched together.
TOGETHER = 4096
#: Relative error that a bound is lowered by; roots and differences of distances are exact to about 1e-15.
SLACK = 1e-12


@dataclass
class VantageTree:
    """Nodes by number: the node's centroid, its two children (-1: none) and their least and largest distances to it."""

    points: np.ndarray
    owner: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> VantageTree:
        """Node 0 is the root; the vantage point of a set is its member with the smallest number."""
        k = len(points)
        owner, child = np.zeros(k, np.int64), np.full((k, 2), -1)
        low, high = np.zeros((k, 2)), np.zeros((k, 2))
        waiting, made = [(np.arange(k), -1, 0)], 0
        while waiting:
            members, parent, side = waiting.pop()
            node, made = made, made + 1
            owner[node] = members[0]
            if parent >= 0:
                child[parent, side] = node
            if not len(rest := members[1:]):
                continue
            far = np.sqrt(((points[rest] - points[members[0]]) ** 2).sum(1).astype(np.float64))
            order = np.argsort(far, kind="stable")
            for part, at in enumerate(np.array_split(order, 2)):
                if len(at):
                    low[node, part], high[node, part] = far[at].min(), far[at].max()
                    waiting.append((np.sort(rest[at]), node, part))
        return cls(points, owner, child, low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and exact squared distance of the nearest centroid of each row, and how many distances were taken."""
        n = len(x)
        best, label = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        # open nodes of each vector and their bounds; a visit closes one node and opens two at most
        nodes, bounds = np.zeros((n, 2), np.int64), np.full((n, 2), np.inf)
        bounds[:, 0] = 0.0
        active, used, taken = np.arange(n), 1, 0
        while len(active):
            pick = bounds[active, :used].argmin(1)
            bound = bounds[active, pick]
            # inclusive: a bound equal to the best distance may hide a tie with a smaller number
            go = bound <= np.sqrt(best[active].astype(np.float64)) * (1 + SLACK)
            active, pick, bound = active[go], pick[go], bound[go]
            if not len(active):
                break
            node = nodes[active, pick]
            bounds[active, pick] = np.inf
            owner = self.owner[node]
            squared = ((x[active] - self.points[owner]) ** 2).sum(1)
            taken += len(active)
            better = (squared < best[active]) | ((squared == best[active]) & (owner < label[active]))
            best[active[better]], label[active[better]] = squared[better], owner[better]
            away = np.sqrt(squared.astype(np.float64))[:, None]
            gap = np.maximum(self.low[node] - away, away - self.high[node]) - SLACK * (away + self.high[node])
            gap = np.maximum(np.maximum(gap, 0.0), bound[:, None])
            gap[self.child[node] < 0] = np.inf
            if used + 2 > nodes.shape[1]:
                nodes = np.concatenate([nodes, np.zeros_like(nodes)], 1)
                bounds = np.concatenate([bounds, np.full_like(bounds, np.inf)], 1)
            nodes[active, used], nodes[active, pick] = self.child[node, 0], self.child[node, 1]
            bounds[active, used], bounds[active, pick] = gap[:, 0], gap[:, 1]
            used += 1
        return label, best, taken


def _found(batches: Iterator[pa.RecordBatch], tree: VantageTree, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches in parts of TOGETHER rows, with vectors, labels and distances; ``at`` is the vectors' column."""
    for batch in batches:
        for first in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(first, TOGETHER)
            x = matrix(part.column(at), tree.points.shape[1])
            yield part, x, *tree.nearest(x)[:2]


def _sums(tree):
    """Vectors -> one row per centroid that has any in the task: its number, count and component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = tree.value.points
        count, total = np.zeros(len(points), np.int64), np.zeros(points.shape, np.int64)
        for _, x, label, _ in _found(batches, tree.value, 0):
            count += np.bincount(label, minlength=len(points))
            for c in np.unique(label):
                total[c] += x[label == c].sum(0)
        full = np.flatnonzero(count)
        ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * points.shape[1])
        sums = pa.ListArray.from_arrays(ends, pa.array(total[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), sums], names=["cluster", "n", "sums"])

    return run


def _labelled(tree):
    """(id, vectors) -> (id, cluster, distance)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, label, best in _found(batches, tree.value, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """Vectors of the ``clusters`` rows with the smallest SHA-256 of ``salt`` and the decimal id; a null id comes last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    top = rows.orderBy(key.asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in top], np.int64)


def next_centroids(rows: DataFrame, points: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of the vectors that are nearest to it; one without any stays.

    Tasks send a row per centroid, which are added up by centroid and component; k rows reach the driver.
    """
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree.over(points))
    parts = rows.select("x").mapInArrow(_sums(tree), "cluster long, n long, sums array<long>")
    width = range(points.shape[1])
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in width))
    out = points.copy()
    for row in total.collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in width]
    tree.unpersist()
    return out


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    salt: str = "3:",
) -> DataFrame:
    """Per kept vector: id, ``cluster``, squared ``distance``, the sums of distances over its cluster
    (``cluster_inertia``) and over all (``inertia``), and ``centroid_sha256`` of its final centroid.

    Kept are vectors of ``width`` components, none of them null or not finite. Null ids are kept, and come last among
    the first centroids; rows that repeat an id and a vector are rows of their own, and may be several of the first
    centroids. With fewer vectors than ``clusters`` there are as many centroids as vectors; equal centroids leave all
    vectors to the smaller number. Other columns are ignored; an empty table gives an empty result. A component beyond
    ``LARGEST / scale`` stops the job. The centroids are all that is broadcast: ``clusters`` times ``width`` numbers.
    """
    spark = vectors.sparkSession
    right = F.size(quoted(vector_col)) == width
    kept = integers(vectors.where(right), vector_col, scale, quoted(id_col).alias("id"))
    rows = stored(kept, "cluster-vectors")
    points = first_centroids(rows, clusters, salt)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(points):
        empty = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        moved = next_centroids(rows, points)
        if (moved == points).all():
            break  # all later rounds give the same
        points = moved
    tree = spark.sparkContext.broadcast(VantageTree.over(points))
    found = stored(rows.mapInArrow(_labelled(tree), f"id {kind}, cluster int, distance long"), "cluster-labels")
    discard(rows)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    inertia = sum(r["cluster_inertia"] for r in sums)
    digest = lambda p: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()
    facts = [(r["cluster"], r["cluster_inertia"], inertia, digest(points[r["cluster"]].tolist())) for r in sums]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(per), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
