"""Approximate nearest neighbours: stable random projections, kd-trees on them, and a chi-square stopping test.

Gaussian projections are 2-stable: for a vector at true distance d, the squared projected distance over d*d follows a
chi-square law with as many degrees of freedom as there are projections. So a true neighbour within the distance of the k-th
found has, with probability ``confidence``, a squared projected distance of at most quantile(confidence) times that distance
squared. A query takes kd-tree leaves, and the points in them, by projected distance, verifies those within that limit on the
original components, and stops when no leaf is within it. The limit shrinks with every better k-th.

* Cells: a coarse kd-tree is cut on at most SAMPLE projected vectors (those of the smallest hashes); every index row is dealt
  to its cell. A query searches its own cell first; that gives a bound, and then it goes only to the cells whose region is
  within the limit of it. Where data are clustered that leaves few cells; where they fill the space (random vectors), most.
* A cell with many rows (repeated vectors, say) is dealt into parts of about ``block`` rows, the queries that come to a cell
  into blocks of ``query_block``; each pair is one group with a kd-tree of its own, so memory is bounded and nothing but the
  coarse tree (at most MAX_CELLS cuts) is broadcast. Only a query's k best of each group shuffle.

Distances are Euclidean in double precision; ties go to the smaller id. Vectors that are null, zero, of another length than
the most frequent one, or that hold a null or non-finite component take no part. Fewer candidates than k give fewer rows. A
repeated id counts as its own row; a query never meets rows of its id. Extra columns are ignored, whatever their names; an
empty index or no queries give an empty table.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

PROJECTIONS, LEAF, CONFIDENCE, SEED = 16, 128, 0.92, 29
BLOCK, QUERY_BLOCK = 16_384, 8_192
SAMPLE, MAX_CELLS = 20_000, 4_096


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    if x <= 0:
        return 0.0
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-min(x / 2, 700.0)) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, degrees) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, degrees) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of at most ``leaf`` points with their bounding boxes; cut at the median of the widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.children, self.rows, low, high = points, [], [], [], []

        def build(rows: np.ndarray) -> int:
            at = len(self.rows)
            box = points[rows]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            self.rows.append(rows)
            self.children.append(None)
            if len(rows) > leaf:
                axis = int(np.argmax(high[at] - low[at]))
                order = rows[np.argpartition(box[:, axis], len(rows) // 2)]
                self.rows[at] = None
                self.children[at] = (build(order[: len(rows) // 2]), build(order[len(rows) // 2 :]))
            return at

        build(np.arange(len(points)))
        self.low, self.high = np.array(low), np.array(high)

    def leaves(self, query: np.ndarray):
        """(squared projected distance to the leaf's box, its rows), nearest first."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        near = (gap * gap).sum(axis=1)
        heap = [(near[0], 0)]
        while heap:
            d, at = heapq.heappop(heap)
            if self.children[at] is None:
                yield d, self.rows[at]
            else:
                for c in self.children[at]:
                    heapq.heappush(heap, (near[c], c))


def search(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, q_id: int, q: np.ndarray, q_low: np.ndarray, k: int, limit: float, bound: float = math.inf):
    """The k nearest found: arrays of ids and distances, and how many vectors were verified. ``limit``: the chi-square quantile
    of the stopping test; ``bound``: a distance within which k others are known."""
    best_id, best_d, seen = np.zeros(0, np.int64), np.zeros(0), 0
    for near, rows in tree.leaves(q_low):
        reach = limit * min(bound, best_d[-1] if len(best_d) >= k else math.inf) ** 2
        if near > reach:
            break
        low = tree.points[rows] - q_low
        rows = rows[((low * low).sum(axis=1) <= reach) & (ids[rows] != q_id)]
        if len(rows):
            diff = vectors[rows] - q
            d = np.concatenate([best_d, np.sqrt((diff * diff).sum(axis=1))])
            i = np.concatenate([best_id, ids[rows]])
            order = np.lexsort((i, d))[:k]
            best_id, best_d, seen = i[order], d[order], seen + len(rows)
    return best_id, best_d, seen


class Cells:
    """A coarse kd-tree: cuts at medians of a sample. Its leaves are the cells, with their regions of the projected space."""

    def __init__(self, sample: np.ndarray, cells: int, projections: int):
        self.axis, self.value, self.below, low, high = [], [], [], [], []

        def grow(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: int) -> int:
            spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(projections)
            axis = int(np.argmax(spread)) if len(spread) else 0
            if wanted < 2 or len(points) < 2 or spread[axis] <= 0:
                low.append(lo)
                high.append(hi)
                return -len(low)
            at, cut = len(self.axis), float(np.median(points[:, axis]))
            if not (points[:, axis] < cut).any():  # half of the sample or more lies on the smallest value
                cut = float(points[points[:, axis] > cut, axis].min())
            self.axis.append(axis)
            self.value.append(cut)
            self.below.append((0, 0))
            left = points[:, axis] < cut
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[axis] = lo2[axis] = cut
            one = grow(points[left], lo, hi2, wanted // 2)
            self.below[at] = (one, grow(points[~left], lo2, hi, wanted - wanted // 2))
            return at

        self.root = grow(sample, np.full(projections, -np.inf), np.full(projections, np.inf), cells)
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.full(len(points), self.root, np.int64)
        axis, value, below = np.array(self.axis, np.int64), np.array(self.value), np.array(self.below, np.int64).reshape(-1, 2)
        while (going := np.flatnonzero(node >= 0)).size:
            n = node[going]
            node[going] = below[n, (points[going, axis[n]] >= value[n]).astype(int)]
        return -node - 1

    def within(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose region is within the squared distance of the point."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= reach)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of the vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(
        F.col("_id").isNotNull() & F.col("_v").isNotNull()
        & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
    return rows


def nearest(
    index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    projections: int = PROJECTIONS, confidence: float = CONFIDENCE, block: int = BLOCK, query_block: int = QUERY_BLOCK, verified: bool = False,
) -> DataFrame:
    """Per query row and rank: query_id, rank (from 1), id, score (distance); with ``verified`` also the number of vectors that
    were compared with the query's on their own components."""
    spark = index.sparkSession
    points, asked = usable(index, id_col, vector_col), usable(queries, id_col, vector_col)
    size = points.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    dims, rows = (size[0]["n"], size[0]["c"]) if size else (0, 0)
    points, asked = points.where(F.size("_v") == dims), asked.where(F.size("_v") == dims)
    share = min(1 << 30, int(SAMPLE / max(rows, 1) * (1 << 30)) + 1)
    sample = points.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < share).orderBy(F.xxhash64("_id", F.lit(5))).limit(SAMPLE).select("_v")
    project = np.random.default_rng(SEED).standard_normal((dims, projections))
    taken = sample.collect()  # at most SAMPLE rows
    fitted = np.array([r["_v"] for r in taken], float).reshape(len(taken), dims) @ project
    shared = spark.sparkContext.broadcast((Cells(fitted, min(MAX_CELLS, max(1, -(-rows // block))), projections), project))  # at most MAX_CELLS cuts
    limit = chi_square_quantile(confidence, projections)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        cells, project = shared.value
        return pd.Series(cells.of(np.stack(v.to_numpy()) @ project) if len(v) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def other_cells(v: pd.Series, bound: pd.Series, own: pd.Series) -> pd.Series:
        cells, project = shared.value
        low = np.stack(v.to_numpy()) @ project if len(v) else []
        return pd.Series([np.setdiff1d(cells.within(p, limit * b * b), [c]).astype("int32") for p, b, c in zip(low, bound, own, strict=True)], dtype=object)

    dealt = durable(points.withColumn("_cell", cell_of("_v")), "cells")
    asked = durable(asked.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", cell_of("_v")), "queries")
    parts = durable(dealt.groupBy("_cell").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("_parts")), "cell-parts")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_row": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "_seen": np.zeros(0, np.int64)})]
        if len(left) and len(right):
            ids, vectors, project = right["_id"].to_numpy(np.int64), np.stack(right["_v"].to_numpy()).astype(float), shared.value[1]
            tree = KdTree(vectors @ project)
            for row, q_id, v, bound in zip(left["_row"], left["_id"], left["_v"], left["_bound"], strict=True):
                v = np.asarray(v, float)
                found, score, seen = search(tree, ids, vectors, q_id, v, v @ project, k, limit, bound)
                if len(found) or seen:
                    out.append(pd.DataFrame({"_row": row, "query_id": q_id, "vec_id": found, "score": score, "_seen": np.where(np.arange(len(found)) == 0, seen, 0)}))
        return pd.concat(out)

    def visit(going: DataFrame) -> DataFrame:
        """going(_row, _id, _v, _cell, _bound): the k best of every part of the cell."""
        blocks = going.groupBy("_cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("_blocks")).join(parts, "_cell")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = going.join(blocks, "_cell").withColumn("_qb", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int")).withColumn("_part", each("_parts"))
        p = dealt.join(blocks, "_cell").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(2)), F.col("_parts")).cast("int")).withColumn("_qb", each("_blocks"))
        key = ["_cell", "_part", "_qb"]
        return q.select(*key, "_row", "_id", "_v", "_bound").groupBy(*key).cogroup(p.select(*key, "_id", "_v").groupBy(*key)).applyInPandas(
            run, "_row long, query_id long, vec_id long, score double, _seen long")

    first = durable(visit(asked.withColumn("_bound", F.lit(float("inf")))), "own-cell")
    kth = first.groupBy("_row").agg(F.get(F.array_sort(F.collect_list("score")), F.lit(k - 1)).alias("_b"))  # k of each part
    further = asked.join(kth, "_row", "left").withColumn("_bound", F.coalesce("_b", F.lit(float("inf")))).withColumn("_to", F.explode(other_cells("_v", "_bound", "_cell")))
    second = visit(further.select("_row", "_id", "_v", F.col("_to").alias("_cell"), "_bound"))
    both = durable(first.unionByName(second), "found")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("score", "vec_id"))
    best = both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    out = best.select("_row", "query_id", "rank", F.col("vec_id").alias(id_col), "score")
    if verified:
        out = out.join(both.groupBy("_row").agg(F.sum("_seen").alias("verified")), "_row")
    return out.drop("_row")
