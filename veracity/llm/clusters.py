"""Operator 12: centroid clustering with Exponion bounds.

Vectors of integers are assigned to the nearest of k centroids (squared Euclidean distance, ties: the smaller number). Each vector carries an upper bound of the
distance to its centroid and a lower bound of that to any other. Where these don't settle a round, only the
centroids in a ball around the present one are measured: with its nearest neighbour s away, all within 2u + s, found as a prefix of its
sorted list of centroids. Bounds are rounded outwards and the radius is inclusive, so that ties are measured; squared distances are exact integers.

A round is one pass that assigns and writes the vectors with their bounds, and one grouped sum over (cluster, dimension) of partial sums a task has made.
The driver holds k centroids. Earlier rounds are dropped.

Cases: vectors that are null, of another length, or hold null or non-finite entries are left out; components beyond
2^26 after scaling stand at it, so that squared distances fit a long (sums of distances beyond one are null); fewer vectors than k: each is a centroid; a missing id starts a
centroid last; of repeated ids the smaller vector starts first; equal centroids: the smaller number has the vectors, the other stays empty and where it is; repeated rows are assigned one by one; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import can_checkpoint, drop_folder, shared_folder

LENGTH, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest component; rows handled at once.
LARGEST, ROWS = 1 << 26, 8192
#: Roundings of bounds go outwards by this share.
SLACK = 1e-12
_STATE = "vec_id bigint, x array<int>, cluster int, distance bigint, upper double, lower double"


def usable(v: Column, length: int) -> Column:
    """Whether a vector has the length and only finite entries."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) == length) & ~bad, F.lit(False))


def quantised(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id, x: floor(scale * component) of the usable vectors of vectors(vec_id, embedding)."""
    x = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return vectors.where(usable(F.col("embedding"), length)).select("vec_id", x.alias("x"))


def first_centroids(points: DataFrame, k: int = K, seed: int = 1) -> list[list[int]]:
    """The k vectors of smallest sha256 of `seed:vec_id`, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in points.orderBy(order.asc_nulls_last(), "x").select("x").limit(k).collect()]


class Search:
    """Exponion search against fixed centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids.astype(np.int64)
        k = len(self.c)
        apart = np.sqrt(((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(2, dtype=np.int64).astype(float)) if k else np.zeros((0, 0))
        self.near = np.argsort(apart, axis=1, kind="stable")
        for i in range(k):  # equal centroids: each is the first of its own list
            self.near[i] = np.concatenate(([i], self.near[i][self.near[i] != i]))
        self.apart = np.take_along_axis(apart, self.near, 1) * (1 - SLACK)
        self.gap = self.apart[:, 1] if k > 1 else np.full(k, np.inf)  # to the nearest other centroid
        self.measured = 0

    def squared(self, x: np.ndarray, j: int) -> np.ndarray:
        self.measured += len(x)
        away = x - self.c[j]
        return np.einsum("ij,ij->i", away, away)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, upper, lower) of vectors with a centroid and bounds. A vector that its bounds settle has distance -1."""
        at, upper, lower = at.copy(), upper.copy(), lower.copy()
        best = np.full(len(x), -1, np.int64)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.gap[at] / 2))
        for a in np.unique(at[open_]):  # tighten, then the bounds again
            mine = open_[at[open_] == a]
            best[mine] = self.squared(x[mine], a)
        upper[open_] = np.sqrt(best[open_].astype(float)) * (1 + SLACK)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], self.gap[at[open_]] / 2)]
        for a in np.unique(at[open_]):
            mine = open_[at[open_] == a]
            radius = 2 * upper[mine] + self.gap[a] * (1 + 4 * SLACK)
            order = np.argsort(-radius)
            mine, radius = mine[order], radius[order]
            least, who = best[mine].copy(), np.full(len(mine), a)
            second = np.full(len(mine), np.iinfo(np.int64).max)
            for j, far in zip(self.near[a][1:], self.apart[a][1:], strict=True):
                n = int(np.searchsorted(-radius, -far, "right"))  # those whose ball reaches the centroid, its edge included
                if not n:
                    break
                d = self.squared(x[mine[:n]], j)
                wins = (d < least[:n]) | ((d == least[:n]) & (j < who[:n]))
                second[:n] = np.minimum(second[:n], np.where(wins, least[:n], d))
                least[:n], who[:n] = np.where(wins, d, least[:n]), np.where(wins, j, who[:n])
            best[mine], at[mine] = least, who
            upper[mine] = np.sqrt(least.astype(float)) * (1 + SLACK)
            lower[mine] = np.sqrt(second.astype(float)) * (1 - SLACK)
        return at, best, upper, lower


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(pc.list_flatten(flat).to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    away = (after - before).astype(np.int64)
    return np.sqrt((away * away).sum(1).astype(float)) * (1 + SLACK)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, exact: bool = False) -> DataFrame:
    """A round: state(vec_id, x, cluster, distance, upper, lower) against centroids that were `before` in the round before
    (None: nothing is known of the vectors yet). exact: every distance is measured."""
    width = centroids.shape[1]
    drift = None if before is None else _moved(before, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        # The largest drift among the other centroids lowers the bound of the others.
        most = np.zeros(len(centroids)) if drift is None else np.array([np.delete(drift, i).max(initial=0.0) for i in range(len(drift))])
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                x = _matrix(rows["x"], width)
                if drift is None:
                    at, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
                else:
                    at = rows["cluster"].to_numpy().astype(np.int64)
                    upper = (rows["upper"].to_numpy() + drift[at]) * (1 + SLACK)
                    lower = np.maximum(rows["lower"].to_numpy() - most[at], 0) * (1 - SLACK)
                at, squared, upper, lower = search.assign(x, at, upper, lower)
                if exact:
                    for a in np.unique(at[squared < 0]):
                        mine = np.flatnonzero((squared < 0) & (at == a))
                        squared[mine] = search.squared(x[mine], a)
                yield pa.RecordBatch.from_arrays([rows["vec_id"], rows["x"], pa.array(at, pa.int32()), pa.array(squared), pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "distance", "upper", "lower"])

    return state.mapInArrow(run, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; an empty cluster stays."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)  # a task's sums fit: 2^36 vectors of 2^26
        for batch in batches:
            x, at = _matrix(batch["x"], width), batch["cluster"].to_numpy()
            for a in np.unique(at):
                n[a] += (at == a).sum()
                total[a] += x[at == a].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width), pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()), pa.array(np.repeat(n[some], width)), pa.array(total[some].ravel())], ["cluster", "dim", "n", "total"])

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, dim int, n bigint, total bigint")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(points: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of points(vec_id, x)."""
    spark = points.sparkSession
    if not centroids:
        return points.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))
    can_checkpoint(spark)
    root, now, before = shared_folder(spark), np.array(centroids, np.int64), None
    state = points.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    for i in range(rounds):
        assigned(state, now, before).write.parquet(f"{root}/{i}")
        state = spark.read.schema(_STATE).parquet(f"{root}/{i}")
        if i:
            drop_folder(spark, f"{root}/{i - 1}")
        before, now = now, means(state, now)
    last = assigned(state, now, before, exact=True).select("vec_id", "cluster", "distance").checkpoint()
    drop_folder(spark, root)
    sums = last.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    per = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # k rows at most
    total = None if None in per.values() or sum(per.values()) >= 1 << 63 else sum(per.values())
    digests = [(a, v, total, hashlib.sha256(",".join(map(str, now[a].tolist())).encode()).hexdigest()) for a, v in per.items()]
    of = spark.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
