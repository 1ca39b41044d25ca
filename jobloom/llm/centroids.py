"""Centroid clustering in exact integers, by equal-average equal-variance nearest-neighbour search.

Centroids are sorted by the mean of their components. A vector's search starts at its own mean and goes outward: once the
means alone keep a centroid farther away than the best one so far, all beyond it on either side are farther too; one that
passes is compared by the deviations round the means; only what passes both is measured in integers. Both inequalities are
lower bounds of the distance, so nothing nearest is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.vectors import finite, matrix, scaled, with_columns_aside


class Centroids:
    """Centroids in the order of their means, with the deviations round them."""

    def __init__(self, centroids: np.ndarray):
        self.numbers = np.lexsort((np.arange(len(centroids)), centroids.sum(axis=1)))
        self.sorted = centroids[self.numbers]
        self.sums, self.spread, self.length = self.moments(self.sorted)
        self.root = np.sqrt(max(centroids.shape[1], 1))

    @staticmethod
    def moments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the components, length of the vector round its mean, and its own length."""
        sums = vectors.sum(axis=1)
        round_mean = vectors - (sums / max(vectors.shape[1], 1))[:, None]
        return sums, np.sqrt((round_mean**2).sum(axis=1)), np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many were measured."""
        sums, spread, length = self.moments(vectors)
        # Floating-point error of a bound is far below this share of the lengths.
        slack = 1e-9 * (1 + length + self.length.max(initial=0))
        best, who = np.full(len(vectors), np.iinfo(np.int64).max), np.full(len(vectors), len(self.sorted))
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        open_, measured = np.arange(len(vectors)), 0
        while len(open_):
            lo, hi, mine = left[open_], right[open_], sums[open_].astype(np.float64)
            below = np.where(lo >= 0, mine - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < len(self.sums), self.sums[np.minimum(hi, len(self.sums) - 1)] - mine, np.inf)
            down = below <= above
            means = np.maximum(np.minimum(below, above) / self.root - slack[open_], 0) ** 2
            go = means <= best[open_]  # infinite where no centroid is left
            open_, lo, hi, down, means = open_[go], lo[go], hi[go], down[go], means[go]
            at = np.where(down, lo, hi)
            left[open_] -= down
            right[open_] += ~down
            apart = np.maximum(np.abs(spread[open_] - self.spread[at]) - slack[open_], 0) ** 2
            near = (means + apart) * (1 - 1e-12) <= best[open_]
            rows, at = open_[near], at[near]
            measured += len(rows)
            distance = ((vectors[rows] - self.sorted[at]) ** 2).sum(axis=1)
            number = self.numbers[at]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            best[rows[closer]], who[rows[closer]] = distance[closer], number[closer]
        return who, best, measured


def kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the rows with exactly ``dims`` components, none null or not finite, as integers."""
    sound = vectors.where((F.size("embedding") == dims) & finite(F.col("embedding")))
    return with_columns_aside(sound, vec_id=F.col("vec_id").cast("long"), v=scaled(F.col("embedding"), scale))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; equal hashes by the components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays.

    A task sends one sum a centroid, so what meets in the shuffle depends on the tasks and not on the rows; the driver gets
    the centroids' own size.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        search = Centroids(centroids)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("v"))
                who, _, _ = search.nearest(vectors)
                np.add.at(total, who, vectors)
                count += np.bincount(who, minlength=len(count))
        used = np.flatnonzero(count)
        columns = [pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    parts = rows.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x"))
    merged = each.groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in merged:
        out[r["cluster"], r["dim"]] = r["x"] // r["n"]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            who, best, _ = search.nearest(matrix(batch.column("v"))) if batch.num_rows else ([], [], 0)
            columns = [batch.column("vec_id"), pa.array(who, pa.int32()), pa.array(best, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors``.

    Rows with another number of components, or a null or non-finite one, take no part. Fewer than ``k`` rows give as many
    centroids; no rows give none. Repeated rows count as often as they stand there; a null id is assigned but is the last
    to seed a centroid. Columns other than ``vec_id`` and ``embedding`` are ignored. Components too large for exact
    distances raise. Each round is one pass over ``vectors``, which should be a table or otherwise cheap to read again.
    """
    spark, rows = vectors.sparkSession, kept(vectors, dims, scale)
    centroids = seeds(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    if not len(centroids):
        centroids = np.zeros((0, dims), np.int64)
    found = assigned(rows, centroids)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, d, sum(inertia.values()), digest[j]) for j, d in inertia.items()]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
