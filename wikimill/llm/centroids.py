"""Centroid clustering of vectors with Ptolemaic lower bounds.

Vectors become integer vectors once, and their exact squared distances to a few fixed pivots are stored beside them. For pivots p
and s, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s),

so a round needs only the pivot distances to rule out most centroids of a vector. The bounds are rounded down by the error that
double arithmetic can make; a centroid that could still be as near as the best one found is compared exactly, in integers.

A round is one pass over the stored table: tasks assign their vectors and give one row of sums per centroid. Only the centroids
(``k`` rows, a parameter) are on the driver, so a lost executor costs the tasks it held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

EPS = float(np.finfo(np.float64).eps)
LARGEST = 1 << 27  # components below this keep 64 squared differences inside a long
ROWS = 4096  # vectors worked on at once


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, ``rounds`` of assignment and moving; a component x becomes floor(scale * x)."""

    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    pivots: int = 6
    seed: str = "1"


def integer_vectors(table: DataFrame, how: Clustering, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows whose vector has ``dim`` components, none null or not finite."""
    x = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x"))
    fine = (F.size("x") == how.dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(how.scale)) * c.cast("double"))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    if v.size and max(int(v.max()), -int(v.min())) >= LARGEST:
        raise OverflowError(f"components of {LARGEST} and more: squared distances may not fit a long")
    return v


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the rows of ``b`` (all to all)."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass
class Pivots:
    """Fixed pivots and the pairs of them that differ."""

    at: np.ndarray

    def pairs(self) -> list[tuple[int, int, float]]:
        d = np.sqrt(squared(self.at, self.at).astype(np.float64))
        return [(p, s, float(d[p, s])) for p, s in combinations(range(len(self.at)), 2) if d[p, s] > 0]

    def bounds(self, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, from the squared pivot distances of both sides; never above the true value."""
        x, c = np.sqrt(vectors.astype(np.float64)), np.sqrt(centroids.astype(np.float64))
        best = np.zeros((len(x), len(c)))
        for p, s, apart in self.pairs():
            a, b = np.multiply.outer(x[:, p], c[:, s]), np.multiply.outer(x[:, s], c[:, p])
            np.maximum(best, (np.abs(a - b) - 8 * EPS * (a + b)) / apart, out=best)
        return best * best * (1 - 16 * EPS)


def nearest(v: np.ndarray, pivot: np.ndarray, pivots: Pivots, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), squared distance, and the number of exact distances that were needed."""
    low = pivots.bounds(pivot, squared(centroids, pivots.at))
    guess = low.argmin(1)
    upper = ((v - centroids[guess]) ** 2).sum(1)
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    open_ = low <= (upper * (1 + 2 * EPS))[:, None]
    open_[np.arange(len(v)), guess] = False
    exact[np.arange(len(v)), guess] = upper
    for j, row in enumerate(centroids):
        at = np.flatnonzero(open_[:, j])
        exact[at, j] = ((v[at] - row) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[np.arange(len(v)), cluster], len(v) + int(open_.sum())


def parts(batch: pa.RecordBatch, dim: int, pivots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo in range(0, len(batch), ROWS):
        part = batch.slice(lo, ROWS)
        yield lo, matrix(part.column("v"), dim), part.column("pivot").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots)


def moved(table: DataFrame, how: Clustering, pivots: Pivots, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, v, pivot in parts(batch, how.dim, len(pivots.at)):
                cluster, _, _ = nearest(v, pivot, pivots, centroids)
                n += np.bincount(cluster, minlength=len(n))
                np.add.at(sums, cluster, v)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(at, pa.int32()), "n": pa.array(n[at]), "sums": pa.array(list(sums[at]), pa.list_(pa.int64()))})

    rows = table.select("v", "pivot").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i]) for i in range(how.dim)]
    out = centroids.copy()
    for row in rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect():  # k rows at most
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def cluster_vectors(table: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that is kept.

    Vectors of another length and those with a null or non-finite component go, as do null vectors. Seeds are the vectors with the
    least SHA-256 of ``<seed>:<id>`` (a null id counts as empty text; equal ids by their components). Repeated rows are vectors of
    their own; with fewer than ``k`` vectors there are as many centroids; an empty table gives no rows. Components that would not
    fit exact long arithmetic raise, as Spark's own arithmetic does.
    """
    spark = table.sparkSession
    ids = integer_vectors(table, how, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = ids.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(how.k).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(-1, how.dim)
    pivots = Pivots(centroids[:how.pivots].copy())
    id_type = ids.schema["vec_id"].dataType.simpleString()

    def measured(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            yield {"vec_id": part.column("vec_id"), "v": part.column("v"), "pivot": list(squared(matrix(part.column("v"), how.dim), pivots.at))}

    vectors = stored(map_batches(ids, measured, f"vec_id {id_type}, v array<long>, pivot array<long>"), "vectors")
    if not seeds:
        none = F.lit(None)
        return vectors.select("vec_id", none.cast("int").alias("cluster"), *(none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), none.cast("string").alias("centroid_sha256"))
    for _ in range(how.rounds):
        centroids = moved(vectors, how, pivots, centroids)

    def assigned(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, v, pivot in parts(batch, how.dim, len(pivots.at)):
            cluster, distance, _ = nearest(v, pivot, pivots, centroids)
            yield {"vec_id": batch.column("vec_id").slice(lo, len(v)), "cluster": cluster, "distance": distance}

    out = stored(map_batches(vectors, assigned, f"vec_id {id_type}, cluster int, distance long"), "assigned")
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows at most
    rows = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sorted(inertia.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
