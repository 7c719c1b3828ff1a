"""Lloyd's rounds over integer vectors with Elkan's bounds: nearest centroids without most of the distances.

Each vector carries an upper bound of the distance to its centroid and a lower bound for every centroid. A centroid is
passed over only if its lower bound, or half its distance to the vector's centroid, is strictly over the upper bound;
bounds are rounded away from each other, so what is passed over is strictly farther, and ties still go to the smaller
number. What isn't passed over is measured in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import stored
from sightline.llm.vectors import known, matrix, products

#: Of op12's contract: components, centroids, rounds, and what precedes the id in the hash that picks the first centroids.
SIZE, CENTROIDS, ROUNDS, SEED = 64, 40, 5, "2:"
_STATE = "id {kind}, v array<long>, cluster int, distance long, upper float, lower array<float>"


def _up(x: np.ndarray) -> np.ndarray:
    """x as a float that is larger for certain (x has one rounding of a double behind it at most)."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """x as a float that is smaller for certain, zero at least."""
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf)), np.float32(0))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to the rows of c."""
    return (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * products(v, c)


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids went from old to new: by the triangle inequality, each by its centroid's way."""
    way = _up(np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)))
    way[(new == old).all(1)] = 0
    return _up(upper.astype(np.float64) + way[cluster]), _down(lower.astype(np.float64) - way[None, :])


def nearest(v: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, upper, lower, number of distances measured): exact, ties to the smaller number."""
    half = _down(np.sqrt(squares(c, c).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    own = ((v - c[cluster]) ** 2).sum(1)
    best, measured = own.copy(), len(v)
    rows = np.flatnonzero((half[cluster].min(1) <= upper) & ((lower <= upper[:, None]).sum(1) > 1)) if len(c) > 1 else np.zeros(0, int)
    upper = np.minimum(upper, _up(np.sqrt(own.astype(np.float64))))
    lower[np.arange(len(v)), cluster] = _down(np.sqrt(own.astype(np.float64)))
    for j in range(len(c)) if len(rows) else ():
        r = rows[(cluster[rows] != j) & (lower[rows, j] <= upper[rows]) & (half[cluster[rows], j] <= upper[rows])]
        if not len(r):
            continue
        d = ((v[r] - c[j]) ** 2).sum(1)
        measured += len(r)
        root = np.sqrt(d.astype(np.float64))
        lower[r, j] = _down(root)
        won = (d < best[r]) | ((d == best[r]) & (j < cluster[r]))
        r, root = r[won], root[won]
        cluster[r], best[r], upper[r] = j, d[won], _up(root)
    return cluster, best, upper, lower, measured


def _assigned(state: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """state with each vector at its nearest centroid of new; without old ones all distances are measured."""

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = matrix(pdf["v"])
            if old is None:
                d = squares(v, new)
                cluster = d.argmin(1)
                best, root = d[np.arange(len(v)), cluster], np.sqrt(d.astype(np.float64))
                upper, lower = _up(root[np.arange(len(v)), cluster]), _down(root)
            else:
                cluster, upper = pdf["cluster"].to_numpy().astype(np.int64), pdf["upper"].to_numpy()
                upper, lower = moved(upper, np.stack(pdf["lower"].to_numpy()), cluster, old, new)
                cluster, best, upper, lower, _ = nearest(v, new, cluster, upper, lower)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cluster": cluster.astype(np.int32), "distance": best, "upper": upper, "lower": list(lower)})

    return state.mapInPandas(assign, _STATE.format(kind=state.schema["id"].dataType.simpleString()))


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Exact floors of the means; sums go up from each batch and task, so a cluster of any size is a row a batch."""

    def add(batches):
        for pdf in batches:
            if len(pdf):
                v, cluster = matrix(pdf["v"]), pdf["cluster"].to_numpy()
                total = np.zeros((len(c), v.shape[1]), np.int64)
                np.add.at(total, cluster, v)
                n = np.bincount(cluster, minlength=len(c))
                some = np.flatnonzero(n)
                yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    parts = state.select("v", "cluster").mapInPandas(add, "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(c.shape[1])]).collect()  # a row a centroid
    out = c.copy()
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
    return out


def clustered(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", size: int = SIZE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((ident, cluster, distance), centroids): each usable vector of df with its nearest centroid and the exact
    squared distance, after `rounds` rounds that start at the vectors whose ids hash lowest.

    Vectors that are null, of another size, or have a null or non-finite component are left out; a component of more
    than 2**27 / 256 is an error, as its squares may pass a long. Rows that repeat are vectors like others. A null id
    hashes after all others; equal ids are ordered by their vectors. Fewer vectors than centroids make as many centroids
    as there are vectors, an empty table gives none and an empty result. Other columns of df are not read. Centroids
    and their sums are the only rows that reach the driver: `centroids` of them.
    """
    kept = stored(known(df, ident, vector, size).select(F.col(ident).alias("id"), "v"), "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(centroids).collect()
    now = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)
    if not len(first):
        return kept.select(F.col("id").alias(ident), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state, old = kept, None
    for turn in range(rounds + 1):
        state = stored(_assigned(state, old, now), f"round-{turn}")
        if turn < rounds:
            old, now = now, _means(state, now)
    return state.select(F.col("id").alias(ident), "cluster", "distance"), now


def digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def inertias(found: DataFrame, c: np.ndarray) -> DataFrame:
    """found of clustered() with cluster_inertia, inertia and centroid_sha256: a small row for each centroid is joined."""
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    rows = [(k, int(s), int(sum(sums.values())), digest(c[k])) for k, s in sums.items()]
    named = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(found.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
