"""Centroid clustering with Hamerly's bounds (operator 13).

Of every vector a state row is kept: its cluster, an upper bound of the distance
to that centroid, and a lower bound of the distance to any other. When centroids
move, the upper bound grows by the own centroid's drift and the lower one shrinks
by the largest drift of the others; while upper < lower the cluster cannot have
changed and no distance is computed. Else the upper bound is replaced by the exact
distance, and a vector that is still ambiguous is compared with every centroid in
whole numbers (ties to the smaller number). Bounds are doubles, always rounded
outwards, so they only ever save work.

State is written every round and the one before removed; a task of a round
reads its rows, the centroids (as many as were asked for) and their drift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize, release
from .vectors import matrix, sums, whole_vectors

CENTROIDS, ROUNDS, SCALE, DIM = 16, 3, 64, 64
#: Shares by which a bound is rounded outwards; more than the error of a root and the sums of some rounds.
SLACK = 1e-12


def _up(x):
    return x * (1 + SLACK) + SLACK


def _down(x):
    return np.maximum(0, x * (1 - SLACK) - SLACK)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def full_scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) from exact distances to every centroid."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    cluster = d.argmin(axis=1)  # the first of equals
    own = d[np.arange(len(x)), cluster]
    if d.shape[1] == 1:
        return cluster, _up(np.sqrt(own)), np.full(len(x), np.inf)
    second = np.partition(d, 1, axis=1)[:, 1]
    return cluster, _up(np.sqrt(own)), _down(np.sqrt(second))


def loosen(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after the centroids moved by at most `drift` each."""
    most = int(drift.argmax())
    others = np.full(len(drift), drift[most])
    others[most] = np.delete(drift, most).max(initial=0.0)
    cluster, upper, lower = cluster.copy(), _up(upper + drift[cluster]), _down(lower - others[cluster])
    unsure = np.flatnonzero(upper >= lower)
    upper[unsure] = _up(np.sqrt(squared(x[unsure], centroids[cluster[unsure]])))
    unsure = unsure[upper[unsure] >= lower[unsure]]
    if len(unsure):
        cluster[unsure], upper[unsure], lower[unsure] = full_scan(x[unsure], centroids)
    scanned = np.zeros(len(x), bool)
    scanned[unsure] = True
    return cluster, upper, lower, scanned


STATE = [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("scanned", T.BooleanType())]


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The next state; without a drift every vector is compared with every centroid."""
    dim = centroids.shape[1]

    def step(batch: pa.RecordBatch) -> dict:
        x = matrix(batch, "cells", dim)
        if drift is None:
            found = *full_scan(x, centroids), np.ones(len(x), bool)
        else:
            found = loosen(x, *[batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)], centroids, drift)
        return {"vec_id": batch.column(0), "cells": batch.column(1), **dict(zip(("cluster", "upper", "lower", "scanned"), found))}

    return arrow_map(state, step, T.StructType([state.schema["vec_id"], *STATE]))


def _sums(state: DataFrame, k: int, dim: int) -> DataFrame:
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy(zero_copy_only=False)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, matrix(batch, "cells", dim))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return sums(state.select("cells", "cluster").mapInArrow(add, schema), ["cluster"], dim)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids at the floored means of their vectors, empty ones where they were; and how far each went, rounded up."""
    new = centroids.copy()
    for r in _sums(state, *centroids.shape).collect():  # at most a row per centroid
        new[r.cluster] = [v // r.n for v in r.s]
    return new, _up(np.sqrt(squared(new, centroids)))


def fit(kept: DataFrame, dim: int, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """(final state table, final centroids) of a written table (vec_id, cells); None without vectors.

    Seeds are the k rows with the smallest sha256 of `1:<vec_id>`; rows of one
    vec_id (or none: last) in the order of their vectors.
    """
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("cells", order.alias("o")).orderBy(F.asc_nulls_last("o"), "cells").limit(k).collect()
    if not first:
        return None, np.zeros((0, dim), np.int64)
    centroids = np.array([r.cells for r in first], dtype=np.int64)
    state = materialize(_assigned(kept, centroids, None), "bounds")
    for _ in range(rounds):
        centroids, drift = _moved(state, centroids)
        before, state = state, materialize(_assigned(state, centroids, drift), "bounds")
        release(before)
    return state, centroids


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, column: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dim` components, none null or non-finite.
    Repeated rows count each; ties go to the smaller number; fewer than k vectors
    give as many centroids. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col(column).alias("embedding"))
    kept = materialize(whole_vectors(rows, scale, dim, ["vec_id"]), "whole")
    state, centroids = fit(kept, dim, k, rounds)
    schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if state is None:
        release(kept)
        state = kept.select("vec_id", "cells", F.lit(0).alias("cluster")).limit(0)

    def measure(batch: pa.RecordBatch) -> dict:
        own = batch.column(2).to_numpy(zero_copy_only=False)
        return {"vec_id": batch.column(0), "cluster": batch.column(2), "distance": squared(matrix(batch, "cells", dim), centroids[own])}

    found = materialize(arrow_map(state.select("vec_id", "cells", "cluster"), measure, schema), "clusters")
    release(state, kept)
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most a row per centroid
    facts = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as centroids at most, whatever the input.
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
