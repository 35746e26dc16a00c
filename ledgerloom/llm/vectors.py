"""Vectors as rows of whole numbers: what operators 11 and 13 share.

Whole numbers make every later sum and distance exact, whatever order tasks
add them in, so a task that is run again cannot change a result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map


def common_length(vectors: DataFrame, column: str = "embedding", multiple: int = 1) -> int:
    """The length that most vectors have, of the positive multiples of `multiple`; ties to the shorter, 0 without any."""
    sizes = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).where(f"n > 0 and n % {multiple} = 0")
    first = sizes.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return first.n if first else 0


def cell_limit(dim: int) -> int:
    """The largest component with which every squared distance of two vectors fits a long."""
    return min((1 << 31) - 1, isqrt(((1 << 63) - 1) // max(1, dim)) // 2)


def whole_vectors(vectors: DataFrame, scale: int, dim: int, keep: list[str], column: str = "embedding") -> DataFrame:
    """Columns `keep` and cells, the components as floor(scale * x).

    Rows whose vector is null, of another length than `dim`, or holds null or
    non-finite components are dropped. Components are taken as doubles, which a
    power of two as scale leaves exact; with dim 0 nothing is kept. One whose squared distance would not fit a
    long is an error (as an overflow is in Spark), never a wrong number.
    """
    limit, width = cell_limit(dim), max(1, dim)
    schema = T.StructType([*[vectors.schema[k] for k in keep], T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def cut(batch: pa.RecordBatch) -> dict | None:
        lists = batch.column(len(keep))
        sized = np.array([n == dim > 0 for n in lists.value_lengths().to_pylist()], dtype=bool)
        x = lists.filter(pa.array(sized)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
        finite = np.isfinite(x).all(axis=1)
        x = np.floor(scale * x[finite])
        if x.size and np.abs(x).max() > limit:
            raise ArithmeticError(f"a component is beyond {limit / scale:g}: its squared distances do not fit a long")
        rows = pa.array(np.flatnonzero(sized)[finite])
        flat = pa.array(x.astype(np.int32).ravel())
        return {**{k: batch.column(i).take(rows) for i, k in enumerate(keep)}, "cells": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)}

    return arrow_map(vectors.select(*keep, column), cut, schema)


def matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """A column of cells as a matrix of 64-bit integers."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, max(1, dim))


def sums(parts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of keys, n and s (an array of `width` longs) added up by keys; every task has added up its own rows before."""
    s = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    return s.select(*keys, "n", F.array(*[f"s{i}" for i in range(width)]).alias("s"))
