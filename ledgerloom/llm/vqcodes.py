"""Vector code compression with segment-mean lower bounds (operator 11).

A vector's parts are replaced by the numbers of their codebooks' nearest
entries. Most entries need no distance: cut both sides into blocks, then

    |p - c|^2  >=  sum over blocks of (S_p - S_c)^2 / size  +  (R_p - R_c)^2

with block sums S and the norm R of what the block means leave over. One block
is tried first, more and smaller ones on what it left; the exact distance to
the most promising entry is the bar. Bounds are lowered by more than their
rounding error, so an entry is only passed over where it is farther. What
survives gets exact integer distances, ties to the lower number.

Every round is one pass: codebooks go out (at most 256 entries a part, whatever
the input), each task adds up its parts by entry and sends those sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize, rejoin, release
from .vectors import common_length, matrix, sums, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a step compares with a codebook at once; numbers of blocks, coarse to fine (of 16 components 8 blocks leave 55 % of the
#: distances, 4 leave 90 %); share by which bounds are lowered.
STEP, LEVELS, SLACK = 1024, (1, 8), 1e-9


class Codebook:
    """One part's entries (whole numbers) with their block sums and residual norms."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        width = self.entries.shape[1]
        self.levels = []
        for blocks in LEVELS:
            if blocks == 1 or blocks < width:
                edges = np.linspace(0, width, blocks + 1).astype(int)[:-1]
                self.levels.append((edges, np.diff([*edges, width]).astype(float)))
        self.marks = [self._marks(self.entries, *level) for level in self.levels]

    @staticmethod
    def _marks(x: np.ndarray, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block sums over the root of their size, residual norms, and how far rounding may shift a norm."""
        means = np.add.reduceat(x, edges, axis=1) / sizes
        rest = x - np.repeat(means, sizes.astype(int), axis=1)
        return means * np.sqrt(sizes), np.sqrt((rest * rest).sum(axis=1)), 1e-12 * (1 + np.sqrt((x.astype(float) ** 2).sum(axis=1)))

    def _bounds(self, own: tuple, other: tuple, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of pairs (row, entry)."""
        s = np.abs(own[0][rows] - other[0][cols]) - (own[2][rows] + other[2][cols])[..., None]
        r = np.abs(own[1][rows] - other[1][cols]) - own[2][rows] - other[2][cols]
        return ((np.maximum(s, 0) ** 2).sum(axis=-1) + np.maximum(r, 0) ** 2) * (1 - SLACK)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row's nearest entry, and how many exact distances that took."""
        index, distance, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        for k in range(0, len(x), STEP):
            index[k : k + STEP], distance[k : k + STEP], n = self._step(x[k : k + STEP])
            exact += n
        return index, distance, exact

    def _exact(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        d = x[rows] - self.entries[cols]
        return np.einsum("ij,ij->i", d, d)

    def _step(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, m = len(x), len(self.entries)
        every = np.arange(n)
        own = [self._marks(x, *level) for level in self.levels]
        low = self._bounds(own[0], self.marks[0], every[:, None], np.arange(m)[None, :])
        bar = self._exact(x, every, low.argmin(axis=1))
        rows, cols = np.nonzero(low <= bar[:, None])
        exact = n
        for mine, theirs in zip(own[1:], self.marks[1:]):
            low = self._bounds(mine, theirs, rows, cols)
            starts = np.searchsorted(rows, every)
            # The first entry with the least bound of its row; its distance lowers the bar.
            least = low == np.minimum.reduceat(low, starts)[rows]
            best = np.full(n, m)
            np.minimum.at(best, rows[least], cols[least])
            bar, exact = np.minimum(bar, self._exact(x, every, best)), exact + n
            left = low <= bar[rows]
            rows, cols = rows[left], cols[left]
        d = self._exact(x, rows, cols)
        starts = np.searchsorted(rows, every)
        distance = np.minimum.reduceat(d, starts)
        hit = d == distance[rows]
        index = np.full(n, m)
        np.minimum.at(index, rows[hit], cols[hit])
        return index, distance, exact + len(d)


def _seeds(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest vec_ids in ascending order, null last; the least vector of a repeated one."""
    ids = [r.vec_id for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) if known else F.lit(False)
    found = {r.vec_id: r.cells for r in kept.where(chosen | F.col("vec_id").isNull() if None in ids else chosen).groupBy("vec_id").agg(F.min("cells").alias("cells")).collect()}
    return np.array([found[i] for i in ids], dtype=np.int64)


def _round(kept: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(part, entry, n, s): members and sums of every used entry."""
    width = dim // len(books)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = matrix(batch, "cells", dim)
            for j, book in enumerate(search):
                part = x[:, j * width : (j + 1) * width]
                entry, _, _ = book.nearest(part)
                count[j] += np.bincount(entry, minlength=len(count[j]))
                np.add.at(total[j], entry, part)
        rows = [(j, int(e), int(count[j][e]), total[j][e].tolist()) for j in range(len(books)) for e in np.flatnonzero(count[j])]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "s"])

    return sums(kept.select("cells").mapInArrow(add, schema), ["part", "entry"], width)


def train(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of a written table of whole vectors; entries that no part uses stay as they are."""
    first = _seeds(kept, entries)
    width = dim // parts
    books = [first[:, j * width : (j + 1) * width].copy() for j in range(parts)] if len(first) else []
    for _ in range(rounds if books else 0):
        for r in _round(kept, books, dim).collect():  # at most parts * entries rows
            books[r.part][r.entry] = [v // r.n for v in r.s]
    return books


def encode(kept: DataFrame, books: list[np.ndarray], dim: int, keep: list[str]) -> DataFrame:
    """`keep`, code (two hex digits a part, so at most 256 entries) and error, the squared distances summed over parts."""
    width = dim // max(1, len(books))
    schema = T.StructType([*[kept.schema[k] for k in keep], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def code(batch: pa.RecordBatch) -> dict:
        x = matrix(batch, "cells", dim)
        found = [Codebook(b).nearest(x[:, j * width : (j + 1) * width])[:2] for j, b in enumerate(books)]
        codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8) if found else np.zeros((len(x), 0), np.uint8)
        return {**{k: batch.column(i) for i, k in enumerate(keep)}, "code": [row.tobytes().hex() for row in codes], "error": sum(d for _, d in found)}

    return arrow_map(kept.select(*keep, "cells"), code, schema)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vec_id and vector: the components that a code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v) / scale) for v in e]) for e in b]) for b in books])
    part = lambda p, i: table[i][F.conv(p, 16, 10).cast("int")]
    return codes.select("vec_id", F.flatten(F.transform(F.regexp_extract_all("code", F.lit("(..)")), part)).alias("vector"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null, holds null or non-finite components,
    or has another length than most (the commonest multiple of `parts`): such a
    vector cannot be compared. Codebooks start from the smallest vec_ids, null
    last; a repeated vec_id counts once, with its least vector. Fewer vectors
    give fewer entries. Repeated rows are coded each, ties go to the lower entry.
    Null labels are one label. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select("vec_id", "label", F.col(column).alias("embedding"))
    dim = common_length(rows, multiple=parts)
    kept = materialize(whole_vectors(rows, scale, dim, ["vec_id", "label"]), "whole")
    books = train(kept, dim, parts, entries, rounds)
    coded = materialize(encode(kept, books, dim, ["vec_id", "label"]), "codes")
    release(kept)
    # A label may hold most rows: it is added up in every task first and joined back through keys that can be split.
    coded = coded.withColumn("l0", F.col("label").isNull()).withColumn("l1", F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType)))
    by_label = coded.groupBy("l0", "l1").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return rejoin(coded, by_label, ["l0", "l1"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
