"""Harmonic packing (operator 9): reciprocal-capacity classes, a fixed count of pieces per bin.

A piece of length l belongs to class j = floor(capacity / l) and every bin of
class j takes j pieces, so workers fill bins without knowing of each other.
Plain harmonic bins of large pieces stay half empty; so a document is first cut
into full sequences, then into the powers of two from its remainder down to
`grain`, whose classes fill exactly, and a tail shorter than `grain`, whose
classes (j >= capacity / grain) waste less than 1 / (j + 1). A worker is a hash
bucket of documents; the incomplete bins of `fan` neighbouring workers are
pooled by class, level by level, until one is left; what then remains is fewer
than j pieces of each class, bounded whatever the input, and fills last bins
first-fit by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import STEP_BYTES, materialize, sliced
from .tokens import encoder

CAPACITY, GRAIN, END_ID = 4096, 256, 2
#: Pieces that a worker bucket holds at about, and workers whose rests are pooled at a level.
PER_WORKER, FAN = 2_000, 16

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def cuts(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of a document's pieces, in order; capacity and grain are powers of two."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise every whole text, append `end_id`, cut: one row per piece, with its ids as bytes if asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(schema)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced=False)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in sliced(batch, 3 * STEP_BYTES):
                cols: dict[str, list] = {f.name: [] for f in arrow}
                ids, begins = enc.encode_arrow(part.column(2))
                ids, at = ids.astype("<u4").tobytes(), (4 * begins).tolist()
                for doc, row, a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), at, at[1:]):
                    data = ids[a:b] + end
                    at_id, n = 0, len(data) // 4
                    for size in cuts(n, capacity, grain):
                        own = data[4 * at_id : 4 * (at_id + size)]
                        for name, value in (("doc_id", doc), ("row", row), ("start", at_id), ("length", size), ("ids_crc32", zlib.crc32(own)), ("doc_tokens", n)):
                            cols[name].append(value)
                        if with_ids:
                            cols["ids"].append(own)
                        at_id += size
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)


def _sequence(level, worker, cls, no):
    """Level, worker, class and bin in one long; ids are unique, not dense."""
    return F.expr(f"shiftleft({level}L, 59) | shiftleft({worker}, 35) | shiftleft({cls}, 22) | {no}")


def assign(cut: DataFrame, capacity: int = CAPACITY, per_worker: int = PER_WORKER, fan: int = FAN) -> DataFrame:
    """Pieces with doc_id, row, start, length -> the same with sequence_id and offset.

    `cut` is read several times: pass a written table. At 24 bits of worker and
    22 of bin, ids last for some 10^10 pieces a class.
    """
    workers = 1 << max(0, (cut.count() // per_worker)).bit_length()
    keep = cut.columns
    now = cut.withColumn("cls", F.expr(f"{capacity} div length")).withColumn("worker", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(workers)))
    filled, level = None, 0
    while True:
        group = W.partitionBy("worker", "cls")
        ranked = now.withColumn("no", F.row_number().over(group.orderBy("doc_id", "row", "start")) - 1).withColumn("n", F.count("*").over(group))
        ranked = materialize(ranked.withColumn("no", F.expr("no div cls")), "ranked")
        full = ranked.where("no < n div cls").withColumn("sequence_id", _sequence(level, "worker", "cls", "no")).select(*keep, "sequence_id")
        filled = full if filled is None else filled.unionByName(full)
        now = ranked.where("no >= n div cls").select(*keep, "cls", "worker")
        if workers == 1:
            break
        workers, level = -(-workers // fan), level + 1
        now = now.withColumn("worker", F.expr(f"worker div {fan}"))
    before = W.partitionBy("sequence_id").orderBy("doc_id", "row", "start")
    filled = filled.withColumn("offset", F.sum("length").over(before) - F.col("length"))
    schema = now.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return filled.unionByName(now.select(*keep).withColumn("last", F.lit(0)).groupBy("last").applyInPandas(_last_bins(capacity, keep), schema))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Every document has at least its end id, so null and empty texts get a piece
    too; long texts are cut whole. Repeated rows are packed each. A sequence is
    padded to `capacity` unless its length is a power of two. An empty table
    gives no rows; extra columns are ignored.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, grain, end_id), "pieces")
    placed = assign(cut, capacity)
    total = F.sum("length").over(W.partitionBy("sequence_id"))
    padded = F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded.alias("padded_length"))


def _last_bins(capacity: int, keep: list[str]):
    """First fit of the last pieces, longest first."""

    def fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], kind="stable")
        used: list[int] = []
        seq, off, first = [], [], 0
        for size in rest["length"].tolist():
            while first < len(used) and used[first] >= capacity:
                first += 1
            k = first
            while k < len(used) and used[k] + size > capacity:
                k += 1
            if k == len(used):
                used.append(0)
            seq.append(k)
            off.append(used[k])
            used[k] += size
        return rest[keep].assign(sequence_id=np.array(seq, dtype=np.int64) + (1 << 62), offset=np.array(off, dtype=np.int64))

    return fit
