"""Benchmark decontamination (operator 5): a broadcast set of benchmark word windows, scanned over every document.

Words are runs of bytes that are digits, letters or non-ASCII, lower-cased A-Z
only. Benchmark windows become integer tuples over the benchmark's vocabulary;
a document is a sequence of those integers, -1 for words the benchmark lacks.
A position is a candidate when its window has no -1 and its rolling hash is in
the table; the tuple itself then decides.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, byte_texts, materialize, sliced

WINDOW = 10
#: Bytes of benchmark text in one broadcast table; more items go to further tables, one after another.
BLOCK_BYTES = 8 << 20

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _hash(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        h = h * _P + ids[at + k].astype(np.uint64) + np.uint64(1)
    return h


class WindowTable:
    """The windows of some benchmark items: vocabulary, sorted hashes by length, and exact tuples."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.exact: dict[int, dict[tuple, list]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                owners = self.exact.setdefault(size, {}).setdefault(tuple(ids[k : k + size]), [])
                if item not in owners[-1:]:
                    owners.append(item)
        self.hashes = {}
        for size, table in self.exact.items():
            keys = np.array(list(table), dtype=np.int64).reshape(-1, size)
            self.hashes[size] = np.unique(_hash(keys.ravel(), np.arange(len(keys)) * size, size))

    def scan(self, text_words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark words inside any occurrence of a window; add the items whose windows occur."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in text_words), dtype=np.int64, count=len(text_words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size, table in self.exact.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if len(at):
                at = at[np.isin(_hash(ids, at, size), self.hashes[size])]
            for p in at.tolist():
                owners = table.get(tuple(ids[p : p + size].tolist()))
                if owners:
                    hit[p : p + size] = True
                    found.update(owners)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of bounded size, streamed to the driver."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        data = (text or "").encode()
        if block and size + len(data) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, data))
        size += len(data)
    if block:
        yield block


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def _broadcast(spark: SparkSession, items: list[tuple[object, bytes]], window: int) -> Broadcast:
    """A block's table, pickled: a worker unpickles it once per task."""
    return spark.sparkContext.broadcast(pickle.dumps(WindowTable(items, window), protocol=5))


def _summed(text: bytes, n_words: int, hit: np.ndarray, found: set, spans: bool) -> tuple:
    """What SCHEMA says of a document, after its doc_id."""
    named = sorted({"null" if i is None else str(i) for i in found})
    clean = None if not spans else without(text, hit).decode() if hit.any() else text.decode()
    return n_words, int(hit.sum()), len(named), named, hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit.any()), clean


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: counts, matching items (sorted as strings) and, with `spans`, the text without hit words.

    A null or empty text has no words and is clean; a null item text has no
    windows; a null item_id is listed as "null". Repeated items count once.
    The removed spans run from a hit's first to its last byte; what separates
    the remaining words stays as it was. Repeated rows are scanned each; extra
    columns are ignored; an empty table gives no rows.

    A benchmark of one block is scanned in one pass. Of a larger one the blocks
    are scanned one after another, each broadcast destroyed before the next, and
    their hits are written and put together at the end.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(SCHEMA)

    def rows_of(ids: pa.Array, texts: list[bytes], split: list[list[bytes]], hits: list[np.ndarray], found: list[set]) -> pa.RecordBatch:
        cols = list(zip(*[_summed(t, len(w), h, f, spans) for t, w, h, f in zip(texts, split, hits, found)])) or [[]] * (len(arrow) - 1)
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(cols, list(arrow)[1:]))], schema=arrow)

    if second is None:
        one = _broadcast(spark, first, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pickle.loads(one.value)
            for batch in batches:
                for part in sliced(batch, STEP_BYTES):
                    texts = byte_texts(part, "text")
                    split = [words(t) for t in texts]
                    hits, found = [np.zeros(len(w), dtype=bool) for w in split], [set() for _ in split]
                    for w, h, f in zip(split, hits, found):
                        table.scan(w, h, f)
                    yield rows_of(part.column(0), texts, split, hits, found)

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    numbered = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    hits_type = T.StructType([T.StructField("row", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def hits_of(one: Broadcast) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pickle.loads(one.value)
            for batch in batches:
                for part in sliced(batch, STEP_BYTES):
                    out: list[tuple] = []
                    for row, text in zip(part.column(1).to_pylist(), byte_texts(part, "text")):
                        w, f = words(text), set()
                        table.scan(w, h := np.zeros(len(w), dtype=bool), f)
                        if f:
                            out.append((row, np.flatnonzero(h).tolist(), ["null" if i is None else str(i) for i in f]))
                    cols = list(zip(*out)) or [[]] * 3
                    schema = to_arrow_schema(hits_type)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

        return numbered.select("text", "row").mapInArrow(step, hits_type)

    found = []
    for items in itertools.chain([first, second], blocks):
        one = _broadcast(spark, items, window)
        found.append(materialize(hits_of(one), "hits"))
        one.destroy()
    every = functools.reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("items")).alias("items"))
    joined = numbered.join(every.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left").select("doc_id", "text", "at", "items")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, STEP_BYTES):
                texts = byte_texts(part, "text")
                split = [words(t) for t in texts]
                hits = [np.zeros(len(w), dtype=bool) for w in split]
                for h, at in zip(hits, part.column(2).to_pylist()):
                    h[at or []] = True
                yield rows_of(part.column(0), texts, split, hits, [set(x or ()) for x in part.column(3).to_pylist()])

    return joined.mapInArrow(last, SCHEMA)


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the spans of consecutive hit words."""
    flat, out, at, k, n = text.translate(_TABLE), [], 0, 0, len(text)
    start = None
    pos = 0
    for h in hit.tolist():
        while flat[pos : pos + 1] == b" ":
            pos += 1
        end = flat.find(b" ", pos)
        end = n if end < 0 else end
        if h and start is None:
            start = pos
            out.append(text[at:start])
        elif not h and start is not None:
            at, start = pos, None
        if h:
            k = end
        pos = end
    if start is not None:
        at = k
    out.append(text[at:])
    return b"".join(out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without its contaminated rows, all columns as they were, without a shuffle.

    Rows with a null or empty text stay; of repeated rows all stay or go. A
    benchmark of more than one block takes a pass for each over what is left,
    written in between, and no more than one broadcast exists at a time.
    """

    def kept(rows: DataFrame, one: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pickle.loads(one.value)
            for batch in batches:
                for part in sliced(batch, STEP_BYTES):
                    clean = []
                    for text in byte_texts(part, "text"):
                        w, f = words(text), set()
                        table.scan(w, np.zeros(len(w), dtype=bool), f)
                        clean.append(not f)
                    yield part.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    spark, blocks = docs.sparkSession, _blocks(benchmark, block_bytes)
    items, following = next(blocks, []), next(blocks, None)
    while following is not None:
        one = _broadcast(spark, items, window)
        docs = materialize(kept(docs, one), "clean")
        one.destroy()
        items, following = following, next(blocks, None)
    return kept(docs, _broadcast(spark, items, window))
