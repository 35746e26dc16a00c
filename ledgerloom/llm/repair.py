"""Token-id files with Re-Pair grammars (operator 2).

A shard holds whole documents in doc_id order. Its ids are compressed by
Re-Pair (Larsson & Moffat, 2000): frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again; a round replaces many pairs at once,
where a place loses to a neighbouring place with a more frequent pair. Rules
never cross documents. The file keeps the rules with their expansion lengths,
so a token or a range is found by prefix sums and a descent into one rule.

Layout of a shard, little-endian: magic, five uint32 (documents, symbols, rules,
first nonterminal, bytes per symbol), int64 shard number, then arrays: doc ids
int64, id-is-null uint8, tokens and symbols per document uint32, rule left and
right uint32, rule expansion length uint32, symbols, and a closing zero byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import STEP_BYTES, arrow_map, materialize, read_binary, shared_path, sliced, write_binary
from .tokens import encoder

MAGIC = b"LLRPAIR1"
BASE, END_ID = 50_257, 0
#: Tokens of a shard at about (a longer document is a shard of its own), and occurrences a pair needs.
SHARD_TOKENS, MIN_COUNT = 1 << 20, 12
#: Bits at most of the table that finds pairs too rare to count; a round takes one in SHARE of the symbols left, LEAST at least.
SLOT_BITS, SHARE, LEAST = 18, 4, 256
#: Symbols stay within 16 bits.
MAX_RULES = (1 << 16) - BASE
#: Bytes of text that a range partition gets at about.
PARTITION_BYTES = 64 << 20


def _apart(at: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which places count: of a run of places with one pair, which overlap each other, every second one."""
    run = np.zeros(len(at), dtype=bool)
    run[1:] = (at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])
    if not run.any():
        return np.ones(len(at), dtype=bool)
    k = np.arange(len(at))
    return (k - np.maximum.accumulate(np.where(run, 0, k))) % 2 == 0


def compress(ids: np.ndarray, last: np.ndarray, base: int = BASE, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and whether each ends its document -> (symbols, rules as (n, 2), whether each symbol ends its document).

    Pairs are counted exactly; rounds go on until none occurs `min_count` times or the symbols run out.
    """
    s, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    made = 0
    # Places whose pair may be frequent; a pair grows no more frequent, so a place comes back only beside a new symbol.
    alive = ~last
    alive[-1:] = False
    while made < max_rules:
        at = np.flatnonzero(alive)
        pair = (s[at] << np.uint32(16)) | s[at + 1]
        bits = min(SLOT_BITS, max(8, len(pair).bit_length() - 1))
        slot = ((pair * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.intp)
        # A slot holds at least as many as each of its pairs.
        hot = (np.bincount(slot, minlength=1 << bits) >= min_count)[slot]
        at, pair = at[hot], pair[hot]
        counted = _apart(at, pair)
        at_hot, slot = at, slot[hot][counted]
        at, pair = at[counted], pair[counted]
        ordered = np.sort(pair)
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
        codes, n = ordered[heads], np.diff(heads, append=len(ordered))
        top = np.flatnonzero(n >= min_count)
        if not len(top):
            break
        room = min(max_rules - made, max(LEAST, -(-(max_rules - made) // SHARE)))
        top = top[np.lexsort((codes[top], -n[top]))][:room]
        rank_of = np.argsort(top)
        codes = codes[top][rank_of]
        # Places of the chosen pairs: first by slot, then exactly.
        mine = np.zeros(1 << bits, dtype=bool)
        mine[(codes * np.uint32(2654435761)) >> np.uint32(32 - bits)] = True
        some = np.flatnonzero(mine[slot])
        k = np.minimum(np.searchsorted(codes, pair[some]), len(codes) - 1)
        exact = codes[k] == pair[some]
        place, rank = at[some[exact]], rank_of[k[exact]]
        alive = np.zeros(len(s), dtype=bool)
        alive[at_hot] = True
        # Of two neighbouring places at most one wins: the more frequent pair, on ties the left.
        beside = place[1:] == place[:-1] + 1
        won = np.ones(len(place), dtype=bool)
        won[1:] &= ~beside | (rank[1:] < rank[:-1])
        won[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        win, rank = place[won], rank[won]
        used = np.zeros(len(top), dtype=bool)
        used[rank] = True
        by_rank = np.empty(len(top), dtype=np.uint32)
        by_rank[rank_of] = codes
        chosen = by_rank[used]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1))
        s[win] = (base + made + np.cumsum(used) - 1)[rank].astype(np.uint32)
        last[win] = last[win + 1]
        keep = np.ones(len(s), dtype=bool)
        keep[win + 1] = False
        now = win - np.arange(len(win))
        s, last, alive = s[keep], last[keep], alive[keep]
        alive[now] = True
        alive[np.maximum(now - 1, 0)] = True
        alive &= ~last
        alive[-1:] = False
        made += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    return s, table.astype(np.uint32), last


def expansion_lengths(rules: np.ndarray, base: int = BASE) -> np.ndarray:
    """Tokens that each rule stands for; a rule refers only to ids and earlier rules."""
    out = np.zeros(len(rules), dtype=np.int64)
    one = np.ones(base, dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (one[a] if a < base else out[a - base]) + (one[b] if b < base else out[b - base])
    return out


@dataclass
class Shard:
    """A decoded shard header with its arrays; tokens are expanded on demand."""

    number: int
    doc_ids: list[int | None]
    doc_tokens: np.ndarray
    doc_symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    base: int

    def __post_init__(self):
        self.first = np.concatenate(([0], np.cumsum(self.doc_symbols.astype(np.int64))))
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions end to end, and where each begins."""
        if self._flat is None:
            starts = np.concatenate(([0], np.cumsum(self.lengths)))
            flat = np.zeros(int(starts[-1]), dtype=np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at = starts[k]
                for x in (a, b):
                    if x < self.base:
                        flat[at] = x
                        at += 1
                    else:
                        n = self.lengths[x - self.base]
                        flat[at : at + n] = flat[starts[x - self.base] : starts[x - self.base] + n]
                        at += n
            self._flat = flat, starts[:-1]
        return self._flat

    def tokens(self, doc: int | None = None) -> np.ndarray:
        """Ids of the doc-th document of the shard, or of all."""
        sym = self.symbols if doc is None else self.symbols[self.first[doc] : self.first[doc + 1]]
        flat, starts = self._expansions()
        rule = sym >= self.base
        which = np.where(rule, sym.astype(np.int64) - self.base, 0)
        size = np.where(rule, self.lengths[which] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - size, size)
        out = np.repeat(sym, size).astype(np.uint32)
        inner = np.repeat(rule, size)
        out[inner] = flat[(np.repeat(starts[which] if len(starts) else which, size) + place)[inner]]
        return out

    def token_at(self, doc: int, i: int) -> int:
        """The i-th id of a document, by prefix sums and one descent."""
        sym = self.symbols[self.first[doc] : self.first[doc + 1]].astype(np.int64)
        size = np.array([self.lengths[x - self.base] if x >= self.base else 1 for x in sym.tolist()])
        ends = np.cumsum(size)
        k = int(np.searchsorted(ends, i, side="right"))
        x, i = int(sym[k]), i - int(ends[k] - size[k])
        while x >= self.base:
            a, b = self.rules[x - self.base].tolist()
            n = int(self.lengths[a - self.base]) if a >= self.base else 1
            x, i = (a, i) if i < n else (b, i - n)
        return x


def pack_shard(number: int, doc_ids: list[int | None], texts: list[bytes] | list[np.ndarray], base: int = BASE) -> bytes:
    """Documents' ids (arrays, or little-endian uint32 bytes) to a shard, without the closing zero."""
    arrays = [np.frombuffer(t, dtype="<u4") if isinstance(t, bytes) else t for t in texts]
    sizes = np.array([len(t) for t in arrays], dtype=np.int64)
    ids = np.concatenate(arrays)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    sym, rules, ends = compress(ids, last, base)
    per_doc = np.diff(np.concatenate(([-1], np.flatnonzero(ends))))
    head = struct.pack("<5Iq", len(doc_ids), len(sym), len(rules), base, 2, number)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), sizes.astype("<u4"), per_doc.astype("<u4"), rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), expansion_lengths(rules, base).astype("<u4"), sym.astype("<u2")]
    return MAGIC + head + b"".join(x.tobytes() for x in parts)


def unpack_shards(data: bytes) -> Iterator[Shard]:
    """The shards of a file, each followed by its closing zero."""
    at = 0
    while at < len(data):
        if data[at : at + 8] != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        n_docs, n_sym, n_rules, base, _, number = struct.unpack_from("<5Iq", data, at + 8)
        at += 8 + struct.calcsize("<5Iq")
        arrays = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_docs), ("<u4", n_rules), ("<u4", n_rules), ("<u4", n_rules), ("<u2", n_sym)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        if data[at : at + 1] != b"\0":
            raise ValueError(f"shard {number} is cut off")
        at += 1
        ids, none, tokens, symbols, left, right, lengths, sym = arrays
        yield Shard(number, [None if x else d for d, x in zip(ids.tolist(), none.tolist())], tokens, symbols, np.stack([left, right], axis=1), lengths.astype(np.int64), sym, base)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts, append `end_id`, and write shards in ascending doc_id order (nulls first).

    A null text is empty: its document is the end id alone. Repeated doc_ids
    are documents of their own, ordered by the hash of their texts (equal ones
    have equal ids, so their order does not show). Extra columns are ignored.
    """
    from pyspark import TaskContext

    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(n_bytes // PARTITION_BYTES) + 1)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = T.StructType([T.StructField("value", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced=True)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.kind)
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        held = n_docs = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_shard((part << 32) | seq, ids, texts)], pa.binary())], names=["value"])

        for batch in batches:
            for piece in sliced(batch, 3 * STEP_BYTES):
                data, begins = enc.encode_arrow(piece.column(1))
                at = begins.tolist()
                for doc, a, b in zip(piece.column(0).to_pylist(), at, at[1:]):
                    if n_docs and held + b - a >= shard_tokens:
                        yield flush()
                        seq, ids, texts, held, n_docs = seq + 1, [], [], 0, 0
                    ids.append(doc)
                    texts.append(np.concatenate((data[a:b], end)))
                    held, n_docs = held + b - a + 1, n_docs + 1
        if n_docs:
            yield flush()

    write_binary(ordered.select("doc_id", "text").mapInArrow(run, schema), "value", path, 8)


ROWS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("shard_bytes", T.LongType()),
        T.StructField("n_rules", T.LongType()),
    ]
)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32, and its shard's number of rules."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for content in batch.column(1):
            for s in unpack_shards(content.as_py() or b""):
                ids = s.tokens().astype("<u4")
                ends = np.cumsum(s.doc_tokens.astype(np.int64))
                starts = ends - s.doc_tokens
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield {"shard": [s.number] * n, "doc_id": s.doc_ids, "place": starts, "n_tokens": s.doc_tokens.astype(np.int64), "ids_crc32": crc, "shard_bytes": [s.symbols.nbytes + 12 * len(s.rules)] * n, "n_rules": [len(s.rules)] * n}

    rows = materialize(arrow_map(read_binary(spark, path), step, ROWS), "token-rows")
    begins = _begins(rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")))
    return rows.join(begins.withColumnRenamed("shard", "__shard"), F.col("shard") == F.col("__shard")).select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard", "n_rules", "shard_bytes")


def _begins(totals: DataFrame) -> DataFrame:
    """(shard, total) -> (shard, begin), the ids in all shards before; summed within partitions, within groups of 1,024 partitions, and over those groups."""
    def before(group: list[str], by: str) -> Column:
        return F.coalesce(F.sum("total").over(W.partitionBy(*group).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    shards = totals.withColumn("part", F.shiftright("shard", 32)).withColumn("inner", before(["part"], "shard"))
    parts = totals.groupBy(F.shiftright("shard", 32).alias("part")).agg(F.sum("total").alias("total")).withColumn("group", F.shiftright("part", 10))
    groups = parts.groupBy("group").agg(F.sum("total").alias("total")).withColumn("outer", before([], "group")).select(F.col("group").alias("__group"), "outer")
    parts = parts.withColumn("middle", before(["group"], "part")).join(groups, F.col("group") == F.col("__group")).select(F.col("part").alias("__part"), (F.col("middle") + F.col("outer")).alias("middle"))
    return shards.join(parts, F.col("part") == F.col("__part")).select("shard", (F.col("inner") + F.col("middle")).alias("begin"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write `docs` to the shared folder and return what the files say. An empty table gives no rows."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
