"""SimHash near-duplicates (operator 3) by deletion-variant signatures.

At most `bits` differing bits over `segments` > bits / 2 segments leave one
segment with at most one differing bit. So each segment is indexed under all
its one-wildcard variants (the segment without one bit, and which bit), and two
segments at distance one or less share a variant. Equality of variants is an
equi-join; the full distance is checked inside it. Where fingerprints are so
many that chance alone fills the variants of one segment, text is cut into more
segments and `together` of them make a longer one: of bits * together / 2 + 1
segments, some `together` hold at most one differing bit between them.

Dense groups are handled without their pairs: first every bucket links its
members to one member chosen by hash (linear in the bucket), those links are
contracted to components, and only members of different components of a bucket
are compared pairwise. Links that the second step skips lie inside a component,
so components are exact.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, byte_texts, materialize, rejoin, release
from .graph import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 16
#: Distinct fingerprints that one task expands into variants.
NODES_PER_TASK = 10_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if over half of the shingle hashes have it. No words: zero."""
    ws = text.translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    starts = [0, *ends[:-1]]
    size = min(shingle, len(ws))
    grams = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]
    counts, n = np.zeros(64, dtype=np.int64), len(grams)
    for k in range(0, n, STEP):
        part = grams[k : k + STEP]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype=">u8", count=len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


FP_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long. A null text counts as empty."""

    def step(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in byte_texts(batch, "text")], dtype=np.uint64)
        return {"doc_id": batch.column(0).cast(pa.int64()).to_pylist(), "fp": fps.view(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), step, FP_SCHEMA)


def segments_for(bits: int, together: int = 1) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which some `together` have at most one differing bit between them."""
    n = bits * together // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


#: Fingerprints per value of the shortest key at most; beyond it more segments are taken together.
CROWD = 16


def together_for(n: int, bits: int) -> int:
    """How many segments make a key, for n different fingerprints; links are the same for any number."""
    together = 1
    while together < 6 and n > CROWD << min(sum(sorted(w for _, w in segments_for(bits, together))[:together]), 60):
        together += 1
    return together


def variants(nodes: DataFrame, bits: int = BITS, together: int = 1) -> DataFrame:
    """Rows of (fp, node, ...) -> one row per choice of segments and wildcard place, with the variant's `key`."""
    keys, segments = [], segments_for(bits, together)
    if together == 1:
        for off, width in segments:
            seg = f"(shiftrightunsigned(fp, {off}) & {(1 << width) - 1}L)"
            keys += [f"shiftleft(shiftleft(shiftright({seg}, {p + 1}), {p}) | ({seg} & {(1 << p) - 1}L), 6) | {off + p}L" for p in range(width)]
    for tag, chosen in enumerate(combinations(segments, together) if together > 1 else ()):
        places = [off + p for off, width in chosen for p in range(width)]
        whole = sum(1 << p for p in places)
        for p in places:
            mask = whole & ~(1 << p)
            # A hash of masked bits, choice and wildcard; what meets by chance is verified like all else.
            keys.append(f"xxhash64(fp & {mask - (1 << 64) if mask >> 63 else mask}L, {tag << 6 | p})")
    return nodes.select("*", F.explode(F.array(*[F.expr(k) for k in keys])).alias("key"))


def _near(a: str, b: str, bits: int):
    return F.expr(f"bit_count({a} ^ {b}) <= {bits}")


def _spread() -> list:
    """Of a bucket: its size and the bits in which any two members differ."""
    return [F.count("*").alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("differ")]


def _hopeful(bits: int):
    """Whether a bucket may hold a link. The two members of a chance collision differ in `differ` itself, which settles them here."""
    return F.expr(f"n > 2 or bit_count(differ) <= {bits}")


def link_components(nodes: DataFrame, bits: int = BITS, together: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, component), the smallest fingerprint reachable, itself included.

    together: segments of a key, by default as `together_for` has it. Nulls are
    no fingerprints; an empty table gives no rows.
    """
    n = nodes.count()
    together = together or together_for(n, bits)
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, n // NODES_PER_TASK + 1)
    index = variants(nodes.select("fp").repartition(parts, "fp"), bits, together)
    leaders = index.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key").alias("h"), "fp")).alias("lead"), *_spread()).where("n > 1").where(_hopeful(bits))
    star = rejoin(index, leaders, ["key"], "inner", merge=True).where(F.expr("fp != lead.fp")).where(_near("fp", "lead.fp", bits))
    first = components(star.select(F.col("fp").alias("a"), F.col("lead.fp").alias("b")))
    placed = nodes.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    rows = materialize(variants(placed.repartition(parts, "fp"), bits, together), "variants")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *_spread()).where("lo != hi").where(_hopeful(bits)).select("key")
    rest = materialize(rejoin(rows, mixed, ["key"], "inner", merge=True), "mixed")
    x = rest.select("key", F.col("fp").alias("fp_a"), F.col("comp").alias("a"))
    y = rest.select(F.col("key").alias("key_b"), F.col("fp").alias("fp_b"), F.col("comp").alias("b"))
    cross = x.hint("merge").join(y, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & _near("fp_a", "fp_b", bits)).select("a", "b").distinct()
    second = components(cross)
    release(rows, rest)
    joined = placed.join(second, F.col("comp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("component", "comp").alias("component"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within `bits` differing bits are linked; component_id is the
    smallest doc_id reachable, the document's own included. Null and wordless
    texts have fingerprint zero and link like any other. Repeated rows each get
    their row; null doc_ids link but are never the smallest unless a component
    has no other. Extra columns are ignored; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    comps = materialize(link_components(nodes, bits).withColumnRenamed("fp", "__fp"), "comps")
    known = nodes.join(comps, F.col("fp") == F.col("__fp")).select("fp", "least", "n", "component")
    tops = known.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    shared = rejoin(known, tops.where("size > 1"), ["component"], "inner").select("fp", "component_id")
    out = rejoin(rows, materialize(shared, "labels"), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest doc_id; rows that repeat it go too."""
    marks = near_duplicates(docs, bits, shingle).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = materialize(marks.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
