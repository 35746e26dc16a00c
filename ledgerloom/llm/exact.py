"""Exact deduplication: tree merge of sorted digest runs (operator 8, DataFrame functions only).

The rows of one partition are a run, sorted by digest and reduced to one row
per digest where they lie. Runs are merged in binomial rounds: in a round, runs
whose numbers differ in the round's bits alone are partners and send their rows
to the one with those bits clear. Runs travel in digest ranges, so a task gets
the same range of all partners, never a whole run, and merges them in digest
order. What a merge retains of a digest is the row with the largest, or
smallest, identifier and the count, and it counts rows as equal only if length
and a second hash agree with the digest, at every level.

In Spark's terms a merge is an exchange by (run, range) and a sort aggregate:
the maximum of a struct is aggregated in sorted order, as the plan shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, rejoin

#: Bits of the run number that a round clears (two to this power are partners), rows of a run at about, hex digits of a range.
ROUND_BITS, RUN_ROWS, RANGE_DIGITS = 3, 10_000, 4
KEY = ["text_sha256", "n_bytes", "second"]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text_sha256, n_bytes, second) of the normalised text; a null text counts as empty.

    row tells repeated rows apart and is fixed by the write that follows.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", norm.alias("norm"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("second"))


def merge_runs(rows: DataFrame, keep: str = "max", runs: int | None = None, bits: int = ROUND_BITS) -> DataFrame:
    """Written digest rows -> one row per distinct text with `best` (doc_id, row) and `group_size`.

    runs: a power of two; partitions are dealt to that many runs, by default as
    many as there are RUN_ROWS rows. The first round merges while it reduces
    each partition, so a digest leaves a partition once however often it occurs.
    """
    best = {"max": F.max, "min": F.min}[keep]
    runs = runs or 1 << (rows.count() // RUN_ROWS).bit_length()
    left = max(1, runs.bit_length() - 1)
    run: Column = F.spark_partition_id().bitwiseAND(runs - 1)
    now = rows.select(run.alias("run"), F.substring("text_sha256", 1, RANGE_DIGITS).alias("range"), *KEY, F.struct("doc_id", "row").alias("best"), F.lit(1).cast("long").alias("n"))
    first = True
    while left > 0:
        # The partner with the lowest number: this round's bits cleared.
        now, left = now.withColumn("run", F.shiftright("run", min(bits, left))), left - bits
        now = now if first else now.repartition("run", "range")
        now, first = now.groupBy("run", "range", *KEY).agg(best("best").alias("best"), F.sum("n").alias("n")), False
    return now.select(*KEY, "best", F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty
    and equals other empty texts. Of equal texts the largest doc_id stays
    (`keep="min"`: the smallest; null ids sort below all others). Of repeated
    rows with that doc_id exactly one is kept. An empty table gives no rows;
    other columns are ignored.
    """
    rows = materialize(digests(docs), "digests")
    groups = merge_runs(rows, keep).where("group_size > 1")
    return rejoin(rows, groups, KEY).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """`docs` without its dropped rows, all columns as they were; a null text counts as empty.

    Of several rows with the doc_id that stays and an equal text one is kept, that
    whose columns come first as JSON text, so reruns agree; fully repeated rows thus
    become one. An empty table stays empty.
    """
    marks = materialize(exact_duplicates(docs, keep), "kept").where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    out = docs.withColumn("__sha", sha).join(marks.withColumnRenamed("__sha", "__sha2"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha2")), "left_semi")
    if not has_repeated_ids(docs):
        return out.drop("__sha")
    row = F.struct(*docs.columns)
    return out.groupBy("doc_id", "__sha").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")


def has_repeated_ids(docs: DataFrame) -> bool:
    """Whether any doc_id occurs twice; only then must repeated rows be told apart."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())
