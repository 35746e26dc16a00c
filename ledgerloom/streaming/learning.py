"""Corrections learned as they arrive.

The aliases so far are read anew for every micro-batch, so a batch sees what the
ones before it taught. A batch's counts are merged into the table in one commit
that also records the batch's number: one that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots

LEARNED = "alias string, canonical string, occurrence_count long, seq long"


def learned_table(spark: SparkSession, path: str, buckets: int = 16) -> Snapshots:
    return Snapshots(spark, path, LEARNED, "alias", buckets)


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up, the canonical of the highest seq stays."""
    both = old.unionByName(new)
    return both.groupBy("alias").agg(F.max_by("canonical", "seq").alias("canonical"), F.sum("occurrence_count").alias("occurrence_count"), F.max("seq").alias("seq"))


def learn_batch(table: Snapshots, events: DataFrame, stream: str, batch: int) -> int:
    """One batch of events (alias, canonical, seq) merged; its own rows are reduced before they meet the table."""
    new = events.where("alias is not null").groupBy("alias").agg(F.max_by("canonical", "seq").alias("canonical"), F.count("*").alias("occurrence_count"), F.max("seq").alias("seq"))
    return table.change(new, merge_counts, (stream, batch))


def relearning(corrections: DataFrame) -> DataFrame:
    """T5: corrections (old, new, seq) as alias events; those that change nothing teach nothing."""
    kept = corrections.where("new is not null and coalesce(trim(old), '') != '' and new != old")
    return kept.select(F.lower(F.trim("old")).alias("alias"), F.lower(F.trim("new")).alias("canonical"), "seq")


def learn_stream(events: DataFrame, table: Snapshots, checkpoint: str, stream: str = "corrections", seen: Callable[[DataFrame, DataFrame, int], None] = lambda known, batch, k: None) -> None:
    """A stream of events into the table, everything that is there, then stop.

    `seen` gets what was known before a batch, the batch and its number: the
    stream-static join with a side that is read anew.
    """

    def add(batch: DataFrame, k: int) -> None:
        seen(table.read(), batch, k)
        learn_batch(table, batch, stream, k)

    q = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
