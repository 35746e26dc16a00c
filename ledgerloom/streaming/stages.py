"""A document's way through the stages as arbitrary stateful processing.

Rows of the stage log arrive in any order and batch. Per document the state is
the furthest stage done, what its last row said, and how often it was tried. A
document that is not through and of which nothing is heard for `patience` is put
up for another try by an event-time timer, and given up after `tries`. What comes
out is a change log, one row for each change; the last row of a document is its
state, equal to `resume_points` over the whole log as far as stages go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mutations import STAGES

PATIENCE_S, TRIES = 3600, 3
CHANGES = "document_id string, version long, last_stage string, next_stage string, status string, attempts int, ts timestamp"
_STATE = "far int, us long, k int, status string, attempts int, version long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StageMachine(StatefulProcessor):
    """far: furthest stage done; us (microseconds), k, status: of the row that is last by time and stage; attempts: tries since that row."""

    def __init__(self, stages: list[str], patience_s: float, tries: int):
        self.stages, self.patience, self.tries = stages, int(patience_s * 1000), tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("way", _STATE)

    def _row(self, key, far: int, status: str, attempts: int, version: int, us: int) -> pd.DataFrame:
        name = lambda k: self.stages[k] if 0 <= k < len(self.stages) else None
        return pd.DataFrame({"document_id": [key[0]], "version": [version], "last_stage": [name(far)], "next_stage": [name(far + 1)], "status": [status], "attempts": [attempts], "ts": [pd.Timestamp(us, unit="us")]})

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = {s: k for k, s in enumerate(self.stages)}
        far, us, at, status, attempts, version = self.state.get() if self.state.exists() else (-1, -(1 << 62), -1, "queued", 0, 0)
        seen = pd.concat(list(rows))
        seen = seen.assign(k=seen["stage"].map(order).fillna(-1).astype(int), us=seen["ts"].astype("datetime64[us]").astype("int64"))
        done = seen.loc[(seen["status"] == "done") & (seen["k"] >= 0), "k"]
        far = max(far, int(done.max()) if len(done) else -1)
        newest = seen.sort_values(["us", "k", "status"]).iloc[-1]
        if (int(newest["us"]), int(newest["k"])) >= (us, at):
            us, at, status, attempts = int(newest["us"]), int(newest["k"]), str(newest["status"]), 0
        version += 1
        finished = far == len(self.stages) - 1 and status == "done"
        shown = "finished" if finished else status
        self.state.update((far, us, at, status, attempts, version))
        self._timer(None if finished else max(us // 1000 + self.patience, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, far, shown, attempts, version, us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        far, us, at, status, attempts, version = self.state.get()
        attempts, version = attempts + 1, version + 1
        given_up = attempts >= self.tries
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update((far, us, at, status, attempts, version))
        if not given_up:
            self.handle.registerTimer(max(due + self.patience, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, far, "given_up" if given_up else "retry", attempts, version, due * 1000)

    def close(self) -> None:
        pass


def stage_changes(log: DataFrame, late: str = "1 hour", patience_s: float = PATIENCE_S, tries: int = TRIES, stages: list[str] | None = None) -> DataFrame:
    """A stream of log rows (document_id, stage, status, ts) -> a stream of changes.

    Rows later than `late` behind the newest are dropped by the watermark; stages
    that are no part of the order say nothing of progress. A document keeps one
    small state row; what was sent is not remembered.
    """
    rows = log.select(F.col("document_id").cast("string").alias("document_id"), "stage", F.coalesce("status", F.lit("")).alias("status"), F.col("ts").cast("timestamp").alias("ts")).where("document_id is not null and ts is not null")
    machine = StageMachine(stages or STAGES, patience_s, tries)
    return rows.withWatermark("ts", late).groupBy("document_id").transformWithStateInPandas(machine, CHANGES, "Update", "EventTime")


def run_to_sink(changes: DataFrame, sink: str, checkpoint: str, before: Callable[[int], None] = lambda batch: None) -> None:
    """Everything that is there, then stop; each batch has its folder, so one that is run again after a failure replaces its own rows.

    `before` is called with a batch's number ahead of its write.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, k: int) -> None:
        before(k)
        batch.write.mode("overwrite").parquet(f"{sink}/batch={k}")

    with rocks(spark):
        q = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


class rocks:
    """State with timers needs the RocksDB store; the session's own setting comes back afterwards."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.was = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.NAME, self.was) if self.was else self.spark.conf.unset(self.NAME)


def current_states(spark: SparkSession, sink: str) -> DataFrame:
    """One row per document: its last change."""
    rows = spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(sink)
    rest = [c for c in rows.columns if c != "document_id"]
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("document_id", "r.*")
