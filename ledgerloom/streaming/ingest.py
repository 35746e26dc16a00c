"""What polls and remembers in the reference, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aliases import CONFIRMATIONS

FILES_PER_TRIGGER = 15


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "json") -> DataFrame:
    """New files of a folder, at most fifteen a trigger; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).format(fmt).load(folder)


def run_available(stream: DataFrame, sink: str, checkpoint: str, key: str | None = None):
    """Everything available, then stop. With a key, rows whose key the sink already holds are left out.

    State of all hashes ever seen would grow without bound, so each micro-batch
    anti-joins the sink instead. A batch that is run again after a failure finds
    its own rows there and adds nothing.
    """
    if key is None:
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:

        def add(batch: DataFrame, _: int) -> None:
            spark = batch.sparkSession
            new = batch.dropDuplicates([key])
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                old = spark.read.schema(batch.schema).parquet(sink).select(F.col(key).alias("__k"))
                new = new.join(old, F.col(key) == F.col("__k"), "left_anti")
            new.write.mode("append").parquet(sink)

        q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stage_log(stream: DataFrame, stage: str) -> DataFrame:
    """A log row per input row."""
    return stream.select("document_id", F.lit(stage).alias("stage"), F.lit("done").alias("status"), F.current_timestamp().alias("ts"))


def promotions(feedback: DataFrame, least: int = CONFIRMATIONS) -> DataFrame:
    """T4: accepted feedback counted per (alias, canonical); complete mode shows those that reached the promotion count."""
    return feedback.where("accepted and coalesce(trim(alias), '') != ''").groupBy("alias", "canonical").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts with a watermark; the batch form of the same expression gives the same rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def relearn(spark: SparkSession, corrections: DataFrame) -> DataFrame:
    """Corrections as they arrive, ready to be aggregated; static sides are read anew by each micro-batch."""
    return corrections.where("new is not null and new != old").select("document_id", "field", F.col("old").alias("alias"), F.col("new").alias("canonical"))
