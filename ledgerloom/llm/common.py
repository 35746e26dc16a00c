"""What the operators share: the shared folder, Arrow plumbing, skew-safe joins, binary files."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as spark.checkpoint.dir names it; tests set their own where the cluster has none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs one read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def release(*tables: DataFrame, sweep: bool = True) -> None:
    """Remove tables that `materialize` returned and nothing reads any more; `sweep` lets Spark drop shuffle files that nothing refers to."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    for path in filter(None, (t.__dict__.pop("_written_to", None) for t in tables)):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if sweep:
        gc.collect()
        jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the vectorised path."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: T.StructType) -> DataFrame:
    """mapInArrow with `fn` from a batch to dicts of columns; batches of few rows keep long texts within memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                out = fn(part)
                for cols in [out] if isinstance(out, dict) else out or ():
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of input that one step of a Python operator holds at once; Spark itself bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch.
STEP_BYTES = 2 << 20


def sliced(batch: pa.RecordBatch, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about `limit` bytes; a single longer row stays whole."""
    n = batch.num_rows
    step = max(1, min(n, int(n * limit / max(1, batch.nbytes)))) if n else 1
    for k in range(0, n, step):
        yield batch.slice(k, step)


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def rejoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", merge: bool = False) -> DataFrame:
    """Join `right`, an aggregate by `keys`, onto rows that may hold a hot key.

    An aggregate is already dealt by its keys, so Spark would join in place and
    could not split a hot partition of `left`. A join key made from a hash of
    the keys forces a fresh exchange on both sides, which adaptive execution
    splits; the keys themselves stay part of the condition. `merge` is for rows
    behind an explode, which Spark sizes as if there were none and would send to
    the driver as a broadcast.
    """
    l = left.withColumn("__k", F.xxhash64(F.lit(11), *keys))
    r = right.select(F.xxhash64(F.lit(11), *keys).alias("__rk"), *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.col("__k") == F.col("__rk")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    return (l.hint("merge") if merge else l).join(r, on, how).drop("__k", "__rk", *[f"__r_{k}" for k in keys])


def write_binary(df: DataFrame, column: str, path: str, per_file: int, terminator: str = "\0") -> None:
    """Raw bytes to files through Spark's text sink, so that any Hadoop file system and the commit protocol apply.

    Every value is followed by `terminator`; formats here are laid out so that
    the byte belongs to them. `per_file` bounds the values in a file.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", terminator).option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files written by `write_binary`, whole: columns path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
