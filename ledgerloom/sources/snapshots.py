"""Tables that change, on file systems without transactions: new folders are written beside the old, and a small manifest that names the folders in use is the commit.

A row lives in the bucket of its key's hash; a change rewrites the buckets it
touches and leaves the others as they are (dynamic partition overwrite, with the
manifest in place of a rename). A write that fails before its manifest leaves the
table as it was. Manifests are numbered and created only if absent, so of two
writers one loses and has to start from the other's result. A manifest also
carries marks, such as the last batch of a stream, which thus commit with the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Snapshots:
    """A table below `path` with a fixed schema and a key column (or several)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str | list[str], buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        self.key = [key] if isinstance(key, str) else key

    # -- manifests --

    def head(self) -> dict:
        """The newest manifest: version, folders by bucket, marks. One cut short by a failure is no manifest."""
        fs, folder = _fs(self.spark, f"{self.path}/_manifests")
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in names:
            stream = fs.open(_fs(self.spark, f"{self.path}/_manifests/{name}")[1])
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
        return {"version": 0, "folders": {}, "marks": {}}

    def _commit(self, before: dict, folders: dict[str, list[str]], mark: tuple[str, int] | None) -> int:
        version = before["version"] + 1
        manifest = {"version": version, "folders": folders, "marks": before["marks"] | (dict([mark]) if mark else {})}
        fs, target = _fs(self.spark, f"{self.path}/_manifests/{version:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} exists") from e
        out.write(bytearray((json.dumps(manifest) + "\n").encode()))
        out.close()
        return version

    # -- reading --

    def read(self, buckets: list[int] | None = None, at: dict | None = None) -> DataFrame:
        """The rows of the newest (or a given) manifest; of some buckets only, if asked."""
        folders = (at or self.head())["folders"]
        paths = [p for b, ps in folders.items() if buckets is None or int(b) in buckets for p in ps]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def marked(self, stream: str) -> int:
        """The last batch of a stream that is in the table, -1 before any."""
        return self.head()["marks"].get(stream, -1)

    # -- writing --

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        return typed.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows to a new folder; which bucket lies where. A task that is run twice commits once."""
        name = f"data-{uuid.uuid4().hex}"
        rows.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        fs, folder = _fs(self.spark, f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return {d.split("=")[1]: f"{name}/{d}" for d in found if d.startswith(BUCKET)}

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Rows beside those there are; a batch of a stream that is in already changes nothing."""
        before = self.head()
        if mark and before["marks"].get(mark[0], -1) >= mark[1]:
            return before["version"]
        new = self._write(self._bucketed(rows))
        folders = {b: before["folders"].get(b, []) + ([new[b]] if b in new else []) for b in before["folders"] | new}
        return self._commit(before, folders, mark)

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], mark: tuple[str, int] | None = None) -> int:
        """`apply(old, changes)` over the buckets that the changes' keys touch; the others stay unread. A batch that is in already changes nothing."""
        before = self.head()
        if mark and before["marks"].get(mark[0], -1) >= mark[1]:
            return before["version"]
        at = changes.select(F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)).distinct()
        touched = sorted(r[0] for r in at.collect())  # at most as many as there are buckets
        new = self._write(self._bucketed(apply(self.read(touched, before), changes))) if touched else {}
        folders = {b: p for b, p in before["folders"].items() if int(b) not in touched} | {b: [p] for b, p in new.items()}
        return self._commit(before, folders, mark)

    def compact(self, apply: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Every bucket rewritten as one folder, through `apply`."""
        before = self.head()
        new = self._write(self._bucketed(apply(self.read(at=before))))
        return self._commit(before, {b: [p] for b, p in new.items()}, None)

    def vacuum(self) -> int:
        """Folders that the newest manifest does not name, removed, and older manifests; not while others read or write."""
        head = self.head()
        used = {p.split("/")[0] for ps in head["folders"].values() for p in ps}
        gone = 0
        fs, top = _fs(self.spark, self.path)
        for s in fs.listStatus(top):
            if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
                gone += 1
        for s in fs.listStatus(_fs(self.spark, f"{self.path}/_manifests")[1]):
            if s.getPath().getName() < f"{head['version']:012d}.json":
                fs.delete(s.getPath(), False)
        return gone


# -- K7: the queue --

QUEUE = "queue_id string, file_hash string, file_path string, file_type string, status string, document_type string, confidence double, created_at timestamp, seq long"


def queue(spark: SparkSession, path: str, buckets: int = 16) -> Snapshots:
    """K7: an append log of queue entries and their changes; a change has only the fields it sets."""
    return Snapshots(spark, path, QUEUE, "queue_id", buckets)


def latest_fields(log: DataFrame, key: str = "queue_id", seq: str = "seq") -> DataFrame:
    """K7: per key the last non-null value of every field; one pass, reduced where the rows lie."""
    rest = [c for c in log.columns if c not in (key, seq)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return log.groupBy(key).agg(*last, F.max(seq).alias(seq)).select(*log.columns)


def enqueue(table: Snapshots, files: DataFrame, mark: tuple[str, int] | None = None) -> int:
    """Files (file_hash, file_path, file_type, created_at, seq) that no entry has yet, as queued; the queue_id is the hash, so a file enters once."""
    known = table.read().select(F.col("file_hash").alias("__h")).where("__h is not null").distinct()
    new = files.where("file_hash is not null").groupBy("file_hash").agg(F.min(F.struct("created_at", "file_path", "file_type", "seq")).alias("r"))
    new = new.join(known, F.col("file_hash") == F.col("__h"), "left_anti")
    none = {"document_type": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}
    return table.append(new.select(F.col("file_hash").alias("queue_id"), "file_hash", "r.file_path", "r.file_type", F.lit("queued").alias("status"), *[v.alias(k) for k, v in none.items()], "r.created_at", "r.seq"), mark)


def set_status(table: Snapshots, changes: DataFrame, mark: tuple[str, int] | None = None) -> int:
    """K7: changes (queue_id, seq and any fields) appended; entries that do not exist are left out, nulls change nothing."""
    known = table.read().select(F.col("queue_id").alias("__k")).distinct()
    kept = changes.join(known, F.col("queue_id") == F.col("__k"), "left_semi")
    columns = {f.name: F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType) for f in table.schema}
    return table.append(kept.select(*[v.alias(k) for k, v in columns.items()]), mark)


# -- K5: the quarantine --

QUARANTINE = "id long, document_id string, document_type string, record string, reasons array<string>, flagged_at timestamp, reviewed boolean"


def quarantine(spark: SparkSession, path: str, buckets: int = 16) -> Snapshots:
    """K5: doubtful records by id, the record as JSON text."""
    return Snapshots(spark, path, QUARANTINE, "id", buckets)


def _review(old: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.groupBy(F.col("id").alias("__id")).agg(F.max("record").alias("__new"))
    met = old.join(c, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return met.withColumns({"reviewed": F.col("reviewed") | hit, "record": F.when(hit, F.coalesce("__new", "record")).otherwise(F.col("record"))}).drop("__id", "__new")


def resolve(table: Snapshots, changes: DataFrame) -> DataFrame:
    """K5: changes (id, record: corrected JSON or null) mark their items reviewed; returns the corrected records (document_id, document_type, record) for the document tables.

    An id that is not there raises, before anything is written.
    """
    before = table.head()
    missing = changes.join(table.read(at=before).select(F.col("id").alias("__k")), F.col("id") == F.col("__k"), "left_anti").limit(3).collect()
    if missing:
        raise KeyError(f"no quarantined item {[r.id for r in missing]}")
    table.change(changes, _review)
    fixed = changes.where("record is not null").select(F.col("id").alias("__k"), F.col("record").alias("__new"))
    return table.read().join(fixed, F.col("id") == F.col("__k")).select("document_id", "document_type", F.col("__new").alias("record"))


def dismiss(table: Snapshots, document_id: str | None = None) -> int:
    """K5: all open items (of one document, if given) become reviewed; returns how many did."""
    open_ = table.read().where("not reviewed")
    ids = (open_ if document_id is None else open_.where(F.col("document_id") == document_id)).select("id", F.lit(None).cast("string").alias("record"))
    n = ids.count()
    if n:
        table.change(ids, _review)
    return n
