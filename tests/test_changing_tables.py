"""Streams with state and tables that change: restarts, repeated batches, failed writes."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aliases, mutations
from ledgerloom.sources import snapshots as N
from ledgerloom.streaming import learning, stages

LOG = "document_id string, stage string, status string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def _folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _file(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _steps(n_docs, n_stages, start):
    names = mutations.STAGES
    return [(f"d{d}", names[k], "failed" if (d + k) % 5 == 0 else "done", start + dt.timedelta(minutes=10 * k + d)) for d in range(n_docs) for k in range(n_stages)]


def test_stage_machine_over_two_runs_and_a_killed_batch(spark):
    source, sink, check = _folder(), _folder() + "/out", _folder()
    first, second = _steps(12, 3, T0), [(d, s, st, ts + dt.timedelta(minutes=40)) for d, s, st, ts in _steps(9, 6, T0)]
    _file(spark, source, first, LOG, "a")
    run = lambda before=lambda k: None: stages.run_to_sink(stages.stage_changes(_stream(spark, source, LOG), late="1 day"), sink, check, before)
    run()
    _file(spark, source, second, LOG, "b")

    def killed(k):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed)
    run()
    run()
    log = spark.createDataFrame(first + second, LOG)
    want = {r.document_id: (r.last_stage, r.next_stage, r.failed) for r in mutations.resume_points(log).collect()}
    got = stages.current_states(spark, sink).collect()
    assert len(got) == len(want) == 12
    assert {r.document_id: (r.last_stage, r.next_stage, r.status == "failed") for r in got} == want


def test_silent_documents_are_tried_again_and_given_up(spark):
    source, sink, check = _folder(), _folder() + "/out", _folder()
    hours = lambda n: T0 + dt.timedelta(hours=n)
    _file(spark, source, [("slow", "received", "done", T0), ("fast", "received", "done", T0)], LOG, "a")
    run = lambda: stages.run_to_sink(stages.stage_changes(_stream(spark, source, LOG), late="10 minutes", patience_s=3600, tries=2), sink, check)
    run()
    _file(spark, source, [("fast", s, "done", hours(0.5)) for s in mutations.STAGES[1:]], LOG, "b")
    run()
    state = lambda: {r.document_id: (r.status, r.attempts, r.last_stage) for r in stages.current_states(spark, sink).collect()}
    assert state() == {"slow": ("done", 0, "received"), "fast": ("finished", 0, mutations.STAGES[-1])}
    _file(spark, source, [("other", "received", "done", hours(1.5))], LOG, "c")
    run()
    assert state()["slow"] == ("retry", 1, "received")
    _file(spark, source, [("other", "classified", "done", hours(9))], LOG, "d")
    run()
    assert state()["slow"] == ("given_up", 2, "received") and state()["fast"][0] == "finished"
    _file(spark, source, [("slow", "classified", "done", hours(9.5))], LOG, "e")
    run()
    assert state()["slow"] == ("done", 0, "classified")


def test_learning_twice_changes_nothing(spark):
    source, check = _folder(), _folder()
    table = learning.learned_table(spark, _folder() + "/learned", buckets=4)
    rows = [(f"a{k % 7}", f"c{k % 3}", k) for k in range(60)]
    schema = "alias string, canonical string, seq long"
    _file(spark, source, rows[:25], schema, "a")
    known = []
    see = lambda old, batch, k: known.append(old.count())
    learning.learn_stream(_stream(spark, source, schema), table, check, seen=see)
    _file(spark, source, rows[25:], schema, "b")
    learning.learn_stream(_stream(spark, source, schema), table, check, seen=see)
    want = {(r.alias, r.canonical, r.occurrence_count) for r in aliases.learned_counts(spark.createDataFrame(rows, schema)).collect()}
    got = lambda: {(r.alias, r.canonical, r.occurrence_count) for r in table.read().collect()}
    assert got() == want and known == [0, 7]
    version = table.head()["version"]
    assert learning.learn_batch(table, spark.createDataFrame(rows[25:], schema), "corrections", 1) == version and got() == want
    learning.learn_batch(table, spark.createDataFrame([("a0", "new", 99)], schema), "edits", 0)
    assert ("a0", "new", 10) in got()
    corrections = spark.createDataFrame([("Widgt ", "Widget", 1), ("same", "same", 2), (" ", "x", 3), ("old", None, 4)], "old string, new string, seq long")
    assert [tuple(r) for r in learning.relearning(corrections).collect()] == [("widgt", "widget", 1)]


def test_a_failed_write_leaves_the_old_snapshot(spark):
    table = N.Snapshots(spark, _folder() + "/t", "id long, v string", "id", buckets=4)
    assert table.read().count() == 0
    table.append(spark.range(20).select("id", F.lit("old").alias("v")))
    before = table.head()
    broken = lambda old, new: old.withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.change(spark.range(3).select("id", F.lit("x").alias("v")), broken)
    assert table.head() == before and table.read().where("v = 'old'").count() == 20
    replace = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    table.change(spark.range(3).select("id", F.lit("new").alias("v")), replace)
    assert {r.id: r.v for r in table.read().collect()} == {k: "new" if k < 3 else "old" for k in range(20)}
    kept = [b for b in before["folders"] if before["folders"][b] == table.head()["folders"].get(b)]
    assert kept, "buckets that no change touched stay as they are"
    with pytest.raises(N.Conflict):
        table._commit(before, before["folders"], None)
    assert table.vacuum() >= 0 and table.read().count() == 20
    table.compact()
    assert table.vacuum() >= 1 and table.read().count() == 20


def test_queue(spark):
    q = N.queue(spark, _folder() + "/queue", buckets=4)
    files = spark.createDataFrame([("h1", "/in/a.pdf", "pdf", T0, 1), ("h1", "/in/b.pdf", "pdf", T0, 2), ("h2", "/in/c.csv", "csv", T0, 3), (None, "/in/d", None, T0, 4)], "file_hash string, file_path string, file_type string, created_at timestamp, seq long")
    N.enqueue(q, files, ("folder", 0))
    N.enqueue(q, files, ("folder", 0))
    N.enqueue(q, files)
    assert q.read().count() == 2
    N.set_status(q, spark.createDataFrame([("h1", "processing", None, 10), ("zz", "failed", None, 11)], "queue_id string, status string, confidence double, seq long"))
    N.set_status(q, spark.createDataFrame([("h1", "invoice", 0.8, 12)], "queue_id string, document_type string, confidence double, seq long"))
    view = lambda: {r.queue_id: (r.status, r.document_type, r.confidence, r.file_path) for r in N.latest_fields(q.read()).collect()}
    want = {"h1": ("processing", "invoice", 0.8, "/in/a.pdf"), "h2": ("queued", None, None, "/in/c.csv")}
    assert view() == want
    q.compact(N.latest_fields)
    assert q.read().count() == 2 and view() == want


def test_quarantine(spark):
    t = N.quarantine(spark, _folder() + "/quarantine", buckets=4)
    t.append(spark.range(1, 7).selectExpr("id", "concat('d', id % 2) as document_id", "'invoice' as document_type", "'{}' as record", "array('bad') as reasons", "timestamp'2024-01-01' as flagged_at", "false as reviewed"))
    fixed = N.resolve(t, spark.createDataFrame([(1, '{"total": 5}'), (2, None)], "id long, record string"))
    assert [tuple(r) for r in fixed.collect()] == [("d1", "invoice", '{"total": 5}')]
    rows = {r.id: (r.reviewed, r.record) for r in t.read().collect()}
    assert rows == {1: (True, '{"total": 5}'), 2: (True, "{}"), **{k: (False, "{}") for k in range(3, 7)}}
    with pytest.raises(KeyError):
        N.resolve(t, spark.createDataFrame([(99, None)], "id long, record string"))
    assert N.dismiss(t, "d1") == 2 and N.dismiss(t) == 2 and N.dismiss(t) == 0
    assert t.read().where("reviewed").count() == 6
