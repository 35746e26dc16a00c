"""Streams and tables that change, each run over a whole given table and held against the state that one pass over it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views as V
from ..operators import aliases as L
from ..operators import mutations as K
from ..session import shared_folder, table
from ..sources import snapshots as N
from ..streaming import learning, stages
from ..views import with_views
from .registry import query
from .relational import LOG


def _stream(s, d, name) -> DataFrame:
    """A given table as a stream of its files; by a pattern, since a source may be one file or a folder of them."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


#: The log that `t03_resume_points` reads, in the statement's terms.
_STAGED = f"with {', '.join(f'{n} as ({q})' for n, q in LOG.items())}, r as (select document_id, event_id % 4 as k, ts, value > 30 as ok from log)"


@query("t03_stage_stream", f"""{_STAGED}, f as (select document_id, coalesce(max(k) filter (where ok), -1) as far, not arg_max(ok, row(ts, k)) as failed, count(*) as n from r group by 1)
select cast(document_id as varchar) as document_id, ['received', 'classified', 'extracted', 'normalized'][far + 1] as last_stage, ['received', 'classified', 'extracted', 'normalized', 'mapped'][far + 2] as next_stage, failed from f""")
def stage_stream(s, d):
    """The stage log as a stream through the state machine; one row per document is its state."""
    names = F.array(*[F.lit(x) for x in K.STAGES])
    log = _stream(s, d, "events").select(F.col("user_id").alias("document_id"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("stage"), F.when(F.col("value") > 30, "done").otherwise("failed").alias("status"), "ts")
    sink = shared_folder(s, "stages")
    # No row of the table is late: the watermark stays behind them all.
    stages.run_to_sink(stages.stage_changes(log, late="36500 days"), f"{sink}/changes", f"{sink}/checkpoint")
    found = stages.current_states(s, f"{sink}/changes")
    return found.select("document_id", "last_stage", "next_stage", (F.col("status") == "failed").alias("failed"))


@query("t05_learning_stream", "select event_type as alias, count(*) as occurrence_count, arg_max(json_extract_string(props, '$.k'), event_id) as canonical from events group by 1")
def learning_stream(s, d):
    """Corrections as a stream into the learned table, one commit a batch; the whole stream given twice counts once."""
    folder = shared_folder(s, "learned")
    known = learning.learned_table(s, f"{folder}/table", buckets=4)
    events = _stream(s, d, "events").select(F.col("event_type").alias("alias"), F.get_json_object("props", "$.k").alias("canonical"), F.col("event_id").alias("seq"))
    learning.learn_stream(events, known, f"{folder}/checkpoint")
    # A new checkpoint reads everything again, under the same stream and batch numbers.
    learning.learn_stream(events, known, f"{folder}/again")
    return known.read().select("alias", "occurrence_count", "canonical")


@query("t01_queue_stream", "select sha256(text) as queue_id, min(doc_id) as seq, 'queued' as status, sha256(text) in (select sha256(text) from documents where doc_id % 3 = 0) as sent from documents where text is not null group by 1")
def queue_stream(s, d):
    """Texts as files that arrive; each enters the queue once, then its classification sets a field and leaves the others."""
    folder = shared_folder(s, "queue")
    q = N.queue(s, f"{folder}/log", buckets=4)

    def arrive(batch: DataFrame, k: int) -> None:
        files = batch.select(F.sha2("text", 256).alias("file_hash"), F.concat(F.lit("/in/"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("file_path"), F.lit("txt").alias("file_type"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.col("doc_id").alias("seq"))
        N.enqueue(q, files.where("file_hash is not null"), ("arrivals", k))

    for run in ("first", "again"):
        _stream(s, d, "documents").select("doc_id", "text").writeStream.foreachBatch(arrive).option("checkpointLocation", f"{folder}/{run}").trigger(availableNow=True).start().awaitTermination()
    sent = table(s, d, "documents").where("doc_id % 3 = 0 and text is not null").select(F.sha2("text", 256).alias("queue_id"), F.lit("quotation").alias("document_type"), F.lit(-1).cast("long").alias("seq")).distinct()
    N.set_status(q, sent)
    q.compact(N.latest_fields)
    return q.read().select("queue_id", "seq", "status", (F.col("document_type") == "quotation").alias("sent")).fillna(False, ["sent"])


@query("k05_quarantine", with_views("select id, id % 3 = 0 or id % 5 = 0 as reviewed, case when id % 3 = 0 then 'fixed ' || document_no else document_no end as record from docs where id % 7 < 3", "docs"))
def quarantine(s, d):
    """K5: doubtful documents sent to quarantine, some resolved with a corrected record, others dismissed; only touched buckets are rewritten."""
    t = N.quarantine(s, f"{shared_folder(s, 'quarantine')}/table", buckets=4)
    docs = V.documents(s, d).where("id % 7 < 3")
    t.append(docs.select("id", (F.col("id") % 5).cast("string").alias("document_id"), "document_type", F.col("document_no").alias("record"), F.array(F.lit("total")).alias("reasons"), F.lit("2024-01-01").cast("timestamp").alias("flagged_at"), F.lit(False).alias("reviewed")))
    N.resolve(t, docs.where("id % 3 = 0").select("id", F.concat(F.lit("fixed "), "document_no").alias("record")))
    N.dismiss(t, "0")
    return t.read().select("id", "reviewed", "record")


@query("t02_stream_once", "select distinct sha256(text) as file_hash from documents")
def stream_once(s, d):
    """The same texts streamed in two runs; the second adds nothing to the sink."""
    from ..streaming.ingest import run_available

    folder = shared_folder(s, "once")
    rows = _stream(s, d, "documents").select(F.sha2("text", 256).alias("file_hash"))
    for run in ("first", "again"):
        run_available(rows, f"{folder}/sink", f"{folder}/{run}", "file_hash")
    return s.read.schema("file_hash string").parquet(f"{folder}/sink")


@query("k12_feedback_rounds", "select alias, canonical, n >= 3 as promoted from (select lower(trim(event_type)) as alias, lower(trim(json_extract_string(props, '$.k'))) as canonical, count(*) as n from events where value > 20 and coalesce(trim(json_extract_string(props, '$.k')), '') <> '' group by 1, 2)")
def feedback_rounds(s, d):
    """Feedback in two rounds; what the first leaves pending the second may promote."""
    f = table(s, d, "events").select("event_id", F.col("event_type").alias("alias"), F.get_json_object("props", "$.k").alias("canonical"), (F.col("value") > 20).alias("accepted"))
    known, pending = s.createDataFrame([], "alias string, canonical string, confidence decimal(4,3)"), s.createDataFrame([], "alias string, canonical string, occurrence_count long")
    for part in (0, 1):
        known, pending = L.take_feedback(f.where(F.col("event_id") % 2 == part).drop("event_id"), known, pending)
    return known.select("alias", "canonical", F.lit(True).alias("promoted")).unionByName(pending.select("alias", "canonical", F.lit(False).alias("promoted")))
