"""Writes on Parquet: every change is a new snapshot computed from the old one, written beside it and swapped in by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep_null: bool = True) -> DataFrame:
    """K2, K8: new rows replace old ones of their key; with keep_null a null does not overwrite. One row of a key in `new`."""
    n = new.select(F.col(key).alias("__k"), F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in new.columns if c != key])
    joined = old.withColumn("__old", F.lit(True)).join(n, F.col(key) == F.col("__k"), "full")
    pick = lambda c: F.col(c) if c not in new.columns else (F.coalesce(f"__n_{c}", c) if keep_null else F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)))
    return joined.select(F.coalesce("__k", key).alias(key), *[pick(c).alias(c) for c in old.columns if c != key])


def upsert_by_hash(old: DataFrame, new: DataFrame, hash_col: str, version: str) -> DataFrame:
    """K2: of documents with one hash the newest version stays; max_by over the row, no sort."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != hash_col]
    return both.groupBy(hash_col).agg(F.max_by(F.struct(*rest), version).alias("__r")).select(hash_col, *[F.col(f"__r.{c}").alias(c) for c in rest])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """K3: all rows of a parent that has new rows are replaced by them."""
    ids = new.select(F.col(parent).alias("__p")).distinct()
    return old.join(ids, F.col(parent) == F.col("__p"), "left_anti").unionByName(new)


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """K5, K7, K9: columns set where the condition holds; None values are left out."""
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def edit_lines(items: DataFrame, edits: DataFrame) -> DataFrame:
    """K9: edits (document_id, line_no, any amounts) over lines; nulls keep the old value; then the edit rules flag."""
    from .arithmetic import flag_edited_line

    e = edits.select(F.col("document_id").alias("__d"), F.col("line_no").alias("__l"), *[F.col(c).alias(f"__e_{c}") for c in edits.columns if c not in ("document_id", "line_no")])
    joined = items.join(e, (F.col("document_id") == F.col("__d")) & (F.col("line_no") == F.col("__l")), "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"__e_{c}").cast(dict(items.dtypes)[c]), F.col(c)) for c in edits.columns if c not in ("document_id", "line_no")})
    return flag_edited_line(out.select(*items.columns))


def delete_cascade(docs: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents of `ids` (id) go with their children (document_id)."""
    gone = ids.select(F.col("id").alias("__g")).distinct()
    kept = docs.join(gone, F.col("id") == F.col("__g"), "left_anti")
    return kept, {n: c.join(gone, F.col("document_id") == F.col("__g"), "left_anti") for n, c in children.items()}


def set_null(docs: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The other delete rule: references to deleted parents become null."""
    gone = ids.select(F.col("id").alias("__g")).distinct()
    return docs.join(gone, F.col(column) == F.col("__g"), "left").withColumn(column, F.when(F.col("__g").isNull(), F.col(column))).drop("__g")


def save_records(rows: DataFrame, tables: dict[str, list[str]]) -> dict[str, DataFrame]:
    """K4: rows (document_type, record map) split by type; known types get their columns, all others JSON text."""
    out = {t: rows.where(F.col("document_type") == t).select("key", *[F.try_element_at("record", F.lit(c)).alias(c) for c in cols]) for t, cols in tables.items()}
    out["generic"] = rows.where(~F.coalesce(F.col("document_type").isin(*tables), F.lit(False))).select("key", "document_type", F.to_json("record").alias("record_json"))
    return out


def merge_duplicates(parents: DataFrame, children: DataFrame, name: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Parents of one name become the one with the smallest id; children follow."""
    from .aggregates import smallest_id

    remap = smallest_id(parents, "id", name)
    kept = parents.join(remap.where("id = keep_id").select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_semi")
    moved = children.join(remap.select(F.col("id").alias("__o"), "keep_id"), F.col(ref) == F.col("__o"), "left").withColumn(ref, F.coalesce("keep_id", ref)).drop("__o", "keep_id")
    return kept, moved


def backfill_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a total take their lines' (A18)."""
    from .aggregates import total_or_taxable

    t = total_or_taxable(items).withColumnRenamed("total", "__t")
    out = docs.join(t, F.col("id") == F.col("document_id"), "left").drop("document_id")
    return out.withColumn("grand_total_final", F.coalesce(F.nullif("grand_total_final", F.lit(0).cast("decimal(14,2)")), F.col("__t").cast("decimal(14,2)"))).drop("__t")


def migrate(old: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of an older table whose key the current one lacks, appended."""
    new = old.join(current.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def export_table(df: DataFrame) -> DataFrame:
    """As text for a sheet: null empty, booleans YES / NO, nested values as JSON."""
    def shown(c: str, kind: str) -> Column:
        if kind == "boolean":
            return F.when(F.col(c), "YES").when(~F.col(c), "NO").otherwise("")
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.to_json(c), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*[shown(c, k).alias(c) for c, k in df.dtypes])


def id_of(name: Column) -> Column:
    """A positive id from a name, the same in every run and on every executor; no counter has to be shared."""
    return F.shiftrightunsigned(F.xxhash64(name), 1)


def insert_vendors(vendors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New vendors (name, ...) appended; returns (vendors, what was inserted with ids).

    Names are compared as normalised; one known already, or blank, inserts
    nothing, and of several of one name the smallest is taken.
    """
    from ..functions.text import normalize_name

    rest = [c for c in new.columns if c != "name"]
    fresh = new.withColumn("__n", normalize_name(F.col("name"))).where("__n != ''").groupBy("__n").agg(F.min(F.struct("name", *rest)).alias("r"))
    fresh = fresh.join(vendors.select(normalize_name(F.col("name")).alias("__k")).distinct(), F.col("__n") == F.col("__k"), "left_anti")
    rows = fresh.select(id_of(F.col("__n")).alias("id"), "r.*")
    return vendors.unionByName(rows, allowMissingColumns=True), rows


def save_documents(new: DataFrame, new_items: DataFrame, documents: DataFrame, items: DataFrame, vendors: DataFrame, customers: DataFrame, allow_duplicate: bool = False) -> dict[str, DataFrame]:
    """K1: new documents and their lines saved as one plan, after duplicate detection and entity resolution.

    new: id (unique), document_no, document_type, document_date,
    grand_total_final, file_hash, vendor_name, vendor_gstin, customer_name,
    customer_gstin and any further columns; `documents` and `items` are the
    tables so far, vendors and customers have (id, name, gstin). A document is a
    duplicate by its file's hash, else by `duplicate_documents`; it and its
    lines are not saved. Names resolve by tax number or likeness, others become
    new entities. Returns the snapshots documents, items, vendors and customers,
    and outcome (id, is_duplicate, duplicate_of). A null hash equals none.
    """
    from .entities import duplicate_documents, resolve_entities

    heads = ["id", "document_no", "document_type", "document_date", "grand_total_final"]
    if allow_duplicate:
        outcome = new.select("id", F.lit(False).alias("is_duplicate"), F.lit(None).cast("long").alias("duplicate_of"))
    else:
        hashes = documents.where("file_hash is not null").groupBy(F.col("file_hash").alias("__h")).agg(F.min("id").alias("by_hash"))
        by_values = duplicate_documents(new.select(*heads), new_items, documents.select(*heads), items)
        found = new.select("id", "file_hash").join(hashes, F.col("file_hash") == F.col("__h"), "left").join(by_values, F.col("id") == F.col("new_id"), "left")
        first = F.coalesce("by_hash", "duplicate_of")
        outcome = found.select("id", first.isNotNull().alias("is_duplicate"), first.alias("duplicate_of"))
    # What later steps read several times is written to the checkpoint folder first, so that no step repeats the ones before it.
    outcome = outcome.checkpoint()
    fresh = new.join(outcome.where("not is_duplicate").select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_semi").checkpoint()
    out = {"outcome": outcome}
    for kind, known in (("vendor", vendors), ("customer", customers)):
        seen = fresh.select(F.col("id").alias("key"), F.col(f"{kind}_name").alias("name"), F.col(f"{kind}_gstin").alias("gstin"))
        found = resolve_entities(seen, known.select("id", "name", "gstin")).checkpoint()
        unknown = seen.join(found.where("entity_id is null").select(F.col("key").alias("__k")), F.col("key") == F.col("__k"), "left_semi")
        out[f"{kind}s"], added = insert_vendors(known, unknown.select("name", "gstin"))
        from ..functions.text import normalize_name

        ids = found.join(seen.select(F.col("key").alias("__s"), "name"), F.col("key") == F.col("__s")).join(added.select(F.col("id").alias("__new"), normalize_name(F.col("name")).alias("__n")), normalize_name(F.col("name")) == F.col("__n"), "left")
        ids = ids.select(F.col("key").alias("__key"), F.coalesce("entity_id", "__new").alias(f"{kind}_id"))
        fresh = fresh.join(ids, F.col("id") == F.col("__key"), "left").drop("__key").checkpoint()
    kept = fresh.drop(*[f"{k}_{part}" for k in ("vendor", "customer") for part in ("name", "gstin")])
    out["documents"] = documents.unionByName(kept, allowMissingColumns=True)
    lines = new_items.join(fresh.select(F.col("id").alias("__i")), F.col("document_id") == F.col("__i"), "left_semi")
    out["items"] = items.unionByName(lines, allowMissingColumns=True)
    return out


#: Stages of a document's way, in order.
STAGES = ["received", "classified", "extracted", "normalized", "mapped", "routed"]


def log_stage(log: DataFrame, rows: DataFrame) -> DataFrame:
    """K6: stage rows (document_id, stage, status, message, ts) appended."""
    return log.unionByName(rows, allowMissingColumns=True)


def resume_points(log: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Per document (document_id, last_stage, next_stage, failed): the furthest stage done, the one to run next (the first without any; null at the end), and whether its last row failed.

    Stages that are no part of the order are ignored.
    """
    order = F.create_map(*[x for k, s in enumerate(stages or STAGES) for x in (F.lit(s), F.lit(k))])
    names = F.array(*[F.lit(s) for s in stages or STAGES])
    rows = log.withColumn("__k", F.try_element_at(order, F.col("stage")))
    done = F.max(F.when(F.col("status") == "done", F.col("__k")))
    found = rows.groupBy("document_id").agg(F.coalesce(done, F.lit(-1)).alias("k"), F.coalesce(F.max_by("status", F.struct("ts", "__k")) == "failed", F.lit(False)).alias("failed"))
    return found.select("document_id", F.get(names, F.col("k")).alias("last_stage"), F.get(names, F.col("k") + 1).alias("next_stage"), "failed")
