"""Field mapping, routing and the entity-attribute-value form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numeric
from ..functions.text import clean_text, normalize_key

# Source names of each document type's columns.
FIELD_MAP = {
    "invoice": {
        "invoice_number": ["invoice #", "invoice no", "invoice number", "inv no", "inv #"],
        "customer_name": ["bill to", "billed to", "customer", "client"],
        "total_amount": ["total due", "amount due", "total amount", "grand total", "total"],
        "invoice_date": ["invoice date", "date"],
        "due_date": ["due date", "payment due"],
        "subtotal": ["subtotal", "sub total"],
        "tax_amount": ["tax", "vat", "gst"],
        "discount_amount": ["discount"],
        "vendor_name": ["vendor", "from", "seller"],
        "payment_terms": ["payment terms", "terms"],
        "purchase_order_number": ["po number", "po #"],
        "notes": ["notes", "remarks"],
    },
    "resume": {
        "name": ["full name", "name"], "email": ["email", "email address"], "phone": ["phone", "phone number", "mobile"], "address": ["address", "location"],
        "objective": ["objective", "summary", "professional summary"], "skills": ["skills", "technical skills"], "education": ["education"],
        "work_experience": ["work experience", "employment history", "experience"], "certifications": ["certifications"], "achievements": ["achievements"],
        "linkedin_url": ["linkedin"], "github_url": ["github"],
    },
    "financial_statement": {
        "total_assets": ["total assets"], "total_liabilities": ["total liabilities"], "net_income": ["net income"], "revenue": ["revenue"], "gross_profit": ["gross profit"],
        "operating_expenses": ["operating expenses"], "period": ["period"], "fiscal_year": ["fiscal year"],
    },
}
MIN_CONFIDENCE = 0.6
TOLERANCE = "0.05"


def field_map(spark: SparkSession, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(document_type, source_field, target) with appended rules; later rules win."""
    rows = [(t, s, target, 0) for t, m in FIELD_MAP.items() for target, names in m.items() for s in names] + [(t, s, target, k + 1) for k, (t, s, target) in enumerate(extra)]
    df = spark.createDataFrame(rows, "document_type string, source_field string, target string, ord int")
    return df.groupBy("document_type", "source_field").agg(F.max_by("target", "ord").alias("target"))


RULES = "document_type string, source_field string, target string, ord long"


def add_mapping_rule(spark: SparkSession, path: str, rules: DataFrame) -> None:
    """Rules (document_type, source_field, target, ord) appended to a folder of JSON lines; a reader sees them from its next read on."""
    rules.select("document_type", "source_field", "target", F.col("ord").cast("long").alias("ord")).write.mode("append").json(path)


def read_mapping_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a folder, by type and source field that of the highest ord; nothing is cached between reads."""
    return spark.read.schema(RULES).json(path).groupBy("document_type", "source_field").agg(F.max_by("target", F.struct("ord", "target")).alias("target"))


def _side_map(rows: DataFrame, key: Column, value: Column) -> Column:
    """A side table of rules as one map, a scalar subquery: rows look it up where they are, without a join on a handful of keys.

    Rule tables are written by hand, so they are small by nature. Null keys are
    left out; of two values of a key the greater is taken.
    """
    one = rows.select(key.alias("k"), value.alias("v")).where("k is not null").groupBy("k").agg(F.max("v").alias("v"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()


def _scoped(document_type: Column | str, field: Column | str) -> Column:
    return F.concat(document_type, F.lit("\n"), field)


def map_fields(rows: DataFrame, mapping: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows (key, document_type, record map) -> mapped fields and extras.

    A name is looked up as is, then through its alias; the rest goes to extras.
    Two sources of one target: the smallest source name wins. A null record is
    an empty one.
    """
    targets = _side_map(mapping, _scoped("document_type", "source_field"), F.col("target"))
    canonical = None if aliases is None else _side_map(aliases, normalize_key(F.col("alias")), normalize_key(F.col("canonical")))

    def named(e: Column) -> Column:
        field = normalize_key(F.replace(e["key"], F.lit("_"), F.lit(" ")))
        target = F.try_element_at(F.col("__t"), _scoped("document_type", field))
        if canonical is not None:
            target = F.coalesce(target, F.try_element_at(F.col("__t"), _scoped("document_type", F.try_element_at(F.col("__c"), field))))
        return F.struct(target.alias("target"), e["key"].alias("source"), e["value"].alias("value"))

    side = {"__t": targets} | ({} if canonical is None else {"__c": canonical})
    found = rows.withColumns(side).withColumn("__e", F.sort_array(F.transform(F.map_entries(F.coalesce("record", F.create_map().cast("map<string,string>"))), named)))
    # Sorted by target and source, the first of a target is the one that stays.
    known = F.filter("__e", lambda e: e["target"].isNotNull())
    first = F.filter(known, lambda e, k: (k == 0) | (F.get(known, k - 1)["target"] != e["target"]))
    entries = lambda xs, name: F.map_from_entries(F.transform(xs, lambda e: F.struct(e[name].alias("name"), e["value"])))
    return found.select("key", "document_type", entries(first, "target").alias("mapped"), entries(F.filter("__e", lambda e: e["target"].isNull()), "source").alias("extras"))


def _amount(c: str) -> Column:
    return numeric.normalize_currency(F.try_element_at("record", F.lit(c)))


def route(rows: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows (key, document_type, record, confidence) -> routing (accept / quarantine) and reasons.

    Invoices: amounts must not be negative and must agree within 5 % of the
    total; bad numbers count as missing. Unknown types pass unless confidence is
    low; a missing confidence passes.
    """
    inv = F.col("document_type") == "invoice"
    neg = [F.when(inv & (_amount(c) < 0), f"{c}: must not be negative") for c in ("total_amount", "subtotal", "tax_amount", "discount_amount")]
    zero = F.lit(0).cast("decimal(20,4)")
    expected = _amount("subtotal") + F.coalesce(_amount("tax_amount"), zero) - F.coalesce(_amount("discount_amount"), zero)
    off = inv & (F.abs(expected - _amount("total_amount")) > _amount("total_amount") * F.lit(TOLERANCE).cast("decimal(3,2)"))
    invalid = F.array_compact(F.array(*neg))
    later = F.array_compact(F.array(F.when(off, "line item consistency check failed"), F.when(F.col("confidence") < threshold, "low OCR confidence")))
    out = rows.withColumn("reasons", F.when(F.size(invalid) > 0, invalid).otherwise(later))
    return out.withColumn("routing", F.when(F.size("reasons") > 0, "quarantine").otherwise("accept"))


def normalize_record(rows: DataFrame, types: DataFrame) -> DataFrame:
    """values by their column's type (key, type); what does not parse stays as it is and is warned about: (row, record, warnings)."""
    kinds = _side_map(types, F.col("key"), F.col("type"))

    def typed(e: Column) -> Column:
        kind, text = F.coalesce(F.try_element_at(F.col("__kinds"), e["key"]), F.lit("text")), clean_text(e["value"])
        return F.struct(e["key"].alias("key"), e["value"].alias("v"), kind.alias("kind"), text.alias("text"))

    def parsed(x: Column) -> Column:
        out = F.when(x["kind"] == "date", dates.parse_month_first(x["text"]).cast("string")).when(x["kind"] == "currency", numeric.normalize_currency(x["text"]).cast("string")).when(x["kind"] == "number", numeric.normalize_number(x["text"]).cast("string")).otherwise(x["text"])
        return F.struct(x["key"].alias("key"), x["v"].alias("v"), x["kind"].alias("kind"), x["text"].alias("text"), out.alias("out"))

    def judged(x: Column) -> Column:
        nullish = F.lower(x["text"]).isin("", "n/a", "none", "-") | ((x["kind"] == "date") & (F.lower(x["text"]) == "null"))
        bad = x["kind"].isin("date", "currency", "number") & x["out"].isNull() & ~nullish
        warn = F.when(bad, F.concat(F.lit("Field '"), x["key"], F.lit("' failed "), x["kind"], F.lit(" normalisation for value '"), x["v"], F.lit("'")))
        return F.struct(x["key"].alias("key"), F.when(bad, x["v"]).otherwise(x["out"]).alias("out"), warn.alias("warn"))

    # One step after the other, so that no step is written out twice in the next.
    entries = F.sort_array(F.map_entries("record"))
    done = rows.withColumn("__kinds", kinds).select("row", F.transform(F.transform(F.transform(entries, typed), parsed), judged).alias("__x"))
    return done.select("row", F.map_from_entries(F.transform("__x", lambda x: F.struct(x["key"], x["out"]))).alias("record"), F.sort_array(F.filter(F.transform("__x", lambda x: x["warn"]), lambda w: w.isNotNull())).alias("warnings"))


def normalize_document(rows: DataFrame, types: DataFrame, file_names: DataFrame | None = None) -> DataFrame:
    """rows (doc, row, record) -> (doc, row, record, warnings, is_catalog): catalog documents go through the catalog rules, others through F37.

    A document is a catalog if any of its rows has a cell that is a catalog
    code, under col_N keys, or if its file name (doc, name) says price list or
    catalog. Catalog rows get canonical keys, code and description.
    """
    from . import catalogs as C

    sheet = F.exists(F.map_keys("record"), lambda k: k.startswith("col_"))
    said = rows.groupBy("doc").agg(F.bool_or(sheet & C.is_item_row(F.col("record"))).alias("is_catalog"), F.bool_or(sheet).alias("__sheet"))
    if file_names is not None:
        named = file_names.where(F.lower("name").rlike("price list|catalog|price_list")).select(F.col("doc").alias("__n")).distinct()
        said = said.join(named, F.col("doc") == F.col("__n"), "left").withColumn("is_catalog", F.col("is_catalog") | (F.col("__sheet") & F.col("__n").isNotNull())).drop("__n")
    marked = rows.join(said.select(F.col("doc").alias("__d"), F.coalesce("is_catalog", F.lit(False)).alias("is_catalog")), F.col("doc") == F.col("__d"))
    plain = normalize_record(marked.where("not is_catalog").select(F.struct("doc", "row").alias("row"), "record"), types)
    r = F.col("record")
    items = F.map_concat(F.map_filter(r, lambda k, v: ~k.isin("Item Code", "Description")), F.create_map(F.lit("Item Code"), C.item_code(r), F.lit("Description"), C.description(r)))
    rich = marked.where("is_catalog").select("doc", "row", items.alias("record"), F.array().cast("array<string>").alias("warnings"), F.lit(True).alias("is_catalog"))
    return plain.select("row.doc", "row.row", "record", "warnings", F.lit(False).alias("is_catalog")).unionByName(rich)


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps as one; of a key in both the right value stays."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def to_eav(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide -> (document_id, field_name, field_value, field_type); nulls are left out, names lower-snake."""
    kinds = dict(rows.dtypes)
    kind = lambda c: "date" if kinds[c] in ("date", "timestamp", "timestamp_ntz") else "number" if kinds[c] in ("int", "bigint", "double", "float") or kinds[c].startswith("decimal") else "text"
    fields = F.array(*[F.struct(F.lit(c.strip().lower().replace(" ", "_")).alias("field_name"), F.col(c).cast("string").alias("field_value"), F.lit(kind(c)).alias("field_type")) for c in columns])
    return rows.select(F.col(key).alias("document_id"), F.inline(fields)).where("field_value is not null")


def from_eav(eav: DataFrame) -> DataFrame:
    """One map of values per document."""
    return eav.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "field_value")))).alias("fields"))


def pivot_eav(eav: DataFrame, names: list[str]) -> DataFrame:
    """Named fields as columns; the list makes the pivot one aggregate without a first pass."""
    return eav.groupBy("document_id").pivot("field_name", names).agg(F.max("field_value"))


def json_rows(rows: DataFrame, column: str, needle: str, field: str | None = None) -> DataFrame:
    """Rows whose JSON contains a text anywhere, or in one field or field of `extras` (which may itself be JSON text)."""
    if field is None:
        return rows.where(F.col(column).ilike(f"%{needle}%"))
    extras = F.get_json_object(column, "$.extras")
    value = F.coalesce(F.get_json_object(column, f"$.{field}"), F.get_json_object(extras, f"$.{field}"))
    return rows.where(value.ilike(f"%{needle}%"))
