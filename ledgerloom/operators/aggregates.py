"""Dashboards: counts, sums, shares, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXTRACTED = ["invoice_final", "invoice_proforma", "purchase_order", "quotation"]


def by_type(docs: DataFrame) -> DataFrame:
    """Per type count, total, documents to review and share of the count in percent."""
    g = docs.groupBy("document_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("grand_total_final"), F.lit(0)).cast("decimal(20,2)").alias("total"), F.count_if(F.col("extraction_status") == "needs_review").alias("n_review"))
    share = (F.col("n") * 100 / F.sum("n").over(W.partitionBy(F.lit(0)))).cast("decimal(9,4)")
    return g.withColumn("share", share.cast("decimal(5,1)"))


def stats(docs: DataFrame) -> DataFrame:
    """One row of totals."""
    return docs.agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum("grand_total_final"), F.lit(0)).cast("decimal(20,2)").alias("total"),
        F.count_if(F.col("extraction_status") == "needs_review").alias("n_review"),
        F.count_if(F.col("document_type").isin(*EXTRACTED)).alias("n_extracted"),
    )


def by_status_display(docs: DataFrame, default: str = "ok") -> DataFrame:
    """A4: grouped by the raw value, shown with a default, so null and the default stay separate rows."""
    return docs.groupBy("extraction_status").agg(F.count("*").alias("n")).select(F.coalesce("extraction_status", F.lit(default)).alias("status"), F.col("extraction_status").isNull().alias("was_null"), "n")


def by_folded(docs: DataFrame, column: str, default: str) -> DataFrame:
    """A5: nulls fold into the default group."""
    return docs.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def item_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Lines per document, zero included."""
    n = items.groupBy("document_id").agg(F.count("*").alias("n_items"))
    return docs.join(n, F.col("id") == F.col("document_id"), "left").select("id", "document_no", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n by an order that is total."""
    return df.orderBy(*order).limit(n)


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Key groups of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def smallest_id(df: DataFrame, id_: str, name: str) -> DataFrame:
    """Every row's id remapped to the smallest of its name."""
    least = df.groupBy(name).agg(F.min(id_).alias("keep_id"))
    return df.select(id_, name).join(least.withColumnRenamed(name, "__n"), F.col(name).eqNullSafe(F.col("__n"))).select(F.col(id_).alias("id"), "keep_id")


def total_or_taxable(items: DataFrame) -> DataFrame:
    """The first of sum(final), sum(taxable), 0 that is not null and not 0."""
    s = lambda c: F.sum(F.col(c).cast("decimal(20,2)"))
    return items.groupBy("document_id").agg(F.coalesce(F.nullif(s("final_value"), F.lit(0).cast("decimal(30,2)")), s("taxable_amount"), F.lit(0)).cast("decimal(20,2)").alias("total"))


def vocabulary(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Distinct lower-case words of at least `least` letters."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), 1)).alias("word")).distinct()


def accuracy(truth: DataFrame, found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Share of matching values per field over rows joined by position."""
    f = found.select(*keys, *[F.col(c).alias(f"__f_{c}") for c in fields])
    return truth.join(f, keys, "left").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).eqNullSafe(F.col(f"__f_{c}"))).alias(f"n_{c}") for c in fields])


def outcome_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count per outcome."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def catalog(items: DataFrame) -> DataFrame:
    """Per vendor its distinct items, the last positive rate by (document, line, code), and the number of lines."""
    place = F.struct("document_id", "line_no", "item_code", "rate")
    return items.groupBy("vendor_id").agg(F.count_distinct("description").alias("n_items"), F.max_by("rate", F.when(F.col("rate") > 0, place)).alias("last_rate"), F.count("*").alias("n_lines"))


def incomplete(docs: DataFrame) -> DataFrame:
    """P20: documents without total, date or customer."""
    return docs.where((F.coalesce("grand_total_final", F.lit(0)) == 0) | F.col("document_date").isNull() | F.col("customer_id").isNull())


def mean_confidence(words: DataFrame) -> DataFrame:
    """Page confidence is the mean of its words (blank and negative left out), the document's the mean of its pages."""
    pages = words.where((F.col("confidence") >= 0) & (F.trim("text") != "")).groupBy("doc", "page").agg(F.avg("confidence").alias("c"))
    return pages.groupBy("doc").agg(F.avg("c").alias("confidence"))


def category_sum(rows: DataFrame, category: str, amount: str, only: str | None = None) -> DataFrame:
    """The sum of an amount by category, or of one category (in whatever case); a missing category is its own."""
    rows = rows if only is None else rows.where(F.lower(category) == only.lower())
    return rows.groupBy(category).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def categories(rows: DataFrame, category: str) -> DataFrame:
    """The distinct categories in use."""
    return rows.select(category).where(F.coalesce(F.trim(category), F.lit("")) != "").distinct()


def alphabetical(rows: DataFrame, name: str) -> DataFrame:
    """Rows by name regardless of case, then as written."""
    return rows.orderBy(F.lower(name), name)
