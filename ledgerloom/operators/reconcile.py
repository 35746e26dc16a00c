"""Header reconciliation against line sums (A12 and its variants) and header fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEC = "decimal(20,8)"
HEADER = {"taxable": "grand_total_taxable", "cgst": "grand_total_cgst", "sgst": "grand_total_sgst", "final": "grand_total_final"}
LINE = {"taxable": "taxable_amount", "cgst": "cgst_amount", "sgst": "sgst_amount", "final": "final_value"}

#: Descriptions of summary rows that were read as lines.
SUMMARY_ROW = r"(?i)^(grand\s*total|sub[\s-]?total|total\s*amount|net\s*total|net\s*amount|balance\s*due|amount\s*due|total\s*due|invoice\s*total)"


def line_sums(items: DataFrame) -> DataFrame:
    """Per document: s_taxable, s_cgst, s_sgst, s_final, n_items, any_flagged. One shuffle, reduced map-side."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,8)").alias(f"s_{k}") for k, c in LINE.items()]
    flag = F.coalesce(F.bool_or("needs_review" if "needs_review" in items.columns else F.lit(False)), F.lit(False))
    return items.groupBy("document_id").agg(*sums, F.count("*").alias("n_items"), flag.alias("any_flagged"))


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    sums = line_sums(items)
    out = docs.join(sums, docs["id"] == sums["document_id"], "left").drop("document_id")
    fill = {f"s_{k}": F.coalesce(f"s_{k}", F.lit(0).cast("decimal(28,8)")) for k in LINE}
    have = set(docs.columns)
    heads = {c: F.coalesce(F.col(c).cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")) if c in have else F.lit(0).cast("decimal(28,8)") for c in [*HEADER.values(), "total_discount"]}
    return out.withColumns(fill | heads | {"any_flagged": F.coalesce("any_flagged", F.lit(False)), "n_items": F.coalesce("n_items", F.lit(0).cast("long"))})


def reconcile(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Header totals corrected only when 0 or more than 2.5 times the lines' sum, then compared.

    Differences beyond 1.00 (taxable, cgst, sgst) or 2.00 (final, with and
    without discount, tested only while nothing else is wrong) and any flagged
    line set needs_review; review_reason joins what was found.
    """
    c = F.col
    df = _joined(docs, items)
    df = df.withColumn("grand_total_taxable", F.when((c("s_taxable") > 0) & ((c("grand_total_taxable") == 0) | (c("grand_total_taxable") > c("s_taxable") * F.lit("2.5").cast("decimal(2,1)"))), c("s_taxable")).otherwise(c("grand_total_taxable")))
    for t in ("cgst", "sgst"):
        df = df.withColumn(HEADER[t], F.when((c(HEADER[t]) == 0) & (c(f"s_{t}") > 0), c(f"s_{t}")).otherwise(c(HEADER[t])))
    df = df.withColumn("expected", F.when(c("s_taxable") > 0, c("s_taxable") + c("grand_total_cgst") + c("grand_total_sgst") - c("total_discount")).otherwise(c("s_final")))
    df = df.withColumn("grand_total_final", F.when((c("expected") > 0) & ((c("grand_total_final") == 0) | (c("grand_total_final") > c("expected") * F.lit("2.5").cast("decimal(2,1)"))), c("expected")).otherwise(c("grand_total_final")))
    side = {t: F.abs(c(f"s_{t}") - c(HEADER[t])) > 1 for t in ("taxable", "cgst", "sgst")}
    wrong = side["taxable"] | side["cgst"] | side["sgst"]
    final = ~wrong & (F.abs(c("s_final") - c("grand_total_final")) > 2) & (F.abs(c("s_final") - c("total_discount") - c("grand_total_final")) > 2)
    reasons = F.concat_ws("; ", *[F.when(cond, f"{t} total mismatch") for t, cond in side.items()], F.when(final, "final total mismatch"), F.when(c("any_flagged"), "line items need review"))
    bad = wrong | final | c("any_flagged")
    return df.withColumns({"extraction_status": F.when(bad, "needs_review").otherwise("ok"), "review_reason": F.when(bad, reasons)}).drop("expected")


def reconcile_standalone(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Header filled only if its final is 0; flagged beyond 1.00 or by any flagged line."""
    c = F.col
    df = _joined(docs, items)
    empty = (c("grand_total_final") == 0) & (c("s_final") > 0)
    df = df.withColumn("__empty", empty).withColumns({HEADER[t]: F.when(c("__empty"), c(f"s_{t}")).otherwise(c(HEADER[t])) for t in HEADER}).drop("__empty")
    bad = ((c("n_items") > 0) & (F.abs(c("grand_total_final") - c("s_final")) > 1)) | c("any_flagged")
    return df.withColumn("extraction_status", F.when(bad, "needs_review").otherwise("ok"))


def fill_missing_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A12d: every header total that is 0 takes the lines' sum."""
    df = _joined(docs, items)
    return df.withColumns({HEADER[t]: F.when(F.col(HEADER[t]) == 0, F.col(f"s_{t}")).otherwise(F.col(HEADER[t])) for t in HEADER})


def reconcile_quotation(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A12b as the quotation page has it (QuotationDetail.jsx:160-215): subtotal_ok, final_ok, net_due, total_discounts.

    Summary rows among the lines do not count. The printed final is the net
    due if it lies within 500 of the lines' sum, or below what was billed but
    above a tenth of it; else the lines' sum is. The lines' finals must meet
    the printed final within 2.0 as they are, less the lines' discounts or less
    what was billed beyond the net due; the printed taxable must meet them too,
    unless the final does. A header without a total passes.
    """
    c, zero = F.col, F.lit(0).cast("decimal(28,8)")
    code = F.trim(F.coalesce("item_code", F.lit("")))
    summary = F.trim(F.coalesce("description", F.lit(""))).rlike(SUMMARY_ROW) & ((code == "") | code.rlike(r"(?i)^item-?\d+$"))
    total = lambda *cols: F.coalesce(F.sum(F.coalesce(*cols, F.lit(0))), F.lit(0)).cast("decimal(28,8)")
    sums = items.where(~summary).groupBy("document_id").agg(total("final_value", "gross_amount").alias("__sum"), total("discount_amount").alias("__off"))
    df = docs.join(sums, docs["id"] == sums["document_id"], "left").drop("document_id")
    head = lambda name: F.coalesce(c(name).cast("decimal(28,8)"), zero) if name in docs.columns else zero
    df = df.withColumns({"__sum": F.coalesce("__sum", zero), "__off": F.coalesce("__off", zero), "__taxable": head("grand_total_taxable"), "__final": head("grand_total_final")})
    df = df.withColumn("__billed", F.when(c("__taxable") > 0, c("__taxable")).otherwise(c("__sum")))
    plausible = (c("__final") > 0) & ((F.abs(c("__final") - c("__sum")) < 500) | ((c("__billed") > c("__final")) & (c("__final") * 10 > c("__billed"))))
    df = df.withColumn("net_due", F.when(plausible, c("__final")).otherwise(c("__sum")))
    df = df.withColumn("__raw", F.greatest(c("__billed") - c("net_due"), zero))
    near = lambda x, y: F.abs(x - y) <= 2
    fin = (c("__final") <= 0) | near(c("__sum"), c("__final")) | near(c("__sum") - c("__off"), c("__final")) | near(c("__sum") - c("__raw"), c("__final"))
    df = df.withColumn("final_ok", fin).withColumn("total_discounts", F.when(c("__off") > 0, c("__off")).otherwise(c("__raw")))
    sub = (c("__taxable") <= 0) | near(c("__sum"), c("__taxable")) | c("final_ok")
    return df.withColumn("subtotal_ok", sub).drop("__sum", "__off", "__taxable", "__final", "__billed", "__raw")


def verify_against(docs: DataFrame, items: DataFrame, expected: DataFrame) -> DataFrame:
    """A12e: documents against stated totals (document_no, lines, taxable, cgst, sgst, final): 0.05, final 1.00."""
    c = F.col
    got = docs.join(line_sums(items), docs["id"] == F.col("document_id")).select("document_no", "n_items", *[f"s_{k}" for k in LINE])
    near = (F.abs(c("s_taxable") - c("taxable")) <= F.lit("0.05").cast(DEC)) & (F.abs(c("s_cgst") - c("cgst")) <= F.lit("0.05").cast(DEC)) & (F.abs(c("s_sgst") - c("sgst")) <= F.lit("0.05").cast(DEC)) & (F.abs(c("s_final") - c("final")) <= 1)
    return expected.join(got, "document_no", "left").select("document_no", F.coalesce((c("n_items") == c("lines")) & near, F.lit(False)).alias("reconciled"))


def parent_status(items: DataFrame) -> DataFrame:
    """K9: a document needs review while any of its lines does."""
    return items.groupBy("document_id").agg(F.count_if("needs_review").alias("n_flagged")).withColumn("extraction_status", F.when(F.col("n_flagged") > 0, "needs_review").otherwise("ok"))
