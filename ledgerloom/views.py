"""The document model over the TPC-H-like tables, as DataFrames and as the same CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread, table

TYPES = {"1": "invoice_final", "2": "invoice_proforma", "3": "purchase_order", "4": "quotation", "5": "patient_account_statement"}
_TYPE_SQL = "case substr(o_orderpriority, 1, 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPES.items()) + " end"
_STATUS_SQL = "case o_orderstatus when 'O' then 'needs_review' when 'F' then 'ok' end"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without vendor: one row per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("DOC-"), F.col("o_orderkey").cast("string")).alias("document_no"),
        F.col("o_orderdate").cast("date").alias("document_date"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("grand_total_final"),
        F.expr(_TYPE_SQL).alias("document_type"),
        F.expr(_STATUS_SQL).alias("extraction_status"),
        F.concat(F.lit("scan_"), (F.col("o_orderkey") % 97).cast("string"), F.lit(".pdf")).alias("source_file"),
    )


def documents_with_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with vendor_id, the smallest supplier of the order's lines; null without lines."""
    vendor = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("vendor_id"))
    return documents(spark, sf_dir).join(vendor, "id", "left")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("state"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("state"))


_ITEM_COLUMNS = """
l_orderkey as document_id, l_linenumber as line_no, cast(l_partkey as {string}) as item_code, p_name as description,
cast(1000 + l_partkey % 9000 as {string}) as hsn_code, p_brand as brand, 'Nos' as uom, p_type as packing,
cast(l_quantity as decimal(10,2)) as qty0, cast(p_retailprice as decimal(12,2)) as rate0,
cast(round(l_discount * 100) as decimal(5,2)) as discount_pct0, cast(round(l_tax * 100) as decimal(5,2)) as tax_pct0, l_partkey, l_suppkey
"""
_BROKEN = """
document_id, line_no, item_code, description, hsn_code, brand, uom, packing,
cast(qty0 as decimal(20,8)) as qty,
cast(case when line_no % 3 = 1 then 0 else rate0 end as decimal(20,8)) as rate,
cast(case when line_no % 3 = 0 then 0 else rate0 * qty0 end as decimal(20,8)) as gross_amount,
cast(discount_pct0 as decimal(20,8)) as discount_pct, cast(0 as decimal(20,8)) as discount_amount, cast(0 as decimal(20,8)) as taxable_amount,
cast(tax_pct0 * 0.5 as decimal(20,8)) as cgst_pct, cast(0 as decimal(20,8)) as cgst_amount,
cast(tax_pct0 * 0.5 as decimal(20,8)) as sgst_pct, cast(0 as decimal(20,8)) as sgst_amount,
cast(case when l_partkey % 10 = 0 then rate0 * qty0 + 1 else 0 end as decimal(20,8)) as final_value, l_suppkey as vendor_id
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with holes and faults by fixed rules: rate or gross blank by line number, a wrong final for parts divisible by 10."""
    l, p = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    joined = l.join(p, l.l_partkey == p.p_partkey)
    raw = joined.selectExpr(*_split(_ITEM_COLUMNS.format(string="string")))
    return raw.selectExpr(*_split(_BROKEN))


def _split(text: str) -> list[str]:
    """Top-level comma separated expressions."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return [x.strip() for x in [*out, text[at:]]]


#: The same views for DuckDB; prefix a statement with `with_views`.
CTES = {
    "docs": f"select o_orderkey as id, o_custkey as customer_id, 'DOC-' || cast(o_orderkey as varchar) as document_no, cast(o_orderdate as date) as document_date, cast(o_totalprice as decimal(14,2)) as grand_total_final, {_TYPE_SQL} as document_type, {_STATUS_SQL} as extraction_status, 'scan_' || cast(o_orderkey % 97 as varchar) || '.pdf' as source_file from orders",
    "docsv": "select d.*, v.vendor_id from docs d left join (select l_orderkey, min(l_suppkey) as vendor_id from lineitem group by l_orderkey) v on v.l_orderkey = d.id",
    "vendors": "select s_suppkey as id, s_name as name, n_name as state from supplier left join nation on s_nationkey = n_nationkey",
    "customers": "select c_custkey as id, c_name as name, n_name as state from customer left join nation on c_nationkey = n_nationkey",
    "items": f"select {_BROKEN} from (select {_ITEM_COLUMNS.format(string='varchar')} from lineitem join part on l_partkey = p_partkey)",
}
_NEEDS = {"docsv": ["docs"]}


def with_views(sql: str, *names: str, **more: str) -> str:
    """`sql` behind the named views (and what they need) and further CTEs."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    parts = [f"{n} as ({CTES[n]})" for n in wanted] + [f"{n} as ({q})" for n, q in more.items()]
    return "with " + ",\n".join(parts) + "\n" + sql
