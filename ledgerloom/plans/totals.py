"""Line arithmetic and header reconciliation over the views with holes and faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import arithmetic as R
from ..operators import entities as E
from ..operators import reconcile as C
from ..session import table
from ..views import with_views
from .registry import query

D = "decimal(20,8)"


def _z(name: str, cond: str, value: str, cols: list[str]) -> str:
    """One fill as a select over the columns."""
    return "select " + ", ".join(f"cast(case when {cond} then {value} else {name} end as {D}) as {c}" if c == name else c for c in cols)


KEYS = ["document_id", "line_no", "item_code", "description"]
AMOUNTS = ["qty", "rate", "gross_amount", "discount_pct", "discount_amount", "taxable_amount", "cgst_pct", "cgst_amount", "sgst_pct", "sgst_amount", "final_value"]
COLS = [*KEYS, *AMOUNTS]


def _chain(fills: list[tuple[str, str, str]], start: str = "items") -> dict[str, str]:
    out, at = {}, start
    for k, (name, cond, value) in enumerate(fills):
        out[f"f{k}"] = f"{_z(name, cond, value, COLS)} from {at}"
        at = f"f{k}"
    out["filled"] = f"select * from {at}"
    return out


FILLS = _chain(
    [
        ("qty", "qty = 0", "1"),
        ("gross_amount", "rate > 0 and gross_amount = 0", "rate * qty"),
        ("rate", "gross_amount > 0 and rate = 0", "cast(gross_amount as double) / cast(qty as double)"),
        ("discount_amount", "discount_pct > 0 and discount_amount = 0", "cast(gross_amount as decimal(14,2)) * cast(discount_pct as decimal(5,2)) * 0.01"),
        ("taxable_amount", "gross_amount > 0 and taxable_amount = 0", "gross_amount - discount_amount"),
        ("taxable_amount", "taxable_amount = 0 and final_value > 0", "final_value"),
        ("cgst_amount", "cgst_pct > 0 and cgst_amount = 0", "cast(taxable_amount as decimal(16,4)) * cast(cgst_pct as decimal(5,2)) * 0.01"),
        ("sgst_amount", "sgst_pct > 0 and sgst_amount = 0", "cast(taxable_amount as decimal(16,4)) * cast(sgst_pct as decimal(5,2)) * 0.01"),
        ("final_value", "final_value = 0 and taxable_amount > 0", "taxable_amount + cgst_amount + sgst_amount"),
        ("gross_amount", "final_value > 0 and gross_amount = 0", "final_value"),
    ]
)
FLAGGED = FILLS | {"flagged": """select *, abs(gross_amount - cast(rate as decimal(14,4)) * cast(qty as decimal(10,2))) > 0.05 or abs(final_value - (taxable_amount + cgst_amount + sgst_amount)) > 0.05 as needs_review,
nullif(concat_ws('; ', case when abs(gross_amount - cast(rate as decimal(14,4)) * cast(qty as decimal(10,2))) > 0.05 then 'Gross Amount mismatch' end, case when abs(final_value - (taxable_amount + cgst_amount + sgst_amount)) > 0.05 then 'Final Value mismatch' end), '') as review_reason from filled"""}
SHOWN = "document_id, line_no, item_code, " + ", ".join(f"cast({c} as decimal(18,4)) as {c}" for c in AMOUNTS) + ", needs_review, review_reason"


def _shown(df):
    return df.select("document_id", "line_no", "item_code", *[F.col(c).cast("decimal(18,4)").alias(c) for c in AMOUNTS], "needs_review", "review_reason")


@query("a11_validate_line", with_views(f"select {SHOWN} from flagged", "items", **FLAGGED))
def validate_line(s, d):
    return _shown(R.validate_line(V.items(s, d)))


@query("p19_review_queue", with_views("select d.document_no, f.document_id, f.line_no, f.item_code, f.review_reason from flagged f join docs d on d.id = f.document_id where needs_review", "docs", "items", **FLAGGED))
def review_queue(s, d):
    from ..operators.documents import review_queue as f

    return f(V.documents(s, d), R.validate_line(V.items(s, d))).select("document_no", "document_id", "line_no", "item_code", "review_reason")


EDIT = """select *, concat_ws('; ', case when gross_amount > 0 and abs(gross_amount - cast(rate as decimal(14,2)) * cast(qty as decimal(10,2))) > greatest(cast(rate as decimal(14,2)) * cast(qty as decimal(10,2)) * 0.05, 5) then 'Gross Amount mismatch' end,
case when abs(discount_amount - cast(gross_amount as decimal(14,2)) * cast(discount_pct as decimal(5,2)) * 0.01) > 0.02 then 'Discount Amount mismatch' end,
case when abs(taxable_amount - (gross_amount - discount_amount)) > 0.02 then 'Taxable Amount mismatch' end,
case when abs(cgst_amount - cast(taxable_amount as decimal(14,2)) * cast(cgst_pct as decimal(5,2)) * 0.01) > 0.02 then 'CGST Amount mismatch' end,
case when abs(sgst_amount - cast(taxable_amount as decimal(14,2)) * cast(sgst_pct as decimal(5,2)) * 0.01) > 0.02 then 'SGST Amount mismatch' end,
case when abs(final_value - (taxable_amount + cgst_amount + sgst_amount)) > 0.02 then 'Final Value mismatch' end) as reasons from items"""


@query("a11b_edited_line", with_views("select document_id, line_no, item_code, qty <> 0 and rate <> 0 and reasons <> '' as needs_review, case when qty <> 0 and rate <> 0 and reasons <> '' then reasons end as review_reason from e", "items", e=EDIT))
def edited_line(s, d):
    return R.flag_edited_line(V.items(s, d)).select("document_id", "line_no", "item_code", "needs_review", "review_reason")


def _cents(x: str) -> str:
    return f"cast({x} as decimal(18,2))"


ROUNDED = _chain(
    [
        (name, f"{name} = 0 and {_cents(value)} > 0", _cents(value))
        for name, value in (
            ("gross_amount", "cast(qty as decimal(10,2)) * cast(rate as decimal(14,2))"),
            ("discount_amount", "cast(gross_amount as decimal(14,2)) * cast(discount_pct as decimal(5,2)) * 0.01"),
            ("taxable_amount", "gross_amount - discount_amount"),
            ("cgst_amount", "cast(taxable_amount as decimal(14,2)) * cast(cgst_pct as decimal(5,2)) * 0.01"),
            ("sgst_amount", "cast(taxable_amount as decimal(14,2)) * cast(sgst_pct as decimal(5,2)) * 0.01"),
            ("final_value", "taxable_amount + cgst_amount + sgst_amount"),
        )
    ]
)


@query("a11c_rounded_line", with_views("select document_id, line_no, item_code, cast(gross_amount as decimal(18,2)) as gross_amount, cast(taxable_amount as decimal(18,2)) as taxable_amount, cast(cgst_amount as decimal(18,2)) as cgst_amount, cast(final_value as decimal(18,2)) as final_value, abs(final_value - (taxable_amount + cgst_amount + sgst_amount)) > 0.05 as needs_review from filled", "items", **ROUNDED))
def rounded_line(s, d):
    out = R.validate_line_rounded(V.items(s, d))
    return out.select("document_id", "line_no", "item_code", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("gross_amount", "taxable_amount", "cgst_amount", "final_value")], "needs_review")


SUMS = FLAGGED | {
    "sums": "select document_id, sum(taxable_amount) as s_taxable, sum(cgst_amount) as s_cgst, sum(sgst_amount) as s_sgst, sum(final_value) as s_final, count(*) as n_items, bool_or(needs_review) as any_flagged from flagged group by document_id",
    "j": "select d.id, cast(d.grand_total_final as decimal(28,8)) as gf, coalesce(s_taxable, 0) as st, coalesce(s_cgst, 0) as sc, coalesce(s_sgst, 0) as ss, coalesce(s_final, 0) as sf, coalesce(n_items, 0) as n_items, coalesce(any_flagged, false) as fl from docs d left join sums on document_id = d.id",
}
A12 = SUMS | {
    "h": "select *, case when st > 0 then st else cast(0 as decimal(28,8)) end as gt, case when sc > 0 then sc else cast(0 as decimal(28,8)) end as gc, case when ss > 0 then ss else cast(0 as decimal(28,8)) end as gs from j",
    "x": "select *, case when st > 0 then st + gc + gs else sf end as expected from h",
    "y": "select *, case when expected > 0 and (gf = 0 or gf > expected * 2.5) then expected else gf end as g from x",
    "z": "select *, abs(st - gt) > 1 as wt, abs(sc - gc) > 1 as wc, abs(ss - gs) > 1 as ws from y",
    "q": "select *, not (wt or wc or ws) and abs(sf - g) > 2 as wf from z",
}


@query("a12_reconcile", with_views("""select id, cast(g as decimal(20,4)) as grand_total_final, cast(gt as decimal(20,4)) as grand_total_taxable, case when wt or wc or ws or wf or fl then 'needs_review' else 'ok' end as extraction_status,
nullif(concat_ws('; ', case when wt then 'taxable total mismatch' end, case when wc then 'cgst total mismatch' end, case when ws then 'sgst total mismatch' end, case when wf then 'final total mismatch' end, case when fl then 'line items need review' end), '') as review_reason from q""", "docs", "items", **A12))
def reconcile(s, d):
    out = C.reconcile(V.documents(s, d), R.validate_line(V.items(s, d)))
    return out.select("id", F.col("grand_total_final").cast("decimal(20,4)").alias("grand_total_final"), F.col("grand_total_taxable").cast("decimal(20,4)").alias("grand_total_taxable"), "extraction_status", "review_reason")


QUOTATION = FLAGGED | {
    "real": r"""select * from flagged where not (regexp_matches(trim(coalesce(description, '')), '(?i)^(grand\s*total|sub[\s-]?total|total\s*amount|net\s*total|net\s*amount|balance\s*due|amount\s*due|total\s*due|invoice\s*total)') and (trim(coalesce(item_code, '')) = '' or regexp_matches(trim(item_code), '(?i)^item-?\d+$')))""",
    "page": """select d.id, cast(case when d.id % 3 = 0 then d.grand_total_final else 0 end as decimal(28,8)) as expected_taxable, cast(coalesce(d.grand_total_final, 0) as decimal(28,8)) as expected_final,
coalesce(sum(coalesce(r.final_value, r.gross_amount)), 0) as sum_of_final, coalesce(sum(r.discount_amount), 0) as sum_of_line_discounts from docs d left join real r on r.document_id = d.id group by all""",
    "billed": "select *, case when expected_taxable > 0 then expected_taxable else sum_of_final end as billed_charges from page",
    "due": "select *, case when expected_final > 0 and (abs(expected_final - sum_of_final) < 500 or (billed_charges > expected_final and expected_final > billed_charges * 0.1)) then expected_final else sum_of_final end as net_due from billed",
    "raw": "select *, case when billed_charges > net_due then billed_charges - net_due else 0 end as raw_diff_discount from due",
    "fin": "select *, case when expected_final > 0 then abs(sum_of_final - expected_final) <= 2 or abs((sum_of_final - sum_of_line_discounts) - expected_final) <= 2 or abs((sum_of_final - raw_diff_discount) - expected_final) <= 2 else true end as final_ok from raw",
}


@query("a12b_quotation_check", with_views("select id, case when expected_taxable > 0 then abs(sum_of_final - expected_taxable) <= 2 or final_ok else true end as subtotal_ok, final_ok, cast(net_due as decimal(20,4)) as net_due, cast(case when sum_of_line_discounts > 0 then sum_of_line_discounts else raw_diff_discount end as decimal(20,4)) as total_discounts from fin", "docs", "items", **QUOTATION))
def quotation_check(s, d):
    """A12b in full; a third of the headers state a taxable total."""
    docs = V.documents(s, d).withColumn("grand_total_taxable", F.when(F.col("id") % 3 == 0, F.col("grand_total_final")))
    out = C.reconcile_quotation(docs, R.validate_line(V.items(s, d)))
    return out.select("id", "subtotal_ok", "final_ok", F.col("net_due").cast("decimal(20,4)").alias("net_due"), F.col("total_discounts").cast("decimal(20,4)").alias("total_discounts"))


@query("a12c_standalone", with_views("select id, cast(case when gf = 0 and sf > 0 then sf else gf end as decimal(20,4)) as grand_total_final, case when (n_items > 0 and abs((case when gf = 0 and sf > 0 then sf else gf end) - sf) > 1) or fl then 'needs_review' else 'ok' end as extraction_status from j", "docs", "items", **SUMS))
def standalone(s, d):
    out = C.reconcile_standalone(V.documents(s, d), R.validate_line(V.items(s, d)))
    return out.select("id", F.col("grand_total_final").cast("decimal(20,4)").alias("grand_total_final"), "extraction_status")


@query("a12d_fill_totals", with_views("select id, cast(st as decimal(20,4)) as grand_total_taxable, cast(case when gf = 0 then sf else gf end as decimal(20,4)) as grand_total_final from j", "docs", "items", **SUMS))
def fill_totals(s, d):
    out = C.fill_missing_totals(V.documents(s, d), R.validate_line(V.items(s, d)))
    return out.select("id", F.col("grand_total_taxable").cast("decimal(20,4)").alias("grand_total_taxable"), F.col("grand_total_final").cast("decimal(20,4)").alias("grand_total_final"))


@query("a12e_verify", with_views("select d.document_no, coalesce(s.n_items = n.n + d.id % 2, false) as reconciled from docs d left join sums s on s.document_id = d.id left join (select document_id, count(*) as n from items group by 1) n on n.document_id = d.id", "docs", "items", **SUMS))
def verify(s, d):
    """A12e over all documents; those with an odd id are given one line too many."""
    items = R.validate_line(V.items(s, d))
    docs = V.documents(s, d)
    sums = C.line_sums(items)
    expected = docs.join(sums, F.col("id") == F.col("document_id"), "left").select("document_no", (F.col("n_items") + F.col("id") % 2).alias("lines"), F.col("s_taxable").alias("taxable"), F.col("s_cgst").alias("cgst"), F.col("s_sgst").alias("sgst"), F.col("s_final").alias("final"))
    return C.verify_against(docs, items, expected)


@query("k09_edit_lines", with_views("select document_id, line_no, item_code, cast(case when document_id % 100 = 0 and line_no = 1 then 3 else qty end as decimal(18,2)) as qty from items", "items"))
def edit_lines(s, d):
    """K9: some first lines of documents get another quantity, in the whole table of lines."""
    from ..operators.mutations import edit_lines as f

    items = V.items(s, d)
    edits = items.where("document_id % 100 = 0 and line_no = 1").select("document_id", "line_no").distinct().select("document_id", "line_no", F.lit(3).alias("qty"), F.lit(None).cast("decimal(20,8)").alias("rate"))
    return f(items, edits).select("document_id", "line_no", "item_code", F.col("qty").cast("decimal(18,2)").alias("qty"))


@query("k09_parent_status", with_views("select document_id, count(*) filter (where needs_review) as n_flagged, case when count(*) filter (where needs_review) > 0 then 'needs_review' else 'ok' end as extraction_status from flagged group by 1", "items", **FLAGGED))
def parent_status(s, d):
    return C.parent_status(R.validate_line(V.items(s, d)))


@query("a18_total_or_taxable", with_views("select document_id, cast(coalesce(nullif(sum(cast(final_value as decimal(20,2))), 0), sum(cast(taxable_amount as decimal(20,2))), 0) as decimal(20,2)) as total from items group by 1", "items"))
def total_or_taxable(s, d):
    from ..operators.aggregates import total_or_taxable as f

    return f(V.items(s, d))


@query("j08_band_join", "with n as (select o_orderkey as id, cast(o_totalprice as decimal(14,2)) as t from orders) select a.id as new_id, b.id as old_id from n a join n b on abs(a.t - b.t) < 0.5 and floor(b.t) between floor(a.t) - 1 and floor(a.t) + 1 where a.id % 50 = 0")
def band_join(s, d):
    """The stated query set (id % 50 = 0) against all rows, each document's own included."""
    docs = V.documents(s, d)
    return E.band_candidates(docs.where("id % 50 = 0"), docs)


@query("j09_duplicates", with_views("select id + 1000000000 as new_id, id as duplicate_of from docs where id % 50 = 0", "docs"))
def duplicates(s, d):
    docs, items = V.documents(s, d), V.items(s, d)
    new = docs.where("id % 50 = 0").select((F.col("id") + 10**9).alias("id"), "document_no", "document_type", "document_date", "grand_total_final")
    lines = items.where("document_id % 50 = 0").withColumn("document_id", F.col("document_id") + 10**9)
    return E.duplicate_documents(new, lines, docs, items)


@query("j07_entities", None)
def entities(s, d):
    known = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("GST"), (F.col("s_suppkey") % 90).cast("string")).alias("gstin"))
    seen = known.select(F.col("id").alias("key"), F.when(F.col("id") % 7 == 0, F.expr("substring(name, 2)")).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 3 == 0, F.col("gstin")).alias("gstin"))
    return E.resolve_entities(seen, known)


@query("f20_edit_similarity", "select a.n_name as a, b.n_name as b, cast(cast(levenshtein(lower(a.n_name), lower(b.n_name)) as bigint) as bigint) as distance from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey where 1 - levenshtein(lower(a.n_name), lower(b.n_name))::double / greatest(length(a.n_name), length(b.n_name)) >= 0.2")
def edit_similarity(s, d):
    from ..functions.text import edit_similarity as f

    n = table(s, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("r")), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), F.col("n_regionkey").alias("r"))
    return a.join(b, "r").where("ka < kb").where(f(F.col("a"), F.col("b")) >= 0.2).select("a", "b", F.levenshtein(F.lower("a"), F.lower("b")).cast("long").alias("distance"))


@query("k01_save_documents", with_views("""select id + 1000000000 as id, id % 100 = 0 as is_duplicate, case when id % 100 = 0 then id end as duplicate_of, (select count(*) from items where document_id = d.id) * (case when id % 100 = 0 then 0 else 1 end) as n_lines,
case when id % 100 <> 0 then vendor_name end as vendor_name from named d where id % 50 = 0""", "docs", "docsv", "vendors", "customers", "items", named="select d.*, case when d.id % 150 = 0 then 'Brand New Traders ' || cast(d.id % 7 as varchar) else v.name end as vendor_name from docsv d left join vendors v on v.id = d.vendor_id"))
def save_documents(s, d):
    """K1: copies of every fiftieth document come in; half of them have other numbers and totals and are new, some from new vendors."""
    from ..operators import mutations as K

    docs = V.documents_with_vendor(s, d).withColumn("file_hash", F.lit(None).cast("string"))
    vendors = V.vendors(s, d).select("id", "name", F.concat(F.lit("GST"), F.col("id").cast("string")).alias("gstin"))
    customers = V.customers(s, d).select("id", "name", F.lit(None).cast("string").alias("gstin"))
    other = F.col("id") % 100 != 0
    copies = docs.where("id % 50 = 0").join(vendors.select(F.col("id").alias("__v"), F.col("name").alias("__name"), "gstin"), F.col("vendor_id") == F.col("__v"), "left")
    brand_new = F.col("id") % 150 == 0
    new = copies.select((F.col("id") + 10**9).alias("id"), F.when(other, F.concat(F.lit("NEW-"), F.col("id").cast("string"))).otherwise(F.col("document_no")).alias("document_no"), "document_type", "document_date", F.when(other, F.col("grand_total_final") + 10**7).otherwise(F.col("grand_total_final")).cast("decimal(14,2)").alias("grand_total_final"), "file_hash",
        F.when(brand_new, F.concat(F.lit("Brand New Traders "), (F.col("id") % 7).cast("string"))).otherwise(F.col("__name")).alias("vendor_name"), F.when(~brand_new, F.col("gstin")).alias("vendor_gstin"), F.lit(None).cast("string").alias("customer_name"), F.lit(None).cast("string").alias("customer_gstin"))
    items = V.items(s, d)
    lines = items.where("document_id % 50 = 0").withColumn("document_id", F.col("document_id") + 10**9)
    saved = K.save_documents(new, lines, docs, items, vendors, customers)
    counts = saved["items"].where(F.col("document_id") >= 10**9).groupBy("document_id").agg(F.count("*").alias("n"))
    heads = saved["documents"].where(F.col("id") >= 10**9).select(F.col("id").alias("__d"), "vendor_id").join(saved["vendors"].select(F.col("id").alias("__v"), "name"), F.col("vendor_id") == F.col("__v"), "left")
    out = saved["outcome"].join(heads, F.col("id") == F.col("__d"), "left").join(counts, F.col("id") == F.col("document_id"), "left")
    return out.select("id", "is_duplicate", "duplicate_of", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.col("name").alias("vendor_name"))
