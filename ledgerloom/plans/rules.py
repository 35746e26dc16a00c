"""Rules on rows: embedded invoices, repairs, filters and small functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import dates, numeric
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import arithmetic as R
from ..operators import catalogs as C
from ..operators import documents as D
from ..operators import mapping as M
from ..operators import mutations as K
from ..session import table
from ..sources import embedded as J
from ..sources import files as S
from ..views import with_views
from .registry import query


def _invoice_json(s, d):
    """id, and an invoice as JSON text: header, and the lines of the order with net amounts missing on odd ones."""
    items = V.items(s, d).select("document_id", F.struct("line_no", "item_code", F.col("description"), F.col("qty").cast("decimal(10,2)").alias("q"), (F.col("vendor_id") % 5).alias("tax")).alias("x"))
    lines = items.groupBy("document_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    odd = lambda x: x["line_no"] % 2 == 1
    shown = F.transform("xs", lambda x: F.struct(
        F.concat(x["line_no"].cast("string"), F.lit(".")).alias("item_no"), x["description"].alias("description"), x["q"].cast("string").alias("quantity"), F.lit("12.50").alias("net_price"),
        F.when(~odd(x), (x["q"] * 10).cast("decimal(12,2)").cast("string")).alias("net_worth"), F.when(~odd(x), (x["q"] * 11).cast("decimal(12,2)").cast("string")).alias("gross_worth"), F.concat(x["tax"].cast("string"), F.lit("%")).alias("vat_pct")))
    docs = V.documents(s, d).join(lines, F.col("id") == F.col("document_id"), "left")
    body = F.struct(
        F.when(F.col("id") % 2 == 0, F.col("document_no")).alias("invoice_no"), F.when(F.col("id") % 2 == 1, F.col("document_no")).alias("quotation_no"), F.date_format("document_date", "yyyy-MM-dd").alias("date_of_issue"),
        F.struct(F.when(F.col("id") % 3 > 0, F.concat(F.lit('Acme "A" '), (F.col("id") % 7).cast("string"))).alias("name"), F.lit("29ABCDE1234F1Z5").alias("gstin")).alias("seller"),
        F.struct(F.concat(F.lit("Client "), F.col("customer_id").cast("string")).alias("name")).alias("client"),
        F.struct(F.lit("10.00").alias("vat_amount"), F.col("grand_total_final").cast("string").alias("gross_worth")).alias("summary"),
        F.coalesce(F.when(F.col("document_id").isNotNull(), shown), F.array().cast(_SHOWN)).alias("items"),
    )
    return docs.select("id", "document_no", F.col("document_date"), "grand_total_final", F.to_json(body).alias("j"))


_SHOWN = "array<struct<item_no:string,description:string,quantity:string,net_price:string,net_worth:string,gross_worth:string,vat_pct:string>>"


_SELLER = "case when id % 3 > 0 then 'Acme \"A\" ' || cast(id % 7 as varchar) else 'TechVision Distributors Pvt Ltd' end"
_JSON_LINES = "select document_id as doc, line_no, 'ITEM-' || cast(line_no as varchar) as item_code, description, cast(qty as decimal(20,2)) as qty, cast(case when line_no % 2 = 1 then qty * 12.5 else qty * 10 end as decimal(20,4)) as taxable_amount, cast(case when line_no % 2 = 1 then qty * 12.5 else qty * 11 end as decimal(20,4)) as final_value, cast(case when line_no % 2 = 1 then 0 else qty * 10 * (vendor_id % 5) * 0.005 end as decimal(20,4)) as cgst_amount from items"


@query("s15_sheet_headers", with_views(f"select id as doc, document_no, document_date, {_SELLER} as vendor_name, 'Client ' || cast(customer_id as varchar) as customer_name, cast(grand_total_final as decimal(20,4)) as final, cast(5 as decimal(20,4)) as cgst from docs", "docs"))
def sheet_headers(s, d):
    """Header, seller, client and summary from the first valid cell of a sheet, behind one that is broken and one without a number."""
    return _sheet(s, d)[0].select(F.col("doc").cast("long").alias("doc"), "document_no", "document_date", "vendor_name", "customer_name", F.col("grand_total_final").cast("decimal(20,4)").alias("final"), F.col("grand_total_cgst").cast("decimal(20,4)").alias("cgst"))


def _sheet(s, d):
    cell = F.concat(F.lit('x "'), F.replace("j", F.lit('"'), F.lit('""')), F.lit('"'))
    grid = _invoice_json(s, d).select(F.col("id").cast("string").alias("doc"), F.lit("s").alias("sheet"), F.lit(3).alias("row_idx"), F.array(F.lit(None).cast("string"), F.lit('{"invoice_no": "broken"'), F.lit('{""items"": [], ""date"": ""x""}'), cell, F.lit('{"invoice_no": "late"}')).alias("cells"))
    return J.sheet_invoices(grid)


@query("s15_sheet_lines", with_views(_JSON_LINES, "items"))
def sheet_lines(s, d):
    """The lines of the embedded invoices."""
    lines = _sheet(s, d)[1]
    return lines.select(F.col("doc").cast("long").alias("doc"), "line_no", "item_code", "description", F.col("qty").cast("decimal(20,2)").alias("qty"), *[F.col(c).cast("decimal(20,4)").alias(c) for c in ("taxable_amount", "final_value", "cgst_amount")])


def _texts(s, d):
    """Three texts in four hold the invoice as escaped JSON, twice; the fourth is running text."""
    escaped = F.replace("j", F.lit('"'), F.lit('\\"'))
    doubled = F.replace("j", F.lit('"'), F.lit('""'))
    money = F.format_number("grand_total_final", 2)
    running = F.concat(F.lit("Quotation No: "), F.col("document_no"), F.lit("\nDate: "), F.date_format("document_date", "dd/MM/yyyy"), F.lit("\nCustomer: Client\n1 Pump "), F.col("document_no"), F.lit(" 2 Nos 10.00 20.00\nGrand Total "), money)
    text = F.when(F.col("id") % 4 == 0, running).otherwise(F.concat(F.lit("batch\ninvoice_1,x,\""), doubled, F.lit("\"\ninvoice_2,x,\""), escaped, F.lit("\"\ninvoice_3 no json here, invoice_no")))
    return J.ingest_texts(_invoice_json(s, d).select(F.col("id").alias("doc"), text.alias("text")))


@query("s14_ingested_headers", with_views(f"select id as doc, document_no, document_date, case when id % 4 > 0 then {_SELLER} end as vendor_name, cast(grand_total_final as decimal(20,4)) as final, case when id % 4 > 0 then 'invoice_final' else 'quotation' end as document_type, 'ok' as extraction_status from docs", "docs"))
def ingested_headers(s, d):
    """Embedded JSON once per number, else the text's own header, totals and type."""
    return _texts(s, d)[0].select("doc", "document_no", "document_date", "vendor_name", F.col("grand_total_final").cast("decimal(20,4)").alias("final"), "document_type", "extraction_status")


@query("s14_ingested_lines", with_views(f"select doc, line_no, description, qty, final_value from ({_JSON_LINES}) where doc % 4 > 0 union all select id, 1, 'Pump ' || document_no, 2, 20 from docs where id % 4 = 0", "docs", "items"))
def ingested_lines(s, d):
    return _texts(s, d)[1].select("doc", "line_no", "description", F.col("qty").cast("decimal(20,2)").alias("qty"), F.col("final_value").cast("decimal(20,4)").alias("final_value"))


@query("a11d_repair_extracted", with_views("""select document_id, line_no, description, cast(case when line_no % 5 = 4 then 2 else q end as decimal(18,2)) as qty, cast(case when line_no % 5 = 4 then 7.50 else r end as decimal(18,2)) as rate, cast(case when line_no % 5 = 4 then 15 else q * r end as decimal(18,2)) as gross_amount, case when line_no % 5 = 3 then 'kg' else 'Nos' end as uom
from (select document_id, line_no, description, cast(qty as bigint) as q, 900 + cast(item_code as bigint) * 0.01 as r from items) where line_no % 7 > 0""", "items"))
def repair_extracted(s, d):
    """A11d, P22: rate and amount swapped, a count before the description, an amount missing, a unit inside the quantity, a stamp instead of a line."""
    i = V.items(s, d)
    q, k = F.col("qty").cast("long"), F.col("line_no") % 5
    r = (900 + F.col("item_code").cast("long") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")
    a = (q * r).cast("decimal(18,2)")
    stamp = F.col("line_no") % 7 == 0
    rows = i.select(
        "document_id",
        "line_no",
        F.when(stamp, "Checked by").when(k == 1, F.concat(q.cast("string"), F.lit(" "), "description")).otherwise(F.col("description")).alias("description"),
        F.when(stamp | (k == 1), "0").when(k == 3, F.concat(q.cast("string"), F.lit(" kg"))).when(k == 4, "2").otherwise(q.cast("string")).alias("qty"),
        F.when(stamp, "0").when((k == 2) & (q > 1), a.cast("string")).when(k == 4, "7.50").otherwise(r.cast("string")).alias("rate"),
        F.when(stamp | (k == 4), "0").when((k == 2) & (q > 1), r.cast("string")).otherwise(a.cast("string")).alias("amount"),
        F.lit("").alias("uom"),
        F.lit("").alias("raw_qty_total"),
    )
    return R.repair_extracted(rows).select("document_id", "line_no", "description", "qty", "rate", "gross_amount", "uom")


@query("a13_confidence", "select conv_id as doc, avg(c) as confidence from (select conv_id, turn, avg(cast(length(text) % 100 as double)) as c from conversations where trim(text) <> '' and length(text) % 10 < 9 group by 1, 2) group by 1")
def confidence(s, d):
    """Turns as pages; some words have no confidence."""
    n = F.length("text")
    words = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text", F.when(n % 10 < 9, (n % 100).cast("double")).otherwise(-1.0).alias("confidence"))
    return A.mean_confidence(words)


@query("f38_normalize_document", with_views("select document_id as doc, line_no, item_code, case when document_id % 3 = 0 then '10000' || item_code || '-X' end as code, case when document_id % 3 = 0 then case when regexp_matches(description, '^\\d*[A-Z]{1,4}\\s*(ml|gm|gms|g|l|each)\\b', 'i') then '' else description end end as description, document_id % 3 = 0 as is_catalog from items", "items"))
def normalize_document(s, d):
    """a third of the documents are catalog sheets, told by a code in any row."""
    i = V.items(s, d)
    k = F.col("document_id") % 3 == 0
    sheet = F.create_map(F.lit("col_1"), F.concat(F.lit("10000"), "item_code", F.lit("-X")), F.lit("col_2"), F.lit("|"), F.lit("col_3"), F.col("description"))
    plain = F.create_map(F.lit("name"), F.col("description"), F.lit("price"), F.lit("1,200"))
    types = s.createDataFrame([("price", "number")], "key string, type string")
    out = M.normalize_document(i.select(F.col("document_id").alias("doc"), F.struct("line_no", "item_code").alias("row"), F.when(k, sheet).otherwise(plain).alias("record")), types)
    r = F.col("record")
    return out.select("doc", "row.line_no", "row.item_code", F.try_element_at(r, F.lit("Item Code")).alias("code"), F.try_element_at(r, F.lit("Description")).alias("description"), "is_catalog")


@query("j16_compare", with_views("select d.source_file as file, i.line_no as idx, i.item_code as expected, case when i.document_id % 5 > 0 then i.item_code end as found from items i join docs d on d.id = i.document_id", "docs", "items"))
def compare(s, d):
    """Expected lines under one path, extracted ones under another; a fifth of the documents was not extracted."""
    names = V.documents(s, d).select("id", "source_file")
    rows = V.items(s, d).join(names, F.col("document_id") == F.col("id")).select("document_id", "source_file", F.concat_ws("/", F.col("document_id").cast("string"), "line_no", "item_code", "description", F.col("qty").cast("string"), F.col("final_value").cast("string"), F.col("vendor_id").cast("string"), F.col("rate").cast("string")).alias("key"), "line_no", "item_code")
    truth = rows.select(F.concat(F.lit("/truth/"), "source_file").alias("file"), F.col("key").alias("idx"), F.col("item_code").alias("expected"), "source_file", "line_no")
    found = rows.where("document_id % 5 > 0").select(F.concat(F.lit("C:\\in\\"), "source_file").alias("source_file"), F.col("key").alias("idx"), F.col("item_code").alias("found")).dropDuplicates(["source_file", "idx"])
    out = C.compare_by_suffix(truth.drop("source_file"), found)
    return out.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("line_no").alias("idx"), "expected", "found")


@query("k04_save_records", with_views("select id as key, case when document_type in ('quotation', 'purchase_order') then document_type else 'generic' end as kind, case document_type when 'quotation' then document_no when 'purchase_order' then cast(grand_total_final as varchar) else '{\"no\":\"' || document_no || '\",\"odd\":\"x\"}' end as shown from docs", "docs"))
def save_records(s, d):
    """K4: two known types keep their columns, others their record as JSON."""
    rows = V.documents(s, d).select(F.col("id").alias("key"), "document_type", F.create_map(F.lit("no"), F.col("document_no"), F.when(F.col("document_type") == "purchase_order", "total").otherwise("odd"), F.when(F.col("document_type") == "purchase_order", F.col("grand_total_final").cast("string")).otherwise("x")).alias("record"))
    out = K.save_records(rows, {"quotation": ["no", "valid"], "purchase_order": ["total"]})
    return out["quotation"].select("key", F.lit("quotation").alias("kind"), F.col("no").alias("shown")).unionByName(out["purchase_order"].select("key", F.lit("purchase_order").alias("kind"), F.col("total").alias("shown"))).unionByName(out["generic"].select("key", F.lit("generic").alias("kind"), F.col("record_json").alias("shown")))


@query("p15_queue_filter", with_views("select id from docs where lower(document_no || chr(10) || document_type) like '%quot%' or cast(id as varchar) like '%77%'", "docs"))
def queue_filter(s, d):
    """Two searches over plain and nested fields, together."""
    docs = V.documents(s, d).select("id", "document_no", "document_type", F.struct(F.col("id").cast("string").alias("note")).alias("record"))
    return C.queue_filter(docs, ["document_no", "document_type"], "QUOT").unionByName(C.queue_filter(docs.where("lower(document_type) not like '%quot%'"), ["record"], "77")).select("id")


@query("p21_no_summary_rows", with_views("select document_id, line_no, item_code from items where not (line_no % 2 = 0 and (line_no % 3 = 0 or line_no % 4 = 0))", "items"))
def no_summary_rows(s, d):
    """Rows that state a total and have no code of their own go; with a code they stay."""
    k = F.col("line_no")
    rows = V.items(s, d).select("document_id", "line_no", F.col("item_code").alias("own"), F.when(k % 2 == 0, F.concat(F.lit("ITEM-"), k.cast("string"))).otherwise(F.col("item_code")).alias("item_code"), F.when((k % 3 == 0) | (k % 4 == 0), F.lit(" Grand Total ")).otherwise(F.col("description")).alias("description"))
    return D.without_summary_rows(rows).select("document_id", "line_no", F.col("own").alias("item_code"))


@query("o08_oldest_queued", with_views("select id as queue_id, document_date as created_at from docs where extraction_status = 'needs_review' order by document_date, id limit 10", "docs"))
def oldest_queued(s, d):
    """The ten oldest that wait."""
    rows = V.documents(s, d).select(F.col("id").alias("queue_id"), F.when(F.col("extraction_status") == "needs_review", "queued").otherwise("done").alias("status"), F.col("document_date").alias("created_at"))
    return S.queued(rows, 10).select("queue_id", "created_at")


@query("f03_numbers", "select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 5 when 0 then null when 1 then l_quantity * 1000 when 2 then null when 3 then -l_quantity else l_quantity end as v from lineitem")
def numbers(s, d):
    """thousands separators, null-likes, words and signs."""
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int")
    raw = F.when(k == 0, " N/A ").when(k == 1, F.concat(q.cast("string"), F.lit(",000"))).when(k == 2, "ten").when(k == 3, F.concat(F.lit("-"), q.cast("string"))).otherwise(F.concat(F.lit(" "), q.cast("string"), F.lit(".0 ")))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.normalize_number(raw).alias("v"))


@query("f10_whole_quotients", "select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 3 = 0 then null else l_quantity % 4 = 0 end as whole, l_linenumber % 2 = 1 as is_decimal from lineitem")
def whole_quotients(s, d):
    """whole quotients, none by zero; numbers with a point."""
    q = F.col("l_quantity").cast("decimal(10,2)")
    by = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(4).cast("decimal(10,2)")
    shown = F.when(F.col("l_linenumber") % 2 == 1, q.cast("string")).otherwise(F.concat(q.cast("int").cast("string"), F.lit(" v1.")))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.is_whole_quotient(q, by).alias("whole"), numeric.is_decimal(shown).alias("is_decimal"))


@query("f15_capped_dates", "select o_orderkey, case when o_orderkey % 3 = 0 then make_date(2026, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(2026, month(o_orderdate), 1))))) else cast(o_orderdate as date) end as day from orders")
def capped_dates(s, d):
    """years beyond the last allowed one are read as it."""
    t = F.col("o_orderdate").cast("date")
    late = F.concat(F.date_format(t, "dd-MMM-"), (F.year(t) + 40).cast("string"))
    return table(s, d, "orders").select("o_orderkey", dates.parse_capped(F.when(F.col("o_orderkey") % 3 == 0, late).otherwise(F.date_format(t, "dd/MM/yyyy"))).alias("day"))


@query("f27_text_layer", "select doc_id, sha256(text) as sha from documents where text is not null")
def text_layer(s, d):
    """ligatures printed as glyph numbers, put back."""
    broken = F.replace(F.replace("text", F.lit("ti"), F.lit("(cid:415)")), F.lit("tt"), F.lit("(cid:425)"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2(X.clean_text_layer(broken), 256).alias("sha"))


@query("f29_canonical_items", "select p_partkey, case p_partkey % 4 when 0 then 'Beaker' when 1 then 'Filter Paper' when 2 then 'Pipette' else p_name end as item from part")
def canonical_items(s, d):
    k = F.col("p_partkey") % 4
    return table(s, d, "part").select("p_partkey", X.canonical_item(F.when(k == 0, F.concat(F.lit("glass BEAKAR "), "p_name")).when(k == 1, "filtar  papar").when(k == 2, "pippette 5 ml").otherwise(F.col("p_name"))).alias("item"))
