"""Listing, search, dashboards, logs and snapshots over the document views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggregates as A
from ..operators import documents as D
from ..operators import history as H
from ..operators import mapping as M
from ..operators import mutations as K
from ..session import table
from ..views import with_views
from .registry import query

NAMED = "select d.*, v.name as vendor_name, c.name as customer_name from docsv d left join vendors v on d.vendor_id = v.id left join customers c on d.customer_id = c.id"
NAMED_VIEWS = ("docs", "docsv", "vendors", "customers")


def _named(s, d):
    return D.named(V.documents_with_vendor(s, d), V.vendors(s, d), V.customers(s, d))


def sql(text: str, *names: str, named: bool = False, **more: str) -> str:
    return with_views(text, *([*NAMED_VIEWS, *names] if named else names), **({"named": NAMED} if named else {}), **more)


@query("a03_by_type", sql("""select document_type, count(*) as n, cast(coalesce(sum(grand_total_final), 0) as decimal(20,2)) as total, count(*) filter (where extraction_status = 'needs_review') as n_review,
cast(cast(count(*) * 100.0 / sum(count(*)) over () as decimal(9,4)) as decimal(5,1)) as share from docs group by document_type""", "docs"))
def by_type(s, d):
    return A.by_type(V.documents(s, d))


@query("a01_stats", sql("""select count(*) as n_documents, cast(coalesce(sum(grand_total_final), 0) as decimal(20,2)) as total, count(*) filter (where extraction_status = 'needs_review') as n_review,
count(*) filter (where document_type in ('invoice_final', 'invoice_proforma', 'purchase_order', 'quotation')) as n_extracted from docs""", "docs"))
def stats(s, d):
    return A.stats(V.documents(s, d))


@query("a04_status_display", sql("select coalesce(extraction_status, 'ok') as status, extraction_status is null as was_null, count(*) as n from docs group by extraction_status", "docs"))
def status_display(s, d):
    return A.by_status_display(V.documents(s, d))


@query("a05_status_folded", sql("select coalesce(extraction_status, 'generic') as extraction_status, count(*) as n from docs group by 1", "docs"))
def status_folded(s, d):
    return A.by_folded(V.documents(s, d), "extraction_status", "generic")


@query("a07_item_counts", sql("select d.id, d.document_no, count(i.document_id) as n_items from docs d left join items i on i.document_id = d.id group by d.id, d.document_no", "docs", "items"))
def item_counts(s, d):
    return A.item_counts(V.documents(s, d), V.items(s, d))


@query("a08_running_share", sql("""select document_type, n, cast(n * 100.0 / sum(n) over () as decimal(9,4)) as share, cast(sum(n) over (order by n desc, document_type rows unbounded preceding) * 100.0 / sum(n) over () as decimal(9,4)) as running
from (select document_type, count(*) as n from docs group by 1)""", "docs"))
def running_share(s, d):
    g = V.documents(s, d).groupBy("document_type").agg(F.count("*").alias("n"))
    return H.running_share(g, "n", [F.desc("n"), F.col("document_type")])


@query("j01_named_documents", sql("select id, document_no, vendor_id, vendor_name, customer_name, document_type from named", named=True))
def named_documents(s, d):
    return _named(s, d).select("id", "document_no", "vendor_id", "vendor_name", "customer_name", "document_type")


@query("o01_page", sql("select id as document_id, document_no as quotation_no, grand_total_final from docs order by id desc limit 10 offset 20", "docs"))
def page(s, d):
    docs = V.documents(s, d).select(F.col("id").alias("document_id"), F.col("document_no").alias("quotation_no"), "grand_total_final")
    return D.page(docs, [F.desc("document_id")], 3, 10)[0]


@query("p03_filters", sql("select id from docs where document_type = 'quotation' and extraction_status = 'ok' and document_date >= date '1995-01-01' and document_date <= date '1996-12-31'", "docs"))
def filters(s, d):
    return D.equal_filters(V.documents(s, d), document_type="quotation", extraction_status="ok", customer_id="all", start_date="1995-01-01", end_date="1996-12-31").select("id")


@query("p07_invoice_family", sql("select id from docs where document_type in ('invoice', 'invoice_final', 'invoice_proforma') or document_type ilike '%invoice%'", "docs"))
def invoice_family(s, d):
    return V.documents(s, d).where(D.type_family(F.col("document_type"), "invoice")).select("id")


@query("p08_vendor_prefix", sql("select id from named where coalesce(vendor_name, '') ilike '%0000000_7%'", named=True))
def vendor_prefix(s, d):
    return D.list_documents(_named(s, d), V.items(s, d), "vendor: 0000000_7").select("id")


@query("p08_brand_prefix", sql("select id from named n where exists (select 1 from items i where i.document_id = n.id and i.brand ilike '%#13%')", "items", named=True))
def brand_prefix(s, d):
    return D.list_documents(_named(s, d), V.items(s, d), "brand:#13").select("id")


@query("p09_free_search", sql("""select id from named n where document_no ilike '%55%' or coalesce(vendor_name, '') ilike '%55%' or coalesce(customer_name, '') ilike '%55%' or source_file ilike '%55%' or document_type ilike '%55%'
or replace(document_type, '_', ' ') ilike '%55%' or exists (select 1 from items i where i.document_id = n.id and (i.description ilike '%55%' or i.item_code ilike '%55%' or i.brand ilike '%55%' or i.hsn_code ilike '%55%'))""", "items", named=True))
def free_search(s, d):
    return D.list_documents(_named(s, d), V.items(s, d), "55").select("id")


@query("p02_detail", sql("""select d.id, count(i.document_id) as n_lines, coalesce(string_agg(cast(i.line_no as varchar) || ':' || i.item_code, ',' order by i.line_no, i.item_code, i.description, i.qty), '') as lines
from docs d left join items i on i.document_id = d.id group by d.id""", "docs", "items"))
def detail(s, d):
    full = D.detail(V.documents(s, d), V.items(s, d))
    return full.select("id", F.size("line_items").cast("long").alias("n_lines"), F.array_join(F.transform("line_items", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["item_code"])), ",").alias("lines"))


@query("p10_search_documents", sql("""select id, document_date from named n where regexp_replace(document_no, '\\s+', ' ', 'g') ilike '%red widget%' or document_type ilike '%red widget%' or coalesce(vendor_name, '') ilike '%red widget%'
or coalesce(customer_name, '') ilike '%red widget%' or source_file ilike '%red widget%' or cast(grand_total_final as varchar) ilike '%red widget%' or regexp_matches(document_no, '(?i)red[\\s\\r\\n\\-_]+widget')
or exists (select 1 from items i where i.document_id = n.id and (regexp_replace(i.description, '\\s+', ' ', 'g') ilike '%red widget%' or i.item_code ilike '%red widget%' or i.hsn_code ilike '%red widget%' or i.brand ilike '%red widget%' or i.packing ilike '%red widget%'
or regexp_matches(i.description, '(?i)red[\\s\\r\\n\\-_]+widget'))) order by document_date desc nulls first, id desc limit 50""", "items", named=True))
def search_documents(s, d):
    return D.search_documents(_named(s, d), V.items(s, d), "red  widget").select("id", "document_date")


@query("p12_amount_search", sql("select id from named where cast(grand_total_final as varchar) ilike '%77.%'", named=True))
def amount_search(s, d):
    return _named(s, d).where(D.any_like(["grand_total_final"], "77.")).select("id")


@query("p13_alias_search", sql("""select id from named n where (document_no ilike '%widget%' or source_file ilike '%widget%' or coalesce(vendor_name,'') ilike '%widget%' or coalesce(customer_name,'') ilike '%widget%' or document_no ilike '%bolt%' or source_file ilike '%bolt%' or coalesce(vendor_name,'') ilike '%bolt%' or coalesce(customer_name,'') ilike '%bolt%'
or exists (select 1 from items i where i.document_id = n.id and (i.description ilike '%widget%' or i.item_code ilike '%widget%' or i.brand ilike '%widget%' or i.hsn_code ilike '%widget%' or i.description ilike '%bolt%' or i.item_code ilike '%bolt%' or i.brand ilike '%bolt%' or i.hsn_code ilike '%bolt%')))
and (document_no ilike '%red%' or source_file ilike '%red%' or coalesce(vendor_name,'') ilike '%red%' or coalesce(customer_name,'') ilike '%red%' or exists (select 1 from items i where i.document_id = n.id and (i.description ilike '%red%' or i.item_code ilike '%red%' or i.brand ilike '%red%' or i.hsn_code ilike '%red%')))""", "items", named=True))
def alias_search(s, d):
    return D.alias_search(_named(s, d), V.items(s, d), [["widget", "bolt"], ["red"]]).select("id")


@query("o03_search_items", sql("""select i.document_id, i.line_no, i.item_code, d.document_no from items i join docs d on d.id = i.document_id
where i.description ilike '%red%' or i.item_code ilike '%red%' or i.hsn_code ilike '%red%' or i.brand ilike '%red%' or i.packing ilike '%red%' or cast(i.line_no as varchar) ilike '%red%'
order by i.document_id desc, i.line_no nulls last, i.item_code limit 100""", "docs", "items"))
def search_items(s, d):
    return D.search_items(V.documents(s, d), V.items(s, d), "red").select("document_id", "line_no", "item_code", "document_no")


@query("p14_in_document", sql("select document_id, line_no, item_code from items where lower(description) like '%e%' and lower(description) like '%a%' or lower(brand) like '%e%' and lower(brand) like '%a%'", "items"))
def in_document(s, d):
    return D.in_document(V.items(s, d), "e a", ["description", "brand"]).select("document_id", "line_no", "item_code")


@query("p20_incomplete", sql("select id from docs where id % 11 = 0 or id % 13 = 0 or id % 17 = 0 or coalesce(grand_total_final, 0) = 0 or document_date is null or customer_id is null", "docs"))
def incomplete(s, d):
    """Some headers lose their total, date or customer first."""
    k = F.col("id")
    docs = V.documents(s, d).withColumns({"grand_total_final": F.when(k % 11 == 0, F.lit(0)).otherwise(F.col("grand_total_final")), "document_date": F.when(k % 13 != 0, F.col("document_date")), "customer_id": F.when(k % 17 != 0, F.col("customer_id"))})
    return A.incomplete(docs).select("id")


FREQ = """select 'vendor' as field, name as value, count(*) as freq from vendors group by name union all select 'customer', name, count(*) from customers group by name
union all select 'doc', document_no, count(*) from docs group by 2 union all select 'type', document_type, count(*) from docs where document_type is not null group by 2
union all select 'brand', brand, count(*) from items group by 2 union all select 'code', item_code, count(*) from items group by 2
union all select 'hsn', hsn_code, count(*) from items group by 2 union all select 'desc', description, count(*) from items group by 2"""


def _freqs(s, d):
    docs, items = V.documents(s, d), V.items(s, d)
    return D.value_frequencies({"vendor": (V.vendors(s, d), "name"), "customer": (V.customers(s, d), "name"), "doc": (docs, "document_no"), "type": (docs, "document_type"), "brand": (items, "brand"), "code": (items, "item_code"), "hsn": (items, "hsn_code"), "desc": (items, "description")})


@query("a10_value_frequencies", sql(FREQ, "docs", "items", "vendors", "customers"))
def value_frequencies(s, d):
    return _freqs(s, d)


@query("o06_ghost_suggestion", sql("""select field, value, freq from f where lower(value) like '%br%' order by (lower(value) like 'br%') desc, freq desc, length(value), value, field limit 1""", "docs", "items", "vendors", "customers", f=FREQ))
def ghost(s, d):
    return D.ghost_suggestion(_freqs(s, d), "br")


@query("a17_duplicate_groups", sql("select document_id, line_no, count(*) as n from items group by 1, 2 having count(*) > 1", "items"))
def duplicate_groups(s, d):
    return A.duplicate_groups(V.items(s, d), "document_id", "line_no")


@query("w09_smallest_id", "select p_partkey as id, min(p_partkey) over (partition by p_name) as keep_id from part")
def smallest_id(s, d):
    return A.smallest_id(table(s, d, "part"), "p_partkey", "p_name")


@query("a23_vocabulary", sql("select distinct unnest(regexp_extract_all(lower(description), '([a-z]{3,})')) as word from items", "items"))
def vocabulary(s, d):
    return A.vocabulary(V.items(s, d), "description")


@query("a21_catalog", sql("""select vendor_id, count(distinct description) as n_items, cast(arg_max(rate, row(document_id, line_no, item_code, rate)) filter (where rate > 0) as decimal(20,8)) as last_rate, count(*) as n_lines from items group by vendor_id""", "items"))
def catalog(s, d):
    return A.catalog(V.items(s, d))


@query("o05_recent", sql("select id, document_no from docs order by id desc limit 50", "docs"))
def recent(s, d):
    return A.recent(V.documents(s, d), [F.desc("id")], 50).select("id", "document_no")


LOG = {"log": "select user_id as document_id, event_type as stage, ts, event_id, value from events"}


def _log(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), "ts", "event_id", "value")


@query("w01_latest_log", sql("select document_id, stage, event_id from log qualify row_number() over (partition by document_id order by ts desc, event_id desc) = 1", **LOG))
def latest_log(s, d):
    return H.latest(_log(s, d), "document_id", ["ts", "event_id"]).select("document_id", "stage", "event_id")


@query("w02_last_successful", sql("select document_id, arg_max(stage, row(ts, event_id)) as last_stage from log where value > 50 group by document_id", **LOG))
def last_successful(s, d):
    return H.last_successful(_log(s, d), "document_id", "stage", F.col("value") > 50, ["ts", "event_id"])


@query("w03_history", sql("select document_id, string_agg(stage, '>' order by ts, event_id) as history, arg_max(stage, row(ts, event_id)) as current from log group by document_id", **LOG))
def history(s, d):
    return H.status_history(_log(s, d), "document_id", "stage", ["ts", "event_id"]).select("document_id", F.array_join("history", ">").alias("history"), "current")


@query("w05_page_groups", """with p as (select l_suppkey as file, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as page, case when l_orderkey % 3 = 0 then null else l_returnflag end as no from lineitem),
f as (select file, page, last_value(no ignore nulls) over (partition by file order by page rows unbounded preceding) as no from p),
g as (select file, page, case when no <> lag(no) over (partition by file order by page) then 1 else 0 end as new from f)
select file, page, sum(new) over (partition by file order by page rows unbounded preceding)::bigint as group_no from g""")
def page_groups(s, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    pages = table(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), n.cast("long").alias("page"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_returnflag")).alias("no"))
    return H.page_groups(pages, "file", "page", "no").select("file", "page", "group_no")


@query("w04_line_numbers", """with p as (select l_suppkey as doc, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos, case when l_orderkey % 4 = 0 then l_linenumber end as given from lineitem),
r as (select *, count(given) over (partition by doc order by pos rows unbounded preceding) as run, coalesce(last_value(given ignore nulls) over (partition by doc order by pos rows unbounded preceding), 0) as base from p)
select doc, pos, base + row_number() over (partition by doc, run order by pos) - case when run > 0 then 1 else 0 end as line_no from r""")
def line_numbers(s, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), n.cast("long").alias("pos"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_linenumber").cast("long")).alias("given"))
    return H.auto_line_numbers(rows, "doc", "pos", "given").select("doc", "pos", F.col("line_no").cast("long").alias("line_no"))


@query("w06_ordinals", sql("select document_id, line_no, 'ITEM-' || cast(row_number() over (partition by document_id order by line_no, item_code, qty, rate) as varchar) as item_code from items", "items"))
def ordinals(s, d):
    return H.ordinals(V.items(s, d), "document_id", [F.col(c) for c in ("line_no", "item_code", "qty", "rate")]).select("document_id", "line_no", "item_code")


@query("k02_upsert_by_hash", "select sha256(text) as file_hash, max(doc_id) as doc_id, arg_max(lang, doc_id) as lang from documents group by 1")
def upsert_by_hash(s, d):
    t = table(s, d, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id", "lang")
    half = F.col("doc_id") % 2 == 0
    return K.upsert_by_hash(t.where(half), t.where(~half), "file_hash", "doc_id").select("file_hash", "doc_id", "lang")


@query("k03_replace_children", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 5 <> 0 union all select l_orderkey, 1, 0 from (select distinct l_orderkey from lineitem where l_orderkey % 5 = 0)")
def replace_children(s, d):
    old = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = old.where("l_orderkey % 5 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"))
    return K.replace_children(old, new, "l_orderkey")


@query("k08_upsert", "select s_suppkey, s_name, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 0 then null else s_acctbal end as s_acctbal from (select s_suppkey, case when s_suppkey % 3 = 0 then upper(s_name) else s_name end as s_name, cast(case when s_suppkey % 3 = 0 and s_suppkey % 2 = 1 then 0.0 else s_acctbal end as double) as s_acctbal from supplier)")
def upsert(s, d):
    old = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.where("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.when(F.col("s_suppkey") % 2 == 1, F.lit(0.0)).alias("s_acctbal"))
    return K.upsert(old, new, "s_suppkey", keep_null=False)


@query("k10_delete_cascade", sql("select (select count(*) from docs where id % 7 <> 0) as n_docs, (select count(*) from items where document_id % 7 <> 0) as n_items", "docs", "items"))
def delete_cascade(s, d):
    docs = V.documents(s, d)
    kept, children = K.delete_cascade(docs, {"items": V.items(s, d)}, docs.where("id % 7 = 0").select("id"))
    return kept.agg(F.count("*").alias("n_docs")).crossJoin(children["items"].agg(F.count("*").alias("n_items")))


@query("k18_merge_duplicates", "with r as (select p_partkey as id, min(p_partkey) over (partition by p_name) as keep_id from part) select keep_id as l_partkey, count(*) as n from lineitem join r on l_partkey = id group by 1")
def merge_duplicates(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    _, moved = K.merge_duplicates(parts, table(s, d, "lineitem").select("l_partkey"), "name", "l_partkey")
    return moved.groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("k17_migrate", "select c_custkey, c_name from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0")
def migrate(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return K.migrate(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 <> 0"), "c_custkey")


@query("k16_export", "select cast(n_nationkey as varchar) as n_nationkey, n_name, case when n_regionkey = 1 then 'YES' when n_regionkey <> 1 then 'NO' else '' end as domestic, '' as note from nation")
def export(s, d):
    return K.export_table(table(s, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") == 1).alias("domestic"), F.lit(None).cast("string").alias("note")))


@query("k03_eav", sql("""select id as document_id, 'document_no' as field_name, document_no as field_value, 'text' as field_type from docs union all select id, 'document_date', cast(document_date as varchar), 'date' from docs
union all select id, 'grand_total_final', cast(grand_total_final as varchar), 'number' from docs union all select id, 'extraction_status', extraction_status, 'text' from docs where extraction_status is not null""", "docs"))
def eav(s, d):
    return M.to_eav(V.documents(s, d), "id", ["document_no", "document_date", "grand_total_final", "extraction_status"])


@query("a22_eav_pivot", sql("select id as document_id, document_no, extraction_status from docs", "docs"))
def eav_pivot(s, d):
    return M.pivot_eav(M.to_eav(V.documents(s, d), "id", ["document_no", "extraction_status"]), ["document_no", "extraction_status"])


@query("p17_json_rows", "select event_id from events where json_extract_string(props, '$.k') ilike '%1%'")
def json_rows(s, d):
    return M.json_rows(table(s, d, "events"), "props", "1", "k").select("event_id")


@query("j06_unseen", "select sha256(text) as file_hash, min(doc_id) as doc_id from documents where doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0) group by 1")
def unseen(s, d):
    from ..operators.entities import unseen as f

    t = table(s, d, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id")
    half = F.col("doc_id") % 2 == 0
    return f(t.where(~half), t.where(half).select("file_hash").distinct(), "file_hash")


@query("u06_map_merge", "select n_nationkey, n_name as a, cast(n_regionkey as varchar) as b from nation")
def map_merge(s, d):
    left, right = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("n_regionkey").cast("string")), F.create_map(F.lit("a"), F.col("n_name"))
    return table(s, d, "nation").select("n_nationkey", M.merge_maps(left, right).alias("m")).select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("p24_informative", sql("select * from docs", "docs"))
def informative(s, d):
    docs = V.documents(s, d).withColumns({"blank": F.lit("-"), "zero": F.lit(0)})
    return docs.select(*D.informative_columns(docs))


@query("t02_seen_once", "select sha256(text) as file_hash, min(doc_id) as doc_id from documents group by 1")
def seen_once(s, d):
    """What a second run over the same files adds to the first one's (nothing)."""
    from ..operators.entities import unseen as f

    t = table(s, d, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id")
    once = f(t, t.limit(0), "file_hash")
    return once.unionByName(f(t, once.select("file_hash"), "file_hash"))


@query("p05_equal_ignoring_case", sql("select id from docs where lower(document_type) = 'quotation'", "docs"))
def equal_ignoring_case(s, d):
    return D.equal_ignoring_case(V.documents(s, d), "document_type", "QuoTation").select("id")


@query("p18_file_name", sql("select id from docs where lower(source_file) like '%scan\\_7%' escape '\\'", "docs"))
def by_file_name(s, d):
    return D.by_file_name(V.documents(s, d), "SCAN_7").select("id")


@query("a09_category_sum", "select p_brand, cast(sum(cast(p_retailprice as decimal(12,2))) as decimal(22,2)) as total, count(*) as n from part group by 1")
def category_sum(s, d):
    return A.category_sum(table(s, d, "part").select("p_brand", F.col("p_retailprice").cast("decimal(12,2)").alias("price")), "p_brand", "price")


@query("a09_categories", "select distinct p_type from part")
def categories(s, d):
    return A.categories(table(s, d, "part"), "p_type")


@query("f16_default_date", sql("select id, coalesce(case when id % 5 <> 0 then document_date end, date '2024-01-15') as document_date, strftime(coalesce(case when id % 5 <> 0 then document_date end, date '2024-01-15'), '%Y-%m-%d') as shown from docs", "docs"))
def default_date(s, d):
    docs = V.documents(s, d).select("id", F.when(F.col("id") % 5 != 0, F.col("document_date")).alias("document_date"))
    return D.with_default_date(docs, "2024-01-15")


@query("f35_nested_as_json", "select n_nationkey, '{\"name\":\"' || n_name || '\",\"keys\":[' || cast(n_nationkey as varchar) || ',' || cast(n_regionkey as varchar) || ']}' as nested from nation")
def nested_as_json(s, d):
    from ..functions.text import nested_as_json as f

    return f(table(s, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.array("n_nationkey", "n_regionkey").alias("keys")).alias("nested")))


@query("f41_image_text", "select doc_id, to_base64(encode(text)) as encoded from documents")
def image_text(s, d):
    from ..functions.text import image_text as f

    return table(s, d, "documents").select("doc_id", F.regexp_replace(f(F.col("text").cast("binary")), r"\s", "").alias("encoded"))


@query("o09_vendors", sql("select id, name from vendors order by lower(name), name", "vendors"))
def vendors_by_name(s, d):
    return A.alphabetical(V.vendors(s, d), "name").select("id", "name")


@query("o10_learned_by_count", "select event_type as alias, count(*) as occurrence_count, arg_max(json_extract_string(props, '$.k'), event_id) as canonical from events group by 1 order by 2 desc, 1")
def learned_by_count(s, d):
    from ..operators import aliases as L

    return L.by_count(L.learned_counts(table(s, d, "events").select(F.col("event_type").alias("alias"), F.get_json_object("props", "$.k").alias("canonical"), F.col("event_id").alias("seq"))))


@query("f47_scoped_suggestion", sql("select 'brand:' || value as suggestion, value, 'brand:' as prefix from f where field = 'brand' and lower(value) like '%#1%' order by (lower(value) like '#1%') desc, freq desc, length(value), value limit 1", "docs", "items", "vendors", "customers", f=FREQ))
def scoped_suggestion(s, d):
    return D.scoped_suggestion(_freqs(s, d), " B: #1")


@query("k11_insert_vendors", "select s_name as name from supplier union all select n_name from nation where n_nationkey % 2 = 0")
def insert_vendors(s, d):
    """Nations of even number are new, one supplier is known."""
    known = V.vendors(s, d).select("id", "name")
    new = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).unionByName(known.orderBy("id").limit(1).select(F.upper("name").alias("name")))
    return K.insert_vendors(known, new)[0].select("name")


K12 = """with f as (select event_type as alias, 'c' || cast(cast(json_extract_string(props, '$.k') as bigint) % 5 as varchar) as canonical, value > 20 as accepted from events),
n as (select alias, canonical, count(*) as n from f where accepted group by 1, 2),
e as (select coalesce(n.alias, l.alias) as alias, coalesce(n.canonical, l.canonical) as canonical, coalesce(n, 0) + coalesce(had, 0) as n, n is not null as now from n full join (select distinct alias, 'c0' as canonical, 2 as had from f) l on n.alias = l.alias and n.canonical = l.canonical)"""


@query("k12_feedback", K12 + " select alias, canonical, case when now and n >= 3 then 'alias' else 'pending' end as state, case when not (now and n >= 3) then n end as occurrence_count from e where not (alias = 'view' and canonical = 'c1') or not now union all select 'view', 'c1', 'alias', null")
def feedback(s, d):
    """Clicks as feedback; one pair is an alias already, every alias has two confirmations of c0 pending."""
    from ..operators import aliases as L

    canonical = F.concat(F.lit("c"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    f = table(s, d, "events").select(F.upper("event_type").alias("alias"), canonical.alias("canonical"), (F.col("value") > 20).alias("accepted"))
    known = s.createDataFrame([("View", "C1")], "alias string, canonical string")
    learned = f.select("alias").distinct().select(F.lower("alias").alias("alias"), F.lit("c0").alias("canonical"), F.lit(2).cast("long").alias("occurrence_count"))
    aliases, pending = L.take_feedback(f, known, learned)
    return aliases.select(F.lower("alias").alias("alias"), F.lower("canonical").alias("canonical"), F.lit("alias").alias("state"), F.lit(None).cast("long").alias("occurrence_count")).unionByName(pending.select("alias", "canonical", F.lit("pending").alias("state"), "occurrence_count"))


@query("k06_stage_log", sql("select document_id, stage, event_id from log union all select id, 'received', -1 from docs", "docs", **LOG))
def stage_log(s, d):
    return K.log_stage(_log(s, d).select("document_id", "stage", "event_id"), V.documents(s, d).select(F.col("id").alias("document_id"), F.lit("received").alias("stage"), F.lit(-1).cast("long").alias("event_id")))


@query("t03_resume_points", sql("""select document_id, case max(k) filter (where ok) when 0 then 'received' when 1 then 'classified' when 2 then 'extracted' when 3 then 'normalized' end as last_stage,
case coalesce(max(k) filter (where ok), -1) when -1 then 'received' when 0 then 'classified' when 1 then 'extracted' when 2 then 'normalized' when 3 then 'mapped' end as next_stage, not arg_max(ok, row(ts, k)) as failed
from (select document_id, event_id % 4 as k, ts, value > 30 as ok from log) group by 1""", **LOG))
def resume_points(s, d):
    names = F.array(*[F.lit(x) for x in K.STAGES])
    log = _log(s, d).select("document_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("stage"), F.when(F.col("value") > 30, "done").otherwise("failed").alias("status"), "ts")
    return K.resume_points(log)


@query("t04_promotion", """with f as (select event_type as alias, json_extract_string(props, '$.k') as canonical, value > 20 as accepted from events), n as (select alias, canonical, count(*) as n from f where accepted and canonical is not null and trim(canonical) <> '' group by 1, 2 having count(*) >= 3)
select alias, arg_min(canonical, row(-n, canonical)) as canonical, max(n) as n, cast(0.900 as decimal(4,3)) as confidence from n group by alias""")
def promotion(s, d):
    from ..operators import aliases as L

    f = table(s, d, "events").select(F.col("event_type").alias("alias"), F.get_json_object("props", "$.k").alias("canonical"), (F.col("value") > 20).alias("accepted"))
    return L.promoted(f, L.seeds(s))


@query("k13_learned_counts", "select event_type as alias, count(*) as occurrence_count, arg_max(json_extract_string(props, '$.k'), event_id) as canonical from events group by 1")
def learned_counts(s, d):
    from ..operators import aliases as L

    return L.learned_counts(table(s, d, "events").select(F.col("event_type").alias("alias"), F.get_json_object("props", "$.k").alias("canonical"), F.col("event_id").alias("seq")))


@query("a20_outcomes", sql("select count(*) filter (where extraction_status = 'ok') as n_ok, count(*) filter (where extraction_status = 'needs_review') as n_needs_review from docs", "docs"))
def outcomes(s, d):
    return A.outcome_counts(V.documents(s, d), "extraction_status", ["ok", "needs_review"])


@query("a19_accuracy", "select count(*) as n, count(*) filter (where quality = case when d.n_chars > 500 then 1 when d.n_chars <= 500 then 0 end) as n_quality, count(*) filter (where toxic = case when contains(lower(d.text), 'idiot') then 1 when d.text is not null then 0 end) as n_toxic from labels l left join documents d on d.doc_id = l.doc_id")
def accuracy(s, d):
    """Labels against a guess by length and one word."""
    guess = table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality"), F.when(F.lower("text").contains("idiot"), 1).otherwise(0).alias("toxic"))
    return A.accuracy(table(s, d, "labels"), guess, ["doc_id"], ["quality", "toxic"])
