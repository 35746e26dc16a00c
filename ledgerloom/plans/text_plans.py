"""Cleaning, typing, grids, chunks and classification over text tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import views as V
from ..functions import classify as Y
from ..functions import dates, numeric
from ..functions import text as X
from ..operators import aliases as L
from ..operators import grids as G
from ..operators import mapping as M
from ..session import spread, table
from ..sources import files as S
from ..views import with_views
from .registry import query

_CLEAN = "regexp_replace(trim({c}), '[ \\t]+', ' ', 'g')"


@query("f17_clean_text", "select conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[ \\t]+', ' ', 'g') as clean from conversations")
def clean_text(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.clean_text(F.col("text")).alias("clean"))


@query("f18_normalize_name", with_views("select id, regexp_replace(regexp_replace(lower(name || ' Pvt Ltd'), '\\b(pvt|ltd|private|limited|co|corp|inc)\\b', '', 'g'), '[^a-z0-9]', '', 'g') as n from vendors", "vendors"))
def normalize_name(s, d):
    return V.vendors(s, d).select("id", X.normalize_name(F.concat("name", F.lit(" Pvt Ltd"))).alias("n"))


@query("f01_to_decimal", with_views("select document_id, line_no, item_code, cast(case line_no % 6 when 0 then 0 when 1 then qty when 2 then 0 when 3 then 1250.75 when 4 then 0 else -qty end as decimal(18,2)) as qty from items", "items"))
def to_decimal(s, d):
    """percent signs, blanks, separators, signs, null-likes and words."""
    q = F.col("qty").cast("decimal(10,2)").cast("string")
    k = F.col("line_no") % 6
    raw = F.when(k == 1, F.concat(F.lit(" "), q, F.lit(" %"))).when(k == 2, "n/a").when(k == 3, "1,250.75").when(k == 4, "ten").when(k == 5, F.concat(F.lit("-"), q))
    return V.items(s, d).select("document_id", "line_no", "item_code", numeric.to_decimal(raw).cast("decimal(18,2)").alias("qty"))


@query("f04_clean_numeric", "select n_nationkey, case n_nationkey % 5 when 0 then '12%' when 1 then '(1,250.00' when 2 then '' when 3 then '-7.5' else cast(n_nationkey as varchar) || '.' end as shown from nation")
def clean_numeric(s, d):
    k = F.col("n_nationkey") % 5
    raw = F.when(k == 0, "approx. 12% ".replace(".", "")).when(k == 1, "Rs (1,250.00)").when(k == 3, "x-7.5 kg").when(k == 4, F.concat(F.lit("no "), F.col("n_nationkey").cast("string"), F.lit(".")))
    return table(s, d, "nation").select("n_nationkey", numeric.clean_numeric(raw).alias("shown"))


@query("f08_split_merged", "select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as decimal(18,2)) as qty, cast(cast(l_quantity as decimal(10,2)) * 12.5 as decimal(18,2)) as total from lineitem")
def split_merged(s, d):
    """F8: quantity and total printed as one, told apart by the price."""
    q = F.col("l_quantity").cast("decimal(10,2)")
    token = F.concat(q.cast("string"), (q * F.lit("12.5").cast("decimal(3,1)")).cast("decimal(18,2)").cast("string"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.split_merged_qty_total(token, F.lit("12.50").cast("decimal(18,2)")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "x.qty", "x.total")


@query("f09_split_qty", "select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as decimal(18,2)) as qty, case l_linenumber % 3 when 0 then 'Nos' when 1 then 'kg' else '' end as uom from lineitem")
def split_qty(s, d):
    q, k = F.col("l_quantity").cast("decimal(10,2)").cast("string"), F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.concat(q, F.lit(" Nos"))).when(k == 1, F.concat(q, F.lit("kg"))).otherwise(q)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.split_qty_uom(raw).alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.qty", "x.uom")


@query("f02_currency", "select o_orderkey, cast(cast(o_totalprice as decimal(14,2)) * (case when o_orderkey % 5 = 0 then -1 else 1 end) as decimal(20,4)) as amount from orders")
def currency(s, d):
    o = table(s, d, "orders")
    money = F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2)
    return o.select("o_orderkey", numeric.normalize_currency(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("($ "), money, F.lit(")"))).otherwise(F.concat(F.lit("USD "), money))).alias("amount"))


@query("f13_dates", "select o_orderkey, cast(o_orderdate as date) as day_first, cast(o_orderdate as date) as month_first from orders")
def parse_dates(s, d):
    """every format of both conventions by turns; month before day only where the day cannot be a month."""
    o = table(s, d, "orders").withColumn("t", F.col("o_orderdate").cast("date"))

    def told(formats):
        k, out = F.col("o_custkey") % len(formats), None
        for n, f in enumerate(formats):
            out = F.when(k == n, F.date_format("t", f)) if out is None else out.when(k == n, F.date_format("t", f))
        return out

    late = F.when((F.dayofmonth("t") > 12) & (F.col("o_custkey") % 7 == 0), F.date_format("t", "M/d/yyyy")).otherwise(told(["yyyy-MM-dd", "d-MMM-yyyy", "d-MMMM-yyyy", "d-M-yyyy", "dd/MM/yyyy"]))
    return o.select("o_orderkey", dates.parse_day_first(late).alias("day_first"), dates.parse_month_first(told(["yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M-d-yyyy"])).alias("month_first"))


@query("f11_indian_digits", """with t as (select o_orderkey, cast(o_totalprice * 1000 as decimal(18,2)) as v from orders), p as (select *, split_part(cast(v as varchar), '.', 1) as w, split_part(cast(v as varchar), '.', 2) as c from t)
select o_orderkey, '₹' || case when length(w) > 3 then ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d{2})', '\\1,', 'g')), ',') || ',' || right(w, 3) else w end || '.' || c as shown from p""")
def indian_digits(s, d):
    return table(s, d, "orders").select("o_orderkey", numeric.group_indian((F.col("o_totalprice") * 1000).cast("decimal(18,2)")).alias("shown"))


@query("f30_type_label", with_views("select distinct document_type, case document_type when 'invoice_final' then 'Invoice Final' when 'invoice_proforma' then 'Invoice Proforma' when 'purchase_order' then 'Purchase Order' when 'quotation' then 'Quotation' else 'Patient Account Statement' end as label from docs", "docs"))
def type_label(s, d):
    return V.documents(s, d).select("document_type", X.type_label(F.col("document_type")).alias("label")).distinct()


_CLASS_WORDS = [w for r in Y.RULES for w in r[3]]


def _class_sql() -> str:
    """The ordered rules over the texts, each with one of the rules' words at its end."""
    words = ", ".join(f"'{w}'" for w in [*_CLASS_WORDS, ""])
    case = " ".join("when " + " or ".join(f"contains(n, '{w}')" for w in r[3]) + f" then '{r[0]}'" for r in Y.RULES)
    return f"with t as (select doc_id, regexp_replace(lower(text || ' ' || [{words}][1 + doc_id % {len(_CLASS_WORDS) + 1}]), '\\s+', ' ', 'g') as n from documents) select doc_id, case {case} end as document_type from t"


@query("f31_classify", _class_sql())
def classify(s, d):
    """every word of every rule at the end of some whole text."""
    word = F.element_at(F.array(*[F.lit(w.upper()) for w in [*_CLASS_WORDS, ""]]), (F.col("doc_id") % (len(_CLASS_WORDS) + 1) + 1).cast("int"))
    docs = table(s, d, "documents").select("doc_id", F.concat("text", F.lit("  "), word).alias("t"))
    return docs.select("doc_id", Y.classify(F.col("t"))["document_type"].alias("document_type"))


RULES = [("english", 0.5, ["the", "of", "and", "th"]), ("german", 0.5, ["der", "und", "ein", "sch"]), ("french", 0.5, ["les", "eau", "que", "ou"]), ("spanish", 0.5, ["ción", "que", "los", "ment"])]


def _density_sql() -> str:
    score = lambda ws: "(" + " + ".join(f"cast(contains(t, '{w}') as int)" for w in ws) + f") / {float(len(ws))}"
    cand = " union all ".join(f"select doc_id, {k} as k, '{n}' as name, {score(ws)} as sc, {th} as th from t" for k, (n, th, ws) in enumerate(RULES))
    return f"with t as (select doc_id, lower(text) as t from documents), c as ({cand}), b as (select doc_id, name, sc from c where sc >= th qualify row_number() over (partition by doc_id order by sc desc, k) = 1) select t.doc_id, coalesce(b.name, 'generic') as document_type, cast(coalesce(b.sc, 0) as double) as score from t left join b on b.doc_id = t.doc_id"


@query("a15_density", _density_sql())
def density(s, d):
    return Y.keyword_density(spread(table(s, d, "documents")), "text", RULES).select("doc_id", "document_type", "score")


@query("s14_lines", "select doc_id, count(*) as n_lines, max(length(l)) as longest from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) group by 1")
def lines(s, d):
    t = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("l")).cast("long").alias("longest"))


@query("s16_chunks", "with l as (select doc_id, string_split(text, chr(10)) as ls from documents), c as (select doc_id, ls, unnest(range(0, greatest(len(ls), 1), 5)) as k from l) select doc_id as doc, cast(k // 5 as bigint) as chunk, sha256(array_to_string(ls[k + 1 : k + 5], chr(10))) as body_sha from c")
def chunks(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return S.chunk_text(t, 5).select("doc", F.col("chunk").cast("long").alias("chunk"), F.sha2("body", 256).alias("body_sha"))


@query("s12_join_pages", "select conv_id as doc, sha256(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) order by turn, text)) as sha from (select conv_id, turn, coalesce(text, '') as text from conversations) group by 1")
def join_pages(s, d):
    pages = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("confidence"))
    return S.join_pages(pages).select("doc", F.sha2("text", 256).alias("sha"))


@query("s09_text_or_scan", "select conv_id as doc, case when max(length(trim(text))) > 30 then 'text' else 'ocr' end as route from conversations group by 1")
def text_or_scan(s, d):
    return S.text_or_scan(table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


@query("s02_hashes", "select doc_id, sha256(text) as file_hash from documents")
def hashes(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


def _grid(s, d):
    n = table(s, d, "nation")
    rows = n.select(F.lit("nations").alias("doc"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sheet"), (F.col("n_nationkey") + 2).alias("row_idx"), F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.concat(F.lit("$"), F.col("n_nationkey").cast("string"), F.lit(".50"))).alias("cells"))
    heads = n.select("n_regionkey").distinct().select(F.lit("nations").alias("doc"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sheet"), F.explode(F.array(F.struct(F.lit(0).alias("row_idx"), F.array(F.lit("Report"), F.lit(None).cast("string"), F.lit("")).alias("cells")), F.struct(F.lit(1).alias("row_idx"), F.array(F.lit("Nation Name"), F.lit("Key"), F.lit("Price")).alias("cells")))).alias("x")).select("doc", "sheet", "x.row_idx", "x.cells")
    return heads.unionByName(rows)


@query("s22_header_rows", "select 'nations' as doc, 'r' || cast(n_regionkey as varchar) as sheet, 1 as header_row from nation group by 2")
def header_rows(s, d):
    return G.header_rows(_grid(s, d))


@query("s26_records", "select 'nations' as doc, 'r' || cast(n_regionkey as varchar) as sheet, n_nationkey + 2 as row_idx, n_name as nation_name, cast(n_nationkey as varchar) as key from nation")
def sheet_records(s, d):
    r = G.records(_grid(s, d))
    return r.select("doc", "sheet", "row_idx", F.col("record")["nation_name"].alias("nation_name"), F.col("record")["key"].alias("key"))


@query("a16_column_types", "select 'nations' as doc, 'r' || cast(n_regionkey as varchar) as sheet, unnest(['nation_name', 'key', 'price']) as key, unnest(['text', 'number', 'currency']) as type from (select distinct n_regionkey from nation)")
def column_types(s, d):
    return G.column_types(G.records(_grid(s, d)), ["row_idx"])


@query("s28_unroll", "with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) select doc_id, cast(unnest(range(1, len(ls) + 1)) as integer) as part, nullif(trim(unnest(ls)), '') as line from l")
def unroll(s, d):
    grid = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit("s").alias("sheet"), F.lit(0).alias("row_idx"), F.array("text").alias("cells"), "doc_id")
    return G.unroll_cells(grid).select(F.col("doc").cast("long").alias("doc_id"), "part", F.col("cells")[0].alias("line"))


@query("s31_text_items", None)
def text_items(s, d):
    items = V.items(s, d)
    line = F.concat(F.col("line_no").cast("string"), F.lit(" "), F.col("description"), F.lit(" "), F.col("hsn_code"), F.lit(" "), F.col("qty").cast("decimal(10,2)").cast("string"), F.lit(" Nos 1,250.00 2,500.00"))
    docs = items.groupBy(F.col("document_id").alias("doc")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return G.text_items(docs)


@query("j13_mapping", with_views("select id as key, document_no as invoice_number, cast(grand_total_final as varchar) as total_amount, source_file as extra from docs", "docs"))
def mapping(s, d):
    rows = spread(V.documents(s, d)).select(F.col("id").alias("key"), F.lit("invoice").alias("document_type"), F.create_map(F.lit("Invoice  #"), F.col("document_no"), F.lit("total due"), F.col("grand_total_final").cast("string"), F.lit("source"), F.col("source_file")).alias("record"))
    out = M.map_fields(rows, M.field_map(s))
    return out.select("key", F.col("mapped")["invoice_number"].alias("invoice_number"), F.col("mapped")["total_amount"].alias("total_amount"), F.col("extras")["source"].alias("extra"))


@query("p26_routing", with_views("""select id as key, case when id % 7 = 0 or id % 11 = 0 or id % 13 = 0 then 'quarantine' else 'accept' end as routing from docs""", "docs"))
def routing(s, d):
    docs = V.documents(s, d)
    t = F.col("grand_total_final").cast("string")
    rows = docs.select(F.col("id").alias("key"), F.lit("invoice").alias("document_type"), F.create_map(F.lit("total_amount"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("-"), t)).otherwise(t), F.lit("subtotal"), F.when(F.col("id") % 11 == 0, F.lit("0.01")).otherwise(t)).alias("record"), F.when(F.col("id") % 13 == 0, F.lit(0.1)).otherwise(F.lit(0.9)).alias("confidence"))
    return M.route(rows).select("key", "routing")


@query("f37_normalize_record", with_views("select id as row, cast(document_date as varchar) as d, cast(cast(grand_total_final as decimal(20,4)) as varchar) as t, 'oops' as bad, 1 as n_warnings from docs", "docs"))
def normalize_record(s, d):
    docs = spread(V.documents(s, d))
    rows = docs.select(F.col("id").alias("row"), F.create_map(F.lit("d"), F.date_format("document_date", "MM/dd/yyyy"), F.lit("t"), F.concat(F.lit("$"), F.format_number("grand_total_final", 2)), F.lit("bad"), F.lit("oops")).alias("record"))
    types = s.createDataFrame([("d", "date"), ("t", "currency"), ("bad", "number")], "key string, type string")
    out = M.normalize_record(rows, types)
    return out.select("row", *[F.col("record")[k].alias(k) for k in ("d", "t", "bad")], F.size("warnings").alias("n_warnings"))


@query("f44_expand", """with a as (select distinct event_type as alias, 'k' || cast(event_id % 7 as varchar) as canonical from events),
b as (select alias as k, canonical as alt from a union select canonical, alias from a),
q as (select conv_id as q_id, turn, string_split(lower(['purchase', 'View', 'k3', 'click', 'xyz'][1 + (conv_id + turn) % 5] || ' ' || string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1]), ' ') as ws from conversations),
t as (select q_id, turn, unnest(range(0, len(ws))) as pos, unnest(ws) as token from q where len(ws) > 0)
select q_id, turn, cast(pos as int) as pos, token, string_agg(alt, '|' order by alt) as alternatives from (select distinct t.q_id, t.turn, t.pos, t.token, x.alt from t, lateral (select t.token as alt union select b.alt from b where b.k = t.token) x) where token <> '' group by all""")
def expand(s, d):
    """the words of a query, of which the first may be an alias, against aliases taken from the events."""
    known = table(s, d, "events").select(F.col("event_type").alias("alias"), F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("canonical")).distinct()
    head = F.element_at(F.array(*[F.lit(x) for x in ("purchase", "View", "k3", "click", "xyz")]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    q = table(s, d, "conversations").select(F.struct("conv_id", "turn", F.monotonically_increasing_id().alias("row")).alias("q_id"), F.concat(head, F.lit(" "), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")[0]).alias("q"))
    return L.expand(q, known).select(F.col("q_id.conv_id").alias("q_id"), "q_id.turn", "pos", "token", F.array_join("alternatives", "|").alias("alternatives")).distinct()


@query("f45_suggest", None)
def suggest(s, d):
    from ..operators.aggregates import vocabulary

    q = s.createDataFrame([(1, "qty widgt"), (2, "boltt")], "q_id int, q string")
    return L.suggest(q, L.seeds(s), vocabulary(V.items(s, d), "description"))


def part_aliases(s, d):
    """Aliases from the names of parts, in order: the first word for the second, surer for rarer pairs."""
    n = table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    ordered = n.withColumn("ord", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p_name")))
    return ordered.select("ord", F.split("p_name", " ")[0].alias("alias"), F.split("p_name", " ")[1].alias("canonical"), (1.0 / F.col("n")).alias("confidence"))


@query("f42_resolve", None)
def resolve(s, d):
    """words of events and parts, whole, cut short and misspelt, against aliases from the parts' names."""
    words = table(s, d, "events").select(F.col("event_type").alias("w")).unionByName(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))).distinct()
    texts = words.select(F.explode(F.array("w", F.substring("w", 1, 3), F.regexp_replace("w", "[aeiou]", ""), F.concat(F.substring("w", 1, 2), "w"), F.concat(F.upper("w"), F.lit("s")))).alias("text"))
    return L.resolve(texts, part_aliases(s, d))


def phrase_aliases(s, d):
    """Aliases of one to three words: how first turns begin."""
    first = table(s, d, "conversations").where("turn = 0").select("conv_id", F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), 0).alias("ws"))
    return first.select(F.array_join(F.slice("ws", 1, (F.col("conv_id") % 3 + 1).cast("int")), " ").alias("alias"), F.concat(F.lit("p"), (F.col("conv_id") % 40).cast("string")).alias("canonical"), (0.5 + (F.col("conv_id") % 5) / 8).alias("confidence")).where("alias != ''")


@query("f43_spans", None)
def spans(s, d):
    """Phrases in all turns, the best ones that do not overlap."""
    turns = table(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn", F.xxhash64("role", "text")).alias("doc"), "text").distinct()
    return L.choose_spans(L.span_matches(turns, phrase_aliases(s, d)))


@query("f25_highlight", "select n_nationkey, regexp_replace(n_name, '(?i)(an|in)', '<mark>\\1</mark>', 'g') as shown from nation")
def highlight(s, d):
    return table(s, d, "nation").select("n_nationkey", X.highlight(F.col("n_name"), ["an", "in"]).alias("shown"))


@query("f23_ocr_digits", "select n_nationkey, translate(n_name, 'SsoOlI|', '5500111') as shown from nation")
def ocr_digits(s, d):
    return table(s, d, "nation").select("n_nationkey", X.ocr_digits(F.col("n_name")).alias("shown"))


@query("f06_percent", "select l_orderkey, l_linenumber, l_partkey, cast(case when l_discount > 0 and l_discount < 1 then round(l_discount * 100) else l_discount end as bigint) as pct from lineitem")
def percent(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(numeric.fraction_to_percent(F.col("l_discount"))).cast("long").alias("pct"))


@query("f07_halves", "select l_orderkey, l_linenumber, l_partkey, cast(cast(round(l_tax * 100) as decimal(5,2)) * 0.5 as decimal(9,3)) as half from lineitem")
def halves(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.halves(F.round(F.col("l_tax") * 100).cast("decimal(5,2)")).alias("half"))


@query("t02_windowed_counts", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed(s, d):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("p16_catalog_rows", "select p_partkey, cast(10000 + p_partkey as varchar) || '-' || p_brand as code, case when regexp_matches(p_name, '^\\d*[A-Z]{1,4}\\s*(ml|gm|gms|g|l|each)\\b', 'i') then '' else p_name end as description from part where p_partkey % 2 = 0")
def catalog_rows(s, d):
    from ..operators import catalogs as C

    p = table(s, d, "part")
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_partkey") + 10000).cast("string"), F.lit("-"), F.col("p_brand"))).otherwise("none")
    rows = p.select("p_partkey", F.create_map(F.lit("col_1"), code, F.lit("col_10"), F.lit("|"), F.lit("col_2"), F.col("p_name"), F.lit("col_3"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("record"))
    hit = rows.where(C.is_item_row(F.col("record")))
    return hit.select("p_partkey", C.item_code(F.col("record")).alias("code"), C.description(F.col("record")).alias("description"))


@query("o11_page_count", with_views("select document_type, cast(ceil(count(*) / 10.0) as bigint) as pages from docs group by 1", "docs"))
def page_counts(s, d):
    from ..operators import catalogs as C

    return V.documents(s, d).groupBy("document_type").agg(F.count("*").alias("n")).select("document_type", C.page_count(F.col("n"), 10).cast("long").alias("pages"))
