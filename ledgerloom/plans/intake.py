"""Files, grids and page texts: what a document is read from, each held against the table it was written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as X
from ..functions import classify as Y
from ..operators import catalogs as C
from ..operators import entities as E
from ..operators import grids as G
from ..operators import history as H
from ..session import shared_folder, table
from ..sources import files as S
from ..views import with_views
from .registry import query


@query("s01_scan_folder", "select sha256(string_agg(n_name, chr(10) order by n_name) || chr(10)) as file_hash, 'csv' as file_type, cast(sum(length(n_name) + 1) as bigint) as length from nation group by n_regionkey")
def scan_folder(s, d):
    """One csv file per region, scanned; the hash is that of the file."""
    folder = shared_folder(s, "scan")
    lines = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name"))
    lines.repartition(8, "region").sortWithinPartitions("region", "n_name").write.partitionBy("region").csv(folder, lineSep="\n")
    return S.scan_folder(s, folder).select("file_hash", "file_type", "length")


@query("s03_true_types", """select n_nationkey, case n_nationkey % 6 when 0 then 'pdf' when 1 then 'xlsx' when 2 then 'xls' when 3 then 'jpg' when 4 then 'csv' end as file_type, n_nationkey % 6 in (1, 2, 3) as mismatch from nation""")
def true_types(s, d):
    """S3: files named .pdf, .PDF or .csv with the first bytes of several formats."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("25504446", "504B0304", "D0CF11E0", "FFD8FFE0", "4142", "4142")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    ext = F.when(F.col("n_nationkey") % 6 == 4, ".CSV").when(F.col("n_nationkey") % 6 == 5, ".txt").otherwise(".pdf")
    files = table(s, d, "nation").select("n_nationkey", F.concat("n_name", ext).alias("name"), F.concat(F.unhex(head), F.col("n_name").cast("binary")).alias("content"))
    typed = files.withColumn("file_type", S.true_type(F.col("content"), F.col("name")))
    wrong = S.mismatched(typed).select(F.col("n_nationkey").alias("__k"))
    return typed.join(wrong, F.col("n_nationkey") == F.col("__k"), "left").select("n_nationkey", "file_type", F.col("__k").isNotNull().alias("mismatch"))


@query("s04_csv_rows", "select n_name as name, 'key, \"' || cast(n_nationkey as varchar) || '\"' as quoted from nation")
def csv_rows(s, d):
    """Csv files with quoted commas and quotes, read into cells on the executors."""
    folder = shared_folder(s, "csv")
    rows = table(s, d, "nation").select("n_name", F.concat(F.lit('key, "'), F.col("n_nationkey").cast("string"), F.lit('"')))
    rows.write.csv(folder, escape='"')
    return S.read_grids(s, folder).select(F.col("cells")[0].alias("name"), F.col("cells")[1].alias("quoted"))


@query("s07_sheets", "select distinct 'nations' as doc, 'r' || cast(n_regionkey as varchar) as sheet from nation")
def sheets(s, d):
    from .text_plans import _grid

    return S.sheets(_grid(s, d))


@query("s14_split_text", "select conv_id as doc, cast(turn as varchar) as number, regexp_replace(regexp_replace(min(text), '^[:\\s]+', ''), '\\s+$', '') as body from conversations group by conv_id, turn")
def split_text(s, d):
    """The turns of a conversation as one text with a marker before each, cut again at the markers."""
    turns = table(s, d, "conversations").select("conv_id", "turn", "text")
    texts = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("invoice_"), x["turn"].cast("string"), F.lit(": "), x["text"], F.lit("\n"))), "").alias("text"))
    return S.split_text(texts).select("doc", "number", "body")


@query("s15_json_cells", "select 'd' || cast(n_regionkey as varchar) as doc, 'N-' || cast(n_regionkey as varchar) as document_no, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as pos, n_name as description, cast(n_nationkey as varchar) as qty from nation")
def json_cells(s, d):
    """A cell that holds JSON with doubled quotes, after one that holds none."""
    n = table(s, d, "nation")
    items = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("description"), x["n_nationkey"].cast("string").alias("qty")))
    told = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.concat(F.lit("N-"), F.first("n_regionkey").cast("string")).alias("document_no"), items.alias("items"))).alias("j"))
    cell = F.concat(F.lit('"'), F.replace("j", F.lit('"'), F.lit('""')), F.lit('"'))
    grid = told.select(F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("doc"), F.lit("s").alias("sheet"), F.lit(0).alias("row_idx"), F.array(F.lit("{broken"), cell).alias("cells"))
    return S.json_cells(grid).select("doc", "document_no", "pos", "description", "qty")


@query("s20_memory", "select 'v' || cast(l_suppkey % 1000 as varchar) as vendor, p_name as item, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2")
def memory(s, d):
    """What vendors sold, learned as one JSON object a line and vendor, written and read again; no task holds more than a vendor."""
    folder = shared_folder(s, "memory")
    sold = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat(F.lit("v"), (F.col("l_suppkey") % 1000).cast("string")).alias("vendor"), "p_name").agg(F.count("*").alias("n"))
    S.write_memory(sold.groupBy("vendor").agg(F.collect_list(F.struct(F.col("p_name").alias("item"), "n")).alias("known_items")), folder)
    return S.read_memory(s, folder, counted=True).select("vendor", "item", "n")


@query("s25_merged_rows", with_views("select document_id as doc, cast(row_number() over w - 1 as int) as row_idx, case when document_id % 2 = 0 then first_value(item_code) over w else item_code end as code, first_value(brand) over w as brand, description from items window w as (partition by document_id order by line_no, item_code, description, qty, vendor_id)", "items"))
def merged_rows(s, d):
    """Documents as sheets; the brand is one merged column, the code on even documents another."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("document_id").orderBy("line_no", "item_code", "description", "qty", "vendor_id")) - 1
    rows = V.items(s, d).withColumn("row_idx", at)
    grid = rows.select(F.col("document_id").cast("string").alias("doc"), F.lit("s").alias("sheet"), "row_idx", F.array("item_code", "brand", "description").alias("cells"))
    size = rows.groupBy("document_id").agg(F.max("row_idx").alias("bottom"))
    ranges = size.select(F.col("document_id").cast("string").alias("doc"), F.lit("s").alias("sheet"), F.lit(0).alias("top"), F.when(F.col("document_id") % 2 == 0, 0).otherwise(1).alias("left"), "bottom", F.lit(1).alias("right"))
    # One range a column, else both columns would take the first one's value.
    each = ranges.select("doc", "sheet", "top", F.explode(F.sequence("left", "right")).alias("left"), "bottom").withColumn("right", F.col("left"))
    return G.fill_merged(grid, each).select(F.col("doc").cast("long").alias("doc"), "row_idx", F.col("cells")[0].alias("code"), F.col("cells")[1].alias("brand"), F.col("cells")[2].alias("description"))


@query("s25_fill_merged", "select 'r' || cast(n_regionkey as varchar) as sheet, n_nationkey as row_idx, first_value(n_name) over (partition by n_regionkey order by n_nationkey) as name, cast(n_nationkey as varchar) as key from nation")
def fill_merged(s, d):
    """Of each sheet the first column is one merged range; its cells take the top one's name."""
    n = table(s, d, "nation")
    sheet = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    grid = n.select(F.lit("d").alias("doc"), sheet.alias("sheet"), F.col("n_nationkey").cast("int").alias("row_idx"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    ranges = n.groupBy(sheet.alias("sheet")).agg(F.min("n_nationkey").cast("int").alias("top"), F.max("n_nationkey").cast("int").alias("bottom")).select(F.lit("d").alias("doc"), "sheet", "top", F.lit(0).alias("left"), "bottom", F.lit(0).alias("right"))
    return G.fill_merged(grid, ranges).select("sheet", F.col("row_idx").cast("long").alias("row_idx"), F.col("cells")[0].alias("name"), F.col("cells")[1].alias("key"))


def _invoice_grid(s, d):
    """A sheet per region: a title, a header in two rows, and a line per nation."""
    n = table(s, d, "nation")
    sheet = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sheet")
    top = [["Price list of the region", None, None, None, None], ["Sl. No", "Item Description", "Qty", "GST", "Net Total"], [None, None, None, "Amount", "(Rs.)"]]
    heads = n.select(sheet).distinct().select(F.lit("d").alias("doc"), "sheet", F.inline(F.array(*[F.struct(F.lit(k).alias("row_idx"), F.array(*[F.lit(x).cast("string") for x in row]).alias("cells")) for k, row in enumerate(top)])))
    rows = n.select(F.lit("d").alias("doc"), sheet, (F.col("n_nationkey") + 3).cast("int").alias("row_idx"), F.array((F.col("n_nationkey") + 1).cast("string"), F.col("n_name"), F.lit("7"), F.lit("9.00"), F.lit("59.00")).alias("cells"))
    return heads.unionByName(rows)


@query("s23_field_headers", "select distinct 'r' || cast(n_regionkey as varchar) as sheet, 1 as header_row, 2 as last_header_row, 'line_no,description,qty,gst_amount,final_value' as fields from nation")
def field_headers(s, d):
    """The header is known by its words, its second row is stacked on it."""
    return G.header_rows_by_fields(_invoice_grid(s, d)).select("sheet", "header_row", "last_header_row", F.array_join("fields", ",", "-").alias("fields"))


@query("s29_generic_items", "select n_nationkey + 2 as row_idx, n_name as description, case when n_regionkey % 2 = 0 then cast(n_nationkey as varchar) else '3' end as qty, '$' || cast(n_nationkey as varchar) as rate from nation")
def generic_items(s, d):
    """Half of the records name their columns, the others are read by position."""
    named = F.col("n_regionkey") % 2 == 0
    none = F.create_map().cast("map<string,string>")
    rows = table(s, d, "nation").select(F.lit("d").alias("doc"), F.lit("s").alias("sheet"), (F.col("n_nationkey") + 2).alias("row_idx"), F.when(named, F.create_map(F.lit("particulars"), F.col("n_name"), F.lit("quantity"), F.col("n_nationkey").cast("string"), F.lit("price"), F.concat(F.lit("$"), F.col("n_nationkey").cast("string")))).otherwise(none).alias("record"), F.array(F.lit("1"), F.col("n_name"), F.lit("3"), F.concat(F.lit("$"), F.col("n_nationkey").cast("string"))).alias("cells"))
    return G.generic_items(rows).select("row_idx", "description", "qty", "rate")


@query("s30_wide_rows", with_views("select id, document_no as no, case when position('.' in cast(grand_total_final as varchar)) > 0 then cast(grand_total_final as varchar) end as amount, document_type as kind from docs", "docs"))
def wide_rows(s, d):
    """The amount is torn into two cells behind its point."""
    amount = F.col("grand_total_final").cast("string")
    rows = V.documents(s, d).select(F.lit("d").alias("doc"), F.lit("s").alias("sheet"), F.col("id").alias("row_idx"), F.array(F.col("document_no"), F.concat(F.substring_index(amount, ".", 1), F.lit(".")), F.substring_index(amount, ".", -1), F.col("document_type")).alias("cells"))
    return G.wide_row_items(rows, ["no", "amount", "kind"]).select(F.col("row_idx").alias("id"), "no", "amount", "kind")


@query("s33_section_items", with_views("select id as doc, 'Pump ' || document_no as description, cast(2 as decimal(18,2)) as qty, cast(grand_total_final as decimal(18,2)) as amount from docs", "docs"))
def section_items(s, d):
    """Only the lines between the table's head and its total are items."""
    docs = V.documents(s, d)
    money = lambda c: F.format_number(c, 2)
    half = F.col("grand_total_final") / 2
    text = F.concat(F.lit("Sold pumps 3 10.00 30.00\nDescription Qty Rate Amount\n1 Pump "), F.col("document_no"), F.lit(" 2 "), money(half), F.lit(" "), money("grand_total_final"), F.lit("\nTotal "), money("grand_total_final"), F.lit("\n2 after the end 3 10.00 30.00"))
    return G.section_items(docs.select(F.col("id").alias("doc"), text.alias("text"))).select("doc", "description", F.col("qty").cast("decimal(18,2)").alias("qty"), F.col("amount").cast("decimal(18,2)").alias("amount"))


@query("s34_text_header", with_views("select id as doc, document_no, strftime(document_date, '%d/%m/%Y') as document_date, 'Acme Scientific Ltd' as vendor_name, 'Customer ' || cast(customer_id as varchar) as customer_name, case when id % 2 = 0 then 'USD' else 'INR' end as currency, '30 days' as payment_terms from docs", "docs"))
def text_header(s, d):
    """Header fields from a page of text."""
    text = F.concat(F.lit("Acme Scientific Ltd\nTax Invoice No: "), F.col("document_no"), F.lit("\nDue Date: 01/01/1990\nInvoice Date: "), F.date_format("document_date", "dd/MM/yyyy"), F.lit("\nBill To: Customer "), F.col("customer_id").cast("string"), F.lit("\n12 Some Street\nPayment Terms: 30 days\n"), F.when(F.col("id") % 2 == 0, "Currency: usd\n").otherwise(""))
    found = G.text_header(V.documents(s, d).select(F.col("id").alias("doc"), text.alias("text")))
    return found.select("doc", "document_no", "document_date", "vendor_name", "customer_name", "currency", "payment_terms")


@query("s35_text_totals", with_views("select id as doc, cast(grand_total_final as decimal(14,2)) as final, cast(floor(grand_total_final) as decimal(14,2)) as taxable, cast(id as decimal(14,2)) as cgst from docs", "docs"))
def text_totals(s, d):
    """Totals from lines of text; the whole tax is given and halved."""
    money = lambda c: F.format_number(c, 2)
    text = F.concat(F.lit("Sub Total "), money(F.floor("grand_total_final")), F.lit("\nTotal GST "), money(F.col("id") * 2), F.lit("\nGrand Total 1.00\nGrand Total : Rs "), money("grand_total_final"))
    return G.text_totals(V.documents(s, d).select(F.col("id").alias("doc"), text.alias("text"))).select("doc", "final", "taxable", "cgst")


@query("s35_table_totals", with_views("select id as doc, case id % 3 when 2 then 0 else 10 end::decimal(18,2) as taxable, case id % 3 when 0 then 1 when 1 then 1.5 else 0 end::decimal(18,2) as cgst, cast(grand_total_final as decimal(18,2)) as final from docs", "docs"))
def table_totals(s, d):
    """Totals rows of four, three or one number; the first page overrides the second."""
    total = F.col("grand_total_final").cast("string")
    rows = F.array(
        F.struct(F.lit(1).alias("page"), F.when(F.col("id") % 3 == 0, F.array(F.lit("Grand Total"), F.lit("10.00"), F.lit("1.00 2.00"), total)).when(F.col("id") % 3 == 1, F.array(F.lit("Total"), F.lit("10.00"), F.lit("3.00"), F.concat(F.lit("INR"), total))).otherwise(F.array(F.lit("Total"), total)).alias("cells")),
        F.struct(F.lit(2).alias("page"), F.when(F.col("id") % 3 == 2, F.array(F.lit("Total words"), F.lit("none"))).otherwise(F.array(F.lit("Total"), F.lit("5.00"), F.lit("5.00"), F.lit("5.00"))).alias("cells")),
    )
    grid = V.documents(s, d).select(F.col("id").alias("doc"), F.lit(0).alias("table"), F.lit(0).alias("row_idx"), F.inline(rows))
    return G.table_totals(grid).select("doc", "taxable", "cgst", "final")


@query("j17_words_in_regions", "select n_nationkey as word, case when n_nationkey % 10 < 5 then 'left' else 'right' end as region from nation")
def words_in_regions(s, d):
    """Word boxes by their centre, two regions a page."""
    words = table(s, d, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("word"), ((F.col("n_nationkey") % 10) * 10).cast("double").alias("x"), F.lit(5.0).alias("y"), F.lit(8.0).alias("width"), F.lit(2.0).alias("height"))
    regions = table(s, d, "region").select(F.col("r_regionkey").alias("page"), F.inline(F.array(*[F.struct(F.lit(n).alias("region"), F.lit(a).alias("x0"), F.lit(0.0).alias("y0"), F.lit(b).alias("x1"), F.lit(10.0).alias("y1")) for n, a, b in (("left", 0.0, 49.0), ("right", 50.0, 99.0))])))
    return G.words_in_regions(words, regions).select("word", "region")


@query("a14_anchors_clusters", "select s_nationkey as page, cast(count(distinct s_suppkey % 3) as integer) as n from supplier group by 1")
def clusters(s, d):
    """Positions some pixels about three columns; as many centres as columns in use."""
    at = ((F.col("s_suppkey") % 3) * 100 + F.col("s_suppkey") % 4).cast("double")
    rows = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("page")).agg(F.sort_array(F.collect_list(at)).alias("xs"))
    return rows.select("page", F.size(H.cluster_positions(F.col("xs"), 20)).alias("n"))


@query("w10_merged_descriptions", "select n_nationkey, case when n_nationkey % 2 = 0 then n_name || ' 500ml pure' else n_name end as first, case when n_nationkey % 2 = 0 then 'assay' else '500ml' end as second from nation")
def merged_descriptions(s, d):
    """Three lines of one item, of which the last is all that is left, and two lines of two."""
    even = F.col("n_nationkey") % 2 == 0
    lines = F.when(even, F.array(F.col("n_name"), F.lit("500ml pure"), F.lit("assay"))).otherwise(F.array(F.col("n_name"), F.lit("500ml")))
    merged = table(s, d, "nation").select("n_nationkey", H.merged_descriptions(lines, F.when(even, 1).otherwise(2)).alias("m"))
    return merged.select("n_nationkey", F.col("m")[0].alias("first"), F.col("m")[1].alias("second"))


@query("f22_item_code", """select p_partkey, case p_partkey % 4 when 0 then 'AB' || cast(1000 + p_partkey % 9000 as varchar) when 1 then '105' || cast(p_partkey % 10 as varchar) when 2 then 'X7-2' else '' end as code,
case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 2 then '! supplies (CPT: X7-2)' when p_partkey % 4 = 3 then '!' || p_name else 'flask' end as description from part""")
def item_codes(s, d):
    """codes at the head of a description, given with misread digits, and inside."""
    k = F.col("p_partkey")
    code = F.when(k % 4 == 1, F.concat(F.lit("lOs"), (k % 10).cast("string"))).otherwise("")
    desc = F.when(k % 4 == 0, F.concat(F.lit("AB"), (1000 + k % 9000).cast("string"), F.lit(" - "), F.col("p_name"))).when(k % 4 == 1, "flask").when(k % 4 == 2, "! supplies (CPT: X7-2)").otherwise(F.concat(F.lit("!"), F.col("p_name")))
    return table(s, d, "part").select("p_partkey", X.item_code(code, desc).alias("x")).select("p_partkey", "x.code", "x.description")


@query("f24_replies", "select n_nationkey, case n_nationkey % 4 when 3 then null else n_name end as vendor, case n_nationkey % 4 when 3 then null else 2 end as n_lines, case n_nationkey % 4 when 3 then null else '5' end as qty from nation")
def replies(s, d):
    """replies with fences and talk, flat ones, lists, and one that is no JSON."""
    lines = '[{"description": "a", "qty": 5}, {"description": "b", "qty": "6"}]'
    name = F.col("n_name")
    text = (
        F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('Here it is:\n```json\n{"header": {"vendor": "'), name, F.lit(f'"}}, "products": {lines}}}\n``` done')))
        .when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit('{"vendor": "'), name, F.lit(f'", "total": 1.5, "lines": {lines}}}')))
        .when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit('[{"vendor": "'), name, F.lit(f'", "items": {lines}}}]')))
        .otherwise("no { json here }")
    )
    r = table(s, d, "nation").select("n_nationkey", X.reply(text).alias("r"))
    return r.select("n_nationkey", F.col("r.header")["vendor"].alias("vendor"), F.size("r.line_items").alias("n_lines"), F.get("r.line_items", F.lit(0))["qty"].alias("qty")).withColumn("n_lines", F.when(F.col("vendor").isNotNull(), F.col("n_lines")))


@query("f33_by_file_type", "select doc_id, case when doc_id % 2 = 0 then 'generic' when contains(lower(text), 'quote') then 'invoice' end as document_type from (select doc_id, text || ' quote invoice bill to subtotal' as text from documents) where doc_id % 2 = 0 or contains(lower(text), 'quote')")
def by_file_type(s, d):
    """Csv files are generic, others go by their words."""
    docs = table(s, d, "documents").select("doc_id", F.concat("text", F.lit(" quote invoice bill to subtotal")).alias("text"))
    found = Y.by_file_type(F.when(F.col("doc_id") % 2 == 0, "csv").otherwise("pdf"), F.col("text"))
    return docs.select("doc_id", found["document_type"].alias("document_type"))


@query("f36_canonical_keys", "select n_nationkey, cast(n_nationkey as varchar) as rate, cast(n_nationkey as varchar) as cell, n_name as other from nation")
def canonical_keys(s, d):
    record = F.create_map(F.lit("Unit_Price"), F.col("n_nationkey").cast("string"), F.lit("origin"), F.col("n_name"))
    return table(s, d, "nation").select("n_nationkey", C.canonical_keys(record).alias("r")).select("n_nationkey", F.col("r")["Rate"].alias("rate"), F.col("r")["col_14"].alias("cell"), F.col("r")["origin"].alias("other"))


@query("f46_catalog_items", "select s_suppkey as doc, 'steel pump' as description, cast(4 as decimal(18,2)) as qty, case when s_suppkey % 2 = 0 then 'Box' else 'Set' end as uom, '8413' as hsn_code, cast(47.20 as decimal(18,2)) as final_value from supplier union all select s_suppkey, 'rubber hose', 1, 'Mtr', '4009', 2.36 from supplier where s_suppkey % 2 = 0")
def catalog_items(s, d):
    """known items of a vendor whose words occur in a text."""
    vendor = F.concat(F.lit("v"), (F.col("s_suppkey") % 5).cast("string"))
    text = F.concat(F.lit("top\nPump of steel 4 "), F.when(F.col("s_suppkey") % 2 == 0, "Box\nhose as usual").otherwise("Set"))
    texts = table(s, d, "supplier").select(F.col("s_suppkey").alias("doc"), vendor.alias("vendor"), text.alias("text"))
    known = s.createDataFrame([(f"v{k}", desc, rate, hsn, uom) for k in range(5) for desc, rate, hsn, uom in (("steel pump", "10.00", "8413", "Nos"), ("rubber hose", "2.00", "4009", "Mtr"))], "vendor string, description string, rate string, hsn_code string, uom string").withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    return C.catalog_items(texts, known).select("doc", "description", "qty", "uom", "hsn_code", "final_value")


@query("j12_templates", "select s_suppkey as doc, case when s_suppkey % 2 = 0 then 'b' else 'a' end as template_id, cast(3 as bigint) as score, 1 as rank from supplier")
def templates(s, d):
    """The template whose phrases weigh most."""
    texts = table(s, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.when(F.col("s_suppkey") % 2 == 0, "Water bill of the month").otherwise("Tax Invoice and water").alias("text"))
    t = s.createDataFrame([("a", "tax invoice", 3), ("b", "water bill", 2), ("b", "of the month", 1), ("c", "water", 1)], "template_id string, phrase string, weight long")
    return E.template_matches(texts, t).where("rank = 1").select("doc", "template_id", "score", "rank")


@query("u05_sharing_words", "with w as (select n_nationkey as id, unnest(string_split(lower(n_name), ' ')) as w from nation) select distinct a.id as left_id, b.id as right_id from w a join w b on a.w = b.w")
def sharing_words(s, d):
    """Nations with a word in common."""
    from ..operators.documents import sharing_words as f

    n = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey", X.tokens(F.col("n_name")).alias("words"))
    return f(n, n)
