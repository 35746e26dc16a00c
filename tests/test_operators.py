"""Worked examples of the document operators on literal rows."""

from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify, dates, numeric, text
from ledgerloom.operators import aliases, arithmetic, documents, entities, grids, history, mapping, mutations, reconcile
from ledgerloom.schema import AMOUNTS, GRID, ITEM
from ledgerloom.sources import files


def line(spark, **v):
    base = {f.name: None for f in ITEM} | {"document_id": 1, "line_no": 1, "item_code": "A", "description": "d"}
    return {k: Dec(str(x)) if k in AMOUNTS and x is not None else x for k, x in (base | v).items()}


def lines(spark, *rows):
    return spark.createDataFrame([line(spark, **r) for r in rows], ITEM)


GOOD = {"qty": 2, "rate": 100, "gross_amount": 200, "discount_pct": 10, "discount_amount": 20, "taxable_amount": 180, "cgst_pct": 9, "cgst_amount": "16.2", "sgst_pct": 9, "sgst_amount": "16.2", "final_value": "212.4"}


def test_valid_and_wrong_line(spark):
    a, b = arithmetic.validate_line(lines(spark, GOOD, GOOD | {"gross_amount": 250, "line_no": 2})).orderBy("line_no").collect()
    assert not a.needs_review and a.review_reason is None
    assert b.needs_review and b.review_reason.startswith("Gross Amount mismatch")


def test_fills_in_order(spark):
    r = arithmetic.validate_line(lines(spark, {"qty": 4, "gross_amount": 100, "cgst_pct": 5})).first()
    assert (r.rate, r.taxable_amount, r.cgst_amount, r.final_value) == (25, 100, 5, 105)
    r = arithmetic.validate_line(lines(spark, {"final_value": 50})).first()
    assert (r.qty, r.taxable_amount, r.gross_amount, r.rate) == (1, 50, 50, 50)


def test_edit_rules_skip_lines_without_rate(spark):
    a, b = arithmetic.flag_edited_line(lines(spark, GOOD | {"rate": 0}, GOOD | {"line_no": 2, "final_value": 300})).orderBy("line_no").collect()
    assert not a.needs_review and b.review_reason == "Final Value mismatch"


def header(spark, **v):
    base = {"id": 1, "grand_total_taxable": None, "total_discount": None, "grand_total_cgst": None, "grand_total_sgst": None, "grand_total_final": None}
    return spark.createDataFrame([{k: Dec(x) if isinstance(x, str) else x for k, x in (base | v).items()}], "id long, grand_total_taxable decimal(14,2), total_discount decimal(14,2), grand_total_cgst decimal(14,2), grand_total_sgst decimal(14,2), grand_total_final decimal(14,2)")


@pytest.mark.parametrize(("qty", "amount", "status"), [(5, "14295.60", "ok"), (3, "8577.36", "needs_review")])
def test_reconcile(spark, qty, amount, status):
    items = arithmetic.validate_line(lines(spark, {"qty": qty, "rate": "2859.12", "gross_amount": amount, "taxable_amount": amount, "final_value": amount}, {"line_no": 2, "qty": 3, "rate": "527.01", "gross_amount": "1581.03", "taxable_amount": "1581.03", "final_value": "1581.03"}))
    r = reconcile.reconcile(header(spark, grand_total_taxable="15876.63", total_discount="39.69", grand_total_final="15836.94"), items).first()
    assert r.extraction_status == status and (status == "ok" or "total mismatch" in r.review_reason)


def test_header_too_large_is_replaced_and_too_small_is_flagged(spark):
    items = arithmetic.validate_line(lines(spark, GOOD))
    r = reconcile.reconcile(header(spark, grand_total_final="99999.00"), items).first()
    assert (r.grand_total_final, r.extraction_status) == (Dec("212.4"), "ok")
    assert reconcile.reconcile(header(spark, grand_total_final="100.00"), items).first().extraction_status == "needs_review"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [(None, 0), ("10", 10), ("2.5", "2.5"), ("1,250.75", "1250.75"), ("-", 0), ("n/a", 0), ("9 %", 9)])
def test_to_decimal(spark, raw, want):
    assert one(spark, numeric.to_decimal(F.lit(raw))) == Dec(str(want))


@pytest.mark.parametrize(("raw", "want"), [("$1,234.56", "1234.56"), ("€500.00", 500), ("not money", None), ("(USD 1,000)", -1000), ("-", None)])
def test_currency(spark, raw, want):
    assert one(spark, numeric.normalize_currency(F.lit(raw))) == (None if want is None else Dec(str(want)))


@pytest.mark.parametrize(("raw", "want"), [("2024-01-15", "2024-01-15"), ("01/15/2024", "2024-01-15"), ("January 15, 2024", "2024-01-15"), ("not a date", None), ("", None), ("n/a", None)])
def test_month_first(spark, raw, want):
    assert str(one(spark, dates.parse_month_first(F.lit(raw)))) == str(want)


@pytest.mark.parametrize(("raw", "want"), [("15-Jun-2026", "2026-06-15"), ("12-07-2026", "2026-07-12"), ("15-July-2026", "2026-07-15"), ("05/06/2024", "2024-06-05")])
def test_day_first(spark, raw, want):
    assert str(one(spark, dates.parse_day_first(F.lit(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [("BOOml", "500ml"), ("SOOML", "500ML"), ("_SOOGM", "500GM"), ("1OOML", "100ML"), ("  a \t b ", "a b"), ("lnvoice", "Invoice"), (None, "")])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "price", "qty", "total"), [("6.00383.04", "63.84", "6.00", "383.04"), ("7.QQ439.85", "348.55", "7.00", "2439.85"), ("8.001111.20", "138.90", "8.00", "1111.20"), ("55.10", "3", "1.00", "55.10")])
def test_split_merged(spark, raw, price, qty, total):
    r = one(spark, numeric.split_merged_qty_total(F.lit(raw), F.lit(price).cast("decimal(18,2)")))
    assert (r.qty, r.total) == (Dec(qty), Dec(total))


@pytest.mark.parametrize(("raw", "qty", "uom"), [("10 L", "10.00", "L"), ("5 Nos", "5.00", "Nos"), ("100", "100.00", ""), ("12kg", "12.00", "kg"), (None, "0.00", ""), ("x", "0.00", "x")])
def test_split_qty(spark, raw, qty, uom):
    r = one(spark, numeric.split_qty_uom(F.lit(raw)))
    assert (r.qty, r.uom) == (Dec(qty), uom)


def test_indian_digits(spark):
    assert one(spark, numeric.group_indian(F.lit("1234567").cast("decimal(14,2)"))) == "₹12,34,567.00"
    assert one(spark, numeric.group_indian(F.lit("-999.5").cast("decimal(14,2)"))) == "-₹999.50"


def test_repair_extracted(spark):
    schema = "description string, qty string, rate double, amount double, uom string, cgst_pct double, raw_qty_total string"
    rows = [("Soybean Oil 1L", "6.00383", 63.84, 0.04, None, 0.0, "6.00383.04"), ("Anti Scalent", "10 L", 550.0, 5500.0, None, 9.0, None), ("66 above items 07-22/5/2026", "0", 0.0, 0.0, None, 0.0, None), ("5 High Lighter", "3", 2859.12, 14295.60, None, 0.0, None)]
    got = {r.description: r for r in arithmetic.repair_extracted(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"Soybean Oil 1L", "Anti Scalent", "High Lighter"}
    assert (got["Soybean Oil 1L"].qty, got["Soybean Oil 1L"].gross_amount) == (Dec("6.00"), Dec("383.04"))
    assert (got["Anti Scalent"].qty, got["Anti Scalent"].uom, got["Anti Scalent"].cgst_amount) == (Dec("10.00"), "L", Dec("495.00"))
    assert got["High Lighter"].qty == Dec("5.00")


@pytest.mark.parametrize(("raw", "kind", "conf"), [("PROFORMA INVOICE", "invoice_proforma", "1.000"), ("Purchase  Order", "purchase_order", "1.000"), ("TAX INVOICE", "invoice_final", "1.000"), ("QUOTATION validity", "quotation", "0.950"), ("", "quotation", "0.500"), ("bill no 7", "invoice_final", "0.900"), ("hello", None, None)])
def test_classify(spark, raw, kind, conf):
    r = one(spark, classify.classify(F.lit(raw)))
    assert (r.document_type, r.confidence) == (kind, conf and Dec(conf))


@pytest.mark.parametrize(("raw", "want"), [("Sl. No", "line_no"), ("HSN/SAC", "hsn_code"), ("Item Description", "description"), ("Qty", "qty"), ("CGST %", "cgst_pct"), ("CGST", "cgst_amount"), ("Disc %", "discount_pct"), ("Unit Price", "rate"), ("Taxable Value", "taxable_amount"), ("Total", "final_value"), ("foo", None), (" ", None)])
def test_header_field(spark, raw, want):
    assert one(spark, classify.header_field(F.lit(raw))) == want


def test_entities(spark):
    known = spark.createDataFrame([(1, "AIC Enterprises Pvt Ltd", "29AASCA0900A1Z3"), (2, "Different Vendor", "29BBBBB1234A1Z1")], "id long, name string, gstin string")
    seen = spark.createDataFrame([(1, "AIC Enterprises", "29AASCA0900A1Z3"), (2, "AIC Enterprises Private Limited", None), (3, "Nobody", None), (4, " ", "29BBBBB1234A1Z1")], "key long, name string, gstin string")
    got = {r.key: (r.entity_id, r.matched_by) for r in entities.resolve_entities(seen, known).collect()}
    assert got == {1: (1, "gstin"), 2: (1, "name"), 3: (None, None), 4: (None, None)}


def test_fuzzy_pairs_lose_nothing(spark):
    from difflib import SequenceMatcher

    names = ["acmetraders", "acmetrader", "acmtraders", "northwind", "northwinds", "zz", "zzz", "globex", "globexx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.left_n, r.right_n) for r in entities.fuzzy_pairs(df, df).collect()}
    assert got == {(a, b) for a in names for b in names if SequenceMatcher(None, b, a).ratio() >= 0.85}


def test_aliases(spark):
    table = spark.createDataFrame([(0, "mtrl", "materials", 1.0), (1, "qty", "quantity", 1.0)], "ord int, alias string, canonical string, confidence double")
    texts = spark.createDataFrame([("mtrl",), ("mat",), ("materiass",), ("quux",)], "text string")
    got = {r.text: (r.canonical, r.match_type) for r in aliases.resolve(texts, table, 0.7).collect()}
    assert got == {"mtrl": ("materials", "alias"), "mat": ("materials", "abbreviation"), "materiass": ("materials", "fuzzy"), "quux": (None, None)}
    spans = aliases.partial_values(spark.createDataFrame([(1, "  the mtrl  x")], "doc int, text string"), table).where("text = 'mtrl'").first()
    assert (spans.start_index, spans.end_index) == (6, 10)


def grid(spark, rows):
    return spark.createDataFrame([("d", "s", k, r) for k, r in enumerate(rows)], GRID)


def test_header_rows(spark):
    first = lambda rows: grids.header_rows(grid(spark, rows)).first().header_row
    assert first([["Name", "Age", "City"], ["Alice", "30", "NY"]]) == 0
    assert first([["Q1 2024 Invoices", None, None], ["Invoice ID", "Amount", "Date"], ["1", "100.5", "2024-01-01"]]) == 1
    assert first([["1", "2"], ["3", "4"]]) == 0


def test_types_merged_and_unrolled(spark):
    rows = [["d", "n", "c", "t"]] + [[f"2024-01-0{k}", str(10 + k), f"${k}.00", "Alice"] for k in range(1, 5)]
    got = {r.key: r.type for r in grids.column_types(grids.records(grid(spark, rows)), ["row_idx"]).collect()}
    assert got == {"d": "date", "n": "number", "c": "currency", "t": "text"}
    ranges = spark.createDataFrame([("d", "s", 1, 0, 1, 1)], "doc string, sheet string, top int, left int, bottom int, right int")
    filled = {r.row_idx: r.cells for r in grids.fill_merged(grid(spark, [["H1", "H2", "H3"], ["A1", None, "C1"]]), ranges).collect()}
    assert filled == {0: ["H1", "H2", "H3"], 1: ["A1", "A1", "C1"]}
    parts = [r.cells for r in grids.unroll_cells(grid(spark, [["a\nb", "1\n2\n3"]])).orderBy("part").collect()]
    assert parts == [["a", "1"], ["b", "2"], [None, "3"]]


def test_clusters(spark):
    assert len(one(spark, history.cluster_positions(F.array(*[F.lit(float(x)) for x in (10, 12, 50, 52, 100)]), 5))) == 3


def test_text_items_and_totals(spark):
    t = "1 AB12 Steel bolt 7318 10 Nos 5.00 50.00\n2 Washer 4 2.50 10.00\n2 Washer 4 2.50 10.00\nSub Total 60.00\nGrand Total 61.00\nGrand Total 62.00"
    docs = spark.createDataFrame([("d", t)], "doc string, text string")
    rows = grids.text_items(docs).orderBy("line").collect()
    assert [(r["shape"], r.description, r.amount) for r in rows] == [("full", "Steel bolt", "50.00"), ("numbered", "Washer", "10.00")]
    assert (grids.text_totals(docs).first().final, grids.text_totals(docs).first().taxable) == (Dec("62.00"), Dec("60.00"))
    h = grids.text_header(spark.createDataFrame([("d", "Invoice No: INV-7\nDate: 01-02-2024\nGSTIN 29AASCA0900A1Z3 INR")], "doc string, text string")).first()
    assert (h.document_no, h.document_date, h.gstin, h.currency) == ("INV-7", "01-02-2024", "29AASCA0900A1Z3", "INR")


def test_routing(spark):
    rows = [(1, "invoice", {"total_amount": "-100"}, 0.9), (2, "invoice", {"subtotal": "100", "tax_amount": "10", "total_amount": "999"}, 0.9), (3, "invoice", {"total_amount": "5"}, 0.1), (4, "mystery", {}, 0.9), (5, "invoice", {"subtotal": "100", "tax_amount": "10", "total_amount": "110"}, None)]
    got = {r.key: r.routing for r in mapping.route(spark.createDataFrame(rows, "key int, document_type string, record map<string,string>, confidence double")).collect()}
    assert got == {1: "quarantine", 2: "quarantine", 3: "quarantine", 4: "accept", 5: "accept"}


def test_eav_replacement(spark):
    row = lambda n, t: spark.createDataFrame([(1, n, t)], "id long, invoice_number string, total_amount double")
    eav = lambda n, t: mapping.to_eav(row(n, t), "id", ["invoice_number", "total_amount"])
    out = mutations.replace_children(eav("INV-999", 1500.5), eav("INV-999-REVISED", 1800.0), "document_id")
    assert mapping.from_eav(out).first().fields == {"invoice_number": "INV-999-REVISED", "total_amount": "1800.0"}


def test_repeated_items(spark):
    rows = lines(spark, {"line_no": 1, "description": "Steel bolt", "item_code": "A1", "final_value": 10}, {"line_no": 2, "description": "steel bolt M4", "item_code": "A1-X", "final_value": 10}, {"line_no": 3, "description": "Nut", "item_code": "B", "final_value": 10})
    assert [(r.line_no, r.item_code) for r in history.drop_repeated_items(rows).orderBy("line_no").collect()] == [(1, "A1-X"), (3, "B")]


def test_duplicate_document(spark):
    head = "id long, document_no string, document_type string, document_date string, grand_total_final decimal(14,2)"
    old = spark.createDataFrame([(1, "N1", "quotation", "2024-01-01", Dec("100.00")), (2, "N2", "quotation", "2024-01-01", Dec("500.00"))], head)
    new = spark.createDataFrame([(9, "N1", "quotation", "2024-01-01", Dec("100.20")), (8, None, "quotation", None, Dec("500.10")), (7, "N1", "quotation", "2024-02-01", Dec("100.00"))], head)
    items = lambda d, w: lines(spark, {"document_id": d, "qty": 1, "rate": 100, "final_value": 100, "description": w, "item_code": None})
    got = {r.new_id: r.duplicate_of for r in entities.duplicate_documents(new, items(9, "hex bolt 10mm"), old, items(1, "hex bolt 10 mm")).collect()}
    assert got == {9: 1}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("inv #,customer,total\nINV-999,\"Acme, Corp\",150.00\n")
    (tmp_path / "b.csv").write_bytes((tmp_path / "a.csv").read_bytes())
    (tmp_path / "c.pdf").write_bytes(b"PK\x03\x04zzzz")
    (tmp_path / ".hidden.csv").write_text("x")
    found = files.scan_folder(spark, str(tmp_path))
    assert sorted((r.name, r.file_type) for r in found.collect()) == [("a.csv", "csv"), ("c.pdf", "xlsx")]
    assert [r.name for r in files.mismatched(found).collect()] == ["c.pdf"]
    cells = files.read_grids(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()
    assert [r.cells for r in cells] == [["inv #", "customer", "total"], ["INV-999", "Acme, Corp", "150.00"]]


def test_split_text_and_json_cells(spark):
    t = spark.createDataFrame([("d", "invoice_1: a\ninvoice_2 b\ninvoice_1 again")], "doc string, text string")
    assert sorted((r.number, r.body) for r in files.split_text(t).collect()) == [("1", "a"), ("2", "b")]
    cell = '"{""document_no"": ""Q1"", ""items"": [{""description"": ""bolt"", ""qty"": ""2""}, {""description"": ""nut""}]}"'
    got = files.json_cells(grid(spark, [["x", cell]])).orderBy("pos").collect()
    assert [(r.document_no, r.description, r.qty) for r in got] == [("Q1", "bolt", "2"), ("Q1", "nut", None)]


def test_streaming(spark, tmp_path):
    from ledgerloom.streaming import ingest

    src, sink, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    schema = "document_id long, file_hash string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.json(src)
    ingest.run_available(ingest.file_stream(spark, src, schema), sink, chk, "file_hash")
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").json(src)
    ingest.run_available(ingest.file_stream(spark, src, schema), sink, chk, "file_hash")
    assert sorted(r.file_hash for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_search_prefixes():
    assert documents.split_prefix("vendor: acme") == ("vendor", "acme")
    assert documents.split_prefix("what: acme") == (None, "acme") and documents.split_prefix("acme") == (None, "acme")


def test_catalog_rows(spark):
    from ledgerloom.operators import catalogs

    rows = spark.createDataFrame([(1, {"col_1": "00123-A5", "col_2": "|", "col_10": "Acid", "col_3": "Acetic", "col_4": "MERCK", "col_5": "BOOml", "col_6": "1,200.50"}), (2, {"col_1": "note", "x": "y"})], "k int, record map<string,string>")
    got = {r.k: r for r in rows.select("k", catalogs.is_item_row(F.col("record")).alias("i"), catalogs.item_code(F.col("record")).alias("c"), catalogs.description(F.col("record")).alias("d")).collect()}
    assert (got[1].i, got[1].c, got[1].d) == (True, "00123-A5", "Acetic Acid") and (got[2].i, got[2].c) == (False, "")
    assert [r.k for r in catalogs.search_rows(rows, "acetic acid").collect()] == [1]
    keyed = one(spark, catalogs.canonical_keys(F.create_map(F.lit("unit_price"), F.lit("5"), F.lit("other"), F.lit("z"))))
    assert (keyed["Rate"], keyed["col_14"], keyed["other"], keyed["col_1"]) == ("5", "5", "z", None)


def test_learned_catalog(spark):
    from ledgerloom.operators import catalogs

    texts = spark.createDataFrame([(1, "AIC Enterprises Pvt", "x\nHigh Lighter pens 7 Box\n"), (2, "zzz", "")], "doc int, vendor_name string, text string")
    vendors = spark.createDataFrame([(0, "AIC ENTERPRISES"), (1, "AIC")], "ord int, vendor string")
    found = catalogs.vendor_lookup(texts, vendors)
    assert {r.doc: r.learned for r in found.collect()} == {1: "AIC ENTERPRISES", 2: None}
    known = spark.createDataFrame([("AIC ENTERPRISES", "High Lighter", Dec("10.00")), ("AIC ENTERPRISES", "Slim Candle", Dec("1.00"))], "vendor string, description string, rate decimal(18,2)")
    (r,) = catalogs.catalog_items(found.withColumnRenamed("learned", "vendor"), known).collect()
    assert (r.description, r.qty, r.uom, r.final_value) == ("High Lighter", Dec("7.00"), "Box", Dec("82.60"))
