"""Embedded invoices, sections of tax invoices and first tables: odd inputs by hand."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import invoice_text as I
from ledgerloom.sources import embedded as J

PLAIN = '{"invoice_no": "N-1", "date": "2024-02-03", "seller": {"name": "A \\"B\\" Ltd"}, "summary": {"tax": 3, "grand_total": "1,018.00"}, "items": [{"desc": "x", "qty": 2, "rate": "9"}, {"item_no": "7.", "quantity": "1", "amount": 4}]}'


def test_ways_to_embed(spark):
    doubled = PLAIN.replace('"', '""')
    escaped = PLAIN.replace("\\", "\\\\").replace('"', '\\"')
    over = '{\\\\"invoice_no\\\\": \\\\"N-1\\\\", \\\\"items\\\\": []}'
    rows = [(1, PLAIN), (2, doubled + '" trailing }'), (3, escaped), (4, over), (5, "{"), (6, None), (7, '{"items": 5}'), (8, "{}")]
    got = {r.k: r.j for r in spark.createDataFrame(rows, "k int, t string").select("k", J.parsed(F.col("t")).alias("j")).collect()}
    for k in (1, 2, 3):
        assert (got[k].invoice_no, got[k].seller.name, len(got[k]["items"])) == ("N-1", 'A "B" Ltd', 2)
    assert got[4].invoice_no == "N-1" and all(got[k] is None or got[k].invoice_no is None for k in (5, 6, 7, 8))


def test_lines_and_header(spark):
    grid = spark.createDataFrame([("d", "s", 0, ["x", PLAIN]), ("e", "s", 0, ["{no json"]), ("f", "s", 0, None)], "doc string, sheet string, row_idx int, cells array<string>")
    heads, lines = J.sheet_invoices(grid)
    h = heads.collect()
    assert len(h) == 1 and (h[0].document_no, h[0].document_date, float(h[0].grand_total_final), float(h[0].grand_total_cgst)) == ("N-1", dt.date(2024, 2, 3), 1018.0, 1.5)
    assert sorted((r.line_no, r.description, float(r.taxable_amount), float(r.final_value), r.uom) for r in lines.collect()) == [(1, "x", 18.0, 18.0, "pcs"), (7, "", 0.0, 4.0, "pcs")]


def test_texts_without_json_are_read_as_text(spark):
    texts = spark.createDataFrame([(1, f"invoice_1 {PLAIN} invoice_2 {PLAIN}"), (2, "invoice_1 nothing, invoice_no {"), (3, None), (4, "")], "doc int, text string")
    heads, lines = J.ingest_texts(texts)
    got = sorted((r.doc, r.document_no, r.extraction_status) for r in heads.collect())
    assert got == [(1, "N-1", "ok"), (2, None, "needs_review"), (4, None, "needs_review")]
    assert {r.doc for r in lines.collect()} == {1}


def _items(spark, text):
    rows = I.gst_items(spark.createDataFrame([(1, text)], "doc int, text string")).orderBy("line_no").collect()
    return [(r.description, float(r.qty), r.uom, float(r.rate), float(r.gross_amount)) for r in rows]


def test_sections(spark):
    assert _items(spark, "Wound filter 8421 5 Nos 10.00 50.00\nTotal 50.00\nBolt 10.00 20.00") == [("Wound filter", 5, "Nos", 10, 50)]
    assert _items(spark, "Particulars\nAcid one\n20 litres can\n5 litres jar\nAmount\nNut 2 Kg 3.00") == [("Acid one 20 litres can", 1, "Nos", 0, 0), ("litres jar", 1, "Nos", 0, 0), ("Nut", 2, "Kg", 3, 6)]
    assert _items(spark, "Particulars\nPump 8421 3 Nos 65000\nHose 8421 2 Nos 1200\nValve 8421 T0 Nos 700\nCap 1,500.00") == [("Pump", 3, "Nos", 650, 1950), ("Hose", 2, "Nos", 0, 1200), ("Valve T0 Nos", 10, "Nos", 700, 7000), ("Cap", 1, "Nos", 1500, 1500)]
    assert _items(spark, "no head\n1 Bolt 10.00 20.00") == [] and _items(spark, None) == []


def test_first_tables(spark):
    texts = spark.createDataFrame([(1, "Supplier: Text Ltd\nCurrency: EUR"), (2, "x"), (3, None)], "doc int, text string")
    wide = ["To ,\nBuyer Co\nRoad 1\nGST No : G1\nKind Attention : Z", *[None] * 10, "Quotation No : Q-9\nValidity : 01-03-2024\nDate : 2024-01-05"]
    tables = spark.createDataFrame([(1, 0, ["Other Pvt Ltd\nLane 2\nTel 5"]), (1, 1, wide), (2, 0, ["Lone Ltd"]), (3, 0, [None]), (3, 1, [None])], "doc int, row_idx int, cells array<string>")
    got = {r.doc: r for r in I.table_header(texts, tables).collect()}
    a = got[1]
    assert (a.vendor_name, a.vendor_address, a.customer_name, a.customer_gstin, a.customer_address) == ("Text Ltd", "Lane 2", "Buyer Co", "G1", "Buyer Co, Road 1")
    assert (a.document_no, a.validity_date, a.document_date, a.currency) == ("Q-9", "2024-03-01", "2024-01-05", "EUR")
    assert got[2].vendor_name is None and got[2].currency == "INR" and got[3].customer_name is None


def test_texts_without_json_are_set_apart_once(spark):
    texts = spark.createDataFrame([(1, f"invoice_1 {PLAIN}"), (2, "Quotation No: Q-77\nBolt 2 Nos 10.00 20.00")], "doc int, text string")
    for df in J.ingest_texts(texts):
        assert df._jdf.queryExecution().analyzed().toString().count("from_json") <= 1
        assert {r.doc for r in df.collect()} == {1, 2}
