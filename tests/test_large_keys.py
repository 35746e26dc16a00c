"""Rates, codes and keys beyond those of small tables."""

from ledgerloom.operators import grids as G
from ledgerloom.operators import invoice_text as I


def _gst(spark, line):
    return [(r.description, float(r.rate), float(r.gross_amount)) for r in I.gst_items(spark.createDataFrame([(1, f"Particulars\n{line}")], "doc int, text string")).collect()]


def test_amounts_of_four_digits_without_commas_leave_no_cents(spark):
    assert _gst(spark, "1 blue plate 8421 45 Kg 1093.71 49,216.95") == [("blue plate", 1093.71, 49216.95)]
    assert _gst(spark, "1 blue plate 8421 45 Kg 12909.10 580,909.50\nlitres pack") == [("blue plate litres pack", 12909.1, 580909.5)]

def test_long_codes_of_dated_lines(spark):
    text = "12/03/2024 K02109371 blue plate 85,216.95\n12/03/2024 K021234567 red plate 1.00\n12/03/2024 K0210937 old plate 2.00\n12/03/2024 Laboratory glass 3.00"
    rows = G.text_items(spark.createDataFrame([(1, text)], "doc int, text string")).orderBy("line").collect()
    assert [(r.code, r.description) for r in rows] == [("K02109371", "blue plate"), ("K021234567", "red plate"), ("K0210937", "old plate"), (None, "Laboratory glass")]
