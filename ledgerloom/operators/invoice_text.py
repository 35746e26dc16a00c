"""Item lines of tax invoices by section, and headers that stand in a page's first table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates
from ..functions.text import clean_text_layer
from .grids import text_header

# What begins and ends the items of a tax invoice, what is no item, numbers that are postcodes, and whole numbers that are prices (in hundredths, or as they are).
SECTION_HEADS = ["description of goods", "particulars", "item description", "hsn/sac", "gst rate", "amount"]
SECTION_ENDS = ["total", "tatar", "sgst", "cgst", "igst", "amount chargeable", "tax amount", "note :", "declaration"]
SECTION_ITEMS = ["anti scalent", "wound filter", "sediment cartridge", "cartridge filter"]
CONTINUED = ["ml to", "litres", "ltr"]
NO_ITEMS = ["no.", "cope", "code", "description of goods", "goods", "hsn", "gst rate", "rate", "amount", "si no", "si", "sl no", "hsn code", "wal", "busy", "inward", "materials", "sign", "signed by", "above items", "security", "total"]
NO_ITEM_PARTS = ["description of goods", "si no", "hsn code", "gst rate"]
POSTCODES = ["560043", "560049"]
HUNDREDTHS, PRICES = ["55000", "65000", "70000", "80000", "90000"], ["550", "650", "700", "800", "900"]
UNITS = "L|Nos|Kg|Pcs|Mtr|Box|Set|Pack|Unit"


def _says(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def section_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, s, full): lines of texts (doc, text) within the items' section; `full` has the line that continues one joined on.

    A line with a head word opens the section and is none of it, anywhere; one
    with an item's name opens it too. The first line after that with a closing
    word, and no head word, ends it. A line of measures without an amount
    continues the one before it, unless that is itself a continuation.
    """
    lines = docs.select("doc", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line", "s"))
    low, w = F.lower("s"), W.partitionBy("doc").orderBy("line")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns({"head": _says(low, SECTION_HEADS), "item": _says(low, SECTION_ITEMS), "close": _says(low, SECTION_ENDS)})
    lines = lines.withColumn("begun", F.coalesce(F.max(F.col("head") | F.col("item")).over(before), F.lit(False)))
    lines = lines.withColumn("ended", F.max(F.col("begun") & F.col("close") & ~F.col("head")).over(w))
    lines = lines.withColumn("inside", ~F.col("head") & ~F.col("ended") & (F.col("begun") | F.col("item")))
    more = _says(F.lower("s"), CONTINUED) & ~F.col("s").rlike(r"\b\d+\.\d{2}\b") & ~F.col("head") & ~F.col("close")
    lines = lines.withColumn("more", more & F.coalesce(F.lag("inside").over(w), F.lit(False)))
    # In a run of such lines every other one is a continuation.
    run = F.sum((~F.col("more")).cast("int")).over(w)
    lines = lines.withColumn("run", run).withColumn("taken", F.col("more") & (F.row_number().over(W.partitionBy("doc", "run").orderBy("line")) % 2 == 0))
    full = F.when(F.coalesce(F.lead("taken").over(w), F.lit(False)), F.concat("s", F.lit(" "), F.lead("s").over(w))).otherwise(F.col("s"))
    return lines.withColumn("full", full).where("inside and not taken").select("doc", "line", "s", "full")


def gst_items(docs: DataFrame) -> DataFrame:
    """(doc, line_no, description, hsn_code, qty, uom, rate, gross_amount, cgst_amount, sgst_amount, final_value) of tax invoices (doc, text).

    The last two amounts of a line are rate and amount; a single one is the
    amount from 1,000 on, else the rate; without any, whole numbers of known
    prices or sizes count. What is missing follows from the quantity, 1 if none
    is told. Taxes are two halves of 18 %.
    """
    kind = "decimal(18,2)"
    s = F.col("s")
    rows = section_lines(docs)
    hsn = F.regexp_extract(s, r"\b(\d{4,8})\b", 1)
    measure = rf"(?i)\b(\d+|T0)\s*[%\]|]?\s*(T0|\d+)?\s*({UNITS})\b"
    told = F.when(F.regexp_extract(s, measure, 2) != "", F.regexp_extract(s, measure, 2)).otherwise(F.regexp_extract(s, measure, 0))
    count = F.regexp_extract(F.replace(told, F.lit("T0"), F.lit("10")), r"\d+", 0)
    has = s.rlike(measure)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast(kind)
    rows = rows.select(
        "doc",
        "line",
        "full",
        hsn.alias("hsn_code"),
        F.when(has, F.coalesce(number(F.nullif(count, F.lit(""))), F.lit(1))).otherwise(1).cast(kind).alias("qty"),
        F.when(has, F.regexp_extract(s, measure, 3)).otherwise("Nos").alias("uom"),
        F.transform(F.regexp_extract_all(s, F.lit(r"[\d,]+\.\d{2}"), 0), number).alias("amounts"),
        F.filter(F.regexp_extract_all(s, F.lit(r"\b\d{3,6}\b"), 0), lambda x: (x != hsn) & ~x.isin(*POSTCODES)).alias("whole"),
    )
    n, one = F.size("amounts"), F.element_at("amounts", -1)
    known = F.filter("whole", lambda x: x.isin(*HUNDREDTHS, *PRICES))
    large = F.filter("whole", lambda x: ~x.isin(*HUNDREDTHS, *PRICES) & (number(x) >= 1000))
    price = F.try_element_at(known, F.lit(-1))
    price = F.coalesce(F.when(price.isin(*HUNDREDTHS), number(price) / 100).otherwise(number(price)), F.lit(0)).cast(kind)
    size = number(F.try_element_at(large, F.lit(-1)))
    size = F.coalesce(F.when(size < 20000, size).otherwise(size / 100), F.lit(0)).cast(kind)
    cents = lambda c: F.bround(c, 2).cast(kind)
    rate = F.when(n >= 2, F.try_element_at("amounts", F.lit(-2))).when((n == 1) & (one >= 1000), F.when(F.col("qty") > 0, cents(F.try_divide(one, "qty"))).otherwise(one)).when(n == 1, one).otherwise(price)
    rows = rows.withColumn("rate", rate.cast(kind))
    amount = F.when((n >= 2) | ((n == 1) & (one >= 1000)), one).when(n == 1, cents(F.col("rate") * F.col("qty"))).otherwise(F.when((size == 0) & (F.col("rate") > 0), cents(F.col("rate") * F.col("qty"))).otherwise(size))
    name = F.col("full")
    # The whole part of an amount without commas is no code: it goes with its amount.
    for pattern in (r"^\W*\d+\W*", r"\b\d{4,8}\b(?!\.\d{2})", r"\b\d+\s*%", rf"(?i)\b\d+\s*(?:{UNITS})\b", r"[\d,]+\.\d{2}", r"\b\d{3,}\b"):
        name = F.regexp_replace(name, pattern, "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[_|()\[\]{}\\/—«‘']+", " "), r"\s+", " "))
    rows = rows.withColumns({"gross_amount": amount.cast(kind), "description": name})
    low = F.lower("description")
    kept = rows.where((F.length("description") >= 3) & ~low.isin(*NO_ITEMS) & ~_says(low, NO_ITEM_PARTS))
    part = lambda r: cents(F.col("gross_amount") * F.lit(r).cast("decimal(4,2)"))
    return kept.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("line")).alias("line_no"), "description", "hsn_code", "qty", "uom", "rate", "gross_amount", part("0.09").alias("cgst_amount"), part("0.09").alias("sgst_amount"), part("1.18").alias("final_value"))


#: Lines of a customer's block that are no name, and those that are no address.
NO_NAME = ["GST Catagery", "GST Category", "Department :", "Kind Attention", "Kind A", "E-mail Id", "Email", "Enq. Ref", "Enq.Date"]
NO_ADDRESS = ["To ,", "GST", "Kind Attention", "Department", "Enq.", "Email"]


def table_header(texts: DataFrame, tables: DataFrame, vendor_names: dict[str, str] | None = None) -> DataFrame:
    """Header fields of texts (doc, text), overlaid by what the first table (doc, row_idx, cells) of a document says.

    The vendor's block is the first cell of row 0, the customer's that of row 1,
    the quotation's the twelfth of row 1; tables of one row say nothing. What the
    table tells of customer, enquiry and quotation counts before the text, of the
    vendor (but for its tax number) only where the text is silent. vendor_names:
    words of the vendor's block that name the vendor whatever else there is.
    """
    block = lambda row, cell: F.max(F.when(F.col("row_idx") == row, clean_text_layer(F.coalesce(F.get("cells", F.lit(cell)), F.lit("")))))
    found = tables.where("row_idx <= 1").groupBy(F.col("doc").alias("__d")).agg(block(0, 0).alias("v"), block(1, 0).alias("c"), block(1, 11).alias("q"), F.count_distinct("row_idx").alias("n")).where("n = 2")
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = found.select("__d", F.col("v").alias("__block"), *[lines(F.col(k)).alias(f"__{k}") for k in "vcq"])
    met = text_header(texts).join(found, F.col("doc") == F.col("__d"), "left")
    has = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w))
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    after = lambda x: F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))
    part = lambda x: F.trim(F.get(F.split(x, ":"), F.lit(1)))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    rest = lambda xs: F.slice(xs, F.lit(2), F.size(xs))
    joined = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, ", "))
    v, c, q = F.col("__v"), F.col("__c"), F.col("__q")
    named = F.coalesce(*[F.when(F.col("__block").contains(k), name) for k, name in (vendor_names or {}).items()], F.lit(None).cast("string"))
    company = first(F.filter(v, lambda x: has(F.upper(x), ["PVT", "LTD", "LIMITED"])))
    people = F.filter(c, lambda x: ~x.startswith("To ,") & ~x.contains("GST No") & ~has(x, NO_NAME) & x.rlike(r"\p{L}"))
    gst = last(F.filter(c, lambda x: x.contains("GST No") & ~x.startswith("To ,") & ~has(x, NO_NAME[:3]) & x.contains(":")))
    # Which field a line of the quotation's block names: the first in this order.
    kinds = [("document_no", ["Quotation. No.", "Quotation No", "Quota"]), ("payment_terms", ["Payment Terms"]), ("currency", ["Currency"]), ("validity_date", ["Validity"]), ("document_date", ["Date"])]

    def kind(x: Column) -> Column:
        out = None
        for name, words in kinds:
            out = F.when(has(x, words), name) if out is None else out.when(has(x, words), name)
        return out

    said = lambda name: last(F.filter(q, lambda x: (kind(x) == name) & x.contains(":")))
    iso = lambda x: dates.parse_day_first(x).cast("string")
    enquiry = lambda words, but: last(F.filter(c, lambda x: has(x, words) & ~has(x, but) & x.contains(":")))
    asked = iso(after(enquiry(["Enq.Date"], ["Enq. Ref"])))
    told = {
        "vendor_name": F.coalesce(named, "vendor_name", company),
        "gstin": F.coalesce(F.nullif(F.regexp_extract("__block", r"GSTNo\.\s*:\s*([A-Z0-9]+)", 1), F.lit("")), "gstin"),
        "vendor_address": joined(F.filter(rest(v), lambda x: ~x.rlike("^(GST|Phone|Tel|Email|Mob)"))),
        "customer_name": F.coalesce(first(people), "customer_name"),
        "customer_gstin": F.coalesce(part(gst), "customer_gstin"),
        "customer_address": F.coalesce("customer_address", F.when(F.size(c) > 2, joined(F.filter(rest(c), lambda x: ~has(x, NO_ADDRESS))))),
        "enquiry_ref": F.coalesce(after(enquiry(["Enq. Ref"], ["\0"])), "enquiry_ref"),
        "enquiry_date": F.coalesce(asked, "enquiry_date"),
        "document_no": F.coalesce(after(said("document_no")), "document_no"),
        "payment_terms": F.coalesce(after(said("payment_terms")), "payment_terms"),
        "currency": F.coalesce(after(said("currency")), "currency"),
        "validity_date": F.coalesce(iso(after(said("validity_date"))), "validity_date"),
        "document_date": F.coalesce(iso(part(said("document_date"))), "document_date", asked, "enquiry_date"),
    }
    return met.withColumns(told).drop("__d", "__block", "__v", "__c", "__q")
