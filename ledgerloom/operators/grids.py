"""Sheet and page grids: header rows, typed columns, line explosion. A grid is (doc, sheet, row_idx, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.classify import header_field

HEAD_ROWS, SAMPLE, VOTE = 15, 20, 0.6
SHEET = ["doc", "sheet"]


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")


def header_rows(grid: DataFrame) -> DataFrame:
    """Per sheet the first of 15 rows with at least two filled cells of which at least two, and half, are short texts; else 0."""
    filled = _filled(F.col("cells"))
    texts = F.size(F.filter(filled, lambda c: (F.length(F.trim(c)) <= 50) & F.trim(c).try_cast("double").isNull()))
    n = F.size(filled)
    good = (F.col("row_idx") < HEAD_ROWS) & (n >= 2) & (texts >= 2) & (texts / F.when(n > 0, n) >= 0.5)
    return grid.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(good, F.col("row_idx"))), F.lit(0)).alias("header_row"))


# Words by which a header row is known at once (a line number, or a description beside a quantity or amount), and words of the labels below it.
NUMBER_HEADS = ["sl #", "sl.no", "sl no", "s.no", "sno", "item no", "line no", "sr no", "item #"]
TEXT_HEADS = ["item description", "particulars", "description"]
AMOUNT_HEADS = ["qty", "quantity", "rate", "price", "amount", "total"]
SUB_HEADS = ["%", "amount", "uom", "unit", "price", "remarks", "specification", "specifications", "rate", "a+b", "after discount", "(rs.)"]
STACKED = 3


def _says(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def header_rows_by_fields(grid: DataFrame) -> DataFrame:
    """Per sheet (header_row, last_header_row, fields): the first row known by its words, else the first with two recognised headers, else 0.

    Up to three rows of labels right below are stacked on it; a row with a
    number above 5 is data. fields has the canonical field of each column, a
    field's first column only.
    """
    text = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    number = lambda c: F.regexp_replace(F.trim(c), "[,$₹]", "").try_cast("double")
    marked = grid.select(
        *SHEET,
        "row_idx",
        "cells",
        (_says(text, NUMBER_HEADS) | (_says(text, TEXT_HEADS) & _says(text, AMOUNT_HEADS))).alias("told"),
        (F.size(F.filter("cells", lambda c: header_field(c).isNotNull())) >= 2).alias("known"),
        (_says(text, SUB_HEADS) & ~F.exists("cells", lambda c: F.coalesce(number(c) > 5, F.lit(False)))).alias("sub"),
    )
    first = lambda flag: F.min(F.when(F.col(flag), F.col("row_idx")))
    heads = marked.groupBy(*SHEET).agg(F.coalesce(first("told"), first("known"), F.lit(0)).alias("header_row"))
    near = marked.join(heads, SHEET).where(F.col("row_idx").between(F.col("header_row"), F.col("header_row") + STACKED))
    rows = near.groupBy(*SHEET, "header_row").agg(F.sort_array(F.collect_list(F.struct("row_idx", "sub", "cells"))).alias("rows"))
    # Rows below count as long as each is a row of labels.
    stacked = F.filter("rows", lambda r, k: (k == 0) | F.forall(F.slice("rows", F.lit(2), k), lambda x: x["sub"]))
    width = F.array_max(F.transform("stacked", lambda r: F.size(r["cells"])))
    label = lambda k: F.array_join(F.filter(F.transform("stacked", lambda r: F.replace(F.trim(F.get(r["cells"], k)), F.lit("\n"), F.lit(" "))), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    fields = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda k: header_field(label(k)))
    out = rows.withColumn("stacked", stacked).withColumn("fields", fields)
    once = F.transform("fields", lambda f, k: F.when(~F.array_contains(F.slice("fields", F.lit(1), k), f), f))
    return out.select(*SHEET, "header_row", F.element_at("stacked", -1)["row_idx"].alias("last_header_row"), once.alias("fields"))


def records(grid: DataFrame) -> DataFrame:
    """Rows below the header as maps with lower-snake keys; blank rows go; repeated headers keep the last value."""
    heads = header_rows(grid)
    key = lambda c, i: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_"))
    top = grid.join(heads, SHEET).where("row_idx = header_row").select(*SHEET, F.transform("cells", key).alias("keys"))
    body = grid.join(heads, SHEET).where("row_idx > header_row").join(top, SHEET).where(F.size(_filled(F.col("cells"))) > 0)
    pairs = F.filter(F.arrays_zip(F.col("keys").alias("k"), F.col("cells").alias("v")), lambda x: x["k"].isNotNull())
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return body.select(*SHEET, "row_idx", F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))).alias("record"))


def fill_merged(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of a merged range (doc, sheet, top, left, bottom, right) take the top-left value; of ranges that overlap the greatest value counts.

    A range is spread to its cells, so cells and ranges meet by place and a sheet
    with many of both costs their sizes, not their product. A row stays in one
    piece: it looks its filled columns up in one map.
    """
    rows = grid.select(*SHEET, "row_idx", "cells")
    tops = ranges.select(*SHEET, F.col("top").alias("row_idx"), "left", "right", "bottom")
    corner = tops.join(rows, [*SHEET, "row_idx"]).select(*SHEET, "left", "right", F.explode(F.sequence("row_idx", "bottom")).alias("row_idx"), F.get("cells", F.col("left")).alias("value"))
    spots = corner.select(*SHEET, "row_idx", F.explode(F.sequence("left", "right")).alias("col"), "value").groupBy(*SHEET, "row_idx", "col").agg(F.max("value").alias("value"))
    filled = spots.groupBy(*SHEET, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("__filled"))
    met = rows.join(filled, [*SHEET, "row_idx"], "left")
    cells = F.transform("cells", lambda c, k: F.when(F.coalesce(F.map_contains_key("__filled", k), F.lit(False)), F.try_element_at("__filled", k)).otherwise(c))
    return met.select(*SHEET, "row_idx", cells.alias("cells"))


def column_types(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with a map `record` -> (doc, sheet, key, type): a 60 % vote of the first 20 rows, date before currency before number, else text.

    A date needs a separator and five characters; a currency needs a symbol.
    """
    n = F.row_number().over(W.partitionBy(*SHEET).orderBy(*order))
    kv = rows.withColumn("n", n).where(F.col("n") <= SAMPLE).select(*SHEET, F.explode("record").alias("key", "v")).withColumn("v", F.trim("v"))
    told = F.coalesce(F.col("v"), F.lit("")) != ""
    v = F.col("v")
    date = v.rlike(r"[/\-. ,]") & (F.length(v) >= 5) & (F.coalesce(*[F.try_to_date(v, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy")]).isNotNull())
    money = v.rlike("[$£€¥₹]") & F.trim(F.regexp_replace(v, "[$£€¥₹,]", "")).try_cast("double").isNotNull()
    number = v.try_cast("double").isNotNull()
    share = lambda c: F.coalesce(F.avg(F.when(told, c.cast("int"))), F.lit(0.0))
    g = kv.groupBy(*SHEET, "key").agg(share(date).alias("d"), share(money).alias("m"), share(number).alias("n"))
    return g.select(*SHEET, "key", F.when(F.col("d") >= VOTE, "date").when(F.col("m") >= VOTE, "currency").when(F.col("n") >= VOTE, "number").otherwise("text").alias("type"))


def unroll_cells(grid: DataFrame) -> DataFrame:
    """A row whose cells hold several lines becomes as many rows, columns matched by position; missing lines are null."""
    parts = F.transform("cells", lambda c: F.split(F.coalesce(c, F.lit("")), "\n"))
    n = F.array_max(F.transform(parts, lambda p: F.size(p)))
    rows = grid.withColumn("__p", parts).select(*SHEET, "row_idx", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("part"), "__p")
    return rows.select(*SHEET, "row_idx", "part", F.transform("__p", lambda p: F.nullif(F.trim(F.try_element_at(p, F.col("part"))), F.lit(""))).alias("cells"))


def generic_items(rows: DataFrame) -> DataFrame:
    """A line from a record by header name, with positional defaults from `cells`."""
    by = lambda name, at: F.coalesce(*[F.try_element_at("record", F.lit(k)) for k in name], F.try_element_at("cells", F.lit(at)))
    return rows.select(*SHEET, "row_idx", by(["description", "particulars", "item"], 2).alias("description"), by(["qty", "quantity"], 3).alias("qty"), by(["rate", "price"], 4).alias("rate"), by(["amount", "total"], 5).alias("amount"))


def wide_row_items(grid: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a fixed number of columns; a decimal torn in two cells ('1,234.' '50') is joined before columns are named."""
    step = lambda acc, c: F.when((F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1)).rlike(r"^[\d,]+\.$") & c.rlike(r"^\d{1,2}$"), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), c)))).otherwise(F.concat(acc, F.array(c)))
    joined = grid.withColumn("cells", F.aggregate("cells", F.array().cast("array<string>"), step))
    return joined.where(F.size("cells") >= len(columns)).select(*SHEET, "row_idx", *[F.element_at("cells", k + 1).alias(c) for k, c in enumerate(columns)])


_MONEY, _QTY, _DESC = r"[$₹]?\s*([\d,]+\.\d{2})", r"(\d+(?:\.\d+)?)", r"([A-Za-z](?:(?!\d\.\d\d)[^|])*?)"
#: Line shapes of scanned pages, tried in order: name, pattern, groups as (code, description, hsn, qty, unit, rate, amount; 0 where the shape has none).
LINE_SHAPES = [
    ("volume", rf"^\s*{_DESC}\s+(\d{{1,5}})\s+(\d{{1,5}}\s*units?)\s+{_MONEY}\s*$", (0, 1, 0, 2, 3, 0, 4)),
    ("full", rf"^\s*\d{{1,3}}[.)]?\s+([A-Z0-9\-]{{4,}})\s+(.+?)\s+(\d{{4,8}})\s+{_QTY}\s+([A-Za-z]{{1,6}})\s+{_MONEY}\s+{_MONEY}\s*$", (1, 2, 3, 4, 5, 6, 7)),
    ("hsn", rf"^\s*\d{{1,3}}[.)]?\s+(.+?)\s+(\d{{4,8}})\s+{_QTY}\s+([A-Za-z]{{1,6}})\s+{_MONEY}\s+{_MONEY}\s*$", (0, 1, 2, 3, 4, 5, 6)),
    ("between", rf"^\s*(?:\d{{1,3}}\s+)?{_DESC}\s+{_MONEY}\s+{_QTY}\s+{_MONEY}\s*$", (0, 1, 0, 3, 0, 2, 4)),
    ("glued", rf"^\s*(?:\d{{1,3}}\s+)?{_DESC}\s+{_MONEY}\s+(\d+\.\d{{2}})([\d,]+\.\d{{2}})\s*$", (0, 1, 0, 3, 0, 2, 4)),
    ("coded", rf"^\s*\d{{1,3}}[.)]?\s+([A-Z0-9\-]*\d[A-Z0-9\-]{{3,}})\s+(.+?)\s+{_QTY}\s+(?:([A-Za-z]{{1,6}})\s+)?{_MONEY}\s+{_MONEY}\s*$", (1, 2, 0, 3, 4, 5, 6)),
    ("unit", rf"^\s*\d{{1,3}}[.)]?\s+(.+?)\s+{_QTY}\s+([A-Za-z]{{1,6}})\s+{_MONEY}\s+{_MONEY}\s*$", (0, 1, 0, 2, 3, 4, 5)),
    ("numbered", rf"^\s*\d{{1,3}}[.)]?\s+(.+?)\s+{_QTY}\s+{_MONEY}\s+{_MONEY}\s*$", (0, 1, 0, 2, 0, 3, 4)),
    ("plain", rf"^\s*{_DESC}\s+([0-9SsoOlI|]{{1,4}}|\d+\.\d+)\s+(?:([A-Za-z]{{2,6}})\s+)?{_MONEY}\s+{_MONEY}\s*$", (0, 1, 0, 2, 3, 4, 5)),
    ("priced", rf"^\s*{_DESC}\s+([0-9SsoOlI|]{{1,4}})\s+{_MONEY}\s*$", (0, 1, 0, 2, 0, 3, 0)),
    ("counted", rf"^\s*(\d{{1,3}})\s+{_DESC}\s+{_MONEY}(?:\s+[A-Za-z])?\s*$", (0, 2, 0, 1, 0, 3, 0)),
    ("dated", rf"^\s*(?:\d{{2}}/\d{{2}}/\d{{4}}\s+)((?:[A-Za-z0-9\-]{{3,8}}|(?=[A-Za-z\-]*\d)[A-Za-z0-9\-]{{9,}})\s+)?{_DESC}\s+{_MONEY}\s*$", (1, 2, 0, 0, 0, 0, 3)),
]
FOOTER = r"(?i)\b(sub\s*total|grand\s*total|total|cgst|sgst|igst|round\s*off|amount in words|bank|ifsc|page \d|signature|terms)\b"


def text_items(docs: DataFrame) -> DataFrame:
    """(doc, text) -> lines that look like items: (doc, line, shape, code, description, hsn, qty, unit, rate, amount).

    Every line offers what each shape it has would read; documents then take
    their lines in order, of each line the first reading that repeats no line
    taken before (equal amount, and one description within the other or one code
    at the other's head), so a repeat falls through to the next shape. Digits
    read as letters are repaired in quantities. Where a count stands between two
    amounts, the one that times the count gives the other is the rate, else the
    lesser; a volume's rate is amount by quantity; a missing amount is quantity
    times rate, a missing rate the amount, a missing quantity 1. Glued digits
    count only if quantity times rate meets the amount within 5. Numbers come as
    texts with two decimals.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line", "s")).where(~F.col("s").rlike(FOOTER))
    names = ("code", "description", "hsn", "qty", "unit", "rate", "amount")
    kind = "decimal(18,2)"

    def number(c: Column) -> Column:
        return F.regexp_replace(c, "[, ]", "").try_cast(kind)

    def parsed(shape, pattern, groups):
        g = {n: F.nullif(F.trim(F.regexp_extract("s", pattern, g)), F.lit("")) if g else F.lit(None).cast("string") for n, g in zip(names, groups)}
        qty, n1, n2 = F.coalesce(F.regexp_replace(F.translate(g["qty"], "SsoOlI|", "5500111"), ",", "").try_cast(kind), F.lit(1).cast(kind)), number(g["rate"]), number(g["amount"])
        rate, amount, fits = F.coalesce(n1, n2), F.coalesce(n2, (qty * n1).cast(kind)), F.lit(True)
        if shape == "volume":
            rate = F.coalesce(F.try_divide(n2, qty).cast(kind), n2)
        if shape == "between":
            straight, crossed = F.abs(n1 * qty - n2) < 2, F.abs(n2 * qty - n1) < 2
            rate = F.when(straight, n1).when(crossed, n2).otherwise(F.least(n1, n2))
            amount = F.when(straight, n2).when(crossed, n1).otherwise(F.greatest(n1, n2))
        if shape == "glued":
            fits = F.abs(qty * n1 - n2) < 5
        return F.when(F.col("s").rlike(pattern) & fits, F.struct(F.lit(shape).alias("shape"), g["code"].alias("code"), g["description"].alias("description"), g["hsn"].alias("hsn"), qty.alias("qty"), g["unit"].alias("unit"), rate.alias("rate"), amount.alias("amount")))

    read = lines.select("doc", "line", F.array_compact(F.array(*[parsed(*s) for s in LINE_SHAPES])).alias("readings")).where(F.size("readings") > 0)
    taken_type = "array<struct<line:int,x:struct<shape:string,code:string,description:string,hsn:string,qty:decimal(18,2),unit:string,rate:decimal(18,2),amount:decimal(18,2)>>>"

    def repeats(x: Column, y: Column) -> Column:
        a, b = F.lower(F.trim(x["description"])), F.lower(F.trim(y["description"]))
        c, d = F.lower(F.coalesce(x["code"], F.lit(""))), F.lower(F.coalesce(y["code"], F.lit("")))
        return (x["amount"] == y["amount"]) & (a.contains(b) | b.contains(a) | ((c != "") & (d != "") & (c.startswith(d) | d.startswith(c))))

    def take(taken: Column, line: Column) -> Column:
        new = F.get(F.filter(line["readings"], lambda x: ~F.exists(taken, lambda y: F.coalesce(repeats(x, y["x"]), F.lit(False)))), F.lit(0))
        return F.when(new.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(line["line"].alias("line"), new.alias("x")))))

    every = read.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "readings"))).alias("lines"))
    found = every.select("doc", F.inline(F.aggregate("lines", F.array().cast(taken_type), take))).select("doc", "line", "x.*")
    return found.withColumns({c: F.col(c).cast("string") for c in ("qty", "rate", "amount")})


_DAY = r"(\d{1,2}[/\-.][A-Za-z0-9]{1,9}[/\-.]\d{2,4}|\d{4}-\d{2}-\d{2}|[A-Za-z]+\s+\d{1,2}[,\s]+\d{4}|\d{1,2}\s+[A-Za-z]+[,\s]+\d{4})"
_REF = r"\s*[:\-#.]*\s*([A-Za-z0-9][A-Za-z0-9/\-]{2,34})"
#: Header fields in running text: name, patterns of one group in order; the first that finds anything counts.
HEADER_PATTERNS = {
    "document_no": [rf"(?i)\b(?:invoice|quotation|quote|bill|po)\s*(?:no|number|#)\.?{_REF}", rf"(?i)\b(?:invoice|quotation|purchase\s*order|order|doc|guarantor\s*no|mrn)\s*(?:no|number|#)?\.?\s*[:#]\s*\[?\s*([A-Za-z0-9\-/]{{4,25}})"],
    "document_date": [rf"(?i)\b(?:date\s*of\s*issue|(?:invoice|quotation|statement|po|bill|issue)\s*date)\s*[:\-]?\s*{_DAY}", rf"(?i)(?<!due )(?<!validity )(?<!enquiry )\bdate\s*[:\-]?\s*{_DAY}"],
    "gstin": [r"\b(\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z0-9])\b"],
    "customer_gstin": [r"(?s)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z0-9]\b.*?\b(\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z0-9])\b"],
    "vendor_name": [r"(?i)\b(?:supplier|from)\s*:\s*([^\n]+)", r"(?im)^\W*([^\n]*\b(?:ltd|limited|scientific|chemicals|pharma|services?|logistics|diagnostic|stationery|enterprises)\b\.?)"],
    "customer_name": [r"(?i)\b(?:bill\s*to|buyer|customer(?:\s*name)?|client|patient(?:\s*name)?)\)?\s*[:\n]\s*([^\n]+)"],
    "customer_address": [r"(?i)\b(?:bill\s*to|buyer|customer(?:\s*name)?|client|patient(?:\s*name)?)\)?\s*[:\n]\s*[^\n]+\n\s*(?!gst|mob|email|date|invoice)([^\n:]+)"],
    "po_reference": [rf"(?i)\bP\.?O\.?\s*(?:no|ref|number)\.?{_REF}"],
    "enquiry_ref": [rf"(?i)\benq(?:uiry|\.)?\s*(?:ref|no)\.?{_REF}"],
    "enquiry_date": [rf"(?i)\benq(?:uiry|\.)?\s*date\s*[:\-]?\s*{_DAY}"],
    "due_date": [rf"(?i)\bdue\s*date\s*[:\-]?\s*{_DAY}"],
    "validity_date": [rf"(?i)\bvalid(?:ity)?\s*(?:date|till|until|upto)\s*[:\-]?\s*{_DAY}"],
    "validity": [r"(?i)validity\s*[:\-]?\s*([^\n]+)"],
    "payment_terms": [r"(?i)(?:payment\s*terms|terms\s*of\s*payment)\s*[:\-]?\s*([^\n]+)"],
    "currency": [r"(?i)(?:currency\s*:|please\s*pay)\s*([A-Z]{3})\b", r"\b(INR|USD|EUR|GBP|AED|BDT)\b"],
    "grand_total_words": [r"(?i)amount\s*in\s*words\s*:?\s*([^\n]+)"],
}
#: Words that stand where a document number would and are none.
NO_NUMBER = ["TAX", "FINAL", "PROFORMA", "NUMBER", "NO", "ACCOUNT", "DATE"]


def text_header(docs: DataFrame) -> DataFrame:
    """(doc, text) -> header fields found in the text; what is not found is null, a missing currency INR."""
    def found(patterns: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit("")) for p in patterns])

    out = docs.select("doc", *[found(p).alias(n) for n, p in HEADER_PATTERNS.items()])
    return out.withColumns({"document_no": F.when(~F.upper("document_no").isin(*NO_NUMBER), F.col("document_no")), "currency": F.coalesce(F.upper("currency"), F.lit("INR"))})


TOTALS = ["taxable", "cgst", "sgst", "final"]


def table_totals(grid: DataFrame) -> DataFrame:
    """Tables (doc, page, table, row_idx, cells) -> (doc, taxable, cgst, sgst, final) from rows that say Total.

    Pages are read from the last, so an earlier page's row overrides. Four
    numbers are taxable, both taxes and final; three are taxable, the whole tax
    (halved) and final; a lone number is the final where none is known yet.
    """
    kind = "decimal(18,2)"
    token = F.flatten(F.transform("cells", lambda c: F.split(F.coalesce(c, F.lit("")), r"\s+")))
    numbers = F.filter(F.transform(token, lambda t: F.when(F.regexp_replace(t, "INR|,", "").rlike(r"^-?\d+(\.\d*)?$"), F.regexp_replace(t, "INR|,", "").try_cast(kind))), lambda x: x.isNotNull())
    said = grid.where(F.array_join("cells", " ").contains("Total") & (F.coalesce(F.get("cells", F.lit(0)), F.lit("")) != ""))
    rows = said.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((-F.col("page")).alias("from_last"), "table", "row_idx", numbers.alias("n")))).alias("rows"))
    empty = F.struct(*[F.lit(0).cast(kind).alias(c) for c in TOTALS])
    half = lambda x: (x / 2).cast(kind)

    def step(at: Column, row: Column) -> Column:
        n, size = (lambda k: F.get(row["n"], F.lit(k))), F.size(row["n"])
        four = F.struct(*[n(k).alias(c) for k, c in enumerate(TOTALS)])
        three = F.struct(n(0).alias("taxable"), half(n(1)).alias("cgst"), half(n(1)).alias("sgst"), n(2).alias("final"))
        lone = F.struct(*[at[c].alias(c) for c in TOTALS[:3]], n(0).alias("final"))
        return F.when(size == 4, four).when(size == 3, three).when((size == 1) & (at["final"] == 0), lone).otherwise(at)

    return rows.select("doc", F.aggregate("rows", empty, step).alias("t")).select("doc", "t.*")


def text_totals(docs: DataFrame) -> DataFrame:
    """Totals in text: the last grand total wins, the first taxable value, the last of each tax; a whole tax is halved where its parts are not told."""
    money = r"[^\d\n]*([\d,]+\.\d{2})"
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line", "s"))
    val = lambda p: F.regexp_replace(F.nullif(F.regexp_extract("s", p + money, 1), F.lit("")), ",", "").try_cast("decimal(14,2)")
    v = lines.select("doc", "line", val(r"(?i)(?:grand\s*total|net\s*payable|net\s*total|final\s*amount|total\s*amount)").alias("final"), val(r"(?i)(?:taxable|sub\s*total)").alias("taxable"), val(r"(?i)\bcgst").alias("cgst"), val(r"(?i)\bsgst").alias("sgst"), val(r"(?i)(?:total\s*gst|gst\s*amount|total\s*tax\b)").alias("gst"))
    last = lambda t: F.max_by(t, F.when(F.col(t).isNotNull(), F.col("line")))
    found = v.groupBy("doc").agg(last("final").alias("final"), F.min_by("taxable", F.when(F.col("taxable").isNotNull(), F.col("line"))).alias("taxable"), *[last(t).alias(t) for t in ("cgst", "sgst", "gst")])
    return found.select("doc", "final", "taxable", *[F.coalesce(t, (F.col("gst") / 2).cast("decimal(14,2)")).alias(t) for t in ("cgst", "sgst")])


def words_in_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words whose centre lies inside a region (page, region, x0, y0, x1, y1); pages are the equi-key."""
    w = words.withColumns({"cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2})
    return w.join(regions, "page").where(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))).drop("cx", "cy", "x0", "y0", "x1", "y1")


def section_items(docs: DataFrame) -> DataFrame:
    """Item lines between a table head and its totals; the section flag is a running maximum over lines."""
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line", "s"))
    w = W.partitionBy("doc").orderBy("line")
    begun = F.max(F.col("s").rlike(r"(?i)\b(description|particulars)\b.*\b(qty|quantity|rate|amount)\b").cast("int")).over(w)
    ended = F.max((F.col("s").rlike(r"(?i)^\s*(sub\s*)?total\b")).cast("int")).over(w)
    inside = lines.withColumns({"b": begun, "e": ended}).where("b = 1 and e = 0")
    return text_items(inside.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("text")))
