"""Numbers as documents print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that a quantity cell may carry, and words of stamps and annotations.
UNITS = "nos no pcs pc l ltr ltrs litre litres kg kgs gm gms g ml mtr mtrs m box boxes set sets roll rolls bag bags sqft sqm rft unit units pair pairs can cans".split()
ANNOTATION = r"(?i)\b(above|items?|rcd|rcvd|received|inward|sign|date|time|sr\.?\s*no|serial|checked|verified|approved|authority|stamp|chq|ref|delivery)\b"
NULLISH = ("n/a", "none", "-")


def _cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def to_decimal(c: Column) -> Column:
    """null, blank, '-', 'n/a', 'none' and unparseable values are 0; commas and percent signs go."""
    s = F.trim(F.regexp_replace(c.cast("string"), "[,%]", ""))
    return F.coalesce(_cast(s, "decimal(38,8)"), F.lit(0).cast("decimal(38,8)"))


def to_decimal_cents(c: Column) -> Column:
    """Also strips currency symbols, and rounds half up to cents."""
    s = F.trim(F.regexp_replace(c.cast("string"), "[,₹$€]", ""))
    return F.coalesce(_cast(s, "decimal(38,8)").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def half_even(c: Column) -> Column:
    """Two places, half to even; null and unparseable are 0."""
    return F.coalesce(F.bround(_cast(F.trim(c.cast("string")), "decimal(30,10)"), 2).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def normalize_currency(c: Column) -> Column:
    """symbols and codes go, (x) is -x, separators between digits go; null-likes and failures are null."""
    s = F.trim(c)
    s = F.when(F.lower(s).isin(*NULLISH) | (s == ""), None).otherwise(s)
    s = F.regexp_replace(s, r"(?i)[$£€¥₹]|usd|eur|gbp|inr", "")
    inner = F.regexp_extract(s, r"^\s*\((.*)\)\s*$", 1)
    negative = s.rlike(r"^\s*\(.*\)\s*$")
    body = F.trim(F.regexp_replace(F.when(negative, inner).otherwise(s), r"(\d),(?=\d)", "$1"))
    return _cast(F.when(negative, F.concat(F.lit("-"), body)).otherwise(body), "decimal(20,4)")


def normalize_number(c: Column) -> Column:
    """thousands separators go; null-likes and failures are null."""
    s = F.trim(c)
    return _cast(F.regexp_replace(F.when(F.lower(s).isin(*NULLISH) | (s == ""), None).otherwise(s), ",", ""), "double")


def clean_numeric(c: Column) -> Column:
    """at the front all but digits, sign, point, comma and opening bracket goes, at the end all but digits, point, comma and percent; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^[^0-9.\-,(]+", ""), r"[^0-9.,%]+$", "")


def fraction_to_percent(c: Column) -> Column:
    """values strictly between 0 and 1 are fractions."""
    return F.when((c > 0) & (c < 1), c * 100).otherwise(c)


def halves(c: Column) -> Column:
    """a tax rate in two equal halves."""
    return (c * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(9,3)")


def is_decimal(c: Column) -> Column:
    """parses as a number and has a point."""
    return _cast(F.trim(c), "double").isNotNull() & c.contains(".")


def is_whole_quotient(a: Column, b: Column) -> Column:
    """a / b is an integer; null when b is 0."""
    return F.when(b != 0, a % F.when(b != 0, b) == 0)


def group_indian(c: Column) -> Column:
    """₹12,34,567.00 from a decimal with two places."""
    s = F.abs(c).cast("decimal(18,2)").cast("string")
    whole, cents = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
    tail = F.right(whole, F.lit(3))
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    grouped = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(head, r"\B(?=(\d{2})+(?!\d))", ","), F.lit(","), tail)).otherwise(whole)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), cents)


def split_qty_uom(c: Column) -> Column:
    """'10 L' -> (10.00, 'L'); a plain number has no unit; else the leading number and the rest; else (0, all)."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    number = _cast(raw, "decimal(30,10)")
    first, rest = F.regexp_extract(raw, r"^(\S+)\s+(.*)$", 1), F.regexp_extract(raw, r"^(\S+)\s+(.*)$", 2)
    first_n = _cast(F.regexp_replace(first, ",", ""), "decimal(30,10)")
    unit = F.lower(rest).isin(*UNITS) | rest.rlike(r"^\p{L}+$")
    lead = F.regexp_extract(raw, r"^([\d,]+\.?\d*)", 1)
    lead_n = _cast(F.regexp_replace(lead, ",", ""), "decimal(30,10)")
    qty = F.when(number.isNotNull(), number).when(unit & first_n.isNotNull(), first_n).when(lead_n.isNotNull(), lead_n).otherwise(F.lit(0))
    uom = F.when(number.isNotNull(), "").when(unit & first_n.isNotNull(), rest).when(lead_n.isNotNull(), F.trim(F.substring(raw, F.length(lead) + 1, F.length(raw)))).otherwise(raw)
    return F.struct(F.bround(qty.cast("decimal(30,10)"), 2).cast("decimal(18,2)").alias("qty"), uom.alias("uom"))


def split_merged_qty_total(c: Column, price: Column) -> Column:
    """F8: '6.00383.04' at 63.84 -> (6.00, 383.04).

    Each point but the last is tried in order as the quantity's; quantity times
    price must meet the total within 0.10, as printed or with one lost leading
    digit 1 to 9. Without a price the first plausible split is taken. Else (1,
    all). O and Q are read as 0.
    """
    raw = F.regexp_replace(F.regexp_replace(c, "[QqOo]", "0"), r"[^0-9.]", "")
    dots = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), lambda k: F.when(F.substring(raw, k, F.lit(1)) == ".", k)), lambda k: k.isNotNull())
    places = F.slice(dots, 1, F.greatest(F.size(dots) - 1, F.lit(0)))
    digits = F.sequence(F.lit(0), F.lit(9))
    kind = "decimal(18,2)"

    def tries(k: Column) -> Column:
        qty, total = F.substring(raw, F.lit(1), k + 2), F.substring(raw, k + 3, F.length(raw))
        return F.transform(digits, lambda d: F.struct(_cast(qty, kind).alias("qty"), _cast(F.when(d == 0, total).otherwise(F.concat(d.cast("string"), total)), kind).alias("total"), d.alias("lost"), (F.length(raw) >= k + 2).alias("long")))

    usable = F.filter(F.flatten(F.transform(places, tries)), lambda x: x["long"] & (x["qty"] > 0) & (x["total"] > 0) & F.when(price > 0, F.abs(F.bround(x["qty"] * price, 2) - x["total"]) <= F.lit("0.10").cast(kind)).otherwise((x["lost"] == 0) & (x["qty"] < 10000) & (x["total"] > x["qty"])))
    hit = F.try_element_at(usable, F.lit(1))
    return F.struct(F.coalesce(hit["qty"], F.lit("1.00").cast(kind)).alias("qty"), F.coalesce(hit["total"], _cast(raw, kind), F.lit(0).cast(kind)).alias("total"))


def is_annotation_row(description: Column, rate: Column, amount: Column) -> Column:
    """No money, and stamp words or fewer than four characters without a digit."""
    d = F.trim(F.coalesce(description, F.lit("")))
    return (half_even(rate) <= 0) & (half_even(amount) <= 0) & (d.rlike(ANNOTATION) | ((F.length(d) < 4) & ~d.rlike(r"\d")))
