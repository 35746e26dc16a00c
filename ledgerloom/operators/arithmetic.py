"""Row arithmetic: fills in a fixed order, then flags. Four rule sets, never blended.

All work in decimal(20,8): sums and products of the model's amounts are exact
there, so no step rounds unless its rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AMOUNTS

DEC = "decimal(20,8)"


def _d(c: Column) -> Column:
    return c.cast(DEC)


def _set(df: DataFrame, name: str, when: Column, value: Column) -> DataFrame:
    return df.withColumn(name, F.when(when, _d(value)).otherwise(F.col(name)))


def _pct(amount: str, pct: str) -> Column:
    return F.col(amount) * F.col(pct) * F.lit("0.01").cast("decimal(3,2)")


def typed(df: DataFrame) -> DataFrame:
    """Amount columns as decimals; null and unparseable values are zero."""
    from ..functions.numeric import to_decimal

    return df.withColumns({c: _d(F.coalesce(F.col(c), F.lit(0))) if dict(df.dtypes)[c].startswith("decimal") else _d(to_decimal(F.col(c))) for c in AMOUNTS if c in df.columns})


def fill_line(df: DataFrame) -> DataFrame:
    """Eight ordered fills; each sees the ones before it."""
    c = F.col
    df = _set(typed(df), "qty", c("qty") == 0, F.lit(1))
    df = _set(df, "gross_amount", (c("rate") > 0) & (c("gross_amount") == 0), c("rate") * c("qty"))
    df = _set(df, "rate", (c("gross_amount") > 0) & (c("rate") == 0), F.try_divide("gross_amount", "qty"))
    df = _set(df, "discount_amount", (c("discount_pct") > 0) & (c("discount_amount") == 0), _pct("gross_amount", "discount_pct"))
    df = _set(df, "taxable_amount", (c("gross_amount") > 0) & (c("taxable_amount") == 0), c("gross_amount") - c("discount_amount"))
    df = _set(df, "taxable_amount", (c("taxable_amount") == 0) & (c("final_value") > 0), c("final_value"))
    for t in ("cgst", "sgst"):
        df = _set(df, f"{t}_amount", (c(f"{t}_pct") > 0) & (c(f"{t}_amount") == 0), _pct("taxable_amount", f"{t}_pct"))
    df = _set(df, "final_value", (c("final_value") == 0) & (c("taxable_amount") > 0), c("taxable_amount") + c("cgst_amount") + c("sgst_amount"))
    late = (c("final_value") > 0) & (c("gross_amount") == 0)
    return df.withColumns({"gross_amount": F.when(late, c("final_value")).otherwise(c("gross_amount")), "rate": F.when(late, _d(F.try_divide("final_value", "qty"))).otherwise(c("rate"))})


def flag_line(df: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """A11's two checks: needs_review and review_reason (joined by '; ', null if none)."""
    tol = F.lit(tolerance).cast(DEC)
    gross = F.abs(F.col("gross_amount") - F.col("rate") * F.col("qty")) > tol
    final = F.abs(F.col("final_value") - (F.col("taxable_amount") + F.col("cgst_amount") + F.col("sgst_amount"))) > tol
    reasons = F.concat_ws("; ", F.when(gross, "Gross Amount mismatch"), F.when(final, "Final Value mismatch"))
    # A generator of one row: a filter on its output stays above the fills, where pushing it down would repeat their whole chain.
    found = F.inline(F.array(F.struct((gross | final).alias("needs_review"), F.when(gross | final, reasons).alias("review_reason"))))
    return df.drop("needs_review", "review_reason").select("*", found)


def validate_line(df: DataFrame, tolerance: str = "0.05") -> DataFrame:
    return flag_line(fill_line(df), tolerance)


def flag_edited_line(df: DataFrame) -> DataFrame:
    """A11b, the edit rules: no fills, six checks, lines without qty or rate are skipped.

    Gross may differ by 5 % of the expected value or 5.0, whichever is more, and
    is tested only when positive; the others by 0.02.
    """
    c, tol = F.col, F.lit("0.02").cast(DEC)
    df = typed(df)
    expected = c("rate") * c("qty")
    checks = {
        "Gross Amount mismatch": (c("gross_amount") > 0) & (F.abs(c("gross_amount") - expected) > F.greatest(expected * F.lit("0.05").cast("decimal(3,2)"), F.lit(5).cast(DEC))),
        "Discount Amount mismatch": F.abs(c("discount_amount") - _pct("gross_amount", "discount_pct")) > tol,
        "Taxable Amount mismatch": F.abs(c("taxable_amount") - (c("gross_amount") - c("discount_amount"))) > tol,
        "CGST Amount mismatch": F.abs(c("cgst_amount") - _pct("taxable_amount", "cgst_pct")) > tol,
        "SGST Amount mismatch": F.abs(c("sgst_amount") - _pct("taxable_amount", "sgst_pct")) > tol,
        "Final Value mismatch": F.abs(c("final_value") - (c("taxable_amount") + c("cgst_amount") + c("sgst_amount"))) > tol,
    }
    real = (c("qty") != 0) & (c("rate") != 0)
    reasons = F.concat_ws("; ", *[F.when(cond, name) for name, cond in checks.items()])
    return df.withColumns({"needs_review": real & (reasons != ""), "review_reason": F.when(real & (reasons != ""), reasons)})


def validate_line_rounded(df: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """A11c, the standalone rules: every step rounded half up to cents, only the final is checked."""
    c = F.col

    def cents(x: Column) -> Column:
        return x.cast("decimal(18,2)").cast(DEC)

    df = typed(df).withColumns({n: cents(c(n)) for n in AMOUNTS})
    for name, value in (
        ("gross_amount", c("qty") * c("rate")),
        ("discount_amount", _pct("gross_amount", "discount_pct")),
        ("taxable_amount", c("gross_amount") - c("discount_amount")),
        ("cgst_amount", _pct("taxable_amount", "cgst_pct")),
        ("sgst_amount", _pct("taxable_amount", "sgst_pct")),
        ("final_value", c("taxable_amount") + c("cgst_amount") + c("sgst_amount")),
    ):
        df = _set(df, name, (c(name) == 0) & (cents(value) > 0), cents(value))
    off = F.abs(c("final_value") - cents(c("taxable_amount") + c("cgst_amount") + c("sgst_amount"))) > F.lit(tolerance).cast(DEC)
    return df.withColumns({"needs_review": off, "review_reason": F.when(off, "Final value mismatch")})


def repair_extracted(df: DataFrame) -> DataFrame:
    """A11d: lines as a language model returns them (description, qty, rate, amount, uom, cgst_pct, ..., raw_qty_total) -> typed lines.

    Annotation rows go; a unit inside qty is split off; swapped columns, a
    leading count in the description, a merged quantity-total token and a whole
    amount / rate quotient are repaired, in this order.
    """
    from ..functions import numeric as N

    c = F.col
    two = "decimal(18,2)"
    df = df.where(~N.is_annotation_row(c("description"), c("rate"), c("amount")))
    parts = N.split_qty_uom(c("qty").cast("string"))
    textual = c("qty").cast("string").isNotNull() & ~F.regexp_replace(c("qty").cast("string"), "[.,]", "").rlike(r"^\d+$") & (parts["uom"] != "") & (F.coalesce(c("uom"), F.lit("")) == "")
    df = df.withColumns({"raw_qty": c("qty").cast("string"), "raw_amount": c("amount").cast("string"), "uom": F.when(textual, parts["uom"]).otherwise(c("uom")), "qty": F.when(textual, parts["qty"]).otherwise(N.half_even(c("qty"))), "rate": N.half_even(c("rate")), "amount": N.half_even(c("amount"))})
    plain = F.coalesce(c("raw_qty_total"), F.lit("")) == ""
    swap = plain & (c("rate") > c("amount")) & (c("amount") > 0) & (c("qty") > 0) & (F.abs(c("qty") * c("amount") - c("rate")) <= F.lit("0.50").cast(two))
    df = df.withColumns({"rate": F.when(swap, c("amount")).otherwise(c("rate")), "amount": F.when(swap, c("rate")).otherwise(c("amount"))})
    swap = plain & (c("qty") > c("amount")) & (c("amount") > 0) & (c("qty") > 100)
    df = df.withColumns({"qty": F.when(swap, c("amount")).otherwise(c("qty")), "amount": F.when(swap, c("qty")).otherwise(c("amount"))})
    df = df.withColumn("description", F.trim(F.coalesce("description", F.lit(""))))
    count = F.regexp_extract("description", r"^(\d{1,12})\s+(.+)$", 1)
    rest = F.regexp_extract("description", r"^(\d{1,12})\s+(.+)$", 2)
    n = F.expr("try_cast(nullif(regexp_extract(description, '^(\\\\d{1,12})\\\\s+(.+)$', 1), '') as decimal(18,2))")
    lead = n.isNotNull() & (count != "") & F.when((c("rate") > 0) & (c("amount") > 0), F.abs(n * c("rate") - c("amount")) <= F.lit("0.05").cast(two)).otherwise((c("rate") > 0) & (c("qty") <= 0))
    df = df.withColumns({"qty": F.when(lead, n).otherwise(c("qty")).cast(two), "description": F.when(lead, rest).otherwise(c("description"))})
    both = (c("qty") > 0) & (c("rate") > 0)
    expected = F.bround(c("qty") * c("rate"), 2).cast(two)
    off = both & (c("amount") != 0) & (F.abs(expected - c("amount")) > F.lit("0.05").cast(two))
    glued = F.when(c("raw_qty").contains(".") & (F.size(F.split("raw_amount", r"\.")) == 2), F.concat("raw_qty", F.lit("."), F.element_at(F.split("raw_amount", r"\."), 2)))
    token = F.coalesce(F.when(~plain & c("raw_qty_total").rlike(r"\..*\."), c("raw_qty_total")), F.when(glued.rlike(r"\..*\."), glued))
    split = N.split_merged_qty_total(token, c("rate"))
    fits = off & token.isNotNull() & (split["qty"] > 0) & (split["total"] > 0) & (F.abs(F.bround(split["qty"] * c("rate"), 2) - split["total"]) <= F.lit("0.10").cast(two))
    df = df.withColumns({"__off": off, "__empty": both & (c("amount") == 0), "__expected": expected, "qty": F.when(fits, split["qty"]).otherwise(c("qty")).cast(two), "amount": F.when(fits, split["total"]).otherwise(c("amount")).cast(two)})
    again = F.bround(c("qty") * c("rate"), 2).cast(two)
    still = c("__off") & (F.abs(again - c("amount")) > F.lit("0.05").cast(two))
    whole = F.when(c("rate") > 0, c("amount") % F.when(c("rate") > 0, c("rate"))) == 0
    div_qty, div_rate = F.bround(F.try_divide("amount", "rate"), 2), F.bround(F.try_divide("amount", "qty"), 2)
    df = df.withColumns(
        {
            "qty": F.when(still & whole, div_qty).when((c("amount") > 0) & (c("rate") > 0) & (c("qty") == 0), div_qty).otherwise(c("qty")).cast(two),
            "amount": F.when(c("__empty"), c("__expected")).when(still & ~whole, again).otherwise(c("amount")).cast(two),
            "rate": F.when((c("amount") > 0) & (c("qty") > 0) & (c("rate") == 0), div_rate).otherwise(c("rate")).cast(two),
        }
    ).drop("__off", "__empty", "__expected")
    for t in ("cgst", "sgst"):
        df = df.withColumn(f"{t}_pct", N.half_even(c(f"{t}_pct")) if f"{t}_pct" in df.columns else F.lit(0).cast(two))
        df = df.withColumn(f"{t}_amount", F.when(c(f"{t}_pct") > 0, F.bround(_pct("amount", f"{t}_pct"), 2)).otherwise(F.lit(0)).cast(two))
    for n_ in ("discount_pct", "discount_amount"):
        df = df.withColumn(n_, N.half_even(c(n_)) if n_ in df.columns else F.lit(0).cast(two))
    from_pct = (c("discount_amount") == 0) & (c("discount_pct") > 0)
    from_amount = (c("discount_pct") == 0) & (c("discount_amount") > 0) & (c("amount") > 0)
    df = df.withColumns({"discount_amount": F.when(from_pct, F.bround(_pct("amount", "discount_pct"), 2)).otherwise(c("discount_amount")).cast(two), "discount_pct": F.when(from_amount, F.bround(F.try_divide(c("discount_amount") * 100, c("amount")), 2)).otherwise(c("discount_pct")).cast(two)})
    df = df.withColumn("taxable_amount", F.when(c("amount") >= c("discount_amount"), c("amount") - c("discount_amount")).otherwise(c("amount")).cast(two))
    return df.withColumns({"final_value": (c("taxable_amount") + c("cgst_amount") + c("sgst_amount")).cast(two), "qty": F.when(c("qty") > 0, c("qty")).otherwise(F.lit(1)).cast(two), "uom": F.coalesce(F.when(c("uom") != "", c("uom")), F.lit("Nos")), "gross_amount": c("amount")}).drop("amount", "raw_qty", "raw_amount")
