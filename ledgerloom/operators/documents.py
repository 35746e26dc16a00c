"""Listing, detail, review queue, search and suggestion over documents and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_regex, tokens

#: Prefixes of a scoped search and the column each one means (d: document side, i: item side).
PREFIXES = {
    "vendor": ("d", "vendor_name"), "v": ("d", "vendor_name"), "customer": ("d", "customer_name"), "c": ("d", "customer_name"),
    "doc": ("d", "document_no"), "no": ("d", "document_no"), "type": ("d", "type_text"), "t": ("d", "type_text"),
    "brand": ("i", "brand"), "b": ("i", "brand"), "code": ("i", "item_code"), "hsn": ("i", "hsn_code"), "desc": ("i", "description"), "d": ("i", "description"),
}
TYPE_FAMILIES = {"invoice": ["invoice", "invoice_final", "invoice_proforma"], "statement": ["patient_account_statement"], "quote": ["quotation"], "po": ["purchase_order"]}


def named(docs: DataFrame, vendors: DataFrame, customers: DataFrame) -> DataFrame:
    """Documents with vendor_name and customer_name; the optimizer broadcasts dimensions that are small enough."""
    v = vendors.select(F.col("id").alias("__v"), F.col("name").alias("vendor_name"))
    c = customers.select(F.col("id").alias("__c"), F.col("name").alias("customer_name"))
    return docs.join(v, F.col("vendor_id") == F.col("__v"), "left").join(c, F.col("customer_id") == F.col("__c"), "left").drop("__v", "__c")


def equal_filters(docs: DataFrame, **values) -> DataFrame:
    """Equality on columns, and start_date / end_date inclusive; None, '' and 'all' filter nothing."""
    for name, value in values.items():
        if value in (None, "", "all"):
            continue
        if name == "start_date":
            docs = docs.where(F.col("document_date") >= F.lit(value).cast("date"))
        elif name == "end_date":
            docs = docs.where(F.col("document_date") <= F.lit(value).cast("date"))
        else:
            docs = docs.where(F.col(name) == F.lit(value))
    return docs


def equal_ignoring_case(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """P5: rows whose column equals the value in whatever case; None, '' and 'all' filter nothing."""
    return df if value in (None, "", "all") else df.where(F.lower(column) == value.lower())


def by_file_name(docs: DataFrame, part: str, column: str = "source_file") -> DataFrame:
    """Documents whose file name contains a text, in whatever case; % and _ mean themselves."""
    return docs.where(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(part.lower())) if part else docs


def with_default_date(docs: DataFrame, default: str, column: str = "document_date") -> DataFrame:
    """F16: a missing date takes the default; `shown` is the date in ISO form."""
    filled = docs.withColumn(column, F.coalesce(F.col(column), F.lit(default).cast("date")))
    return filled.withColumn("shown", F.date_format(column, "yyyy-MM-dd"))


def sharing_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (id, words) of both sides that have a word in common: left_id, right_id, once per pair; words meet in an equi-join."""
    l = left.select(F.col("id").alias("left_id"), F.explode(F.array_distinct("words")).alias("w"))
    r = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct("words")).alias("w"))
    return l.join(r, "w").select("left_id", "right_id").distinct()


def type_family(c: Column, family: str) -> Column:
    """A family of types, by list or by containment; other values match by containment."""
    family = family.lower()
    if family in TYPE_FAMILIES:
        cond = c.isin(*TYPE_FAMILIES[family])
        return cond | c.ilike(f"%{family}%") if family == "invoice" else cond
    return c.ilike(f"%{family.replace(' ', '%')}%")


def pattern(term: str, escape: bool = False) -> str:
    """A containment pattern; the user's % and _ act as wildcards unless escaped."""
    if escape:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{term}%"


def any_like(columns: list[str], term: str, escape: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(pattern(term, escape)) for c in columns])


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """O1: one page, and a frame of the total (one row, `total`); nothing runs before either is read."""
    return df.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit), df.agg(F.count("*").alias("total"))


def split_prefix(query: str) -> tuple[str | None, str]:
    """P8: 'vendor: acme' -> ('vendor', 'acme'); an unknown prefix is dropped and its term searched everywhere."""
    head, colon, term = query.partition(":")
    head = head.strip().lower()
    if not colon:
        return None, query.strip()
    return (head if head in PREFIXES else None), term.strip()


def list_documents(docs: DataFrame, items: DataFrame, query: str = "", **filters) -> DataFrame:
    """Documents (with names) that match a scoped or free query, and equality filters.

    A free query looks at five document columns, the type's display name and,
    through an existence join, at the lines.
    """
    docs = equal_filters(docs, **filters).withColumn("type_text", F.replace("document_type", F.lit("_"), F.lit(" ")))
    prefix, term = split_prefix(query)
    if term:
        if prefix and PREFIXES[prefix][0] == "i":
            hit = items.where(any_like([PREFIXES[prefix][1]], term)).select(F.col("document_id").alias("__d"))
            docs = docs.join(hit, F.col("id") == F.col("__d"), "left_semi")
        elif prefix:
            docs = docs.where(any_like([PREFIXES[prefix][1]], term))
        else:
            hit = items.where(any_like(["description", "item_code", "brand", "hsn_code"], term)).select(F.col("document_id").alias("__d")).distinct()
            docs = docs.join(hit, F.col("id") == F.col("__d"), "left")
            docs = docs.where(any_like(["document_no", "vendor_name", "customer_name", "source_file", "document_type", "type_text"], term) | F.col("__d").isNotNull()).drop("__d")
    return docs.drop("type_text")


def detail(docs: DataFrame, items: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Documents with their lines as an ordered array."""
    if ids is not None:
        docs, items = docs.where(F.col("id").isin(*ids)), items.where(F.col("document_id").isin(*ids))
    lines = items.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "item_code", "description", "qty"))).alias("line_items"))
    return docs.join(lines, F.col("id") == F.col("document_id"), "left").drop("document_id").withColumn("line_items", F.coalesce("line_items", F.array().cast(lines.schema["line_items"].dataType)))


def review_queue(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Flagged lines with their document."""
    return items.where("needs_review").join(docs.select(F.col("id").alias("__d"), "document_no", "document_type"), F.col("document_id") == F.col("__d")).drop("__d")


def search_documents(docs: DataFrame, items: DataFrame, query: str, limit: int | None = 50, **filters) -> DataFrame:
    """Distinct documents that match white-space-normalised text, tokens in order, or amounts as text; newest first."""
    q = " ".join(query.split())
    fuzzy = "(?i)" + r"[\s\r\n\-_]+".join(escape_regex(t) for t in q.split())

    def flat(c: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ").ilike(pattern(q))

    docs = equal_filters(docs, **filters)
    own = reduce(lambda a, b: a | b, [flat(c) for c in ("document_no", "document_type", "vendor_name", "customer_name", "source_file", "grand_total_final")])
    line = reduce(lambda a, b: a | b, [flat(c) for c in ("description", "item_code", "hsn_code", "brand", "packing")]) | F.coalesce(F.col("description"), F.lit("")).rlike(fuzzy)
    hit = items.where(line).select(F.col("document_id").alias("__d")).distinct()
    out = docs.join(hit, F.col("id") == F.col("__d"), "left").where(own | F.coalesce(F.col("document_no"), F.lit("")).rlike(fuzzy) | F.col("__d").isNotNull()).drop("__d")
    out = out.orderBy(F.col("document_date").desc_nulls_first(), F.col("id").desc())
    return out.limit(limit) if limit else out


def search_items(docs: DataFrame, items: DataFrame, query: str, limit: int | None = 100) -> DataFrame:
    """Lines whose text or numbers contain the query."""
    cols = ["description", "item_code", "hsn_code", "brand", "packing", "line_no"]
    out = items.where(any_like(cols, " ".join(query.split()))).join(docs.select(F.col("id").alias("__d"), "document_no"), F.col("document_id") == F.col("__d")).drop("__d")
    out = out.orderBy(F.col("document_id").desc(), F.col("line_no").asc_nulls_last(), "item_code")
    return out.limit(limit) if limit else out


def alias_search(docs: DataFrame, items: DataFrame, expanded: list[list[str]]) -> DataFrame:
    """Every token must match, by any alternative, in any of the document's or its lines' columns.

    Lines are read once: each line tells which tokens it meets, and documents
    gather those; no join per token.
    """
    d_cols, i_cols = ["document_no", "source_file", "vendor_name", "customer_name"], ["description", "item_code", "brand", "hsn_code"]

    def meets(cols: list[str], alternatives: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [any_like(cols, x) for x in alternatives])

    found = items.groupBy("document_id").agg(*[F.bool_or(meets(i_cols, alt)).alias(f"__t{k}") for k, alt in enumerate(expanded)]) if expanded else None
    if found is None:
        return docs
    out = docs.join(found, F.col("id") == F.col("document_id"), "left")
    for k, alt in enumerate(expanded):
        out = out.where(meets(d_cols, alt) | F.coalesce(F.col(f"__t{k}"), F.lit(False)))
    return out.select(*docs.columns)


def in_document(items: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Lines where one column contains the phrase or all of its tokens."""
    phrase = " ".join(query.lower().split())
    cols = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    words = tokens(F.lit(phrase))
    return items.where(F.exists(cols, lambda c: c.contains(F.lit(phrase)) | F.forall(words, lambda w: c.contains(w))))


def value_frequencies(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How often each value occurs, for several fields; blank values do not count.

    Fields of one DataFrame are read in one pass: its rows are stacked to (field,
    value) and all are counted in one aggregation, which reduces them where they lie.
    """
    tables: dict[int, tuple[DataFrame, list]] = {}
    for field, (df, col) in sources.items():
        tables.setdefault(id(df), (df, []))[1].append(F.struct(F.lit(field).alias("field"), F.col(col).cast("string").alias("value")))
    stacked = [df.select(F.inline(F.array(*pairs))) for df, pairs in tables.values()]
    rows = reduce(lambda a, b: a.unionByName(b), stacked).where(F.coalesce(F.col("value"), F.lit("")) != "")
    return rows.groupBy("field", "value").agg(F.count("*").alias("freq"))


#: Prefixes of a scoped suggestion and the field each one means.
GHOST_PREFIXES = {
    "vendor": "vendor", "v": "vendor", "customer": "customer", "c": "customer", "brand": "brand", "b": "brand", "code": "code", "item_code": "code", "item": "code",
    "hsn": "hsn", "hsn_code": "hsn", "doc": "doc", "document_no": "doc", "number": "doc", "type": "type", "document_type": "type", "desc": "desc", "description": "desc",
}


def _best(freqs: DataFrame, low: str) -> DataFrame:
    hits = freqs.where(F.lower("value").contains(low))
    return hits.orderBy(F.lower("value").startswith(low).desc(), F.col("freq").desc(), F.length("value"), "value", "field").limit(1)


def ghost_suggestion(freqs: DataFrame, text: str) -> DataFrame:
    """The best completion: prefix matches first, then frequent, short, and by name."""
    return _best(freqs, text.lower())


def scoped_suggestion(freqs: DataFrame, text: str) -> DataFrame:
    """for `prefix:term` the best completion of the term in the prefix's field as `prefix:value`, else that of the whole text in any field.

    One row at most: suggestion, value, prefix (null for a free one). An unknown
    prefix or an empty term is searched as it stands.
    """
    head, colon, term = text.partition(":")
    field, term = GHOST_PREFIXES.get(head.strip().lower()), term.strip().lower()
    free = _best(freqs, text.lower()).select(F.lit(1).alias("place"), F.col("value").alias("suggestion"), "value", F.lit(None).cast("string").alias("prefix"))
    if not (colon and field and term):
        return free.drop("place")
    own = _best(freqs.where(F.col("field") == field), term).select(F.lit(0).alias("place"), F.concat(F.lit(f"{field}:"), "value").alias("suggestion"), "value", F.lit(f"{field}:").alias("prefix"))
    return own.unionByName(free).orderBy("place").limit(1).drop("place")


def without_summary_rows(items: DataFrame) -> DataFrame:
    """Rows that state totals are no lines."""
    total = F.lower(F.trim("description")).rlike(r"^(sub\s*)?total\b|^grand\s*total|^amount in words|^net payable|^(c|s|i)gst\b")
    generic = F.coalesce(F.col("item_code"), F.lit("")).rlike(r"^(ITEM-\d+)?$")
    return items.where(~(F.coalesce(total, F.lit(False)) & generic))


def informative_columns(df: DataFrame) -> list[str]:
    """Columns that hold any value besides null, blank, '-' and zero. One aggregate row."""
    def told(c: str) -> Column:
        s = F.trim(F.col(c).cast("string"))
        return F.coalesce(F.bool_or(~s.isin("", "-", "0") & ~s.rlike(r"^0*\.?0+$")), F.lit(False)).alias(c)

    row = df.agg(*[told(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]
