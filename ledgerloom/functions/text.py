"""String repair and matching expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal replacements of misread words; words that names drop.
MISREAD = [("lnvoice", "Invoice"), ("|nvoice", "Invoice"), ("Tot a l", "Total"), ("Sub t otal", "Subtotal")]
COMPANY_WORDS = r"\b(pvt|ltd|private|limited|co|corp|inc)\b"
#: Unit repairs, in order: pattern, replacement.
UNIT_REPAIRS = [
    (r"\b[BS5](?:OO|0O|O0)\s*(ML|GM|G|L|ml|gm|g|l)\b", "500$1"),
    (r"\b1OO\s*(ML|GM|G|L|ml|gm|g|l|Gms|gms)\b", "100$1"),
    (r"(?i)^_[S5](?:OO|00)GM$", "500GM"),
]


def clean_text(c: Column) -> Column:
    """trim, blanks and tabs collapsed (line ends stay), unit repairs, literal replacements; null is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"[ \t]+", " ")
    out = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), UNIT_REPAIRS, out)
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), MISREAD, out)


def normalize_name(c: Column) -> Column:
    """lower case, company words out, only letters a-z and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), COMPANY_WORDS, ""), "[^a-z0-9]", "")


def normalize_key(c: Column) -> Column:
    """lower case, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, case-insensitive; two empty strings are alike."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / F.when(longest > 0, longest))


def ocr_digits(c: Column) -> Column:
    """letters that stand for digits."""
    return F.translate(c, "SsoOlI|", "5500111")


def clean_text_layer(c: Column) -> Column:
    """two ligatures that a text layer shows as glyph numbers."""
    return F.replace(F.replace(c, F.lit("(cid:415)"), F.lit("ti")), F.lit("(cid:425)"), F.lit("tt"))


def tokens(c: Column) -> Column:
    """lower-case words at white space; blank has none."""
    return F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda x: x != "")


def type_label(c: Column) -> Column:
    """the display name of a document type."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def highlight(c: Column, terms: list[str]) -> Column:
    """marks every occurrence of any term, longest first."""
    import re

    pattern = "|".join(re.escape(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    return F.regexp_replace(c, f"(?i)({pattern})", "<mark>$1</mark>") if pattern else c


#: Letters that a misread code has for digits: always, and only in codes of one of these lengths.
CODE_DIGITS, SHORT_CODE_DIGITS, SHORT_CODES, CODES = ("OoIl|", "00111"), ("ZzSsB", "22558"), (4, 5, 8), (4, 5, 6, 7, 8)


def item_code(code: Column, description: Column) -> Column:
    """(code, description).

    Without a code of two characters, the description's first word of 3 to 10
    is the code if it has a digit or one of the usual lengths, and leaves the
    description; a code named inside the description stays there. Codes of 4 to
    8 characters with a digit are upper-cased, their misread letters repaired.
    """
    given, desc = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    head = r"^([A-Za-z0-9\-/]{3,10})\s+[\-:]?\s*(.+)$"
    lead = F.regexp_extract(desc, head, 1)
    takes = (F.length(given) <= 1) & (lead != "") & (lead.rlike(r"\d") | F.length(lead).isin(4, 5, 6, 8))
    tagged = F.regexp_extract(desc, r"(?i)(?:CPT|Code|HSN|Part\s*#?|Cat\s*#?)\s*[:\-\s]\s*([A-Za-z0-9\-]{3,10})", 1)
    found = F.when(takes, lead).when(given != "", given).otherwise(tagged)
    size = F.length(found)
    repaired = F.translate(found, *CODE_DIGITS)
    repaired = F.upper(F.when(size.isin(*SHORT_CODES), F.translate(repaired, *SHORT_CODE_DIGITS)).otherwise(repaired))
    return F.struct(F.when(size.isin(*CODES) & found.rlike(r"\d"), repaired).otherwise(found).alias("code"), F.when(takes, F.trim(F.regexp_extract(desc, head, 2))).otherwise(desc).alias("description"))


def json_in_text(c: Column) -> Column:
    """the outermost braces of a reply, code fences and surrounding talk removed; null if none."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


#: Names under which a reply may list its lines, in order; the fourth only beside a flat header.
LINE_KEYS = ["line_items", "items", "products", "table_items", "lines"]


def reply(c: Column) -> Column:
    """(header, line_items) of a language model's reply; null if it holds no JSON object with lines.

    The reply without code fences is read as JSON, else its outermost braces; of
    a list the first object counts. The header stands under `header` beside the
    lines, or is all that stands beside them. Header values and the values of
    lines are texts; lines that are no list are none.
    """
    body = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    whole = F.try_parse_json(body)
    value = F.coalesce(whole, F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))
    first = F.coalesce(F.try_variant_get(value, "$[0]", "variant"), value)
    object_ = F.try_variant_get(first, "$", "map<string,variant>")
    keys = F.array(*[F.lit(k) for k in LINE_KEYS])
    present = F.filter(keys, lambda k: F.map_contains_key(object_, k))
    nested = F.map_contains_key(object_, F.lit("header")) & (F.size(F.array_remove(present, "table_items")) > 0)
    key = F.get(F.when(nested, F.array_remove(present, "table_items")).otherwise(present), F.lit(0))
    texts = lambda v: F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.try_variant_get(x, "$", "string"))
    flat = F.transform_values(F.map_filter(object_, lambda k, _: k != key), lambda _, x: F.try_variant_get(x, "$", "string"))
    none = F.create_map().cast("map<string,string>")
    header = F.coalesce(F.when(nested, texts(F.try_element_at(object_, F.lit("header")))).otherwise(flat), none)
    lines = F.transform(F.try_variant_get(F.try_element_at(object_, key), "$", "array<variant>"), texts)
    return F.when(F.size(present) > 0, F.struct(header.alias("header"), F.coalesce(lines, F.array().cast("array<map<string,string>>")).alias("line_items")))


def image_text(content: Column) -> Column:
    """an image's bytes as base64 text."""
    return F.base64(content)


def nested_as_json(df, columns: list[str] | None = None):
    """arrays, maps and structs as JSON text, all other columns as they are."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.to_json(c) for c in columns or df.columns if kinds[c].startswith(("array", "map", "struct"))})


def escape_regex(text: str) -> str:
    """A literal for both Java's and RE2's syntax."""
    import re

    return re.sub(r"([.^$*+?()\[\]{}|\\\-])", r"\\\1", text)


# Misspelt item names and their canonical form, first match wins.
TYPOS = [(r"(?i)beak[ae]r", "Beaker"), (r"(?i)pip+et+e?", "Pipette"), (r"(?i)flas?ck", "Flask"), (r"(?i)filt[ea]r\s*pap[ea]r", "Filter Paper")]


def canonical_item(c: Column) -> Column:
    """an ordered dictionary of misspellings; unknown names stay."""
    out = None
    for pattern, name in TYPOS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(c)
