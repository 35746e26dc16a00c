"""URL filtering (operator 6, DataFrame functions only): given rules first, mined rules for what they leave open.

Given rules are (host, path, verdict): a rule fits its host and all subdomains
when the url's path starts with the rule's; the longest fitting rule wins.
Every url offers its host's suffixes, which equi-join with rule hosts.

For other urls, Spark's FP-growth mines token combinations of labelled urls;
combinations that imply the label `block` with enough confidence, support and
lift, and no smaller combination already kept among their subsets, become
rules. They are matched by an inverted index: url tokens join rule tokens, and
a rule fits when as many tokens met as it has. The labels are those that the
given rules put on the urls they fit (`rule_labels`), or any table of labelled
urls. Urls without a label count as not blocked: they are most of what a
combination is tried on, and one that only the labelled urls have in common
with many others (`h:com`, where the given rules speak of a few hosts) must not
become a rule. A part is held out to measure what the mined rules are worth.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, rejoin

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Share of labelled urls that hold a combination, confidence and lift it must reach.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.9, 1.2
#: Different urls used for mining at most (a hash of the url decides), and one in HELD_OUT of all that is kept from mining.
MAX_LABELLED, HELD_OUT = 200_000, 5
#: Rows of rules up to which they are broadcast.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct words of the host (h:) and of the path's segments (p:); numbers are left out."""
    h = F.transform(F.regexp_extract_all(host, F.lit(r"([^.\-_:]+)"), 1), lambda x: F.concat(F.lit("h:"), x))
    p = F.transform(F.regexp_extract_all(ascii_lower(path), F.lit(r"([^/.\-_]+)"), 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(h, p), lambda x: ~x.rlike(r"^.:\d*$")))


def _few(rows: DataFrame, n: int) -> DataFrame:
    """`rows` to be broadcast if they are few enough, else left to the planner."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _parsed(rows: DataFrame) -> DataFrame:
    """Different urls of rows with a column url, with host and path."""
    return rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def _given(parsed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(url, host, path) -> (url, best: size, rule, verdict) of urls that a given rule fits."""
    table = parsed.sparkSession.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, verdict string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = parsed.select("url", "path", F.explode(suffixes).alias("rule_host")).join(_few(table, len(rules)), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    return fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))


def rule_labels(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Different urls of `pages`, labelled with the verdict of the given rule that fits, null where none does: (url, label, held_out).

    A hash of the url holds out one in HELD_OUT; null urls are left out.
    """
    parsed = _parsed(pages.where("url is not null"))
    found = parsed.select("url").join(_given(parsed, rules), "url", "left")
    return found.select("url", F.col("best.verdict").alias("label"), (F.pmod(F.xxhash64(F.lit(60), "url"), F.lit(HELD_OUT)) == 0).alias("held_out"))


def mine(labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Urls (url, label) -> rules (rule_id, token, size, confidence, support): one row per rule and token.

    A null label counts as not blocked; rows with a null url are ignored,
    repeated rows count once. Where all labels are alike, or there are none,
    there are no rules; of equally confident rules all stay.
    """
    rows = labels.where("url is not null").select("url", F.coalesce("label", F.lit("open")).alias("label")).distinct()
    n = rows.count()
    if n > MAX_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(6), "url"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    baskets = rows.select(F.array_append(tokens(host_of(F.col("url")), path_of(F.col("url"))), F.concat(F.lit("y:"), "label")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = found.where((F.col("consequent")[0] == "y:block") & (F.col("lift") >= min_lift) & ~F.exists("antecedent", lambda x: x.startswith("y:")))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "mined")
    small = rules.select(F.col("items").alias("sub"), F.explode("items").alias("t"), F.size("items").alias("k"))
    wide = rules.select("items", F.explode("items").alias("t"))
    covered = wide.join(small, "t").where(F.col("k") < F.size("items")).groupBy("items", "sub", "k").count().where("count = k").select("items").distinct()
    kept = rules.join(covered, "items", "left_anti")
    return kept.select(F.array_join("items", "+").alias("rule_id"), F.explode("items").alias("token"), F.size("items").alias("size"), "confidence", "support")


def _mined(parsed: DataFrame, mined: DataFrame) -> DataFrame:
    """(url, host, path) and written mined rules -> (url, rule_id, confidence), a row per rule that fits, by the inverted index."""
    index = parsed.select("url", F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(_few(mined, mined.count()), "token")
    return index.groupBy("url", "rule_id", "size", "confidence").agg(F.count("*").alias("n")).where("n = size").select("url", "rule_id", "confidence")


def worth(labels: DataFrame, mined: DataFrame) -> DataFrame:
    """Held-out urls (url, label; null is not blocked) and mined rules -> per rule its support and confidence there: rule_id, support, confidence, n_urls.

    Repeated rows count once; rules that fit no url are left out, an empty table gives no rows.
    """
    held = materialize(labels.where("url is not null").select("url", F.coalesce("label", F.lit("open")).alias("label")).distinct(), "held-out")
    n = max(1, held.count())
    fits = _mined(_parsed(held), materialize(mined, "rules")).withColumnRenamed("url", "__url").join(held, F.col("__url") == F.col("url"))
    right = F.sum((F.col("label") == "block").cast("long"))
    return fits.groupBy("rule_id").agg((right / n).alias("support"), (right / F.count("*")).alias("confidence"), F.count("*").alias("n_urls"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, mined: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, mined_rule, confidence.

    mined: rules of `mine`, none if not given. rule is the given rule as host + path, null where none fits; then the
    verdict is `block` if a mined rule fits (the most confident, ties by name)
    and `allow` otherwise. A null url has an empty host and path. Repeated rows
    are judged each; extra columns are ignored.
    """
    mined = pages.sparkSession.createDataFrame([], "rule_id string, token string, size int, confidence double, support double") if mined is None else materialize(mined, "rules")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))
    parsed = materialize(_parsed(rows), "urls")
    best = _given(parsed, rules)
    top = _mined(parsed, mined).groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule_id")).alias("top"))

    verdicts = parsed.join(best, "url", "left").join(top, "url", "left")
    by_url = verdicts.select(
        "url",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("top").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("top.rule_id").alias("mined_rule"),
        (-F.col("top.c")).alias("confidence"),
    )
    return rejoin(rows, materialize(by_url, "verdicts"), ["url"]).drop("url")
