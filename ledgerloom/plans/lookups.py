"""Fuzzy look-ups over whole tables; no SQL has the ratio, so tests hold them against every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import catalogs as C
from ..operators import entities as E
from ..session import table
from .registry import query


@query("j10_catalog_lookup", None)
def catalog_lookup(s, d):
    """Lines with letters lost against the catalogs of vendors, own entries first. A vendor's catalog has the parts it sold in odd orders."""
    items = V.items(s, d).select(F.regexp_replace("description", "[aeiou](?=[^aeiou ]*$)", "").alias("description"), "vendor_id")
    catalog = V.items(s, d).where("document_id % 2 = 1").select(F.initcap("description").alias("name"), "vendor_id").distinct()
    return E.catalog_match(items, catalog)


@query("j11_vendor_lookup", None)
def vendor_lookup(s, d):
    """customers' names as sellers against vendors learned from suppliers: contained, containing or alike, the first one learned."""
    learned = table(s, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.substring("s_name", 1, 12), (F.col("s_suppkey") % 1000).cast("string")).alias("vendor"))
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("M/s supplier#0000"), (k % 100).cast("string"), F.lit(" & Sons"))).when(k % 3 == 1, F.concat(F.lit("suplier#00"), (k % 50).cast("string"))).otherwise(F.col("c_name"))
    return C.vendor_lookup(table(s, d, "customer").select(k.alias("doc"), said.alias("vendor_name")), learned)
