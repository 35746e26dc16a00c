"""A scanned page's items by the first of four extractors that finds any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .catalogs import catalog_items, vendor_lookup
from .grids import text_items
from .invoice_text import gst_items
from .pages import anchored_items

# Words of a tax invoice, and how many items a learned catalog must find to be believed.
TAX_WORDS, CATALOG_LEAST = r"gstin|pan no|hsn|cgst|sgst", 2
LINE = ["doc", "method", "line_no", "description", "qty", "rate", "gross_amount"]


def image_items(scans: DataFrame, words: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, method, line_no, description, qty, rate, gross_amount) of scans (doc, vendor_name, text).

    In order: the learned catalog of the vendor (known: ord, vendor, description,
    rate) if it finds two items, the sections of a tax invoice if the text speaks of
    one, word boxes (page = doc) by their columns, lines of text by their shapes. Each extractor only
    sees documents for which all before it found nothing; a written table of what
    is settled comes between, so no extractor runs twice.
    """
    amount = "decimal(18,2)"
    shape = lambda df, method, line: df.select("doc", F.lit(method).alias("method"), line.cast("int").alias("line_no"), "description", *[F.col(c).cast(amount).alias(c) for c in ("qty", "rate", "gross_amount")])

    def open_(df: DataFrame, key: str = "doc") -> DataFrame:
        return df.join(found.select(F.col("doc").alias("__f")).distinct(), F.col(key) == F.col("__f"), "left_anti")

    learned = vendor_lookup(scans.select("doc", "vendor_name"), known.select("ord", "vendor").groupBy("vendor").agg(F.min("ord").alias("ord"))).where("learned is not null")
    texts = scans.select("doc", "text").join(learned.select(F.col("doc").alias("__l"), F.col("learned").alias("vendor")), F.col("doc") == F.col("__l")).select("doc", "vendor", "text")
    items = catalog_items(texts, known.drop("ord")).withColumnRenamed("amount", "gross_amount")
    items = items.withColumn("n", F.count("*").over(W.partitionBy("doc"))).where(F.col("n") >= CATALOG_LEAST)
    found = shape(items, "catalog", F.row_number().over(W.partitionBy("doc").orderBy("description"))).checkpoint()
    tax = gst_items(open_(scans).where(F.lower("text").rlike(TAX_WORDS)).select("doc", "text"))
    found = found.unionByName(shape(tax, "sections", F.col("line_no"))).checkpoint()
    boxes = anchored_items(open_(words, "page"), pages).withColumnRenamed("page", "doc")
    found = found.unionByName(shape(boxes, "columns", F.col("line_no"))).checkpoint()
    lines = text_items(open_(scans).select("doc", "text")).withColumnRenamed("amount", "gross_amount")
    return found.unionByName(shape(lines, "lines", F.row_number().over(W.partitionBy("doc").orderBy("line"))))
