"""Explicit schemas of the document model; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("document_no", T.StringType()),
        T.StructField("document_date", T.DateType()),
        T.StructField("vendor_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("grand_total_taxable", T.DecimalType(14, 2)),
        T.StructField("total_discount", T.DecimalType(14, 2)),
        T.StructField("grand_total_cgst", T.DecimalType(14, 2)),
        T.StructField("grand_total_sgst", T.DecimalType(14, 2)),
        T.StructField("grand_total_final", T.DecimalType(14, 2)),
        T.StructField("source_file", T.StringType()),
        T.StructField("extraction_status", T.StringType()),
    ]
)

ITEM = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("item_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("hsn_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("uom", T.StringType()),
        T.StructField("packing", T.StringType()),
        T.StructField("qty", T.DecimalType(20, 8)),
        T.StructField("rate", T.DecimalType(20, 8)),
        T.StructField("gross_amount", T.DecimalType(20, 8)),
        T.StructField("discount_pct", T.DecimalType(20, 8)),
        T.StructField("discount_amount", T.DecimalType(20, 8)),
        T.StructField("taxable_amount", T.DecimalType(20, 8)),
        T.StructField("cgst_pct", T.DecimalType(20, 8)),
        T.StructField("cgst_amount", T.DecimalType(20, 8)),
        T.StructField("sgst_pct", T.DecimalType(20, 8)),
        T.StructField("sgst_amount", T.DecimalType(20, 8)),
        T.StructField("final_value", T.DecimalType(20, 8)),
    ]
)

#: Fields of a line that arithmetic works on, in the order of the fills.
AMOUNTS = ["qty", "rate", "gross_amount", "discount_pct", "discount_amount", "taxable_amount", "cgst_pct", "cgst_amount", "sgst_pct", "sgst_amount", "final_value"]
ALIASES = T.StructType([T.StructField("alias", T.StringType()), T.StructField("canonical", T.StringType())])
GRID = T.StructType([T.StructField("doc", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
EAV = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("field_name", T.StringType()), T.StructField("field_value", T.StringType()), T.StructField("field_type", T.StringType())])
