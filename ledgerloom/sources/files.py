"""Files as DataFrames: discovery, true types, grids, text, memory."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GRID

EXTENSIONS = "{pdf,xlsx,xls,csv}"


def scan_folder(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Files of the allowed kinds with hash and true type; dotfiles, known hashes and repeats are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"[!.]*.{EXTENSIONS}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.sha2("content", 256).alias("file_hash"), true_type(F.col("content"), name).alias("file_type"), "length")
    first = out.groupBy("file_hash").agg(F.min(F.struct("path", "name", "file_type", "length")).alias("r")).select("r.*", "file_hash")
    return first if known is None else first.join(known.select(F.col("file_hash").alias("__k")), F.col("file_hash") == F.col("__k"), "left_anti")


def true_type(content, name):
    """S3: by the first bytes; csv by its extension; null when unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), "xlsx")
        .when(head.startswith("D0CF11E0"), "xls")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("89504E47"), "png")
        .when(F.lower(name).endswith(".csv"), "csv")
    )


def mismatched(files: DataFrame) -> DataFrame:
    """S3: files whose extension says something else than their bytes."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    return files.where(F.col("file_type").isNotNull() & (ext != F.col("file_type")))


def _grids(kind: str, tolerant: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for sheet, k, cells in _sheets(kind, bytes(content), tolerant):
                    rows.append((path, sheet, k, [None if c is None else str(c) for c in cells]))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["doc", "sheet", "row_idx", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["doc", "sheet", "row_idx", "cells"])

    return read


def _sheets(kind: str, content: bytes, tolerant: bool) -> Iterator[tuple[str, int, list]]:
    if kind == "csv":
        csv.field_size_limit(10 << 20)
        text = content.decode("utf-8", "ignore" if tolerant else "strict")
        for k, row in enumerate(csv.reader(io.StringIO(text, newline=""))):
            yield "Sheet1", k, row
    elif kind == "xlsx":
        try:
            import openpyxl
        except ImportError as e:
            raise RuntimeError("reading xlsx needs openpyxl on the executors") from e
        book = openpyxl.load_workbook(io.BytesIO(content), data_only=True, read_only=True)
        for sheet in book.worksheets:
            for k, row in enumerate(sheet.iter_rows(values_only=True)):
                yield sheet.title, k, list(row)
    elif kind == "xls":
        try:
            import xlrd
        except ImportError as e:
            raise RuntimeError("reading xls needs xlrd on the executors") from e
        book = xlrd.open_workbook(file_contents=content)
        for sheet in book.sheets():
            for k in range(sheet.nrows):
                yield sheet.name, k, sheet.row_values(k)
    elif kind == "pdf":
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading pdf needs pdfplumber on the executors") from e
        with pdfplumber.open(io.BytesIO(content)) as book:
            for n, page in enumerate(book.pages):
                for t, grid in enumerate(page.extract_tables() or []):
                    for k, row in enumerate(grid):
                        yield f"page{n + 1}.{t + 1}", k, row
    else:
        raise ValueError(f"no grid reader for {kind}")


def read_grids(spark: SparkSession, path: str, kind: str = "csv", tolerant: bool = False) -> DataFrame:
    """Cells of every sheet (or page table) of every file, read on the executors; (doc, sheet, row_idx, cells)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    return files.mapInPandas(_grids(kind, tolerant), GRID)


def sheets(grid: DataFrame) -> DataFrame:
    """The sheets of each document."""
    return grid.select("doc", "sheet").distinct()


def text_or_scan(pages: DataFrame, least: int = 30) -> DataFrame:
    """A document is text if any page (doc, page, text) has more than 30 characters, else it needs OCR."""
    longest = F.max(F.coalesce(F.length(F.trim("text")), F.lit(0)))
    return pages.groupBy("doc").agg(F.when(longest > least, "text").otherwise("ocr").alias("route"))


def join_pages(pages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pages (doc, page, text, confidence) as one text with page breaks, and the pages below the confidence threshold."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n--- Page Break ---\n\n")
    return pages.groupBy("doc").agg(text.alias("text"), F.sort_array(F.collect_list(F.when(F.col("confidence") < threshold, F.col("page")))).alias("low_pages"))


def first_extraction(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The first non-empty of several item arrays."""
    return rows.withColumn("items", F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in columns]))


def split_text(texts: DataFrame) -> DataFrame:
    """Texts (doc, text) cut at `invoice_<n>` markers: (doc, part, number, body); of one number in a document the first part stays."""
    parts = texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(invoice_\d+.*?)(?=invoice_\d+|$)"), 1)).alias("part", "s"))
    out = parts.select("doc", "part", F.regexp_extract("s", r"^invoice_(\d+)", 1).alias("number"), F.regexp_replace("s", r"^invoice_\d+[:\s]*|\s+$", "").alias("body"))
    return out.groupBy("doc", "number").agg(F.min("part").alias("part"), F.min_by("body", "part").alias("body"))


CELL_JSON = "document_no string, date string, items array<struct<description:string,qty:string,rate:string,amount:string>>"


def json_cells(grid: DataFrame, every: bool = False) -> DataFrame:
    """JSON embedded (and over-escaped) in cells: the first valid cell of a document, or all; one row per item."""
    cells = grid.select("doc", "sheet", "row_idx", F.posexplode("cells").alias("col", "v"))
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.col("v"), F.lit('""'), F.lit('"')), r'\\+"', '"'), r'^"|"$', "")
    found = cells.where(F.col("v").contains("{")).withColumn("j", F.from_json(F.regexp_extract(clean, r"(?s)\{.*\}", 0), CELL_JSON)).where("j is not null and j.items is not null")
    if not every:
        found = found.groupBy("doc").agg(F.min_by("j", F.struct("sheet", "row_idx", "col")).alias("j"))
    return found.select("doc", "j.document_no", F.posexplode("j.items").alias("pos", "item")).select("doc", "document_no", "pos", "item.*")


def chunk_text(texts: DataFrame, lines: int = 100, divider: str = r"--- Page Break ---") -> DataFrame:
    """(doc, text) cut at page dividers, else every `lines` lines: (doc, chunk, body)."""
    pages = F.split("text", divider)
    by_page = texts.where(F.size(pages) > 1).select("doc", F.posexplode(pages).alias("chunk", "body"))
    rows = texts.where(F.size(pages) <= 1).select("doc", F.split("text", "\n").alias("ls"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ls"), F.lit(1)), F.lit(lines))
    by_lines = rows.select("doc", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("ls", k, lines), "\n"))).alias("chunk", "body"))
    return by_page.unionByName(by_lines)


def merge_chunks(parts: DataFrame) -> DataFrame:
    """Results of chunks (doc, chunk, header map, items array): first non-empty header value, items in order."""
    kv = parts.select("doc", "chunk", F.explode_outer("header").alias("k", "v")).where("k is not null and coalesce(trim(v), '') != ''")
    heads = kv.groupBy("doc", "k").agg(F.min_by("v", "chunk").alias("v")).groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("header"))
    items = parts.groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "items"))), lambda x: x["items"])).alias("items"))
    return items.join(heads, "doc", "left")


def read_memory(spark: SparkSession, path: str, counted: bool = False) -> DataFrame:
    """The learned memory, a JSON object a line and vendor: known items as (vendor, item), with how often each was seen if `counted`."""
    raw = spark.read.schema(f"vendor string, known_items array<{'struct<item:string,n:bigint>' if counted else 'string'}>").json(path)
    rows = raw.select("vendor", F.explode("known_items").alias("item"))
    return rows.select("vendor", "item.*") if counted else rows


def read_memory_file(spark: SparkSession, path: str) -> DataFrame:
    """A memory kept as one JSON object over all vendors, as (vendor, item); such a file is read by one task."""
    raw = spark.read.schema("vendors map<string, struct<known_items: array<string>>>").json(path, multiLine=True)
    return raw.select(F.explode("vendors").alias("vendor", "v")).select("vendor", F.explode("v.known_items").alias("item"))


def write_memory(catalog: DataFrame, path: str) -> None:
    """The memory back as JSON lines; the committer renames whole files into place."""
    catalog.write.mode("overwrite").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The log of corrections, one JSON object a line, by a stated schema."""
    return spark.read.schema("document_id long, line_no int, field string, old string, new string, ts string").json(path)


def queued(queue: DataFrame, n: int = 10) -> DataFrame:
    """The oldest n queued rows (queue_id, status, created_at)."""
    return queue.where(F.col("status") == "queued").orderBy("created_at", "queue_id").limit(n)
