"""Readers and writers: cells and words in, JSON and workbooks out."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "table_id string, file string, page int, table_ord int, title string, row_idx int, col_idx int, raw string"
WORDS = "file string, page int, word_id long, text string, x0 double, x1 double, top double, bottom double, size double"
GROUND_TRUTH = "source_pdf string, source_page int, title string, rows array<array<string>>"


def discover(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(file, path, mtime, bytes) of the files below path; of equal names the first path stands. Contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    return named.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy("path"))).filter("__n = 1").drop("__n")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELLS).parquet(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Cells of hand-made tables, one JSON file each; the file's name is the table's id."""
    raw = spark.read.schema(GROUND_TRUTH).option("multiLine", "true").json(path).withColumn("table_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    rows = raw.select("table_id", F.col("source_pdf").alias("file"), F.col("source_page").alias("page"), F.lit(0).alias("table_ord"), "title", F.posexplode("rows").alias("row_idx", "cells"))
    return rows.select("table_id", "file", "page", "table_ord", "title", "row_idx", F.posexplode("cells").alias("col_idx", "raw"))


def write_json(tables: DataFrame, path: str) -> None:
    """One JSON object per table, ordered within each file's partition."""
    tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r["cells"], lambda c: F.coalesce(c["txt"], c["num"].cast("string"))))).drop("data").write.json(path)


def sheet_names(titles: list[str]) -> list[str]:
    """Names that a workbook allows: 28 characters without []:*?/\\, told apart by _2, _3 and so on."""
    out: list[str] = []
    for t in titles:
        name = re.sub(r"[\[\]:*?/\\]", "_", t)[:28] or "Sheet"
        k, full = 1, name
        while full.lower() in {x.lower() for x in out}:
            k += 1
            full = f"{name}_{k}"
        out.append(full)
    return out


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx file of sheets of rows, from the standard library. Meant for reports of one company, not for a corpus."""
    names, book = sheet_names(list(sheets)), BytesIO()

    def cell(v, r, c) -> str:
        ref = ""
        c += 1
        while c:
            c, k = divmod(c - 1, 26)
            ref = chr(65 + k) + ref
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}{r + 1}"><v>{v}</v></c>'
        return f'<c r="{ref}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r + 1}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")
    return book.getvalue()
