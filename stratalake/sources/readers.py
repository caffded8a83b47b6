"""Readers: delimited text, JSON, Excel, Word and Parquet files, and pasted text.

Every reader gives a frame of the file's columns plus `_row_id`, the order of the scan.  Spark reads the bytes, of office
files too, which tasks then parse; so folders, globs and any store that Spark reads work as well as single files.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators.clean import clean_headers, drop_empty_rows, with_row_id


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension: json, xlsx, docx, parquet, and delimited text for the rest."""
    kind = os.path.splitext(path.rstrip("/*"))[1].lower().lstrip(".")
    readers = {"json": read_json, "jsonl": read_json, "xlsx": read_excel, "docx": read_word, "parquet": read_parquet}
    if kind in ("xls", "pdf"):
        raise ValueError(f".{kind} needs an extractor: hand its text to sources.readers or its items to sources.layout")
    return readers.get(kind, read_delimited)(spark, path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_row_id(spark.read.parquet(path))


def sniff_delimiter(line: str) -> str:
    """The delimiter that occurs most in a line; the earlier in the list on ties, a comma without any."""
    best = max(fixed.DELIMITERS, key=lambda d: (line.count(d), -fixed.DELIMITERS.index(d)))
    return best if best in line else ","


def looks_headless(names: list[str], n_rows: int) -> bool:
    if n_rows < 1:
        return False
    numeric = lambda s: bool(re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", s or ""))
    return all(re.fullmatch(r"_\d+", n or "") for n in names) or all(not (n or "").strip() for n in names) or (len(names) > 1 and all(numeric(n) for n in names))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, multi_line: bool | None = None) -> DataFrame:
    """All columns as text.  The first line decides on delimiter and header unless they are given.

    A file is split among tasks unless a quoted value spans lines; `multi_line` tells, else the quotes of all lines are counted.
    """
    lines = [r[0] for r in spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(2).collect()]
    if not lines:
        raise ValueError(f"nothing to read in {path}")
    sep = delimiter or sniff_delimiter(lines[0].lstrip("﻿"))
    if multi_line is None:
        odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
        multi_line = spark.read.text(path).where(odd).limit(1).count() > 0
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "mode": "PERMISSIVE"}
    first = spark.read.options(**options).csv(path, header=False, inferSchema=False)
    names = [v for v in (first.limit(1).collect() or [[]])[0]]
    names = [(n or "").lstrip("﻿").strip() for n in names]
    headless = looks_headless(names, len(lines) - 1) if header is None else not header
    if headless:
        width = len(first.columns)
        df = first.toDF(*[f"Column {i + 1}" for i in range(width)])
    else:
        headers = clean_headers(names)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
        df = spark.read.options(**options).schema(schema).csv(path, header=True, enforceSchema=True).toDF(*headers)
    return with_row_id(drop_empty_rows(df))


def read_pasted(spark: SparkSession, text: str) -> DataFrame:
    """A small text from a clipboard."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        raise ValueError("nothing was pasted")
    sep = sniff_delimiter(lines[0])
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    width = max(len(x.split(sep)) for x in lines)
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = rows.select(F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    names = ["" if v is None else v.strip() for v in parsed.first()]
    if looks_headless(names, len(lines) - 1):
        return with_row_id(drop_empty_rows(parsed.toDF(*[f"Column {i + 1}" for i in range(width)])))
    numbered = with_row_id(parsed.toDF(*clean_headers(names)))
    return drop_empty_rows(numbered.where(F.col("_row_id") > numbered.agg(F.min("_row_id")).first()[0]).drop("_row_id")).withColumn("_row_id", F.monotonically_increasing_id())


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns; arrays of plain values joined by commas, arrays of records as JSON."""

    def walk(field: T.StructField, path: list[str]) -> Iterator:
        at = [*path, field.name]
        c = F.col(".".join(f"`{p}`" for p in at))
        kind = field.dataType
        if isinstance(kind, T.StructType):
            for inner in kind.fields:
                yield from walk(inner, at)
        elif isinstance(kind, T.ArrayType):
            plain = not isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType)
            yield (F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") if plain else F.to_json(c)).alias(".".join(at))
        else:
            yield (F.to_json(c) if isinstance(kind, T.MapType) else c).alias(".".join(at))

    return df.select(*[c for f in df.schema.fields for c in walk(f, [])])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records (an array, one object, or one object a line), flattened."""
    df = spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    if not df.columns or df.columns == ["_corrupt_record"]:
        raise ValueError(f"no records in {path}")
    return with_row_id(flatten(df))


def flatten_json_text(df: DataFrame, column: str, schema: str, prefix: str | None = None) -> DataFrame:
    """A text column of JSON objects as dotted columns."""
    parsed = df.withColumn("__j", F.from_json(F.col(column), schema))
    names = parsed.select("__j.*").columns
    return parsed.select(*df.columns, *[F.col(f"__j.`{n}`").alias(f"{prefix or column}.{n}") for n in names]).drop("__j")


# ---- office files ----------------------------------------------------------------------------------------------------

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DAY_FORMATS = {14, 15, 16, 17, 22}


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(blob: bytes) -> list[list[str]]:
    """Cells of the first sheet as text, row by row, blanks as ''."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        days: set[int] = set()
        if "xl/styles.xml" in names:
            formats = ElementTree.fromstring(z.read("xl/styles.xml")).find(f"{_SHEET}cellXfs")
            days = {i for i, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId", 0)) in _DAY_FORMATS}
        first = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_SHEET}c")):
                at = _column_number(c.get("r")) if c.get("r") else i
                value = c.find(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                elif value is None or value.text is None:
                    continue
                elif c.get("t") == "s":
                    cells[at] = shared[int(value.text)]
                elif c.get("t") == "b":
                    cells[at] = "true" if value.text == "1" else "false"
                elif int(c.get("s", 0)) in days and c.get("t") in (None, "n"):
                    cells[at] = (datetime(1899, 12, 30) + timedelta(days=float(value.text))).strftime("%Y-%m-%d")
                else:
                    cells[at] = value.text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def word_blocks(blob: bytes) -> tuple[list[tuple[str, str]], list[list[list[str]]]]:
    """((section, text) of each paragraph under its last heading, tables of two or more data rows)."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    section, rows, tables = "", [], []
    for e in body:
        if e.tag == f"{_WORD}tbl":
            table = [[text_of(c) for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")]
            if len(table) >= 3:
                tables.append(table)
        elif e.tag == f"{_WORD}p" and (text := text_of(e)):
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            if style is not None and style.get(f"{_WORD}val", "").lower().startswith("heading"):
                section = text
            else:
                rows.append((section, text))
    if not rows:
        rows = [("", text_of(body)[:2000])]
    return rows, tables


def _office_cells(spark: SparkSession, path: str, parse) -> DataFrame:
    """file, at and cells of office files: bytes come through Spark's own reader, so any store that Spark reads works."""

    def rows(batches):
        for batch in batches:
            for name, blob in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                cells = parse(blob)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["file", "at", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, at int, cells array<string>")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook; the first row names the columns."""
    cells = _office_cells(spark, path, sheet_rows)
    head = cells.where("at = 0").orderBy("file").limit(1).collect()
    if not head:
        raise ValueError(f"no rows in {path}")
    names = clean_headers([h for h in head[0]["cells"]])
    columns = [F.get("cells", i).alias(n) for i, n in enumerate(names)]
    return with_row_id(drop_empty_rows(cells.where("at > 0").orderBy("file", "at").select(*columns)))


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """section and text of each paragraph."""
    cells = _office_cells(spark, path, lambda blob: [list(r) for r in word_blocks(blob)[0]])
    return with_row_id(cells.orderBy("file", "at").select(F.get("cells", 0).alias("section"), F.get("cells", 1).alias("text")))


def read_word_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table, row and cells of the tables in documents."""

    def parse(blob: bytes) -> list[list[str]]:
        return [[str(t), str(r), *row] for t, table in enumerate(word_blocks(blob)[1]) for r, row in enumerate(table)]

    cells = _office_cells(spark, path, parse)
    return cells.select("file", F.get("cells", 0).cast("int").alias("table"), F.get("cells", 1).cast("int").alias("row"), F.slice("cells", 3, 10_000).alias("cells"))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.orderBy("_row_id").limit(rows)


def preview_text(spark: SparkSession, path: str, chars: int = 8000) -> str:
    found = spark.read.text(path, wholetext=True).select(F.substring("value", 1, chars)).first()
    return found[0] if found else ""
