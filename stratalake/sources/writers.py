"""Sinks: CSV and Parquet by Spark, and a report bundle (JSON, Markdown, Excel) of small frames."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def _small(df: DataFrame, most: int = 200_000) -> list:
    """The rows of a frame of a report's size; more is an error, as it belongs into files that Spark writes."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes {most} rows of a frame at most: write it with write_parquet")
    return rows


def json_bundle(frames: dict[str, DataFrame], meta: dict) -> str:
    """Small frames and facts as one JSON text; rows of the data itself go to `write_parquet`."""
    return json.dumps(meta | {k: [r.asDict(recursive=True) for r in _small(df)] for k, df in frames.items()}, default=str, ensure_ascii=False)


def markdown_report(title: str, summary: str, sections: dict[str, DataFrame | list[str]]) -> str:
    out = [f"# {title}", "", summary, ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, DataFrame):
            out += ["| " + " | ".join(body.columns) + " |", "|" + " --- |" * len(body.columns)]
            out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _small(body)]
        else:
            out += [f"- {line}" for line in body]
        out.append("")
    return "\n".join(out)


def excel_bytes(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook of small frames, a sheet each."""
    buffer = io.BytesIO()
    names = list(sheets)
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, n in enumerate(names):
            df = sheets[n]
            rows = [df.columns, *[list(r) for r in _small(df)]]
            cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>'
            body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


# ---- history ---------------------------------------------------------------------------------------------------------

HISTORY = "id string, ts timestamp, file string, rows long, columns int, quality long, null_pct double, duplicates long, numeric_columns int, category_columns int, metric string, metric_mean double, metric_median double, top_category string, headers array<string>, summary string"


def append_history(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def list_history(spark, path: str, most: int = 20) -> DataFrame:
    """The latest entries; an absent log is empty."""
    try:
        log = spark.read.schema(HISTORY).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], HISTORY)
    return log.withColumn("__n", F.row_number().over(Window.orderBy(F.desc("ts"), "id"))).where(F.col("__n") <= most).drop("__n").orderBy(F.desc("ts"), "id")


def without_entry(history: DataFrame, entry_id: str) -> DataFrame:
    return history.where(F.col("id") != entry_id)


def clear_history(spark, path: str) -> None:
    """The log with no entries."""
    spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(path)


def top_categories(history: DataFrame) -> DataFrame:
    """How many runs each leading value led."""
    return history.where("top_category is not null").groupBy("top_category").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "top_category")


def trend(history: DataFrame, file: str | None = None) -> DataFrame:
    picked = history if file is None else history.where(F.col("file") == file)
    return picked.orderBy("ts").select("ts", "file", "rows", "quality", "metric", "metric_mean", "top_category")
