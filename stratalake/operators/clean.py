"""Cleaning: headers, coercion by inferred type, imputation, de-duplication, time parts, with a log."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.scratch import written
from .profile import ColumnType, infer_types, q

ROW_ID = "_row_id"


def clean_headers(names: list[str]) -> list[str]:
    """Trim, join spaces, fill blanks, and tell names apart that differ in case only."""
    out, seen = [], set()
    for i, name in enumerate(names):
        name = re.sub(r"\s+", " ", name or "").strip() or f"column_{i + 1}"
        if name.lower() in seen:
            name = f"{name}_{i}"
        seen.add(name.lower())
        out.append(name)
    return out


def with_row_id(df: DataFrame) -> DataFrame:
    """Row order of the scan as a column: increasing within and across the splits of the files."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def coerced(name: str, kind: str) -> Column:
    c = q(name)
    if kind in ("integer", "number"):
        return C.to_number(c)
    if kind == "boolean":
        return C.to_boolean(c)
    if kind == "date":
        return C.to_day(c)
    return C.without_nullish(c)


def impute_values(df: DataFrame, types: list[ColumnType]) -> dict[str, object]:
    """The fill of each column with gaps: mean (4 places) of numbers, mode of categories and booleans (ties: first seen)."""
    fills: dict[str, object] = {}
    numbers = [t.column for t in types if t.type in ("integer", "number")]
    if numbers:
        row = df.agg(*[F.round(F.avg(C.finite(q(n))), 4).alias(f"m{i}") for i, n in enumerate(numbers)]).first()
        fills |= {n: row[f"m{i}"] for i, n in enumerate(numbers) if row[f"m{i}"] is not None}
    modes = [t.column for t in types if t.type in ("category", "boolean")]
    if modes:
        pairs = df.select(ROW_ID, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("value")) for n in modes])).alias("x")).select(ROW_ID, "x.*")
        counts = pairs.where("value is not null").groupBy("column", F.lower("value").alias("key")).agg(F.count("*").alias("n"), F.min(ROW_ID).alias("at"), F.min_by("value", ROW_ID).alias("value"))
        best = counts.groupBy("column").agg(F.max_by("value", F.struct("n", (-F.col("at")).alias("at"))).alias("value"))
        kinds = dict(df.dtypes)
        for r in best.collect():  # a row for each column
            fills[r["column"]] = r["value"] == "true" if kinds[r["column"]] == "boolean" else r["value"]
    return fills


def deduplicate(df: DataFrame, names: list[str], order: str = ROW_ID) -> DataFrame:
    """The first row (by `order`) of each set of rows that agree in all columns, case and outer spaces aside."""
    key = [F.lower(F.trim(F.coalesce(q(n).cast("string"), F.lit("")))) for n in names]
    whole = F.struct(*[q(n) for n in df.columns])
    kept = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(whole, q(order)).alias("__row"))
    return kept.select("__row.*")


@dataclass
class Cleaned:
    df: DataFrame
    types: list[ColumnType]
    null_counts: dict[str, int]
    duplicate_rows: int
    rows_removed: int
    log: list[dict] = field(default_factory=list)


def clean(df: DataFrame, impute: bool = True, drop_duplicates: bool = True) -> Cleaned:
    """Types, coercion, gaps, fills, then duplicates; a value that does not fit its column's type becomes null.

    The coerced rows are written once, and what follows reads them; rows without duplicates are written again.
    """
    df = df if ROW_ID in df.columns else with_row_id(df)
    names = [c for c in df.columns if c != ROW_ID]
    df = df.toDF(*[ROW_ID if c == ROW_ID else h for c, h in zip([*names, ROW_ID], [*clean_headers(names), ROW_ID], strict=True)]) if df.columns[-1] == ROW_ID else df
    names = [c for c in df.columns if c != ROW_ID]
    types = infer_types(df.select(*[q(n) for n in names]))
    log = [{"step": "type_inference", "column": t.column, "detail": t.type, "count": None} for t in types]
    # one pass coerces, writes and counts; the counts are of a job without a shuffle, whose tasks count once each
    seen = Observation()
    typed = df.select(*[coerced(t.column, t.type).alias(f"v{i}") for i, t in enumerate(types)], *[C.is_nullish(q(n)).alias(f"b{i}") for i, n in enumerate(names)], ROW_ID)
    counts = [F.count("*").alias("rows"), *[F.count_if(~F.col(f"b{i}")).alias(f"r{i}") for i in range(len(names))], *[F.count_if(F.col(f"v{i}").isNull()).alias(f"g{i}") for i in range(len(names))]]
    typed = written(typed.observe(seen, *counts).select(*[F.col(f"v{i}").alias(n) for i, n in enumerate(names)], ROW_ID))
    row = seen.get
    nulls = {n: row[f"g{i}"] for i, n in enumerate(names)}
    for i, n in enumerate(names):
        bad = row[f"r{i}"] - (row["rows"] - row[f"g{i}"])
        if bad:
            log.append({"step": "value_coercion", "column": n, "detail": "unparseable", "count": bad})
    if impute:
        fills = impute_values(typed, types)
        for n, v in fills.items():
            if nulls[n]:
                log.append({"step": "imputation", "column": n, "detail": str(v), "count": nulls[n]})
        typed = typed.select(*[F.coalesce(q(n), F.lit(fills[n])).alias(n) if n in fills else q(n) for n in names], ROW_ID)
    key = F.xxhash64(F.array(*[F.lower(F.trim(F.coalesce(q(n).cast("string"), F.lit("")))) for n in names]))
    groups = typed.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    if groups:
        log.append({"step": "deduplication", "column": None, "detail": "removed" if drop_duplicates else "counted", "count": groups})
    if drop_duplicates and groups:  # rows of distinct hashes are distinct
        typed = written(deduplicate(typed, names))
    return Cleaned(typed, types, nulls, groups, groups if drop_duplicates else 0, log)


def time_parts(df: DataFrame, name: str) -> DataFrame:
    """Year, quarter, month, month name, ISO week and day of week of a date column."""
    d = q(name).cast("timestamp")
    return df.withColumns(
        {
            f"{name}_year": F.year(d),
            f"{name}_quarter": F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")),
            f"{name}_month": F.date_format(d, "yyyy-MM"),
            f"{name}_month_name": F.date_format(d, "MMMM yyyy"),
            f"{name}_week": F.weekofyear(d),
            f"{name}_day_of_week": F.date_format(d, "EEEE"),
        }
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(*[F.nullif(C.trimmed(q(n)), F.lit("")) for n in df.columns]).isNotNull())


def search(df: DataFrame, needle: str) -> DataFrame:
    return df.where(C.any_contains([q(n) for n in df.columns], needle)) if needle else df


def page(df: DataFrame, order: list[str], number: int, size: int = 50) -> DataFrame:
    """Page `number` from 0; a number beyond the last page gives the last one.

    For page after page of one table, `ordered.stored(df, order)` sorts once and its `page` reads a partition or two.
    """
    last = max(0, -(-df.count() // size) - 1)
    return df.orderBy(*order).offset(min(max(number, 0), last) * size).limit(size)
