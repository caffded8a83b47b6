"""OLAP over columns: group aggregates, top and bottom, Pareto, periods, decomposition, roles, and the whole sweep.

Money is summed as exact decimals.  Ties are broken by the value itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .ordered import stored
from .profile import ColumnType, q

EXACT = "decimal(28,6)"


def exact_sum(c: Column) -> Column:
    return F.sum(C.finite(c).cast(EXACT)).cast("double")


def _aggregates(m: Column) -> list[Column]:
    v = C.finite(m)
    return [exact_sum(m).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max")]


def grouped(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    """value, sum, count, min, max, mean of each group with a value and a measure."""
    d, m = q(dimension).cast("string"), q(measure)
    some = df.where(d.isNotNull() & (d != "") & C.finite(m).isNotNull())
    return some.groupBy(d.alias("value")).agg(*_aggregates(m)).withColumn("mean", F.col("sum") / F.col("count"))


def aggregate_by(df: DataFrame, measure: str, dimension: str, agg: str = "sum", top: int | None = 10, ascending: bool = False) -> DataFrame:
    """Groups by an aggregate, with its share of the sum of all groups' sums."""
    if agg not in ("sum", "mean", "count", "max", "min"):
        agg = "sum"
    groups = grouped(df, measure, dimension)
    total = groups.agg(F.sum(F.col("sum").cast(EXACT)).cast("double").alias("__total"))
    value = F.col(agg).cast("double")
    out = groups.join(F.broadcast(total)).select(
        "value", "sum", "count", F.round("mean", 4).alias("mean"), value.alias("agg_value"), C.share_of(value, F.col("__total")).alias("share")
    )
    out = out.orderBy(F.asc("agg_value") if ascending else F.desc("agg_value"), "value")
    return out if top is None else out.limit(top)


def top_n(df: DataFrame, measure: str, dimension: str, n: int = 5, agg: str = "sum") -> DataFrame:
    return aggregate_by(df, measure, dimension, agg, n)


def bottom_n(df: DataFrame, measure: str, dimension: str, n: int = 5, agg: str = "sum") -> DataFrame:
    return aggregate_by(df, measure, dimension, agg, n, ascending=True)


def share_of_total(df: DataFrame, measure: str, dimension: str, top: int = 50) -> DataFrame:
    return aggregate_by(df, measure, dimension, "sum", top).select("value", "sum", "share")


def pareto(df: DataFrame, measure: str, dimension: str, top: int | None = 1000) -> DataFrame:
    """value, sum, rank, cumulative and cumulative_share over the `top` groups (a report's size) by sum; over all with None."""
    if top is None:
        return _whole_pareto(grouped(df, measure, dimension).select("value", "sum"))
    best = grouped(df, measure, dimension).select("value", "sum").orderBy(F.desc("sum"), "value").limit(top)
    by = Window.orderBy(F.desc("sum"), "value").rowsBetween(Window.unboundedPreceding, 0)
    money = F.col("sum").cast(EXACT)
    running = F.sum(money).over(by).cast("double")
    whole = F.sum(money).over(Window.partitionBy()).cast("double")
    return best.select("value", "sum", F.row_number().over(Window.orderBy(F.desc("sum"), "value")).alias("rank"), running.alias("cumulative"), C.share_of(running, whole).alias("cumulative_share"))


def _whole_pareto(groups: DataFrame) -> DataFrame:
    """The same from prefix sums: no task holds more than a range of the groups."""
    held = stored(groups, [F.desc("sum"), "value"])
    whole = held.table.agg(F.sum(F.col("sum").cast(EXACT)).cast("double")).first()[0]
    ranks = held.running({"cumulative": F.col("sum").cast(EXACT), "rank": F.lit(1).cast("long")})
    return ranks.select("value", "sum", "rank", F.col("cumulative").cast("double").alias("cumulative"), C.share_of(F.col("cumulative").cast("double"), F.lit(whole)).alias("cumulative_share"))


def pareto_summary(curve: DataFrame, threshold: float = 80) -> DataFrame:
    """One row: contributors, those within the threshold (the crossing one not counted), those to cross it, share there, concentration."""
    inside = F.count(F.when(F.col("cumulative_share") <= threshold, 1))
    return curve.agg(
        F.count("*").alias("total_contributors"),
        inside.alias("pareto_count"),
        F.min(F.when(F.col("cumulative_share") >= threshold, F.col("rank"))).cast("long").alias("groups_to_threshold"),
        F.min(F.when(F.col("cumulative_share") >= threshold, F.col("cumulative_share"))).alias("cumulative_at"),
        F.round(F.coalesce(F.try_divide(inside, F.count("*")), F.lit(0.0)) * 100, 1).alias("concentration_index"),
    )


def period_key(c: Column, granularity: str) -> Column:
    """`week` is the calendar year with the ISO week; `iso_week` takes the week's own year."""
    d = c.cast("timestamp")
    year = F.year(d).cast("string")
    week = F.concat(F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return {
        "year": year,
        "quarter": F.concat(year, F.lit("-Q"), F.quarter(d).cast("string")),
        "month": F.date_format(d, "yyyy-MM"),
        "day": F.date_format(d, "yyyy-MM-dd"),
        "week": F.concat(year, week),
        "iso_week": F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), week),
    }[granularity]


def period_over_period(df: DataFrame, measure: str, date: str, granularity: str = "month", agg: str = "sum", fill_gaps: bool = False) -> DataFrame:
    """period, value, previous, delta and growth_pct against the previous period that exists (or, filled, that passed)."""
    key = period_key(q(date), granularity)
    value = {"mean": F.avg(C.finite(q(measure))), "count": F.count(C.finite(q(measure))).cast("double")}.get(agg, exact_sum(q(measure)))
    out = df.where(key.isNotNull() & C.finite(q(measure)).isNotNull()).groupBy(key.alias("period")).agg(value.alias("value"))
    if fill_gaps:
        steps = {"year": "1 year", "quarter": "3 months", "month": "1 month", "day": "1 day", "week": "7 days", "iso_week": "7 days"}
        unit = "week" if "week" in granularity else granularity
        ends = df.agg(F.date_trunc(unit, F.min(q(date))).alias("a"), F.date_trunc(unit, F.max(q(date))).alias("b"))
        every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {steps[granularity]}"))).alias("t")).select(period_key(F.col("t"), granularity).alias("period")).distinct()
        out = every.join(out, "period", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return over_previous(out)


def over_previous(periods: DataFrame) -> DataFrame:
    """Each period's value against that of the period before it."""
    previous = F.lag("value").over(Window.orderBy("period"))  # one row for each period
    return periods.select("period", F.round("value", 4).alias("value"), F.round(previous, 4).alias("previous"), F.round(F.col("value") - previous, 4).alias("delta"), C.percent_change(previous, F.col("value")).alias("growth_pct"))


def series_summary(periods: DataFrame) -> DataFrame:
    """One row: first, last, total growth, peak and trough (the earlier on ties), mean growth and its projection."""
    edge = lambda f, c: f(c, "period")
    out = periods.agg(
        F.count("*").alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        edge(F.min_by, "value").alias("first_value"), edge(F.max_by, "value").alias("last_value"),
        F.max(F.struct("value", "period"))["value"].alias("peak_value"), F.min(F.struct("value", "period"))["value"].alias("trough_value"),
        F.min_by("period", F.struct((-F.col("value")).alias("v"), "period")).alias("peak_period"), F.min_by("period", F.struct("value", "period")).alias("trough_period"),
        F.avg("growth_pct").alias("mean_growth"),
    )
    out = out.withColumn("total_growth_pct", C.percent_change(F.col("first_value"), F.col("last_value")))
    projected = F.when(F.col("n") >= 3, F.round(F.col("last_value") * (1 + F.col("mean_growth") / 100), 4))
    return out.withColumn("projected", projected).withColumn("mean_growth", F.round("mean_growth", 4))


def decompose(df: DataFrame, measure: str, dimension: str, top: int = 50) -> DataFrame:
    """value, sum, share and rank over the `top` groups, with the top share and the share of the first fifth of the groups."""
    best = grouped(df, measure, dimension).select("value", "sum").orderBy(F.desc("sum"), "value").limit(top)
    every = Window.partitionBy()
    whole = F.sum(F.col("sum").cast(EXACT)).over(every).cast("double")
    ranked = best.select("value", "sum", C.share_of(F.col("sum"), whole).alias("share"), F.row_number().over(Window.orderBy(F.desc("sum"), "value")).alias("rank"), F.count("*").over(every).alias("__n"))
    fifth = F.col("rank") <= F.ceil(F.col("__n") * 0.2)
    return ranked.select("value", "sum", "share", "rank", F.max("share").over(every).alias("top_share"), F.round(F.sum(F.when(fifth, F.col("share"))).over(every), 1).alias("concentration_index"))


def sweep(df: DataFrame, measures: list[str], dimensions: list[str], top: int | None = None) -> DataFrame:
    """Every measure by every dimension from one grouping-sets job: measure, dimension, value, sum, count, mean, share, rank.

    Groups of a null or blank value are left out of their set; ranks and shares are within (measure, dimension).
    With `top`, each task keeps its first groups of a pair before they are ranked together.
    """
    named = df.select(*[q(d).cast("string").alias(f"d{i}") for i, d in enumerate(dimensions)], *[C.finite(q(m)).alias(f"m{i}") for i, m in enumerate(measures)])
    dims = [f"d{i}" for i in range(len(dimensions))]
    aggs = [F.struct(F.sum(F.col(f"m{i}").cast(EXACT)).cast("double").alias("sum"), F.count(f"m{i}").alias("count")).alias(f"a{i}") for i in range(len(measures))]
    cube = named.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id().alias("g"), *aggs)
    n = len(dims)
    which = [F.when(F.col("g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.struct(F.lit(name).alias("dimension"), F.col(f"d{i}").alias("value"))) for i, name in enumerate(dimensions)]
    tall = cube.select(F.coalesce(*which).alias("d"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"a{i}").alias("a")) for i, m in enumerate(measures)])).alias("m"))
    tall = tall.select("m.measure", "d.dimension", "d.value", "m.a.sum", "m.a.count").where("value is not null and value <> '' and count > 0")
    pair = ["measure", "dimension"]
    whole = tall.groupBy(*pair).agg(F.sum(F.col("sum").cast(EXACT)).cast("double").alias("__whole"))  # a row for each pair
    tall = tall.join(F.broadcast(whole), pair).withColumn("rank", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("sum"), "value")))
    if top is not None:
        tall = tall.where(F.col("rank") <= top)
    return tall.select("measure", "dimension", "value", "sum", "count", F.round(F.col("sum") / F.col("count"), 4).alias("mean"), C.share_of(F.col("sum"), F.col("__whole")).alias("share"), "rank")


# ---- roles of columns ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Role:
    column: str
    role: str  # measure, dimension, geo, time, identifier
    subtype: str
    non_null: int
    unique: int
    unique_ratio: float
    sum: float
    mean: float
    min: float | None
    max: float | None


def _has(name: str, words: tuple[str, ...], match: str) -> bool:
    low = name.lower()
    return any(w in low for w in words) if match == "substring" else bool(set(re.split(r"[^a-z0-9]+", low)) & set(words))


def is_identifier_name(name: str, ratio: float, unique: int) -> bool:
    low = name.lower()
    if low == "id" or low.endswith(("_id", "-id")) or (low.endswith("id") and ratio >= 0.9) or low.startswith(fixed.IDENTIFIER_STARTS):
        return True
    return bool(set(re.split(r"[_\-. ]+", low)) & set(fixed.IDENTIFIER_TOKENS)) or bool(re.search(r"[a-z]id$", low) and ratio >= 0.9 and unique >= 20)


def classify(df: DataFrame, types: list[ColumnType], match: str = "substring") -> list[Role]:
    """The role of each typed column, from one aggregation; `match` tells how keywords meet names (substring or token)."""
    aggs = []
    for i, t in enumerate(types):
        c = q(t.column)
        v = C.finite(c) if t.type in ("integer", "number") else F.lit(None).cast("double")
        text = F.when(c.cast("string") != "", F.lower(c.cast("string")))
        aggs.append(
            F.struct(
                F.count(text).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                F.count(F.when(v.between(1900, 2099) & (v == F.floor(v)), 1)).alias("years"), F.count(F.when(v != F.floor(v), 1)).alias("broken"),
            ).alias(f"c{i}")
        )
    row = df.agg(F.count("*").alias("rows"), *aggs).first()
    values = [F.struct(F.lit(i).alias("i"), F.xxhash64(F.lower(q(t.column).cast("string"))).alias("h")) for i, t in enumerate(types) if row[f"c{i}"]["n"]]
    blank = F.lit("").cast("string")
    kept = df.select(F.explode(F.array(*[F.when(F.coalesce(q(types[j].column).cast("string"), blank) != "", v) for j, v in zip([i for i in range(len(types)) if row[f"c{i}"]["n"]], values, strict=True)])).alias("x")) if values else None
    unique = {r["i"]: r["u"] for r in kept.where("x is not null").select("x.*").distinct().groupBy("i").agg(F.count("*").alias("u")).collect()} if values else {}
    out = []
    for i, t in enumerate(types):
        s = row[f"c{i}"].asDict() | {"unique": unique.get(i, 0)}
        if not s["n"]:
            continue
        ratio = s["unique"] / s["n"]
        role, sub = role_of(t, row["rows"], s, ratio, match)
        out.append(Role(t.column, role, sub, s["n"], s["unique"], round(ratio, 4), s["sum"], s["mean"], s["min"], s["max"]))
    return out


def role_of(t: ColumnType, rows: int, s, ratio: float, match: str) -> tuple[str, str]:
    numeric, measured = t.type in ("integer", "number"), _has(t.column, fixed.MEASURE_WORDS, match)
    if t.type == "date":
        return "time", "date"
    if numeric and s["years"] / s["n"] >= 0.8 and 1 < s["unique"] < 200:
        return "time", "year"
    if (numeric or t.type == "identifier") and is_identifier_name(t.column, ratio, s["unique"]):
        return "identifier", t.type
    if numeric:
        coded = s["unique"] <= 15 and rows > 5 and not measured and not s["broken"]
        return ("dimension", "integer") if coded else ("measure", t.type)
    if t.type == "boolean":
        return "dimension", "boolean"
    if t.type == "identifier" or (ratio >= 0.95 and rows >= 20 and s["unique"] > 20 and not measured):
        return "identifier", t.type
    return ("geo" if _has(t.column, fixed.GEOGRAPHIC_WORDS, match) else "dimension"), t.type


def primary_measure(roles: list[Role], match: str = "substring") -> Role | None:
    score = lambda r: sum(_has(r.column, (w,), match) for w in fixed.MEASURE_WORDS) + (0.5 if r.sum > 0 else 0)
    return max((r for r in roles if r.role == "measure"), key=score, default=None)


def primary_dimension(roles: list[Role]) -> Role | None:
    def score(r: Role) -> float:
        size = 5 if 3 <= r.unique <= 20 else 2 if 2 <= r.unique <= 50 else 0
        return size - 10 * (r.subtype == "boolean") + 3 * (r.role == "geo") + (r.subtype == "category")

    return max((r for r in roles if r.role in ("dimension", "geo")), key=score, default=None)


# ---- frequencies -----------------------------------------------------------------------------------------------------


def frequencies(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    c = q(column).cast("string")
    return df.where(c.isNotNull() & (c != "")).groupBy(c.alias("label")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(top)


def top_by(df: DataFrame, category: str, number: str, agg: str = "sum", top: int = 10) -> DataFrame:
    c, v = q(category).cast("string"), C.finite(q(number))
    value = {"sum": exact_sum(q(number)), "mean": F.avg(v), "max": F.max(v), "min": F.min(v)}.get(agg, F.count(v).cast("double"))
    return df.where(c.isNotNull() & (c != "") & v.isNotNull()).groupBy(c.alias("label")).agg(F.round(value, 4).alias("value")).orderBy(F.desc("value"), "label").limit(top)
