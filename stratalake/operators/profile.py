"""Type inference and describe-style profiles: one aggregation for all columns, small frames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed
from . import gram
from .quantiles import exact_quantiles, quantiles_and

#: Columns whose pairs are so few that one aggregation takes them all.
FEW = 12


@dataclass(frozen=True)
class ColumnType:
    column: str
    type: str
    confidence: float


def q(name: str) -> Column:
    """A column by its literal name."""
    return F.col(f"`{name.replace('`', '``')}`")


def infer_types(df: DataFrame, exact_distinct: bool = True, categories: bool = True) -> list[ColumnType]:
    """Semantic type of each column, from one job over all rows.  Typed columns need no text rules.

    Without `categories` repeated texts are text: as a category may have half as many values as the table has rows, a
    text column becomes one when the table grows by rows alone.
    """
    aggs = []
    for i, f in enumerate(df.schema.fields):
        if not isinstance(f.dataType, T.StringType):
            none = F.lit(0).cast("long")
            aggs.append(F.struct(F.count(q(f.name)).alias("n"), *[none.alias(x) for x in ("booleans", "dates", "numbers", "integers", "unique")]).alias(f"c{i}"))
            continue
        c = F.col(f"__s{i}")
        number = F.col(f"__n{i}")
        count = lambda cond, c=c: F.count(F.when(c.isNotNull() & cond, 1))
        aggs.append(
            F.struct(
                F.count(c).alias("n"),
                count(C.to_boolean(c).isNotNull()).alias("booleans"),
                count(C.to_day(c).isNotNull()).alias("dates"),
                count(number.isNotNull()).alias("numbers"),
                count(number == F.floor(number)).alias("integers"),
                (F.lit(0).cast("long") if exact_distinct else F.approx_count_distinct(F.lower(c))).alias("unique"),
            ).alias(f"c{i}")
        )
    texts = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    read = df.withColumns({f"__s{i}": C.without_nullish(q(n)) for i, n in texts}) if texts else df
    read = read.withColumns({f"__n{i}": C.to_number(F.col(f"__s{i}")) for i, _ in texts}) if texts else read
    row = read.agg(*aggs).first()
    unique = distinct_counts(read, {i: F.col(f"__s{i}") for i, _ in texts}) if exact_distinct and texts else {}
    return [decide_type(f, **row[f"c{i}"].asDict() | ({"unique": unique[i]} if i in unique else {}), categories=categories) for i, f in enumerate(df.schema.fields)]


def distinct_counts(df: DataFrame, columns: dict[int, Column]) -> dict[int, int]:
    """Distinct non-null values of each text column, case aside: one row for a (column, hash) pair, not one for a column and row."""
    pairs = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(F.lower(c)).alias("h"))) for i, c in columns.items()]), lambda x: x.isNotNull())
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").distinct().groupBy("i").agg(F.count("*").alias("n"))
    return dict.fromkeys(columns, 0) | {r["i"]: r["n"] for r in counts.collect()}


def decide_type(field: T.StructField, n: int, booleans: int, dates: int, numbers: int, integers: int, unique: int, categories: bool = True) -> ColumnType:
    kind = field.dataType
    if not n:
        return ColumnType(field.name, "empty", 1.0)
    if isinstance(kind, T.BooleanType):
        return ColumnType(field.name, "boolean", 1.0)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return ColumnType(field.name, "date", 1.0)
    if isinstance(kind, T.IntegralType):
        return ColumnType(field.name, "integer", 1.0)
    if isinstance(kind, T.NumericType):
        return ColumnType(field.name, "number", 1.0)
    if booleans / n >= 0.9 and n >= 2:
        return ColumnType(field.name, "boolean", booleans / n)
    if dates / n >= 0.8:
        return ColumnType(field.name, "date", dates / n)
    if numbers / n >= 0.85:
        return ColumnType(field.name, "integer" if integers == n else "number", numbers / n)
    if unique >= 0.9 * n and n >= 5:
        return ColumnType(field.name, "identifier", 0.7)
    if categories and 1 < unique <= max(15, -(-n // 2)):
        return ColumnType(field.name, "category", 0.75)
    return ColumnType(field.name, "text", 0.5)


def _each(df: DataFrame, names: list[str], values) -> DataFrame:
    """A row for each column from one aggregation: `values(column, name)` gives named aggregates."""
    if not names:
        raise ValueError("no columns to describe")
    wide = df.agg(*[F.struct(F.lit(n).alias("column"), *values(q(n), n)).alias(f"c{i}") for i, n in enumerate(names)])
    return wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("x")).select("x.*")


def describe_numeric(df: DataFrame, names: list[str], places: int = 4, accuracy: int | None = None) -> DataFrame:
    """count, mean, median, stddev, min, max, q1, q3, sum, range; exact quantiles unless an accuracy is given."""

    v = {n: C.finite(q(n)) for n in names}
    stats = [F.struct(F.lit(n).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c.cast("decimal(28,6)")).cast("double").alias("sum")).alias(f"d{i}") for i, (n, c) in enumerate(v.items())]
    if not names:
        raise ValueError("no columns to describe")
    if accuracy is None:
        at, row = quantiles_and(df, v, (0.25, 0.5, 0.75), stats)
    else:
        row = df.agg(*stats, *[F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(f"p{i}") for i, c in enumerate(v.values())]).first()
        at = {n: row[f"p{i}"] or [None] * 3 for i, n in enumerate(v)}
    kind = "column string, count long, mean double, stddev double, min double, max double, sum double, q1 double, median double, q3 double"
    told = df.sparkSession.createDataFrame([(*row[f"d{i}"], *at[n]) for i, n in enumerate(names)], kind)
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), places)
    return told.select("column", "count", *[r(F.col(c)).alias(c) for c in ("mean", "median", "stddev", "min", "max", "q1", "q3", "sum")], r(F.col("max") - F.col("min")).alias("range"))


def describe_dates(df: DataFrame, names: list[str]) -> DataFrame:
    def values(c: Column, _: str) -> list[Column]:
        d = c.cast("date")
        return [F.count(d).alias("count"), F.min(d).alias("min"), F.max(d).alias("max"), F.datediff(F.max(d), F.min(d)).alias("span_days")]

    return _each(df, names, values)


def describe_categories(df: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    """column, cardinality, value, n and rank of the most frequent values (ties: by value)."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    counts = pairs.where("value is not null and value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    # the rank alone is a window, so that each task keeps its first `top` values before they are dealt by column
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
    size = counts.groupBy("column").agg(F.count("*").alias("cardinality"))  # a row for each column
    return ranked.join(F.broadcast(size), "column").select("column", "cardinality", "value", "n", "rank")


def null_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """column, nulls, rows and null_pct."""
    names = names or df.columns
    values = lambda c, _: [F.count(F.when(is_blank(c), 1)).alias("nulls"), F.count("*").alias("rows"), F.round(F.coalesce(F.try_divide(F.count(F.when(is_blank(c), 1)), F.count("*")), F.lit(0.0)) * 100, 2).alias("null_pct")]
    return _each(df, names, values)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def correlations(df: DataFrame, names: list[str], places: int = 3) -> DataFrame:
    """a, b and r for each ordered pair of columns; rows complete in the pair count; 0 for a constant or short column.

    Up to FEW columns are one aggregation of all pairs; more go by blocked matrix products, with equal results.
    """
    v = {n: C.finite(q(n)) for n in names}
    if len(names) > FEW:
        return gram.correlations(df, v, places)
    aggs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = v[a].isNotNull() & v[b].isNotNull()
            x, y = F.when(both, v[a]), F.when(both, v[b])
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(F.coalesce(r, F.lit(0.0)), places) + 0.0).alias("r")))
    own = [F.struct(F.lit(n).alias("a"), F.lit(n).alias("b"), F.lit(1.0).alias("r")) for n in names]
    wide = df.agg(F.array(*aggs, *own).alias("pairs")) if aggs else df.agg(F.count("*")).select(F.array(*own).alias("pairs"))
    pairs = wide.select(F.explode("pairs").alias("p")).select("p.*")
    return pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def strong_pairs(matrix: DataFrame, least: float = 0.4, top: int = 8) -> DataFrame:
    strength = F.when(F.abs("r") >= 0.7, "strong").otherwise("moderate").alias("strength")
    return matrix.where((F.col("a") < F.col("b")) & (F.abs("r") >= least)).select("a", "b", "r", strength).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def iqr_fences(df: DataFrame, names: list[str]) -> DataFrame:
    """column, low, high: beyond them a value is an outlier; null with fewer than four values."""

    at = exact_quantiles(df, {n: C.finite(q(n)) for n in names}, (0.25, 0.75))

    def values(c: Column, name: str) -> list[Column]:
        low, high = (F.lit(x).cast("double") for x in at[name])
        some = F.count(C.finite(c)) >= 4
        return [F.when(some, low - 1.5 * (high - low)).alias("low"), F.when(some, high + 1.5 * (high - low)).alias("high")]

    return _each(df, names, values)


def outlier_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column and n, the values beyond its fences (0 without fences)."""
    fences = {r["column"]: r for r in iqr_fences(df, names).collect()}

    def values(c: Column, name: str) -> list[Column]:
        low, high = (F.lit(fences[name][k]).cast("double") for k in ("low", "high"))
        return [F.count(F.when((C.finite(c) < low) | (C.finite(c) > high), 1)).alias("n")]

    return _each(df, names, values)


def outliers(df: DataFrame, names: list[str], order: str, samples: int = 10) -> DataFrame:
    """column, n, low, high and the first outlying values (in `order`)."""
    fences = F.broadcast(iqr_fences(df, names))
    pairs = df.select(F.col(order).alias("__at"), F.explode(F.array(*[F.struct(F.lit(n).alias("column"), C.finite(q(n)).alias("value")) for n in names])).alias("x")).select("__at", "x.*")
    out = pairs.join(fences, "column").where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    ranked = out.withColumn("__n", F.row_number().over(Window.partitionBy("column").orderBy("__at", "value")))
    first = ranked.where(F.col("__n") <= samples).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "value"))), lambda x: x["value"]).alias("samples"))
    return out.groupBy("column", "low", "high").agg(F.count("*").alias("n")).join(first, "column")


def quality_scores(rows: Column, cells: Column, null_cells: Column, duplicates: Column, weak_columns: Column, typed: Column, columns: Column) -> Column:
    """array<struct<dimension,weight,value,contribution>> from scalar columns."""
    per = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100
    values = {
        "Completeness": 100 - per(null_cells, cells),
        "Uniqueness": 100 - per(duplicates, rows),
        "Consistency": 100 - per(weak_columns, columns),
        "Type Richness": per(typed, columns),
        "Volume": F.log10(rows + 1) / 5 * 100,
    }
    bounded = {k: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)) for k, v in values.items()}
    return F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit(w).alias("weight"), bounded[k].alias("raw")) for k, w in fixed.QUALITY_WEIGHTS.items()])


def quality(df: DataFrame, types: list[ColumnType] | None = None, legacy_uniqueness: bool = False) -> DataFrame:
    """dimension, weight, value, contribution and score, a row for each dimension, of the frame as it stands.

    Duplicates are rows beyond the first of equal normalised rows; `legacy_uniqueness` counts none.
    """
    types = types or infer_types(df)
    names = df.columns
    typed = sum(t.type in ("integer", "number", "category", "boolean", "date") for t in types)
    blanks = [F.count(F.when(is_blank(q(n)), 1)).alias(f"b{i}") for i, n in enumerate(names)]
    key = F.xxhash64(F.array(*[F.lower(F.trim(F.coalesce(q(n).cast("string"), F.lit("")))) for n in names]))
    s = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), *blanks).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("dups"), *[F.sum(f"b{i}").alias(f"b{i}") for i in range(len(names))])
    b = [F.col(f"b{i}") for i in range(len(names))]
    weak = reduce(lambda x, y: x + y, [F.when(F.try_divide(x, F.col("rows")) > 0.5, 1).otherwise(0) for x in b])
    dups = F.lit(0) if legacy_uniqueness else F.col("dups")
    scores = quality_scores(F.col("rows"), F.col("rows") * len(names), reduce(lambda x, y: x + y, b), dups, weak, F.lit(typed), F.lit(len(names)))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x["weight"] * x["raw"])
    out = s.select(F.round(total).cast("long").alias("score"), F.explode(scores).alias("x"))
    return out.select("x.dimension", "x.weight", F.round("x.raw", 1).alias("value"), F.round(F.col("x.weight") * F.col("x.raw"), 1).alias("contribution"), "score")


def quality_band(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").otherwise("Needs Work")


def share_band(share: Column) -> Column:
    return F.when(share > 30, "high").when(share > 10, "mid").otherwise("low")


def null_tone(null_pct: Column) -> Column:
    return F.when(null_pct < 5, "good").when(null_pct < 20, "warn").otherwise("bad")


def duplicate_tone(duplicates: Column) -> Column:
    return F.when(duplicates == 0, "good").otherwise("warn")


def sampled_columns(df: DataFrame, first: int = 50) -> dict[str, list[str]]:
    """numeric and category columns by the first rows alone: over 60 % numbers; 2 to 30 values of which one is no number."""
    sample = df.limit(first)
    texts = {c: C.without_nullish(q(c).cast("string")) for c in df.columns}
    some = [F.struct(F.count(t).alias("n"), F.count(C.to_number(t)).alias("numbers"), F.size(F.collect_set(t)).alias("unique")).alias(f"c{i}") for i, t in enumerate(texts.values())]  # of `first` rows
    row = sample.agg(*some).first()
    stats = {c: row[f"c{i}"] for i, c in enumerate(df.columns)}
    return {
        "numeric": [c for c, s in stats.items() if s["n"] and s["numbers"] / s["n"] > 0.6],
        "category": [c for c, s in stats.items() if 2 <= s["unique"] <= 30 and s["numbers"] < s["n"]],
    }
