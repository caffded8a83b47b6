"""Chart datasets: small (label, value) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import olap
from .profile import ColumnType, correlations, q
from .quantiles import exact_quantiles, middle


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, low, high, value: min(15, max(5, ceil(sqrt n))) bins of one width, the last one closed; empty bins count 0."""
    v = C.finite(q(column))
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("n >= 4")
    s = s.withColumn("bins", F.least(F.lit(15), F.greatest(F.lit(5), F.ceil(F.sqrt("n")).cast("int"))))
    s = s.withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    at = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("width"))).cast("int")
    counts = df.select(v.alias("v")).where("v is not null").join(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count("*").alias("value"))
    every = s.select("lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return every.join(counts, "bin", "left").select("bin", F.round(low, 4).alias("low"), F.round(low + F.col("width"), 4).alias("high"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row: the element in place n // 2 (from 0) of the sorted values."""
    split = exact_quantiles(df, {column: C.finite(q(column))}, (0.5,), middle)[column][0]
    return df.sparkSession.createDataFrame([(split,)], "split double")


def median_split(df: DataFrame, column: str) -> DataFrame:
    """Below and at-or-above the upper median."""
    v = C.finite(q(column))
    side = F.when(v < F.col("split"), "Below median").otherwise("Above median")
    return df.where(v.isNotNull()).join(F.broadcast(upper_median(df, column))).groupBy(side.alias("label")).agg(F.count("*").alias("value"))


def line(df: DataFrame, date: str | None, number: str, order: str, first: int = 50) -> DataFrame:
    """Mean per day, or without a date the first records."""
    if date:
        v = C.finite(q(number))
        days = df.where(q(date).isNotNull()).groupBy(F.date_format(q(date), "yyyy-MM-dd").alias("label")).agg(F.sum(v.cast(olap.EXACT)).alias("s"), F.count(v).alias("n"))
        # the mean rounded in whole numbers: half a unit of the fourth place goes away from zero
        micro = F.abs((F.col("s") * 1_000_000).cast("decimal(38,0)"))
        value = F.signum("s") * F.when(F.col("n") > 0, F.call_function("div", 2 * micro + 100 * F.col("n"), 200 * F.col("n"))) / 10_000
        return days.select("label", value.alias("value")).orderBy("label")
    return df.orderBy(order).limit(first).select(q(order).cast("string").alias("label"), C.finite(q(number)).alias("value"))


def scatter(df: DataFrame, x: str, y: str, order: str, first: int = 400) -> DataFrame:
    pair = df.select(q(order).alias("__at"), C.finite(q(x)).alias("x"), C.finite(q(y)).alias("y")).where("x is not null and y is not null")
    return pair.orderBy("__at").limit(first).select("x", "y")


def area(df: DataFrame, numbers: list[str], order: str, first: int = 30) -> DataFrame:
    values = [F.coalesce(C.finite(q(n)), F.lit(0.0)).alias(n) for n in numbers[:4]]
    return df.select(q(order).alias("label"), *values).orderBy("label").limit(first)


def radar(completeness: Column, uniqueness: Column, consistency: Column, richness: Column, volume: Column, density: Column) -> Column:
    axes = zip(("Completeness", "Uniqueness", "Consistency", "Type Richness", "Volume", "Density"), (completeness, uniqueness, consistency, richness, volume, density), strict=True)
    return F.array(*[F.struct(F.lit(n).alias("label"), F.round(v, 1).alias("value")) for n, v in axes])


def quality_radar(scores: DataFrame, density: float) -> DataFrame:
    """label and value of the six axes, from `profile.quality` and the share of filled cells in percent."""
    five = scores.agg(*[F.max(F.when(F.col("dimension") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(("Completeness", "Uniqueness", "Consistency", "Type Richness", "Volume"))])
    return five.select(F.explode(radar(*[F.col(f"v{i}") for i in range(5)], F.lit(density))).alias("x")).select("x.*")


def bundle(df: DataFrame, types: list[ColumnType], order: str) -> dict[str, DataFrame]:
    """All charts that the columns allow."""
    of = lambda *kinds: [t.column for t in types if t.type in kinds]
    numbers, categories, dates = of("integer", "number"), of("category", "boolean"), of("date")
    out: dict[str, DataFrame] = {}
    if categories:
        out["bar"] = olap.top_by(df, categories[0], numbers[0]) if numbers else olap.frequencies(df, categories[0])
        out["doughnut"] = olap.frequencies(df, categories[0], 7)
        out["horizontal_bar"] = olap.frequencies(df, categories[1], 10) if len(categories) > 1 else olap.frequencies(df, categories[0], 15)
    elif len(numbers) >= 2:
        out["doughnut"] = median_split(df, numbers[0])
    if numbers:
        out["line"] = line(df, dates[0] if dates else None, numbers[0], order)
        out["histogram"] = histogram(df, numbers[0])
        out["area"] = area(df, numbers, order)
    if len(numbers) >= 2:
        out["scatter"] = scatter(df, numbers[0], numbers[1], order)
        out["heatmap"] = correlations(df, numbers)
    return out
