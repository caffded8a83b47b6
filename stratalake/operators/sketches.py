"""Profiles that merge: counts and sketches of each column, kept day by day, and summed up without reading the rows again.

Distinct values are counted by a HyperLogLog sketch of 2**LOG bytes (standard error 1.04 / sqrt(2**LOG), 0.8 %), order
statistics by a KLL sketch of SIZE (ranks within about 0.2 %); counts, sums, least and greatest are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .profile import is_blank, q

LOG, SIZE = 14, 2048


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """A row for each column: rows, nulls, sum, min, max and the two sketches; one scan."""
    each = []
    for i, n in enumerate(names):
        v, text = C.finite(q(n)) if dict(df.dtypes)[n] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz") else F.lit(None).cast("double"), q(n).cast("string")
        each.append(
            F.struct(
                F.lit(n).alias("column"), F.count("*").alias("rows"), F.count_if(is_blank(q(n))).alias("nulls"), F.sum(v.cast("decimal(28,6)")).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"),
                F.hll_sketch_agg(F.when(~is_blank(q(n)), text), F.lit(LOG)).alias("distinct"), F.kll_sketch_agg_double(v, F.lit(SIZE)).alias("order"),
            ).alias(f"c{i}")
        )
    return df.agg(*each).select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))


def merged(profiles: DataFrame) -> DataFrame:
    """One row for each column from the rows of many profiles."""
    return profiles.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls")], F.sum("sum").cast("decimal(38,6)").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("order").alias("order"),
    )


def described(profiles: DataFrame) -> DataFrame:
    """column, rows, nulls, sum, mean, min, max, unique (estimated), q1, median and q3 (estimated; null without numbers)."""
    at = F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("order", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    numbers = F.when(F.col("min").isNotNull(), F.kll_sketch_get_n_double("order"))
    told = profiles.withColumn("at", at).withColumn("n", numbers)
    total = F.col("sum").cast("double")
    return told.select("column", "rows", "nulls", total.alias("sum"), F.round(F.try_divide(total, F.col("n")), 4).alias("mean"), "min", "max", F.hll_sketch_estimate("distinct").alias("unique"), F.get("at", 0).alias("q1"), F.get("at", 1).alias("median"), F.get("at", 2).alias("q3"))


def keep(df: DataFrame, names: list[str], path: str, day: str) -> None:
    """The profile of one day's rows in a folder of its own; a repeated day overwrites itself."""
    profile(df, names).write.mode("overwrite").parquet(f"{path}/day={day}")


def kept(df: DataFrame, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The merged profile of the days from `first` to `last`; `df` gives the session."""
    days = df.sparkSession.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return merged(days.where(F.col("day").between(F.lit(first or ""), F.lit(last or "￿"))).drop("day"))
