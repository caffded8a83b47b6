"""The batch operators over streams: running period totals with late data, and any operator on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import columns as C
from ..operators import olap


def period_totals(stream: DataFrame, measure: str, time: str, window: str = "30 days", late: str = "1 day") -> DataFrame:
    """start, end, sum and count of each window of event time; events later than `late` are past it."""
    v = C.finite(F.col(measure)).cast("decimal(28,6)")
    by = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return by.agg(F.sum(v).cast("double").alias("sum"), F.count(v).alias("count")).select("w.start", "w.end", "sum", "count")


def day_totals(stream: DataFrame, measure: str, time: str, late: str = "1 day") -> DataFrame:
    """day, sum (exact) and count of each day of event time; days are the parts of which calendar periods are made."""
    v = C.finite(F.col(measure)).cast(olap.EXACT)
    by = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"))
    return by.agg(F.sum(v).alias("sum"), F.count(v).alias("count")).select(F.col("w.start").alias("day"), "sum", "count")


def keep_days(totals: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Runs a stream of day totals over all that is there now: the last state of each day, and the rows that came too late.

    Every micro-batch writes the days that it changed into a folder of its own, so a batch that is repeated after a failure
    overwrites itself; `path` also holds the checkpoint.
    """
    put = each_batch(totals, lambda df: df, f"{path}/days").outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
    query = put.trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    schema = totals.schema.add("batch", "long")
    days = totals.sparkSession.read.schema(schema).parquet(f"{path}/days")
    last = days.groupBy("day").agg(F.max_by(F.struct("sum", "count"), "batch").alias("x")).select("day", "x.sum", "x.count")
    return last, late


def periods_of_days(days: DataFrame, granularity: str = "month") -> DataFrame:
    """period, value, previous, delta and growth_pct from day totals, as `olap.period_over_period` gives them from rows."""
    sums = days.where("count > 0").groupBy(olap.period_key(F.col("day"), granularity).alias("period")).agg(F.sum("sum").cast("double").alias("value"))
    return olap.over_previous(sums)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Writes the operator's result of every micro-batch under `path`, a folder for each, so that a repeated batch overwrites itself."""

    def put(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put)
