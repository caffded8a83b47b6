"""Tables stored in order: ranks, running totals and pages without a window over all rows.

Rows are dealt by ranges of the order, each range is written as a partition of its own, and a row for each partition
(size, totals) is all that comes to the driver.  A rank or a running total is what the partitions before hold and a window
inside one partition; a page reads the partitions that it touches.  The order should tell rows apart: rows that it does
not tell apart lie in one partition.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

PART = "_part"


@dataclass
class Stored:
    table: DataFrame  # the rows with PART
    order: list[Column | str]
    ends: list[tuple[int, int]]  # of each partition with rows, in order: its number, and the rows up to its end

    @property
    def rows(self) -> int:
        return self.ends[-1][1] if self.ends else 0

    def _before(self, totals: dict[int, object], kind: str) -> DataFrame:
        rows = [(p, str(x)) for p, x in totals.items()]  # one for each partition
        return F.broadcast(self.table.sparkSession.createDataFrame(rows, f"{PART} int, __before string").withColumn("__before", F.col("__before").cast(kind)))

    def ranked(self, name: str = "rank") -> DataFrame:
        """The rows with their place from 1."""
        before = {p: end - size for (p, end), size in zip(self.ends, self._sizes(), strict=True)}
        at = F.row_number().over(Window.partitionBy(PART).orderBy(*self.order))
        return self.table.withColumn(name, at).join(self._before(before, "long"), PART).withColumn(name, F.col(name) + F.col("__before")).drop("__before")

    def _sizes(self) -> list[int]:
        return [end - start for (_, end), start in zip(self.ends, [0, *[e for _, e in self.ends]], strict=False)]

    def running(self, values: dict[str, Column]) -> DataFrame:
        """The rows with the total of each decimal or whole value up to and with the row; a null adds nothing."""
        kinds = dict(self.table.select(*[F.sum(v).alias(n) for n, v in values.items()]).dtypes)
        totals = self.table.groupBy(PART).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in values.items()]).collect()
        totals = {r[PART]: r for r in totals}
        out, up = self.table, Window.partitionBy(PART).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({n: F.coalesce(F.sum(v).over(up), F.lit(0)) for n, v in values.items()})
        for n in values:
            before, sums = {}, 0
            for p, _ in self.ends:
                before[p] = sums
                sums += totals[p][n]
            out = out.join(self._before(before, kinds[n]), PART).withColumn(n, (F.col(n) + F.col("__before")).cast(kinds[n])).drop("__before")
        return out

    def page(self, number: int, size: int = 50) -> DataFrame:
        """Page `number` from 0 (a number beyond the last gives the last), from the partitions that hold its rows."""
        last = max(0, -(-self.rows // size) - 1)
        start = min(max(number, 0), last) * size
        ends = [e for _, e in self.ends]
        first, final = bisect_right(ends, start), bisect_right(ends, min(start + size, self.rows) - 1)
        skipped = ends[first - 1] if first else 0
        parts = [p for p, _ in self.ends[first : final + 1]]
        return self.table.where(F.col(PART).isin(parts)).orderBy(*self.order).offset(start - skipped).limit(size).drop(PART)


def stored(df: DataFrame, order: list[Column | str], parts: int | None = None) -> Stored:
    """`df` written in order, in `parts` ranges (the session's shuffle partitions if not given)."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    table = written(dealt, by=PART)
    ends, at = [], 0
    for p, n in sorted(table.groupBy(PART).count().collect()):  # a row for each partition
        at += n
        ends.append((p, at))
    return Stored(table, order, ends)
