"""Pairwise-complete correlations of many columns by blocked Gram matrices.

With X the values (moved by a column's mean, 0 where missing) and M the mask of what is there, the sums that the
correlation of two columns takes over the rows that have both are entries of M'M, X'M, M'X, (X*X)'M, M'(X*X) and X'X.
Tasks multiply batches of rows, BLOCK by BLOCK columns, and keep one set of partial products for each pair of blocks; the
sets of all tasks are added up a tree of FAN to one.  A task holds products, never a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK, FAN = 64, 32
#: Rows that are multiplied at once.
ROWS = 4096
_PART = "a int, b int, part long, sums array<double>"


def _tasks(width: int):
    edges = [(a, min(a + BLOCK, width)) for a in range(0, width, BLOCK)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(np.float64)
                m = (~np.isnan(x)).astype(np.float64)
                x = np.nan_to_num(x, nan=0.0)
                for i, (a, b) in enumerate(edges):
                    for j, (c, d) in enumerate(edges[i:], i):
                        xa, ma, xb, mb = x[:, a:b], m[:, a:b], x[:, c:d], m[:, c:d]
                        new = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
                        sums[i, j] = sums[i, j] + new if (i, j) in sums else new
        task = TaskContext.get().partitionId()
        yield _rows([(i, j, task, s) for (i, j), s in sums.items()])

    return multiply


def _rows(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = [[p[k] for p in parts] for k in range(3)] + [[p[3].ravel() for p in parts]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["a", "b", "part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one group, in the order of tasks, become one."""
    at, total = None, np.zeros(0)
    for batch in batches:
        for a, b, part, sums in zip(*[batch[c].to_pylist() for c in ("a", "b", "part")], batch["sums"], strict=True):
            if (a, b, part // FAN) != at:
                if at:
                    yield _rows([(*at, total)])
                at, total = (a, b, part // FAN), np.zeros(len(sums))
            total = total + sums.values.to_numpy()
    if at:
        yield _rows([(*at, total)])


def correlations(df: DataFrame, values: dict[str, Column], places: int = 3) -> DataFrame:
    """a, b and r for each ordered pair of named columns; rows complete in the pair count; 0 for a constant or short column."""
    spark, names = df.sparkSession, list(values)
    v = [c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())]
    means = df.agg(*[F.avg(c) for c in v]).first()
    moved = df.select(*[(c - F.lit(m or 0.0)).alias(f"v{i}") for i, (c, m) in enumerate(zip(v, means, strict=True))])
    parts = written(moved.mapInArrow(_tasks(len(names)), _PART))
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:  # one level of the tree
        group = [F.col("a"), F.col("b"), F.expr(f"part div {FAN}").alias("g")]
        parts = written(parts.repartition(*group).sortWithinPartitions("a", "b", "part").mapInArrow(_add, _PART))
        last //= FAN

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sums in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["sums"], strict=True):
                rows, columns = (min(BLOCK, len(names) - k * BLOCK) for k in (a, b))
                n, sx, sy, sxx, syy, sxy = sums.values.to_numpy().reshape(6, rows, columns)
                with np.errstate(all="ignore"):
                    spread = np.maximum(n * sxx - sx * sx, 0) * np.maximum(n * syy - sy * sy, 0)
                    # what rounding leaves of a constant column's spread is none
                    r = np.where((n * sxx - sx * sx > 1e-12 * n * sxx) & (n * syy - sy * sy > 1e-12 * n * syy), (n * sxy - sx * sy) / np.sqrt(spread), 0.0)
                i, j = np.meshgrid(np.arange(rows) + a * BLOCK, np.arange(columns) + b * BLOCK, indexing="ij")
                keep = i < j
                yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(np.clip(r[keep], -1, 1))], ["i", "j", "r"])

    found = parts.mapInArrow(pairs, "i int, j int, r double").select("i", "j", (F.round("r", places) + 0.0).alias("r"))
    named = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    upper = found.select(named("i").alias("a"), named("j").alias("b"), "r")
    own = spark.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, r double")
    return upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(own)
