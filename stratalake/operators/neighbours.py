"""An inverted file over vectors: approximate nearest neighbours by cells, with exact scores.

Cells are the unit centroids of spherical k-means on a sample of at most SAMPLE vectors; every row of the table is filed
under its nearest centroid, in a written table.  A query looks into the cells nearest to it and scores their rows exactly.
How many cells, is measured when the index is fitted: the fewest with which sampled queries find `recall` of their true
neighbours among the sample.  Where vectors have no structure that is nearly all of them, and the search is no cheaper
than the exact one (`retrieval.nearest`).

Rows and queries of a cell meet in blocks of PACK rows; a large cell is dealt to as many tasks as it has SHARE rows, and
its queries are copied to each, so no task holds a cell.  Null and zero vectors have no neighbours and are nobody's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import vectors_of

SAMPLE, ROUNDS, PACK, SHARE = 16_384, 12, 256, 50_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids_of(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = unit_rows(sums[full])
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells in which up to 200 sampled queries find `recall` of their k nearest among the sample."""
    asked = x[:: max(1, len(x) // 200)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    places = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell, seen from a query
    needed = np.sort(np.take_along_axis(places, (x @ c.T).argmax(1)[near], axis=1).ravel()) + 1
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])


@dataclass
class Index:
    cells: np.ndarray
    probes: int
    table: DataFrame  # cell, key, unit vector
    key: str

    def _spread(self, df: DataFrame, vector: str, count: int, names: list[str]) -> DataFrame:
        """(cell, key, unit vector) for the `count` nearest cells of each row."""
        cells, kind = self.cells, df.schema[self.key].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = vectors_of(part.column(1))
                    x = np.pad(x, ((0, 0), (0, max(0, cells.shape[1] - x.shape[1]))))[:, : cells.shape[1]]
                    x = unit_rows(x)
                    rows = np.flatnonzero(np.isfinite(x).all(1))
                    near = np.argsort(-(x[rows] @ cells.T), axis=1, kind="stable")[:, :count]
                    keys = part.column(0).take(pa.array(np.repeat(rows, near.shape[1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(near.size + 1) * cells.shape[1], pa.int32()), pa.array(np.repeat(x[rows], near.shape[1], axis=0).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), keys, lists], names)

        return df.select(self.key, vector).mapInArrow(place, f"{names[0]} int, `{names[1]}` {kind}, {names[2]} array<double>")

    def search(self, queries: DataFrame, k: int = 5, vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """query_id, key and score of the k best rows in the cells nearest to each query (ties: by key)."""
        asked = written(self._spread(queries, vector, probes or self.probes, ["cell", "query_id", "q"]))
        parts = self.table.groupBy("cell").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"), F.count("*").alias("rows"))
        rows = self.table.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(self.key), F.col("parts")).cast("int")).withColumn("packs", F.ceil(F.col("rows") / F.col("parts") / PACK))
        sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / PACK).alias("packs"))
        wanted = asked.join(parts, "cell").join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def pack(df: DataFrame, key: str, v: str, names: tuple[str, str]) -> DataFrame:
            """Some PACK rows of a cell's part beside each other."""
            some = df.groupBy("cell", "part", F.pmod(F.xxhash64(key, F.lit(1)), F.col("packs")).alias("g")).agg(F.collect_list(F.struct(key, v)).alias("x"))
            return some.select("cell", "part", F.col(f"x.{key}").alias(names[0]), F.flatten(f"x.{v}").alias(names[1]))

        met = pack(rows, self.key, "v", ("ids", "data")).join(pack(wanted, "query_id", "q", ("qids", "qdata")), ["cell", "part"])
        own, width, kinds = self.key, self.cells.shape[1], [dict(asked.dtypes)["query_id"], dict(self.table.dtypes)[self.key]]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, data, qids, qdata in zip(*[batch[c] for c in ("ids", "data", "qids", "qdata")], strict=True):
                    s = qdata.values.to_numpy().reshape(-1, width) @ data.values.to_numpy().reshape(-1, width).T
                    names = ids.values.to_numpy(zero_copy_only=False)
                    order = np.argsort(names, kind="stable")
                    s = np.round(s, 6)[:, order]
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [qids.values.take(pa.array(np.repeat(np.arange(len(s)), top.shape[1]))), ids.values.take(pa.array(order[top.ravel()])), pa.array(np.take_along_axis(s, top, 1).ravel())], ["query_id", own, "score"]
                    )

        found = met.select("ids", "data", "qids", "qdata").mapInArrow(score, f"query_id {kinds[0]}, `{self.key}` {kinds[1]}, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, k: int = 5, recall: float = 0.95, seed: int = 7) -> Index:
    """The index of a whole table; sqrt(rows) cells, 16 to 1024, if not told."""
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = vectors.select(vector) if share == 1 else vectors.select(vector).sample(share, seed=seed)
    x = some.where(F.col(vector).isNotNull()).limit(SAMPLE).toArrow()[vector].combine_chunks()
    x = unit_rows(vectors_of(x)) if len(x) else np.zeros((0, 1))
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        x = np.eye(1, x.shape[1])
    cells = min(len(x), cells or int(min(1024, max(16, n**0.5))))
    centroids = centroids_of(x, cells)
    index = Index(centroids, probes_for(x, centroids, k, recall), vectors, key)
    index.table = written(index._spread(vectors, vector, 1, ["cell", key, "v"]))
    return index


def recall_of(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the exact neighbours that were found."""
    both = exact.join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
