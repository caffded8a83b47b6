"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without the setting (a test) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="stratalake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if hasattr(df, "_buckets"):
        return _save_buckets(df, f"spark_catalog.default.stash_{uuid.uuid4().hex}", path, "error")
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash = path
    return back


def bucketed(df: DataFrame, by: str, into: int) -> DataFrame:
    """`df`, to be stashed in buckets of `by`: rows stay in their tasks, and grouping what is read back by `by` moves nothing."""
    df._buckets = (into, by)
    return df


def _save_buckets(df: DataFrame, name: str, path: str, mode: str) -> DataFrame:
    df.write.option("compression", "zstd").bucketBy(*df._buckets).mode(mode).saveAsTable(name, format="parquet", path=path)
    df.sparkSession.catalog.refreshTable(name)
    back = df.sparkSession.table(name)
    back._stash, back._table = path, name
    return back


def extend(stashed: DataFrame, df: DataFrame) -> DataFrame:
    """A table that `stash` wrote in buckets, with the rows of `df` (in such buckets, too) added to it."""
    return _save_buckets(df, stashed._table, stashed._stash, "append")


def unlist(*stashes: DataFrame) -> None:
    """Take tables in buckets out of the catalogue; their files stay, and frames read on."""
    for df in stashes:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")


def forget(*stashes: DataFrame) -> None:
    """Delete tables that `stash` gave, once no frame reads them any more."""
    for df in stashes:
        if hasattr(df, "_table"):
            unlist(df)
        _delete(df.sparkSession, df._stash)
        _written.remove((df.sparkSession, df._stash))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What `stash` wrote and nobody forgot: deleted when the driver ends.
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


@contextlib.contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Inside, files are split among tasks in the same way every time, even if executors come or go."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the input's columns that carry (in any case) a name that an operator is about to give."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def row_hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number from 0 without gaps, in no particular order.

    Places inside partitions are written first; only a count for each partition comes to the driver.
    """
    at = F.monotonically_increasing_id()
    placed = stash(df.select("*", F.shiftright(at, 33).alias("_p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    starts, total = [], 0
    for p, n in sorted(placed.groupBy("_p").count().collect()):
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _o long")
    return placed.join(offsets, "_p").select(*[f"`{c}`" for c in df.columns], (F.col("_o") + F.col("_i")).alias(name))


def pieces(total: int, each: int) -> int:
    return max(1, -(-int(total) // int(each)))


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) but the roots: root is the smallest node that links reach.

    `edges` is read several times: a written table.

    Alternating star contraction: every round is a few joins and groupings on node ids, so a star of
    any size is one pre-aggregated group; rounds grow with the logarithm of the graph.
    """
    pairs, last = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), []
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every neighbour above a node goes to the node's smallest neighbour
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        pairs = stash(small)
        forget(*last)
        last = [pairs]
        # settled once all are stars: a node hangs on one node, and nothing hangs on it
        ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
