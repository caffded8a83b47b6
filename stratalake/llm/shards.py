"""Sharding: a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash and counts each bucket.
Pass 2 brings each bucket together and deals its records by a Fisher-Yates permutation drawn from the same
seed; `write_shards` writes them.  A bucket's first global place is the sum of the counts before it, so places are
gapless; place p goes to shard p % shards as slot p // shards, hence shard sizes are at most one apart (the law
`rows`).

A bucket is full at `bucket_bytes` or `bucket_rows`, whatever comes first.  The deck of a permutation is kept as
about sqrt(n) blocks of sqrt(n) places, so a swap rewrites two blocks and not the deck.  Rows that agree in doc_id
and text and are over `hot_rows` many are numbered, from a count, and scattered by number, else their common hash would put
them into one bucket; whichever of them has a number, the same places are theirs, and no other row moves.

Nulls: a null text has no bytes, a null doc_id hashes as any value.  Repeated rows stay as many rows.  An
empty table gives an empty result.  Columns of the input called like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, row_hash, stash, without

#: Buckets whose counts are summed at a time when places are found.
SPAN = 1024


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """array<int>: a permutation of 0..n-1; step k (n-1 down to 1) swaps k with a seeded draw from 0..k."""
    wide = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def swapped(w: Column) -> Column:
        draws = F.transform(steps, lambda k: F.struct(k.alias("k"), F.pmod(row_hash(seed, bucket, k), k + 1).cast("int").alias("j")))
        starts = F.sequence(F.lit(0), n - 1, w)
        deck = F.transform(starts, lambda at: F.sequence(at, F.least(at + w, n) - 1))

        def swap(blocks: Column, d: Column) -> Column:
            block = lambda x: F.floor(x / w).cast("int")
            value = lambda x: F.get(F.get(blocks, block(x)), x % w)
            changed = lambda own, i: F.transform(own, lambda x, at: F.when(i * w + at == d["k"], value(d["j"])).when(i * w + at == d["j"], value(d["k"])).otherwise(x))
            return F.transform(blocks, lambda own, i: F.when((i == block(d["k"])) | (i == block(d["j"])), changed(own, i)).otherwise(own))

        return F.flatten(F.aggregate(draws, deck, swap))

    return F.get(F.transform(F.array(wide), swapped), F.lit(0))


def _numbered(keyed: DataFrame) -> DataFrame:
    """The rows with `__number`: hot rows of one `__own` from 0 on, without gaps; only a count of each task's is dealt."""
    placed = stash(keyed.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    hot = placed.where("__n is not null")
    sizes = hot.groupBy("__own", "__p").agg(F.count("*").alias("__size"))
    before = sizes.select("__own", "__p", (F.sum("__size").over(Window.partitionBy("__own").orderBy("__p")) - F.col("__size")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__own", "__p").orderBy("__i")) - 1
    hot = hot.withColumn("__at", at).join(before, ["__own", "__p"]).withColumn("__number", F.col("__at") + F.col("__before")).drop("__at", "__before")
    return hot.unionByName(placed.where("__n is null").withColumn("__number", F.lit(None).cast("long"))).drop("__p", "__i")


def shuffle_shards(df: DataFrame, shards: int = 40, seed: int = 20240229, bucket_bytes: int = 8 << 20, bucket_rows: int = 8192, hot_rows: int = 2048) -> DataFrame:
    """Every row of `df` with `size` (bytes of text + 16), `shard` and `slot`."""
    df = without(df, "size", "shard", "slot", "__own", "__bucket", "__nth", "__place", "__n", "__deck", "__first")
    df = df.withColumn("size", text_bytes(F.col("text")) + 16)
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    buckets = max(pieces(total["b"], bucket_bytes), pieces(total["n"], bucket_rows))
    keyed = df.withColumn("__own", row_hash(seed, F.col("doc_id"), F.col("text")))
    hot = keyed.groupBy("__own").agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select("__own", F.lit(1).alias("__n"))
    n_hot = hot.count()
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= 1_000_000 else hot, "__own", "left")
        own = F.when(F.col("__n").isNull(), F.col("__own")).otherwise(row_hash(seed + 2, F.col("__own"), F.col("__number")))
        # written, as the number of a row must not change between the two passes
        scattered = stash(_numbered(keyed).withColumn("__bucket", F.pmod(own, F.lit(buckets))).drop("__own", "__n", "__number"))
    else:
        scattered = keyed.withColumn("__bucket", F.pmod("__own", F.lit(buckets))).drop("__own")

    counts = scattered.groupBy("__bucket").agg(F.count("*").cast("int").alias("__n"))
    spans = counts.groupBy(F.expr(f"__bucket div {SPAN}").alias("span")).agg(F.sum("__n").alias("n"))
    before = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("span").orderBy("__bucket")
    places = (
        counts.withColumn("span", F.expr(f"__bucket div {SPAN}"))
        .withColumn("at", F.sum("__n").over(inside) - F.col("__n"))
        .join(before, "span")
        .repartition(pieces(buckets, 4), "__bucket")  # the decks weigh far more than the counts that AQE would coalesce
        .select("__bucket", (F.col("at") + F.col("base")).alias("__first"), fisher_yates(F.col("__n"), F.col("__bucket"), seed).alias("__deck"))
    )
    nth = Window.partitionBy("__bucket").orderBy(F.col("doc_id"), row_hash(seed + 1, F.col("text")))
    placed = scattered.withColumn("__nth", F.row_number().over(nth)).join(places, "__bucket")
    place = F.col("__first") + F.get("__deck", F.col("__nth") - 1)
    return (
        placed.withColumn("__place", place)
        .withColumn("shard", (F.col("__place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__place div {shards}").cast("long"))
        .drop("__bucket", "__nth", "__place", "__first", "__deck")
    )


def write_shards(sharded: DataFrame, path: str, shards: int = 40, files_per_shard: int = 1) -> None:
    """Write one folder per shard; within a file rows follow slots, and files of a shard hold ranges of slots in order."""
    (
        sharded.repartitionByRange(shards * files_per_shard, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )


def op2_sharding(docs: DataFrame) -> DataFrame:
    return shuffle_shards(docs.select("doc_id", "text")).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
