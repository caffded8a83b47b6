"""Mixing sources to target weights by pivotal dependent rounding.

Sources share all words by weight (1, 2, 3 and again, in code point order, null last); a source's target stops
at `most` times its words and the excess goes to the others by weight.  A document of a source then has the
expected copies target / words: a whole part and a fraction.  The fractions are rounded by the pivotal method on
words: where two meet, words move at random from one to the other, so that the words taken together stay and each
one's expected copies stay, until one is at 0 or 1; the one left fractional goes on.

Documents meet documents of like size (a class for each power of two), in parallel in blocks and in order of size; what is
left of each block goes up a tree of a fixed fan-in, so no task sees more than a block or a node's children, and sources of
any size go the same way.  Classes go in WAVES, the large ones first: those that hold the upper half of a source's words,
then the upper half of the rest, and so on.  One document at most is left of each class of a wave.  These are rounded from
the largest on: what a document gives or takes is spread over the smaller ones that are left and over all documents of the
later waves, so words and expected copies stay; one that they cannot make up for goes to the side nearer to the target.
So a source misses its target by a part of a small document, unless a few documents outweigh all others.

Draws come from a hash of the row and a seed, and blocks from counts and hashes, so reruns agree.  Equal rows are
counted, then numbered, and so fall into different blocks.  A null text has no words and adds none; a null source is
a source; repeated rows are rows of their own.  Other columns pass through `mix` unchanged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, forget, pieces, row_hash, stash

FAN_IN, WAVES = 64, 4
#: Equal rows that are numbered in one place.
CHUNK = 1024
SEED = 7919


def row_tie(seed: int) -> Column:
    return row_hash(seed, F.col("doc_id"), F.col("text"), F.col("source"))


def sized_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, tie (of the row) and n, the number of rows equal in these."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_tie(seed).alias("tie"))
    return rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """A row for each of the n equal rows, with a draw of its own; many equal rows are dealt to tasks in chunks."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}")))).repartition("tie", "chunk")
    nth = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))
    return chunks.withColumn("nth", nth).withColumn("draw", row_hash(seed, F.col("tie"), F.col("nth"))).drop("chunk", "nth", "n")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, rank and target of each source; only sums reach the driver."""
    by = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = stash(by.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights)).cast("double")))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("source_size") * most <= F.lit(level) * F.col("w")
        got = by.agg(
            F.sum(F.when(capped, F.col("source_size") * most)).alias("held"),
            F.sum(F.when(~capped, F.col("w"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (total - (got["held"] or 0)) / got["open"]
    return by.select(
        "source", "source_size", "rank", F.least(F.col("source_size") * F.lit(float(most)), F.lit(float(level)) * F.col("w")).alias("target")
    )


def pivotal(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions of `p` in order, keeping the sum of p * size; -1 or the place of the only one that stays fractional."""
    p, held = p.copy(), -1
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, x, y = p[held], p[i], size[held], size[i]
        up, down = min((1 - a) * x, b * y), min(a * x, (1 - b) * y)  # words that may move to and from the held one
        moved = up if draw[i] * (up + down) < down else -down
        p[held], p[i] = a + moved / x, b - moved / y
        for j in (held, i):
            if not 1e-9 < p[j] < 1 - 1e-9:
                p[j] = round(p[j])
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    return p, held


def pivotal_head(f: float | np.ndarray, size: np.ndarray, rest: float, draw: np.ndarray) -> tuple[np.ndarray, float]:
    """Round documents with fractions f, the largest first, each against all smaller ones and the `rest` words after them.

    A document goes to 1 or to 0 at random where the smaller ones can give and take its words, else to the side for
    which they can (or nearly can).  What it gives or takes is spread over the smaller ones by what each can take or give.
    `f` is one fraction for all, or one for each and for the rest.  Gives the rounded fractions and that of the rest.
    """
    n = len(size)
    p, words = np.array(np.broadcast_to(np.asarray(f, float), n + 1)), np.append(size, rest)
    for i in range(n):
        can_give, can_take = p[i + 1 :] * words[i + 1 :], (1 - p[i + 1 :]) * words[i + 1 :]
        up, down = (1 - p[i]) * size[i], p[i] * size[i]  # words that go to the document or leave it
        short_up, short_down = up - can_give.sum(), down - can_take.sum()  # what the smaller ones lack for that
        full = draw[i] * (up + down) < down if short_up <= 0 and short_down <= 0 else short_up < short_down
        moved = up if full else -down
        share = can_give if moved > 0 else can_take
        if share.sum() > 0:
            p[i + 1 :] -= np.divide(share, words[i + 1 :], out=np.zeros(n - i), where=words[i + 1 :] > 0) * moved / max(share.sum(), abs(moved))
        p[i] = float(full)
    return p[:n], float(p[n])


def _uniform(tie: np.ndarray, level: int) -> np.ndarray:
    h = tie.astype(np.int64).view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + SEED) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def round_group(level: int):
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw"], ascending=[False, True], kind="stable")
        p, held = pivotal(pdf["p"].to_numpy(float), np.maximum(pdf["size"].to_numpy(float), 1), _uniform(pdf["draw"].to_numpy(), level))
        done = np.ones(len(p), dtype=bool)
        if held >= 0:
            done[held] = False
        return pdf.assign(p=p, done=done)

    return apply


def round_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a wave left of one source, a document of each class at most; `after` is the fraction of the later waves."""
    pdf = pdf.sort_values(["size", "draw"], ascending=[False, True], kind="stable")
    f = np.append(pdf["p"].to_numpy(float), pdf["now"].iloc[0])
    p, after = pivotal_head(f, np.maximum(pdf["size"].to_numpy(float), 1), float(pdf["rest"].iloc[0]), _uniform(pdf["draw"].to_numpy(), 99))
    return pdf.assign(p=p, after=after)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_rows: int = 4096, seed: int = SEED) -> DataFrame:
    """doc_id, tie, size, source_size, target and copies of every row."""
    sized = stash(sized_rows(docs, seed))
    sources = source_targets(sized, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("ratio") + 1e-9).cast("int")
    base = ["rank", "doc_id", "tie", "draw", "size", "source_size", "target", "whole", "p"]
    rows = numbered(sized, seed + 2).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = stash(rows.withColumn("ratio", ratio).withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))).select(*base))

    forget(sized)
    kinds = "rank int, doc_id long, tie long, draw long, size long, source_size long, target double, whole int, p double"
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    # at most a row for each class of a source
    up = Window.partitionBy("rank").orderBy("class")
    counts = rows.groupBy("rank", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = counts.withColumn("upto", F.sum("words").over(up)).withColumn("all", F.sum("words").over(Window.partitionBy("rank")))
    wave = sum([F.when(F.col("upto") * (2 << w) <= F.col("all"), 1).otherwise(0) for w in range(WAVES - 1)], F.lit(0))
    counts = stash(counts.select("rank", "class", "n", "words", wave.alias("wave"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")))
    rows = rows.join(counts.select("rank", "class", "wave", "blocks"), ["rank", "class"]).withColumn("block", F.pmod("draw", F.col("blocks"))).drop("blocks")
    # by block, as a source or a class may hold most of the rows
    rows = stash(rows.repartition("rank", "class", "block"))
    now, out = rows.groupBy("rank").agg(F.first("p").alias("now")), []
    for w in range(WAVES):
        most = counts.where(F.col("wave") == w).agg(F.max("n")).first()[0]
        if not most:
            continue
        wide, level = pieces(most, block_rows), 0
        left = rows.where(F.col("wave") == w).drop("p", "wave").join(now, "rank").withColumnRenamed("now", "p").select(*base, "class", "block")
        while True:
            turn = stash(left.groupBy("rank", "class", "block").applyInPandas(round_group(level), kinds + ", class int, block long, done boolean"))
            out.append(turn.where("done").select(*base))
            left = turn.where("not done").drop("done")
            if wide == 1:
                break
            level, wide = level + 1, pieces(wide, FAN_IN)
            left = left.withColumn("block", F.expr(f"block div {FAN_IN}"))
        later = counts.groupBy("rank").agg(F.sum(F.when(F.col("wave") > w, F.col("words")).otherwise(0)).cast("double").alias("rest"))
        last = stash(left.select(*base).join(later, "rank").join(now, "rank").groupBy("rank").applyInPandas(round_rest, kinds + ", rest double, now double, after double"))
        out.append(last.select(*base))
        now = stash(now.join(last.groupBy("rank").agg(F.min("after").alias("after")), "rank", "left").select("rank", F.coalesce("after", "now").alias("now")))
    out = reduce(DataFrame.unionByName, out) if out else rows.select(*base)
    return out.select("doc_id", "tie", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, hot_rows: int = 1 << 16, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows that agree in id, text and source are alike, and their copies differ by one at most: the first of them, in the
    order of a hash of all their columns, take it.  Rows that agree in all columns are counted and taken as one, and over
    `hot_rows` other rows of one kind are numbered range by range of that hash, so no task holds them all.
    """
    names = docs.columns
    seed = how.get("seed", SEED)
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") and c not in names[:i] else f"__{i}" for i, c in enumerate(names)])
    plan = stash(mix_plan(docs, **how).groupBy(F.col("tie").alias("__tie")).agg(F.count("*").alias("__rows"), F.sum("copies").alias("__copies")).where("__copies > 0"))
    own = plain.withColumn("__tie", row_tie(seed)).withColumn("__row", row_hash(seed + 4, *[F.to_json(F.struct(c)) if isinstance(plain.schema[c].dataType, T.MapType | T.VariantType) else F.col(c) for c in plain.columns]))
    # small: how many rows have each hash, and how many of its kind come before
    kinds = own.join(plan, "__tie").select("__tie", "__row", "__rows").groupBy("__tie", "__row", "__rows").agg(F.count("*").alias("__same"))
    kinds = kinds.withColumn("__range", F.when(F.col("__rows") > hot_rows, F.shiftright("__row", 52)).otherwise(0))
    ranges = kinds.where("__range <> 0 or __rows > " + str(hot_rows)).groupBy("__tie", "__range").agg(F.sum("__same").alias("__n"))
    before = ranges.select("__tie", "__range", (F.sum("__n").over(Window.partitionBy("__tie").orderBy("__range")) - F.col("__n")).alias("__before"))
    up = F.sum("__same").over(Window.partitionBy("__tie", "__range").orderBy("__row"))
    kinds = kinds.withColumn("__upto", up).join(before, ["__tie", "__range"], "left").withColumn("__first", F.col("__upto") - F.col("__same") + F.coalesce("__before", F.lit(0)))
    # of rows with one hash, which are equal in all columns, those numbered up to the rest take one copy more
    own = own.join(plan, "__tie").join(kinds.select("__tie", "__row", "__same", "__first"), ["__tie", "__row"])
    more = F.greatest(F.lit(0), F.least(F.col("__same"), F.expr("__copies % __rows") - F.col("__first")))
    own = own.withColumn("__more", more)
    some = own.where("__more in (0, __same)").withColumn("__take", F.expr("__copies div __rows + if(__more > 0, 1, 0)"))
    # a hash at the border: its equal rows are counted out as one row
    split = own.where("__more not in (0, __same)").dropDuplicates(["__tie", "__row"]).withColumn("__take", F.expr("(__copies div __rows) * __same + __more"))
    taken = some.unionByName(split).where("__take > 0")
    return taken.withColumn("__take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__take").cast("long")))).select(*plain.columns).toDF(*names)


def op3_source_mixing(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
