"""A stored inverted index over chunks: postings by dimension and block with block maxima, written once, asked many times.

A block is up to BLOCK chunks that lie together in the table as written, so their postings are made where they lie; chunks
carry their block, and no text or weight is dealt again.  For a question, the products of its weights with the maxima of a block,
summed, bound the cosine of every chunk of the block; a word of the question adds at most its bonus.  The FIRST blocks of
highest bound give k scores (cosines to nine places, so that copies tie), and only blocks whose bound reaches the k-th of them are scored: no chunk is lost.  A chunk
that shares no dimension can hold words of two letters at most, so if the k-th score is no more than these are worth, all
chunks are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import retrieval

BLOCK, FIRST = 128, 4


@dataclass
class Postings:
    chunks: DataFrame  # id, family, text, n (a number of its own), block (n div BLOCK)
    index: DataFrame  # term, df, idf
    table: DataFrame  # dim, block, top, at (n minus that of the block's start), weights: sorted by dim in each file

    def search(self, question: str, k: int = 6) -> DataFrame:
        """id, family, text and score = cosine + 0.03 for each word of the question that the text holds, of the top k."""
        spark, words = self.chunks.sparkSession, retrieval.words_of(question)
        asked = spark.createDataFrame([("?", question)], "id string, text string")
        wanted = {r["dim"]: r["weight"] for r in retrieval.embed(asked, self.index).collect()}  # of one question
        if not wanted:
            return self._whole(self._leading(self.chunks.withColumn("cosine", F.lit(0.0)), words, k))
        weight = F.create_map(*[x for d, w in wanted.items() for x in (F.lit(d), F.lit(w))])[F.col("dim")]
        mine = self.table.where(F.col("dim").isin(list(wanted))).withColumn("w", weight)
        bound = mine.groupBy("block").agg((F.sum(F.col("w") * F.col("top")) + 0.03 * len(words) + 2e-9).alias("bound"))
        bounds = written(bound)
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        some = F.col("block").isin(first)
        best = self._leading(self._meeting(self.chunks.where(some), mine.where(some), words), words, k).select("score").collect()  # k rows
        least = min((r["score"] for r in best), default=0.0) if len(best) == k else 0.0
        if least <= 0.03 * sum(len(w) < 3 for w in words):
            return self._whole(self._leading(self._meeting(self.chunks, mine, words, "left"), words, k))
        good = bounds.where(F.col("bound") >= least).select("block")
        return self._whole(self._leading(self._meeting(self.chunks.join(good, "block", "left_semi"), mine.join(good, "block", "left_semi"), words), words, k))

    def _meeting(self, chunks: DataFrame, mine: DataFrame, words: list[str], how: str = "inner") -> DataFrame:
        """id, bonus and cosine of the chunks that share a dimension (all with `left`); no text is dealt."""
        each = mine.select("block", "w", F.inline(F.arrays_zip("at", "weights")))
        cosine = each.groupBy((F.col("block") * BLOCK + F.col("at")).alias("n")).agg(F.sum(F.col("w") * F.col("weights")).alias("cosine"))
        return chunks.select("n", "id", _bonus(words).alias("bonus")).join(cosine, "n", how)

    def _leading(self, chunks: DataFrame, words: list[str], k: int) -> DataFrame:
        """id and score of the top k."""
        bonus = F.col("bonus") if "bonus" in chunks.columns else _bonus(words)
        scored = chunks.select("id", (F.round(F.coalesce("cosine", F.lit(0.0)), 9) + bonus).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def _whole(self, leading: DataFrame) -> DataFrame:
        """The leading chunks (k rows) with family and text."""
        return self.chunks.join(F.broadcast(leading), "id").select("id", "family", "text", "score").orderBy(F.desc("score"), "id")


def _bonus(words: list[str]):
    low = F.lower("text")
    return sum([F.when(low.contains(t), 0.03).otherwise(0.0) for t in words], F.lit(0.0))


def build(chunks: DataFrame) -> Postings:
    """The index of `chunks` (id, family, text; ids are distinct)."""
    kept = written(chunks.select("id", "family", "text", F.monotonically_increasing_id().alias("n")).withColumn("block", F.expr(f"n div {BLOCK}")))
    index = written(retrieval.fit_index(kept, distinct=True))
    by = retrieval.Weigher(index)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = pa.array(by.dims, pa.string())
        for batch in batches:  # a block that two batches share has two rows for a dimension
            block = batch["block"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                at, dim, weight = by.weights(part["t"], part["s"])
                if not len(dim):
                    continue
                starts = np.flatnonzero(np.diff(dim, prepend=-1))
                ends = pa.array(np.append(starts, len(dim)), pa.int32())
                places = pa.array((part["n"].to_numpy() - block[a] * BLOCK)[at].astype(np.int16))
                cut = [pa.ListArray.from_arrays(ends, x) for x in (places, pa.array(weight))]
                yield pa.RecordBatch.from_arrays([dims.take(pa.array(dim[starts])), pa.array(np.full(len(starts), block[a])), pa.array(np.maximum.reduceat(weight, starts)), *cut], ["dim", "block", "top", "at", "weights"])

    made = retrieval.read_for_vectors(kept, "n", "block").mapInArrow(lists, "dim string, block long, top double, at array<short>, weights array<double>")
    return Postings(kept, index, written(made.sortWithinPartitions("dim", "block")))
