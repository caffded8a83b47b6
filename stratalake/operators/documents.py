"""Text analytics over many documents: structure, readability, keywords, entities, sentiment, topics, key passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed
from ..functions import text as X
from ..sources.scratch import written
from .ordered import stored
from .retrieval import vectors_of


def overview(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and averages of each document, with reading ease and sentiment."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(doc, F.length(t).cast("long").alias("chars"), F.size(X.words(t)).cast("long").alias("words"), F.size(X.sentences(t)).cast("long").alias("sentences"), F.size(X.paragraphs(t)).cast("long").alias("paragraphs"), F.round(X.reading_ease(t), 1).alias("reading_ease"), X.sentiment(t).alias("sentiment"))
    per = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 1)
    return base.withColumns({"words_per_sentence": per("words", "sentences"), "words_per_paragraph": per("words", "paragraphs"), "reading_label": X.reading_label(F.col("reading_ease")), "sentiment_label": X.sentiment_label(F.col("sentiment"))})


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", over: int = 30) -> DataFrame:
    """doc, par and text of each paragraph."""
    return docs.select(doc, F.posexplode(X.paragraphs(F.col(text), over)).alias("par", "text"))


def leading_paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text", first: int = 3) -> DataFrame:
    """doc and its first paragraphs, as a sample to show."""
    return docs.select(doc, F.slice(X.paragraphs(F.col(text)), 1, first).alias("sample"))


def keywords(units: DataFrame, top: int = 15, by: list[str] | None = None, text: str = "text", unicode: bool = False) -> DataFrame:
    """term, tf, df and score = tf * (ln((N + 1) / (df + 1)) + 1) of the top terms, of all units or within each `by`.

    Tasks count batch by batch, so what is dealt and written is a row for each term or group, not for a unit's terms.
    """
    by = by or []
    counts = written(_term_counts(units.select(*by, _read(F.col(text), unicode).alias("__t")), by).groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    size = counts.where("term is null").select(*by, F.col("df").alias("__n"))
    terms = counts.where("term is not null")
    sized = terms.join(size, by) if by else terms.join(F.broadcast(size))
    scored = sized.select(*by, "term", "tf", "df", F.round(F.col("tf") * (F.ln((F.col("__n") + 1) / (F.col("df") + 1)) + 1), 4).alias("score"))
    if not by:
        return scored.orderBy(F.desc("score"), "term").limit(top)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top)


#: Bytes of ASCII letters and digits as they are, all others as a space.
_PLAIN = np.array([b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _read(text: Column, unicode: bool = False) -> Column:
    """What `_coded` takes: texts in lower case, or their tokens."""
    return X.tokens(text, True) if unicode else F.lower(F.coalesce(text, F.lit("")))


def _coded(read: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the code of each token of a batch, and the words of the codes: the tokens of `functions.text.tokens`."""
    if pa.types.is_string(read.type):
        _, offsets, data = read.buffers()
        plain = _PLAIN[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
        read = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(read), [None, offsets, pa.py_buffer(plain)], offset=read.offset))
    found = read.flatten().dictionary_encode()
    row, code, words = np.repeat(np.arange(len(read)), np.diff(read.offsets.to_numpy())), found.indices.to_numpy().astype(np.int64), found.dictionary
    kept = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, value_set=pa.array(fixed.STOP_WORDS)))).to_numpy(zero_copy_only=False)
    number, here = np.cumsum(kept) - 1, kept[code]
    return row[here], number[code[here]], words.filter(pa.array(kept))


def _term_counts(read: DataFrame, by: list[str]) -> DataFrame:
    """`by`, term, tf and df of each batch of `__t`; a row without a term has the number of units as df."""
    names = [*by, "term", "tf", "df"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = np.zeros(n, np.int64)
            for c in by:
                codes = batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            first = np.unique(group, return_index=True)[1]
            row, code, words = _coded(batch["__t"])
            keys, tf = np.unique(group[row] * len(words) + code, return_counts=True)
            df = np.unique(np.unique((group[row] * len(words) + code) * n + row) // n, return_counts=True)[1]
            of, term = np.divmod(keys, max(1, len(words)))
            every = np.arange(len(first))  # the groups as a whole
            terms = pa.concat_arrays([words.take(pa.array(term)), pa.nulls(len(first), words.type)])
            at = pa.array(first[np.concatenate((of, every))])
            cut = [batch[c].take(at) for c in by]
            yield pa.RecordBatch.from_arrays([*cut, terms, pa.array(np.concatenate((tf, 0 * every))), pa.array(np.concatenate((df, np.bincount(group))))], names)

    kinds = [f for f in read.schema.fields if f.name in by]
    return read.mapInArrow(count, T.StructType([*sorted(kinds, key=lambda f: by.index(f.name)), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())]))


def entity_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each document and kind that occurs: n and the first distinct samples."""
    found = [F.struct(F.lit(k).alias("kind"), X.entity_summary(F.col(text), k).alias("x")) for k in kinds or fixed.ENTITY_PATTERNS]
    return docs.select(doc, F.explode(F.array(*found)).alias("k")).select(doc, "k.kind", "k.x.n", "k.x.samples").where("n > 0")


def word_bucket(word: str, dimensions: int = 64) -> int:
    """One of up to 256 numbers for a word, by the first two digits of its digest."""
    return hashlib.md5(word.encode(), usedforsecurity=False).digest()[0] % dimensions


def hashed_words(units: DataFrame, dimensions: int = 64) -> DataFrame:
    """The units that have words, with `__v`: counts of their hashed words as a vector of length 1."""
    counted = units.withColumn("__t", _read(F.col("text")))
    names = units.columns

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (row, code, words) = batch.num_rows, _coded(batch["__t"])
            buckets = np.array([word_bucket(w, dimensions) for w in words.to_pylist()], np.int64)  # of each word once
            x = np.bincount(row * dimensions + buckets[code], minlength=n * dimensions).reshape(n, dimensions).astype(np.float64)
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(x.ravel()))
            out = pa.RecordBatch.from_arrays([*[batch[c] for c in names], lists], [*names, "__v"])
            yield out.filter(pa.array(np.bincount(row, minlength=n) > 0))

    return counted.mapInArrow(vectors, T.StructType([*units.schema.fields, T.StructField("__v", T.ArrayType(T.DoubleType()))]))


def _assign(centroids: np.ndarray):
    """The step of a task: `cluster` of each row, the most similar centroid (to nine places; ties: the first)."""

    def best(v: pa.Array) -> np.ndarray:
        return np.round(vectors_of(v) @ centroids.T, 9).argmax(1)

    return best


def spherical_kmeans(vectors: DataFrame, starts: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids after up to `rounds` Lloyd steps over `__v`; a centroid that no row is near to becomes a seeded unit vector."""
    c, (k, width) = np.round(starts, 9), starts.shape
    for r in range(rounds):
        best = _assign(c)

        def step(batches: Iterator[pa.RecordBatch], best=best) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, width))
            for batch in batches:
                mine = best(batch["__v"])[:, None] == np.arange(k)
                sums += mine.T.astype(np.float64) @ vectors_of(batch["__v"])
            cluster, dim = np.divmod(np.arange(k * width), width)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(sums.ravel())], ["cluster", "dim", "x"])

        found = np.zeros((k, width))
        for cluster, dim, x in vectors.select("__v").mapInArrow(step, "cluster int, dim int, x double").groupBy("cluster", "dim").agg(F.sum("x")).collect():  # k * width rows
            found[cluster, dim] = x
        for i in range(k):
            size = np.linalg.norm(found[i])
            found[i] = found[i] / size if size > 1e-9 else np.eye(width)[(seed + i + r) % width]
        found = np.round(found, 9)
        if (found == c).all():
            break
        c = found
    return c


def topics(units: DataFrame, k: int = 4, seed: int = 7, dimensions: int = 64, rounds: int = 12, order: tuple[str, ...] = ("doc_id", "par")) -> DataFrame:
    """The units with `cluster`: spherical k-means over hashed words, from evenly spaced units; fewer than eight units have none."""
    base = written(hashed_words(units, dimensions))
    held = stored(base.select(*order, "__v"), list(order))  # the texts stay where they are
    if held.rows < 8:
        return units.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    starts = np.array([held.page(i * held.rows // k, 1).first()["__v"] for i in range(k)])
    best = _assign(spherical_kmeans(base, starts, rounds, seed))
    schema = base.drop("__v").schema
    names = schema.names

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(best(batch["__v"]), pa.int32())], [*names, "cluster"])

    return base.mapInArrow(label, T.StructType([*schema.fields, T.StructField("cluster", T.IntegerType())]))


def topic_summary(clustered: DataFrame, order: list[str], top: int = 8) -> DataFrame:
    words = keywords(clustered, top, ["cluster"]).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    cut = clustered.select("cluster", C.snippet(F.col("text"), 160).alias("text"), F.struct(*order).alias("at"))  # only the heads of texts are sorted
    heads = cut.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("text", "at").alias("representative"))
    return heads.join(words, "cluster").orderBy(F.desc("size"), "cluster")


def key_passages(units: DataFrame, top: int = 5, order: str = "par") -> DataFrame:
    """The passages of over ten tokens that are densest in the 30 leading keywords."""
    lead = pa.array([r["term"] for r in keywords(units, 30).select("term").collect()], pa.string())
    names = units.columns

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, words = _coded(batch["__t"])
            sizes = np.bincount(row, minlength=batch.num_rows)
            hits = pc.is_in(words, value_set=lead).to_numpy(zero_copy_only=False)[code]
            found = np.bincount(row[hits], minlength=batch.num_rows) / np.maximum(sizes, 1)
            kept = sizes > 10
            if kept.sum() > top:  # those that round to the last place or above it
                kept &= found >= np.sort(found[kept])[-top] - 1e-4
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(found)], [*names, "density"]).filter(pa.array(kept))

    schema = T.StructType([*units.schema.fields, T.StructField("density", T.DoubleType())])
    scored = units.withColumn("__t", _read(F.col("text"))).mapInArrow(dense, schema)
    return scored.withColumn("density", F.round("density", 4)).orderBy(F.desc("density"), order).limit(top)
