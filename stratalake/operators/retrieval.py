"""Top-k retrieval: sparse word and trigram vectors as rows, joined on their dimensions; dense vectors by dot product."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions import text as X
from ..sources.scratch import written

BUCKETS, WORD_DIMENSIONS = 512, 4096


def row_groups(df: DataFrame, columns: list[str], row_id: str, each: int = 25, first: int | None = 200) -> DataFrame:
    """Chunks (id, family, text) of `each` rows in order; `first` rows only, as reports do, or all with None."""
    spoken = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in columns])
    rows = df.select(F.col(row_id).alias("__at"), spoken.alias("line"))
    if first is not None:
        rows = rows.orderBy("__at").limit(first)
    rows = rows.withColumn("__g", F.expr(f"__at div {each}"))
    return rows.groupBy("__g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "line"))), lambda x: x["line"]), "\n").alias("text")).select(F.concat(F.lit("row_group_"), "__g").alias("id"), F.lit("row_group").alias("family"), "text")


def document_chunks(docs: DataFrame, each: int = 3) -> DataFrame:
    """Chunks of `each` passages of over 80 characters of each document."""
    parts = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), 80)).alias("par", "part")).withColumn("g", F.expr(f"par div {each}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("doc_id", "g").agg(joined.alias("text")).select(F.concat_ws("_", F.lit("doc"), "doc_id", "g").alias("id"), F.lit("document").alias("family"), "text")


def _terms(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.explode(X.question_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def fit_index(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """term and idf of the WORD_DIMENSIONS most frequent terms (ties: by term); with `distinct` ids, terms are counted row by row."""
    if distinct:
        df = chunks.select(F.explode(F.array_distinct(X.question_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    else:
        df = _terms(chunks).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(chunks.agg(F.count("*").alias("n")))
    return df.join(n).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")).orderBy(F.desc("df"), "term").limit(WORD_DIMENSIONS)


def read_for_vectors(chunks: DataFrame, *more: str) -> DataFrame:
    """id, `more`, `t` (words) and `s` (letters and digits): what `Weigher` takes."""
    return chunks.select("id", *more, X.question_tokens(F.col("text")).alias("t"), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", "").alias("s"))


class Weigher:
    """Weights of chunks in a task: tf/length * idf of words and 1 + ln(count) of hashed trigrams, one vector of length 1.

    It holds the index (WORD_DIMENSIONS rows at most); dimensions are numbered words first, then buckets.
    """

    def __init__(self, index: DataFrame):
        known = index.select("term", "idf").collect()
        self.terms, self.idf = [r["term"] for r in known], np.array([r["idf"] for r in known], dtype=np.float64)
        self.dims = [f"w:{t}" for t in self.terms] + [f"g:{b}" for b in range(BUCKETS)]

    def weights(self, t: pa.ListArray, s: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, dimension and weight, by dimension and then by row."""
        words, sizes = len(self.terms), np.diff(t.offsets.to_numpy())
        found = pc.index_in(t.flatten(), value_set=pa.array(self.terms, pa.string())).to_numpy(zero_copy_only=False)
        row, here = np.repeat(np.arange(len(t)), sizes), ~np.isnan(found)
        keys, n = np.unique(found[here].astype(np.int64) * len(t) + row[here], return_counts=True)
        dim, at = np.divmod(keys, max(1, len(t)))
        weight = n / sizes[at] * self.idf[dim]
        grams = np.zeros((len(t), BUCKETS), np.int64)
        for i, text in enumerate(s.to_pylist()):
            c = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
            if len(c) > 2:
                grams[i] = np.bincount((961 * c[:-2] + 31 * c[1:-1] + c[2:]) % BUCKETS, minlength=BUCKETS)
        bucket, place = np.nonzero(grams.T)
        dim, at = np.concatenate((dim, words + bucket)), np.concatenate((at, place))
        weight = np.concatenate((weight, 1 + np.log(grams[place, bucket])))
        norm = np.sqrt(np.bincount(at, weight * weight, len(t)))
        return at, dim, weight / norm[at]


def embed(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """id, dim, weight of each chunk (`Weigher`); ids are distinct."""
    by = Weigher(index)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = pa.array(by.dims, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                at, dim, weight = by.weights(part["t"], part["s"])
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at)), dims.take(pa.array(dim)), pa.array(weight)], ["id", "dim", "weight"])

    return read_for_vectors(chunks).mapInArrow(build, f"id {chunks.schema['id'].dataType.simpleString()}, dim string, weight double")


def expand(question: str) -> list[str]:
    """The question and its variants by fixed rewrites, each once."""
    out = [question]
    for pattern, word in fixed.QUESTION_VARIANTS:
        new = re.sub(pattern, word, question, count=1, flags=re.IGNORECASE)
        if new not in out:
            out.append(new)
    return out


def words_of(question: str) -> list[str]:
    return sorted({t for t in re.split(r"[^a-z0-9_]+", question.lower()) if len(t) > 1})


def retrieve(chunks: DataFrame, vectors: DataFrame, index: DataFrame, question: str, k: int = 6) -> DataFrame:
    """id, family, text and score = cosine + 0.03 for each word of the question that the text holds, of the top k."""
    asked = chunks.sparkSession.createDataFrame([("?", question)], "id string, text string")
    wanted = F.broadcast(embed(asked, index).select("dim", F.col("weight").alias("w")))
    cosine = vectors.join(wanted, "dim").groupBy("id").agg(F.sum(F.col("weight") * F.col("w")).alias("cosine"))
    low = F.lower("text")
    bonus = sum([F.when(low.contains(t), 0.03).otherwise(0.0) for t in words_of(question)], F.lit(0.0))
    scored = chunks.join(cosine, "id", "left").withColumn("score", F.round(F.coalesce("cosine", F.lit(0.0)), 9) + bonus).drop("cosine")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def rerank(found: DataFrame, question: str) -> DataFrame:
    boost = F.coalesce(F.create_map(*[x for k, v in fixed.FAMILY_BOOST.items() for x in (F.lit(k), F.lit(v))])[F.col("family")], F.lit(0.0))
    low = F.lower("text")
    overlap = sum([F.when(low.contains(t), 0.04).otherwise(0.0) for t in words_of(question)], F.lit(0.0))
    return found.withColumn("score", F.col("score") + boost + overlap).orderBy(F.desc("score"), "id")


def ask(chunks: DataFrame, question: str, k: int = 6) -> dict:
    """Expand, retrieve for each variant, merge by best score, rerank; the context, the sources and the top chunk as answer."""
    from .postings import build

    index, found = build(chunks), None  # written once, asked for every variant
    for variant in expand(question):
        one = index.search(variant, k)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("id", "family", "text").agg(F.max("score").alias("score"))
    top = rerank(merged, question).limit(k).select("id", "family", "text", "score", C.snippet(F.col("text"), 220).alias("snippet")).collect()  # k rows
    return {
        "answer": top[0]["text"] if top else "No matching data was found.",
        "context": "\n".join(f"[{i}] {r['text']}" for i, r in enumerate(top, 1)),
        "sources": [{"id": r["id"], "score": round(r["score"], 4), "snippet": r["snippet"]} for r in top],
    }


#: Bytes of all queries' vectors up to which every task gets them; rows and queries of a cell meet in a join beyond.
MOST_QUERIES = 32 << 20


def vectors_of(column: pa.Array) -> np.ndarray:
    """A column of lists as rows of a matrix: shorter lists are filled with 0, a null list is NaN, a null number is 0."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False)) if column.flatten().null_count else column.flatten().to_numpy()
    if not column.null_count and len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out, at = np.zeros((len(column), int(sizes.max(initial=0)))), 0
    for i, there in enumerate(column.is_valid().to_pylist()):
        if there:
            out[i, : sizes[i]] = flat[at : at + sizes[i]]
            at += sizes[i]
        else:
            out[i] = np.nan
    return out


def _packs(df: DataFrame, key: str, vector: str, rows: int, ids: str, data: str) -> DataFrame:
    """Blocks of `rows` rows: their keys and their vectors as one matrix of doubles (a null vector is NaN)."""
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_pydict({ids: [part.column(0).to_pylist()], data: [vectors_of(part.column(1)).tobytes()]}, pa.schema([(ids, pa.list_(part.column(0).type)), (data, pa.binary())]))

    return df.select(F.col(key), F.col(vector)).mapInArrow(pack, f"{ids} array<{kind}>, {data} binary")


def _cells(packs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Every block of rows beside every block of queries.

    Queries below `most` bytes (counted on the written table) go to all tasks.  More are dealt, with the rows, over a grid
    whose cells have one part of either side: each side is copied along the other's parts only.
    """
    size = queries.agg(F.coalesce(F.sum(F.octet_length("qdata")), F.lit(0)), F.count("*")).first()
    if size[0] <= most:
        return packs.withColumn("_c", F.lit(0)).join(F.broadcast(queries.withColumn("_c", F.lit(0))), "_c").drop("_c")
    across = -(-size[0] // most)
    down = max(1, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // across)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = packs.withColumn("_x", part("ids", down)).withColumn("_y", every(across))
    asked = queries.withColumn("_y", part("qids", across)).withColumn("_x", every(down))
    return rows.join(asked, ["_x", "_y"]).drop("_x", "_y")


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    m = np.frombuffer(data).reshape(rows, -1)
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: by score, NaN last, and then by id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", rows: int = 256, most: int = MOST_QUERIES) -> DataFrame:
    """query_id, key and score: for each query row the k rows with the greatest cosine (ties: by key).

    Keys are not null, and those of queries are distinct.  Blocks of rows meet blocks of queries (`_cells`), and a task
    passes on only the k best of its rows for each query, of which again each task keeps k before they are dealt by query.
    The cosine with a null or zero vector is null and comes last.
    """
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.schema[key].dataType.simpleString()
    q = written(_packs(queries.select(key, vector), key, vector, rows, "qids", "qdata"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        types = None
        for batch in batches:
            types = batch.column("qids").type.value_type, batch.column("ids").type.value_type
            for ids, data, qids, qdata in zip(*[batch.column(c) for c in ("ids", "data", "qids", "qdata")], strict=True):
                ids, qids, data, qdata = ids.as_py(), tuple(qids.as_py()), data.as_py(), qdata.as_py()
                width = max(len(data) // 8 // len(ids), len(qdata) // 8 // len(qids))
                a, b = _matrix(qdata, len(qids), width), _matrix(data, len(ids), width)
                with np.errstate(all="ignore"):
                    scores = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)), 6)
                names = np.array(ids)
                order = np.argsort(names, kind="stable")
                top = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]
                new = np.take_along_axis(scores[:, order], top, 1), names[order][top]
                if qids in held:
                    new = _best(*[np.concatenate(x, 1) for x in zip(held[qids], new, strict=True)], k)
                held[qids] = new
        for qids, (scores, names) in held.items():
            each = [pa.array(np.repeat(np.array(qids), scores.shape[1]), types[0]), pa.array(names.ravel(), types[1]), pa.array(scores.ravel(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(each, names=["query_id", key, "score"])

    found = _cells(_packs(vectors, key, vector, rows, "ids", "data"), q, most).mapInArrow(search, f"query_id {asked}, `{key}` {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), key)
    return found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).select("query_id", key, F.round("score", 6).alias("score"))
