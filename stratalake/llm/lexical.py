"""Ranked lexical search: exact top k of a whole table for each item by dual-tree search.

Both sides are hierarchies whose nodes hold coordinate maxima, one coordinate for each term of an item.  A document's
coordinate is the term's share of the score without its weight, (10**9 * tf) div (1000 * tf + 12 * m); an item's is weight
times occurrences.  The product of two nodes' maxima, summed over terms, bounds every score of a document below the one
against an item below the other.  A pair of nodes whose bound stays under the weakest k-th score of all items below is
left, with all its documents and items; bounds are rounded up, scores are whole numbers, so no row is lost.

Documents are sorted by their weightiest terms and packed PACK at a time; packs are leaves, and FAN of them a node, up to
the CHUNK that a task holds at once.  Items are leaves, FAN of them a node.  First every item looks at its SEEDS packs of
highest bound, so that the search of all packs starts with k-th scores that hold for the whole table.

Items go to the tasks in blocks of at most MOST_ITEMS items and MOST_TERMS terms (an item of more terms alone), one pass
over the documents for each block, so what is broadcast and what a task holds is bounded whatever the number of items.
A document is one row of terms of the block, however long its text is; texts are read in pieces.

Null and empty texts have no terms, so such items rank nothing and such documents are not counted.  Rows of documents are
ranked one by one, also with a doc_id that others have; a null doc_id comes after all others (and so does the largest
long, which is taken for it).  Repeated rows of items repeat their results.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, pieces, row_hash, stash

#: A run of these bytes is a term: digits, ASCII letters and all that is not ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 20
MOST_ITEMS, MOST_TERMS = 512, 1 << 14
PACK, FAN, CHUNK, SEEDS = 128, 8, 512, 2
#: Stands for a null doc_id: the largest long.
NO_ID = (1 << 63) - 1
#: Documents that a task packs and searches.
DEALT = 1 << 14
_PACK = "pack long, docs array<long>, ends array<int>, terms array<int>, parts array<long>, top_terms array<int>, top_parts array<long>"


def terms_of(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text with A-Z lowered, piece by piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if len(text) - at > size else None
        end = gap.end() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def count_terms(text: str | None) -> Counter:
    found: Counter = Counter()
    for some in terms_of((text or "").encode("utf-8", "surrogatepass")):
        found.update(some)
    return found


class Block:
    """Some items: their terms, numbered, and how often each item has each."""

    def __init__(self, rows: list[tuple[int | None, str, int]]) -> None:
        counts = [(item, times, count_terms(text)) for item, text, times in rows]
        counts = [x for x in counts if x[2]]
        self.items = [item for item, _, _ in counts]
        self.times = [times for _, times, _ in counts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for *_, c in counts for t in c}))}
        self.counts = [{self.vocabulary[t]: n for t, n in c.items()} for *_, c in counts]

    def weigh(self, weights: np.ndarray) -> np.ndarray:
        """One row for each item: weight times occurrences of each term."""
        out = np.zeros((len(self.items), len(self.vocabulary)), np.int64)
        for i, count in enumerate(self.counts):
            for t, n in count.items():
                out[i, t] = weights[t] * n
        return out


class Tree:
    """Items, FAN to a node, up to one root: maxima by level, level 0 being the items themselves in a good order."""

    def __init__(self, weighed: np.ndarray) -> None:
        order = sorted(range(len(weighed)), key=lambda i: (tuple(np.argsort(-weighed[i], kind="stable")[:3]), i))
        self.order, self.exact = order, weighed[order]
        self.levels = [self.exact.astype(np.float64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))


def count_documents(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of each row with a term: n counts all terms, the lists those of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.large_binary()), strict=True):
                    n, found = 0, Counter()
                    for some in terms_of(text.as_py() or b""):
                        n += len(some)
                        found.update(filter(vocabulary.__contains__, some))
                    if n:
                        rows.append((doc, n, [vocabulary[t] for t in found], list(found.values())))
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["doc_id", "n", "terms", "times"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def term_weights(counted: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, the documents that have terms, and all terms' number."""
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(terms, np.int64)
    for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
        df[t] = n
    weights = [math.floor(1000 * math.log((2 * total.n + 2) / (2 * int(d) + 1))) for d in df]
    return np.array(weights, np.int64), total.n, total.l or 0


def pack(counted: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """Documents with a term of some item, sorted by their three weightiest terms, PACK to a row."""
    heavy = np.empty(len(weights), np.int64)
    heavy[np.argsort(-weights, kind="stable")] = np.arange(len(weights))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, times = batch["terms"], batch["times"]
            sizes = np.diff(terms.offsets.to_numpy())
            flat, tf = terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * batch["n"].to_numpy() * documents) // length
            parts = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
            ends, keys = np.cumsum(sizes), []
            for start, end in zip(ends - sizes, ends, strict=True):
                ranks = heavy[flat[start:end]]
                keys.append(np.sort(np.partition(ranks, 2)[:3] if len(ranks) > 3 else ranks).tolist())
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(keys, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(parts))], ["doc_id", "key", "terms", "parts"]
            )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                terms, parts = part["terms"].flatten().to_numpy(), part["parts"].flatten().to_numpy()
                offsets = part["terms"].offsets.to_numpy()
                order = np.lexsort((-parts, terms))
                first = np.concatenate(([True], np.diff(terms[order]) != 0))
                docs = part["doc_id"].to_numpy()
                row = (int(docs[0]), docs, (offsets[1:] - offsets[0]).astype(np.int32), terms, parts, terms[order][first], parts[order][first])
                kinds = (pa.int64(), *[pa.list_(pa.int64() if i in (0, 3, 5) else pa.int32()) for i in range(6)])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["pack", "docs", "ends", "terms", "parts", "top_terms", "top_parts"])

    some = counted.where(F.size("terms") > 0)
    placed = some.mapInArrow(place, "doc_id long, key array<long>, terms array<int>, parts array<long>")
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, pieces(documents, DEALT))
    placed = placed.repartitionByRange(tasks, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return placed.select("doc_id", "terms", "parts").mapInArrow(fill, _PACK).withColumn("pack", F.monotonically_increasing_id())


def best_packs(packs: DataFrame, weighed: np.ndarray) -> list[int]:
    """The SEEDS packs of highest bound of each item: at most SEEDS for each item of the block."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = weighed.astype(np.float64)
        for batch in batches:
            ids, found = batch["pack"].to_numpy(), np.empty((len(q), batch.num_rows))
            for j, (t, c) in enumerate(zip(batch["top_terms"], batch["top_parts"], strict=True)):
                found[:, j] = q[:, t.values.to_numpy()] @ c.values.to_numpy().astype(np.float64)
            best = np.argsort(-found, axis=1, kind="stable")[:, :SEEDS]
            items = np.repeat(np.arange(len(q)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids[best.ravel()]), pa.array(found[items, best.ravel()])], ["item", "pack", "bound"])

    found = packs.select("pack", "top_terms", "top_parts").mapInArrow(bound, "item long, pack long, bound double").where("bound > 0")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "pack"))).where(F.col("r") <= SEEDS)
    return [r.pack for r in ranked.select("pack").distinct().collect()]


def search(tree: Tree, floor: np.ndarray, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of the dual-tree search: each item's `top` documents among the packs that a task reads, if above 0 and not below its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floor]
        weakest = [np.maximum(floor, 1).astype(np.float64)]
        for level in tree.levels[1:]:
            weakest.append(np.minimum.reduceat(weakest[-1], np.arange(0, len(weakest[-1]), FAN)))
            assert len(weakest[-1]) == len(level)

        def take(item: int, docs: np.ndarray, scores: np.ndarray) -> None:
            good = scores >= weakest[0][item]
            if not good.any():
                return
            docs, scores = np.concatenate((best[item][0], docs[good])), np.concatenate((best[item][1], scores[good]))
            order = np.lexsort((docs, -scores))[:top]
            best[item] = docs[order], scores[order]
            if len(order) == top and scores[order[-1]] > weakest[0][item]:
                weakest[0][item] = scores[order[-1]]
                for level in range(1, len(weakest)):  # the weakest of the nodes above may rise with it
                    item //= FAN
                    weakest[level][item] = weakest[level - 1][item * FAN : (item + 1) * FAN].min()

        def visit(level: int, item: int, depth: int, node: int) -> None:
            terms, parts = nodes[depth][node]
            if float(tree.levels[level][item, terms] @ parts) * (1 + 1e-9) + 0.5 < weakest[level][item]:
                return
            if level == 0 and depth == 0:
                docs, starts, terms, parts = leaves[node]
                take(item, docs, np.add.reduceat(tree.exact[item, terms] * parts, starts))
                return
            below = range(item * FAN, min((item + 1) * FAN, len(weakest[level - 1]))) if level else [item]
            inner = range(node * FAN, min((node + 1) * FAN, len(nodes[depth - 1]))) if depth else [node]
            for d in inner:
                for i in below:
                    visit(max(level - 1, 0), i, max(depth - 1, 0), d)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                column = lambda name: [x.values.to_numpy() for x in part[name]]  # noqa: E731, B023
                leaves = [(d, np.concatenate(([0], e[:-1])), t, p) for d, e, t, p in zip(*map(column, ("docs", "ends", "terms", "parts")), strict=True)]
                nodes = [list(zip(column("top_terms"), [p.astype(np.float64) for p in column("top_parts")], strict=True))]
                while len(nodes[-1]) > 1:
                    nodes.append([merged(nodes[-1][i : i + FAN]) for i in range(0, len(nodes[-1]), FAN)])
                visit(len(tree.levels) - 1, 0, len(nodes) - 1, 0)
        items = np.repeat(np.array(tree.order, np.int64), [len(s) for _, s in best])
        docs, scores = (np.concatenate([b[k] for b in best]) if best else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(docs), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def merged(nodes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of several nodes."""
    terms, parts = np.concatenate([t for t, _ in nodes]), np.concatenate([p for _, p in nodes])
    order = np.argsort(terms, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(terms[order]) != 0)))
    return terms[order][starts], np.maximum.reduceat(parts[order], starts)


def best_of(packs: DataFrame, tree: Tree, floor: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score, rank) over all tasks' results."""
    found = packs.mapInArrow(search(tree, floor[tree.order], top), "item long, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def search_block(docs: DataFrame, block: Block, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block; a written table."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not block.items:
        return empty
    counted = stash(count_documents(docs, block.vocabulary))
    weights, documents, length = term_weights(counted, len(block.vocabulary))
    if not length:
        return empty
    weighed = block.weigh(weights)
    tree, packs = Tree(weighed), stash(pack(counted, weights, documents, length))
    seeds = spark.createDataFrame([(p,) for p in best_packs(packs, weighed)], "pack long")
    floor = np.zeros(len(block.items), np.int64)
    first = best_of(packs.join(seeds, "pack", "left_semi"), tree, floor, top)
    for r in first.where(F.col("rank") == top).collect():  # at most one row for each item of the block
        floor[r.item] = r.score
    found = best_of(packs, tree, floor, top)
    names = spark.createDataFrame([(i, item, times) for i, (item, times) in enumerate(zip(block.items, block.times, strict=True))], "item long, item_id long, times long")
    found = found.join(names, "item").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    out = stash(found.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    forget(counted, packs)
    return out


def blocks(items: DataFrame, most_items: int = MOST_ITEMS, most_terms: int = MOST_TERMS) -> Iterator[Block]:
    """The items (item_id, text) in blocks below both bounds; an item with more terms comes alone."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array([len(count_terms(t)) for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size], [*batch.schema.names, "size"])

    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("times"))
    items = stash(items.mapInArrow(sizes, "item_id long, text string, times long, size long").where("size > 0"))
    total = items.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    n = max(pieces(total.n, most_items), pieces(total.s or 0, most_terms))
    while n > 1:
        dealt = items.groupBy(F.pmod(row_hash(7, "item_id", "text"), F.lit(n)).alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        if not dealt.where((F.col("n") > most_items) | ((F.col("s") > most_terms) & (F.col("n") > 1))).limit(1).count():
            break
        n *= 2
    for b in range(n):
        rows = items.where(F.pmod(row_hash(7, "item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect() if total.n else []
        if rows:
            yield Block([(r.item_id, r.text, r.times) for r in rows])
    forget(items)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents of score above 0, equal scores by doc_id."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items):
        out = out.unionByName(search_block(docs, block, top))
    return out


def op12_ranked_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank(docs, benchmark)


def op12_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
    total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
    tf AS (SELECT doc_id, len(ts)::BIGINT AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
    i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
    s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM i JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    WHERE rank <= 20"""
