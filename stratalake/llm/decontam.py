"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item's set is its distinct runs of five words (ASCII lower case); an item of fewer words is one run of all
its words.  A document contains an item when at least `threshold` of the item's runs are among its own.

One seeded hash orders all runs, and both sides are sketched by their smallest values, partition by partition of set
size (powers of two).  In a partition of sizes up to u an item keeps its m = floor((1 - threshold) * u) + 1 smallest
values (bottom-m MinHash), and `reach` is the largest value that any of them keeps.  A document of any length keeps for
a partition its values up to `reach` (a MinHash sketch scaled to it), and only for partitions whose sizes it can hold:
with fewer than threshold * n runs it contains no item of n.  A document that holds threshold of an item misses at most
m - 1 of its runs, so its sketch shares a value with the item's: the search loses nothing.  Each hit is then counted
exactly, first on hashes of all of the item's runs and at last on the words themselves.

Items go to every task while their runs and their texts' bytes are below bounds; beyond these, sketches of both sides
meet in a Spark join.  A document's value is sent there only if a bit table of the items' values (2 MB) has it.  A null
or empty text has no runs and matches nothing; repeated rows give one pair each (the pair is reported once for a
doc_id); other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import without

RUN = 5
THRESHOLD = 0.8
#: Bytes of items' texts that are broadcast at most.
MOST_TEXT = 64 << 20
#: Bits of the table that tells which values are in some item's sketch.
GATE_BITS = 24
PAIRS = "doc_id long, item_id long, item_shingles int, matched int, containment double"


def sketch_size(n: int, threshold: float) -> int:
    """Values kept for an item of n runs: enough for the largest set of its partition (sizes 2**c to 2**(c+1) - 1)."""
    top = (1 << n.bit_length()) - 1
    return min(n, math.floor((1 - threshold) * top + 1e-9) + 1)


def order_value(runs: np.ndarray) -> np.ndarray:
    """The seeded hash by which sketches keep the smallest: 63 bits."""
    return (K.mix(runs ^ K.U64(0x5851F42D4C957F2D)) >> K.U64(1)).astype(np.int64)


def word_runs(text: str, k: int = RUN) -> set[tuple[bytes, ...]]:
    """The set itself, from the words."""
    words = text.encode().translate(bytes(K.LOWER)).translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def item_runs(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, text, k (words of a run), part (of its size), runs (little-endian 64-bit values) and sketch of each item that has words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            start, end, row = K.words(data, offsets)
            h, r = K.shingles(K.word_hashes(data, start, end), row, batch.num_rows, RUN)
            count, cut = np.bincount(row, minlength=batch.num_rows), np.searchsorted(r, np.arange(batch.num_rows + 1))
            keep, ks, parts, runs, sketches = [], [], [], [], []
            for i in np.flatnonzero(count):
                own = np.unique(h[cut[i] : cut[i + 1]])
                keep.append(i)
                ks.append(min(RUN, int(count[i])))
                parts.append(len(own).bit_length())
                runs.append(own.tobytes())
                sketches.append(np.sort(order_value(own))[: sketch_size(len(own), threshold)])
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column("item_id"), picked.column("text"), pa.array(ks, pa.int32()), pa.array(parts, pa.int32()), pa.array(runs, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["item_id", "text", "k", "part", "runs", "sketch"],
            )

    return benchmark.select("item_id", "text").mapInArrow(build, "item_id long, text string, k int, part int, runs binary, sketch array<long>")


def document_sketches(data: np.ndarray, offsets: np.ndarray, reach: dict[tuple[int, int], int], threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each (k, part): the values and rows of the documents' sketches, and all runs and their rows."""
    start, end, row = K.words(data, offsets)
    if not len(start):
        return
    hashes = K.word_hashes(data, start, end)
    for k in sorted({k for k, _ in reach}):
        h, r = K.shingles(hashes, row, len(offsets) - 1, k)
        value, size = order_value(h), np.bincount(r, minlength=len(offsets) - 1)
        for part in sorted(p for q, p in reach if q == k):
            least = threshold * (1 << (part - 1)) - 1e-9  # runs that an item of this partition asks for
            at = np.flatnonzero((value <= reach[k, part]) & (size[r] >= least))
            yield k, part, value[at], r[at], h, r


class Items:
    """Sketches and runs of all items, for one task's search."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.texts = [r["text"] for r in rows]
        self.runs = [np.frombuffer(r["runs"], K.U64) for r in rows]
        self.index, self.reach = {}, {}
        for key in sorted({(r["k"], r["part"]) for r in rows}):
            own = [(np.array(r["sketch"], np.int64), i) for i, r in enumerate(rows) if (r["k"], r["part"]) == key]
            values = np.concatenate([v for v, _ in own])
            items = np.concatenate([np.full(len(v), i) for v, i in own])
            order = np.argsort(values, kind="stable")
            gate = np.zeros(1 << 16, dtype=bool)
            gate[values & 0xFFFF] = True
            self.index[key] = (values[order], items[order], gate)
            self.reach[key] = int(values.max())

    def search(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(row, item, matched) of each text of the buffer that contains an item."""
        for k, part, value, row, h, r in document_sketches(data, offsets, self.reach, threshold):
            values, items, gate = self.index[k, part]
            at = np.flatnonzero(gate[value & 0xFFFF])
            at = at[np.isin(value[at], values)]
            lo, hi = np.searchsorted(values, value[at]), np.searchsorted(values, value[at], side="right")
            pairs = {(int(row[a]), int(items[j])) for a, x, y in zip(at, lo, hi, strict=True) for j in range(x, y)}
            own: dict[int, np.ndarray] = {}
            for i, j in sorted(pairs):
                if i not in own:
                    own[i] = h[np.searchsorted(r, i) : np.searchsorted(r, i, side="right")]
                matched = int(np.isin(self.runs[j], own[i]).sum())
                if matched < threshold * len(self.runs[j]) - 1e-9:
                    continue
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogateescape")
                matched = len(word_runs(self.texts[j], k) & word_runs(text, k))
                if matched >= threshold * len(self.runs[j]) - 1e-9:
                    yield i, j, matched


def _items(spark, items: DataFrame, most_broadcast: int):
    """The broadcast items, or None when they are too many or too long."""
    n = items.agg(F.coalesce(F.sum(F.octet_length("runs")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    small = n[0] // 8 <= most_broadcast and n[1] <= MOST_TEXT
    return spark.sparkContext.broadcast(items.orderBy("item_id").collect()) if small else None


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, item_shingles, matched and containment of each pair that holds."""
    items = item_runs(benchmark, threshold)
    sent = _items(docs.sparkSession, items, most_broadcast)
    if sent is None:
        return contained_items_joined(docs, items, threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(sent.value)
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = K.utf8(batch.column("text"))
            rows, cols = [], [[], [], [], []]
            for a, b in K.slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for i, j, m in own.search(part, off, threshold):
                    n = len(own.runs[j])
                    rows.append(a + i)
                    for c, v in zip(cols, (own.ids[j], n, m, m / n), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                names=["doc_id", "item_id", "item_shingles", "matched", "containment"],
            )

    return docs.select("doc_id", "text").mapInArrow(search, PAIRS).distinct()


def contained_items_joined(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same search when the items are too many to send: runs and sketches meet by value, texts only in the pairs found."""
    sketches = items.select("item_id", "k", "part", F.explode("sketch").alias("value"))
    reach = {(r["k"], r["part"]): r["top"] for r in sketches.groupBy("k", "part").agg(F.max("value").alias("top")).collect()}  # a row for each partition
    gate = _gate(sketches)
    sent = docs.sparkSession.sparkContext.broadcast(gate)  # 2**GATE_BITS bits

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for k, p, value, row, _, _ in document_sketches(part, off, reach, threshold):
                    low = value & ((1 << GATE_BITS) - 1)
                    at = np.flatnonzero((np.frombuffer(sent.value, np.uint8)[low >> 3] >> (low & 7)) & 1)
                    key = batch.column("own").take(pa.array(row[at] + a))
                    own = [pa.array(value[at]), pa.array(np.full(len(at), k), pa.int32()), pa.array(np.full(len(at), p), pa.int32())]
                    yield pa.RecordBatch.from_arrays([key, *own], names=["own", "value", "k", "part"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, k, x, y in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "k", "text", "item_text")], strict=True):
                own = word_runs(y, k)
                m = len(own & word_runs(x or "", k))
                if m >= threshold * len(own) - 1e-9:
                    out.append({"doc_id": doc, "item_id": item, "item_shingles": len(own), "matched": m, "containment": m / len(own)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int32()), ("matched", pa.int32()), ("containment", pa.float64())]))

    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    seen = docs.select("own", "text").mapInArrow(values, "own long, value long, k int, part int").distinct()
    pairs = seen.join(sketches, ["value", "k", "part"]).select("own", "item_id").distinct()
    found = pairs.join(docs, "own").join(items.select("item_id", "k", F.col("text").alias("item_text")), "item_id")
    return found.select("doc_id", "item_id", "k", "text", "item_text").mapInArrow(verify, PAIRS).distinct()


def _gate(sketches: DataFrame) -> bytes:
    """Bits of the values that some sketch has, collected as distinct places (at most 2**GATE_BITS)."""
    low = F.col("value").bitwiseAND(F.lit((1 << GATE_BITS) - 1)).cast("int")
    table = np.zeros(1 << GATE_BITS, dtype=bool)
    table[[r["low"] for r in sketches.select(low.alias("low")).distinct().toLocalIterator()]] = True
    return np.packbits(table, bitorder="little").tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of `docs` that contain no item; all columns stay."""
    items = item_runs(benchmark, threshold)
    sent = _items(docs.sparkSession, items, most_broadcast)
    if sent is None:
        own = without(docs, "__own").withColumn("__own", F.xxhash64("doc_id", "text"))
        hit = contained_items_joined(own.select(F.col("__own").alias("doc_id"), "text"), items, threshold)
        return own.join(hit.select(F.col("doc_id").alias("__own")).distinct(), "__own", "left_anti").drop("__own")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(sent.value)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, b in K.slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for i, _, _ in own.search(part, off, threshold):
                    keep[a + i] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained_items(docs, benchmark)
