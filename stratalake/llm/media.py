"""Media columns: content-defined chunking of payloads, deduplicated by Spark joins and verified by reconstruction.

A payload is a text's UTF-8 bytes with bytes 255 after them up to a positive multiple of 576.  A rolling gear hash
over the last 32 bytes cuts it where its low bits are zero (at least `least` and at most `most` bytes after the last
cut; chunks are some 200 bytes on average, as half of the texts have less than 1.5 kB).  Two things come of it: a
recipe, the ordered list of chunks, and the chunk store, in which each digest is kept once with its bytes; both are
written as tables (Zstandard pages).

Most chunks stand in one place, so only names of chunks and the chunks that several packs share are moved.  A pack is
some 8 MB of texts that lie together in one task.  The first pack that has a chunk keeps it, next to the other chunks
of its texts; the store is written in buckets of packs and read back in these.  Packs learn from a copy of the texts in
buckets which chunks others keep; the copy is made and deleted in waves, a share of the tasks each.  Reading back, a
pack's own chunks lie in its bucket and those that other packs keep are sent to it; recipes are put together and
checked against their names, and the features computed from the bytes so rebuilt.

Packs meet by 64-bit keys of digests.  Two different chunks with one key end the run with an error (likely from some
10^9 chunks on); they never change a result.

The stored form of a payload is its recipe (digest and length of each chunk) followed by the chunks' bytes; its unit is
the 8-bit sample.  It depends on the payload alone, so a text has the same form in any table.  Equal payloads have one
recipe and are rebuilt once.

A null text is empty (576 bytes 255).  Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import bucketed, extend, forget, pieces, same_splits, stash, unlist

UNIT = 576
LEAST, MEAN_BITS, MOST = 64, 7, 4096
#: Gear values of the 256 bytes, by rule.
GEAR = (K.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of SHA-256 that name a chunk or a recipe.
NAME = 16
#: Bytes of text in a pack; texts of more than ONE_WAVE bytes are copied in so many WAVES, one copy at a time.
PACK_BYTES, WAVES, ONE_WAVE = 8 << 20, 6, 32 << 20
#: Spark writes 100,000 buckets at most.
MOST_BUCKETS = 20_000
ROW = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("recipe", pa.binary()), ("places", pa.list_(pa.int32()))])
STORE = pa.schema([("pack", pa.int64()), ("place", pa.int32()), ("digest", pa.binary()), ("bytes", pa.binary()), ("wants", pa.list_(pa.struct([("pack", pa.int64()), ("place", pa.int32())])))])
FEATURES = pa.schema([("recipe", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string())])
FEATURE_COLUMNS = "recipe binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over k < 32 (fewer at the start), modulo 2**32, by doubling."""
    h, width = GEAR[data], 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def padded(size: int) -> int:
    return max(1, -(-size // UNIT)) * UNIT


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) with each row filled up."""
    sizes = np.diff(offsets)
    full = np.maximum(1, -(-sizes // UNIT)) * UNIT
    off = np.concatenate(([0], np.cumsum(full))).astype(np.int64)
    out = np.full(off[-1], 255, dtype=np.uint8)
    for i, n in enumerate(sizes):
        out[off[i] : off[i] + n] = data[offsets[i] : offsets[i + 1]]
    return out, off


def cut_points(hashes: np.ndarray, offsets: np.ndarray, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> Iterator[list[int]]:
    """The ends of the chunks of each row.  A cut looks at bytes of its own row only, as least is over 32."""
    marks = np.flatnonzero((hashes >> np.uint32(32 - bits)) == 0) + 1
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], a
        while b - at > least:
            i = int(np.searchsorted(marks, at + least))
            end = min(int(marks[i]) if i < len(marks) else b, at + most, b)
            ends.append(end)
            at = end
        if at < b:
            ends.append(b)
        yield ends


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, memoryview, list[bytes], list[int], np.ndarray]]:
    """row, payload, digests and ends of the chunks of each row of a batch."""
    data, offsets = K.utf8(batch.column("text"))
    for a, b in K.slices(offsets):
        raw, off = payloads(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        view = memoryview(raw)
        for i, ends in enumerate(cut_points(gear_hash(raw), off)):
            at, digests = int(off[i]), []
            for end in ends:
                digests.append(hashlib.sha256(view[at:end]).digest()[:NAME])
                at = end
            yield a + i, view[off[i] : off[i + 1]], digests, [e - int(off[i]) for e in ends], offsets


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, recipe (hash of the list) and digests of each row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists, sizes = [], [], []
            for i, _, digests, _, offsets in chunks(batch):
                names.append(hashlib.sha256(b"".join(digests)).digest()[:NAME])
                lists.append(digests)
                sizes.append(int(offsets[i + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                names=["doc_id", "n_bytes", "recipe", "digests"],
            )

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n_bytes long, recipe binary, digests array<binary>")


def steady(docs: DataFrame) -> DataFrame:
    """`docs` if they are read from files, in the same order every time; anything else (shuffles, functions) is written first."""
    nodes = re.findall(r"^[\s:+*\-]*(?:\(\d+\) )?(\w+)", docs._jdf.queryExecution().sparkPlan().toString(), re.M)
    return docs if set(nodes) <= {"Project", "Filter", "FileScan", "Union", "LocalTableScan"} else stash(docs)


def sliced(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The number of a pack and its rows: some `each` bytes of text that lie together in one task."""
    pack = TaskContext.get().partitionId() << 32
    for batch in batches:
        _, offsets = K.utf8(batch.column("text"))
        for a, b in K.slices(offsets, each):
            yield pack, batch.slice(a, b - a)
            pack += 1


def listing(docs: DataFrame, each: int = PACK_BYTES) -> DataFrame:
    """A row for each pack: the keys (8 bytes of the digest) of its different chunks, and its rows' recipes as places among these."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, batch in sliced(batches, each):
            places: dict[bytes, int] = {}
            rows = []
            for i, _, digests, _, offsets in chunks(batch):
                at = [places.setdefault(d, len(places)) for d in digests]
                rows.append({"doc_id": batch.column("doc_id")[i].as_py(), "n_bytes": int(offsets[i + 1] - offsets[i]), "recipe": hashlib.sha256(b"".join(digests)).digest()[:NAME], "places": at})
            keys = np.frombuffer(b"".join(d[:8] for d in places), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([rows], pa.list_(ROW))], names=["pack", "keys", "rows"])

    return docs.mapInArrow(build, "pack long, keys array<long>, rows array<struct<doc_id: long, n_bytes: long, recipe: binary, places: array<int>>>")


def owners(listed: DataFrame) -> DataFrame:
    """pack and place of every chunk that stands in several packs: the first keeps it, and `wants` tells who gets it; for the others that is null."""
    seen = listed.select("pack", F.posexplode("keys").alias("place", "key")).select("key", F.struct("pack", "place").alias("at"))
    seen = seen.withColumn("owner", F.min("at").over(Window.partitionBy("key"))).where("at <> owner").select("owner", "at")
    seen = stash(seen)  # a row for each further pack of a chunk
    kept = seen.groupBy("owner").agg(F.collect_list("at").alias("wants")).select("owner.*", "wants")
    return stash(kept.unionByName(seen.select("at.*"), allowMissingColumns=True))


def copied(docs: DataFrame, wave: int, waves: int, each: int) -> DataFrame:
    """pack, row and text of the tasks of one wave."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, batch in sliced(batches, each):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pack)), pa.array(np.arange(n, dtype=np.int32)), batch.column("text")], names=["pack", "row", "text"])

    return docs.where(F.spark_partition_id() % waves == wave).mapInArrow(build, "pack long, row int, text string")


def kept_chunks(texts: DataFrame, told: DataFrame) -> DataFrame:
    """pack, place, digest, bytes and `wants` of the chunks that the packs keep: each digest once."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in STORE.names}
        if left.num_rows:
            wants = dict(zip(right["place"].to_pylist(), right["wants"].to_pylist(), strict=True))
            places: dict[bytes, int] = {}
            for _, payload, digests, ends, _ in chunks(left.sort_by("row").combine_chunks().to_batches()[0]):
                at = 0
                for digest, end in zip(digests, ends, strict=True):
                    if digest not in places:
                        place = places[digest] = len(places)
                        if wants.get(place, True):  # None: another pack keeps it
                            for c, v in zip(STORE.names, (left["pack"][0].as_py(), place, digest, bytes(payload[at:end]), wants.get(place)), strict=True):
                                out[c].append(v)
                    at = end
        return pa.Table.from_pydict(out, STORE)

    return texts.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(build, "pack long, place int, digest binary, bytes binary, wants array<struct<pack: long, place: int>>")


def features(name: bytes, parts: list[bytes]) -> dict:
    """A row of FEATURES, and the payload: these chunks, which must be those of the recipe."""
    names = [hashlib.sha256(p).digest()[:NAME] for p in parts]
    if hashlib.sha256(b"".join(names)).digest()[:NAME] != name:
        raise ValueError("the chunks as stored are not those of the recipe")
    raw = b"".join(parts)
    form = b"".join(d + len(p).to_bytes(4, "big") for d, p in zip(names, parts, strict=True)) + raw
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    return {
        "recipe": name, "payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).digest(), "tail_crc32": zlib.crc32(raw[-32:]),
        "media_bytes": len(form), "media_sha256": hashlib.sha256(form).digest(),
        "feature": f"chunks={len(parts)};symbols={len(share)};entropy={-float((share * np.log2(share)).sum()):.6f};mean={float(np.frombuffer(raw, np.uint8).mean()):.6f}",
        "payload": raw,
    }


def rebuilt(listed: DataFrame, store: DataFrame, payload: bool = False) -> DataFrame:
    """The features of each recipe (and with `payload` its bytes), from its chunks as stored.

    A recipe is rebuilt in the first pack that has it; that pack's chunks lie in its bucket of the store, and the
    others come to it from the packs that keep them.
    """

    told = FEATURES.append(pa.field("payload", pa.binary())) if payload else FEATURES

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[int, bytes] = {}
        for table, column in ((left, "bytes"), (right, "sent")):
            if table.num_rows:
                parts.update((p, b) for p, b in zip(table["place"].to_pylist(), table[column].to_pylist(), strict=True) if p is not None)
        wanted = zip(right["recipe"].to_pylist(), right["places"].to_pylist(), strict=True) if right.num_rows else ()
        try:
            rows = [features(name, [parts[p] for p in places]) for name, places in wanted if name is not None]
        except KeyError:
            raise ValueError("a chunk of a recipe is not in the store") from None
        return pa.Table.from_pylist(rows, told)

    rows = listed.select("pack", F.inline("rows"))
    once = rows.groupBy("recipe").agg(F.min(F.struct("pack", "places")).alias("at")).select("at.*", "recipe")
    # under a name of their own, as both sides of the grouping read the store
    sent = store.where("wants is not null").select(F.inline("wants"), F.col("bytes").alias("sent"))
    needs = sent.unionByName(once, allowMissingColumns=True)
    return store.select("pack", "place", "bytes").groupBy("pack").cogroup(needs.groupBy("pack")).applyInArrow(build, FEATURE_COLUMNS + (", payload binary" if payload else ""))


def chunk_store(docs: DataFrame, each: int = PACK_BYTES, one_wave: int = ONE_WAVE) -> tuple[DataFrame, DataFrame]:
    """The listing of `docs` and the store of its chunks, both as written."""
    docs = steady(docs.select("doc_id", "text"))
    with same_splits(docs.sparkSession):
        listed = stash(listing(docs, each))
        size = listed.agg(F.count("*").alias("packs"), F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["n_bytes"])).alias("bytes")).first()
        total = size["bytes"] or 0
        into, waves = min(max(1, size["packs"]), pieces(total, each), MOST_BUCKETS), WAVES if total > one_wave else 1
        told, store = owners(listed), None
        for wave in range(waves):
            texts = stash(bucketed(copied(docs, wave, waves, each), "pack", pieces(into, waves)))
            part = bucketed(kept_chunks(texts, told.where(F.shiftright("pack", 32) % waves == wave)), "pack", into)
            store = extend(store, part) if store else stash(part)
            forget(texts)
    unlist(store)
    return listed, store


def op6_media_chunks(docs: DataFrame) -> DataFrame:
    listed, store = chunk_store(docs)
    rows = listed.select(F.inline("rows")).drop("places")
    made = rows.join(rebuilt(listed, store), "recipe").drop("recipe")
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
