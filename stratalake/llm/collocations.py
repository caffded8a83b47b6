"""Phrase collocation mining: phrases of 2 to MOST words counted in HAT-tries, spilled as sorted runs, merged by prefix partition.

Words that occur LEAST times in a language get numbers; no phrase with another word can occur so often.  From every
occurrence of such a word goes the run of up to MOST numbered words that starts there, and a task counts equal runs in a
HAT-trie: a shallow trie over word numbers whose leaves are hash containers of the rest of the run.  A container bursts
into a trie node when it holds more than BURST rests.  When a task holds over HELD runs, its largest subtrees are spilled
whole, each as a sorted run, in blocks of up to BLOCK keys.  Blocks are written; their first keys give the bounds of
prefix partitions of about RANGE keys each, blocks are cut there, and a task merges the blocks of a partition and counts
every prefix of 2 to MOST words.  A frequent prefix is cut where it is large: what the first and the last prefix of a
partition count may go on in its neighbours and is added up after that.

The numbers go to tasks while there are at most MOST_WORDS of them in MOST_BYTES, and are joined to the words of documents
(cut into parts of PART words) beyond; counts are the same.  The score is exact in 38 digits.

A null lang counts as `und`, a null text as empty; rows count one by one, also equal ones; other columns, doc_id included,
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dense_ids, forget, pieces, stash

MOST, LEAST, TOP = 5, 100, 2000
BURST, HELD = 4096, 250_000
MOST_WORDS, MOST_BYTES = 1 << 20, 32 << 20
PART = 1 << 15
#: Keys of a written block, and about those of a prefix partition; blocks whose first keys give the bounds of partitions.
BLOCK, RANGE, SEEN = 8192, 500_000, 100_000
_BLOCK = "first binary, n long, data binary"
_ENDS = bytes.maketrans(b".,;:!?\v\f\r", b"\n" * 9)
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")


def chunks(text: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in lower case (A-Z) whose pieces end with a newline, in chunks that end between words."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if len(data) - at > size else None
        end = gap.start() if gap else len(data)
        yield data[at:end].lower().translate(_ENDS)
        at = end


class HatTrie:
    """Counts of keys of `words` words of `width` bytes.  Nodes are dicts by word, containers Counters of the rest of the key."""

    def __init__(self, words: int = MOST, width: int = 4, burst: int = BURST) -> None:
        self.words, self.width, self.burst, self.root, self.size = words, width, burst, {}, 0

    def add(self, first: bytes, rests: list[bytes]) -> None:
        """Keys that share their first word, their rests in order of the second."""
        self.size += self._put(self.root, first, rests, self.words - 1)

    def _put(self, node: dict, word: bytes, rests: list[bytes], left: int) -> int:
        child = node.get(word)
        if child is None:
            child = node[word] = Counter()
        if isinstance(child, Counter):
            before = len(child)
            child.update(rests)
            if left > 1 and len(child) > self.burst:
                node[word] = self._burst(child)
            return len(child) - before
        more, at, w = 0, 0, self.width
        while at < len(rests):
            next_, end = rests[at][:w], at + 1
            while end < len(rests) and rests[end][:w] == next_:
                end += 1
            more += self._put(child, next_, [r[w:] for r in rests[at:end]], left - 1)
            at = end
        return more

    def _burst(self, container: Counter) -> dict:
        node: dict = {}
        for rest, n in container.items():
            child = node.get(word := rest[: self.width])
            if child is None:
                child = node[word] = Counter()
            child[rest[self.width :]] = n
        return node

    def spill(self, keep: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Takes out the largest subtrees below the root whole, until `keep` keys are left."""
        for size, word in sorted(((_size(child), word) for word, child in self.root.items()), reverse=True):
            if self.size <= keep:
                return
            self.size -= size
            keys, counts = [], []
            _gather(self.root.pop(word), word, keys, counts)
            yield keys, counts


def _size(node: dict) -> int:
    return len(node) if isinstance(node, Counter) else sum(map(_size, node.values()))


def _gather(node: dict, prefix: bytes, keys: list[bytes], counts: list[int]) -> None:
    if isinstance(node, Counter):
        keys += [prefix + rest for rest in node]
        counts += node.values()
    else:
        for word, child in node.items():
            _gather(child, prefix + word, keys, counts)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f); the row of a language with a null word has the number of all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, words in found.items() for word, n in words.items()]
            flat += [(lang, None, words.total()) for lang, words in found.items()]
            langs, words, ns = zip(*flat, strict=True) if flat else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for chunk in chunks(text.as_py()):
                    found[lang].update(chunk.split())
            if sum(map(len, found.values())) > HELD:
                yield rows()
        yield rows()

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _runs(ids: np.ndarray, starts: int) -> np.ndarray:
    """The runs of two to MOST numbers that start before `starts`: one row each, zeros behind the end; 0 in `ids` ends a run."""
    ahead = np.concatenate((ids, np.zeros(MOST - 1, np.uint32)))
    runs = np.stack([ahead[j : j + starts] for j in range(MOST)], axis=1)
    runs = runs[(runs[:, 0] > 0) & (runs[:, 1] > 0)]
    for j in range(2, MOST):
        runs[runs[:, j - 1] == 0, j] = 0
    return runs


def _merged(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    order = np.lexsort(runs.T[::-1])
    runs, counts = runs[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]).any(axis=1)))) if len(runs) else np.zeros(0, np.int64)
    return runs[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(runs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[bytes, int, bytes]]:
    """Rows of a written table from keys in order: the first key, the number of keys, the keys column by column with their counts.

    The first word is told by its step from the row before, the second too while the first stays; of all numbers the lowest
    bytes come first, then the next ones, so that what is alike stands together and packs well.
    """
    for at in range(0, len(runs), BLOCK):
        some = runs[at : at + BLOCK].astype(np.int64)
        columns = [*some.T, counts[at : at + BLOCK]]
        step = np.diff(some[:, 0], prepend=0)
        columns[0], columns[1] = step, np.where(step == 0, np.diff(some[:, 1], prepend=0), some[:, 1])
        planes = np.stack(columns).astype("<u4").view(np.uint8).reshape(MOST + 1, -1, 4).transpose(0, 2, 1)
        yield runs[at].astype(">u4").tobytes(), len(some), pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _read_block(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 4 * n * (MOST + 1), "zstd", asbytes=True), np.uint8).reshape(MOST + 1, 4, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(MOST + 1, n)
    step, second = columns[0], np.cumsum(columns[1], dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], step[1:] != 0)))
    second -= np.repeat(second[starts] - columns[1][starts], np.diff(np.concatenate((starts, [n]))))
    runs = np.stack([np.cumsum(step, dtype=np.int64), second, *columns[2:MOST]], axis=1).astype(np.uint32)
    return runs, columns[MOST].astype(np.int64)


class Counting:
    """A task's trie, fed with numbers of words; what comes out are blocks of spilled runs."""

    def __init__(self) -> None:
        self.trie, self.ids = HatTrie(), []

    def feed(self, numbers: list[int]) -> Iterator[pa.RecordBatch]:
        self.ids += numbers
        if len(self.ids) > HELD:
            tail = self.ids[1 - MOST :]
            yield from self.insert(np.array(self.ids, np.uint32), len(self.ids) - len(tail))
            self.ids = tail

    def insert(self, ids: np.ndarray, starts: int) -> Iterator[pa.RecordBatch]:
        """Runs that start before `starts`; the others come again."""
        runs = _runs(ids, starts)
        runs = runs[np.argsort(runs[:, 0].astype(np.uint64) << np.uint64(32) | runs[:, 1], kind="stable")]
        raw, width = runs.astype(">u4").tobytes(), 4 * MOST
        rests = [raw[i + 4 : i + width] for i in range(0, len(raw), width)]
        cuts = [*np.flatnonzero(np.diff(runs[:, 0].astype(np.int64), prepend=0)).tolist(), len(runs)]
        for a, b in pairwise(cuts):
            self.trie.add(raw[width * a : width * a + 4], rests[a:b])
        if self.trie.size > HELD:
            yield from self._spilled(HELD // 4)

    def _spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        counts: list[int] = []
        for k, n in self.trie.spill(keep):
            keys += k
            counts += n
            if len(keys) > 8 * BLOCK:
                yield _batch(keys, counts)
                keys, counts = [], []
        if keys:
            yield _batch(keys, counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.insert(np.array(self.ids, np.uint32), len(self.ids))
        yield from self._spilled(0)


def _batch(keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
    """Whole subtrees as blocks of one sorted run."""
    runs = np.frombuffer(b"".join(keys), ">u4").astype(np.uint32).reshape(-1, MOST)
    first, n, data = zip(*_blocks(*_merged(runs, np.array(counts, np.int64))), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["first", "n", "data"])


def count_by_broadcast(docs: DataFrame, numbers: dict[str, dict[bytes, int]]) -> DataFrame:
    """Sorted runs of counted keys, with the words' numbers in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                number = numbers.get(lang, {}).get
                for chunk in chunks(text.as_py()):
                    found: list[int] = []
                    for piece in chunk.split(b"\n"):
                        found += [number(w, 0) for w in piece.split()]
                        found.append(0)
                    found.pop()  # the last piece goes on in the next chunk
                    yield from counting.feed(found)
                yield from counting.feed([0])
        yield from counting.rest()

    return docs.mapInArrow(run, _BLOCK)


def count_by_join(docs: DataFrame, words: DataFrame, part: int = PART) -> DataFrame:
    """The same with the numbers joined to the words of documents, part by part; a part carries the words that its last runs need."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "part", "starts", "lang", "at", "word"]
        for batch in batches:
            for row, lang, text in zip(batch["row"].to_pylist(), batch["lang"].to_pylist(), batch["text"], strict=True):
                ahead: list[bytes | None] = []
                at = 0

                def rows(some: list, starts: int, at: int, row: int = row, lang: str = lang) -> pa.RecordBatch:
                    n = len(some)
                    columns = [pa.array([row] * n, pa.int64()), pa.array([at] * n, pa.int64()), pa.array([starts] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(some, pa.binary()).cast(pa.string())]
                    return pa.RecordBatch.from_arrays(columns, names)

                for chunk in chunks(text.as_py()):
                    for i, piece in enumerate(chunk.split(b"\n")):
                        ahead += ([None] if i else []) + piece.split()
                    while len(ahead) >= part + MOST:
                        yield rows(ahead[: part + MOST - 1], part, at)
                        ahead, at = ahead[part:], at + 1
                if ahead:
                    yield rows(ahead, len(ahead), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting()
        for batch in batches:
            for ids, starts in zip(batch["ids"], batch["starts"].to_pylist(), strict=True):
                yield from counting.insert(ids.values.to_numpy().astype(np.uint32), starts)
        yield from counting.rest()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "lang", "text")
    rows = rows.mapInArrow(split, "row long, part long, starts int, lang string, at int, word string")
    named = rows.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    one = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("id").cast("int"), F.lit(0)).alias("id")))), lambda x: x["id"])
    return named.groupBy("row", "part", "starts").agg(one.alias("ids")).select("ids", "starts").mapInArrow(run, _BLOCK)


def bounds(blocks: DataFrame) -> tuple[list[bytes], int]:
    """Keys at which prefix partitions begin, and the number of all keys.  SEEN first keys at most come to the driver."""
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("keys")).first()
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, pieces(size.keys or 0, RANGE))
    seen = blocks.select("first", "n") if size.blocks <= SEEN else blocks.select("first", "n").sample(SEEN / size.blocks / 1.5, seed=1)
    firsts = sorted((bytes(r.first), r.n) for r in seen.limit(SEEN).collect())
    total, at, out = sum(n for _, n in firsts), 0, []
    for key, n in firsts:
        if at * parts >= (len(out) + 1) * total and key != (out[-1] if out else None):
            out.append(key)
        at += n
    return out, size.keys or 0


def prefix_counts(blocks: DataFrame, least: int) -> DataFrame:
    """(key, f) of every prefix of two words or more that occurs `least` times."""
    starts, _ = bounds(blocks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                out: list[tuple[int, bytes, int, bytes]] = []
                for first, n, data in zip(*[batch.slice(i, 32)[c].to_pylist() for c in ("first", "n", "data")], strict=True):
                    runs, counts = _read_block(n, data)
                    low, high = bisect_right(starts, first), bisect_right(starts, runs[-1].astype(">u4").tobytes())
                    if low == high:
                        out.append((low, first, n, data))
                        continue
                    keys = np.frombuffer(runs.astype(">u4").tobytes(), f"S{4 * MOST}")
                    at = [0, *np.searchsorted(keys, np.array(starts[low:high], keys.dtype)).tolist(), n]
                    for p, (a, b) in enumerate(pairwise(at), low):
                        out += [(p, *row) for row in _blocks(runs[a:b], counts[a:b])]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["p", "first", "n", "data"])

    def count(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        read = [_read_block(n, data) for n, data in held]
        runs, counts = _merged(np.concatenate([r for r, _ in read]), np.concatenate([c for _, c in read]))
        new = np.ones(runs.shape, bool)
        new[1:] = np.cumsum(runs[1:] != runs[:-1], axis=1) > 0
        keys, sums = [], []
        for depth in range(1, MOST):
            at = np.flatnonzero(new[:, depth])
            total = np.add.reduceat(counts, at)
            good = total >= least
            good[[0, -1]] = True  # these may go on in the partitions beside
            good &= runs[at, depth] > 0
            keys += [k.tobytes() for k in runs[at[good], : depth + 1].astype(">u4")]
            sums += total[good].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.int64())], ["key", "c"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for p, n, data in zip(batch["p"].to_pylist(), batch["n"].to_pylist(), batch["data"], strict=True):
                if p != at and held:
                    yield from count(held)
                    held = []
                at = p
                held.append((n, data.as_py()))
        if held:
            yield from count(held)

    dealt = blocks.mapInArrow(cut, f"p int, {_BLOCK}").select("p", "n", "data").repartitionById(len(starts) + 1, F.col("p"))
    return dealt.mapInArrow(merge, "key binary, c long").groupBy("key").agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def _words_of(column: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(column), F.lit(4)), lambda i: F.substr(F.col(column), i, F.lit(4)))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = 100, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, words, cut: each language's `top` phrases.

    A phrase goes if a longer one with its words inside occurs `inside` per cent as often.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = stash(count_words(docs).where((F.col("f") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    # frequent words have small numbers, which pack well
    frequent = counted.where("word is not null").repartitionByRange(F.desc("f"), "lang", "word").sortWithinPartitions(F.desc("f"), "lang", "word")
    words = stash(dense_ids(frequent, "id").join(totals, "lang").select("lang", "word", "f", "n", (F.col("id") + 1).alias("id")))
    size = words.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    if size.n <= most_words and (size.bytes or 0) <= most_bytes:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, number in words.select("lang", "word", "id").collect():  # at most most_words rows
            numbers[lang][word.encode()] = number
        runs = count_by_broadcast(docs, dict(numbers))
    else:
        runs = count_by_join(docs, words)
    runs = stash(runs)
    grams = stash(prefix_counts(runs, least))
    forget(runs)
    names = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "lang", "word", "f", "n")
    both = grams.unionByName(names.select("key", "f"))
    named = grams.withColumn("first", F.substring("key", 1, 4)).join(names.select(F.col("key").alias("first"), "lang", "n"), "first").select("key", "lang", "n", F.col("f").alias("a"))
    # every cut, with the counts of its parts
    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), (F.length("key") / 4 - 1).cast("int"))))
    cuts = cuts.withColumn("left", F.expr("substring(key, 1, 4 * k)")).withColumn("right", F.expr("substring(key, 4 * k + 1)"))
    cuts = cuts.join(both.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(both.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)"))
    weakest = cuts.groupBy("key", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the longer phrases that a phrase stands in
    longer = grams.where(F.length("key") > 8).withColumn("size", F.explode(F.expr("sequence(2, cast(length(key) / 4 as int) - 1)")))
    longer = longer.withColumn("at", F.explode(F.expr("sequence(0, cast(length(key) / 4 as int) - size)"))).select(F.expr("substring(key, 4 * at + 1, 4 * size)").alias("key"), "f")
    longer = longer.groupBy("key").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    # the words themselves
    spelled = kept.select("key", F.posexplode(_words_of("key")).alias("at", "one")).join(names.select(F.col("key").alias("one"), "word"), "one")
    spelled = spelled.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = kept.join(spelled, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", (F.length("key") / 4).cast("int").alias("words"), F.col("cut.k").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = stash(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut"))
    forget(counted, words, grams)
    return out


def op13_collocations(docs: DataFrame) -> DataFrame:
    return mine(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH piece AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)),
    size AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang),
    place AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 6)) AS k)),
    f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM place GROUP BY ALL HAVING count(*) >= 100),
    cand AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
    cut AS (SELECT *, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS c FROM cand)),
    scored AS (SELECT cut.lang, cut.phrase, a, fl.f AS l, fr.f AS r, n, c, ((1000::HUGEINT * a * n) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
        FROM cut JOIN size ON size.lang = cut.lang JOIN f AS fl ON fl.lang = cut.lang AND fl.k = c AND fl.phrase = lp
        JOIN f AS fr ON fr.lang = cut.lang AND fr.k = m - c AND fr.phrase = rp),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored) WHERE o = 1),
    part AS (SELECT lang, array_to_string(w[place:place + z - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(range(1, m - z + 2)) AS place FROM (SELECT *, unnest(range(2, m)) AS z FROM cand WHERE m > 2)) GROUP BY ALL)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
        SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank
        FROM best LEFT JOIN part ON part.lang = best.lang AND part.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
    WHERE rank <= 2000"""
