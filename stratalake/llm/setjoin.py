"""N-gram Jaccard join by set relations: links between texts that share num/den of their word runs.

A document's set holds its distinct runs of k words (ASCII lower case; a shorter text is one run).  Two sets link
when den * |x & y| >= num * |x | y|.  The join loses no link and works on distinct sets:

1. A table of 2**20 counters, filled from all documents, orders runs from rare to frequent.
2. Equal sets collapse into one (the strongest set relation: one set's answers are the other's).
3. Each set puts its prefix, the first |x| - ceil(t |x|) + 1 runs, into inverted lists, with its size and the run's
   position in the set.  Sets that link have a first common run, and it stands in both prefixes; as nothing before
   it is shared, sets with positions i and j differ in i + j + | |x| - i - |y| + j | runs at least.  A probe skips the
   whole block of a list whose sizes are out of reach, and inside it what stands at positions out of reach.  Lists
   with the same members collapse into the one of the least run.
4. Short lists give their pairs, long ones the pairs of each member with one pivot, the set with the least position
   (it has the fewest runs of its own).  A pair is dropped if the parity bitmaps of its sets differ in more bits than
   the sets may differ in runs, and the rest is verified on whole sets.
5. A set that links to a pivot takes over the pivot's answers: it is in the pivot's component, and no pair within a
   component is looked at again.  What remains of a long list are sets of different components whose positions are
   within reach.  A task that compares their bitmaps gives the sets that may link; these meet in a task with their
   whole sets, are verified there, and only links that join two components come out: fewer than there are sets.

So no row is made for a pair within a group of copies, no link between components is lost, and no list is cut.  A
list of over `block` sets is dealt to tasks as pairs of blocks, and a run with over `hot` occurrences is dealt to
lists by its sets' names before any list is built.

Runs are compared by 58-bit hashes and sets are named by 64-bit hashes of these: exact but for collisions.
A null or empty text has an empty set and links with nothing.  Rows with a null doc_id take no part in links and
have no component.  Repeated rows have equal sets.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, forget, pieces, stash

SLOT_BITS = 20
#: Counters travel in this many parts.
PARTS = 64
#: Ids of documents (8 bytes each) that are broadcast at most.
MOST_SENT = 1_000_000
LOW58 = np.uint64((1 << 58) - 1)


@dataclass(frozen=True)
class Rule:
    """Runs of k words; sets link at a Jaccard similarity of num/den."""

    k: int = 3
    num: int = 9
    den: int = 10

    def prefix(self, n: int) -> int:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def sizes_fit(self, small: int, large: int) -> bool:
        return self.den * small >= self.num * large

    def may_differ(self, n: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to n."""
        return (self.den - self.num) * n // (self.den + self.num)

    def linked(self, both: int, n: int) -> bool:
        return self.den * both >= self.num * (n - both)

    def in_reach(self, n: np.ndarray | int, i: np.ndarray | int, m: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        """Whether sets of n and m runs may link if their first common run stands at the places i and j."""
        return (i + j + abs((n - i) - (m - j))) * (self.den + self.num) <= (self.den - self.num) * (n + m)


def _runs(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """a, b and the (hash, row) pairs, row by row, of ranges of rows; hashes may repeat."""
    data, offsets = K.utf8(batch.column("text"))
    for a, b in K.slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, row = K.words(part, off)
        if not len(start):
            yield a, b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        yield a, b, *K.shingles(K.word_hashes(part, start, end), row, b - a, k)


def run_counts(docs: DataFrame, rule: Rule) -> np.ndarray:
    """2**SLOT_BITS counters of runs over all documents, summed up a tree of tasks."""
    width = (1 << SLOT_BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, h, _ in _runs(batch, rule.k):
                total += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        if total.any():
            node = TaskContext.get().partitionId() // 128
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PARTS), pa.int32()), pa.array([node] * PARTS, pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(PARTS)], pa.binary())],
                names=["part", "node", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "node": table.column("node")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, node int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("part", "node").applyInArrow(add, schema)
    out = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in rows.withColumn("node", F.lit(0)).groupBy("part", "node").applyInArrow(add, schema).collect():  # 8 * 2**SLOT_BITS bytes
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def ordered_sets(batch: pa.RecordBatch, k: int, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of each row that has words: distinct runs, rare ones first, as 64-bit values."""
    for a, b, h, row in _runs(batch, k):
        token = (rank[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h & LOW58)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        keep = np.ones(len(token), dtype=bool)
        keep[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        token, row = token[keep], row[keep]
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            if cut[i] < cut[i + 1]:
                yield a + i, token[cut[i] : cut[i + 1]]


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def parity(tokens: np.ndarray, each: int = 2) -> bytes:
    """Bit i is the parity of the runs that fall on it; some `each` bits for each run."""
    bits = 1 << min(16, max(7, int(each * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, at the shorter one's length: never more than the sets differ."""
    if len(x) > len(y):
        x, y = y, x
    a, b, n = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(y) * 8
    while n > len(x) * 8:
        n //= 2
        b = (b >> n) ^ (b & ((1 << n) - 1))
    return (a ^ b).bit_count()


def _rows_and_prefixes(docs: DataFrame, rule: Rule, rank_sent, buckets: int, hot: int) -> DataFrame:
    """Rows of two kinds: doc_id, sid, n and bits of each document; and prefix entries by bucket, packed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = rank_sent.value
        seen: set[int] = set()
        for batch in batches:
            n_rows = batch.num_rows
            ids, sizes, bits = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), [b""] * n_rows
            tokens, owners, lengths, places = [], [], [], []
            for i, own in ordered_sets(batch, rule.k, rank):
                ids[i], sizes[i], bits[i] = set_id(own), len(own), parity(own)
                if int(ids[i]) not in seen:
                    seen.add(int(ids[i]))
                    p = rule.prefix(len(own))
                    tokens.append(own[:p])
                    owners.append(np.full(p, ids[i]))
                    lengths.append(np.full(p, len(own), np.int32))
                    places.append(np.arange(p, dtype=np.int32))
            none = pa.nulls(n_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids), pa.array(sizes), pa.array(bits, pa.binary()), pa.nulls(n_rows, pa.int32()), none, none, none, none],
                names=["doc_id", "sid", "n", "bits", "bucket", "tokens", "owners", "lengths", "places"],
            )
            if not tokens:
                continue
            t, o, m, j = (np.concatenate(x) for x in (tokens, owners, lengths, places))
            where = ((t + _part(t, o, hot) * K.U64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            cut = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1)).tolist()  # of the buckets that are there
            at = [order[a:b] for a, b in pairwise(cut)]
            some = [int(where[x[0]]) for x in at]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), *[pa.array([x[i].tobytes() for i in at], pa.binary()) for x in (t, o, m, j)]],
                names=["doc_id", "sid", "n", "bits", "bucket", "tokens", "owners", "lengths", "places"],
            )

    schema = "doc_id long, sid long, n long, bits binary, bucket int, tokens binary, owners binary, lengths binary, places binary"
    return docs.select("doc_id", "text").mapInArrow(build, schema)


def _part(tokens: np.ndarray, owners: np.ndarray, hot: int) -> np.ndarray:
    """The part of its run's list that an entry belongs to: 1 for all, but for runs that may occur over `hot` times."""
    parts = K.U64(1) << np.maximum((tokens >> np.uint64(58)).astype(np.int64) - max(0, hot.bit_length() - 1), 0).astype(np.uint64)
    return np.where(parts > 1, K.U64(2) + K.mix(owners.view(np.uint64)) % parts, K.U64(1))


def _lists(entries: DataFrame, hot: int) -> DataFrame:
    """run, split and the members, sizes and places (packed, in order of size and place) of each inverted list of two or more sets.

    Lists with the same members are the same list, whose run is the least of theirs.  A hot run has several lists; they
    are all kept, as are those of one set, as pairs across them are still to be found.
    """

    def build(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        t, o, n, j = get("tokens", np.uint64), get("owners", np.int64), get("lengths", np.int32), get("places", np.int32)
        part = _part(t, o, hot)
        order = np.lexsort((o, j, n, part, t))
        t, o, n, j, part = t[order], o[order], n[order], j[order], part[order]
        same = (t[1:] == t[:-1]) & (part[1:] == part[:-1])
        keep = np.concatenate(([True], ~same | (o[1:] != o[:-1])))
        t, o, n, j, part = t[keep], o[keep], n[keep], j[keep], part[keep]
        heads = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(heads[1:], len(t))
        wanted = (ends - heads > 1) | (part[heads] > 1)
        found: dict[bytes, tuple] = {}
        for a, b in zip(heads[wanted].tolist(), ends[wanted].tolist(), strict=True):
            members, split = o[a:b].tobytes(), bool(part[a] > 1)
            name = blake2b(members + (t[a].tobytes() + part[a].tobytes() if split else b""), digest_size=16).digest()
            if name not in found:  # runs stand in order: the least comes first
                found[name] = (int(t[a]), split, members, n[a:b].tobytes(), j[a:b].tobytes())
        kinds = (("run", pa.int64()), ("split", pa.bool_()), ("members", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()))
        return pa.table({"name": pa.array(list(found), pa.binary()), **{c: pa.array([v[i] for v in found.values()], k) for i, (c, k) in enumerate(kinds)}})

    lists = entries.groupBy("bucket").applyInArrow(build, "name binary, run long, split boolean, members binary, sizes binary, places binary")
    least = lists.groupBy("name").agg(F.min_by(F.struct("run", "split", "members", "sizes", "places"), "run").alias("x"))
    return least.select("x.*", (F.octet_length("x.members") / 8).cast("long").alias("width"))


def _first_pairs(lists: DataFrame, rule: Rule, short: int) -> DataFrame:
    """a < b: all pairs in reach of short lists; of long lists, each member with the pivot."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for members, sizes, places in zip(*[batch.column(c).to_pylist() for c in ("members", "sizes", "places")], strict=True):
                if len(members) <= short * 8:
                    o, n, at = np.frombuffer(members, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(places, np.int32).tolist()
                    for j in range(1, len(o)):
                        for i in range(j - 1, -1, -1):
                            if not rule.sizes_fit(n[i], n[j]):
                                break  # members before are smaller still: skip the block
                            if rule.in_reach(n[i], at[i], n[j], at[j]):
                                out.add((min(o[i], o[j]), max(o[i], o[j])))
                else:
                    o, n, at = np.frombuffer(members, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(places, np.int32).astype(np.int64)
                    mid = int(np.lexsort((abs(np.arange(len(o)) - len(o) // 2), at))[0])
                    for x in o[rule.in_reach(n, at, n[mid], at[mid]) & (o != o[mid])].tolist():
                        out.add((min(x, int(o[mid])), max(x, int(o[mid]))))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("members", "sizes", "places").mapInArrow(build, "a long, b long").distinct()


def _near(pairs: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose bitmaps allow a link."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("a", "b", "na", "nb", "xa", "xb")]
            out = [(a, b) for a, b, n, m, x, y in zip(*c, strict=True) if least_difference(x, y) <= rule.may_differ(n + m)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    side = lambda s: info.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"x{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(build, "a long, b long")


def _whole_sets(sids: DataFrame, docs: DataFrame, info: DataFrame, rule: Rule, rank_sent, most_sent: int) -> DataFrame:
    """sid and tokens of the given sets, from the texts of their documents; dealt by sid, once for all joins on it."""
    wanted = stash(info.join(sids.distinct(), "sid", "left_semi").select("sid", "rep"))
    sent = F.broadcast if wanted.count() <= most_sent else lambda df: df  # else the texts meet the ids in a shuffled join
    ids = sent(wanted.select(F.col("rep").alias("doc_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {set_id(own): own.tobytes() for _, own in ordered_sets(batch, rule.k, rank_sent.value)}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["sid", "tokens"])

    held = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(sets, "sid long, tokens binary")
    return held.join(sent(wanted.select("sid")), "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Runs that two sorted sets share."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _verified(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "xa", "xb")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if rule.linked(_in_common(x, y), len(x) + len(y)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    side = lambda s: held.select(F.col("sid").alias(s), F.col("tokens").alias(f"x{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(link, "a long, b long")


def _open_members(lists: DataFrame, roots: DataFrame, rule: Rule, short: int) -> DataFrame:
    """run, sid, root, place and n of the members of long and split lists that a set of another component may be in reach of."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (members, sizes, places) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("members", "sizes", "places")], strict=True)):
                sid = np.frombuffer(members, np.int64)
                arrays = [batch.column("run").take(pa.array(np.full(len(sid), i))), pa.array(sid), pa.array(np.frombuffer(sizes, np.int32)), pa.array(np.frombuffer(places, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["run", "sid", "n", "place"])

    longer = lists.where((F.col("width") > short) | F.col("split")).select("run", "members", "sizes", "places")
    members = longer.mapInArrow(unpack, "run long, sid long, n int, place int")
    members = stash(members.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    # the least place of a run's list, and the least one among the other components
    first = members.groupBy("run").agg(F.min(F.struct("place", "root")).alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    first = stash(first.where("lo <> hi").select("run", F.col("f.place").alias("place1"), F.col("f.root").alias("root1")))
    mixed = members.join(first, "run")
    second = mixed.where("root <> root1").groupBy("run").agg(F.min("place").alias("place2"))
    mixed = mixed.join(second, "run").withColumn("other", F.when(F.col("root") == F.col("root1"), F.col("place2")).otherwise(F.col("place1")))
    # y of a link has at most n * den / num runs, so x and y differ in at most n * (den - num) / num
    found = stash(mixed.where((F.col("place") + F.col("other")) * rule.num <= F.col("n").cast("long") * (rule.den - rule.num)).select("run", "sid", "root", "place", "n"))
    forget(members, first)
    return found


class _List:
    """Members of a list in order of size, and what each one may have to be compared with."""

    def __init__(self, n: np.ndarray, place: np.ndarray, root: np.ndarray, own: np.ndarray | None, rule: Rule):
        self.order = np.lexsort((place, n))
        self.n, self.place, self.rule = n[self.order], place[self.order], rule
        self.names, self.root = np.unique(root[self.order], return_inverse=True)
        self.own = None if own is None else own[self.order]

    def probes(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member outside the largest component, and the members of other components whose size and place are in reach."""
        n, place, root, rule = self.n, self.place, self.root, self.rule
        main = int(np.bincount(root).argmax())
        for x in np.flatnonzero(root != main).tolist():
            lo = int(np.searchsorted(n, -(-rule.num * n[x] // rule.den)))
            hi = int(np.searchsorted(n, rule.den * n[x] // rule.num, side="right"))
            # pairs of two sets outside the main component come up twice: once is enough
            seen = (root[lo:hi] != root[x]) & ((root[lo:hi] == main) | (np.arange(lo, hi) < x)) & rule.in_reach(n[lo:hi], place[lo:hi], n[x], place[x])
            if self.own is not None:
                seen &= self.own[lo:hi] != self.own[x]
            if seen.any():
                yield x, np.flatnonzero(seen) + lo

    def near(self, x: int, at: np.ndarray, differ: np.ndarray) -> np.ndarray:
        return differ * (self.rule.den + self.rule.num) <= (self.rule.den - self.rule.num) * (self.n[at] + self.n[x])


class _Bitmaps:
    """Parity bitmaps of the members' own widths, and folded to half of them, as matrices."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(b) for b in bits])
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in sorted({int(x) for own in set(self.width.tolist()) for x in (own, own // 2)}):
            at = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            full = [np.frombuffer(bits[i], np.uint8) for i in at.tolist()]
            matrix = np.stack([f if len(f) == w else f[:w] ^ f[w:] for f in full])
            row = np.full(len(bits), -1)
            row[at] = np.arange(len(at))
            self.rows[w] = (row, matrix.view(np.uint64) if w % 8 == 0 else matrix)

    def differ(self, x: int, at: np.ndarray) -> np.ndarray:
        """Bits in which x differs from each of `at`, at the smaller width; 0 where widths are further apart than sizes in reach make them."""
        out = np.zeros(len(at), np.int64)
        for w in (int(self.width[x]), int(self.width[x]) // 2):
            row, matrix = self.rows[w]
            pick = np.flatnonzero(np.minimum(self.width[at], self.width[x]) == w)
            pick = pick[row[at[pick]] >= 0]
            if len(pick) and row[x] >= 0:
                out[pick] = np.bitwise_count(matrix[row[at[pick]]] ^ matrix[row[x]]).sum(axis=1)
        return out


def _in_touch(members: _List, bits: list[bytes]) -> np.ndarray:
    """Which members have another one of a different component that may link to them."""
    maps, out = _Bitmaps([bits[i] for i in members.order]), np.zeros(len(bits), bool)
    for x, at in members.probes():
        near = at[members.near(x, at, maps.differ(x, at))]
        if len(near):
            out[members.order[x]] = True
            out[members.order[near]] = True
    return out


def _joining_links(members: _List, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of verified links between components."""
    sets = [sets[i] for i in members.order]
    maps = _Bitmaps([parity(x, 4) for x in sets])
    up, out = np.arange(len(members.names)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    for x, at in members.probes():
        differ = maps.differ(x, at)
        near = members.near(x, at, differ)
        for y in at[near][np.argsort(differ[near], kind="stable")].tolist():
            a, b = top(members.root[x]), top(members.root[y])
            if a != b and members.rule.linked(_in_common(sets[x], sets[y]), int(members.n[x] + members.n[y])):
                up[max(a, b)] = min(a, b)
                out.append((int(members.names[members.root[x]]), int(members.names[members.root[y]])))
    return out


def _dealt(left: DataFrame, block: int) -> DataFrame:
    """Members of lists with own, lo and hi: every pair of blocks of a list is a task's."""
    blocks = left.groupBy("run").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = left.join(blocks, "run").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*left.columns, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _list_of(table: pa.Table, rule: Rule) -> _List:
    n, place, root, own = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "root", "own"))
    return _List(n, place, root, None if table.column("lo")[0] == table.column("hi")[0] else own, rule)


def _members_in_touch(left: DataFrame, info: DataFrame, rule: Rule, block: int) -> DataFrame:
    """The members of `left` that may link to another component, by their bitmaps: a row for a member, not for a pair."""

    def build(table: pa.Table) -> pa.Table:
        hit = _in_touch(_list_of(table, rule), table.column("bits").to_pylist())
        return table.select(["run", "sid", "root", "place", "n"]).filter(pa.array(hit))

    dealt = _dealt(left, block).join(info.select("sid", "bits"), "sid")
    found = dealt.groupBy("run", "lo", "hi").applyInArrow(build, "run long, sid long, root long, place int, n int")
    return stash(found.distinct())


def _across(left: DataFrame, held: DataFrame, rule: Rule, block: int) -> DataFrame:
    """a and b: links between components, found and verified in tasks that each hold two blocks of a list."""

    def build(table: pa.Table) -> pa.Table:
        out = _joining_links(_list_of(table, rule), [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return _dealt(left, block).join(held, "sid").drop("sid").groupBy("run", "lo", "hi").applyInArrow(build, "a long, b long")


def links(docs: DataFrame, rule: Rule = Rule(), short: int = 12, block: int = 4096, hot: int = 1 << 18, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, sid and n of each row; and root of each sid that has a link and is not its own root."""
    spark = docs.sparkSession
    counts = run_counts(docs, rule)
    rank = np.minimum(np.ceil(np.log2(counts + 1)), 31).astype(np.uint8)
    rank_sent = spark.sparkContext.broadcast(rank)  # 2**SLOT_BITS bytes
    buckets = pieces(int(counts.sum()) * (rule.den - rule.num) // rule.den, 400_000)
    both = stash(_rows_and_prefixes(docs, rule, rank_sent, buckets, hot))
    named = both.where("bucket is null and doc_id is not null and n > 0").select("doc_id", "sid", "n", "bits")
    info = stash(named.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    lists = stash(_lists(both.where("bucket is not null").select("bucket", "tokens", "owners", "lengths", "places"), hot))
    rows = stash(both.where("bucket is null").select("doc_id", "sid", "n"))
    forget(both)
    sets = lambda sids: _whole_sets(sids, docs, info, rule, rank_sent, most_sent)

    near = stash(_near(_first_pairs(lists, rule, short), info, rule))
    held = stash(_verified(near, sets(near.select(F.explode(F.array("a", "b")).alias("sid"))), rule))
    roots = _roots(spark, held)
    members = _open_members(lists, roots, rule, short)
    left = _members_in_touch(members, info, rule, block)
    joining = stash(_across(left, sets(left.select("sid")), rule, block))
    # the stars so far stand for all links before
    links_ = stash(roots.select(F.col("sid").alias("a"), F.col("root").alias("b")).unionByName(joining))
    found = _roots(spark, links_)
    forget(info, lists, near, held, members, left, joining, links_)
    return rows, found


def _roots(spark, held: DataFrame) -> DataFrame:
    return components(spark, held).select(F.col("node").alias("sid"), "root")


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    rows, roots = links(docs, rule)
    reps = rows.where("doc_id is not null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = reps.join(least, "root").select("sid", "component_id")
    joined = rows.join(of, "sid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(k=5, num=8, den=10)) -> DataFrame:
    """One row of `docs` for each component, with its smallest doc_id; rows without a doc_id stay.

    A row is known by doc_id and text: rows that share a doc_id alone each belong to the component of their text.
    """
    keyed = docs.where("doc_id is not null").withColumn("__row", F.xxhash64("doc_id", "text"))
    of = jaccard_components(keyed.select(F.col("__row").alias("doc_id"), "text"), rule).select(F.col("doc_id").alias("__row"), "component_id").distinct()
    ids = keyed.select("__row", "doc_id").distinct()
    lead = of.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("__row")).select("__row")
    names = [f"`{c}`" for c in docs.columns]
    kept = keyed.dropDuplicates(["__row"]).join(lead, "__row", "left_semi").select(*names)
    return kept.unionByName(docs.where("doc_id is null"))


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
