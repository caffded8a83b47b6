"""Suffix-array dedup: remove every byte covered by a `length`-byte string that also starts in an earlier document.

Shipping every suffix would cost many times the input, so suffixes are sorted where they can matter:

1. Anchors.  In each window of `length` bytes the gram (of `gram` bytes) with the least hash is its anchor; the choice
   depends on the window's bytes only, so equal windows have equal anchors at equal places.  About one position in
   (length - gram) / 2 is an anchor.  They are looked for once and travel with the text, as a byte each.
2. Fingerprints.  The windows of an anchor are parted into two halves by the bytes before the anchor; all windows of a
   half share about two thirds of their bytes (those from the least place before the anchor on).  Hashes of these bytes,
   one for each block of documents, meet in buckets; a half seen in one document only can bring no match and leaves.
   Nothing else is filtered.  (Grams alone are shared by chance, the more the larger the corpus; these bytes are not.)
   Grams that stand over `hot` times are told apart.
3. Contexts.  An anchor with a shared half travels with the bytes around it that its shared halves need: up to
   length - gram before it and length after its start.  Equal contexts collapse in each block and again in the bucket,
   keeping the least document.  So an exact copy, a hot passage or thousands of near copies cost one context for each
   block and each wording.
4. Suffix sorting.  In each bucket the contexts of one gram are sorted as suffixes (bytes from the anchor on) and as
   reversed prefixes (bytes before it), equal strings as one, by the deep-shallow method: multikey quicksort (three parts
   about a pivot, the middle one going on to the next seven bytes) down to a shallow depth; groups that still agree are
   ordered by a blind trie, which inserts by the bytes at branching depths alone and then compares once.  Both orders
   bring their longest common prefixes.
5. Windows.  The window that starts i bytes before an anchor is the same in two contexts exactly if their reversed
   prefixes share i bytes and their suffixes length - i: a run of each order.  The least document of a run pair is the
   window's first document.
   A hot gram's windows are parted into ranges of i.  All windows of a range share most of their bytes (those from the
   least i before the anchor on), so its contexts are dealt to tasks by these bytes and cut to what the range needs.
6. Answers go back to the blocks: in a document later than the first one of a context, all its windows are removed;
   in the first one, those windows whose first document is earlier still.

Long documents are worked on in pieces of `PIECE` bytes.  A null text is empty.  Rows that agree in doc_id hold one document's strings: a string in two rows of one doc_id is not
in a smaller one.  A null doc_id comes after all others.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pieces, row_hash

LENGTH, GRAM = 50, 16
LAST = np.int64((1 << 63) - 1)  # the place of a null doc_id
SHALLOW = 28
#: Bytes that a step of multikey quicksort compares; with the number of them that the string still has they fill a key.
STEP = 7
#: Bytes of a document whose anchors are looked for at a time, and anchors whose contexts are cut out at a time.
PIECE, ANCHORS = 4 << 20, 1 << 17
#: Ranges of windows that are marked apart, and those of a hot gram.
HALVES, RANGES = 2, 5
#: Bytes of a context's record before the bytes of the text: those before the anchor, those from it on, range of a hot gram.
HEAD = 3
#: A value for each byte, by rule.
_BYTE_VALUE = (K.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


# ---- deep-shallow suffix sorting -------------------------------------------------------------------------------------


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # x[:lo] == y[:lo], x[:hi] != y[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid)
    return lo


class BlindTrie:
    """Strings ordered by a Patricia trie that looks at branching bytes only on its way down.

    A node is [depth, children by byte]; a leaf is the list of equal strings' numbers.  A string that ends at a node's
    depth goes under the byte -1.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:  # blind descent: any child will do if the byte is missing
            kids = node[1]
            node = kids.get(self._at(s, node[0])) or next(iter(kids.values()))
        leaf = self.strings[node[1][0]]
        depth = common_prefix(s, leaf)
        if depth == len(s) == len(leaf):
            node[1].append(i)
            return
        parent, node = None, self.root
        while 0 <= node[0] < depth:
            parent, node = node, node[1].get(self._at(s, node[0]))
            if node is None:
                parent[1][self._at(s, parent[0])] = [-1, [i]]
                return
        if node[0] == depth:
            node[1][self._at(s, depth)] = [-1, [i]]
            return
        fork = [depth, {self._at(s, depth): [-1, [i]], self._at(leaf, depth): node}]
        if parent is None:
            self.root = fork
        else:
            parent[1][self._at(s, parent[0])] = fork

    def ordered(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                out.extend(node[1])
            else:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def _keys(matrix: np.ndarray, rows: np.ndarray, depth: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """STEP bytes of each row from its depth on, and how many of them are its own: a string that ends comes before one that goes on with zeros."""
    key = np.zeros((len(rows), 8), np.uint8)
    key[:, :STEP] = matrix[rows[:, None], depth[:, None] + np.arange(STEP)]
    key[:, STEP] = np.clip(lengths[rows] - depth, 0, STEP)
    return key.view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(matrix: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order, deep): the rows ordered within groups as far as `shallow` bytes tell, and the places [a, b) of rows that agree so far.

    All open parts take a step at once: each is parted into the rows below, at and above its pivot's key; those at it go
    deeper.
    """
    n = len(matrix)
    order, deep = np.argsort(group, kind="stable"), []
    padded = np.zeros((n, max(matrix.shape[1], shallow) + STEP), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    part, depth = group[order].astype(np.int64), np.zeros(n, np.int64)
    slots = np.arange(n)
    while len(slots):
        heads = np.flatnonzero(np.concatenate(([True], part[slots][1:] != part[slots][:-1])))
        sizes = np.diff(np.append(heads, len(slots)))
        many = np.repeat(sizes > 1, sizes)
        slots = slots[many]
        if not len(slots):
            break
        sizes = sizes[sizes > 1]
        heads = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(sizes)), sizes)
        rows, d = order[slots], depth[slots]
        key = _keys(padded, rows, d, lengths)
        pivot = key[heads + sizes // 2][own]
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        by = np.argsort(own * 3 + side, kind="stable")
        side, d = side[by], d[by] + STEP * (side[by] == 1)
        order[slots], depth[slots], part[slots] = rows[by], d, own[by] * 3 + side
        ended = (side == 1) & ((key[by] & np.uint64(0xFF)) < STEP)  # equal strings
        over = (side == 1) & ~ended & (d >= shallow)
        if over.any():
            at = slots[over]
            edges = np.flatnonzero(np.concatenate(([True], part[at][1:] != part[at][:-1], [True])))
            deep += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
        slots = slots[~(ended | over)]
    return order, deep


def deep_shallow(matrix: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of a zero-padded byte matrix within groups (sorted, first); lcp[i] is shared with the row before in the same group, else -1."""
    n = len(matrix)
    order, deep = multikey_quicksort(matrix, lengths, group, shallow)
    for a, b in deep:
        rows = order[a:b]
        trie = BlindTrie([matrix[r, : lengths[r]].tobytes() for r in rows])
        for i in range(b - a):
            trie.insert(i)
        order[a:b] = rows[trie.ordered()]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        x, y = matrix[order[:-1]], matrix[order[1:]]
        differ = x != y
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        lcp[1:] = np.minimum(first, np.minimum(lengths[order[:-1]], lengths[order[1:]]))
        lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, lcp


def _distinct(matrix: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sample, same): a row of each distinct string of a group, and where each row's string is among them."""
    key = K.mix(_context_key(matrix) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, sample, same = np.unique(key, return_index=True, return_inverse=True)
    own = sample[same]
    if (lengths != lengths[own]).any() or (group != group[own]).any() or (matrix != matrix[own]).any():
        return np.arange(len(key)), np.arange(len(key))  # two strings share a key: all are sorted
    return sample, same


def _by(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of equal numbers together, in their order, and the numbers so ordered."""
    bits = len(pair).bit_length()
    if int(pair.max()).bit_length() + bits > 63:
        by = np.argsort(pair, kind="stable")
        return by, pair[by]
    both = np.sort((pair << bits) | np.arange(len(pair)))
    return both & ((1 << bits) - 1), both >> bits


def first_documents(gram: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each context and i: the least document with the window that starts i bytes before the anchor; LAST where there is no such window."""
    n, reach = len(gram), before.shape[1]
    _, group = np.unique(gram, return_inverse=True)
    sides = []
    for matrix, lengths in ((after, n_after), (before, n_before)):
        sample, same = _distinct(matrix, lengths, group)
        order, lcp = deep_shallow(matrix[sample], lengths[sample], group[sample])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sides.append((place[same], lcp))
    (right, right_lcp), (left, left_lcp) = sides
    out = np.full((n, reach + 1), LAST, dtype=np.int64)
    early = np.argsort(doc, kind="stable")
    for i in range(reach + 1):
        at = early[((n_before >= i) & (n_after >= length - i))[early]]
        if not len(at):
            continue
        by, pair = _by(np.cumsum(right_lcp < length - i)[right[at]] * (n + 1) + np.cumsum(left_lcp < i)[left[at]])
        order = at[by]
        head = np.ones(len(order), dtype=bool)
        head[1:] = pair[1:] != pair[:-1]
        out[order, i] = doc[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
    return out


# ---- anchors ---------------------------------------------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values, by doubling."""
    n, out, step = len(values) - width + 1, values, 1
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[:n], out[width - step : width - step + n]) if step < width else out


def _order(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit value over zero for each gram, which says what gram of a window is least: sum of a byte's value << its place, by doubling."""
    h, width = _BYTE_VALUE[data], 1
    while width * 2 <= gram:
        h = h[:-width] + (h[width:] << np.uint32(width))
        width *= 2
    if width < gram:
        h = h[: len(data) - gram + 1] * np.uint32(0x9E3779B1) + h[gram - width :]
    return (h * np.uint32(0x85EBCA6B)) | np.uint32(1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and hash of every gram that is the least (or ties with it) of a window of its row."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _order(data, gram)
    width = length - gram + 1
    # the greatest of the windows' least grams over all windows that hold a place is its own gram at anchors only
    padded = np.zeros(len(h) + width - 1, np.uint32)
    least = padded[width - 1 : width - 1 + len(data) - length + 1]
    least[:] = _sliding(h, width, np.minimum)
    for end in offsets[1:-1].tolist():  # no window goes over the end of a row
        least[max(0, end - length + 1) : end] = 0
    place = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    return place, np.searchsorted(offsets, place, side="right") - 1, _bytes_key(_words(data), place, gram)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _bytes_key(words: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    h = np.zeros(len(place), np.uint64)
    for at in [*range(0, n - 7, 8), *([n - 8] if n > 8 and n % 8 else [])]:
        h = K.mix(h * np.uint64(0x9FB21C651E98DF25) + words[place + at] + np.uint64(at + 1))
    return h if n >= 8 else K.mix((words[place] & np.uint64((1 << 8 * n) - 1)) + np.uint64(1))


def _ranges(length: int, gram: int, parts: int) -> list[tuple[int, int]]:
    """The least and the greatest number of bytes before the anchor, for each range of its windows."""
    edges = np.linspace(0, length - gram + 1, parts + 1).astype(int).tolist()
    return [(lo, hi - 1) for lo, hi in pairwise(edges) if lo < hi]


def _range_key(words: np.ndarray, place: np.ndarray, lo: int, hi: int, length: int) -> np.ndarray:
    """A hash of the bytes that all windows share which start lo to hi bytes before an anchor."""
    return K.mix(_bytes_key(words, place - lo, length - hi + lo) + np.uint64(lo + 1)) | np.uint64(1)


def _blocked(docs: DataFrame, blocks: int, length: int, gram: int) -> DataFrame:
    """The documents, dealt into blocks, with the gaps between their anchors as bytes."""
    doc = F.coalesce(F.col("doc_id"), F.lit(int(LAST) - 1))
    own = docs.select("doc_id", doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(row_hash(31, F.col("doc_id"), F.col("text")), F.lit(blocks)).cast("int").alias("block"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gaps(part, off, length, gram) for _, _, part, off in _slices(pa.Table.from_batches([batch]))]
            yield batch.append_column("gaps", pa.array([g for some in found for g in some], pa.binary()))

    return own.mapInArrow(anchored, "doc_id long, doc long, text string, block int, gaps binary")


def gaps(part: np.ndarray, off: np.ndarray, length: int, gram: int) -> list[bytes]:
    """For each row of a slice, how far each anchor is from the one before it, the first from the row's start: at most length - gram + 1."""
    found = list(_pieces(part, off, length, gram))
    place, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    step = np.diff(place, prepend=0)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    step[first] = place[first] - off[row[first]]
    raw, cut = step.astype(np.uint8).tobytes(), np.searchsorted(row, np.arange(len(off))).tolist()
    return [raw[a:b] for a, b in pairwise(cut)]


def _slices(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.utf8(table.column("text"))
    for a, b in K.slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _anchored(table: pa.Table, length: int, gram: int) -> Iterator[tuple]:
    """First row, end, bytes, offsets and words of each slice, and place and row of its anchors, some ANCHORS at a time."""
    steps, cut = K.utf8(table.column("gaps"))
    for a, b, part, off in _slices(table):
        own = cut[a : b + 1] - cut[a]
        far = np.concatenate(([0], np.cumsum(steps[cut[a] : cut[b]], dtype=np.int64)))
        row = np.repeat(np.arange(b - a), np.diff(own))
        place = far[1:] + (off[:-1] - far[own[:-1]])[row]
        yield a, b, part, off, _words(part), [(place[i : i + ANCHORS], row[i : i + ANCHORS]) for i in range(0, len(place), ANCHORS)]


def _pieces(part: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, row and hash of the anchors of a slice; one long document goes piece by piece, and pieces share no anchor."""
    if len(off) > 2 or len(part) <= PIECE:
        yield anchors(part, off, length, gram)
        return
    last = -1
    for at in range(0, len(part), PIECE):
        own = part[at : at + PIECE + length - 1]
        place, row, h = anchors(own, np.array([0, len(own)]), length, gram)
        place = place + at
        new = place > last
        if new.any():
            last = int(place[-1])
            yield place[new], row[new], h[new]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _split(where: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that are there, in order, each with the places of its entries."""
    order = np.argsort(where, kind="stable")
    order = order[np.searchsorted(where[order], 0) : np.searchsorted(where[order], buckets)]
    cut = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
    return [(int(where[order[a]]), order[a:b]) for a, b in pairwise(cut.tolist())]


def _half_marks(words: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, length: int, gram: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each half of the windows: the anchors that have such windows, their marks, and the half.  A mark is its gram's bucket and 31 bits."""
    bucket = _bucket(h, buckets).astype(np.uint64) << np.uint64(32)
    for lo, hi in _ranges(length, gram, HALVES):
        at = np.flatnonzero((place - lo >= start) & (place - hi + length <= end))
        yield at, (_range_key(words, place[at], lo, hi, length) & np.uint64(0xFFFFFFFF)) | bucket[at], lo, hi


def _heads(values: np.ndarray) -> np.ndarray:
    """Where another value begins in sorted ones."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def gram_marks(block: int, table: pa.Table, length: int, gram: int, buckets: int, hot: int) -> pa.Table:
    """A block's marks by bucket; the lowest bit tells whether two documents of the block have the mark.

    Inside a bucket 31 bits are kept: two marks that agree in them merely stay together as if shared.  With them go the
    grams that stand over hot / buckets times in the block, and how often; other blocks together add `hot` at most.
    """
    ms, ds, hs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    doc = table.column("doc").to_numpy()
    for a, _, _, off, words, some in _anchored(table, length, gram):
        for place, row in some:
            h = _bytes_key(words, place, gram) | np.uint64(1)
            hs.append(h)
            for at, mark, _, _ in _half_marks(words, place, off[row], off[row + 1], h, length, gram, buckets):
                ms.append(mark)
                ds.append(doc[a + row[at]])
    mark, d = np.concatenate(ms), np.concatenate(ds)
    order = np.argsort(mark)
    mark, d = mark[order], d[order]
    head = _heads(mark)
    many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head) if len(head) else np.zeros(0, bool)
    mark = np.where(many, mark[head], mark[head] ^ np.uint64(1))
    h = np.sort(np.concatenate(hs))
    head = _heads(h)
    often = np.diff(np.append(head, len(h)))
    h, often = h[head[often * buckets > hot]], often[often * buckets > hot].astype(np.uint32)
    parts = _split((mark >> np.uint64(32)).astype(np.int32), buckets)  # a gram's bucket has its marks, if any
    common = dict(_split(_bucket(h, buckets), buckets))
    none = np.zeros(0, np.int64)
    cols = {"grams": [mark[i] for _, i in parts], "common": [h[common.get(b, none)] for b, _ in parts]}
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in parts], pa.int32()),
            "block": pa.array([block] * len(parts), pa.int32()),
            **{c: pa.array([x.astype(np.uint32).tobytes() for x in xs], pa.binary()) for c, xs in cols.items()},
            "often": pa.array([often[common.get(b, none)].tobytes() for b, _ in parts], pa.binary()),
        }
    )


def shared_grams(table: pa.Table, hot: int) -> pa.Table:
    """Per block, the marks of one bucket that two documents have, and the grams that stand over `hot` times by the blocks' counts."""
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    lists = [np.frombuffer(x, np.uint32) for x in table.column("grams").to_pylist()]
    every = np.concatenate(lists).astype(np.uint64)
    both = np.sort(((every | np.uint64(1)) << np.uint64(32)) | np.arange(len(every), dtype=np.uint64))
    place = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = _heads(both >> np.uint64(32))
    size = np.diff(np.append(head, len(both)))
    twice = np.zeros(len(every), bool)
    twice[place] = np.repeat((size > 1) | (np.maximum.reduceat(every[place] & np.uint64(1), head) > 0), size)
    ends = np.cumsum([0, *map(len, lists)])
    kept = [np.unique(g[twice[a:b]] | np.uint32(1)) for g, a, b in zip(lists, ends[:-1], ends[1:], strict=True)]
    common, at = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("common").to_pylist()]), return_inverse=True)
    often = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("often").to_pylist()])
    many = common[np.bincount(at, weights=often, minlength=len(common)) > hot].tobytes()
    some = [i for i, k in enumerate(kept) if len(k)]
    return pa.table({"block": pa.array([blocks[i] for i in some], pa.int32()), "bucket": pa.array([bucket] * len(some), pa.int32()), "grams": pa.array([kept[i].tobytes() for i in some], pa.binary()), "hot": pa.array([many] * len(some), pa.binary())})


def _marked(table: pa.Table, column: str = "grams") -> np.ndarray:
    """All shared marks (or hot grams) sent to a block: bucket and 31 bits in one sorted number each."""
    rows = [(b, g) for b, g in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist(), strict=True) if g is not None]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(g, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, g in rows]]))


class Among:
    """Says which values are among sorted marks.  Marks are spread evenly over a bucket, so that a few of their first bits tell nearly where one stands."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        top = int(marks[-1] >> np.uint64(32)) + 1 if len(marks) else 1
        self.shift = np.uint64(32 - min(31, max(0, (4 * len(marks) // top).bit_length() - 1)))
        self.cells = top << (32 - int(self.shift))
        self.start = np.concatenate(([0], np.cumsum(np.bincount((marks >> self.shift).astype(np.int64), minlength=self.cells))))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(values), bool)
        cell = (values >> self.shift).astype(np.int64)
        todo = np.flatnonzero(cell < self.cells)
        at, end = self.start[cell[todo]], self.start[cell[todo] + 1]
        while len(todo):
            go = at < end
            todo, at, end = todo[go], at[go], end[go]
            same = self.marks[at] == values[todo]
            found[todo[same]] = True
            todo, at, end = todo[~same], at[~same] + 1, end[~same]
        return found


def _shared_anchors(table: pa.Table, length: int, gram: int, marks: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple]:
    """For each slice (first row, end, bytes, offsets): place, row, group, extents and range of the anchors that share a half, some ANCHORS at a time.

    A group is the gram, or for a hot one the bytes that the windows of a range share; the extents are those of the
    shared halves, or of the range.
    """
    shared, is_common = Among(marks), Among(hot)

    def of(off: np.ndarray, words: np.ndarray, some: list) -> Iterator[tuple]:
        for place, row in some:
            h = _bytes_key(words, place, gram) | np.uint64(1)
            first, last = np.full(len(place), length), np.full(len(place), -1)  # of the windows in shared halves
            for at, mark, lo, hi in _half_marks(words, place, off[row], off[row + 1], h, length, gram, buckets):
                at = at[shared(mark)]
                first[at], last[at] = np.minimum(first[at], lo), hi
            at = np.flatnonzero(last >= 0)
            p, r, h = place[at], row[at], h[at]
            nb, na = np.minimum(p - off[r], last[at]), np.minimum(off[r + 1] - p, length - first[at])
            is_hot = is_common((h & np.uint64(0xFFFFFFFF)) | (_bucket(h, buckets).astype(np.uint64) << np.uint64(32)))
            plain = ~is_hot
            yield p[plain], r[plain], h[plain], nb[plain], na[plain], 0
            if is_hot.any():
                for i, (lo, hi) in enumerate(_ranges(length, gram, RANGES)):
                    b, a = np.minimum(nb, hi), np.minimum(na, length - lo)
                    ok = is_hot & (np.maximum(lo, length - a) <= b)
                    yield p[ok], r[ok], _range_key(words, p[ok], lo, hi, length), b[ok], a[ok], i + 1

    for a, b, part, off, words, some in _anchored(table, length, gram):
        yield a, b, part, off, of(off, words, some)


def _records(part: np.ndarray, length: int, gram: int):
    """A function that gives the records of anchors of a slice: HEAD, zero-padded bytes from the anchor on, those before it, nearest first."""
    reach = length - gram
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(reach, np.uint8), part, np.zeros(length, np.uint8))), reach + length)

    def records(place: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, kind: int) -> np.ndarray:
        full = np.empty((len(place), HEAD + length + reach), np.uint8)
        full[:, 0], full[:, 1], full[:, 2] = n_before, n_after, kind
        own = around[place]
        full[:, HEAD : HEAD + length] = own[:, reach:]
        full[:, HEAD + length :] = own[:, :reach][:, ::-1]
        for at, width, n in ((HEAD, length, n_after), (HEAD + length, reach, n_before)):
            cut = np.flatnonzero(n < width)
            full[cut, at : at + width] *= np.arange(width) < n[cut][:, None]
        return full

    return records


def _groups(full: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The group of each record: of its gram, or of the bytes that a hot gram's windows of a range share."""
    after, before = full[:, HEAD : HEAD + length], full[:, HEAD + length :]
    h = np.empty(len(full), np.uint64)
    for kind in np.flatnonzero(np.bincount(full[:, 2])).tolist():
        lo, hi = _ranges(length, gram, RANGES)[kind - 1] if kind else (0, length - gram)
        own = np.flatnonzero(full[:, 2] == kind)
        rows = np.concatenate((before[own, :lo][:, ::-1], after[own, : length - hi]), axis=1)
        h[own] = K.mix(_context_key(rows) + np.uint64(kind))
    return h


def _context_key(full: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a byte matrix, for finding equal rows."""
    width = -(-full.shape[1] // 8) * 8
    words = np.zeros((len(full), width), np.uint8)
    words[:, : full.shape[1]] = full
    words = words.view("<u8")
    h = np.zeros(len(full), np.uint64)
    for c in range(words.shape[1]):
        h = K.mix(h * np.uint64(0x9FB21C651E98DF25) + words[:, c] + np.uint64(c + 1))
    return h


def _collapse(key: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least document of each key, and whether the key has other documents."""
    order = np.lexsort((doc, key))
    head = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else order
    if not len(head):
        return head, np.zeros(0, bool)
    several = np.minimum.reduceat(doc[order], head) != np.maximum.reduceat(doc[order], head)
    return order[head], several | np.maximum.reduceat(many[order], head)


#: Marks, in the first byte of a context's record, that other documents of the block have it too.
MANY = np.uint8(0x80)


def block_contexts(block: int, table: pa.Table, marks: np.ndarray, hot: np.ndarray, length: int, gram: int, buckets: int) -> pa.Table:
    """The block's distinct contexts by bucket, each with its least document."""
    doc = table.column("doc").to_numpy()
    keys, rows, docs, hashes, many = [np.zeros(0, np.uint64)], [np.zeros((0, HEAD + 2 * length - gram), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for a, _, part, _, found in _shared_anchors(table, length, gram, marks, hot, buckets):
        records = _records(part, length, gram)
        for place, row, h, nb, na, kind in found:
            full = records(place, nb, na, kind)
            key, d = _context_key(full), doc[a + row]
            head, several = _collapse(key, d, np.zeros(len(d), bool))
            for x, y in ((keys, key[head]), (rows, full[head]), (docs, d[head]), (hashes, h[head]), (many, several)):
                x.append(y)
    key, full, d, h = np.concatenate(keys), np.concatenate(rows), np.concatenate(docs), np.concatenate(hashes)
    head, several = _collapse(key, d, np.concatenate(many))
    full, d, h = full[head], d[head], h[head]
    full[several, 0] |= MANY
    parts = _split(_bucket(h, buckets), buckets)
    pack = zstandard.ZstdCompressor(level=1)
    cols = {c: pa.array([pack.compress(x[i].tobytes()) for _, i in parts], pa.binary()) for c, x in (("rows", full), ("docs", d))}
    return pa.table({"bucket": pa.array([i for i, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int32()), **cols})


def sorted_answers(table: pa.Table, length: int, gram: int) -> pa.Table:
    """For each block, what becomes of its contexts: key, first document of the context, and bits of its windows with an earlier one."""
    reach, width = length - gram, HEAD + 2 * length - gram
    blocks = table.column("block").to_pylist()
    unpack = zstandard.ZstdDecompressor()
    full, doc = (np.concatenate([np.frombuffer(unpack.decompress(x), kind) for x in table.column(c).to_pylist()]) for c, kind in (("rows", np.uint8), ("docs", np.int64)))
    full = full.reshape(-1, width)
    cut = np.cumsum([0, *(zstandard.frame_content_size(x) // 8 for x in table.column("docs").to_pylist())])
    shared_in = full[:, 0] & MANY
    full[:, 0] &= ~MANY
    # equal contexts collapse: compare the bytes themselves
    key = _context_key(full)
    _, sample, same = np.unique(key, return_index=True, return_inverse=True)
    if (full != full[sample[same]]).any():
        same = _as_ranks(full)  # two contexts share a key: tell them apart by their bytes
    n = int(same.max()) + 1 if len(same) else 0
    least = np.full(n, LAST, np.int64)
    np.minimum.at(least, same, doc)
    sample = np.zeros(n, np.int64)
    sample[same] = np.arange(len(same))
    cfull = full[sample]
    cgram = _groups(cfull, length, gram)
    # a gram with one context has no other windows to meet
    _, group, count = np.unique(cgram, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[group] > 1)
    bits = np.zeros(n, np.int64)
    if len(some):
        part = cfull[some]
        firsts = first_documents(cgram[some], part[:, HEAD + length :], part[:, 0].astype(np.int64), part[:, HEAD : HEAD + length], part[:, 1].astype(np.int64), least[some], length)
        earlier = firsts < least[some][:, None]
        bits[some] = (earlier.astype(np.int64) << np.arange(reach + 1)).sum(axis=1)
    out_first, out_bits = least[same], bits[same]
    take = [slice(cut[i], cut[i + 1]) for i in range(len(blocks))]
    # no answer is needed where a block's own least document is the first one and has no earlier window
    need = (out_bits != 0) | (np.bincount(same, minlength=n)[same] > 1) | (shared_in > 0)
    return pa.table(
        {
            "block": pa.array(blocks, pa.int32()),
            **{c: pa.array([x[s][need[s]].tobytes() for s in take], pa.binary()) for c, x in (("keys", key), ("firsts", out_first), ("bits", out_bits))},
        }
    )


def _as_ranks(full: np.ndarray) -> np.ndarray:
    """A number for each distinct row of a byte matrix, by sorting its eight-byte words."""
    width = -(-full.shape[1] // 8) * 8
    words = np.zeros((len(full), width), np.uint8)
    words[:, : full.shape[1]] = full
    words = words.view("<u8")
    order = np.lexsort(tuple(words[:, c] for c in range(words.shape[1])))
    new = np.zeros(len(full), np.int64)
    if len(full) > 1:
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    out = np.empty(len(full), np.int64)
    out[order] = np.cumsum(new)
    return out


def cut_block(table: pa.Table, keys: np.ndarray, firsts: np.ndarray, bits: np.ndarray, marks: np.ndarray, hot: np.ndarray, length: int, gram: int, buckets: int, with_text: bool) -> pa.Table:
    """Removal counts of the block's documents, and their kept bytes."""
    order = np.argsort(keys, kind="stable")
    keys, firsts, bits = keys[order], firsts[order], bits[order]
    doc, ids = table.column("doc").to_numpy(), table.column("doc_id").combine_chunks()
    sizes, removed, spans, digests, texts = [], [], [], [], []
    shift = np.arange(length - gram + 1)
    for a, b, part, off, found in _shared_anchors(table, length, gram, marks, hot, buckets):
        edge = np.zeros(len(part) + 1, np.int32)
        records = _records(part, length, gram)
        for place, row, _, nb, na, kind in found if len(keys) else ():
            key = _context_key(records(place, nb, na, kind))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[at] == key
            later = known & (doc[a + row] > firsts[at])
            # all windows of a later document go, which are one stretch
            np.add.at(edge, (place - nb)[later], np.int32(1))  # of the array's own type: another one is cast element by element
            np.add.at(edge, (place + na)[later], np.int32(-1))
            some = np.flatnonzero(known & ~later & (bits[at] != 0))
            windows = (bits[at[some]][:, None] >> shift) & 1 == 1
            windows &= (shift <= nb[some][:, None]) & (length - shift <= na[some][:, None])
            i, s = np.nonzero(windows)
            begin = place[some[i]] - s
            np.add.at(edge, begin, np.int32(1))
            np.add.at(edge, begin + length, np.int32(-1))
        gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        rows = off[:-1][off[:-1] < off[1:]]
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1]
        ends[:-1] &= ~gone[1:]
        begins[rows] = gone[rows]  # a run ends with its row
        ends[rows[1:] - 1] = gone[rows[1:] - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(off, begin, side="right") - 1
        count = np.bincount(row, weights=end - begin, minlength=b - a).astype(np.int64)
        kept = memoryview(part[~gone].tobytes())
        sizes += np.diff(off).tolist()
        removed += count.tolist()
        spans += np.bincount(row, minlength=b - a).tolist()
        own = [kept[x:y] for x, y in pairwise((off - np.concatenate(([0], np.cumsum(count)))).tolist())]
        digests += [sha256(k).hexdigest() for k in own]
        if with_text:
            texts += map(bytes, own)
    out = {"doc_id": ids, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_text else {}))


def _numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    lists = [np.frombuffer(x, kind) for x in table.column(column).to_pylist() if x is not None]
    return np.concatenate(lists) if lists else np.zeros(0, kind)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = 12 << 20, hot: int = 50_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with `with_text` the kept bytes) of every row."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = pieces(total, block_bytes)
    own = _blocked(docs, blocks, length, gram)

    def marks(key: tuple, table: pa.Table) -> pa.Table:
        return gram_marks(key[0].as_py(), table, length, gram, blocks, hot)

    def shared_of(table: pa.Table) -> pa.Table:
        return shared_grams(table, hot)

    def contexts(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        return block_contexts(key[0].as_py(), table, _marked(shared), _marked(shared, "hot"), length, gram, blocks)

    def answer(table: pa.Table) -> pa.Table:
        return sorted_answers(table, length, gram)

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        columns = [_numbers(answers, c, k) for c, k in (("keys", np.uint64), ("firsts", np.int64), ("bits", np.int64))]
        return cut_block(table, *columns, _marked(answers), _marked(answers, "hot"), length, gram, blocks, with_text)

    by = lambda df: df.groupBy("block")
    shared = by(own).applyInArrow(marks, "bucket int, block int, grams binary, common binary, often binary").groupBy("bucket").applyInArrow(shared_of, "block int, bucket int, grams binary, hot binary")
    found = by(own).cogroup(by(shared)).applyInArrow(contexts, "bucket int, block int, rows binary, docs binary")
    answers = found.groupBy("bucket").applyInArrow(answer, "block int, keys binary, firsts binary, bits binary")
    none = F.lit(None).cast("binary")
    back = answers.withColumns({"grams": none, "hot": none, "bucket": F.lit(0)}).unionByName(shared.withColumns({"keys": none, "firsts": none, "bits": none}))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by(own).cogroup(by(back)).applyInArrow(cut, schema)


def op7_suffix_dedup(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs)
