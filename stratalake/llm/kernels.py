"""Vectorised byte kernels that run inside Spark tasks (numpy over Arrow buffers).

Texts are taken as UTF-8 bytes.  A word is a run of bytes other than 0x20 and
0x09-0x0D, which is the same as splitting the decoded text on those characters.
Hashes are polynomial prefix sums modulo 2**64 followed by a finalising mix, so
a hash of any window costs a subtraction and a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text that one kernel call works on (a longer document goes alone).
SLICE_BYTES = 2 << 20

_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = max(n, SLICE_BYTES + 64)
        for name, base in (("pow", _BASE), ("inv", _INV)):
            steps = np.full(size, base & _MASK, dtype=U64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=U64)
    return _tables["pow"], _tables["inv"]


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j over j < i; values are small integers."""
    p, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], dtype=U64, out=out[1:])
    return out


def window_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(p))
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(U64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `most` bytes together."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] |= inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return window_hash(prefix(LOWER[data] if lower else data), start, end)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words; a row with fewer words gives its whole sequence as one, an empty one nothing."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    n = len(hashes)
    h = np.zeros(max(0, n - k + 1), dtype=U64)
    for i in range(k):
        h = h * U64(0xD6E8FEB86659FD93) + hashes[i : i + len(h)]
    ok = row[: len(h)] == row[k - 1 : k - 1 + len(h)]
    out, rows = [mix(h[ok] + U64(k))], [row[: len(h)][ok]]
    for r in np.flatnonzero((count > 0) & (count < k)):
        s = U64(0)
        with np.errstate(over="ignore"):
            for x in hashes[begin[r] : begin[r] + count[r]]:
                s = s * U64(0xD6E8FEB86659FD93) + x
        out.append(mix(np.array([s + U64(count[r])], dtype=U64)))
        rows.append(np.array([r]))
    h, rows = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return h[order], rows[order]
