"""Ranked lexical search against scores computed row by row."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from stratalake.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, score string, Item string", "item_id long, text string, rank string, Terms string"
terms = lambda text: re.findall(TERM, (text or "").translate(UPPER))


def brute(docs, items, top=20):
    counts = [(doc, Counter(terms(t))) for doc, t, *_ in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for doc, c in counts:
            m = 100 - 25 + 25 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def rows(rnd, n, words):
    word = lambda: rnd.choice(words) if rnd.random() < 0.6 else words[min(int(rnd.expovariate(0.2)), len(words) - 1)]
    return [(i, rnd.choice([" ", ", ", "\n", "é "]).join(word() for _ in range(rnd.randint(1, 60))), "s", "t") for i in range(n)]


@pytest.mark.parametrize(("most_items", "pack"), [(512, 128), (3, 4)])
def test_ranks_against_brute_force(spark, monkeypatch, most_items, pack):
    rnd = random.Random(pack)
    words = [f"w{i}" if i % 3 else f"Wört{i}" for i in range(120)]
    docs = rows(rnd, 300, words)
    same = docs[5][1]
    docs += [(1000 + i, same, None, None) for i in range(60)] + [(None, same, None, None), (None, None, None, None), (7777, "", None, None), (7778, "-- !!", None, None), docs[3], docs[3]]
    docs.append((8888, " ".join(rnd.choice(words) for _ in range(40_000)), None, None))
    items = [(i, t, None, None) for i, t, *_ in rows(rnd, 17, words)]
    items += [(100, same, None, None), (101, None, None, None), (102, "unknown zzz", None, None), (None, "w1 w1 w2", None, None), items[2], items[2], (103, " ".join(words * 3), None, None)]
    for name, value in (("PACK", pack), ("FAN", 3), ("CHUNK", 7)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "MOST_ITEMS", most_items)
    frame_d, frame_i = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    seen = defaultdict(int)
    for block in lexical.blocks(frame_i, most_items, 200):
        seen["blocks"] += 1
        assert len(block.items) <= most_items and (len(block.items) == 1 or sum(map(len, block.counts)) <= 200)
    assert seen["blocks"] > 3
    got = sorted((tuple(r) for r in lexical.op12_ranked_search(frame_d, frame_i).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(rows(random.Random(1), 5, ["a", "b"]), DOCS), spark.createDataFrame([(1, "a b", None, None)], ITEMS)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.rank(none_d, items).count() == lexical.rank(docs, none_i).count() == 0


def test_texts_are_read_in_pieces():
    text = ("Ab1 é-x " * 1000).encode()
    assert [t for some in lexical.terms_of(text, 10) for t in some] == [t.encode() for t in terms(text.decode())]


def test_bounds_prune(monkeypatch):
    """A pack whose maxima cannot reach an item's k-th score is never opened."""
    import numpy as np
    import pyarrow as pa

    opened = []
    tree = lexical.Tree(np.array([[5, 0], [4, 0], [0, 9]], np.int64))
    real = np.add.reduceat
    monkeypatch.setattr(lexical.np, "add", type("spy", (), {"reduceat": staticmethod(lambda a, i: opened.append(len(a)) or real(a, i))}))
    packs = [(0, [1, 2], [1, 2], [0, 0], [100, 90], [0], [100]), (1, [3], [1], [0], [1], [0], [1]), (2, [4], [1], [1], [7], [1], [7])]
    names = ["pack", "docs", "ends", "terms", "parts", "top_terms", "top_parts"]
    kinds = [pa.int64(), *[pa.list_(pa.int64() if i in (0, 3, 5) else pa.int32()) for i in range(6)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs, strict=True), kinds, strict=True)], names)
    floor = np.array([0, 0, 0], np.int64)
    (out,) = lexical.search(tree, floor, 1)(iter([batch]))
    got = dict(zip(out["item"].to_pylist(), zip(out["doc_id"].to_pylist(), out["score"].to_pylist(), strict=True), strict=True))
    assert got == {0: (1, 500), 1: (1, 400), 2: (4, 63)}
    assert len(opened) == 3
