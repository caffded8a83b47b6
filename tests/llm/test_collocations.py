"""Phrases against plain counting; the trie against a dict."""

import random
import re
from collections import Counter, defaultdict

import pytest

from stratalake.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, Score string, n string"


def brute(rows, least, top, inside=100):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found, longer = [], Counter()
        for p, a in counts.items():
            if len(p) > 2 and a >= least:
                for z in range(2, len(p)):
                    for i in range(len(p) - z + 1):
                        longer[p[i : i + z]] = max(longer[p[i : i + z]], a)
        for p, a in counts.items():
            if len(p) < 2 or a < least or 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], len(p), k))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s, m, k) for i, (s, a, p, left, right, m, k) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["É", "x-y", "I'm", "\x1f", "Ab"]
    say = lambda n: "".join(rnd.choice(words[: rnd.choice([3, 8, 30])]) + rnd.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(n))
    rows = [(i, say(rnd.randint(1, 200)), rnd.choice(["en", "en", "de", None, "und", ""]), "s", "n") for i in range(60)]
    rows += [(900 + i, "the same line of words here and there", "en", None, None) for i in range(40)]
    rows += [(1, None, "en", None, None), (2, "", "de", None, None), (3, " \t\n.", "fr", None, None), rows[0], rows[0], (None, "a a a a a a a a a a a a", "en", None, None)]
    return [*rows, (5000, say(30_000), "de", None, None)]


@pytest.mark.parametrize(("joined", "spread"), [(False, 1_000_000), (True, 100)])
def test_phrases_against_counting(spark, monkeypatch, joined, spread):
    rows = corpus()
    monkeypatch.setattr(collocations, "RANGE", spread)
    if joined:  # many small prefix partitions
        bounds = collocations.bounds
        monkeypatch.setattr(collocations, "bounds", lambda blocks: bounds(blocks) if len(bounds(blocks)[0]) > 30 else pytest.fail("few partitions"))
        monkeypatch.setattr(collocations, "BLOCK", 16)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if joined:
        monkeypatch.setattr(collocations, "PART", 50)
        real = collocations.count_by_join
        monkeypatch.setattr(collocations, "count_by_join", lambda d, w: real(d, w, 50))
    got = sorted(tuple(r) for r in collocations.mine(docs, least=8, top=40, most_words=0 if joined else 1 << 20).collect())
    assert got == brute(rows, 8, 40)
    assert any(r[2] == "a a a a a" for r in got) and {r[0] for r in got} >= {"en", "de", "und", ""}


def test_query_columns_and_empty_table(spark):
    out = collocations.op13_collocations(spark.createDataFrame([], SCHEMA))
    assert out.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert out.count() == 0


def test_trie_bursts_and_spills_whole_subtrees():
    rnd, trie, want, spilled = random.Random(2), collocations.HatTrie(words=4, width=1, burst=5), Counter(), Counter()

    def take(keep):
        before, runs = trie.size, list(trie.spill(keep))
        assert trie.size <= keep and before - trie.size == sum(len(k) for k, _ in runs)
        for keys, counts in runs:
            assert len(set(keys)) == len(keys) and len({k[:1] for k in keys}) == 1
            for k, n in zip(keys, counts, strict=True):
                spilled[k] += n

    for i in range(3000):
        first = bytes([rnd.randint(1, 6)])
        rests = sorted(bytes(rnd.randint(0, 6) for _ in range(3)) for _ in range(3))
        trie.add(first, rests)
        want.update(first + r for r in rests)
        if i == 200:
            assert any(not isinstance(c, Counter) for c in trie.root.values())
        if trie.size > 900:
            take(300)
    take(0)
    assert trie.size == 0 and spilled == want


def test_runs_go_on_over_feeds(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "BLOCK", 3)
    rnd = random.Random(8)
    ids = [rnd.choice([0, 1, 2, 3, 300, 70_000]) for _ in range(1000)]
    counting, got = collocations.Counting(), Counter()
    for batch in [b for i in range(0, 1000, 7) for b in counting.feed(ids[i : i + 7])] + list(counting.rest()):
        last = b""
        for first, n, data in zip(*[batch[c].to_pylist() for c in ("first", "n", "data")], strict=True):
            runs, counts = collocations._read_block(n, data)
            keys = [r.astype(">u4").tobytes() for r in runs]
            assert n <= 3 and first == keys[0] and [last, *keys] == sorted({last, *keys})
            last = keys[-1]
            for k, c in zip(runs.tolist(), counts.tolist(), strict=True):
                got[tuple(x for x in k if x)] += c
    want = Counter()
    for i in range(1000):
        run = tuple(ids[i : i + 5])
        run = run[: run.index(0)] if 0 in run else run
        if len(run) > 1:
            want[run] += 1
    assert got == want


def test_chunks_keep_pieces():
    text = "Ab c. D\te\vf  g!h " * 50
    assert [w for c in collocations.chunks(text, 10) for w in c.split()] == [w.encode() for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", text.lower())]
    whole, cut = (b"".join(collocations.chunks(text, n)) for n in (10**6, 3))
    assert whole == cut
