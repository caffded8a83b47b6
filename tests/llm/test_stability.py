"""Results that do not depend on how a table is split, and sources of any size that go through the dealt rounding."""

import random
from collections import Counter

import numpy as np

from stratalake.llm import mixing, shards


def test_same_places_in_any_split(spark):
    rows = [(7, "same", "x", i % 3) for i in range(5000)] + [(i, f"text {i}", "xy"[i % 2], 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    places = [Counter(map(tuple, shards.op2_sharding(df.repartition(n)).select("doc_id", "size", "text_crc32", "shard", "slot").collect())) for n in (3, 17)]
    assert places[0] == places[1] and places[0].total() == 7000
    mixes = [Counter(map(tuple, mixing.mix(df.repartition(n), hot_rows=h, block_rows=512).collect())) for n, h in ((3, 1000), (17, 1000), (5, 1 << 16))]
    assert mixes[0] == mixes[1] == mixes[2]
    assert max(n for r, n in mixes[0].items() if r[0] != 7) <= 3


def test_small_sources_meet_in_pairs(spark):
    """Fifty documents of a source: most are decided by pairs, all sources come near, and large documents keep their chances."""
    rnd = random.Random(12)
    sizes = sorted((int(rnd.paretovariate(1.1) * 20) % 4000 for _ in range(50)), reverse=True)
    rows = [(s * 100 + i, " ".join(["w"] * n), f"s{s:02}") for s in range(60) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id // 100, {})[r.doc_id % 100] = r
    for own in by.values():
        target = own[0].target
        assert abs(sum(r.copies * r["size"] for r in own.values()) - target) <= sorted(sizes)[25] / 2 + 1
    # sources of weight 1: the ten largest documents are taken as often as the mean copies say
    ratio = {s: own[0].target / own[0].source_size for s, own in by.items()}
    low = [s for s in by if ratio[s] < 1]
    assert len(low) == 20
    for i in range(10):
        assert abs(np.mean([by[s][i].copies for s in low]) - np.mean([ratio[s] for s in low])) < 0.35
    p = np.array([0.5] * 50)
    done, held = mixing.pivotal(p, np.array(sizes, float).clip(1), np.random.default_rng(0).random(50))
    assert sum(x in (0, 1) for x in done) >= 49 and held < 50
