"""Operators whose work is dealt to tasks in blocks, against plain computation."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.functions import columns as C
from stratalake.functions import text as X
from stratalake.operators import clean, documents, gram, neighbours, olap, ordered, postings, profile, retrieval, sketches
from stratalake.plans import catalogue
from stratalake.streaming import increments


def test_wide_correlations_equal_numpy_and_the_small_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 500))
    x = base + 0.7 * base[:, :1] + 1e6
    x[:, 7] = 5.0  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    names = [f"c{i}" for i in range(500)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    monkeypatch.setattr(gram, "FAN", 3)
    got = {(r.a, r.b): r.r for r in profile.correlations(df, names).collect()}
    assert len(got) == 500 * 500
    for i, j in [(0, 1), (3, 499), (130, 64), (7, 8), (9, 1), (200, 201), (5, 5)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        want = 1.0 if i == j else 0.0 if len(a) < 2 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert got[f"c{i}", f"c{j}"] == pytest.approx(want, abs=6e-4) and got[f"c{j}", f"c{i}"] == got[f"c{i}", f"c{j}"]
    few = names[:10]
    assert {(r.a, r.b): r.r for r in profile.correlations(df, few).collect()} == {(r.a, r.b): r.r for r in gram.correlations(df, {n: C.finite(F.col(n)) for n in few}).collect()}
    empty = df.limit(0)
    assert {r.r for r in profile.correlations(empty, names[:20]).where("a <> b").collect()} <= {0.0}


def test_stored_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(40)]), i, None if i % 9 == 0 else rnd.randint(-5, 50)) for i in range(1000)]
    held = ordered.stored(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), [F.desc("k"), "i"], parts=7)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert held.rows == 1000 and len(held.ends) > 3
    assert [tuple(r)[:3] for r in held.page(7, 30).collect()] == want[210:240]
    assert [tuple(r) for r in held.page(99, 300).collect()] == want[900:] and [tuple(r) for r in held.page(-1, 4).collect()] == want[:4]
    assert {r.i: r["rank"] for r in held.ranked().collect()} == {r[1]: n for n, r in enumerate(want, 1)}
    total, sums = 0, {}
    for r in want:
        total += r[2] or 0
        sums[r[1]] = total
    assert {r.i: r.s for r in held.running({"s": F.col("v")}).collect()} == sums
    none = ordered.stored(spark.createDataFrame([], "k int, i int"), ["k"])
    assert none.page(3).count() == none.ranked().count() == none.rows == 0
    read = held.page(7, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in read and len(held.table.where(F.col("_part") == held.ends[0][0]).inputFiles()) <= len(held.table.inputFiles())


def test_pareto_over_all_groups(spark):
    df = spark.createDataFrame([(f"g{i % 300}", float(i % 17)) for i in range(3000)], "d string, m double")
    whole, cut = (sorted(map(tuple, olap.pareto(df, "m", "d", top=t).collect())) for t in (None, 1000))
    assert len(whole) == 300 and whole == [tuple(float(v) if isinstance(v, float) else v for v in r) for r in cut]


def test_many_queries_over_a_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    a, b = (sorted(map(tuple, retrieval.nearest(df, df, k=3, rows=16, most=m).collect())) for m in (1 << 20, 1000))
    assert a == b and len(a) == 450


def test_inverted_file_finds_most_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.3 * rng.normal(size=(90, 16)) for c in centres] + [rng.normal(size=(200, 16)), np.tile(centres[0], (300, 1))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id % 10 = 0 and vec_id < 1200")
    index = neighbours.build(df, cells=32)
    assert index.probes < 16 and index.table.count() == len(x)
    exact = retrieval.nearest(df, asked, k=5)
    got = neighbours.recall_of(index.search(asked), exact).first()
    assert got.queries == 120 and got.recall >= 0.9
    whole = index.search(asked, probes=32)
    assert neighbours.recall_of(whole, exact).first().recall == 1.0 and whole.count() == 600
    assert neighbours.build(df.limit(0)).search(asked).count() == 0


def lloyd(x, k, rounds, seed):
    c = np.round(x[[i * len(x) // k for i in range(k)]], 9)
    for r in range(rounds):
        at = np.round(x @ c.T, 9).argmax(1)
        new = []
        for i in range(k):
            s = x[at == i].sum(0)
            new.append(s / np.linalg.norm(s) if (at == i).any() else np.eye(x.shape[1])[(seed + i + r) % x.shape[1]])
        c = np.round(np.array(new), 9)
    return np.round(x @ c.T, 9).argmax(1)


def test_topics_against_plain_lloyd(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows = [(i // 5, i % 5, " ".join(rnd.choice(words[i % 4 * 12 : i % 4 * 12 + 24]) for _ in range(12))) for i in range(200)] + [(90, 0, "the of and"), (91, 0, None), (92, 0, "same word1 word1"), (93, 0, "same word1 word1")]
    units = spark.createDataFrame(rows, "doc_id int, par int, text string").repartition(3)
    vectors = {(r.doc_id, r.par): r["__v"] for r in documents.hashed_words(units).collect()}
    keys = sorted(vectors)
    assert len(keys) == 202
    want = lloyd(np.array([vectors[k] for k in keys]), 6, 12, 7)
    got = {(r.doc_id, r.par): r.cluster for r in documents.topics(units, k=6).collect()}
    assert [got[k] for k in keys] == want.tolist()
    lone = spark.createDataFrame([(i, 0, "word1") for i in range(10)], "doc_id int, par int, text string")
    assert {r.cluster for r in documents.topics(lone).collect()} == {0}


def test_stored_index_finds_what_scoring_all_chunks_finds(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"term{i}x" for i in range(50)] + ["an", "of", "Ünü"]
    rows = [(f"c{i:03}", rnd.choice(["insights", "document", "summary"]), None if i % 31 == 0 else " ".join(rnd.choice(words[: rnd.choice([5, 53])]) for _ in range(rnd.randint(0, 25)))) for i in range(160)]
    chunks = spark.createDataFrame(rows, "id string, family string, text string").repartition(4)
    monkeypatch.setattr(postings, "BLOCK", 8)
    held = postings.build(chunks)
    assert held.chunks.select("block").distinct().count() == 20
    vectors = retrieval.embed(chunks, held.index)
    for question in ("term3x and term7x", "of an", "", "nothing here", "term40x term41x term42x of the"):
        want = retrieval.retrieve(chunks, vectors, held.index, question, 6).collect()
        got = held.search(question, 6).collect()
        assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want], question


def test_index_is_made_where_the_chunks_lie(spark, monkeypatch):
    plans, keep = [], postings.written
    monkeypatch.setattr(postings, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    chunks = spark.createDataFrame([(f"c{i}", "document", f"word{i % 9} and word{i % 7} abc") for i in range(300)], "id string, family string, text string")
    held = postings.build(chunks)
    dealt = [[line for line in p.splitlines() if "Exchange" in line] for p in plans]
    assert not dealt[0] and not dealt[2] and not any("id#" in line for line in dealt[1])  # but for counts of terms
    assert held.table.agg(F.sum(F.size("at"))).first()[0] == retrieval.embed(chunks, held.index).count()


def test_stream_of_days_counts_late_rows(spark, tmp_path):
    rows = [("2024-01-30 10:00", 1.5), ("2024-01-31 23:59", 2.25), ("2024-02-01 00:00", 4.0), ("2024-03-05 12:00", None), ("2024-03-05 12:00", 1.0)]
    later = [("2024-03-05 13:00", 2.0)], [("2024-01-02 00:00", 99.0)]
    for n, some in enumerate((rows, *later)):
        spark.createDataFrame(some, "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("ts timestamp, v double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    days, late = increments.keep_days(increments.day_totals(stream, "v", "ts", "1 day"), f"{tmp_path}/out")
    got = [(r.period, r.value, r.delta) for r in increments.periods_of_days(days).orderBy("period").collect()]
    assert late == 1 and got == [("2024-01", 3.75, None), ("2024-02", 4.0, 0.25), ("2024-03", 3.0, -1.0)]


def test_kept_profiles_merge(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i % 3, None if i % 11 == 0 else rnd.gauss(0, 50), rnd.choice(["a", "b", "", None]) if i % 2 else f"w{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "d int, v double, w string")
    for d in range(3):
        sketches.keep(df.where(F.col("d") == d), ["v", "w"], f"{tmp_path}/h", f"2024-01-0{d + 1}")
        sketches.keep(df.where(F.col("d") == d), ["v", "w"], f"{tmp_path}/h", f"2024-01-0{d + 1}")
    got = {r.column: r for r in sketches.described(sketches.kept(df, f"{tmp_path}/h")).collect()}
    v = sorted(x for _, x, _ in rows if x is not None)
    assert (got["v"].rows, got["v"].nulls, got["v"].min, got["v"].max) == (6000, 6000 - len(v), v[0], v[-1])
    assert got["v"].mean == pytest.approx(sum(v) / len(v), abs=1e-3)
    assert abs(sum(x < got["v"].median for x in v) / len(v) - 0.5) < 0.01 and abs(got["v"].unique - len(v)) < 0.04 * len(v)
    distinct = {w for *_, w in rows if w}
    assert abs(got["w"].unique - len(distinct)) < 0.04 * len(distinct) and got["w"].nulls == sum(not w for *_, w in rows) and got["w"].median is None
    part = sketches.described(sketches.kept(df, f"{tmp_path}/h", "2024-01-02", "2024-01-02")).where("column = 'v'").first()
    assert part.rows == 2000


def test_terms_are_counted_in_tasks_as_tokens_are(spark, monkeypatch):
    dealt, keep = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df: dealt.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    texts = ["Of the_K.İx wörd\x0b42\x1cab a b ab", None, "", "!!", "ab AB the\n\nof", "é1é22é333 ab"]
    df = spark.createDataFrame([(i % 2 if i % 3 else None, t) for i, t in enumerate(texts * 3)], "g int, text string").repartition(3)
    for by in ([], ["g"]):
        for unicode in (False, True):
            got = {tuple(r) for r in documents.keywords(df, 99, by, unicode=unicode).select(*by, "term", "tf", "df").collect()}
            each = df.withColumn("u", F.monotonically_increasing_id()).select(*by, "u", F.explode(X.tokens(F.col("text"), unicode)).alias("term"))
            want = {tuple(r) for r in each.groupBy(*by, "term").agg(F.count("*"), F.count_distinct("u")).collect() if not by or r.g is not None}
            assert got == want and got
    assert not any("__u" in p for p in dealt) and len(dealt) == 4  # no unit of a term is dealt


def test_cleaned_rows_are_read_not_made_again(spark):
    df = spark.createDataFrame([(i, f"v{i % 50}", i * 1.5) for i in range(100)], "id int, v string, x double")
    for rows, removed in ((df, 0), (df.unionByName(df.limit(10)), 10)):
        got = clean.clean(rows)
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and got.rows_removed == removed and got.df.count() == 100


@pytest.mark.parametrize("comma", [False, True])
def test_values_that_cannot_be_read_are_told_by_their_characters(spark, comma):
    raw = ["12", "-1.5e3", "(12)", "$ 5 %", "1.234,50", "1,234.5", "12 apples", "Jan 05, 1998", "x" * 50, " 7﻿", ".", "+", "()", "€-3", "1 2", "2024-01-05", "05.02.2024", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").coalesce(1)
    got = {r.r: (r.n, r.d) for r in df.select("r", C.to_number(F.col("r"), comma).alias("n"), C.to_day(F.col("r")).cast("string").alias("d")).collect()}
    number = {"12": 12.0, "-1.5e3": -15000.0 if comma else -1500.0, "(12)": -12.0, "$ 5 %": 0.05, "1.234,50": 1234.5, "1,234.5": 1234.5, " 7﻿": 7.0, "€-3": -3.0}
    number |= {"05.02.2024": 5022024.0} if comma else {}
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == pytest.approx(number)
    assert {k: v[1] for k, v in got.items() if v[1]} == {"Jan 05, 1998": "1998-01-05", "2024-01-05": "2024-01-05", "05.02.2024": "2024-02-05"}
    plan = df.select(C.to_number(F.col("r"))).limit(1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "btrim" in plan.lower() or "trim(" in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_type_drift_of_copies(spark, tmp_path):
    """Amounts that repeat in copies of a table, in fewer than half of its rows, are text as in the SQL; the rule for types by itself tells a category."""
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    o.withColumn("o_orderkey", F.explode(F.sequence("o_orderkey", F.col("o_orderkey") + 6 * 10**6, F.lit(10**6)))).write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.sql(f"WITH orders AS (SELECT * FROM '{tmp_path}/orders.parquet/*.parquet') SELECT * FROM ({catalogue.oracle_sql()['type_drift']})").fetchall()
    assert sorted(map(tuple, catalogue.queries()["type_drift"](spark, str(tmp_path)).collect())) == sorted(want)
    words = spark.createDataFrame([(f"word {i % 40}",) for i in range(100)], "w string")
    assert [profile.infer_types(words)[0].type, profile.infer_types(words, categories=False)[0].type] == ["category", "text"]
