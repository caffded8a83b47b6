"""Reports, comparison, quantiles, streams and the small readers: against brute force on small inputs."""

import math
import random
import statistics
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.operators import charts, compare, documents, olap, profile, retrieval
from stratalake.operators.quantiles import exact_quantiles, middle
from stratalake.plans import analysis
from stratalake.sources import readers, writers
from stratalake.streaming import increments


def orders(spark, n=60):
    rnd = random.Random(4)
    rows = [(f"2024-{i % 6 + 1:02}-{i % 27 + 1:02}", rnd.choice(["North", "South", "East"]), rnd.choice(["web", "shop"]), float(rnd.randint(1, 90)), float(i)) for i in range(n)]
    rows[5] = (*rows[5][:3], 5000.0, 5.0)
    return spark.createDataFrame(rows, "day string, region string, channel string, revenue double, cost double")


@pytest.fixture(scope="module")
def analysed(spark):
    return analysis.analyse(orders(spark), "orders.csv")


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_are_exact(spark, accuracy):
    rnd = random.Random(1)
    values = [rnd.choice([float(rnd.randint(0, 9)), rnd.gauss(0, 100)]) for _ in range(501)]
    df = spark.createDataFrame([(v, None, 7.0) for v in values], "a double, b double, c double").repartition(5)
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = exact_quantiles(df, {n: F.col(n) for n in "abc"}, at, accuracy=accuracy)
    ordered = sorted(values)

    def wanted(p):
        k = p * (len(ordered) - 1)
        lo, hi = math.floor(k), math.ceil(k)
        return ordered[lo] + (ordered[hi] - ordered[lo]) * (k - lo)

    assert [round(x, 9) for x in got["a"]] == [round(wanted(p), 9) for p in at]
    assert got["b"] == [None] * len(at) and got["c"] == [7.0] * len(at)
    assert exact_quantiles(df, {"a": F.col("a")}, (0.5,), middle)["a"] == [statistics.median_high(values)]


def test_reports_state_the_facts(spark, analysed):
    a = analysed
    rows = a.cleaned.df.collect()
    assert a.measure.column == "revenue" and a.time.column == "day"
    by = {}
    for r in rows:
        by[r[a.dimension.column]] = by.get(r[a.dimension.column], 0) + r["revenue"]
    best = max(by, key=by.get)
    said = analysis.statements(a)
    assert repr(best) in said["leader"] and f"{len(rows)} rows" in said["shape"]
    assert analysis.insights(a) == [said[k] for k in analysis.TOPICS if k in said]
    figures = {k["label"]: k for k in analysis.kpis(a)}
    assert figures["Rows"]["value"] == str(len(rows)) and figures["Outlying values"]["value"] == "1" and len(figures) <= 8
    assert any("revenue: 1 beyond" in x for x in analysis.anomalies(a))
    assert analysis.outlook(a) and analysis.health_note(a) == "State of the data: nothing to mend."
    dive = analysis.deep_dive(a, "revenue")
    assert "0 of 60 values are missing" in dive and "beyond the fences" in dive
    assert "most often" in analysis.deep_dive(a, "channel")
    with pytest.raises(ValueError):
        analysis.deep_dive(a, "absent")
    assert set(analysis.overview(a)) >= {"leaders", "pareto", "periods"}
    assert analysis.quick_types(orders(spark)) == {"day": "text", "region": "text", "channel": "text", "revenue": "numeric", "cost": "numeric"}
    assert analysis.document_suggestions(["tide", "salt"])[:2] == ["What is said about tide?", "What is said about salt?"]
    radar = {r["label"]: r["value"] for r in a.frames["chart_radar"].collect()}
    assert radar["Density"] == 100.0 and len(radar) == 6


def test_chunks_of_an_analysis_answer_questions(analysed):
    chunks = analysis.chunks(analysed)
    families = {r["family"] for r in chunks.select("family").distinct().collect()}
    assert families >= {"summary", "insights", "kpis", "column_stats", "category_stats", "top_n", "pareto", "periods", "olap_summary", "row_group", "anomalies"}
    assert chunks.select("id").distinct().count() == chunks.count() and chunks.where("text is null or text = ''").count() == 0
    assert "revenue" in retrieval.ask(chunks, "median and mean of revenue")["answer"]


def test_workbook_and_bundle(spark, analysed, tmp_path):
    sheets = analysis.workbook(analysed)
    assert list(sheets) == ["Clean Data", "Statistics", "Quality", "Insights", "Correlations", "KPIs"]
    (tmp_path / "r.xlsx").write_bytes(writers.excel_bytes(sheets))
    assert readers.read(spark, str(tmp_path / "r.xlsx")).count() == 60
    text = writers.json_bundle({"quality": analysed.frames["quality"]}, analysis.bundle(analysed))
    assert '"insights"' in text and '"log"' in text
    with pytest.raises(ValueError):
        writers._small(spark.range(11), 10)


def test_history_is_cleared(spark, analysed, tmp_path):
    path = str(tmp_path / "h")
    entry = analysis.history_entry(analysed)
    writers.append_history(entry, path)
    log = writers.list_history(spark, path)
    assert writers.top_categories(log).first()["runs"] == 1 and writers.trend(log).count() == 1
    assert writers.without_entry(log, log.first()["id"]).count() == 0
    writers.clear_history(spark, path)
    assert writers.list_history(spark, path).count() == 0


def test_comparison(spark):
    a = orders(spark)
    b = orders(spark, 40).withColumn("revenue", F.col("revenue") * 2).withColumn("channel", F.lit("post")).drop("cost").withColumn("tax", F.lit(1.5))
    types = lambda df: profile.infer_types(df)
    got = compare.compare(a, b, types(a), types(b), "first", "second")
    assert got["schema"] == {"added": ["tax"], "removed": ["cost"], "common": ["day", "region", "channel", "revenue"]}
    assert got["volume"]["row_delta"] == -20 and got["numbers"][0]["outliers_a"] == 1 and got["numbers"][0]["outliers_delta"] == 0
    assert "Only there: tax." in got["summary"] and "No longer there: cost." in got["summary"] and "Means that moved: revenue" in got["summary"]
    assert {q["dimension"] for q in got["quality"]} == {"Completeness", "Uniqueness", "Consistency", "Type Richness", "Volume"}


def test_topics_part_unlike_passages(spark):
    rnd = random.Random(2)
    say = lambda words: " ".join(rnd.choice(words) for _ in range(20))
    sea, law = "tide salt wave reef shore keel".split(), "court clause statute judge appeal bench".split()
    rows = [(i, 0, say(sea if i % 2 else law)) for i in range(40)]
    units = spark.createDataFrame(rows, "doc_id int, par int, text string")
    clustered = documents.topics(units, k=2)
    sides = {}
    for r in clustered.collect():
        sides.setdefault(r["cluster"], set()).add(r["doc_id"] % 2)
    assert sorted(map(sorted, sides.values())) == [[0], [1]]
    top = documents.topic_summary(clustered, ["doc_id", "par"]).collect()
    assert [r["size"] for r in top] == [20, 20] and all(set(r["keywords"]) <= set(sea) or set(r["keywords"]) <= set(law) for r in top)
    assert documents.topics(units.limit(5), k=2).count() == 0


def test_columns_by_their_first_rows(spark):
    assert profile.sampled_columns(orders(spark)) == {"numeric": ["revenue", "cost"], "category": ["region", "channel"]}


def test_bands(spark):
    row = spark.range(1).select(*[profile.quality_band(F.lit(s)).alias(f"q{s}") for s in (80, 60, 59)], profile.duplicate_tone(F.lit(0)).alias("d"), profile.null_tone(F.lit(20)).alias("n")).first()
    assert tuple(row) == ("Excellent", "Good", "Needs Work", "good", "bad")
    assert charts.median_split(spark.createDataFrame([(float(i),) for i in range(5)], "v double"), "v").where("label = 'Below median'").first()["value"] == 2
    assert olap.sweep(orders(spark), ["revenue"], ["region"], top=1).count() == 1


def test_delimited_text_is_split_unless_quotes_span_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("k,v\n" + "".join(f'{i},"a, {i}"\n' for i in range(50)))
    (tmp_path / "wide.csv").write_text('k,v\n1,"two\nlines"\n2,one\n')
    for multi in (None, True):
        assert readers.read_delimited(spark, str(tmp_path / "plain.csv"), multi_line=multi).count() == 50
    got = readers.read_delimited(spark, str(tmp_path / "wide.csv")).collect()
    assert [r["v"] for r in got] == ["two\nlines", "one"]


def test_tables_of_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("k", "v"), ("x", "1"), ("y", "2"))) + "</w:tbl>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{table}</w:body></w:document>")
    got = readers.read_word_tables(spark, str(tmp_path / "t.docx")).orderBy("row").collect()
    assert [list(r["cells"]) for r in got] == [["k", "v"], ["x", "1"], ["y", "2"]]


def test_streams(spark, tmp_path):
    src, out, each = (str(tmp_path / n) for n in ("in", "out", "each"))
    rows = [("2024-01-01 00:00:00", 1.0), ("2024-01-05 00:00:00", 2.5), ("2024-03-01 00:00:00", 4.0), ("2024-06-01 00:00:00", 8.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    writer = increments.period_totals(stream, "v", "t").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append")
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination(120)
    sums = sorted(r["sum"] for r in spark.read.parquet(out).collect())
    assert sums in ([3.5, 4.0], [3.5, 4.0, 8.0], [1.0, 2.5, 4.0])  # windows that the watermark has passed
    run = increments.each_batch(stream, lambda b: b.agg(F.sum("v").alias("v")), each).option("checkpointLocation", f"{each}-c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["v"] for r in spark.read.parquet(each).collect()] == [15.5]


def test_quantiles_narrow_until_a_task_can_sort(spark):
    """Brackets of at most eight values are sorted: every rank needs rounds, over heavy ties as over distinct values."""
    rnd = random.Random(6)
    columns = {"ties": [float(rnd.choice([1, 1, 1, 2])) for _ in range(4000)], "skewed": [math.exp(rnd.gauss(0, 5)) for _ in range(4000)], "mixed": [rnd.choice([0.0, -0.0, rnd.random(), 5.0]) for _ in range(4000)]}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "ties double, skewed double, mixed double").repartition(3)
    at = (0.0, 0.25, 0.5, 0.77, 1.0)
    got = exact_quantiles(df, {n: F.col(n) for n in columns}, at, sorted_=8, accuracy=64)
    for name, values in columns.items():
        assert got[name] == [pytest.approx(float(np.quantile(values, p)), abs=1e-12) for p in at], name
    two = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "v double")
    assert exact_quantiles(two, {"v": F.col("v")}, (0.5,), sorted_=1) == {"v": [1.5]}
