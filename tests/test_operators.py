import math
import random
import zipfile

from pyspark.sql import functions as F

from stratalake.operators import charts, clean, olap, profile, retrieval
from stratalake.plans import analysis
from stratalake.sources import layout, readers, writers


def sales(spark):
    rows = [("North", "2024-01-05", "$10.00", "a"), ("North", "2024-02-05", "$30.00", "b"), ("South", "2024-02-07", "n/a", "a"), ("East", "2024-03-01", "$50.00", "b"), ("north ", "2024-01-05", "$10.00", "A"), ("West", "2024-03-02", "5", "c")]
    return spark.createDataFrame(rows, "Region string, Day string, Revenue string, kind string")


def test_clean_and_types(spark):
    got = clean.clean(sales(spark))
    assert {t.column: t.type for t in got.types} == {"Region": "identifier", "Day": "date", "Revenue": "number", "kind": "category"} or got.types[2].type in ("number", "integer")
    assert got.duplicate_rows == 1 and got.df.count() == 5
    assert got.null_counts["Revenue"] == 1
    assert got.df.where("Region = 'South'").first()["Revenue"] == 21.0


def test_headers():
    assert clean.clean_headers([" a  b ", "", "A B", None]) == ["a b", "column_2", "A B_2", "column_4"]


def test_grouping(spark):
    df = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("y", 30.0), (None, 5.0), ("z", None), ("w", 1.0)], "d string, m double")
    top = olap.aggregate_by(df, "m", "d").collect()
    assert [(r["value"], r["sum"]) for r in top] == [("x", 30.0), ("y", 30.0), ("w", 1.0)]
    assert olap.bottom_n(df, "m", "d", 1).first()["value"] == "w"
    s = olap.pareto_summary(olap.pareto(df, "m", "d")).first()
    assert (s["total_contributors"], s["pareto_count"], s["groups_to_threshold"]) == (3, 1, 2)
    assert {(r["value"], r["rank"]) for r in olap.sweep(df, ["m"], ["d"]).collect()} == {("x", 1), ("y", 2), ("w", 3)}
    empty = df.limit(0)
    assert olap.sweep(empty, ["m"], ["d"]).count() == 0 and olap.pareto_summary(olap.pareto(empty, "m", "d")).first()["total_contributors"] == 0


def test_profile_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "a double, b double")
    r = {x["column"]: x for x in profile.describe_numeric(df, ["a", "b"]).collect()}
    assert r["a"]["count"] == 2 and r["a"]["mean"] == 1.5 and r["b"]["stddev"] == 0.0
    assert {x["r"] for x in profile.correlations(df, ["a", "b"]).where("a <> b").collect()} == {0.0}
    assert sum(x["value"] for x in charts.histogram(spark.range(10).withColumn("v", F.col("id").cast("double")), "v").collect()) == 10


def test_roles(spark):
    df = spark.range(40).select(F.col("id").alias("order_id"), (F.col("id") % 3).cast("string").alias("segment"), (F.col("id") * 1.5).alias("revenue"), F.concat(F.lit("c"), F.col("id") % 4).alias("city"))
    roles = {r.column: r.role for r in olap.classify(df, profile.infer_types(df))}
    assert roles["order_id"] == "identifier" and roles["revenue"] == "measure" and roles["city"] == "geo"


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name; name\n1;"x;\ny";2\n ; ; \n2;z;3\n')
    got = readers.read(spark, str(p))
    assert got.columns[:3] == ["id", "name", "name_2"] and got.count() == 2
    (tmp_path / "n.csv").write_text("1,2\n3,4\n")
    assert readers.read(spark, str(tmp_path / "n.csv")).columns[:2] == ["Column 1", "Column 2"]
    (tmp_path / "j.json").write_text('[{"a": {"b": 1}, "t": [1, 2]}, {"a": {"b": 2}, "t": []}]')
    assert [r["a.b"] for r in readers.read(spark, str(tmp_path / "j.json")).orderBy("_row_id").collect()] == [1, 2]
    sheet = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    (tmp_path / "s.xlsx").write_bytes(writers.excel_bytes({"Data": sheet}))
    assert [r["v"] for r in readers.read(spark, str(tmp_path / "s.xlsx")).orderBy("_row_id").collect()] == ["1", "2"]
    assert readers.read_pasted(spark, "a,b\n1,2\n3,4").count() == 2


def test_word(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:t>Hello</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert [tuple(r)[:2] for r in readers.read(spark, str(tmp_path / "d.docx")).collect()] == [("Intro", "Hello")]


def test_layout(spark):
    items = [("d", 1, 10.0 + 100 * c, 700.0 - 20 * r + (c % 2), f"{r}{c}") for r in range(6) for c in range(2)]
    parts = layout.cells(layout.row_numbers(spark.createDataFrame(items, "doc string, page int, x double, y double, text string")))
    assert layout.strict_tables(parts).count() == 12
    assert layout.page_text(parts).first()["text"].startswith("--- Page 1 ---\n00 01")


def test_analysis_and_history(spark, tmp_path):
    a = analysis.analyse(sales(spark), "sales.csv")
    assert analysis.kpis(a)[0]["value"] == "5" and analysis.insights(a) and "repeated rows" in analysis.health_note(a)
    assert analysis.suggestions(a) and analysis.narrative(a)
    path = str(tmp_path / "history")
    assert writers.list_history(spark, path).count() == 0
    writers.append_history(analysis.history_entry(a), path)
    assert writers.list_history(spark, path).first()["file"] == "sales.csv"


def test_retrieval(spark):
    chunks = spark.createDataFrame([("1", "insights", "north revenue grew quickly"), ("2", "summary", "south costs fell"), ("3", "row_group", "")], "id string, family string, text string")
    got = retrieval.ask(chunks, "how did revenue grow")
    assert got["sources"][0]["id"] == "1" and got["answer"].startswith("north")
    assert retrieval.expand("top average") == ["top average", "maximum average", "top mean"]


def test_nearest_takes_many_queries(spark):
    rnd = random.Random(11)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 1.0]), (63, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    flat = {i: [x or 0.0 for x in (v or [])] for i, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    def cosine(a, b):
        size = math.sqrt(dot(a, a) * dot(b, b))
        return round(dot(a, b) / size, 6) if size else None
    asked = [0, 7, 20, 60, 62, 63]
    got = retrieval.nearest(df, df.where(F.col("vec_id").isin(asked)), k=4, rows=5).collect()
    want = []
    for q in asked:
        scored = [(cosine(flat[q], v), i) for i, v in flat.items()]
        want += [(q, i, s) for s, i in sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:4]]
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted(want, key=lambda r: r[:2])
    assert retrieval.nearest(df, df.limit(0)).count() == 0 and retrieval.nearest(df.limit(0), df).count() == 0


def test_gaps_of_days(spark):
    df = spark.createDataFrame([("2024-02-28", 4.0), ("2024-03-02", 1.0), ("2024-03-02", 5.0)], "day string, v double").withColumn("day", F.col("day").cast("timestamp"))
    got = olap.period_over_period(df, "v", "day", "day", fill_gaps=True).orderBy("period").collect()
    assert [(r["period"], r["value"], r["previous"]) for r in got] == [("2024-02-28", 4.0, None), ("2024-02-29", 0.0, 4.0), ("2024-03-01", 0.0, 0.0), ("2024-03-02", 6.0, 0.0)]
