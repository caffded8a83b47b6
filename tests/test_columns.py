import datetime as dt
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalake.functions import columns as C
from stratalake.functions import text as X


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", f(F.col("s"))).orderBy("i").collect()]


def test_numbers(spark):
    given = ["$1,250.50", "(300)", "12%", "1.234,56", "1,50", "1,500", "€1.100", "abc", "$", None, " 7 ", "1e3", "0x1A"]
    assert one(spark, given, C.to_number) == [1250.5, -300.0, 0.12, 1234.56, 1.5, 1500.0, 1.1, None, None, None, 7.0, 1000.0, None]


def test_days(spark):
    given = ["2024-1-5", "2024-01-05T10:20:00", "01/02/2024", "01/18/2024", "Jan 5, 2024", "5 Jan 2024", "3/4/24", "2024-02-31", "2024.07.20", "x", None]
    d = dt.date
    assert one(spark, given, C.to_day) == [d(2024, 1, 5), d(2024, 1, 5), d(2024, 2, 1), d(2024, 1, 18), d(2024, 1, 5), d(2024, 1, 5), d(2024, 3, 4), None, None, None, None]


def test_booleans_and_blanks(spark):
    assert one(spark, ["Yes", "n", "1", "maybe", None], C.to_boolean) == [True, False, True, None, None]
    assert one(spark, [" N/A ", "--", "", "0", None, "x "], C.without_nullish) == [None, None, None, "0", None, "x"]


def test_text(spark):
    assert one(spark, ["The quick, brown fox a"], X.tokens) == [["quick", "brown", "fox"]]
    assert one(spark, ["One here. Two there! three"], lambda c: F.size(X.sentences(c))) == [2]
    assert one(spark, ["abcd", "ab", None], X.trigrams) == [["abc", "bcd"], [], []]
    assert one(spark, ["make", "the", "beautiful", ""], X.syllables) == [1, 1, 4, 0]
    assert one(spark, ["mail a@b.org now"], lambda c: X.entities(c, "email")) == [["a@b.org"]]


@given(st.floats(-1e12, 1e12, allow_nan=False))
def test_compact_text_is_short(v):
    assert len(C.compact_text(v)) < 18


@pytest.mark.parametrize(("word", "many"), [("category", "categories"), ("box", "boxes"), ("day", "days"), ("class", "classes")])
def test_plural(word, many):
    assert C.plural(word) == many


def test_trigrams_of_a_long_text_take_one_pass(spark):
    df = spark.range(1).select(F.repeat(F.lit("aB-9é"), 100_000).alias("t"))
    start = time.time()
    got = {tuple(r) for r in df.select(F.explode(X.trigrams(F.col("t"))).alias("gram")).groupBy("gram").count().collect()}
    assert got == {("ab9", 100_000), ("b9a", 99_999), ("9ab", 99_999)} and time.time() - start < 20
