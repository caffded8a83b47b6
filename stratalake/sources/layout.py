"""Pages of positioned text items (as a PDF extractor gives them) to rows, columns, tables and paragraphs.

Items are a frame (doc, page, x, y, text).  Rows and cells are gaps and islands over windows of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds `row`: items within `tolerance` of a row's first y share it, from the top down."""
    listed = items.groupBy("doc", "page").agg(F.array_sort(F.collect_set((-F.col("y")).cast("double"))).alias("ys"))  # one page
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("first"), F.array().cast("array<struct<y:double,row:int>>").alias("out"))

    def step(acc, y):
        new = acc["first"].isNull() | (y - acc["first"] > tolerance)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(new, y).otherwise(acc["first"]).alias("first"), F.concat(acc["out"], F.array(F.struct((-y).alias("y"), row.alias("row")))).alias("out"))

    numbered = listed.select("doc", "page", F.explode(F.aggregate("ys", start, step, lambda acc: acc["out"])).alias("o")).select("doc", "page", "o.y", "o.row")
    return items.withColumn("y", F.col("y").cast("double")).join(numbered, ["doc", "page", "y"])


def cells(rows: DataFrame, gap: float = 18.0) -> DataFrame:
    """doc, page, row, cell, x and text: a gap in x over `gap` starts a new cell."""
    by = Window.partitionBy("doc", "page", "row").orderBy("x")
    cell = F.sum(F.when(F.col("x") - F.lag("x").over(by) > gap, 1).otherwise(0)).over(by)
    parts = rows.withColumn("cell", cell.cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ")
    return parts.groupBy("doc", "page", "row", "cell").agg(F.min("x").alias("x"), F.trim(joined).alias("text"))


def strict_tables(parts: DataFrame) -> DataFrame:
    """The cells of documents with a table: one column count on five rows and 60 % of candidates, aligned columns, short cells."""
    wide = Window.partitionBy("doc", "page", "row")
    candidates = parts.withColumn("n", F.count("*").over(wide)).where("n >= 2")
    counts = candidates.select("doc", "page", "row", "n").distinct().groupBy("doc", "n").agg(F.count("*").alias("rows"))
    every = Window.partitionBy("doc")
    best = counts.withColumn("all", F.sum("rows").over(every)).withColumn("place", F.row_number().over(every.orderBy(F.desc("rows"), F.desc("n"))))
    best = best.where((F.col("place") == 1) & (F.col("rows") >= 5) & (F.col("rows") >= 0.6 * F.col("all"))).select("doc", "n")
    table = candidates.join(best, ["doc", "n"])
    spread = table.groupBy("doc", "n", "cell").agg(F.stddev_pop("x").alias("s"), F.avg(F.length("text")).alias("len"), F.count("*").alias("c"))
    good = spread.groupBy("doc", "n").agg(F.count(F.when(F.col("s") < 12, 1)).alias("aligned"), (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean_len"))
    good = good.where((F.col("aligned") * 2 >= F.col("n")) & (F.col("mean_len") <= 40)).select("doc")
    return table.join(good, "doc").select("doc", "page", "row", "cell", "text")


def page_text(parts: DataFrame, most_pages: int = 60) -> DataFrame:
    """doc and text with a mark before each page; the page cap is that of a report."""
    line = parts.where(F.col("page") <= most_pages).groupBy("doc", "page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " ").alias("line"))
    page = line.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda c: c["line"]), "\n").alias("body"))
    marked = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("body"))
    return page.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda c: c["t"]), "\n\n").alias("text"))
