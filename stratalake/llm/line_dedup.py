"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

A document is the sequence of its lines (split at line feeds).  Lines get ids in the order of their 128-bit hashes; then
each round ranks runs of twice as many lines by the pair of their halves' ranks.  Ranks keep the order (a range-sorted
table of the distinct pairs numbers them), so after h lines all positions stand in the order of the suffix array as
far as h lines tell, and positions of one rank are an interval of it whose longest common prefix is h lines at least.
A position that is alone in its interval has its place and leaves; rounds go on until none is left, that is, until
the longest repeated run is found.

In each interval of at least `min_lines` lines the first position, by doc_id and then place, stays; at all others the
interval's lines are a later copy.  The longest copy at each position counts, copies that overlap or touch join into
maximal repeated runs, and these are deleted.  (An interval's prefix is known up to its power of two; a longer common
prefix shows as the same interval at the positions that follow, so the joined runs are whole.)

With `min_words`, one line is a run too if it has that many words, or if it is a whole document and has a word: then
the bound on a run is its lines or its words.

Pairs are counted before they are shuffled, and ranks come back to positions by a join, which Spark splits where one
line is hot; positions are never gathered by line.  Lines that occur once leave before any doubling.

A null text is one empty line.  Rows that agree in doc_id and text count as one document and get one result each; a
null doc_id comes last.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, forget, row_hash, stash

MIN_LINES = 2
#: Words from which one line that repeats is a passage.
MIN_WORDS = 50


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_ids(text: Column, min_words: int | None = None) -> Column:
    """The two halves of each line's hash, and whether the line is a run by itself (kind 1 by its words, 2 as a whole document, else 0)."""
    lines = split_lines(text)
    words = lambda x: F.regexp_count(x, F.lit(WORD))
    kind = lambda x: F.when(words(x) >= min_words, 1).when((F.size(lines) == 1) & (words(x) > 0), 2).otherwise(0)
    no_kind = F.lit(0)
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("rank"), row_hash(1, x).alias("next"), (no_kind if min_words is None else kind(x)).alias("kind")))


def place() -> Column:
    """The order of positions: a null doc_id comes last."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("own"), F.col("pos"))


def ranked(pairs: DataFrame) -> DataFrame | None:
    """rank and next of each pair that stands at two positions or more, with its first place and its number `new` in sorted order; None if there is none.

    Numbers keep the order but leave gaps: a partition's number is its high bits.
    """
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1").drop("n")
    keys = stash(often.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id()))
    return keys if keys.limit(1).count() else None


def intervals(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """For 1, 2, ... lines: the positions that are not alone, with their rank in the suffix array so far, kind, and whether they are later copies.

    Lengths double, but for a step to `min_lines` itself.
    """
    seqs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), line_ids(F.col("text"), min_words).alias("lines"))
    seqs = seqs.groupBy("id", "own").agg(F.first("lines").alias("lines"))
    pairs = stash(seqs.select("id", "own", F.posexplode("lines").alias("pos", "line")).select("id", "own", "pos", "line.*"))
    by = Window.partitionBy("id", "own").orderBy("pos")
    length = step = 0
    while (keys := ranked(pairs)) is not None:
        level = pairs.join(keys, ["rank", "next"]).select("id", "own", "pos", "kind", F.col("new").alias("rank"), (place() > F.col("first")).alias("again"))
        level = stash(level)
        forget(pairs, keys)
        length += step or 1
        yield length, level
        step = min(length, min_lines - length) if length < min_lines else length
        # the rank of the position `step` lines on, if that is not alone
        following = F.max("rank").over(by.rangeBetween(step, step))
        pairs = stash(level.select("id", "own", "pos", "kind", "rank", following.alias("next")).where("next is not null"))
    forget(pairs)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """id, own (hash of the text) and runs: the sorted maximal repeated runs [a, b) of lines of each document that has later copies."""
    copies = []
    for length, level in intervals(docs, min_lines, min_words):
        if length == 1 and min_words is not None:
            firsts = level.where("kind > 0").groupBy("kind", "rank").agg(F.min(place()).alias("first"))
            single = level.join(firsts, ["kind", "rank"]).where(place() > F.col("first"))
            copies.append(single.select("id", "own", "pos", F.lit(1).alias("span")))
        if length >= min_lines:
            copies.append(level.where("again").select("id", "own", "pos", F.lit(length).alias("span")))
    if not copies:
        none = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), F.array().cast("array<struct<a:int,b:int>>").alias("runs"))
        return none.where(F.lit(False))
    longest = reduce(DataFrame.unionByName, copies).groupBy("id", "own", "pos").agg(F.max("span").alias("span"))
    by = Window.partitionBy("id", "own").orderBy("pos")
    end = F.col("pos") + F.col("span")
    reached = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    heads = longest.withColumn("head", (reached.isNull() | (F.col("pos") > reached)).cast("int")).withColumn("nth", F.sum("head").over(by))
    runs = heads.groupBy("id", "own", "nth").agg(F.min("pos").alias("a"), F.max(end).alias("b"))
    return runs.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and kept (the text that is left; null if all lines are deleted)."""
    cut = repeated_runs(docs, min_lines, min_words).select(F.col("id").alias("__id"), F.col("own").alias("__own"), "runs")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    rows = own.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own")), "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<a:int,b:int>>"))
    # the stretches between the runs stay
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["b"]))
    ends = F.concat(F.transform("runs", lambda r: r["a"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["b"] - r["a"])
    return rows.select("doc_id", split_lines(F.col("text")).alias("lines"), runs.alias("runs")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.when(removed < F.size("lines"), F.array_join(kept, "\n")).alias("kept"),
    )


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    return hashed(dedup_lines(docs))


def op9_passage_dedup(docs: DataFrame) -> DataFrame:
    """As op9_line_dedup, and passages and documents that sit on one line are deleted as well."""
    return hashed(dedup_lines(docs, min_words=MIN_WORDS))


def op9_sql(min_lines: int = MIN_LINES) -> str:
    runs = " || chr(10) || ".join(["line", *[f"lead(line, {i}) OVER w" for i in range(1, min_lines)]])
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
    r AS (SELECT doc_id, pos, {runs} AS run FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM r WHERE run IS NOT NULL),
    c AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, range({min_lines}) t(d) WHERE nth > 1),
    m AS (SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS cut FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos),
    k AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM m)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE head) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
    FROM k GROUP BY doc_id"""


def op9_passage_sql(min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> str:
    runs = " || chr(10) || ".join(["line", *[f"lead(line, {i}) OVER w" for i in range(1, min_lines)]])
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
    w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM l),
    r AS (SELECT doc_id, pos, 0 AS kind, {min_lines} AS span, {runs} AS run FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
      UNION ALL SELECT doc_id, pos, 1, 1, line FROM w WHERE words >= {min_words}
      UNION ALL SELECT doc_id, pos, 2, 1, line FROM w WHERE words > 0 AND words < {min_words} AND n = 1),
    f AS (SELECT doc_id, pos, span, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, pos) AS nth FROM r WHERE run IS NOT NULL),
    c AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, range({min_lines}) t(d) WHERE nth > 1 AND d < span),
    m AS (SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS cut FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos),
    k AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM m)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE head) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
    FROM k GROUP BY doc_id"""
