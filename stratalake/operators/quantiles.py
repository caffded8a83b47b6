"""Exact order statistics by narrowing, without a task that holds a column's values.

A bracket is a range of values that holds a wanted rank, with the counts of values below and inside it; the first one is
the whole column.  A round takes a mergeable sketch of the values inside (one scan), reads off two values close to the
rank on either side, and counts what lies below, at, between and above these (one scan).  The part with the rank is the
next bracket, so results are exact whatever the sketch's error, and each round takes two values off at least.  A bracket
of one value is done; one of up to `sorted_` values has its distinct values ordered in a window; others go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

Ranks = Callable[[int, float], tuple[int, int, float]]
#: Values that one task orders at most.
SORTED = 1 << 18
#: Size of a sketch: its error is about 2.3 / SKETCH**0.9 of the values.
SKETCH = 4096


def between(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks (from 0) around p * (n - 1), and the weight of the upper one."""
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def middle(n: int, _: float) -> tuple[int, int, float]:
    """The upper median: rank n // 2."""
    return n // 2, n // 2, 0.0


@dataclass
class Bracket:
    """Values low..high of a column, `below` of all smaller and `inside` in it, that hold the ranks lower..upper."""

    column: str
    lower: int
    upper: int
    low: float
    high: float
    below: int
    inside: int

    def holds(self, v: Column) -> Column:
        return v.between(F.lit(self.low), F.lit(self.high))


def exact_quantiles(df: DataFrame, values: dict[str, Column], at: tuple[float, ...], ranks: Ranks = between, accuracy: int = SKETCH, sorted_: int = SORTED) -> dict[str, list[float | None]]:
    """For each named numeric column, its value at each of `at`; None where it has no values."""
    return quantiles_and(df, values, at, [], ranks, accuracy, sorted_)[0]


def quantiles_and(df: DataFrame, values: dict[str, Column], at: tuple[float, ...], also: list[Column], ranks: Ranks = between, accuracy: int = SKETCH, sorted_: int = SORTED) -> tuple[dict[str, list[float | None]], Row]:
    """The same with the row of other aggregates (`also`), which the first scan takes along."""
    v, size = {n: c.cast("double") for n, c in values.items()}, min(65535, max(8, accuracy))
    first = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.kll_sketch_agg_double(c, F.lit(size)).alias("sketch")).alias(f"q{i}") for i, c in enumerate(v.values())], *also).first()
    open_: dict[tuple[str, int], Bracket] = {}
    weights: dict[tuple[str, int], float] = {}
    sketches = {}
    for i, name in enumerate(v):
        s = first[f"q{i}"]
        for j, p in enumerate(at):
            if s["n"]:
                lower, upper, weights[name, j] = ranks(s["n"], p)
                open_[name, j] = Bracket(name, lower, upper, s["low"], s["high"], 0, s["n"])
                sketches[name, s["low"], s["high"]] = s["sketch"]
    found: dict[tuple[str, int], tuple[float, float]] = {}
    while open_:
        found |= {k: (b.low, b.low) for k, b in open_.items() if b.low == b.high}
        small = {k: b for k, b in open_.items() if k not in found and b.inside <= sorted_}
        found |= _ordered(df, v, small) if small else {}
        open_ = {k: b for k, b in open_.items() if k not in found}
        if open_:
            open_, more = _narrowed(df, v, open_, sketches, size)
            found |= more
            sketches = {}
    value = lambda k: None if k not in found else found[k][0] if not weights[k] or found[k][0] == found[k][1] else (1 - weights[k]) * found[k][0] + weights[k] * found[k][1]
    return {n: [value((n, j)) for j in range(len(at))] for n in v}, first


def _narrowed(df: DataFrame, v: dict[str, Column], open_: dict[tuple[str, int], Bracket], sketches: dict, size: int) -> tuple[dict[tuple[str, int], Bracket], dict[tuple[str, int], tuple[float, float]]]:
    """A smaller bracket for each, or its values; equal brackets share a sketch."""
    ranges = {(b.column, b.low, b.high): b for b in open_.values()}
    if missing := [r for r in ranges if r not in sketches]:
        row = df.agg(*[F.kll_sketch_agg_double(F.when(ranges[r].holds(v[r[0]]), v[r[0]]), F.lit(size)).alias(f"s{i}") for i, r in enumerate(missing)]).first()
        sketches = sketches | {r: row[f"s{i}"] for i, r in enumerate(missing)}
    margin = min(0.25, 8 / size**0.9)
    near = lambda b, rank, side: min(1.0, max(0.0, (rank - b.below) / b.inside + side * (margin + 2 / b.inside)))
    asked = [F.kll_sketch_get_quantile_double(F.lit(bytes(sketches[b.column, b.low, b.high])), F.array(F.lit(near(b, b.lower, -1)), F.lit(near(b, b.upper, 1)))) for b in open_.values()]
    cuts = [r["ends"] for r in df.sparkSession.range(1).select(F.explode(F.array(*asked)).alias("ends")).collect()]  # two values for each bracket
    at: dict[str, set[float]] = {}
    for b, (low, high) in zip(open_.values(), cuts, strict=True):
        at.setdefault(b.column, set()).update((low, high))
    # a value's place among its column's cuts: even between two, odd at one
    most, names = max(map(len, at.values())), list(at)
    table = F.array(*[F.array(*[F.lit(x) for x in [*sorted(some), *[math.inf] * (most - len(some))]]) for some in at.values()])
    own = [F.element_at(F.element_at(table, F.col("i") + 1), j + 1) for j in range(most)]
    place = sum([F.when(F.col("v") > x, 2).when(F.col("v") == x, 1).otherwise(0) for x in own], F.lit(0))
    each = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v[n].alias("v")) for i, n in enumerate(names)]))).where("v is not null")
    counts = each.groupBy("i", place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts: dict[str, list[Bracket]] = {n: [] for n in at}
    for i, _, n, low, high in sorted(counts.collect()):  # two rows for each cut at most, and one
        own_ = parts[names[i]]
        own_.append(Bracket(names[i], 0, 0, low, high, own_[-1].below + own_[-1].inside if own_ else 0, n))
    out, found = {}, {}
    for k, b in open_.items():
        lower, upper = (next(p for p in parts[b.column] if p.below <= rank < p.below + p.inside) for rank in (b.lower, b.upper))
        if lower is upper:
            out[k] = Bracket(b.column, b.lower, b.upper, lower.low, lower.high, lower.below, lower.inside)
        else:  # neighbours in different parts
            found[k] = lower.high, upper.low
    return out, found


def _ordered(df: DataFrame, v: dict[str, Column], small: dict[tuple[str, int], Bracket]) -> dict[tuple[str, int], tuple[float, float]]:
    """The values at both ranks of each bracket, from counts of its distinct values in order."""
    inside = [F.struct(F.lit(i).alias("w"), F.when(b.holds(v[b.column]), v[b.column]).alias("value")) for i, b in enumerate(small.values())]
    counts = df.select(F.inline(F.array(*inside))).where("value is not null").groupBy("w", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("value"))
    wanted = df.sparkSession.createDataFrame([(i, b.below, b.lower, b.upper) for i, b in enumerate(small.values())], "w int, below long, lower long, upper long")
    ranked = counts.withColumn("upto", upto).join(F.broadcast(wanted), "w").withColumn("upto", F.col("upto") + F.col("below"))  # a row for each bracket
    holds = lambda c: (F.col(c) < F.col("upto")) & (F.col(c) >= F.col("upto") - F.col("n"))
    hits: dict[int, dict[str, float]] = {}
    for r in ranked.select("w", "value", holds("lower").alias("lower"), holds("upper").alias("upper")).where("lower or upper").collect():  # two rows for each bracket
        for side in ("lower", "upper"):
            if r[side]:
                hits.setdefault(r["w"], {})[side] = r["value"]
    return {k: (hits[i]["lower"], hits[i]["upper"]) for i, k in enumerate(small)}
