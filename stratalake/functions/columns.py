"""Column expressions: blanks, dirty numbers, dates, booleans, rounding and display."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space of expressions, no-break space, byte order mark.
_EDGE = " \t\n\x0b\f\r\u00a0\ufeff"
#: What a number can be made of; only such values are taken apart.
_PARTS = rf"^[\d.,+\-eE()%\s\u00a0\ufeff{fixed.CURRENCY_SIGNS}]+$"
#: How the patterns of days begin.
_DAY_START = r"^(\d{1,4}[-/.\s]|[A-Za-z]{3,9}\s)"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(c: Column) -> Column:
    """Trim all white space, no-break spaces and byte order marks."""
    return F.btrim(c.cast("string"), F.lit(_EDGE))


def is_nullish(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*fixed.NULL_WORDS)


def without_nullish(c: Column) -> Column:
    return F.when(~is_nullish(c), trimmed(c))


def let(value: Column, then) -> Column:
    """`then` of a value that is evaluated once: its expression would otherwise be copied wherever it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def to_number(raw: Column, decimal_comma: bool = False) -> Column:
    """Double, or null: accounting brackets, currency signs, per cent, and commas as thousands or decimals.

    With both separators the last one is the decimal; a lone comma is decimal before exactly two last digits (always,
    with `decimal_comma`), a lone point always unless `decimal_comma`.
    """

    def plain(s: Column) -> Column:
        point, comma = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
        european = F.replace(F.regexp_replace(s, r"\.", ""), F.lit(","), F.lit("."))
        decimal = F.regexp_replace(s, "^([^,]*),", "$1.")
        lone = F.lit(True) if decimal_comma else s.rlike(r",\d{2}$")
        points = F.regexp_replace(s, r"\.", "") if decimal_comma else s
        without = F.regexp_replace(s, ",", "")
        both = s.contains(".") & s.contains(",")
        return F.when(both, F.when(comma > point, european).otherwise(without)).when(s.contains(","), F.when(lone, decimal).otherwise(without)).otherwise(points)

    def signed(s: Column) -> Column:
        bare = F.regexp_replace(s, f"^\\(|\\)$|[{fixed.CURRENCY_SIGNS}%]", "")
        scale = F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0) * F.when(s.contains("%"), 0.01).otherwise(1.0)
        return let(plain(trimmed(bare)), lambda n: F.when(n.rlike(_NUMBER), n.try_cast("double"))) * scale

    def read(s: Column) -> Column:
        dirty = F.when(s.rlike(_PARTS), signed(s))
        return dirty if decimal_comma else F.when(s.rlike(_NUMBER), s.try_cast("double")).otherwise(dirty)

    return let(trimmed(raw), read)


def to_day(raw: Column) -> Column:
    """Date, or null: the first of the patterns in order that gives a day of the calendar."""
    return let(trimmed(raw), lambda s: F.when(s.rlike(_DAY_START), _day_of(s)))


def _day_of(s: Column) -> Column:
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    def day(pattern: str, y: Column, m: Column, d: Column) -> Column:
        return F.when(s.rlike(pattern), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))

    def month(name: Column) -> Column:
        names = F.array(*[F.lit(m) for m in fixed.MONTH_NAMES])
        return F.array_position(names, F.lower(F.substring(name, 1, 3))).cast("string")

    iso, full = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    short, named, led = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})", r"^(\d{1,2})\s+([A-Za-z]{3,9}),?\s+(\d{4})"
    year = F.when(F.length(part(short, 3)) == 2, F.concat(F.lit("20"), part(short, 3))).otherwise(part(short, 3))
    first, second = part(short, 1), part(short, 2)
    swapped = first.try_cast("int") > 12
    return F.coalesce(
        day(iso, part(iso, 1), part(iso, 2), part(iso, 3)),
        day(full, part(full, 3), part(full, 2), part(full, 1)),
        day(short, year, F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)),
        day(named, part(named, 3), month(part(named, 1)), part(named, 2)),
        day(led, part(led, 3), month(part(led, 2)), part(led, 1)),
    )


def to_boolean(raw: Column) -> Column:
    return let(F.lower(trimmed(raw)), lambda s: F.when(s.isin(*fixed.TRUE_WORDS), True).when(s.isin(*fixed.FALSE_WORDS), False))


def finite(c: Column) -> Column:
    """The value as a double where it is a finite number, else null."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def share_of(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, places)


def percent_change(before: Column, after: Column, places: int = 2) -> Column:
    """Null without a base or on a base of 0."""
    return F.round(F.try_divide(after - before, F.abs(before)) * 100, places)


def compact(c: Column) -> Column:
    """1.23k, 1.23M, 1.23B; small numbers whole or with two places."""
    size = F.abs(c)
    d = c.cast("double")
    return (
        F.when(c.isNull(), "—")
        .when(size >= 1e9, F.format_string("%.2fB", d / 1e9))
        .when(size >= 1e6, F.format_string("%.2fM", d / 1e6))
        .when(size >= 1e3, F.format_string("%.2fk", d / 1e3))
        .when(d == F.floor(d), F.format_string("%.0f", d))
        .otherwise(F.format_string("%.2f", d))
    )


def snippet(c: Column, most: int) -> Column:
    return F.concat(F.substring(c, 1, most), F.when(F.length(c) > most, "…").otherwise(""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def any_contains(columns: list[Column], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c.cast("string")).contains(needle.lower()), F.lit(False)) for c in columns])


def compact_text(value: float | None) -> str:
    """`compact` for one number on the driver."""
    if value is None:
        return "—"
    for size, sign in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(value) >= size:
            return f"{value / size:.2f}{sign}"
    return f"{value:.0f}" if value == int(value) else f"{value:.2f}"


def plural(word: str) -> str:
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|ch|sh)$", word) else "s")


def safe_name(name: str) -> str:
    return re.sub(r"[^\w-]+", "_", re.sub(r"\.[^.]+$", "", name), flags=re.ASCII)


def spoken(c: Column) -> Column:
    """A number in a chunk of text: whole numbers plain, others with two places, a null as the word."""
    v = c.cast("double")
    return F.when(v.isNull(), "null").when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.format_string("%.2f", v))
