"""Column expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import let


def _kept(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def tokens(text: Column, unicode: bool = False) -> Column:
    """Words of a document: lower case, letters and digits (ASCII unless `unicode`), two or more characters, no stop words."""
    outside = r"[^\p{L}\p{N}\s]" if unicode else r"[^a-z0-9\s]"
    return _kept(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), outside, " "), r"\s+"), fixed.STOP_WORDS)


def question_tokens(text: Column) -> Column:
    """Words for retrieval: underscores and inner points stay."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s.]", " "), r"\s+")
    return _kept(F.transform(parts, lambda t: F.regexp_replace(t, r"^[.]+|[.]+$", "")), fixed.QUESTION_STOP_WORDS)


def trigrams(text: Column) -> Column:
    """Every three letters or digits in a row, overlaps included; one pass, as a place in a string is found by counting from its start."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", ""), F.lit("(?=([a-z0-9]{3}))"), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.length(F.trim(s)) > 0)


def paragraphs(text: Column, over: int = 30) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|--- Page \d+ ---"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) > over)


def syllables(word: Column) -> Column:
    """Of a word of ASCII letters, digits and underscores."""

    def counted(w: Column) -> Column:
        stem = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
        return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]{1,2}"))))

    return let(F.translate(F.lower(word), "0123456789_", ""), counted)


def reading_ease(text: Column) -> Column:
    def scored(n: Column) -> Column:
        score = 206.835 - 1.015 * (n["words"] / n["sentences"]) - 84.6 * (n["syllables"] / n["words"])
        return F.when((n["words"] > 0) & (n["sentences"] > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)

    total = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    counts = lambda w: F.struct(F.size(w).alias("words"), F.size(sentences(text)).alias("sentences"), total(w).alias("syllables"))
    return let(words(text), lambda w: let(counts(w), scored))


def reading_label(score: Column) -> Column:
    out = F.lit(fixed.READING_LABELS[-1][1])
    for least, label in reversed(fixed.READING_LABELS[:-1]):
        out = F.when(score >= least, label).otherwise(out)
    return out


def entities(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.ENTITY_PATTERNS[kind]), F.lit(0))


def entity_summary(text: Column, kind: str, most: int = 8) -> Column:
    """struct<n, samples>: how often, and the first distinct ones; the text is searched once."""
    samples = lambda found: F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(x))), 1, most)
    return let(entities(text, kind), lambda found: F.struct(F.size(found).cast("long").alias("n"), samples(found).alias("samples")))


def sentiment(text: Column) -> Column:
    hits = lambda t, listed: F.size(F.filter(t, lambda x: x.isin(*listed)))
    share = lambda t: F.try_divide(hits(t, fixed.POSITIVE_WORDS) - hits(t, fixed.NEGATIVE_WORDS), F.size(t))
    return F.round(F.coalesce(let(tokens(text), share), F.lit(0.0)), 3) + 0.0


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.02, "positive").when(score < -0.02, "negative").otherwise("neutral")
