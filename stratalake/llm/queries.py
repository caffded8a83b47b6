"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontam, html_text, lexical, line_dedup, media, mixing, preference, quality, secret_scan, setjoin, shards, suffix_dedup
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on_docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    with_other = lambda f, other: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, other))
    return {
        "op1_secret_scan": on_docs(secret_scan.op1_secret_scan),
        "op2_sharding": on_docs(shards.op2_sharding),
        "op3_source_mixing": on_docs(mixing.op3_source_mixing),
        "op4_decontamination": with_other(decontam.op4_decontamination, "benchmark"),
        "op5_quality": with_other(quality.op5_quality, "labels"),
        "op6_media_chunks": on_docs(media.op6_media_chunks),
        "op7_suffix_dedup": on_docs(suffix_dedup.op7_suffix_dedup),
        "op8_preference_formatting": lambda spark, sf_dir: preference.op8_preference_formatting(table(spark, sf_dir, "conversations")),
        "op9_line_dedup": on_docs(line_dedup.op9_line_dedup),
        "op9_passage_dedup": on_docs(line_dedup.op9_passage_dedup),
        "op10_jaccard_join": on_docs(setjoin.op10_jaccard_join),
        "op11_html_extraction": lambda spark, sf_dir: html_text.op11_html_extraction(table(spark, sf_dir, "pages")),
        "op13_collocations": on_docs(collocations.op13_collocations),
        "op12_ranked_search": with_other(lexical.op12_ranked_search, "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_preference_formatting": preference.op8_sql(), "op12_ranked_search": lexical.op12_sql(), "op13_collocations": collocations.op13_sql(), "op9_line_dedup": line_dedup.op9_sql(), "op9_passage_dedup": line_dedup.op9_passage_sql()}
