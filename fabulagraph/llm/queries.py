"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fabulagraph.llm import decontaminate, html, language, mixing, ngram_join, quality, secrets, suffixes, toxicity, urls
from fabulagraph.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, d: quality.op1(table(spark, d, "documents")),
    "op2_html_extraction": lambda spark, d: html.op2(table(spark, d, "pages")),
    "op3_decontamination": lambda spark, d: decontaminate.op3(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_ngram_join": lambda spark, d: ngram_join.op4(table(spark, d, "documents")),
    "op5_secret_scan": lambda spark, d: secrets.op5(table(spark, d, "documents")),
    "op6_toxicity": lambda spark, d: toxicity.op6(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_url_filter": lambda spark, d: urls.op7(table(spark, d, "pages")),
    "op8_suffix_array_dedup": lambda spark, d: suffixes.op8(table(spark, d, "documents")),
    "op9_language_id": lambda spark, d: language.op9(table(spark, d, "documents")),
    "op10_source_mixing": lambda spark, d: mixing.op10(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op8_suffix_array_dedup": suffixes.ORACLE,
    "op10_source_mixing": mixing.ORACLE.format(docs="documents"),
}
