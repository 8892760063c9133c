"""Registered queries of the operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, decontamination, exact_dedup, language, language_model, main_text, mixing, ngram_join, periodic, token_files, topk, toxicity, url_lists)
from .common import table


def op1_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, d, "documents"), ngram_join.Rule(4, 85, 100))


def op2_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text.main_texts(table(spark, d, "pages"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_url_lists(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return url_lists.evaluate(url_lists.dated_captures(pages), url_lists.derived_entries(pages))


def op5_language(spark: SparkSession, d: str) -> DataFrame:
    return language.report(table(spark, d, "documents"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the order in which their first copies are due; those that are not taken come last."""
    due = mixing.scheduled(table(spark, d, "documents"))
    return due.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op7_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_language_model(spark: SparkSession, d: str) -> DataFrame:
    return language_model.scored(table(spark, d, "documents"))


def op10_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.token_table(table(spark, d, "documents"))


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.report(table(spark, d, "documents"))


def op12_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.nearest(table(spark, d, "embeddings"))


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic.report(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_join, op2_main_text, op3_decontamination, op4_url_lists, op5_language, op6_mixing, op7_exact_dedup, op8_toxicity, op9_language_model,
    op10_token_files, op11_token_alignment, op12_exact_topk, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {
    "op4_url_lists": url_lists.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_exact_topk": topk.ORACLE_SQL}
