"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starpipe.llm import (
    audit, jaccard, language, mixing, nbsvm, packing, quality, secrets, spelling, substring, suffixes, topk, urls,
)
from starpipe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function, sql: str | None = None):
    QUERIES[function.__name__] = function
    if sql is not None:
        ORACLES[function.__name__] = sql
    return function


def op1_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_topk_search(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op7_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality_classifier(spark, sf_dir):
    return nbsvm.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


query(op1_substring_dedup, substring.SQL)
query(op2_url_filter)
query(op3_source_mixing, mixing.SQL)
query(op4_topk_search, topk.SQL)
query(op5_quality_rules)
query(op6_secret_scan)
query(op7_language_id)
query(op8_packing)
query(op9_jaccard_join)
query(op10_suffix_dedup)
query(op11_filter_audit, audit.SQL)
query(op12_quality_classifier)
query(op13_spelling_variants)
