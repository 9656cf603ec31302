"""The training-data operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, ctw, decontaminate, hyperminhash, license, permutation, pii, sentencepiece, substring, urlfilter
from .common import table


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.code_lengths(table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.neighbours(table(spark, sf_dir, "embeddings"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality,
    "op2_lm_score": lm_score,
    "op3_near_dedup": near_dedup,
    "op4_pii": find_pii,
    "op5_substring_dedup": substring_dedup,
    "op6_url_filter": url_filter,
    "op7_decontamination": decontamination,
    "op8_sentencepiece": sentencepiece_ids,
    "op9_neighbours": nearest,
    "op10_license_scan": license_scan,
}

SQL: dict[str, str] = {
    "op3_near_dedup": hyperminhash.SQL,
    "op5_substring_dedup": substring.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op10_license_scan": license.SQL,
}
