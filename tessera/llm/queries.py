"""The queries of this subpackage, each over a whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, counting, dart, exact, mixing, packing, quality, suffixes, urlfilter, warczip
from .common import documents, pages


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.robust_outliers(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_to_files(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(pages(spark, sf_dir))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.round_trip(pages(spark, sf_dir))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.near_classes(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact.ORACLE, "op8_url_filter": urlfilter.ORACLE, "op9_warc_archives": warczip.ORACLE}
