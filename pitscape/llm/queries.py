"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitscape.llm import compression, infill, language, licences, mixing, ngram_join, pii, quantised, reputation, suffixes, tiling, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


@_query("op2_mix_sources", mixing.ORACLE)
def op2(spark, sf_dir):
    return mixing.mixture(_table(spark, sf_dir, "documents"))


@_query("op3_warc_round_trip", warc.ORACLE)
def op3(spark, sf_dir):
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).drop("payload")


@_query("op5_licence_scan")
def op5(spark, sf_dir):
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


@_query("op7_host_reputation", reputation.ORACLE)
def op7(spark, sf_dir):
    return reputation.judged(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


@_query("op9_compression_quality")
def op9(spark, sf_dir):
    return compression.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op6_private_spans")
def op6(spark, sf_dir):
    return pii.private_spans(_table(spark, sf_dir, "documents"))


@_query("op4_greedy_tiling")
def op4(spark, sf_dir):
    return tiling.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op8_quantised_neighbours")
def op8(spark, sf_dir):
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op1_ngram_groups")
def op1(spark, sf_dir):
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


@_query("op10_repeated_bytes")
def op10(spark, sf_dir):
    return suffixes.deduplicated(_table(spark, sf_dir, "documents"), with_kept=False)


@_query("op11_fill_in_middle", infill.ORACLE)
def op11(spark, sf_dir):
    return infill.digests(_table(spark, sf_dir, "documents"))


@_query("op12_whitened_embeddings")
def op12(spark, sf_dir):
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@_query("op13_language")
def op13(spark, sf_dir):
    return language.predicted_languages(_table(spark, sf_dir, "documents"))
