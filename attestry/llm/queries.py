"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, crosspolytope, fingerprints, minhash, mixing, paragraphs, quotations, rules, suffixes, urlgraph
from .common import table


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.filter_urls(table(spark, sf_dir, "pages"))


def op3_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_units(table(spark, sf_dir, "documents"))


def op7_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"), least=paragraphs.SIZE)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.score(docs, rules.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_url_filters": op2_url_filters,
    "op3_suffix_buckets": op3_suffix_buckets,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_fingerprints": op5_fingerprints,
    "op6_mix_sources": op6_mix_sources,
    "op7_repeats": op7_repeats,
    "op7_paragraph_bands": op7_paragraph_bands,
    "op7_passages": op7_passages,
    "op7_lines": op7_lines,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quotations": op9_quotations,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_forest": minhash.op1_sql(),
    "op2_url_filters": urlgraph.op2_sql(),
    "op4_cross_polytope": crosspolytope.op4_sql(),
    "op6_mix_sources": mixing.op6_sql(),
    "op7_paragraph_bands": paragraphs.op7_sql(),
    "op7_lines": paragraphs.op7_sql(paragraphs.SIZE),
}
