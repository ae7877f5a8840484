"""Queries of the llm operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.quality import apply_policy, ledger

    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return apply_policy(rows, "v3").drop("text")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.quality import ablation, ledger

    return ablation(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"]).drop("mix_source")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.fingerprints import robustness

    return robustness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.sharding import assign, digest

    return digest(assign(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.substrings import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.merkle import tamper_check

    return tamper_check(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.centroids import clusters, digest

    return digest(*clusters(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "quality_ablation": quality_ablation,
        "op2_mixing": op2_mixing,
        "op3_fingerprints": op3_fingerprints,
        "op4_pii": op4_pii,
        "op5_language_id": op5_language_id,
        "op6_sharding": op6_sharding,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_packing": op8_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_line_dedup": op12_line_dedup,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    from emberlog.llm import centroids, jaccard, line_dedup, merkle, quality, substrings

    return {
        "op1_quality_rules": quality.policy_sql("v3"),
        "quality_ablation": quality.ablation_sql(),
        "op7_jaccard_join": jaccard.COMPONENTS_SQL,
        "op9_substring_dedup": substrings.DEDUP_SQL,
        "op11_merkle_manifest": merkle.TAMPER_SQL,
        "op12_line_dedup": line_dedup.DEDUP_SQL,
        "op13_centroid_clustering": centroids.CLUSTERING_SQL,
    }
