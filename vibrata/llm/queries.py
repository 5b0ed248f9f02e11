"""The queries of this subpackage, with production parameters over whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vibrata.llm import bpe, decontamination, exact_dedup, gru_lm, impact_index, licenses, merkle, mixing, quality, sharding, simhash, topk, toxicity
from vibrata.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, a row each; see ``licenses.scan``."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity, with its fold; see ``toxicity.score`` for nulls, repeats and empty tables."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50; see ``topk.top_k``."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; see ``sharding.sharded``."""
    return sharding.sharding(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality, with its fold; see ``quality.score``."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents; see ``gru_lm.fit`` and ``gru_lm.score``."""
    return gru_lm.lm_scoring(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as hashes; see ``bpe.round_trip``."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it; see ``exact_dedup.groups``."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component; see ``simhash.near_groups``."""
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see ``mixing.mix``."""
    return mixing.mixing(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item; see ``impact_index.ranked``."""
    return impact_index.ranked_lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that lie in windows of benchmark items; see ``decontamination.contamination``."""
    return decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, with what a tampered text gives; see ``merkle.manifest``."""
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_toxicity, op3_exact_top_k, op4_sharding, op5_quality_classifier, op6_gru_lm, op7_byte_bpe, op8_exact_dedup, op9_simhash, op10_mixing,
        op11_ranked_search, op12_decontamination, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": topk.SQL, "op8_exact_dedup": exact_dedup.SQL, "op10_mixing": mixing.SQL, "op11_ranked_search": impact_index.SQL, "op12_decontamination": decontamination.SQL, "op13_merkle_manifest": merkle.SQL}
