"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .manifest import MANIFEST_SQL
from .phrases import COLLOCATIONS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_report

    return token_file_report(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_report

    return media_report(_table(spark, sf_dir, "documents"))


def op4_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_report

    return piece_report(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packing_report

    return packing_report(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest_report

    return manifest_report(_table(spark, sf_dir, "documents"))


def op12_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_chunked_media, op4_suffix_pieces, op5_gated_language_model, op7_trie_counts, op3_classifier_chain, op6_jaccard_rtree, op8_collinear_chains, op9_permutation_index, op10_tiered_packing, op11_merkle_manifest, op12_stripe_collocations, op13_unlabelled_quality)}
ORACLES: dict[str, str] = {"op11_merkle_manifest": MANIFEST_SQL, "op12_stripe_collocations": COLLOCATIONS_SQL}
