"""The queries of this subpackage over the test tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, fingerprints, langid, licenses, lines, neardup, packing, pii, quality, rules
from gridloom.llm.common import documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates over sets of four words, similarity 0.8 or more."""
    return neardup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.held_out_predictions(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited."""
    return licenses.license_rows(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document and which rules keep it."""
    return rules.rule_rows(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    return lines.deduplicated(documents(spark, sf_dir), digest=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels that are not held out."""
    return quality.held_out_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, under the session's key or one drawn for this call."""
    return pii.surrogates(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its place of a sequence."""
    return packing.pack_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_fingerprints, op2_near_duplicates, op3_language, op4_licenses, op5_quality_rules, op6_line_dedup, op7_quality_classifier, op8_pii_surrogates, op9_bpe, op10_packing]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": licenses.ORACLE_OP4, "op5_quality_rules": rules.ORACLE_OP5, "op6_line_dedup": lines.ORACLE_OP6}
