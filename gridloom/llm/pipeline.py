"""The corpus pipeline: quality, lines, near duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import lines, neardup, packing, pii, quality
from gridloom.llm.common import documents, dropped, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(texts: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return texts.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier of operator 7, learned from this corpus and its labels, scores under 0.5."""
    model = quality.fit(docs, documents(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=COLUMNS[1:]).filter("score >= 0.5").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines found in at least ten documents keep the first, by document and position; a document left without any text stays, empty."""
    return _counted(lines.deduplicated(docs, keep_first=True, carry=["lang", "source"]))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of near duplicates (five words, 0.8)."""
    kept = stored(neardup.near_duplicates(docs).filter("kept").select("doc_id").distinct())
    return docs.join(kept, "doc_id", "left_semi").select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    return _counted(pii.surrogates(docs, carry=["lang", "source"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii_surrogates", pii_stage),
    ("best_fit_packing", packing_stage),
]
#: The stages' models and packing have no SQL form. tests/llm hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packing_stage() over what the stages before it keep of documents. Each stage is written as a table, and
    goes when the next one is. Rows that repeat a document repeat; an empty table gives no rows; null texts are empty."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
