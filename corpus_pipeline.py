"""From raw documents to packed training sequences, in four stages.

Each stage reads what its predecessor kept: quality rules, quality classifier, near-duplicate
removal, packing. ``run`` writes each stage's result as Parquet and reads it back for the next.

Edge cases: a null or empty text fails the base rules, so it goes in the first stage, whatever the
other columns hold; rows with a null id are judged by their text like any other, but teach the
classifier nothing; rows that repeat an id with other texts are documents of their own; of repeated
rows one stays; an empty table gives no pieces; without labels the classifier keeps all. Columns of
documents named like those that an operator adds pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiotrack.llm.common import materialize, release, table
from spatiotrack.llm.near_dedup import deduplicate
from spatiotrack.llm.packing import pack_documents
from spatiotrack.llm.quality_classifier import fit_classifier, score_documents
from spatiotrack.llm.quality_rules import ADDED, FEATURES, quality_rules

ADDED_COLUMNS = (*FEATURES, *ADDED, "score")


def _with_own_columns(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """What ``stage`` keeps, with the columns of ``docs`` as they were, also those named like columns that it adds."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ADDED_COLUMNS}
    kept = stage(docs.withColumnsRenamed(own))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity bands."""
    return _with_own_columns(lambda d: quality_rules(d).filter("kept"), docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to labelled rows among ``docs``, scores 0.5 or more."""
    net = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return _with_own_columns(lambda d: score_documents(d, net).filter(F.col("score") >= 0.5), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return deduplicate(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: where each document's ids went."""
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", dedup), ("packing", packing)]

#: SQL cannot express the perplexity model, the classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
