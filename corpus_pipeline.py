"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  An empty table passes through every stage as an
empty table; null languages and sources are groups of their own.

The tables that the stages return are computed when their caller writes them, so the
stages set the session's number of rows for a Python worker at once to ``BATCH_ROWS``
and leave it at that: documents are wide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import mixing, ngram_join, packing, pii, quality
from panelweave.llm.common import table, written
from panelweave.llm.queries import tokenizer_path


BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Null and empty texts fail the base rules and go; repeated rows are judged each for itself.
    """
    small_batches(spark)
    return quality.quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null ids last, then the smallest text digest).

    Of rows equal in id and text one stays; documents without words all stay.
    """
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; null texts stay null, repeated rows are masked each."""
    small_batches(spark)
    return pii.masked(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words, and so null texts, are never taken."""
    small_batches(spark)
    return mixing.repeat_taken(mixing.mix_sources(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text would be the end token alone, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Packing, the field's spans and the sketches cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
