"""From raw documents to packed training sequences in five stages, each written as Parquet and read again by the next.

Language identification drops the texts it rejects; near-duplicate detection keeps one document of each group;
suffix de-duplication takes repeated passages out of what is left; the secret scan masks what it finds; packing lays
the documents out in sequences.

Texts reach Python workers in batches of at most BATCH_ROWS, where the session has left Spark's default: ten thousand
long texts at once, in the executor and in the worker, are most of what a task of these stages would hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm import language, neardup, packing, secrets, suffixes
from vectrine.llm.common import held_out, tasks_for, written
from vectrine.llm.queries import PACKING_TOKENIZER

#: SQL cannot express compression, sketches or tokenizers; tests compare the stages with brute-force versions.
ORACLE_SQL = None

#: Rows of a batch of texts, and the setting of them with its default.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with small batches for the rows it returns too, which are made after it has returned."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; null, empty and letterless texts go."""
    known = language.train(docs, ~held_out(F.col("doc_id")))
    return language.accepted(docs, known)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id. Rows without an id belong to no group and stay.

    Of rows with the same id and the same text one stays, the smallest by its other columns. An id with several texts
    keeps each of them, as an id cannot tell which of its texts belong to a group.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:  # a struct keeps other columns apart from these names, whatever they are called
        order = F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(c) for c in others])
        rows = rows.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), order).alias("others")).select("doc_id", "text", *[F.col("others")[c].alias(c) for c in others])
    else:
        rows = rows.distinct()
    return rows.unionByName(docs.where("doc_id is null")).select(*docs.columns).coalesce(tasks_for(docs))


@small_batches
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat an earlier one; characters that a cut goes through go, all others stay,
    and documents of which nothing but blanks is left go too. Other columns may have any names."""
    out = suffixes.strip_repeats(docs, carry=tuple(docs.columns)).where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    return _with_text(out.select("kept_text", "carried"), docs)


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns out of (kept_text, carried), with the new text and, where there is an n_chars, its length."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


@small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    masked = secrets.mask_documents(docs)
    return _with_text(masked.select(F.col("text").alias("kept_text"), F.struct(*[masked[c] for c in docs.columns]).alias("carried")), docs)


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(PACKING_TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
