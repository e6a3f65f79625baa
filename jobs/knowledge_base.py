"""Keeps a knowledge base for retrieval up to date with a growing folder of documents.

Each run takes the files that have come since the last one (a file stream with a checkpoint that ends when it has read
them), cleans their texts, cuts them into overlapping chunks, embeds the chunks in batches as an embedding service takes
them, and writes one folder a batch below `target`, partitioned by language:

    target/texts/batch=N/                   the cleaned text of each document that is new or changed
    target/chunks/batch=N/lang=XX/          its chunks with token counts and vectors; an empty language is a null one
    target/entries/batch=N/                 its digest, written last

A document that comes again with the same text is not embedded again; one with another text replaces its earlier
entry. A batch that is repeated after a failure overwrites its own folder, so a run may be repeated at any time.
`current` is the knowledge base as it stands: the chunks of each document's latest entry.

    python -m jobs.knowledge_base --documents DIR --target DIR --checkpoint DIR [--config jobs/knowledge_base.json]
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, configuration, log, read_if_there, watched
from vectrine.functions import embed
from vectrine.functions import text as text_functions
from vectrine.operators import chunking, store
from vectrine.session import session

DEFAULTS = {"chunk_size": 200, "overlap": 50, "dimensions": 64, "digits": 4, "files_per_batch": 1000}
DOCUMENTS = "doc_id long, text string, lang string, source string"
ENTRIES = "doc_id long, lang string, source string, content_md5 string, batch long"
CHUNKS = "doc_id long, chunk_index int, source string, content string, token_count int, embedding array<double>, error string, batch long, lang string"


def new_entries(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lang, source, text, content_md5) of the batch's documents whose text the knowledge base does not hold.

    Rows without an id cannot be found again and rows without text have nothing to find, so both are left out. Of rows
    that repeat an id the one with the greatest digest of its text comes in, whatever order they are read in. known has
    doc_id and content_md5 of the latest entries; it is narrow, and only it meets the batch.
    """
    rows = batch.select("doc_id", "lang", "source", text_functions.clean_whitespace(F.col("text")).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).withColumn("content_md5", F.md5("text"))
    latest = store.distinct_latest(rows.withColumn("order", F.struct("content_md5", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))), "doc_id", "order").drop("order")
    return latest.join(known.select("doc_id", "content_md5"), ["doc_id", "content_md5"], "left_anti")


def chunks_of(entries: DataFrame, config: dict) -> DataFrame:
    """(doc_id, lang, source, chunk_index, content, token_count, embedding, error): each text in windows with overlap,
    embedded at most as many at a time as the embedder takes; vectors are rounded for storage."""
    size, overlap, dimensions, digits = (config[k] for k in ("chunk_size", "overlap", "dimensions", "digits"))
    keyed = entries.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    cut = chunking.by_fixed_size(keyed, size, overlap, id_col="key").where(F.length("content") > 0)
    rows = cut.select(F.struct(*[F.col("key")[c].alias(c) for c in ("doc_id", "lang", "source")], "chunk_index", "content", text_functions.token_estimate(F.col("content")).alias("token_count")).alias("chunk"), "content")

    def vectors(texts: list[str]) -> np.ndarray:
        return embed.vectors_of(texts, dimensions)

    done = embed.embed_batches(rows, vectors, id_col="chunk", text_col="content")
    return done.select("chunk.*", F.transform("embedding", lambda x: F.round(x, digits)).alias("embedding"), "error")


def take(batch: DataFrame, number: int, target: str, config: dict) -> dict[str, int]:
    """Writes the entries and chunks of one batch; what it read and wrote, in rows."""
    spark = batch.sparkSession
    known = read_if_there(spark, f"{target}/entries", ENTRIES).where(F.col("batch") < number)
    fresh = new_entries(batch, store.distinct_latest(known, "doc_id", "batch"))
    at = f"{target}/entries/batch={number}", f"{target}/chunks/batch={number}", f"{target}/texts/batch={number}"
    fresh.write.mode("overwrite").parquet(at[2])  # the new texts once, since both tables are made from them
    texts = spark.read.schema(fresh.schema).parquet(at[2])
    chunks = chunks_of(texts, config)
    # files of even size whatever a language's share; the entries come last, so a batch counts once it is whole
    chunks.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").parquet(at[1])
    texts.select("doc_id", "lang", "source", "content_md5").write.mode("overwrite").parquet(at[0])
    counts = {"documents": batch.count(), "entries": spark.read.schema(ENTRIES).parquet(at[0]).count()}
    out = read_if_there(spark, at[1], CHUNKS).agg(F.count("*").alias("chunks"), F.count("error").alias("errors")).first()
    counts |= {"chunks": out["chunks"], "errors": out["errors"]}
    log.info("batch %d: read %d documents, wrote %d entries to %s and %d chunks (%d not embedded) to %s", number, counts["documents"], counts["entries"], at[0], counts["chunks"], counts["errors"], at[1])
    return counts


def run(spark: SparkSession, documents: str, target: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new in documents and waits until it is written; the sums of what its batches read and wrote."""
    config, target = DEFAULTS | (config or {}), target.rstrip("/")
    total = {"batches": 0, "documents": 0, "entries": 0, "chunks": 0, "errors": 0}
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(watched(documents))

    def each(batch: DataFrame, number: int) -> None:
        for k, v in (take(batch, number, target, config) | {"batches": 1}).items():
            total[k] += v

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %s: %s", documents, total)
    return total


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's latest entry."""
    latest = store.distinct_latest(read_if_there(spark, f"{target}/entries", ENTRIES), "doc_id", "batch").select("doc_id", "batch")
    return read_if_there(spark, f"{target}/chunks", CHUNKS).join(latest, ["doc_id", "batch"], "left_semi")


def main() -> None:
    given = arguments(__doc__.split("\n")[0], {"documents": "folder of Parquet files with doc_id, text, lang and source", "target": "folder of the knowledge base", "checkpoint": "folder of what has been read"})
    spark = session()
    try:
        run(spark, given.documents, given.target, given.checkpoint, configuration(given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
