"""Tables that grow: appends with ids, upserts, incremental merges, logs and counters derived from logs.

Counters are never updated in place: events are appended and counted when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.session import written


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()
_V, _TAGS = T.ArrayType(_D), T.ArrayType(_S)
#: Declared tables of the applications; JSON text columns have the type they decode to.
SCHEMAS: dict[str, T.StructType] = {
    "knowledge_entries": _table(("id", _L), ("title", _S), ("content", _S), ("category", _S), ("tags", _TAGS), ("embedding", _V), ("created_at", _TS), ("updated_at", _TS), ("version", _L)),
    "knowledge_relationships": _table(("id", _L), ("source_id", _L), ("target_id", _L), ("relationship_type", _S), ("confidence", _D), ("created_at", _TS)),
    "query_history": _table(("id", _L), ("query", _S), ("response", _S), ("relevance_score", _D), ("query_time", _TS)),
    "qa_knowledge": _table(("id", _L), ("question", _S), ("answer", _S), ("category", _S), ("tags", _TAGS), ("embedding", _V), ("confidence", _D), ("created_at", _TS), ("updated_at", _TS), ("usage_count", _L)),
    "conversation_history": _table(("id", _L), ("session_id", _S), ("user_question", _S), ("system_answer", _S), ("confidence", _D), ("timestamp", _TS)),
    "user_feedback": _table(("id", _L), ("qa_id", _L), ("feedback_type", _S), ("feedback_text", _S), ("timestamp", _TS)),
    "content_items": _table(("id", _S), ("title", _S), ("content", _S), ("category", _S), ("tags", _TAGS), ("embedding", _V), ("created_at", _TS)),
    "users": _table(("user_id", _S), ("preferences", T.MapType(_S, _D)), ("embedding", _V), ("created_at", _TS)),
    "user_behaviors": _table(("id", _L), ("user_id", _S), ("content_id", _S), ("behavior_type", _S), ("score", _D), ("timestamp", _TS)),
    "recommendations": _table(("id", _L), ("user_id", _S), ("content_id", _S), ("recommendation_type", _S), ("score", _D), ("timestamp", _TS)),
    "search_documents": _table(("id", _S), ("title", _S), ("content", _S), ("category", _S), ("tags", _TAGS), ("url", _S), ("embedding", _V), ("created_at", _TS), ("view_count", _L)),
    "search_history": _table(("id", _L), ("query", _S), ("user_id", _S), ("results_count", _L), ("timestamp", _TS)),
    "search_analytics": _table(("id", _L), ("query", _S), ("clicked_doc_id", _S), ("position", _L), ("timestamp", _TS)),
    "analyzed_documents": _table(("id", _S), ("filename", _S), ("file_path", _S), ("file_type", _S), ("size", _L), ("content", _S), ("category", _S), ("keywords", _TAGS), ("summary", _S), ("embedding", _V), ("created_at", _TS)),
    "document_categories": _table(("id", _L), ("category_name", _S), ("description", _S), ("created_at", _TS)),
    "document_similarity": _table(("id", _L), ("doc1_id", _S), ("doc2_id", _S), ("similarity_score", _D), ("created_at", _TS)),
    "analysis_results": _table(("id", _L), ("doc_id", _S), ("analysis_type", _S), ("result_data", _S), ("timestamp", _TS)),
    "user_actions": _table(("id", _L), ("user_id", _S), ("item_id", _S), ("action_type", _S), ("score", _D), ("timestamp", _TS), ("context", T.MapType(_S, _S))),
    "realtime_recommendations": _table(("id", _L), ("user_id", _S), ("item_id", _S), ("score", _D), ("reason", _S), ("timestamp", _TS), ("real_time", _B)),
    "ab_test_results": _table(("id", _L), ("user_id", _S), ("test_group", _S), ("recommendation_id", _S), ("clicked", _B), ("timestamp", _TS)),
    "performance_metrics": _table(("id", _L), ("metric_name", _S), ("value", _D), ("timestamp", _TS)),
    "embedded_documents": _table(("id", _L), ("text", _S), ("embedding", _V), ("metadata", T.MapType(_S, _S)), ("created_at", _TS)),
}


def with_ids(rows: DataFrame, after: int = 0, id_col: str = "id") -> DataFrame:
    """rows with ids from after + 1 on, without a gap, in two passes: counts by partition, then places within it.

    The rows are written with their places first, so a lost executor or another layout of tasks cannot move an id.
    """
    parts = written(rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ids")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_lo"))
    before = {r["_p"]: (r["_n"], r["_lo"]) for r in counts.collect()}  # a row for each partition
    at, start = after, {}
    for p in sorted(before):
        start[p] = at + 1 - before[p][1]
        at += before[p][0]
    if not start:
        return rows.withColumn(id_col, F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)])
    return parts.withColumn(id_col, F.col("_m") + offset[F.col("_p")]).drop("_p", "_m")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """new rows replace old ones of their key; both must have the same columns. Of new rows that repeat a key the
    largest by the JSON text of its other columns comes in, whatever the order they are read in."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return old.join(once, keys, "left_anti").unionByName(once)


def incremental_merge(old: DataFrame, new: DataFrame, keys: tuple[str, str] = ("title", "content"), updated: tuple[str, ...] = ("category",)) -> DataFrame:
    """A full join on the keys: matched rows take the new values and version + 1, unmatched old ones stay, unmatched
    new ones come in at version 1. old has keys, updated columns and version."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in updated], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, list(keys), "full")
    matched = F.col("_new").isNotNull()
    version = F.when(F.col("_old").isNull(), F.lit(1)).when(matched, F.col("version") + 1).otherwise(F.col("version")).cast("long")
    return both.select(*keys, *[F.when(matched, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in updated], version.alias("version"))


def with_counts(items: DataFrame, log: DataFrame, item_key: str, log_key: str, name: str) -> DataFrame:
    """items with the number of log rows of each; in place of counter updates."""
    counts = log.groupBy(F.col(log_key).alias(item_key)).agg(F.count("*").alias(name))
    return items.join(counts, item_key, "left").fillna(0, [name])


def query_log(results: DataFrame, query: Column, at: Column) -> DataFrame:
    """One row of a query's results: the query, the JSON response and the top score. results is a top-k report."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), *[c for c in results.columns if c != "score"], "score")))
    row = results.agg(F.to_json(F.transform(ordered, lambda x: x.dropFields("_o"))).alias("response"), F.max("score").alias("relevance_score"))
    return row.select(query.alias("query"), "response", "relevance_score", at.alias("query_time"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """For derived tables that are rebuilt, such as edges; path must not be one df reads."""
    df.write.mode("overwrite").parquet(path)


def distinct_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def reads_back(df: DataFrame, path: str) -> DataFrame:
    """Writes an index and reads it again; Parquet keeps vectors and metadata as they are."""
    overwrite(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
