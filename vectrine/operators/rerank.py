"""Re-ranking of candidates for each query: strategies, rank changes, response clean-up, costs and a keyed cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import text as T
from vectrine.functions import vectors as V

#: Candidates that a re-ranker gets at most.
MAX_DOCUMENTS = 100


def place(df: DataFrame, by: str, name: str, query_col: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """df with the 0-based place of each row by a score, ids ascending among equals."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc(F.round(by, 9)), id_col)) - 1)


def lexical_scorer(query: Column, text: Column) -> Column:
    """The default scorer: overlap of words, in place of a remote cross-encoder. Pass a pandas_udf for a model."""
    return T.overlap(query, text)


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, top_n: int | None = None, most: int = MAX_DOCUMENTS) -> DataFrame:
    """(…, original_rank, relevance_score, new_rank, rank_change) of (query_id, query, doc_id, text, score).

    The first `most` candidates of each query by score are scored anew; scores are held within 0 and 1, missing ones
    are 0.5. Ranks count from 0; rank_change is original minus new.
    """
    first = place(candidates, "score", "original_rank").where(F.col("original_rank") < most)
    scored = first.withColumn("relevance_score", clamp_score(scorer(F.col("query"), F.col("text"))))
    out = place(scored, "relevance_score", "new_rank").withColumn("rank_change", F.col("original_rank") - F.col("new_rank"))
    return out if top_n is None else out.where(F.col("new_rank") < top_n)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.5))))


def apply_response(documents: DataFrame, response: DataFrame) -> DataFrame:
    """Joins a scorer's answers (query_id, index, relevance_score) to (query_id, index, doc_id); answers for unknown
    indexes go. A query without any valid answer keeps its order, at 0.5."""
    joined = documents.join(response, ["query_id", "index"], "left")
    answered = F.max(F.col("relevance_score").isNotNull()).over(Window.partitionBy("query_id"))
    kept = joined.withColumn("_any", answered).where(~F.col("_any") | F.col("relevance_score").isNotNull())
    kept = kept.withColumn("relevance_score", clamp_score(F.col("relevance_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "index")
    return kept.withColumn("new_rank", F.row_number().over(order) - 1).withColumn("rank_change", F.col("index") - F.col("new_rank")).drop("_any")


def hybrid(candidates: DataFrame, embedding_weight: float = 0.3, rerank_weight: float = 0.7) -> DataFrame:
    """(…, final_score, embedding_rank, rerank_rank, rank_change) of (query_id, doc_id, cosine, rerank_score).

    A row without a re-rank score counts 0 there; a query without any is ranked by its embedding alone. rank_change
    is the embedding's place minus the re-ranker's.
    """
    unit = V.unit_interval(F.col("cosine"))
    has = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id"))
    out = candidates.withColumn("_has", has)
    out = out.withColumn("final_score", F.when(F.col("_has"), embedding_weight * unit + rerank_weight * F.coalesce("rerank_score", F.lit(0.0))).otherwise(unit))
    out = place(out.withColumn("_r", F.coalesce("rerank_score", F.lit(0.0))), "cosine", "embedding_rank")
    out = place(out, "_r", "rerank_rank")
    return place(out, "final_score", "final_rank").withColumn("rank_change", F.col("embedding_rank") - F.col("rerank_rank")).drop("_has", "_r")


def by_strategy(candidates: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """embedding, rerank or hybrid ranking of (query_id, doc_id, cosine, rerank_score), as final_rank."""
    if strategy == "embedding":
        return place(candidates, "cosine", "final_rank")
    if strategy == "rerank":
        return place(candidates.withColumn("rerank_score", clamp_score(F.col("rerank_score"))), "rerank_score", "final_rank")
    if strategy == "hybrid":
        return hybrid(candidates)
    raise ValueError(f"no strategy {strategy!r}")


def cost(n_documents: Column, tokens: int = 200, price_per_thousand: float = 0.0008) -> Column:
    return n_documents * tokens / 1000 * price_per_thousand


def cache_key(query: Column, documents: Column, strategy: str, top_n: int | None = None) -> Column:
    """The strategy is part of the key, so two strategies never share an answer."""
    return F.md5(F.concat_ws("\x1f", query, F.array_join(documents, "\x1e"), F.lit(strategy), F.lit(str(top_n))))


def cache_get(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests by key among cache rows that have not expired."""
    alive = cache.where(F.col("expires_at") > now)
    return requests.join(alive, "key"), requests.join(alive, "key", "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """The cache without expired and replaced rows, with the fresh ones."""
    kept = cache.where(F.col("expires_at") > now).join(fresh, "key", "left_anti")
    return kept.unionByName(fresh.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds))))


def all_strategies(candidates: DataFrame) -> DataFrame:
    """(method, query_id, doc_id, rank from 1) of the same candidates by each strategy."""
    one = lambda s: by_strategy(candidates, s).select(F.lit(s).alias("method"), "query_id", "doc_id", (F.col("final_rank") + 1).alias("rank"))
    return one("embedding").unionByName(one("rerank")).unionByName(one("hybrid"))


def ranked_with_cache(requests: DataFrame, candidates: DataFrame, cache: DataFrame, now: Column, strategy: str = "hybrid", most: int = MAX_DOCUMENTS, ttl_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): (query_id, key, ranking array<doc_id>, cached) of (query_id, query), and the cache with new ones.

    The first `most` candidates of a query by cosine are ranked. Its key is made of the query, those candidates and the
    strategy, so neither another strategy nor another list shares an answer; only missing keys are ranked.
    """
    first = place(candidates, "cosine", "_p").where(F.col("_p") < most)
    lists = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("docs"))
    asked = requests.join(lists, "query_id").withColumn("key", cache_key(F.col("query"), F.col("docs"), strategy))
    hits, misses = cache_get(asked, cache, now)
    fresh = by_strategy(first.drop("_p").join(misses.select("query_id"), "query_id", "left_semi"), strategy)
    ranking = fresh.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranking"))
    new = misses.join(ranking, "query_id")
    answers = hits.select("query_id", "key", "ranking", F.lit(True).alias("cached")).unionByName(new.select("query_id", "key", "ranking", F.lit(False).alias("cached")))
    return answers, cache_put(cache, new.groupBy("key").agg(F.first("ranking").alias("ranking")), now, ttl_seconds)
