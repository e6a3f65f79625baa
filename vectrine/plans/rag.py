"""Retrieval-augmented answers: ingest, retrieve, assemble a prompt, answer from what was found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import embed
from vectrine.functions import text as T
from vectrine.functions import vectors as V
from vectrine.operators import chunking, search
from vectrine.session import written

#: Characters of context a prompt holds at most, and what stands between sources.
MAX_CONTEXT, BETWEEN = 3000, "\n\n---\n\n"
REFUSAL = "The material at hand does not answer this question."
INSTRUCTIONS = "Answer the question from the sources only, name the ones you use, and say so if they do not answer it."


def source_part(source: Column, section: Column, content: Column) -> Column:
    """A source tag line, then the content."""
    tag = F.concat(F.lit("[来源: "), F.coalesce(source, F.lit("未知来源")), F.when(F.length(section) > 0, F.concat(F.lit(", "), section)).otherwise(F.lit("")), F.lit("]"))
    return F.concat(tag, F.lit("\n"), content)


def assemble(found: DataFrame, most: int = MAX_CONTEXT) -> DataFrame:
    """(query_id, context, n_sources) of (query_id, doc_id, source, section, content, score).

    Parts are taken by score while their lengths still fit; the first that does not fit ends the context. found is a
    top-k result, so a query's rows are few.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    rows = found.withColumn("part", source_part(F.col("source"), F.col("section"), F.col("content"))).withColumn("r", F.row_number().over(order))
    total = F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.withColumn("total", total).where(F.col("total") <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", "part"))), lambda x: x["part"])
    return fits.groupBy("query_id").agg(F.array_join(parts, BETWEEN).alias("context"), F.count("*").alias("n_sources"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(INSTRUCTIONS + "\n\n"), context, F.lit("\n\nQuestion: "), question)


def extract_answer(context: Column, question: Column) -> Column:
    """The default generator, in place of a language model: the first content line of the best source."""
    return F.coalesce(F.try_element_at(F.split(context, "\n"), F.lit(2)), F.lit(REFUSAL))


@dataclass
class Pipeline:
    """Chunks, embeds and searches documents; embed and generate are Column functions and may be pandas UDFs."""

    chunk_size: int = 300
    overlap: int = 50
    dimensions: int = 64
    top_k: int = 3
    embed: Callable[[Column, int], Column] = embed.hashed_in_batches
    generate: Callable[[Column, Column], Column] = extract_answer

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """(chunk_id, doc_id, chunk_index, source, content, embedding); chunks of 10 characters or less go."""
        chunks = chunking.by_recursion(docs, self.chunk_size, self.overlap, chunking.RAG_SEPARATORS, least=10, id_col=id_col, text_col=text_col)
        named = chunks.join(docs.select(id_col, F.col(source_col).alias("source")), id_col)
        key = F.xxhash64(F.col(id_col), F.col("chunk_index"))
        return named.select(key.alias("chunk_id"), F.col(id_col).alias("doc_id"), "chunk_index", "source", "content").withColumn("embedding", self.embed(F.col("content"), self.dimensions))

    def retrieve(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        """The top_k chunks of each (query_id, question), with 1 / (1 + squared L2) scores."""
        index = written(index, "index")  # searched, then asked for what was found; chunks are cut and embedded once
        q = queries.select(F.col("query_id").alias("chunk_id"), self.embed(F.col("question"), self.dimensions).alias("embedding"))
        near = search.knn(q, index, self.top_k, "squared_l2", exclude_self=False, id_col="chunk_id")
        found = written(near.select("query_id", F.col("vec_id").alias("chunk_id"), "score"), "found")  # of known size, so chunks need not move
        return found.join(index.drop("embedding"), "chunk_id")

    def answer(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, question, answer, prompt, n_sources); a blank question or an empty index gives the refusal."""
        found = self.retrieve(index, queries.where(F.length(F.trim("question")) > 0)).withColumn("section", F.lit(""))
        context = assemble(found)
        rows = queries.join(context, "query_id", "left").fillna(0, ["n_sources"])
        empty = F.col("context").isNull()
        return rows.select("query_id", "question", F.when(empty, F.lit(REFUSAL)).otherwise(self.generate(F.col("context"), F.col("question"))).alias("answer"), F.when(empty, F.lit("")).otherwise(prompt(F.col("context"), F.col("question"))).alias("prompt"), "n_sources")


def threshold_answers(found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(query_id, answer_id, confidence, answered) of ranked (query_id, doc_id, score, rank): the best row where it
    reaches the threshold, a refusal elsewhere."""
    best = found.where("rank = 1")
    ok = F.col("score") >= threshold
    return best.select("query_id", F.when(ok, F.col("doc_id")).alias("answer_id"), F.round("score", 6).alias("confidence"), ok.alias("answered"))


def engine_search(df: DataFrame, query: str, query_vector: list[float], k: int = 10, title_col: str = "title", content_col: str = "content", id_col: str = "id", vector_weight: float = 0.7, keyword_weight: float = 0.3, where: Column | None = None) -> DataFrame:
    """(…, score, highlights, preview): 0.7 cosine + 0.3 keywords, highlights and a preview of the k best only."""
    rows = df if where is None else df.where(where)
    q = F.lit(query)
    score = vector_weight * V.cosine(F.col("embedding"), V.literal(query_vector)) + keyword_weight * T.keyword_score(q, F.col(title_col), F.col(content_col))
    top = rows.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("highlights", T.highlights(q, F.col(title_col), F.col(content_col))).withColumn("preview", T.preview(F.col(content_col)))


def answers_with_sources(found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(query_id, answer, confidence, answered, sources) of ranked (query_id, doc_id, source, text, score, rank): the
    best row's text where it reaches the threshold, else the refusal; all rows' sources by rank either way.

    found is a top-k result, so a query's rows are few. A query without rows is not in it and gets no answer.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "source")))
    out = found.groupBy("query_id").agg(F.max("score").alias("confidence"), F.min_by("text", "rank").alias("best"), F.transform(rows, lambda x: x["source"]).alias("sources"))
    ok = F.col("confidence") >= threshold
    return out.select("query_id", F.when(ok, F.col("best")).otherwise(F.lit(REFUSAL)).alias("answer"), "confidence", ok.alias("answered"), "sources")
