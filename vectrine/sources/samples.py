"""Small literal tables for trials: documents with metadata, queries with judgements, benchmark sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCUMENTS = (
    (0, "Spark plans a query as a tree of operators and runs it in stages.", "engine"),
    (1, "A shuffle moves rows so that equal keys meet in one task.", "engine"),
    (2, "Columnar files are read faster where few columns are asked for.", "storage"),
    (3, "Filters that reach the scan spare most of the reading.", "storage"),
    (4, "Vectors of similar texts point in similar directions.", "retrieval"),
    (5, "An inverted list holds the vectors nearest to one centroid.", "retrieval"),
    (6, "Term weights fall with the number of documents that hold the term.", "retrieval"),
    (7, "A watermark tells how late an event may come and still count.", "streams"),
    (8, "State is kept for each key between the batches of a stream.", "streams"),
    (9, "A checkpoint cuts the lineage of a long chain of steps.", "engine"),
)
_QUERIES = ((0, "how do rows with equal keys meet", (1,), "easy"), (1, "reading columnar files fast", (2, 3), "medium"), (2, "nearest vectors in lists", (4, 5), "medium"), (3, "late events in a stream", (7, 8), "hard"), (4, "what makes a rare term weigh more", (6,), "easy"), (5, "steps and stages of a long plan", (0, 9), "hard"))
_COMPARED = (
    "Bread rises because yeast turns sugar into gas.",
    "A sourdough starter holds wild yeast and needs feeding.",
    "Kneading builds the gluten that holds the gas in.",
    "Whole-grain flour takes up more water than white flour.",
    "A hot stone gives the loaf a firm crust.",
    "Steam in the oven keeps the crust soft at first.",
    "Salt slows the yeast and sharpens the taste.",
    "Tomatoes need sun and even watering.",
    "Compost feeds the soil in spring.",
    "Slugs come out on damp evenings.",
    "A raised bed warms up early in the year.",
    "Mulch keeps the ground moist in summer.",
    "Trams run on rails in the street.",
    "A night bus replaces the underground after midnight.",
    "Cyclists may use the lane against the traffic here.",
    "Tickets are cheaper when bought before the ride.",
    "The ferry crosses the river every twenty minutes.",
)


def documents(spark: SparkSession, n: int = 10, category: str | None = None) -> DataFrame:
    """(doc_id, text, category, score): the first n of ten documents at most, scores falling with the place."""
    rows = [(i, t, c, 1.0 - 0.05 * i) for i, t, c in _DOCUMENTS if category in (None, c)]
    return spark.createDataFrame(rows[:n], "doc_id long, text string, category string, score double")


def evaluation(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries (query_id, text, difficulty) and judgements (query_id, doc_id, rel)."""
    queries = spark.createDataFrame([(i, t, d) for i, t, _, d in _QUERIES], "query_id long, text string, difficulty string")
    qrels = spark.createDataFrame([(i, x, 1) for i, _, rel, _ in _QUERIES for x in rel], "query_id long, doc_id long, rel long")
    return documents(spark), queries, qrels


def benchmark_sets(spark: SparkSession, n_documents: int, n_queries: int) -> DataFrame:
    """(query_id, query, doc_id, text, relevant): for each query as many documents, every other one off the subject."""
    q = spark.range(n_queries).select(F.col("id").alias("query_id"), F.concat(F.lit("query "), F.col("id") + 1).alias("query"))
    d = q.withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n_documents - 1)))).withColumn("relevant", F.col("doc_id") % 2 == 0)
    return d.withColumn("text", F.concat(F.when(F.col("relevant"), F.lit("About ")).otherwise(F.lit("Not about ")), "query", F.lit(", part "), F.col("doc_id") + 1))


def comparison(spark: SparkSession) -> DataFrame:
    """(doc_id, text): seventeen fixed documents on three subjects, to compare rankings on."""
    return spark.createDataFrame(list(enumerate(_COMPARED)), "doc_id long, text string")
