"""BM25 where only each query's best leave a task: the same rows as by all scores, and few of them."""

import pytest
from pyspark.sql import functions as F

from vectrine.functions import embed
from vectrine.operators import sparse
from vectrine.plans import catalog_text

TEXTS = [(i, f"a{i % 7} b{i % 3} a1 a1 检索 c{i}") for i in range(60)]
ASKED = [(0, "a1 b2 检"), (1, "b0 nothing"), (2, "nothing"), (3, None), (4, "c5 c5 a3"), (5, "a1")]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def plain(index, q, k):
    """By the join of postings, all scores ranked."""
    return rows(sparse.ranked(sparse._joined(index, q, 1.5, 0.75, "query_id", "text"), k))


@pytest.mark.parametrize("k", [1, 4, 100])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_by_terms_equal_all_scores_ranked(spark, monkeypatch, k, kind):
    monkeypatch.setattr(sparse, "CELLS", 20)  # a few documents at once
    monkeypatch.setattr(sparse, "PRODUCTS", 5)
    monkeypatch.setattr(sparse, "HELD", 7)
    df = spark.createDataFrame([*TEXTS, (90, None), (91, ""), (92, "a1")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    q = spark.createDataFrame(ASKED, "query_id long, text string")
    index = sparse.build_index(df)
    want = plain(index, q, k)
    assert rows(sparse.bm25_best(index, q, k)) == want and len({r[0] for r in want}) == 4
    assert rows(sparse.bm25_best(sparse.build_index(df, only=sparse.query_terms(q)), q, k)) == want
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
    assert rows(sparse.bm25_best(sparse.build_index(df, only=sparse.query_terms(q)), q, k)) == want


def test_best_by_terms_sum_rows_of_one_id(spark):
    df = spark.createDataFrame([*TEXTS, *TEXTS[:5], (None, "a1 c5"), (None, "b0 a3"), (70, "a1 c5")], "doc_id long, text string")
    q = spark.createDataFrame(ASKED, "query_id long, text string")
    index = sparse.build_index(df)
    key = lambda x: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in x.collect()}
    assert key(sparse.bm25_best(index, q, 6)) == key(sparse.ranked(sparse._joined(index, q, 1.5, 0.75, "query_id", "text"), 6))
    pairs = sparse.bm25(index, q)
    assert pairs.count() == pairs.select("query_id", "doc_id").distinct().count()


def test_best_by_terms_of_nothing(spark):
    df, q = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    assert sparse.bm25_best(sparse.build_index(df.limit(0)), q, 3).count() == 0
    assert sparse.bm25_best(sparse.build_index(df), q.limit(0), 3).count() == 0


def test_equal_scores_go_to_the_smaller_ids_whatever_the_batch(spark):
    df = spark.range(3000, -1, -1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "x y").otherwise("y x").alias("text")).coalesce(1)
    q = spark.createDataFrame([(1, "x y z")], "query_id long, text string")
    assert [r["doc_id"] for r in sparse.bm25_best(sparse.build_index(df), q, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_few_rows_leave_a_task(spark):
    """A row for each query and document was made, shuffled and sorted."""
    df = spark.createDataFrame([(i, f"the of w{i % 50}") for i in range(4000)], "doc_id long, text string").coalesce(2)
    q = spark.createDataFrame([(i, f"the of w{i}") for i in range(20)], "query_id long, text string")
    index = sparse.build_index(df)
    asked, again = sparse._asked(index, q, "query_id", "text")
    tasks = index.forward.rdd.getNumPartitions()
    assert again is None and sparse._scored(index.forward, asked, "long", 5, 1.5, 0.75).count() <= tasks * 20 * 5
    assert sparse.bm25(index, q).count() == 20 * 4000


def test_the_registered_searches_make_no_row_a_pair(spark, sf):
    for name in ("bm25_topk", "hybrid_rrf", "hybrid_merge"):
        plan = getattr(catalog_text, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "inline(" not in plan and "MapInArrow" in plan, name


def test_an_index_of_asked_terms_counts_the_others_in_the_length(spark):
    df = spark.createDataFrame([(1, "a b c c"), (2, "d")], "doc_id long, text string")
    only = spark.createDataFrame([("c",), ("zz",)], "term string")
    got = {r["doc_id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in sparse.build_index(df, only=only).forward.collect()}
    assert got == {1: (4, [("c", 2)]), 2: (1, [])}

def test_terms_are_hashed_once_a_batch(spark, monkeypatch):
    """Each slice of 256 rows hashed its own terms again."""
    monkeypatch.setattr(embed, "TERMS_AT_ONCE", 7)
    df = spark.createDataFrame([(i, f"w{i} word 检索 w{i}") for i in range(600)], "doc_id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embed.embed_terms(sparse.build_index(df).forward, 8).collect()}
    want = embed.vectors_of([f"w{i} word 检索 w{i}" for i in range(600)], 8)
    assert len(got) == 600 and all(max(abs(got[i] - want[i])) < 1e-12 for i in range(600))


def test_an_index_with_vectors_embeds_by_all_terms(spark):
    df = spark.createDataFrame([*((i, f"w{i} word 检索 w{i}") for i in range(600)), (600, None), (601, "!")], "doc_id long, text string").coalesce(1)
    only = spark.createDataFrame([("word",)], "term string")
    index = sparse.build_index(df, only=only, dimensions=8)
    got = {r["id"]: r["embedding"] for r in index.vectors.collect()}
    want = {r["id"]: r["embedding"] for r in embed.embed_table(df, "doc_id", "text", 8).collect()}
    assert got.keys() == want.keys() == set(range(600)) and all(max(abs(a - b) for a, b in zip(got[i], want[i], strict=True)) < 1e-12 for i in want)
    assert index.postings.count() == 600
