"""Steps whose rows grow with their input and no faster, against plain results."""

import re

import numpy as np
from pyspark.sql import functions as F

from vectrine.functions import embed
from vectrine.functions import text as T
from vectrine.operators import analytics, evaluation, recommend, sparse
from vectrine.streaming import recommender


def plan(df):
    return df._jdf.queryExecution().toString()


def test_class_judgements_equal_pairs(spark):
    """Labels judge as the rows of all pairs do, and the best are never sorted."""
    labels = {i: i % 4 if i else None for i in range(24)} | {20: 9}
    df = spark.createDataFrame(list(labels.items()), "id long, label int")
    asked, docs = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("a")), df.select(F.col("id").alias("doc_id"), F.col("label").alias("b"))
    grades = spark.createDataFrame([(a, b, 3 - abs(a - b)) for a in (0, 1, 2, 3, 9) for b in range(-2, 13) if abs(a - b) <= 2], "a int, b int, rel int")
    by_class = evaluation.ClassJudgements(asked, docs, grades)
    pairs = asked.join(grades, "a").join(docs, "b").where("query_id <> doc_id").select("query_id", "doc_id", "rel")
    run = spark.createDataFrame([(q, d, r) for q in range(0, 24, 5) for r, d in enumerate([x for x in range(3, 24, 2) if x != q][:10], 1)], "query_id long, doc_id long, rank int")
    queries = asked.select("query_id")
    rows = lambda x: sorted(tuple(round(v, 9) for v in r) for r in x.collect())
    for k in (1, 10):
        assert rows(evaluation.ndcg(run, by_class, queries, k)) == rows(evaluation.ndcg(run, pairs, queries, k))
    assert rows(evaluation.per_query(run, by_class, queries)) == rows(evaluation.per_query(run, pairs, queries))
    assert rows(evaluation.binary_metrics(run, by_class, queries)) == rows(evaluation.binary_metrics(run, pairs, queries))
    assert not re.search(r"row_number|\[a#\d+\], \[b#", plan(evaluation.ndcg(run, by_class, queries, 10)))


def test_what_was_seen_leaves_no_list_longer(spark, monkeypatch):
    """A user that has seen sixty of eighty items made every list as long; now no more than the limit is asked for."""
    rng = np.random.default_rng(2)
    x, u = rng.normal(0, 1, (80, 4)), rng.normal(0, 1, (7, 4))
    seen = [(user, int(i)) for user in range(6) for i in rng.permutation(80)[: user * 12]]
    asked = []
    from vectrine.operators import search

    best = search._block_best
    monkeypatch.setattr(search, "_block_best", lambda q, v, grid, k, *a, **h: asked.append(k) or best(q, v, grid, k, *a, **h))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    found = recommend.content_based(frame([(i, v.tolist()) for i, v in enumerate(u)], "user_id long, embedding array<double>"), frame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>"), spark.createDataFrame(seen + seen[:5], "user_id long, item_id long"), 5)
    got = {}
    for r in found.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    cos = (u @ x.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    left_out = set(seen)
    assert got == {k: [int(i) for i in np.argsort(-cos[k]) if (k, int(i)) not in left_out][:5] for k in range(7)} and asked == [5]


def test_user_vectors_are_not_unfolded(spark):
    b = spark.createDataFrame([(k, k % 3, k % 5, float(k % 4 - 1), k) for k in range(60)], "event_id long, user_id long, item_id long, score double, ts long")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, embedding array<float>")
    out = recommend.user_vectors(b, items, 6)
    want = {}
    for user in range(3):
        rows = [(k % 4 - 1, [k % 5, 1.0]) for k in sorted((k for k in range(60) if k % 3 == user), reverse=True)[:6]]
        n = sum(w for w, _ in rows)
        want[user] = [sum(w * v[d] for w, v in rows) / n if n > 0 else 0.0 for d in (0, 1)]
    got = {r["user_id"]: r["embedding"] for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and "posexplode" not in plan(out).lower()


def test_keywords_are_counted_within_rows(spark):
    texts = [(0, "b a b a c the The zz x"), (1, None), (2, ""), (3, "Straße straße école")]
    out = analytics.keywords(spark.createDataFrame(texts, "doc_id long, text string"), 3, least=1, stop=("the",))
    assert [tuple(r) for r in out.orderBy("doc_id", "rank").collect()] == [(0, "b", 2, 1), (0, "a", 2, 2), (0, "c", 1, 3), (3, "straße", 2, 1), (3, "école", 1, 2)]
    assert "Exchange" not in plan(out)


def test_terms_are_embedded_in_slices(spark):
    """A batch of ten thousand long texts became Python strings all at once; slices give the same, past their edges too."""
    df = spark.createDataFrame([(i, f"w{i} word w{i}") for i in range(600)], "doc_id long, text string").coalesce(1)
    rows = {r["id"]: r["embedding"] for r in embed.embed_terms(sparse.build_index(df).forward, 8).collect()}
    assert embed.ROWS_AT_ONCE <= 256 and len(rows) == 600
    assert all(np.allclose(rows[i], embed.vectors_of([f"w{i} word w{i}"], 8)[0]) for i in (5, 255, 256, 599))


def test_batched_embedding_equals_the_fold(spark):
    df = spark.createDataFrame([("the Of 数据 the",), ("",), (None,), ("a_1 b",)], "t string")
    for r in df.select(embed.hashed_in_batches(F.col("t"), 8).alias("a"), embed.hashed_embedding(F.col("t"), 8).alias("b"), T.word_tokens(F.col("t")).alias("w")).collect():
        assert (r["a"] is None and r["b"] is None) or np.allclose(r["a"], r["b"])


def test_an_item_start_is_drawn_once():
    recommender._item_start.cache_clear()
    assert np.array_equal(recommender._item_start(7, 50), recommender.initial_vector(7, 2, 50))
    recommender._item_start(7, 50)
    assert recommender._item_start.cache_info().hits == 1
