"""Operators on hand-made inputs: golden values, edge cases and properties."""

import inspect
import math
import os
import random
import subprocess
import sys
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine import catalog
from vectrine.functions import embed
from vectrine.functions import text as T
from vectrine.functions import vectors as V
from vectrine.operators import analytics, chunking, evaluation, hierarchy, learn, network, projection, recommend, rerank, search, sparse, store, temporal
from vectrine.plans import rag
from vectrine.session import EngineConfig, scratch, written
from vectrine.sources import files, pdf, samples
from vectrine.streaming import expiry, metrics, online, recommender


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def col(x):
    return F.lit(x)


# --- vectors


def test_zero_and_empty_vectors(spark):
    z, a, e = V.literal([0, 0]), V.literal([3, 4]), F.array().cast("array<double>")
    r = one(spark, V.cosine(z, a).alias("c"), V.cosine(e, e).alias("e"), V.normalize(z).alias("n"), V.cosine_or_nan(z, a).alias("x"), V.cosine_smoothed(z, a).alias("s"), V.norm(a).alias("l"), V.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), V.mean(e).alias("m"))
    assert (r["c"], r["e"], r["n"], r["s"], r["l"], r["j"], r["m"]) == (0.0, 0.0, [0.0, 0.0], 0.0, 5.0, 0.0, None)
    assert math.isnan(r["x"])


def test_quality_checks(spark):
    good, bad = V.literal([1, 0]), F.array(F.lit(float("nan")), F.lit(5.0))
    r = one(spark, V.quality_checks(good, 2)["valid"].alias("a"), V.quality_checks(bad, 2)["valid"].alias("b"), V.quality_checks(good, 3)["right_dim"].alias("c"))
    assert (r["a"], r["b"], r["c"]) == (True, False, False)


# --- texts


def test_tokens_of_mixed_scripts(spark):
    r = one(spark, T.word_tokens(col("RAG 检索增强 v2_x")).alias("t"), T.token_estimate(col("检索增强abcd")).alias("n"))
    assert r["t"] == ["rag", "v2_x", "检索", "索增", "增强", "检", "索", "增", "强"]
    assert r["n"] == int(4 / 1.5 + 4 / 4)


def test_languages_and_rules(spark):
    r = one(spark, *[T.detect_language(col(x)).alias(k) for k, x in {"a": "日本語です", "b": "ひらがな", "c": "한국어", "d": "Hello", "e": "123"}.items()], T.classify_by_rules(col("企业管理和市场战略")).alias("f"), T.classify_by_rules(col("nothing")).alias("g"), T.classify_by_rules(col("nothing"), fallback="其他").alias("h"), T.normalize_for_language(col("Hello, World 1!"), col("en")).alias("i"))
    assert list(r)[:5] == ["zh", "ja", "ko", "en", "unknown"]
    assert (r["f"], r["g"], r["h"], r["i"]) == ("商业", "技术", "其他", "hello world")


def test_cleaning(spark):
    r = one(spark, T.clean_markup(col("<b>Hé</b>, you&me  x")).alias("a"), T.clean_whitespace(col("a\n\n\n\nb  c\t d ")).alias("b"), T.preview(col("abcdef"), 3).alias("c"))
    assert list(r) == ["Hé you me x", "a\n\nb c d", "abc..."]


def test_highlights_and_scores(spark):
    title, content, q = col("Deep learning basics"), col("An intro to deep nets. Deep deep learning."), col("deep")
    r = one(spark, T.highlights(q, title, content).alias("h"), T.keyword_score(q, title, content).alias("s"), T.keyword_score(col(" "), title, content).alias("z"))
    assert r["h"][0] == "Deep learning "[:14] and len(r["h"]) == 3 and all("eep" in x for x in r["h"])
    assert (r["s"], r["z"]) == (1.0, 0.0)


def test_summary_stops_at_the_first_that_does_not_fit(spark):
    r = one(spark, T.summarize(col("One. Two! " + "x" * 300 + ". Four.")).alias("a"), T.summarize(col("")).alias("b"), T.summarize(col("y" * 250)).alias("c"))
    assert r["a"] == "One。Two。" and r["b"] == "" and r["c"] == "y" * 200 + "..."


def test_embedding_forms_agree(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma 检索"), (3, "")], "id long, text string")
    table = {r["id"]: r["embedding"] for r in embed.embed_table(df, "id", "text", 16).collect()}
    column = {r["id"]: r["e"] for r in df.select("id", embed.hashed_embedding(F.col("text"), 16).alias("e")).collect()}
    assert set(table) == {1, 2} and all(np.allclose(table[i], column[i]) for i in table) and not any(column[3])
    cache = df.where("id = 1").select("text", embed.hashed_embedding(F.col("text"), 64).alias("embedding"))
    whole, fresh = embed.embed_with_cache(df, cache)
    assert whole.count() == 3 and fresh.count() == 2
    with pytest.raises(KeyError):
        embed.provider("none")


# --- chunks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. 。\n,", max_size=400))
def test_recursive_parts_lose_no_character(text):
    parts = chunking.recursive_parts(text, 20, chunking.SEPARATORS)
    keep = [c for c in text if c not in "\n。.，, "]
    assert [c for p in parts for c in p if c not in "\n。.，, "] == keep


def test_recursion_flaw_only_on_request():
    text = "short\n\n" + "x" * 30 + " " + "y" * 30
    assert chunking.recursive_parts(text, 20, ("\n\n", " ")).count("short") == 1
    assert chunking.recursive_parts(text, 20, ("\n\n", " "), compat=True).count("short") == 2


def test_fixed_size_cuts_and_refuses_endless_overlap():
    text = ("word " * 30 + ". ") * 4
    parts = chunking.fixed_size(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0] == text[:100].strip()
    with pytest.raises(ValueError):
        chunking.fixed_size(text, 100, 50)


def test_semantic_chunks():
    parts = ["abc.", "abd.", "xyz!", "xyw!"]
    assert chunking.semantic(parts, 0.4) == ["abc. abd.", "xyz! xyw!"]
    assert chunking.semantic([], 0.4) == []
    v = np.array([[1, 0], [1, 0], [0, 1], [0, 1.0]])
    assert chunking.semantic(parts, 0.5, vectors=v) == ["abc. abd.", "xyz! xyw!"]


def test_chunkers_on_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, " \n "), (3, "One. Two. Three.")], "doc_id long, text string")
    for name in chunking.STRATEGIES:
        rows = chunking.chunk_documents(df, name, {"lang": "en"}).collect()
        assert {r["doc_id"] for r in rows} == {3} and rows[0]["metadata"]["lang"] == "en"
    assert [r["content"] for r in chunking.by_sentence(df, max_sentences=2).orderBy("chunk_index").collect()] == ["One. Two.", "Three."]


# --- search


def vectors(spark, n=60, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_all_lists_probed_equal_the_exact_search(spark):
    _, df = vectors(spark)
    q = search.vector_of(df, 5)
    centroids = search.train_centroids(df, 4)
    ids = lambda x: [r["vec_id"] for r in x.collect()]
    assert ids(search.ivf_search(search.assign(df, centroids), centroids, q, 7, 4)) == ids(search.topk(df, q, 7, "cosine_smoothed"))
    with pytest.raises(KeyError):
        search.vector_of(df, -1)


def test_trained_lists_recall_of_every_fiftieth_vector(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = df.where("vec_id % 50 = 0")
    got = catalog.queries()["ivf_trained_search"](spark, sf)
    assert {r["query_id"] for r in got.collect()} == {r["vec_id"] for r in queries.collect()}
    assert search.recall(got, search.knn(queries, df, 10)) >= 0.9


def test_batched_lists(spark):
    _, df = vectors(spark)
    centroids = search.train_centroids(df, 4)
    assigned, queries = search.assign(df, centroids), df.where("vec_id < 9")
    rows = lambda x: {(r["query_id"], r["rank"]): r["vec_id"] for r in x.collect()}
    assert rows(search.ivf_knn(assigned, queries, centroids, 7, 4)) == rows(search.knn(queries, df, 7))
    got = rows(search.ivf_knn(assigned, queries, centroids, 7, 2, exclude_self=False))
    for i in range(9):
        want = [r["vec_id"] for r in search.ivf_search(assigned, centroids, search.vector_of(df, i), 7, 2).collect()]
        assert [got[i, k + 1] for k in range(len(want))] == want


def test_best_rows_of_equal_scores_are_few_and_of_small_ids():
    a, ids, s = search._cut(np.repeat([0, 1], 100), np.tile(np.arange(100)[::-1], 2), np.r_[np.ones(100), np.arange(100.0)], 3)
    assert sorted(ids[a == 0]) == [0, 1, 2] and sorted(s[a == 1]) == [97, 98, 99]


@pytest.mark.parametrize("metric", list(search.METRICS))
def test_knn_equals_single_searches(spark, metric):
    _, df = vectors(spark)
    got = search.knn(df.where("vec_id < 4"), df, 5, metric)
    for i in range(4):
        want = [r["vec_id"] for r in search.topk(df, search.vector_of(df, i), 5, metric, exclude=i).collect()]
        assert [r["vec_id"] for r in got.where(F.col("query_id") == i).orderBy("rank").collect()] == want


def test_unknown_metrics_are_refused(spark):
    _, df = vectors(spark)
    for call in (lambda: search.knn(df, df, 3, "cosin"), lambda: search.topk(df, [1.0] * 6, 3, "cosin")):
        with pytest.raises(ValueError):
            call()


def test_search_within_lists_equals_filtered_searches(spark):
    _, df = vectors(spark)
    got = search.knn_by_list(df.where("vec_id < 5"), df, 4, "label", exclude_self=True)
    for i in range(5):
        for label in range(3):
            want = [r["vec_id"] for r in search.topk(df, search.vector_of(df, i), 4, where=F.col("label") == label, exclude=i).collect()]
            assert [r["vec_id"] for r in got.where((F.col("query_id") == i) & (F.col("list") == label)).orderBy("rank").collect()] == want


def test_bounds_of_all_scores(spark):
    x, df = vectors(spark)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {r["query_id"]: (r["lo"], r["hi"]) for r in search.score_bounds(df.where("vec_id < 5"), df).collect()}
    s = u[:5] @ u.T
    assert all(got[i] == pytest.approx((s[i].min(), s[i].max())) for i in range(5))


def test_searches_on_null_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [0.9, 0.1])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in search.topk(df.where("size(embedding) = 2"), [1.0, 0.0], 3).collect()] == [1, 1, 5]
    assert search.similar_pairs(df, 0.9).count() == 2
    assert search.knn(df.limit(0), df, 3).count() == 0


# --- sparse, hybrid, rerank


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a a c")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in sparse.bm25(sparse.build_index(df), q).collect()}
    w = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (5 / 3)))
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert got[1] == pytest.approx(2 * idf * w(2, 3)) and got[2] == pytest.approx(idf * w(1, 2)) and 3 not in got


def test_bm25_by_a_shuffled_join_and_with_documents_of_score_zero(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} a1 a1 检索") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a1 b2 检"), (1, "b0 nothing"), (2, "nothing"), (3, None)], "query_id long, text string")
    index = sparse.build_index(df)
    rows = lambda x: {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in x.collect()}
    small = rows(sparse.bm25(index, q))
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
    assert rows(sparse.bm25(index, q)) == small and {k for k, _ in small} == {0, 1}
    full = sparse.filled(sparse.bm25(index, q), index, q, 20)
    assert full.groupBy("query_id").count().where("count = 20").count() == 4
    assert [r["doc_id"] for r in full.where("query_id = 2").orderBy("rank").collect()] == list(range(20))
    best = [r["doc_id"] for r in full.where("query_id = 1").orderBy("rank").collect()]
    assert best[:14] == list(range(0, 40, 3)) and best[14:] == [1, 2, 4, 5, 7, 8]


def test_embeddings_of_counted_terms_equal_those_of_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma 检索"), (3, ""), (4, None)], "doc_id long, text string")
    a = {r["id"]: r["embedding"] for r in embed.embed_terms(sparse.build_index(df).forward, 16).collect()}
    b = {r["id"]: r["embedding"] for r in embed.embed_table(df, "doc_id", "text", 16).collect()}
    assert set(a) == set(b) == {1, 2} and all(np.allclose(a[i], b[i]) for i in a)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB_1 .检索增K", max_size=30))
def test_tokens_in_python_and_as_an_expression(spark_for_properties, text):
    assert sorted(T.tokens_of(text)) == sorted(one(spark_for_properties, T.word_tokens(col(text)).alias("t"))["t"])


def test_batches_that_fail_and_texts_that_are_too_long(spark, monkeypatch):
    calls = []

    def remote(texts):
        calls.append(len(texts))
        if any("bad" in x for x in texts):
            raise OSError("no answer")
        return embed.vectors_of(texts, 4)

    monkeypatch.setitem(embed._PROVIDERS, "small", embed.Provider("small", 4, 3, 5, embed.hashed_embedding))
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "x" * 100), (4, "bad one"), (5, "two"), (6, "three")], "doc_id long, text string").coalesce(1).orderBy("doc_id")
    rows = {r["doc_id"]: r for r in embed.embed_batches(df, remote, "small").collect()}
    assert rows[1]["error"] is None and np.allclose(rows[1]["embedding"], embed.vectors_of(["one"], 4)[0])
    assert rows[2]["error"] == "empty text" and rows[3]["error"] == "over 5 tokens"
    assert {rows[i]["error"] for i in (4, 5, 6)} == {"no answer"} and all(rows[i]["embedding"] is None for i in (2, 3, 4, 5, 6))


def test_cache_levels(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    key = lambda x: F.md5(F.lit(x))
    row = lambda x, when: spark.range(1).select(key(x).alias("key"), F.array(F.lit(9.0)).alias("embedding"), F.lit(when).cast("timestamp").alias("expires_at"))
    memory, store_ = row("a", "2024-01-01").drop("expires_at"), row("a", "2024-01-03").union(row("b", "2024-01-03")).union(row("c", "2024-01-01"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "text string")
    served = embed.cached_levels(asked, memory, store_, now, dimensions=4)
    assert sorted((r["text"], r["level"], len(r["embedding"])) for r in served.collect() if r["text"]) == [("a", "memory", 1), ("b", "store", 1), ("c", "fresh", 4), ("c", "fresh", 4)]
    assert tuple(embed.cache_counters(served).first()) == (5, 1, 1, 2, 0.4)
    assert embed.cache_counters(served.limit(0)).first()["hit_rate"] == 0.0


def test_rankings_are_cached_by_strategy(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    c = spark.createDataFrame([(0, 1, 0.9, 0.1), (0, 2, 0.5, 0.8), (1, 1, 0.2, 0.3)], "query_id long, doc_id long, cosine double, rerank_score double")
    q = spark.createDataFrame([(0, "x"), (1, "y")], "query_id long, query string")
    none = spark.createDataFrame([], "key string, ranking array<bigint>, expires_at timestamp")
    first, cache = rerank.ranked_with_cache(q, c, none, now, "embedding")
    assert {r["query_id"]: (r["ranking"], r["cached"]) for r in first.collect()} == {0: ([1, 2], False), 1: ([1], False)}
    cache = written(cache, "cache")
    again, _ = rerank.ranked_with_cache(q, c, cache, now, "embedding")
    assert {r["cached"] for r in again.collect()} == {True}
    other, _ = rerank.ranked_with_cache(q, c, cache, now, "rerank")
    assert {r["query_id"]: (r["ranking"], r["cached"]) for r in other.collect()}[0] == ([2, 1], False)
    capped, _ = rerank.ranked_with_cache(q, c, none, now, "rerank", most=1)
    assert {r["query_id"]: r["ranking"] for r in capped.collect()} == {0: [1], 1: [1]}


def test_semantic_chunks_by_an_embedder(spark):
    df = spark.createDataFrame([(1, "Cats purr. Cats sleep. Ships sail.")], "doc_id long, text string")
    kinds = lambda parts: np.array([[1.0, 0.0] if "Cats" in p else [0.0, 1.0] for p in parts])
    assert [r["content"] for r in chunking.by_meaning(df, embedder=kinds).orderBy("chunk_index").collect()] == ["Cats purr. Cats sleep.", "Ships sail."]


def test_algorithms_compared_on_separate_groups(spark):
    points = [(i, [float(i % 3) * 10 + (i // 3) * 0.01, 0.0]) for i in range(90)]
    rows = {r["algorithm"]: r for r in learn.compare_algorithms(spark.createDataFrame(points, "vec_id long, embedding array<double>"), n_init=3).collect()}
    assert {(r["clusters"], r["noise"]) for r in rows.values()} == {(3, 0)} and all(r["silhouette"] > 0.99 for r in rows.values())
    assert samples.comparison(spark).count() == 17


def test_network_of_batches_equals_one_built_at_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = {i: rng.normal(0, 1, 3) for i in range(60)}
    net = network.SimilarityNetwork(spark, f"file://{tmp_path}/net", 0.7)
    table = lambda rows: spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")

    def edges(x):
        unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
        return {(a, b) for a in x for b in x if a < b and unit[a] @ unit[b] > 0.7}

    def check(want):
        assert {(r["a"], r["b"]) for r in net.edges().collect()} == edges(want) and net.edges().count() == len(edges(want))

    now = {i: x[i] for i in range(40)}
    assert net.update(table(list(now.items())), 0)["entries"] == 40
    check(now)
    batch = [(i, x[i]) for i in range(30, 60)] + [(3, -x[3]), (4, None), (5, x[6]), (5, x[6]), (None, x[7])]
    after = now | {i: x[i] for i in range(30, 60)} | {3: -x[3], 5: x[6]}
    del after[4]
    for _ in range(2):  # a batch that runs twice
        assert net.update(table(batch), 1)["entries"] == 23  # thirty to thirty-nine come as they are
        check(after)
    net.update(table([(4, x[4])]), 2)
    check(after | {4: x[4]})
    assert net.update(table([]), 3) == {"entries": 0, "edges": 0}


def test_inverted_lists_prune_partitions(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    centroids = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.where("vec_id < 20").orderBy("vec_id").collect()]
    search.write_lists(search.assign(df, centroids), str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    found = search.ivf_lists_l2(lists, df.where("vec_id % 50 = 0"), centroids, 10, 20)
    exact = search.knn(df.where("vec_id % 50 = 0"), df, 10, "squared_l2")
    assert {tuple(r)[:2] for r in found.collect()} == {tuple(r)[:2] for r in exact.collect()}
    one = search.ivf_lists_l2(lists, df.where("vec_id = 0"), centroids, 5, 1)
    assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() > 0 and search.recall(search.ivf_lists_l2(lists, df.where("vec_id % 50 = 0"), centroids, 10, 16), exact) >= 0.9


def made_pdf(pages, packed=False):
    """A PDF file with one font by a map to Unicode and one without; in a packed one all but streams are in an object stream."""
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <6F22> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <D83DDE00>] endbfrange"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>"}
    stream = lambda x: b"<< /Length %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(zlib.compress(x)), zlib.compress(x))
    streams = {5: stream(cmap)} | {11 + 2 * i: stream(c) for i, c in enumerate(pages)}
    objects |= {10 + 2 * i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i) for i in range(len(pages))}
    if packed:
        places, body = [], b""
        for n, x in objects.items():
            places.append(b"%d %d" % (n, len(body)))
            body += x + b" "
        head = b" ".join(places) + b" "
        inside = zlib.compress(head + body)
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(objects), len(head), inside)
        objects = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (objects | streams).items()) + b"%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text_without_a_library(spark, tmp_path, packed):
    first = rb"BT /F1 12 Tf 72 700 Td (A \(first\) line\051 caf\351) Tj 0 -14 Td [(ker) -10 (ned) -300 (words)] TJ T* (x) ' ET"
    second = b"BT /F2 9 Tf <0001> Tj 5 0 Td <001000110012> Tj 1 0 0 1 0 0 Tm [<0020> 5 <0021>] TJ ET"
    data = made_pdf([first, second], packed)
    want = "A (first) line) café\nkerned words\nx\n漢abc\né😀\n"
    assert pdf.text_of(data) == want
    for name, x in (("a.pdf", data), ("b.pdf", b"%PDF broken"), ("c.pdf", b"no such file"), ("d.pdf", data.replace(b"%%EOF", b"/Encrypt"))):
        (tmp_path / name).write_bytes(x)
    assert {r["path"][-5:]: r["text"] for r in pdf.read(spark, str(tmp_path)).collect()} == {"a.pdf": want, "b.pdf": "", "c.pdf": "", "d.pdf": ""}
    assert {r["filename"]: r["content"] for r in files.documents(spark, str(tmp_path)).collect()}["a.pdf"] == want


def test_fusions(spark):
    a = spark.createDataFrame([(0, 1, 9.0), (0, 2, 8.0)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(0, 2, 0.9), (0, 3, 0.8)], "query_id long, doc_id long, score double")
    ab, ba = ({r["doc_id"]: r["score"] for r in sparse.fuse_ranks(x, 5).collect()} for x in ([a, b], [b, a]))
    assert ab == pytest.approx(ba) and ab[2] == pytest.approx(1 / 62 + 1 / 61)
    assert [r["doc_id"] for r in sparse.fuse_first_seen(a, b, 5).orderBy("rank").collect()] == [1, 2, 3]


def test_rerank_responses(spark):
    docs = spark.createDataFrame([(0, i, 10 + i) for i in range(3)] + [(1, 0, 20)], "query_id long, index long, doc_id long")
    answers = spark.createDataFrame([(0, 2, 1.7), (0, 0, 0.2), (0, 9, 0.9)], "query_id long, index long, relevance_score double")
    rows = {(r["query_id"], r["doc_id"]): (r["relevance_score"], r["new_rank"], r["rank_change"]) for r in rerank.apply_response(docs, answers).collect()}
    assert rows == {(0, 12): (1.0, 0, 2), (0, 10): (0.2, 1, -1), (1, 20): (0.5, 0, 0)}


def test_hybrid_without_rerank_scores_and_strategies(spark):
    c = spark.createDataFrame([(0, 1, 0.5, None), (0, 2, 0.9, None)], "query_id long, doc_id long, cosine double, rerank_score double")
    assert [r["final_score"] for r in rerank.hybrid(c).orderBy("doc_id").collect()] == pytest.approx([0.75, 0.95])
    with pytest.raises(ValueError):
        rerank.by_strategy(c, "x")
    assert one(spark, rerank.cost(F.lit(100)).alias("c"))["c"] == pytest.approx(0.016)


def test_cache_expires(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, v string").withColumn("expires_at", F.when(F.col("key") == "a", F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-01 02:00:00")).cast("timestamp"))
    hits, misses = rerank.cache_get(spark.createDataFrame([("a",), ("b",)], "key string"), cache, now)
    assert [r["key"] for r in hits.collect()] == ["b"] and [r["key"] for r in misses.collect()] == ["a"]
    assert rerank.cache_put(cache, spark.createDataFrame([("a", "z")], "key string, v string"), now).count() == 2


# --- metrics: values computed by hand


@pytest.mark.parametrize(("run", "recall", "precision", "rr"), [([2, 0, 5, 1, 8], 1.0, 2 / 3, 1.0), ([5, 1, 8, 2, 0], 0.0, 0.0, 0.25), ([5, 1, 8, 3, 4], 0.0, 0.0, 0.0)])
def test_ranking_metrics(spark, run, recall, precision, rr):
    r = spark.createDataFrame([(0, d, k + 1) for k, d in enumerate(run)], "query_id long, doc_id long, rank long")
    q = spark.createDataFrame([(0, 0, 1), (0, 2, 1)], "query_id long, doc_id long, rel long")
    m = evaluation.per_query(r, q, spark.createDataFrame([(0,), (1,)], "query_id long")).collect()
    by = {x["query_id"]: x for x in m}
    assert (by[0]["recall_3"], by[0]["precision_3"], by[0]["mrr"]) == pytest.approx((recall, precision, rr))
    assert (by[1]["recall_3"], by[1]["precision_3"], by[1]["mrr"], by[1]["hit_3"]) == (1.0, 0.0, 0.0, 0)


@pytest.mark.parametrize(("run", "at3", "at4"), [([0, 1, 3, 2], 1.0, 1.0), ([0, 3, 1, 2], 0.972121, 0.972121), ([2, 3, 1, 0], 0.226869, 0.547831)])
def test_graded_gain(spark, run, at3, at4):
    r = spark.createDataFrame([(0, d, k + 1) for k, d in enumerate(run)], "query_id long, doc_id long, rank long")
    q = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (0, 2, 0), (0, 3, 1)], "query_id long, doc_id long, rel long")
    ids = spark.createDataFrame([(0,), (5,)], "query_id long")
    for k, want in ((3, at3), (4, at4)):
        got = {x["query_id"]: x["ndcg"] for x in evaluation.ndcg(r, q, ids, k).collect()}
        assert got[0] == pytest.approx(want, abs=1e-6) and got[5] == 1.0
    assert {x["query_id"]: x["ndcg"] for x in evaluation.ndcg(r, q, ids, 3, exponential=False).collect()}[5] == 0.0


# --- learning


def test_density_clusters_and_noise(spark, tmp_path):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    points = [(i, [i * 0.1, 0.0]) for i in range(6)] + [(10 + i, [50 + i * 0.1, 0.0]) for i in range(4)] + [(99, [200.0, 0.0])]
    got = {r["vec_id"]: r["cluster"] for r in learn.dbscan(spark.createDataFrame(points, "vec_id long, embedding array<double>"), 0.15, 3).collect()}
    assert {got[i] for i in range(6)} == {0 if got[0] == 0 else got[0]} and len({got[10 + i] for i in range(4)}) == 1 and got[99] == -1 and got[0] != got[10]


def test_ward_and_its_bound(spark):
    points = [(i, [float(i % 2) * 10 + i * 0.01]) for i in range(10)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in learn.ward(df, 2).collect()}
    assert all((got[i] == got[0]) == (i % 2 == 0) for i in range(10))
    with pytest.raises(ValueError):
        learn.ward(df, 2, most=5)


def test_best_k_looks_at_two_to_eight_clusters(spark, tmp_path, monkeypatch):
    starts = []
    kmeans = learn.kmeans
    monkeypatch.setattr(learn, "kmeans", lambda df, k, **how: starts.append(how.get("n_init", inspect.signature(kmeans).parameters["n_init"].default)) or kmeans(df, k, **how))
    centres = np.eye(6) * 20
    rows = [(i, [float(x) for x in centres[i % 6] + np.random.default_rng(i).normal(0, 0.1, 6)]) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["k"]: r["best"] for r in catalog.queries()["cluster_best_k"](spark, str(tmp_path)).collect()}
    assert got == {k: k == 6 for k in range(2, 9)} and starts == [10] * 7


def test_ward_gives_every_vector_a_cluster(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = catalog.queries()["cluster_ward"](spark, sf).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(r["vec_id"] for r in df.collect()) and {r["cluster"] for r in got} == {0, 1, 2}


def test_ward_over_centres_finds_separate_clusters(spark):
    points = [(i, [float(i % 3) * 10 + i * 0.001, 0.0]) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in learn.ward_of_all(df, 3, centres=12, most=100).collect()}
    assert len(got) == 300 and all(got[i] == got[i % 3] for i in range(300)) and len({got[0], got[1], got[2]}) == 3
    assert learn._agglomerate(np.array([[0.0], [1.0], [2.1]]), np.array([100, 100, 1]), 2) == [0, 1, 1]


def test_ward_tree_equals_one_block(spark):
    """Rounds of reciprocal neighbours down to three clusters, against joining the nearest pair again and again."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (40, 5)), rng.normal(4, 2, (20, 5))])
    df = spark.createDataFrame([(i * 3 + 1, v.tolist()) for i, v in enumerate(x)] + [(0, None)], "vec_id long, embedding array<double>").repartition(3)
    tree = written(hierarchy.ward_tree(df, last=8), "tree")
    want = [d for *_, d in hierarchy.joins_of(x, np.ones(len(x)))]
    got = tree.collect()
    assert sorted(r["distance"] for r in got) == pytest.approx(sorted(want)) and all(r["kept"] < r["joined"] for r in got)
    for k in (1, 3):
        found = {r["vec_id"]: r["cluster"] for r in hierarchy.cut(df, tree, k).collect()}
        assert [found[i * 3 + 1] for i in range(len(x))] == learn._agglomerate(x, np.ones(len(x)), k)


def test_ward_tree_of_ties_and_few_rows(spark):
    square = [(i, [float(i % 4), 0.0]) for i in range(12)]  # each place three times, all gaps alike
    df = spark.createDataFrame(square, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in hierarchy.ward(df, 4, last=1).collect()}
    assert all(got[i] == got[i % 4] for i in range(12)) and len(set(got.values())) == 4
    assert [tuple(r) for r in hierarchy.ward(df.limit(1), 3).collect()] == [(0, 0)]
    assert hierarchy.ward(df.limit(0), 3).collect() == []


def test_kmeans_ends_where_lloyd_does(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 4)) + np.repeat(np.eye(4) * 3, 50, 0)
    df = spark.createDataFrame([(i, v.tolist(), str(i)) for i, v in enumerate(x)] + [(999, None, "n")], "vec_id long, embedding array<double>, name string").repartition(3)
    out, inertia, width = learn.kmeans(df, 4, most=100, move=1e-9)
    label = {r["vec_id"]: r["cluster"] for r in out.collect()}
    at = np.array([label[i] for i in range(200)])
    centres = np.stack([x[at == c].mean(0) for c in range(4)])
    d = ((x[:, None] - centres) ** 2).sum(2)
    assert (d.argmin(1) == at).all() and inertia == pytest.approx(d.min(1).sum()) and 0 < width < 1
    best = np.inf
    for s in range(30):  # no worse than thirty plain runs from random rows
        c = x[np.random.default_rng(s).choice(200, 4, replace=False)]
        for _ in range(100):
            a = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.stack([x[a == j].mean(0) if (a == j).any() else c[j] for j in range(4)])
        best = min(best, ((x[:, None] - c) ** 2).sum(2).min(1).sum())
    assert inertia <= best * (1 + 1e-9)
    again = {r["vec_id"]: r["cluster"] for r in learn.kmeans(df.repartition(2), 4, most=100, move=1e-9)[0].collect()}
    assert again == label  # however the rows are dealt
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert learn.kmeans(same, 2)[0].select("cluster").distinct().count() == 1 and math.isnan(learn.kmeans(same, 2)[2])
    assert learn.kmeans(same.limit(0), 2)[0].collect() == []


def test_one_class_machine_is_fitted_on_all_rows(spark, sf):
    """The flags of a plain fit of the same objective, by many small gradient steps, on all rows."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    x, nu, soft, features = np.array([v for _, v in rows], float), 0.1, 0.02, 256
    rng = np.random.default_rng(42)
    gamma = 1 / (x.shape[1] * x.var())
    w, b = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    z = np.sqrt(2 / features) * np.cos(x @ w + b)
    u, rho = np.zeros(features), 0.0
    value = lambda u, rho: u @ u / 2 - rho + np.where((t := rho - z @ u) <= 0, 0, np.where(t < soft, t * t / (2 * soft), t - soft / 2)).mean() / nu
    for _ in range(4000):
        pull = np.clip((rho - z @ u) / soft, 0, 1) / (nu * len(z))
        u, rho = u - 0.02 * (u - pull @ z), rho - 0.02 * (pull.sum() - 1) * 0.1
    got = {r["vec_id"]: r for r in learn.one_class_boundary(df, df).collect()}
    scores = np.array([got[i]["score"] for i, _ in rows])
    assert sum(r["is_anomaly"] for r in got.values()) == pytest.approx(nu * len(x), abs=1)
    s = z @ u - np.quantile(z @ u, nu)
    assert np.corrcoef(s, scores)[0, 1] > 0.999
    assert ((s < 0) != (scores < 0)).mean() <= 0.01 and np.isfinite(value(u, rho))


def plain_tsne(x, perplexity, turns=400):
    """The method as it stands, all pairs in one process."""
    n = len(x)
    d = ((x[:, None] - x) ** 2).sum(2)
    off = ~np.eye(n, dtype=bool)
    p = np.zeros((n, n))
    order = np.sort(d[off].reshape(n, n - 1), 1)
    places = np.argsort(np.where(off, d, np.inf), 1)[:, : n - 1]
    np.put_along_axis(p, places, projection.affinities(order, perplexity), 1)
    p = (p + p.T) / (2 * n)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = (x - x.mean(0)) @ axes[:2].T
    y, v, gain = y / y[:, 0].std() * 1e-4, np.zeros((n, 2)), np.ones((n, 2))
    for t in range(turns):
        w = 1 / (1 + ((y[:, None] - y) ** 2).sum(2))
        np.fill_diagonal(w, 0)
        c = ((12 if t < turns // 4 else 1) * p - w / w.sum()) * w
        slope = 4 * (c.sum(1)[:, None] * y - c @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if t < turns // 4 else 0.8) * v - 50 * gain * slope
        y = y + v
    return y


def kept(x, y, k=10):
    near = lambda z: np.argsort(((z[:, None] - z) ** 2).sum(2) + np.eye(len(z)) * 1e18, 1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y), strict=True)])


def test_affinities_have_the_perplexity():
    d = np.sort(np.random.default_rng(0).gamma(2, 1, (50, 60)), 1)
    p = projection.affinities(d, 12)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p)).sum(1)), 12, rtol=1e-6)


def test_tsne_keeps_neighbours_as_the_plain_method_does(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (240, 8)) + np.repeat(rng.normal(0, 4, (6, 8)), 40, 0)
    monkeypatch.setattr(projection, "PART", 100)  # several parts
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["x"], r["y"]) for r in projection.tsne(df, 15.0, rounds=40).collect()}
    assert sorted(got) == list(range(240))
    y = np.array([got[i] for i in range(240)])
    assert np.isfinite(y).all() and kept(x, y) >= 0.85 * kept(x, plain_tsne(x, 15))
    few = projection.tsne(df.where("vec_id < 2")).collect()
    assert [(r["x"], r["y"]) for r in few] == [(0.0, 0.0)] * 2 and projection.tsne(df.limit(0)).collect() == []


def test_detectors_find_a_far_point(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 4)]) for i in range(80)] + [(999, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    forest = {r["vec_id"]: r["score"] for r in learn.isolation_forest(df).collect()}
    assert max(forest, key=forest.get) == 999
    lof = {r["vec_id"]: r["lof"] for r in learn.local_outlier_factor(df).collect()}
    assert max(lof, key=lof.get) == 999
    machine = {r["vec_id"]: r for r in learn.one_class_boundary(df, df.where("vec_id < 999")).collect()}
    assert machine[999]["is_anomaly"] and sum(r["is_anomaly"] for r in machine.values()) <= 20


def test_learning_on_tables_without_a_vector(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for df in (none, none.limit(0)):
        known = learn.profile(df)
        assert known == ([], 0.0, 0.0, 0.0)
        assert learn.anomaly_report(learn.distance_anomalies(df.where("embedding is not null"), known)).first()["total"] == 0
        assert learn.pca(df, 2)[0].count() == 0 and learn.pca(df, 2)[1] == []
        assert learn.one_class_boundary(df, df).count() == 0
        assert learn.local_outlier_factor(df).count() == 0 and learn.isolation_forest(df).count() == 0


def test_pca_against_numpy(spark):
    x, df = vectors(spark, 40, 5)
    out, shares = learn.pca(df, 2)
    x32 = x.astype(np.float32).astype(float)
    c = x32 - x32.mean(0)
    values = np.linalg.svd(c, compute_uv=False) ** 2
    assert shares == pytest.approx(list(values[:2] / values.sum()), abs=1e-6)
    p = np.array([r["point"] for r in out.orderBy("vec_id").collect()])
    assert np.allclose((p**2).sum(0), values[:2], rtol=1e-5)


# --- recommendations, stores, time


def test_weights_and_latest(spark):
    b = spark.createDataFrame([(1, 7, 1.0, k, k) for k in range(25)], "user_id long, item_id long, score double, ts long, event_id long")
    assert sorted(r["ts"] for r in recommend.latest(b).collect()) == list(range(5, 25))
    items = spark.createDataFrame([(7, [1.0, 2.0])], "item_id long, embedding array<double>")
    minus = b.withColumn("score", F.lit(-1.0))
    assert recommend.user_vectors(b, items).first()["embedding"] == [1.0, 2.0]
    assert recommend.user_vectors(minus, items).first()["embedding"] == [0.0, 0.0]


def test_ids_upserts_and_merges(spark):
    df = spark.range(23).repartition(5).select(F.col("id").alias("x"))
    assert sorted(r["id"] for r in store.with_ids(df, 100).collect()) == list(range(101, 124))
    old = spark.createDataFrame([("a", "1", "x", 3), ("b", "2", "y", 1)], "title string, content string, category string, version long")
    new = spark.createDataFrame([("a", "1", "z"), ("c", "3", "w")], "title string, content string, category string")
    got = {r["title"]: (r["category"], r["version"]) for r in store.incremental_merge(old, new).collect()}
    assert got == {"a": ("z", 4), "b": ("y", 1), "c": ("w", 1)}
    assert len(store.SCHEMAS) == 22
    rows = lambda n: spark.createDataFrame(n, "id long, x string, m map<string,int>")
    got = store.upsert(rows([(1, "a", {}), (2, "b", {})]), rows([(2, "c", {"k": 1}), (2, "d", None), (3, "e", {})])).collect()
    assert sorted((r["id"], r["x"]) for r in got) == [(1, "a"), (2, "d"), (3, "e")]


def test_a_run_scope_deletes_what_it_wrote(spark):
    with scratch(spark) as path:
        df = written(spark.range(5), "five")
        assert df.count() == 5 and df.inputFiles()[0].startswith(path.replace("file:///", "file:/")) or path in df.inputFiles()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    assert written(spark.range(3), "three").count() == 3


def test_query_log(spark):
    res = spark.createDataFrame([(1, 0.2), (2, 0.9)], "doc_id long, score double")
    row = store.query_log(res, F.lit("q"), F.lit("2024-01-01").cast("timestamp")).first()
    assert row["relevance_score"] == 0.9 and row["response"].startswith('[{"doc_id":2')


def test_asof_and_range_joins(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "k string, t long, i long")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 7, 70)], "k string, t long, x long")
    assert {r["i"]: r["x"] for r in temporal.asof_join(left, right, "k", "t", ["x"]).collect()} == {1: 50, 2: None, 3: None}


def test_empty_reports(spark):
    none = spark.createDataFrame([], "query string")
    assert analytics.click_rate(none, none).first()["rate"] == 0.0


# --- plans


def test_prompt_budget_and_refusal(spark):
    rows = spark.createDataFrame([(0, 1, "s", "p", "x" * 50, 0.9), (0, 2, None, "", "y" * 5000, 0.8), (0, 3, "t", "", "z", 0.7)], "query_id long, doc_id long, source string, section string, content string, score double")
    r = rag.assemble(rows).first()
    assert r["n_sources"] == 1 and r["context"] == "[来源: s, p]\n" + "x" * 50
    docs = spark.createDataFrame([(1, "The capital of France is Paris. It lies on the Seine river.", "geo")], "doc_id long, text string, source string")
    pipe = rag.Pipeline()
    out = {x["query_id"]: x for x in pipe.answer(pipe.ingest(docs), spark.createDataFrame([(0, "capital of France"), (1, " ")], "query_id long, question string")).collect()}
    assert "Paris" in out[0]["answer"] and out[0]["n_sources"] == 1 and out[1]["answer"] == rag.REFUSAL


def test_engine_search_shape(spark):
    df = spark.createDataFrame([("a", "Deep nets", "All about deep nets", [1.0, 0.0]), ("b", "Soup", "Recipes", [0.0, 1.0])], "id string, title string, content string, embedding array<double>")
    rows = rag.engine_search(df, "deep nets", [1.0, 0.0]).collect()
    assert rows[0]["id"] == "a" and rows[0]["score"] == pytest.approx(1.0) and rows[0]["highlights"] and rows[1]["score"] == 0.0


# --- sources and streams


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two  \nthree\n", "utf-8")
    (tmp_path / "b.md").write_bytes("中文".encode("gbk"))
    (tmp_path / "skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p></w:body></w:document>')
    assert [(r["line_number"], r["text"]) for r in files.text_lines(spark, str(tmp_path / "a.txt")).collect()] == [(1, "one"), (2, "two"), (3, "three")]
    with pytest.raises(ValueError):
        files.text_lines(spark, str(tmp_path / "a.txt"), most=2)
    got = {r["filename"]: r["content"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["b.md"] == "中文" and got["c.docx"] == "Hi\n" and "skip.bin" not in got


def test_samples(spark):
    docs, queries, qrels = samples.evaluation(spark)
    assert (docs.count(), queries.count(), qrels.count()) == (10, 6, 10)
    assert samples.documents(spark, 99).count() == 10 and samples.documents(spark, 99, "storage").count() == 2
    assert samples.benchmark_sets(spark, 6, 2).where("relevant").count() == 6
    scores = sparse.ranked(sparse.bm25(sparse.build_index(docs), queries), 5)
    assert evaluation.per_query(scores, qrels, queries).agg(F.avg("hit_5")).first()[0] == 1.0


def test_few_results_are_noise(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "doc_id long, text string, embedding array<double>")
    assert learn.cluster_results(df).first()["cluster"] == -1


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A process that starts elsewhere, with the package on its own path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom vectrine.session import session\nfrom vectrine.operators import chunking\nspark = session(master='local[2]')\ndf = spark.createDataFrame([(1, 'One. Two.' * 50)], 'doc_id long, text string')\nprint('chunks', chunking.by_recursion(df, 60, 10).count())\n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    assert int(out.split("chunks")[1]) > 1


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [1000, 500, 1]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for share in (0.0, 0.5, 0.9, 1.0):
            assert learn.quantile(df, "x", share, bins=8, few=20) == pytest.approx(float(np.quantile(x, share)))
    assert learn.quantile(df.limit(0), "x", 0.5) is None


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"top_k": 9, "other": 1}')
    assert EngineConfig.from_json(str(tmp_path / "c.json")).top_k == 9


def test_online_model_one_action_at_a_time(spark, tmp_path):
    """Batches of one action each equal the plain fold over both sides."""
    model = recommender.OnlineModel(spark, f"file://{tmp_path}/model", dimensions=4, limit=3)
    start = {(side, k): spark.range(1).select(recommender.hashed_start(F.lit(k), side, 4).alias("v")).first()["v"] for side in ("users", "items") for k in (1, 2, 3)}
    users, items = ({k: np.array(start[side, k]) for k in (1, 2, 3)} for side in ("users", "items"))
    for n, (u, i, s) in enumerate([(1, 2, 5.0), (1, 3, -1.0), (2, 2, 3.0), (1, 2, 1.0)]):
        users[u], items[i] = recommender.sgd_step(users[u], items[i], s)
        batch = spark.createDataFrame([(n, n, u, i, s)], "event_id long, ts long, user_id long, item_id long, score double")
        top = model.update(batch, n).collect()
        assert all(r["item_id"] != i for r in top)
    for side, want, keys in (("users", users, (1, 2)), ("items", items, (2, 3))):
        got = {r["key"]: r["vector"] for r in model.vectors(side).collect()}
        assert set(got) == set(keys) and all(np.allclose(got[k], want[k]) for k in keys)
    again = model.update(batch, n).collect()  # a batch that runs twice leaves the same vectors
    assert [tuple(r) for r in again] == [tuple(r) for r in top]
    assert np.allclose({r["key"]: r["vector"] for r in model.vectors("users").collect()}[1], users[1])


def test_online_model_folds_many_actions_of_one_user(spark, tmp_path):
    model = recommender.OnlineModel(spark, f"file://{tmp_path}/model", dimensions=4)
    rows = [(n, n, 1, 10 + n, float(n % 3)) for n in range(6)] + [(9, 9, None, 3, 1.0)]
    model.update(spark.createDataFrame(rows, "event_id long, ts long, user_id long, item_id long, score double"), 0)
    first = lambda k, side: np.array(spark.range(1).select(recommender.hashed_start(F.lit(k), side, 4).alias("v")).first()["v"])
    user = first(1, "users")
    items = {}
    for _, _, _, i, s in rows[:6]:
        user, items[i] = recommender.sgd_step(user, first(i, "items"), s)
    assert np.allclose(model.vectors("users").first()["vector"], user)
    assert all(np.allclose(r["vector"], items[r["key"]]) for r in model.vectors("items").collect())


@pytest.mark.parametrize(("n", "per_bucket"), [(600, 100), (10_000, 100_000)])
def test_waves_equal_acting_one_by_one(spark, n, per_bucket):
    """Actions of 50 users, a third of them on one item, in several buckets and in one."""
    rng = random.Random(4)
    rows = [(k, k // 3, rng.randrange(50), 0 if k % 3 == 0 else rng.randrange(1, 400), float(rng.choice([1, 3, 5, -1]))) for k in range(n)]
    start = {s: spark.createDataFrame([(k,) for k in sorted({r[c] for r in rows})], "key long").withColumn("vector", online.hashed_start(F.col("key"), s, 6)) for s, c in (("users", 2), ("items", 3))}
    want = {s: {r["key"]: np.array(r["vector"]) for r in df.collect()} for s, df in start.items()}
    for _, _, u, i, score in rows:
        want["users"][u], want["items"][i] = recommender.sgd_step(want["users"][u], want["items"][i], score)
    actions = spark.createDataFrame(rng.sample(rows, n), "event_id long, ts long, user_id long, item_id long, score double")
    got = online.two_sided(actions, start["users"], start["items"], per_bucket=per_bucket).collect()
    assert len(got) == sum(map(len, want.values()))
    assert all(np.allclose(r["vector"], want[r["side"]][r["key"]], atol=1e-12) for r in got)


def test_online_model_snapshots_and_rescoring(spark, tmp_path):
    model = recommender.OnlineModel(spark, f"file://{tmp_path}/model", dimensions=4, limit=3, keep_seen=True, snapshot_every=2)
    plain = recommender.OnlineModel(spark, f"file://{tmp_path}/plain", dimensions=4, limit=3, keep_seen=True, snapshot_every=0)
    rng = random.Random(2)
    schema = "event_id long, ts long, user_id long, item_id long, score double, event_type string"
    for batch in range(4):
        rows = [(10 * batch + k, k, rng.randrange(3), rng.randrange(6), float(rng.randrange(-1, 6)), rng.choice(["view", "like"])) for k in range(6)]
        df = spark.createDataFrame([*rows, (None, 1, 1, 1, 1.0, "view")], schema)
        old = [tuple(r) for r in spark.read.parquet(f"{model.path}/recommendations").collect()] if batch else []
        a, b = ([tuple(r) for r in m.update(df, batch).collect()] for m in (model, plain))
        assert {r[:2] for r in a} == {r[:2] for r in b}
    assert os.path.exists(f"{tmp_path}/model/users_all/batch=1") and os.path.exists(f"{tmp_path}/model/items_all/batch=3")
    for side in ("users", "items"):
        x, y = ({r["key"]: r["vector"] for r in m.vectors(side).collect()} for m in (model, plain))
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k]) for k in x)
    # the scores of the last batch from their definition
    users, items = ({r["key"]: np.array(r["vector"]) for r in model.vectors(s).collect()} for s in ("users", "items"))
    last = {}
    for user, item, _, rank, _, n in old:
        last.setdefault(user, {}).setdefault(n, {})[rank] = item
    kinds = {}
    for r in spark.read.parquet(f"{model.path}/kinds").collect():
        kinds.setdefault(r["user_id"], {}).setdefault(r["event_type"], []).append(r["n"])
    assert a
    for user in {r[0] for r in a}:
        cached = last[user][max(last[user])].values() if user in last else []
        bonus = lambda v: 0.1 * (1 - np.mean([v @ items[i] for i in cached])) if cached else 0.0  # noqa: B023, E731
        score = {i: users[user] @ v + bonus(v) for i, v in items.items()}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]  # noqa: B023
        kind = min(kinds[user], key=lambda k: (-sum(kinds[user][k]), k))  # noqa: B023
        got = sorted((r for r in a if r[0] == user), key=lambda r: r[3])
        assert [r[1] for r in got] == best and [r[2] for r in got] == pytest.approx([score[i] for i in best])
        assert {r[4] for r in got} == {f"based on your {kind} history"}


def test_producer_and_state_that_expires(spark, tmp_path):
    stream = recommender.producer(spark, 50)
    assert stream.isStreaming and {"event_id", "ts", "user_id", "item_id", "event_type", "score"} <= set(stream.columns)
    events = tmp_path / "in"
    spark.createDataFrame([(1, 1, 7, 3.0), (2, 2, 7, 1.0)], "event_id long, user_id long, item_id long, score double").selectExpr("*", "timestamp'2024-01-01' as ts").write.parquet(str(events))
    live = spark.readStream.schema(spark.read.parquet(str(events)).schema).parquet(str(events))
    out = recommender.run_to_table(recommender.user_state(live, 3, ttl_seconds=3600), "ttl", "update", ["user_id"])
    assert {r["user_id"]: r["n"] for r in out.collect()} == {1: 1, 2: 1}


def test_users_start_anew_after_their_time(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:30:00", 1), (3, "2024-01-01 02:00:00", 1), (4, "2024-01-01 02:00:01", 2)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts", "2L as item_id", "1d as score").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = recommender.run_to_table(recommender.user_state(live, 3, ttl_seconds=3600), "ttl", "update", ["user_id"])
    assert {r["user_id"]: r["n"] for r in out.collect()} == {1: 1, 2: 1}


def test_requests_to_an_expiring_entry():
    def plain(times, until, ttl):
        hits = misses = evictions = 0
        for t in times:
            if until is not None and t < until:
                hits += 1
            else:
                evictions += until is not None
                misses, until = misses + 1, t + ttl
        return hits, misses, evictions, until

    rng = random.Random(3)
    for _ in range(200):
        times = sorted(rng.randrange(60) for _ in range(rng.randrange(1, 12)))
        until, ttl = rng.choice([None, rng.randrange(60)]), rng.randrange(1, 20)
        assert expiry.requests(np.array(times), until, ttl) == plain(times, until, ttl)


def test_expired_entries_leave_the_state(spark, tmp_path):
    """Two runs over a growing folder; the state holds the entry that lives at the end and no other."""

    def add(name, rows):
        spark.createDataFrame(rows, "k long, t string").selectExpr("k", "cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(n):
        live = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
        with expiry.rocksdb(spark):
            recommender.to_table(expiry.expiring_cache(live, "k", 600, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
            state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "until").load().select("key.k").collect()
        sums = spark.read.parquet(str(tmp_path / "out")).groupBy("k").agg(F.sum("hits"), F.sum("misses"), F.sum("evictions")).collect()
        return {r["k"] for r in state}, {tuple(r) for r in sums}

    before = spark.conf.get(expiry.PROVIDER)
    add("a", [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:01:00"), (None, "2024-01-01 00:01:00"), (4, None)])
    assert run(1) == ({1, 2}, {(1, 1, 2, 1), (2, 0, 1, 0)})
    add("b", [(3, "2024-01-01 00:30:00"), (3, "2024-01-01 00:30:00")])
    assert run(2) == ({3}, {(1, 1, 2, 2), (2, 0, 1, 1), (3, 1, 1, 0)})
    assert spark.conf.get(expiry.PROVIDER) == before


def test_batches_report_their_metrics(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(n % (k + 2),) for n in range(10 * (k + 1))], "user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("user_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with metrics.reported(spark, str(tmp_path / "metrics")):
        recommender.to_table(metrics.observed(live), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = metrics.ticks(spark, str(tmp_path / "metrics")).collect()
    got = {(r["batch"], r["metric_name"]): r["value"] for r in rows}
    assert {b for b, _ in got} == {0, 1, 2} and {m for _, m in got} == {"rows", "active_users", "input_rows", "rows_per_second", "batch_ms"}
    assert [got[b, "rows"] for b in range(3)] == [got[b, "input_rows"] for b in range(3)] and sorted(got[b, "rows"] for b in range(3)) == [10, 20, 30]
    assert sorted(got[b, "active_users"] for b in range(3)) == [2, 3, 4]


def test_sgd_uses_the_new_user_vector():
    u, i = np.array([0.1, 0.2]), np.array([0.3, -0.1])
    nu, ni = recommender.sgd_step(u, i, 1.0)
    e = 1.0 - u @ i
    assert np.allclose(nu, u + 0.01 * (e * i - 0.001 * u)) and np.allclose(ni, i + 0.01 * (e * nu - 0.001 * i))
    users, items = recommender.fold([(1, 2, 1.0), (1, 2, 1.0)])
    assert set(users) == {1} and set(items) == {2}


def test_streams_score_actions_as_batches_do(spark, sf):
    from vectrine.plans import catalog_logs

    rows = lambda df: {(r["event_id"], r["score"]) for r in df.collect()}
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert rows(recommender.as_actions(events, catalog_logs.SCORES)) == rows(catalog_logs.actions(spark, sf))


def test_stream_sink_does_not_double_a_batch(spark, tmp_path, sf):
    stream = recommender.actions(spark, f"{sf}/event[s].parquet")
    recommender.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    recommender.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert n == spark.read.parquet(f"{sf}/events.parquet").count() == spark.read.parquet(str(tmp_path / "out")).count()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=4, max_size=4), st.lists(st.floats(-3, 3), min_size=4, max_size=4))
def test_cosine_is_symmetric_and_bounded(spark_for_properties, a, b):
    r = one(spark_for_properties, V.cosine_clamped(V.literal(a), V.literal(b)).alias("x"), V.cosine_clamped(V.literal(b), V.literal(a)).alias("y"))
    assert r["x"] == pytest.approx(r["y"]) and -1 <= r["x"] <= 1


@pytest.fixture(scope="module")
def spark_for_properties(spark):
    return spark


def test_user_vectors_of_the_stream_have_fifty_dimensions(spark, sf):
    assert {len(r["vector"]) for r in catalog.queries()["stream_user_vectors"](spark, sf).collect()} == {50}


def test_random_sets_are_seeded():
    random.seed(0)
    assert list(recommender.initial_vector(3, 1, 4)) == list(recommender.initial_vector(3, 1, 4))
