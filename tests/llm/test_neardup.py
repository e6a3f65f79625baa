"""Near-duplicates against all pairs on full sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import TEXTS, awkward, empty
from vectrine.llm import graph, neardup, queries, shingles
from vectrine.llm.common import partitions, partitions_for


def brute(texts, width, percent):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            holders[s].add(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(rows, want):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_query_on_the_small_table(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    want = brute(texts, 3, 85)
    assert len({c for _, c in want.values()}) < len(want)
    check(queries.op3_neardup(spark, sf).collect(), want)


def test_large_cluster_in_blocks(spark):
    """Hundreds of near copies, most of them linked only through others, some not at all."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(420):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            own[rng.randrange(60)] = f"x{rng.randrange(30)}"
        texts.append((i, " ".join(own)))
    texts += [(1000 + i, f"alone {i} " + " ".join(f"z{i}_{k}" for k in range(20))) for i in range(40)]
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    check(rows, brute(texts, 3, 85))


def test_awkward(spark):
    rows = neardup.near_duplicates(awkward(spark), 3, 85).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and not by[2]["kept"]
    assert [by[i]["n_shingles"] for i in (3, 4, 5, 9, 10)] == [0, 0, 1, 1, 0]
    assert by[3]["kept"] and by[4]["kept"] and by[5]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        s = shingles.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), 120)
        assert len(s) == 120 and (s != np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    same = [np.mean(shingles.sketch(x, 128) == shingles.sketch(x[100:], 128)) for x in (a, a[:500], a[:300])]
    assert all(abs(s - j) < 0.12 for s, j in zip(same, (0.9, 0.8, 0.667), strict=True))


def test_banding_meets_its_chance():
    for percent in (50, 70, 80, 85, 95):
        r, b = neardup.banding(percent)
        assert (1 - (percent / 100) ** r) ** b <= 1e-6


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (9, 8)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], []])
def test_components(spark, pairs):
    got = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in range(len(parent)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
        if all(parent[a] == parent[b] for a, b in pairs):
            break
    assert got == parent


@pytest.fixture
def many_partitions(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, x in keep.items():
        spark.conf.set(k, x)


def test_a_hot_key_is_not_one_task_of_a_join(spark, many_partitions):
    from pyspark.sql import functions as F

    left = spark.range(100_000, numPartitions=50).selectExpr("id", "case when id % 3 = 0 then 7 when id % 11 = 0 then null else id end as k").withColumn("tag", F.lit("x"))
    right = spark.range(100_000).selectExpr("id as k", "id * 2 as w").where("k % 2 = 1")
    assert len(graph.hot_keys(left, ["k"])) == 1
    for how in ("inner", "left"):
        out = graph.spread_join(left, right, ["k"], how)
        assert out.columns == ["k", "id", "tag", "w"]
        plain = left.join(right, ["k"], how).select("k", "id", "tag", "w")
        assert out.exceptAll(plain).isEmpty() and out.count() == plain.count()
        largest = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert largest <= 3000, (how, largest)


def test_components_of_a_star_and_a_chain_over_many_partitions(spark, many_partitions):
    pairs = spark.range(20_000).selectExpr("1000000 as a", "id as b").union(spark.range(30).selectExpr("id + 2000000 as a", "id + 2000001 as b"))
    rows = graph.components(pairs, 20_100).collect()
    assert {r["label"] for r in rows if r["v"] <= 1_000_000} == {0} and {r["label"] for r in rows if r["v"] >= 2_000_000} == {2_000_000}
    assert len(rows) == 20_001 + 31


def test_by_group_streams_groups_over_batches(spark):
    import pyarrow as pa

    def fn(key, batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([n], pa.int64())], ["k", "n"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("id * id % 13 as k", "id")
        got = {r["k"]: r["n"] for r in graph.by_group(df, ["k"], ["id"], graph.Spread(3, 2), fn, "k long, n long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter(i * i % 13 for i in range(500))


def test_a_table_of_unknown_size_gets_the_session_s_partitions(spark):
    wide = spark.createDataFrame([(1, *"abcdefghijklmn")], ["doc_id", *"abcdefghijklm", "text"])
    assert partitions_for(wide) == partitions_for(wide.select("doc_id", "text")) == partitions(spark)
