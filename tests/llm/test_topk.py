"""Exact top-k against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from vectrine.llm import queries, topk


def brute(rows, is_query, k, scale=256):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(good):
        if is_query(i):
            asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("ids", T.StringType())])


def run(spark, rows, modulo, k=5):
    df = spark.createDataFrame([(i, v, "s", "t") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.exact_topk(df, df["vec_id"] % modulo == 0, k).collect())


def test_query(spark, sf):
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    assert sorted(tuple(r) for r in queries.op5_topk(spark, sf).collect()) == brute(rows, lambda i: i % 50 == 0, 5)


def test_awkward_vectors(spark):
    rng = random.Random(0)
    f32 = lambda n: [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)]
    same = f32(8)
    rows = [(i, f32(8)) for i in range(60)] + [(100 + i, same) for i in range(40)] + [(5, f32(8)), (7, same), (7, same)]
    rows += [(200, None), (201, []), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] + same[1:]), (None, same), (210, f32(4)), (220, f32(4))]
    assert run(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0, 5)


def test_values_too_large_for_doubles(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.uniform(-1e5, 1e5))) for _ in range(4)]) for i in range(50)]
    assert run(spark, rows, 7) == brute(rows, lambda i: i % 7 == 0, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (1, [1.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows, 2) == brute(rows, lambda i: i % 2 == 0, 5)


@pytest.mark.parametrize("largest", [3, 256, 40_000, 1 << 30])
def test_bounds_hold_for_every_candidate(largest):
    rng = np.random.default_rng(3)
    q, c = rng.integers(-largest, largest + 1, (20, 16)), rng.integers(-largest, largest + 1, (500, 16))
    low, width, cells = topk.approximate(c)
    at = low + cells.astype(np.int64) * width
    assert cells.dtype == np.uint8 and (at <= c).all() and (c < at + width).all()
    lower, slack = topk.bounds(q, low, width, cells)
    for k, x in enumerate(q):
        exact = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c]
        assert all(lo <= e <= lo + slack[k] for lo, e in zip(lower[k].tolist(), exact, strict=True))


def test_few_exact_vectors_are_read(spark, sf):
    """The file keeps cells apart from exact vectors, and the bounds of all blocks leave few of those to read."""
    reads = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, asked = df.count(), df.where("vec_id % 50 = 0").count()
    got = topk.exact_topk(df, df["vec_id"] % 50 == 0, 5, reads=reads)
    rows = got.collect()
    assert len(rows) == 5 * asked and 5 * asked <= reads.value < 0.1 * n * asked
    file = topk.vector_file(topk.quantised(df))
    assert file.select("cells").agg({"cells": "max"}).first()[0] is not None
    assert {r["n"] for r in file.selectExpr("length(cells) * 8 = length(exact) as n").collect()} == {True}


def test_very_common_vectors_leave_few_rows(spark):
    """A third of all rows are one vector; a query still gets the smallest ids, its own left out."""
    rng = random.Random(5)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, same) for i in range(400)] + [(400 + i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(800)] + [(0, same)] * 7
    assert run(spark, rows, 100) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 100 == 0, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.without_spare_copies(topk.quantised(df), 5).where("id < 400").count() == 10
