"""Exact top-k by inner product over vector-approximation files.

The vectors are written once, in blocks. A block's approximation, one byte a dimension that names a cell between the
block's least and largest value there, and its exact vectors are separate columns of the file, so a scan of the one
does not read the other.

1. Queries scan the cells, which give a lower and an upper bound of every inner product. A candidate survives where its
   upper bound reaches the k-th highest lower bound seen so far by the task; survivors are written with their bounds.
2. The k-th highest lower bound of each query over all blocks is known then, and most survivors go.
3. Exact vectors of what is left are read block by block, for each query in the order of the bounds, until no unread
   bound reaches the k-th exact score. The best of all blocks are merged by rank.

Of equal vectors only those of the k + 1 smallest ids can be among the k best of any query, so very common vectors are
cut down to those before the file is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm.common import partitions, written
from vectrine.llm.graph import Spread, by_group, hot_keys

#: Queries of a tile and those scored at once, rows of a block, cells of a dimension, exact vectors read at a time.
QUERY_TILE, QUERIES_AT_ONCE, BLOCK, CELLS, READ = 4096, 512, 4096, 256, 16
#: Tiles whose running bounds a task remembers; survivors from which on a block is hot, and parts it is dealt over then.
HELD_TILES, HOT_SURVIVORS, HOT_PARTS = 256, 20_000, 64
_FILE = "block long, dim int, ids binary, low binary, width binary, cells binary, exact binary"


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of each component as double.

    Rows whose id or vector is null, whose vector is empty, or which holds a null or non-finite component are left
    out; they take no part in a search.
    """
    x = df[vector_col].cast("array<double>")
    usable = df[id_col].isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return df.where(usable).select(df[id_col].cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def without_spare_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows of the k + 1 smallest ids, and k rows of each: a query leaves out its own id, so no
    other row can be among its k best. Both limits hold within tasks before anything is shuffled."""
    first = vectors.withColumn("_d", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_d") <= k + 1)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("v", "id").orderBy("_d"))).where(F.col("_r") <= k).select("id", "v")


def approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per dimension the least value and a cell's width, and each component's cell."""
    low = exact.min(0)
    width = (exact.max(0) - low) // CELLS + 1
    return low, width, ((exact - low) // width).astype(np.uint8)


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (query, candidate) of the inner products, and by how much more a query's upper bounds are."""
    x, step = q.astype(np.float64), width.astype(np.float64)
    lower = (x * step) @ cells.T.astype(np.float64) + (x @ low.astype(np.float64) + np.minimum(x, 0) @ (step - 1))[:, None]
    slack = np.abs(x) @ (step - 1)
    most = np.abs(x) @ np.maximum(np.abs(low), np.abs(low + CELLS * width)).astype(np.float64)
    if most.max(initial=0) >= 1 << 51:  # sums are no longer exact in double: room for their rounding
        room = most * len(low) * 2.0**-50
        lower, slack = lower - room[:, None], slack + 2 * room
    return lower, slack


def vector_file(vectors: DataFrame) -> DataFrame:
    """Writes blocks of one dimension: (block, dim, ids, low, width, cells, exact)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def out(ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
            exact = np.concatenate(parts)
            low, width, cells = approximate(exact)
            blobs = [np.concatenate(ids).astype("<i8"), low.astype("<i8"), width.astype("<i8"), cells, exact.astype("<i8")]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([exact.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["block", "dim", "ids", "low", "width", "cells", "exact"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, v = part.column(0).to_numpy(), part.column(1)
                size = v.value_lengths().to_numpy()
                flat, edge = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
                for dim in np.unique(size):
                    here = np.flatnonzero(size == dim)
                    some = held.setdefault(int(dim), ([], []))
                    some[0].append(ids[here])
                    some[1].append(flat[edge[here][:, None] + np.arange(dim)])
                    if sum(map(len, some[0])) >= BLOCK:
                        yield out(*held.pop(int(dim)))
                        n += 1
        for some in held.values():
            yield out(*some)
            n += 1

    return written(vectors.select("id", "v").mapInArrow(run, _FILE), "vectors")


def _tiles(queries: DataFrame, tiles: int) -> DataFrame:
    """(tile, qdim, qids, qexact): the queries of a tile and dimension as one row; a tile holds about QUERY_TILE."""

    def gather(table: pa.Table) -> pa.Table:
        by_dim: dict[int, tuple[list[int], list[list[int]]]] = {}
        for i, v in zip(table["id"].to_pylist(), table["v"].to_pylist(), strict=True):
            some = by_dim.setdefault(len(v), ([], []))
            some[0].append(i)
            some[1].append(v)
        tile = pa.array([table["tile"][0].as_py()] * len(by_dim), pa.int32())
        blob = lambda k: pa.array([np.array(x[k], "<i8").tobytes() for x in by_dim.values()], pa.binary())
        return pa.table({"tile": tile, "qdim": pa.array(list(by_dim), pa.int32()), "qids": blob(0), "qexact": blob(1)})

    return queries.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).groupBy("tile").applyInArrow(gather, "tile int, qdim int, qids binary, qexact binary")


def survivors(file: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, block, place, lower, upper) of the candidates that the cells do not rule out, by one scan of them."""
    spark = file.sparkSession
    tiles = max(1, -(-queries.count() // QUERY_TILE))
    groups = max(1, min(partitions(spark), file.count()))
    # the cells, which are most of the file, move once; the queries, which are few, are handed to every group of blocks
    asked = _tiles(queries, tiles).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = file.select("block", "dim", "ids", "low", "width", "cells", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"))
    meet = (cells["g"] == asked["g"]) & (cells["dim"] == asked["qdim"])
    pairs = cells.join(asked.hint("merge"), meet).select("tile", "dim", "block", "ids", "low", "width", "cells", "qids", "qexact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}  # each query's k highest lower bounds so far
        for batch in batches:
            for row in range(batch.num_rows):
                tile, dim, block, ids, low, width, cells, qids, qexact = (batch.column(c)[row].as_py() for c in range(9))
                cid, qid = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                low, width, cells = np.frombuffer(low, "<i8"), np.frombuffer(width, "<i8"), np.frombuffer(cells, np.uint8).reshape(-1, dim)
                q = np.frombuffer(qexact, "<i8").reshape(-1, dim)
                if (tile, dim) not in best:
                    if len(best) >= HELD_TILES:
                        best.clear()
                    best[tile, dim] = np.full((len(qid), k), -np.inf)
                known = best[tile, dim]
                for at in range(0, len(qid), QUERIES_AT_ONCE):
                    to = slice(at, at + QUERIES_AT_ONCE)
                    lower, slack = bounds(q[to], low, width, cells)
                    lower[qid[to, None] == cid[None, :]] = -np.inf
                    some = np.concatenate([known[to], lower], axis=1)
                    known[to] = np.partition(some, some.shape[1] - k, axis=1)[:, -k:]
                    a, b = np.nonzero((lower + slack[:, None] >= known[to].min(1)[:, None]) & np.isfinite(lower))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(qid[to][a]), pa.array(np.full(len(a), block)), pa.array(b.astype(np.int32)), pa.array(lower[a, b]), pa.array(lower[a, b] + slack[a])], ["query_id", "block", "place", "lower", "upper"])

    return pairs.mapInArrow(run, "query_id long, block long, place int, lower double, upper double")


def _read(file: DataFrame, left: DataFrame, queries: DataFrame, k: int, reads: Accumulator | None) -> DataFrame:
    """(query_id, vec_id, score): the k best exact products of each block, read in the order of the bounds."""
    hot = hot_keys(left, ["block"], HOT_SURVIVORS)
    is_hot = F.xxhash64("block").isin(hot) if hot else F.lit(False)
    asked = left.join(queries.select(F.col("id").alias("query_id"), "v"), "query_id")
    asked = asked.select("block", F.when(is_hot, F.pmod(F.xxhash64("query_id"), F.lit(HOT_PARTS))).otherwise(0).cast("int").alias("s"), F.lit(1).alias("kind"), "query_id", (-F.col("upper")).alias("order"), "place", "v", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("exact"))
    parts = F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(HOT_PARTS - 1)).otherwise(F.lit(0))))
    wanted = file.select("block", "ids", "exact").join(left.select("block").distinct(), "block", "left_semi")
    stored = wanted.select("block", parts.alias("s"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("order"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<bigint>").alias("v"), "ids", "exact")

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = exact = None
        now, mine, scores, sure = None, np.empty(0, np.int64), np.empty(0, np.int64), False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), now)), pa.array(mine), pa.array(scores)], ["query_id", "vec_id", "score"])

        for batch in batches:
            skip = batch.column(2).to_pylist().count(0)
            if skip:
                ids = np.frombuffer(batch.column(7)[0].as_py(), "<i8")
                exact = np.frombuffer(batch.column(8)[0].as_py(), "<i8").reshape(len(ids), -1)
            rows = batch.slice(skip)
            if ids is None or not rows.num_rows:
                continue
            query, upper, place = rows.column(3).to_numpy(), -rows.column(4).to_numpy(), rows.column(5).to_numpy()
            v = rows.column(6).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            edge = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if query[lo] != now:
                    if len(mine):
                        yield out()
                    now, mine, scores, sure = int(query[lo]), np.empty(0, np.int64), np.empty(0, np.int64), False
                for at in range(lo, hi, READ):
                    if sure or (len(scores) == k and upper[at] < scores[-1]):
                        sure = True
                        break
                    here = place[at : min(at + READ, hi)]
                    if reads is not None:
                        reads.add(len(here))
                    mine, scores = np.concatenate([mine, ids[here]]), np.concatenate([scores, exact[here] @ v[lo]])
                    best = np.lexsort([mine, -scores])[:k]
                    mine, scores = mine[best], scores[best]
        if len(mine):
            yield out()

    n = partitions(file.sparkSession)
    return by_group(stored.union(asked), ["block", "s"], ["kind", "query_id", "order", "place"], Spread(n, n), fn, "query_id long, vec_id long, score long")


def exact_topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, reads: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Queries are the rows where is_query holds; candidates are all rows of the same dimension with another id. Fewer
    candidates than k give fewer rows. A query id that occurs more than once is asked once, with its smallest vector;
    repeated candidates each count. Rows that `quantised` leaves out take no part. Products must fit 64 bits. reads,
    where given, counts the exact vectors that were read.
    """
    queries = written(quantised(df.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    file = vector_file(without_spare_copies(quantised(df, id_col, vector_col, scale), k))
    found = written(survivors(file, queries, k), "survivors")
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    least = found.select("query_id", "lower", kth.alias("_r")).where(F.col("_r") <= k).where(F.col("_r") == k).select("query_id", F.col("lower").alias("least"))
    left = written(found.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query_id", "block", "place", "upper"), "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _read(file, left, queries, k, reads).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
