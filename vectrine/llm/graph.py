"""Connected components and sorted-group passes, both without collecting a group or a graph anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectrine.llm.common import written


#: Edges or labels of one file.
FILE_ROWS = 500_000
#: A key is hot that holds over one HOT_SHARE-th of the rows, and over HOT_ROWS of them: at most HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1000, 100


def hot_keys(df: DataFrame, keys: list[str], least: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys of df that hold over one HOT_SHARE-th of its rows and over `least` of them, at most HOT_SHARE
    whatever its size; null keys are none. Counted in partial sums."""
    total = df.count()
    if total <= least:
        return []
    return hot_of(df.where(_known(keys)).groupBy(*keys).agg(F.count("*").alias("n")), keys, total, least)


def hot_of(counted: DataFrame, keys: list[str], total: int, least: int = HOT_ROWS) -> list[int]:
    """`hot_keys` where the rows of each key are counted already, as n."""
    found = counted.where(F.col("n") > max(least, total // HOT_SHARE)).orderBy(F.desc("n")).limit(HOT_SHARE)
    return sorted(r["h"] for r in found.select(F.xxhash64(*keys).alias("h")).collect())


def _known(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """left joined (inner or left) with right, which has each key once, without a task that gets all rows of a hot key.

    The left rows of hot keys stay where they are and meet the right rows of those keys by a broadcast of at most
    HOT_SHARE rows (and the few that share their hash); left rows with a null key meet nothing and are not moved
    either. All others take the ordinary join. left and right are read more than once, so they should be cheap to read.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    fields = [f for f in right.schema if f.name not in keys]
    order = [*keys, *[c for c in left.columns if c not in keys], *[f.name for f in fields]]
    known = left.where(_known(keys))
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    out = known.where(~is_hot).join(right.where(~is_hot), keys, how).select(*order) if hot else known.join(right, keys, how).select(*order)
    if hot:
        out = out.unionByName(known.where(is_hot).join(F.broadcast(right.where(is_hot)), keys, how).select(*order))
    if how == "left":
        alone = left.where(~_known(keys)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        out = out.unionByName(alone.select(*order))
    return out


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the smallest vertex that v is connected with.

    Smallest labels flow along edges, then every label is replaced by its own label, until nothing changes; the jump
    makes long chains short. Minima are combined before they move, and the two joins of a round are `spread_join`s, so
    neither a vertex with very many edges nor a label that very many vertices have is one task's group. Each round is
    written, which cuts its lineage; `about` is the number of rows to expect.
    """
    files = None if about is None else -(-about // FILE_ROWS)
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.select(F.inline(ends)).distinct(), "edges", files)
    state = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels", files)
    busy = hot_keys(both, ["b"])
    while True:
        labels = state.select("v", "label")
        beside = spread_join(both, labels.select(F.col("v").alias("b"), "label"), ["b"], hot=busy)
        near = beside.groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        moved = written(labels.join(near, "v", "left").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label")), "moved", files)
        jump = moved.select(F.col("v").alias("label"), F.col("label").alias("to"))
        state = written(spread_join(moved, jump, ["label"]).select("v", "was", F.least("label", "to").alias("label")), "labels", files)
        if state.where(F.col("label") != F.col("was")).isEmpty():
            return state.select("v", "label")


class Spread(NamedTuple):
    """Partitions that groups are dealt to, and tasks that work through them at most."""

    partitions: int
    tasks: int


def by_group(df: DataFrame, keys: list[str], order: list[str], spread: Spread, fn: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Calls fn(key, batches) for each group of the keys, which come first in df's columns.

    Rows are dealt out by key and sorted; a task streams them, so many small groups share a batch and a group of any
    size reaches fn as a run of batches rather than one table. fn must use its batches up before it returns.
    """
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = list(zip(*(batch.column(c).to_pylist() for c in range(k)), strict=True))
                at = 0
                for i in range(1, len(rows) + 1):
                    if i == len(rows) or rows[i] != rows[at]:
                        yield rows[at], batch.slice(at, i - at)
                        at = i

        stream = parts()
        head = next(stream, None)
        while head is not None:
            key, after = head[0], []

            def group(first: pa.RecordBatch = head[1], key: tuple = key, after: list = after) -> Iterator[pa.RecordBatch]:
                yield first
                for other, part in stream:
                    if other != key:
                        after.append((other, part))
                        return
                    yield part

            own = group()
            yield from fn(key, own)
            for _ in own:
                pass
            head = after[0] if after else None
        pa.default_memory_pool().release_unused()  # a worker that waits holds little

    return df.repartition(spread.partitions, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema).coalesce(spread.tasks)
