"""Exact and partition-pruned vector search.

One query is a constant in the plan: the score is a projection over one scan and the result a TakeOrderedAndProject.
Many queries meet the vectors in packed blocks through an equi-join, are scored by matrix products over Arrow
batches, and only each block's best rows leave it. Ties always go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.session import written

#: Rows of a packed block.
BLOCK = 2048
#: Queries whose best rows a task holds while it reads blocks.
HELD = 1 << 16
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": V.cosine,
    "cosine_smoothed": V.cosine_smoothed,
    "ip": V.dot,
    "l2": lambda a, b: V.distance_score(V.euclidean(a, b)),
    "squared_l2": lambda a, b: V.distance_score(V.squared_l2(a, b)),
    "l1": lambda a, b: V.distance_score(V.manhattan(a, b)),
}


def vector_of(df: DataFrame, item: int | str, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """One row's vector, brought to the driver to be a constant; a missing id raises KeyError."""
    found = df.where(F.col(id_col) == item).select(V.doubles(F.col(vector_col)).alias("v")).limit(1).collect()
    if not found:
        raise KeyError(f"no row {item!r}")
    return list(found[0]["v"])


def scored(df: DataFrame, query: list[float], metric: str = "cosine", vector_col: str = "embedding") -> DataFrame:
    """df with its score against the query; rows without a vector are left out."""
    return df.where(F.col(vector_col).isNotNull()).withColumn("score", METRICS[_known(metric)](F.col(vector_col), V.literal(query)))


def topk(df: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", threshold: float | None = None, where: Column | None = None, exclude: int | str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows, score descending, ids ascending. The filter and the exclusion come before scoring, the
    threshold (>=) before the cut."""
    rows = df if where is None else df.where(where)
    rows = rows if exclude is None else rows.where(F.col(id_col) != exclude)
    rows = scored(rows, query, metric, vector_col)
    rows = rows if threshold is None else rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def topk_post_filtered(df: DataFrame, query: list[float], k: int, where: Column, fetch: int = 3, **how: object) -> DataFrame:
    """Fetches fetch * k rows first and filters then, so fewer than k may be left."""
    found = topk(df, query, fetch * k, **how)
    return found.where(where).orderBy(F.desc("score"), F.asc(str(how.get("id_col", "vec_id")))).limit(k)


def threshold_sweep(df: DataFrame, query: list[float], thresholds: list[float], metric: str = "cosine") -> DataFrame:
    """(threshold, n, best): how many rows reach each threshold, in one pass and one aggregation."""
    rows = scored(df, query, metric).select("score", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.sum(hit.cast("long")).alias("n"), F.max(F.when(hit, F.col("score"))).alias("best"))


def packed(df: DataFrame, id_col: str, vector_col: str, rows: int = BLOCK, list_col: str | None = None) -> DataFrame:
    """(dim, list, ids, data): blocks of at most `rows` vectors of one dimension and list (0 without a list_col); null
    vectors and ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, v = part.column(0).to_numpy(), part.column(1)
                size, lists = v.value_lengths().to_numpy(), part.column(2).to_numpy()
                flat, edge = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
                for dim, own in np.unique(np.stack([size, lists], 1), axis=0):
                    here = np.flatnonzero((size == dim) & (lists == own))
                    data = flat[edge[here][:, None] + np.arange(dim)].astype("<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([int(own)], pa.int64()), pa.array([ids[here].astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["dim", "list", "ids", "data"])

    src = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    own = F.lit(0) if list_col is None else F.col(list_col)
    return src.select(F.col(id_col).cast("long"), V.doubles(F.col(vector_col)), own.cast("long")).mapInArrow(run, "dim int, list long, ids binary, data binary")


def _block(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, which have one dimension, as rows; no number becomes a Python object."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _squared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :], 0)


def _smoothed(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q @ v.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :] + V.EPSILON)


#: The metrics over blocks: all scores of queries (rows) and vectors (rows).
BLOCK_METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda q, v: _unit(q) @ _unit(v).T,
    "cosine_smoothed": _smoothed,
    "ip": lambda q, v: q @ v.T,
    "l2": lambda q, v: 1 / (1 + np.sqrt(_squared(q, v))),
    "squared_l2": lambda q, v: 1 / (1 + _squared(q, v)),
    "l1": lambda q, v: np.stack([1 / (1 + np.abs(v - x).sum(1)) for x in q]),
}


@dataclass(frozen=True)
class Products:
    """A metric over blocks of which a product of rows tells whether a score may reach a bar, so that most are ruled out by
    single-precision products and only the others are made exactly.

    asks gives of queries and their bars the rows that are multiplied and the least product; offers the rows of vectors;
    pairs the exact scores of queries and vectors side by side; all_pairs those of all rows.
    """

    asks: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    offers: Callable[[np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    all_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def __call__(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.all_pairs(q, v)


def near_rows(q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries whose squared distance must not pass -least: rows whose product with those of `far_rows` is minus the
    squared distance, and that least product."""
    return np.concatenate([2 * q, -(q * q).sum(1)[:, None], np.ones((len(q), 1))], 1), least


def far_rows(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.ones((len(v), 1)), -(v * v).sum(1)[:, None]], 1)


def squared_pairs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The squared distances of rows side by side, as `_squared` has them of all."""
    return np.maximum((q * q).sum(1) - 2 * np.einsum("ij,ij->i", q, v) + (v * v).sum(1), 0)


def _gap(s: np.ndarray) -> np.ndarray:
    """The distance d of a score 1 / (1 + d)."""
    with np.errstate(divide="ignore"):
        return 1 / np.maximum(s, 0) - 1


#: Metrics that blocks are searched by; others compare all pairs exactly.
FAST: dict[str, Products] = {
    "cosine": Products(lambda q, bar: (_unit(q), bar), _unit, lambda q, v: np.einsum("ij,ij->i", _unit(q), _unit(v)), BLOCK_METRICS["cosine"]),
    "ip": Products(lambda q, bar: (q, bar), lambda v: v, lambda q, v: np.einsum("ij,ij->i", q, v), BLOCK_METRICS["ip"]),
    "l2": Products(lambda q, bar: near_rows(q, -(_gap(bar) ** 2)), far_rows, lambda q, v: 1 / (1 + np.sqrt(squared_pairs(q, v))), BLOCK_METRICS["l2"]),
    "squared_l2": Products(lambda q, bar: near_rows(q, -_gap(bar)), far_rows, lambda q, v: 1 / (1 + squared_pairs(q, v)), BLOCK_METRICS["squared_l2"]),
}
#: Minus the squared distance.
NEAREST = Products(near_rows, far_rows, lambda q, v: -squared_pairs(q, v), lambda q, v: -_squared(q, v))
#: Rows of a block, at least, that give its queries their first bars.
SOME = 256
#: Rows of queries whose products with a block are made at once.
TILE = 256


def may_reach(metric: Products, q: np.ndarray, bar: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of queries and vectors that may score the query's bar, which is finite: every pair that does is
    there, and few others."""
    with np.errstate(over="ignore", invalid="ignore"):
        rows, least = metric.asks(q, bar)
        others = metric.offers(v)
        low, high = rows.astype(np.float32), others.astype(np.float32)
        # the sizes that a product is made of at most, of which rounding of both sides and of the sums may take a share
        sizes = np.abs(rows) @ np.abs(others).max(0, initial=0)
        if not (sizes < 1e37).all():  # too large or no numbers: nothing is ruled out
            return tuple(x.ravel() for x in np.indices((len(q), len(v))))
        least = np.maximum(least - (rows.shape[1] + 8) * 2.0**-23 * sizes, -3e38)
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        found, made = [], np.empty((TILE, len(v)), np.float32)
        for at in range(0, len(q), TILE):
            part = made[: len(q) - at]
            np.matmul(low[at : at + TILE], high.T, out=part)
            found.append(np.flatnonzero(part >= least[at : at + TILE, None]) + at * len(v))
    return np.divmod(np.concatenate(found), max(1, len(v))) if found else (np.empty(0, np.int64),) * 2


def _known(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; known: {sorted(METRICS)}")
    return metric


#: Scores that agree to nine digits are equal, and ids decide; so one this much lower may still be among the best.
EQUAL = 1e-9


def _cut(a: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query a, in its order: by the score to nine digits, then by id."""
    order = np.lexsort((ids, -np.floor(s / EQUAL + 0.5), a))
    a, ids, s = a[order], ids[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], ids[keep], s[keep]


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cosine", exclude_self: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k best of all vectors by one of METRICS, or by a function that gives
    the scores of query rows and vector rows; other names are refused.

    Query blocks meet vector blocks in the cells of a grid (`_meeting`), so neither side is broadcast; a task keeps a
    query's best rows over all blocks it reads (of `HELD` queries at a time), and ranks are taken over those.
    """
    q = written(packed(queries, id_col, vector_col), "blocks")
    v = q if vectors is queries else written(packed(vectors, id_col, vector_col), "blocks")
    return _block_best(q, v, _grid(q, v, _groups(queries), k), k, metric, exclude_self)


def knn_by_list(queries: DataFrame, vectors: DataFrame, k: int, list_col: str, metric: str = "cosine", exclude_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, list, vec_id, score, rank): each query's k best within every list of the vectors (a long), in one
    pass over the vectors however many lists there are."""
    return _block_best(packed(queries, id_col, vector_col), packed(vectors, id_col, vector_col, list_col=list_col), (1, _groups(queries)), k, metric, exclude_self, by_list=True)


def _groups(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a row that leaves a task, to weigh it against a vector that is sent to one.
ROW_BYTES = 32


def _grid(queries: DataFrame, vectors: DataFrame, cells: int, k: int = 0) -> tuple[int, int]:
    """Into how many groups written blocks of queries and of vectors are dealt, so that about so many cells result and
    the least is moved: a query goes to each group of vectors and gets k rows from it, a vector to each of queries. Few
    blocks fill few groups, so there are twice as many groups as blocks at most."""
    size = lambda blocks: blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("b")).first()
    q, v = size(queries), size(vectors)
    asked = q["b"] + q["n"] // 8 * k * ROW_BYTES
    for_vectors = min(cells, max(1, round((cells * v["b"] / max(1, asked)) ** 0.5)))
    for_queries = min(-(-cells // for_vectors), max(1, 2 * q["blocks"]))
    return for_queries, min(-(-cells // for_queries), max(for_vectors, 1), max(1, 2 * v["blocks"]))


def _meeting(queries: DataFrame, vectors: DataFrame, grid: tuple[int, int], keys: list[str]) -> DataFrame:
    """(dim, ids, data, qids, qdata, list): each query block beside each vector block of the same keys, by an equi-join on
    the cells of a grid of groups of queries and of vectors. Blocks are far larger than the files that Spark judges a
    table by, so the join is never to be a broadcast."""
    rows, columns = grid
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(*keys, F.col("ids").alias("qids"), F.col("data").alias("qdata"), group(rows).alias("r")).withColumn("c", each(columns))
    v = vectors.withColumn("c", group(columns)).withColumn("r", each(rows))
    return v.join(q.hint("merge"), [*keys, "r", "c"]).select("dim", "ids", "data", "qids", "qdata", "list")


def block_pairs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(dim, ids, data, lids, ldata, same): each unordered pair of packed blocks of one dimension once, and where `same`
    in both orders, each block beside itself included.

    Blocks are dealt into groups, and the pairs of groups, about as many as shuffle partitions, are the keys of an
    equi-join; a block is copied for each group, so copies grow with the root of the partitions. Never a broadcast.
    """
    n = int(np.ceil((np.sqrt(8 * _groups(df) + 1) - 1) / 2))
    blocks = packed(df, id_col, vector_col).withColumn("b", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    rows = blocks.withColumn("p", F.explode(meet)).select("dim", "p.i", "p.j", "b", "ids", "data")
    left = rows.where("b = i").select("dim", "i", "j", F.col("ids").alias("lids"), F.col("data").alias("ldata"))
    return rows.where("b = j").join(left.hint("merge"), ["dim", "i", "j"]).select("dim", "ids", "data", "lids", "ldata", (F.col("i") == F.col("j")).alias("same"))


def best_between_blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, read: Callable) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k best vectors of written blocks; `read` gives a query block's ids and
    vectors, and (place of the query, vector id) of what is left out of its results."""
    return _block_best(queries, vectors, _grid(queries, vectors, _groups(queries), k), k, metric, False, without=read)


def _wanted(qid: np.ndarray, vid: np.ndarray, exclude_self: bool) -> np.ndarray:
    return qid != vid if exclude_self else np.ones(len(qid), bool)


def _is_left_out(a: np.ndarray, vid: np.ndarray, left_out: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Whether the query of place a leaves out the vector, of (names, sorted keys of place and name)."""
    if left_out is None or not len(left_out[0]):
        return np.zeros(len(a), bool)
    names, keys = left_out
    at = np.minimum(np.searchsorted(names, vid), len(names) - 1)
    key = a * len(names) + at
    return (names[at] == vid) & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)


def _over(s: np.ndarray, bar: np.ndarray, k: int, places: np.ndarray, qid: np.ndarray, vid: np.ndarray, exclude_self: bool, left_out: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vector id, score) of the scores of some queries and a block that reach the bars; of a query
    without one, those that are among the k best of the block."""
    s[~np.isfinite(s)] = -np.inf
    if left_out is not None and len(left_out[0]):
        names, keys = left_out
        user, name = np.divmod(keys, len(names))
        order = np.argsort(vid, kind="stable")
        row = np.full(len(qid), -1)
        row[places] = np.arange(len(places))
        user, item = row[user], names[name]
        user, item = user[user >= 0], item[user >= 0]
        first = np.searchsorted(vid[order], item)
        n = np.searchsorted(vid[order], item, "right") - first  # an id may stand twice
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s[np.repeat(user, n), order[at]] = -np.inf
    if exclude_self and len(own_at := np.flatnonzero(np.isin(vid, qid[places]))):
        s[:, own_at] = np.where(qid[places][:, None] == vid[None, own_at], -np.inf, s[:, own_at])
    if np.isneginf(bar).any() and s.shape[1]:
        n = min(k, s.shape[1])
        bar = np.maximum(bar, np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n])
    a, b = np.nonzero((s >= bar[:, None] - EQUAL) & (s > -np.inf))
    return places[a], vid[b], s[a, b]


def _block_best(queries: DataFrame, vectors: DataFrame, grid: tuple[int, int], k: int, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray], exclude_self: bool, by_list: bool = False, without: Callable | None = None) -> DataFrame:
    """The k best of each query among the packed vectors of its lists, whose blocks meet in the cells of the grid; with
    by_list the k best of each list, for every query. A score that the k-th best of a query so far already passes is
    dropped by one comparison. without reads query blocks of which each row leaves some vectors out."""
    scores = metric if callable(metric) else FAST.get(_known(metric), BLOCK_METRICS[metric])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        more: dict[tuple[bytes, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        bars: dict[tuple[bytes, int], np.ndarray] = {}
        left_out: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def cut(key: tuple[bytes, int]) -> None:
            """Takes what was found of late among the best."""
            n = len(key[0]) // 8
            best[key] = _cut(*map(np.concatenate, zip(*([best[key]] if key in best else []), *more.pop(key), strict=True)), k)
            a, _, s = best[key]
            first, end = np.searchsorted(a, np.arange(n)), np.searchsorted(a, np.arange(n), "right")
            bars[key] = np.where(end - first >= k, np.append(s, -np.inf)[np.minimum(first + k - 1, len(s))], -np.inf)

        def search(key: tuple[bytes, int], qid: np.ndarray, y: np.ndarray, vid: np.ndarray, x: np.ndarray) -> None:
            """Adds what a block, or some rows of one, has for a block of queries."""
            qids, bar = key[0], bars[key]
            new = np.flatnonzero(np.isneginf(bar)) if isinstance(scores, Products) else np.arange(len(qid))
            found = []
            if len(new):
                some = y[new] if len(new) < len(qid) else y
                found.append(_over(scores(some, x), bar[new], k, new, qid, vid, exclude_self, left_out.get(qids)))
            if len(new) < len(qid):
                old = np.flatnonzero(~np.isneginf(bar))
                a, b = may_reach(scores, y[old], bar[old] - EQUAL, x)
                a = old[a]
                keep = _wanted(qid[a], vid[b], exclude_self) & ~_is_left_out(a, vid[b], left_out.get(qids))
                a, b = a[keep], b[keep]
                s = np.concatenate([np.empty(0), *(scores.pairs(y[a[at : at + HELD]], x[b[at : at + HELD]]) for at in range(0, len(a), HELD))])
                keep = np.isfinite(s) & (s >= bar[a] - EQUAL)
                found.append((a[keep], vid[b[keep]], s[keep]))
            more.setdefault(key, []).extend(found)
            # the best of a block are sorted anew only when as many again have come
            if key not in best or len(new) or 2 * sum(len(f[0]) for f in more[key]) > len(best[key][0]):
                cut(key)

        def out() -> Iterator[pa.RecordBatch]:
            for key in list(more):
                cut(key)
            for (qids, own), (a, vid, s) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(qids, "<i8")[a]), pa.array(vid), pa.array(s), pa.array(np.full(len(a), own))], ["query_id", "vec_id", "score", "list"])
            for kept in (best, bars, left_out):
                kept.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, qids, qdata, own = (batch.column(c)[row].as_py() for c in range(6))
                vid, x = _block(dim, ids, data)
                qid, y, *out_of = without(dim, qids, qdata) if without else _block(dim, qids, qdata)
                key = qids, own if by_list else 0
                if key not in bars:
                    if held + len(qid) > HELD:
                        yield from out()
                        held = 0
                    held += len(qid)
                    bars[key] = np.full(len(qid), -np.inf)
                if out_of and qids not in left_out:
                    names = np.unique(out_of[1])
                    left_out[qids] = names, np.unique(out_of[0] * len(names) + np.searchsorted(names, out_of[1]))
                # a query without a bar gets one from some rows of its first block, if it asks for few
                fast = isinstance(scores, Products)
                some = max(SOME, 8 * k)
                parts = (0, some, len(vid)) if fast and len(vid) > 4 * some and np.isneginf(bars[key]).any() else (0, len(vid))
                for lo, hi in zip(parts, parts[1:], strict=False):
                    search(key, qid, y, vid[lo:hi], x[lo:hi] if fast else x)
        yield from out()

    pairs = _meeting(queries, vectors, grid, ["dim"] if by_list else ["dim", "list"])
    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double, list long")
    names = ["query_id", "list"] if by_list else ["query_id"]
    order = Window.partitionBy(*names).orderBy(F.desc(F.round("score", 9)), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*names, "vec_id", "score", "rank")


def _met(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The packed blocks of both tables beside each other, written once to know their size."""
    q, v = (written(packed(x, id_col, vector_col), "blocks") for x in (queries, vectors))
    return _meeting(q, v, _grid(q, v, _groups(queries)), ["dim", "list"])


def all_scores(queries: DataFrame, vectors: DataFrame, metric: str | tuple[str, ...] = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score) of every query and vector, the diagonal included: the cells of a similarity matrix,
    which are the result. They are made block by block where they lie; several metrics are columns of their names, made
    side by side, so that no cell is shuffled."""
    names = (metric,) if isinstance(metric, str) else metric
    columns = ["score"] if isinstance(metric, str) else list(names)
    made = [BLOCK_METRICS[_known(m)] for m in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, qids, qdata = (batch.column(c)[row].as_py() for c in range(5))
                (vid, x), (qid, y) = _block(dim, ids, data), _block(dim, qids, qdata)
                for at in range(0, len(qid), 64):
                    part = y[at : at + 64]
                    scores = [pa.array(f(part, x).ravel()) for f in made]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + 64], len(vid))), pa.array(np.tile(vid, len(part))), *scores], ["query_id", "vec_id", *columns])

    pairs = _met(queries, vectors, id_col, vector_col)
    return pairs.mapInArrow(run, "query_id long, vec_id long, " + ", ".join(f"{c} double" for c in columns))


def score_bounds(queries: DataFrame, vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, lo, hi): the least and the highest score of each query among all vectors; a row a block leaves a task."""
    scores = BLOCK_METRICS[_known(metric)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, qids, qdata = (batch.column(c)[row].as_py() for c in range(5))
                (_, x), (qid, y) = _block(dim, ids, data), _block(dim, qids, qdata)
                s = scores(y, x)
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(s.min(1)), pa.array(s.max(1))], ["query_id", "lo", "hi"])

    pairs = _met(queries, vectors, id_col, vector_col)
    return pairs.mapInArrow(run, "query_id long, lo double, hi double").groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def similar_pairs(df: DataFrame, threshold: float, strict: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b and cosine >= threshold (> if strict), by products of packed blocks.

    Every unordered pair of blocks meets once (`block_pairs`); only pairs that pass leave a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, lids, ldata, same = (batch.column(c)[row].as_py() for c in range(6))
                (x, v), (y, w) = _block(dim, ids, data), _block(dim, lids, ldata)
                i, j = may_reach(FAST["cosine"], w, np.full(len(w), threshold), v)
                a, b = y[i], x[j]
                keep = a < b if same else a != b  # blocks of one number meet in both orders
                i, j, a, b = i[keep], j[keep], a[keep], b[keep]
                s = np.concatenate([np.empty(0), *(FAST["cosine"].pairs(w[i[at : at + HELD]], v[j[at : at + HELD]]) for at in range(0, len(i), HELD))])
                keep = s > threshold if strict else s >= threshold
                a, b, s = a[keep], b[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a", "b", "score"])

    return block_pairs(df, id_col, vector_col).mapInArrow(run, "a long, b long, score double")


def pairs_between(some: DataFrame, others: DataFrame, threshold: float, strict: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b of the vectors of two tables that share no id, as `similar_pairs` of their union would
    give for pairs across them; only blocks of different tables meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, qids, qdata = (batch.column(c)[row].as_py() for c in range(5))
                (vid, x), (qid, y) = _block(dim, ids, data), _block(dim, qids, qdata)
                s = _unit(y) @ _unit(x).T
                i, j = np.nonzero(s > threshold if strict else s >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(qid[i], vid[j])), pa.array(np.maximum(qid[i], vid[j])), pa.array(s[i, j])], ["a", "b", "score"])

    return _met(some, others, id_col, vector_col).mapInArrow(run, "a long, b long, score double")


def pairwise_l2(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(pairs, mean, least, most): of the L2 distances of all unordered pairs, by products of blocks; a row a pair of
    blocks leaves a task. Fewer than two vectors have no pair: 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, lids, ldata, same = (batch.column(c)[row].as_py() for c in range(6))
                (vid, x), (lid, y) = _block(dim, ids, data), _block(dim, lids, ldata)
                d = np.sqrt(_squared(y, x))
                d = d[lid[:, None] < vid[None, :] if same else lid[:, None] != vid[None, :]]
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array([len(d)], pa.int64()), *(pa.array([float(f(d))]) for f in (np.sum, np.min, np.max))], ["n", "s", "lo", "hi"])

    found = block_pairs(df, id_col, vector_col).mapInArrow(run, "n long, s double, lo double, hi double")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.min("lo").alias("least"), F.max("hi").alias("most"))


def group_similarity(df: DataFrame, group_col: str, vector_col: str = "embedding") -> DataFrame:
    """(a, b, mean_similarity) of every two groups: the mean over all pairs of their rows, without making a pair.

    The mean cosine of two groups is the product of their mean unit vectors, so one aggregation by group and place is
    all that grows with the data; the pairs made are pairs of groups.
    """
    means = mean_vectors(df.withColumn("_u", V.normalize(F.col(vector_col))), group_col, "_u")
    left = means.select(F.col(group_col).alias("a"), F.col("centroid").alias("u"), F.lit(0).alias("one"))
    right = means.select(F.col(group_col).alias("b"), F.col("centroid").alias("v"), F.lit(0).alias("one"))
    return left.join(right, "one").select("a", "b", V.dot(F.col("u"), F.col("v")).alias("mean_similarity"))


def mean_vectors(df: DataFrame, group_col: str, vector_col: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(group, centroid, n): the (weighted) mean vector of each group, by partial sums over (group, place).

    A group with no positive weight gets zeros.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    at = df.where(F.col(vector_col).isNotNull()).select(group_col, w.alias("_w"), F.posexplode(V.doubles(F.col(vector_col))).alias("_at", "_x"))
    sums = at.groupBy(group_col, "_at").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.sum("_w").alias("_n"))
    value = F.when(F.col("_n") > 0, F.try_divide("_s", "_n")).otherwise(0.0)
    ordered = F.array_sort(F.collect_list(F.struct("_at", value.alias("_v"))))
    return sums.groupBy(group_col).agg(F.transform(ordered, lambda x: x["_v"]).alias("centroid"), F.max("_n").alias("n"))


# --- inverted lists


def assign(df: DataFrame, centroids: list[tuple[int, list[float]]], vector_col: str = "embedding") -> DataFrame:
    """df with the cluster_id of its nearest centroid by L2; ties to the first. Centroids are a trained, fixed set."""
    ranked = F.array(*[F.struct(V.squared_l2(F.col(vector_col), V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in centroids])
    return df.where(F.col(vector_col).isNotNull()).withColumn("cluster_id", F.array_min(ranked)["i"])


def train_centroids(df: DataFrame, nlist: int, seed: int = 42, vector_col: str = "embedding") -> list[tuple[int, list[float]]]:
    """k-means centroids; nlist of them reach the driver, whatever the number of vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=nlist, seed=seed, featuresCol="_f").fit(df.select(array_to_vector(V.doubles(F.col(vector_col))).alias("_f")))
    return [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]


def probe(centroids: list[tuple[int, list[float]]], query: list[float], nprobe: int) -> list[int]:
    """The nprobe lists whose centroids are nearest to the query by cosine."""
    q = np.array(query)
    cos = [(-float(np.dot(q, c) / (np.linalg.norm(q) * np.linalg.norm(c) + 1e-10)), i) for i, c in centroids]
    return [i for _, i in sorted(cos)[:nprobe]]


def ivf_search(assigned: DataFrame, centroids: list[tuple[int, list[float]]], query: list[float], k: int, nprobe: int, id_col: str = "vec_id") -> DataFrame:
    """Searches the nprobe best lists only. The lists are a literal filter on cluster_id, so a table written by
    partitionBy("cluster_id") reads no other files."""
    return topk(assigned, query, k, "cosine_smoothed", where=F.col("cluster_id").isin(probe(centroids, query, nprobe)), id_col=id_col)


def ivf_knn(assigned: DataFrame, queries: DataFrame, centroids: list[tuple[int, list[float]]], k: int, nprobe: int, exclude_self: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): `knn` by cosine where each query meets its nprobe best lists only.

    Blocks of one list meet the queries that probe it by an equi-join; a list's blocks are dealt over groups, so one
    long list is not one task. Recall grows with nprobe and is 1 when all lists are probed.
    """
    near = F.array(*[F.struct((-V.cosine_smoothed(F.col(vector_col), V.literal(c))).alias("d"), F.lit(i).alias("i")) for i, c in centroids])
    probed = queries.where(F.col(vector_col).isNotNull()).withColumn("_l", F.explode(F.slice(F.array_sort(near), 1, nprobe)["i"]))
    grid = 1, -(-_groups(queries) // max(1, len(centroids)))
    return _block_best(packed(probed, id_col, vector_col, list_col="_l"), packed(assigned, id_col, vector_col, list_col="cluster_id"), grid, k, "cosine", exclude_self)


def ivf_lists_l2(lists: DataFrame, queries: DataFrame, centroids: list[tuple[int, list[float]]], k: int, nprobe: int, exclude_self: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k best by 1 / (1 + squared L2) in the nprobe lists whose centroids
    are nearest to it, out of a table that `write_lists` wrote.

    The lists that any query probes are found first and joined to the table's partition column, so at run time Spark
    reads the folders of those lists only; they are as many as centroids at most. Each list's blocks then meet the
    queries that probe it.
    """
    near = F.array(*[F.struct(V.squared_l2(F.col(vector_col), V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in centroids])
    probed = queries.where(F.col(vector_col).isNotNull()).withColumn("_l", F.explode(F.slice(F.array_sort(near), 1, nprobe)["i"]))
    wanted = probed.select(F.col("_l").alias("cluster_id")).distinct().where("cluster_id >= 0")
    read = lists.join(F.broadcast(wanted), "cluster_id", "left_semi")
    grid = 1, -(-_groups(queries) // max(1, len(centroids)))
    return _block_best(packed(probed, id_col, vector_col, list_col="_l"), packed(read, id_col, vector_col, list_col="cluster_id"), grid, k, "squared_l2", exclude_self)


def recall(found: DataFrame, exact: DataFrame) -> float | None:
    """Share of the exact search's (query_id, vec_id) rows that were found, as a mean over its queries."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("r")).first()["r"]


def write_lists(assigned: DataFrame, path: str) -> None:
    """One directory for each inverted list."""
    assigned.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(path)
