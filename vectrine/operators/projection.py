"""t-SNE in rounds: neighbours by the block-wise search, attraction along the edges of their graph, repulsion by a grid.

A round is one pass: points are dealt into parts, of which each is one row, with its points and its edges, and reads
where all points lay at the round's start; for repulsion, others are known as the counts and means of grid cells, of
which there is a fixed number. Each point takes a few gradient steps against these, then all positions are written and
the cells are counted anew; so the map does not depend on how points are dealt. Edges are packed once and no edge is a
row of a round; what moves in one is the points' places, once for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import learn, search
from vectrine.session import written

#: Points of a part at most and, where tasks would be few, at least; cells along a side of the grid.
PART, LEAST, GRID = 16384, 512, 64
#: Bytes of a point, and of its id and place alone.
POINT, FAR = 56, 24


def affinities(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """The chance of each neighbour of each point (rows) by a Gaussian whose width gives the perplexity, by bisection of
    its precision for all points at once."""
    d = distances - distances[:, :1]
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    beta = 1 / np.maximum(d.mean(1), 1e-12)
    goal = np.log(min(perplexity, d.shape[1]))
    for _ in range(64):
        w = np.exp(-d * beta[:, None])
        s = w.sum(1)
        entropy = np.log(s) + beta * (d * w).sum(1) / s
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    w = np.exp(-d * beta[:, None])
    return w / w.sum(1, keepdims=True)


def _edges(rows: DataFrame, n: int, perplexity: float, id_col: str, vector_col: str) -> DataFrame:
    """(a, b, p) in both directions: the mean of both points' chances, over all points one in sum."""
    k = max(1, min(n - 1, int(3 * perplexity)))
    near = search.knn(rows, rows, k, search.NEAREST, id_col=id_col, vector_col=vector_col)
    lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))).alias("l"))
    lists = lists.select("query_id", F.col("l.vec_id").alias("ids"), F.col("l.d").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = search.matrix(batch.column(2))
                ids = batch.column(1).flatten()
                a = np.repeat(batch.column(0).to_numpy(), d.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(a), ids, pa.array((affinities(d, perplexity) / (2 * n)).ravel())], ["a", "b", "p"])

    one = written(lists.mapInArrow(run, "a long, b long, p double"), "chances")
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).groupBy("a", "b").agg(F.sum("p").alias("p"))


def tsne(df: DataFrame, perplexity: float = 30.0, rounds: int = 60, steps: int = 5, early: float = 12.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, y): a map in which near vectors lie near, from the first two principal axes on.

    The first quarter of the rounds exaggerates attraction by `early`. The step is that of one point in `early` times
    four, 50 at least, with momentum and gains. It approximates what one process would do: other points are seen as
    cell means, and the ends of edges as of the round's start; a test holds how many neighbours it keeps against the plain
    method. ids are longs, each once; rows without a vector are left out. Fewer than three rows lie at the origin.
    """
    rows = written(df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), V.doubles(F.col(vector_col)).alias(vector_col)), "rows")
    n = rows.count()
    if n < 3:
        return rows.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    parts = max(-(-n // PART), min(-(-n // LEAST), 2 * df.sparkSession.sparkContext.defaultParallelism))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    edges = _edges(rows, n, perplexity, id_col, vector_col).select(part("a").alias("part"), part("b").alias("other"), "a", "b", "p")
    edges = written(edges.repartition(parts, "part").sortWithinPartitions("part", "other").mapInArrow(_blobs(_edge_blob), "part int, data binary"), "edges")
    points, _ = learn.pca(rows, 2, id_col, vector_col)
    points = points.select(part(id_col).alias("part"), F.col(id_col).alias("a"), F.get("point", F.lit(0)).alias("x"), F.coalesce(F.get("point", F.lit(1)), F.lit(0.0)).alias("y"))
    spread = points.agg(F.stddev_pop("x")).first()[0] or 1.0
    first = points.select("part", "a", (F.col("x") / spread * 1e-4).alias("x"), (F.col("y") / spread * 1e-4).alias("y"))
    state = written(first.repartition(parts, "part").sortWithinPartitions("part", "a").mapInArrow(_blobs(_point_blob), "part int, data binary"), "state")
    rate = max(n / early / 4, 50.0)
    side = 4e-4 / GRID  # of a cell; follows the width of the map
    none = F.lit(None).cast("binary")
    for turn in range(rounds):
        cells, used = _cells(state, side), side
        side = max(float(np.ptp(cells[:, 3:], axis=0).max()), 1e-4) * 1.2 / GRID
        exaggerated, momentum = (early, 0.5) if turn < rounds // 4 else (1.0, 0.8)
        # a part needs its edges, its own points whole, and where all others' points lie
        own = edges.select(F.col("part").alias("at"), F.lit(-1).alias("part"), "data").unionByName(state.select(F.col("part").alias("at"), "part", "data"))
        far = state.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("at <> part").select("at", "part", F.substring("data", F.lit(1), F.floor(F.octet_length("data") / F.lit(POINT) * F.lit(FAR)).cast("int")).alias("data"))
        run = _round(cells, used, exaggerated, momentum, rate, steps)
        state = written(own.unionByName(far).repartition(parts, "at").sortWithinPartitions("at", "part").mapInArrow(run, "part int, data binary"), "state")
    return state.mapInArrow(_unfolded, "a long, x double, y double").withColumnRenamed("a", id_col)


def _point_blob(columns: list[np.ndarray]) -> bytes:
    """Points of a part by id: ids, x and y, then velocities and gains of both."""
    ids, x, y = columns
    return _packed(ids, np.stack([x, y], 1), np.zeros((len(ids), 2)), np.ones((len(ids), 2)))


def _packed(ids: np.ndarray, y: np.ndarray, v: np.ndarray, gain: np.ndarray) -> bytes:
    return b"".join([ids.astype("<i8").tobytes(), y.T.astype("<f8").tobytes(), v.T.astype("<f8").tobytes(), gain.T.astype("<f8").tobytes()])


def _places(data: bytes, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and (x, y) of points of which a blob has so many bytes each."""
    n = len(data) // each
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", 2 * n, 8 * n).reshape(2, n).T


def _edge_blob(columns: list[np.ndarray]) -> bytes:
    """Edges of a part in order of the part of their other end: that part, both ends, chance."""
    other, a, b, p = columns
    return b"".join([other.astype("<i8").tobytes(), a.astype("<i8").tobytes(), b.astype("<i8").tobytes(), p.astype("<f8").tobytes()])


def _blobs(pack: Callable[[list[np.ndarray]], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each part of rows that are sorted by part, which is their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            data = pack([np.concatenate(c) for c in zip(*held, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

        for batch in batches:
            part, columns = batch.column(0).to_numpy(), [c.to_numpy() for c in batch.columns[1:]]
            for own in np.unique(part):
                if own != now and held:
                    yield out()
                    held = []
                now = int(own)
                held.append([c[part == own] for c in columns])
        if held:
            yield out()

    return run


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(1):
            ids, y = _places(data.as_py(), POINT)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y[:, 0]), pa.array(y[:, 1])], ["a", "x", "y"])


def _cells(state: DataFrame, side: float) -> np.ndarray:
    """(i, j, count, x, y) of the cells that hold points; the side is a fixed share of the map's width a round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                _, y = _places(data.as_py(), POINT)
                cells, at = np.unique(np.floor(y / side).astype("int64"), axis=0, return_inverse=True)
                at = at.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells[:, 0], cells[:, 1], np.bincount(at), np.bincount(at, y[:, 0]), np.bincount(at, y[:, 1]))], ["i", "j", "n", "x", "y"])

    found = state.mapInArrow(run, "i long, j long, n long, x double, y double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    cells = np.array(sorted(tuple(r) for r in found.collect()), float)  # of a grid of fixed size
    cells[:, 3:] /= cells[:, 2:3]
    return cells


def _round(cells: np.ndarray, side: float, exaggerated: float, momentum: float, rate: float, steps: int):  # noqa: ANN202
    count, centre = cells[:, 2], cells[:, 3:]
    place = {(int(i), int(j)): c for c, (i, j) in enumerate(cells[:, :2])}
    total = 0.0  # of all pairs of points, by cells; a point with itself does not count
    for at in range(0, len(cells), 512):
        total += float((count[at : at + 512, None] * count / (1 + search._squared(centre[at : at + 512], centre))).sum())
    total = max(total - count.sum(), 1e-12)

    def moved(ids: np.ndarray, s: np.ndarray, a: np.ndarray, p: np.ndarray, far: np.ndarray) -> np.ndarray:
        own = np.searchsorted(ids, a)
        y, v, gain = s[:, :2].copy(), s[:, 2:4].copy(), s[:, 4:].copy()
        mine = np.array([place[int(i), int(j)] for i, j in np.floor(y / side)])
        # of a point's own cell only the others push it
        n, whole = count[mine, None], centre[mine]
        others = np.where(n > 1, (n * whole - y) / np.maximum(n - 1, 1), 0.0)
        for _ in range(steps):
            gap = y[own] - far
            drawn = gap * (exaggerated * p / (1 + (gap * gap).sum(1)))[:, None]
            pull = np.stack([np.bincount(own, drawn[:, c], len(y)) for c in (0, 1)], 1)
            push = np.zeros_like(y)
            for lo in range(0, len(y), 512):
                w = 1 / (1 + search._squared(y[lo : lo + 512], centre))
                w = count * w * w
                push[lo : lo + 512] = y[lo : lo + 512] * w.sum(1, keepdims=True) - w @ centre
            for weight, at in ((n, whole), (1 - n, others)):
                w = weight / (1 + ((y - at) ** 2).sum(1, keepdims=True)) ** 2
                push -= w * (y - at)
            slope = 4 * (pull - push / total)
            gain = np.maximum(np.where(np.sign(slope) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
            v = momentum * v - rate * gain * slope
            y = y + v
        return np.concatenate([y, v, gain], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points = None, None
        other, a, b, p, far = (np.empty(0, np.int64),) * 3 + (np.empty(0),) * 2

        def out() -> pa.RecordBatch:
            n = len(points) // POINT
            ids, y = _places(points, POINT)
            v, gain = np.frombuffer(points, "<f8", 4 * n, 24 * n).reshape(2, 2, n).transpose(0, 2, 1)
            done = moved(ids, np.concatenate([y, v, gain], 1), a, p, far)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_packed(ids, done[:, :2], done[:, 2:4], done[:, 4:])], pa.binary())], ["part", "data"])

        for batch in batches:
            for at, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                if at != now and points is not None:
                    yield out()
                if at != now:
                    now, points = at, None
                    other, a, b, p, far = (np.empty(0, np.int64),) * 3 + (np.empty(0), np.empty((0, 2)))
                if part < 0:
                    n = len(data) // 32
                    other, a, b = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
                    p, far = np.frombuffer(data, "<f8", n, 24 * n), np.empty((n, 2))
                    continue
                if part == at:
                    points = data
                ids, y = _places(data, POINT if part == at else FAR)
                lo, hi = np.searchsorted(other, part), np.searchsorted(other, part, "right")
                far[lo:hi] = y[np.searchsorted(ids, b[lo:hi])]
        if points is not None:
            yield out()

    return run
