"""Nearest-centroid classification, anomaly detection, clustering and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import hierarchy, search
from vectrine.session import spread, written


#: Arrays of tasks that the driver adds up at most.
GROUPS = 32


def centroids(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> list[tuple[int | str, list[float]]]:
    """(label, mean vector) by label; there are as many as labels, and they become constants of a plan."""
    rows = search.mean_vectors(df, label_col, vector_col).select(label_col, "centroid").collect()
    return sorted((r[0], list(r[1])) for r in rows)


def class_scores(df: DataFrame, classes: list[tuple[int | str, list[float]]], vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and class with its cosine; classes are a fixed list, so no join is made."""
    scores = F.array(*[F.struct(F.lit(c).alias("class"), V.cosine(F.col(vector_col), V.literal(v)).alias("score")) for c, v in classes])
    return df.withColumn("_s", F.explode(scores)).select("*", "_s.class", "_s.score").drop("_s")


def classify(df: DataFrame, classes: list[tuple[int | str, list[float]]], threshold: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """All classes at or over the threshold, best first; a vector may get several or none."""
    rows = class_scores(df, classes)
    rows = rows if threshold is None else rows.where(F.col("score") >= threshold)
    order = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "class")
    return rows.withColumn("rank", F.row_number().over(order))


def best_class(df: DataFrame, classes: list[tuple[int | str, list[float]]], threshold: float | None = None) -> DataFrame:
    """df with the best class (ties to the first) and its score; null class under the threshold. No shuffle."""
    scored = F.array(*[F.struct((-F.round(V.cosine(F.col("embedding"), V.literal(v)), 9)).alias("s"), F.lit(k).alias("k"), F.lit(c).alias("class"), V.cosine(F.col("embedding"), V.literal(v)).alias("score")) for k, (c, v) in enumerate(classes)])
    out = df.withColumn("_b", F.array_min(scored))
    keep = F.lit(True) if threshold is None else F.col("_b.score") >= threshold
    return out.withColumn("class", F.when(keep, F.col("_b.class"))).withColumn("score", F.col("_b.score")).drop("_b")


def sentiment(df: DataFrame, positive: list[float], negative: list[float], vector_col: str = "embedding") -> DataFrame:
    """df with its sentiment and the margin of the two cosines; a tie is negative."""
    margin = F.round(V.cosine(F.col(vector_col), V.literal(positive)) - V.cosine(F.col(vector_col), V.literal(negative)), 9)
    return df.where(F.col(vector_col).isNotNull()).withColumn("margin", margin).withColumn("sentiment", F.when(F.col("margin") > 0, "positive").otherwise("negative"))


def accuracy(predicted: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, correct, accuracy); rows without a class count in no total."""
    rows = predicted.where(F.col("class").isNotNull())
    return rows.groupBy(label_col).agg(F.count("*").alias("n"), F.sum((F.col("class") == F.col(label_col)).cast("long")).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


# --- anomalies


def profile(df: DataFrame, vector_col: str = "embedding", deviations: float = 2.0) -> tuple[list[float], float, float, float]:
    """Centre, mean and population deviation of the distances to it, and the threshold mean + deviations * std.

    A table without a vector has an empty centre and zeros.
    """
    found = search.mean_vectors(df.withColumn("_g", F.lit(0)), "_g", vector_col).first()
    if found is None:
        return [], 0.0, 0.0, 0.0
    centre = list(found["centroid"])
    d = V.euclidean(F.col(vector_col), V.literal(centre))
    row = df.agg(F.avg(d).alias("m"), F.stddev_pop(d).alias("s")).first()
    return centre, row["m"], row["s"], row["m"] + deviations * row["s"]


def distance_anomalies(df: DataFrame, known: tuple[list[float], float, float, float], vector_col: str = "embedding") -> DataFrame:
    """df with distance, is_anomaly (over the threshold) and confidence: 1 for anomalies, else 1 - distance / threshold."""
    centre, _, _, threshold = known
    d = V.euclidean(F.col(vector_col), V.literal(centre))
    share = F.try_divide(F.col("distance"), F.lit(threshold))
    out = df.withColumn("distance", d).withColumn("is_anomaly", F.col("distance") > threshold)
    return out.withColumn("confidence", F.when(F.col("is_anomaly"), F.least(share, F.lit(1.0))).otherwise(1 - share))


def similarity_anomalies(df: DataFrame, centre: list[float], least: float = 0.5, vector_col: str = "embedding") -> DataFrame:
    return df.withColumn("similarity", V.cosine(F.col(vector_col), V.literal(centre))).withColumn("is_anomaly", F.col("similarity") < least)


def local_outlier_factor(df: DataFrame, k: int = 5, contamination: float = 0.1) -> DataFrame:
    """(vec_id, lof, is_anomaly): the local outlier factor by L2 over k neighbours; the share `contamination` with the
    highest factors are anomalies. Neighbours come from the block-wise search, so all pairs are never rows."""
    near = written(search.knn(df, df, k, metric="l2").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), (1 / F.col("score") - 1).alias("d")), "near")
    kd = near.groupBy("a").agg(F.max("d").alias("kd"))
    reach = near.join(kd.select(F.col("a").alias("b"), F.col("kd").alias("kb")), "b").withColumn("reach", F.greatest("d", "kb"))
    lrd = reach.groupBy("a").agg(F.try_divide(F.lit(1.0), F.avg("reach") + 1e-10).alias("lrd"))
    of = reach.join(lrd.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg(F.avg("lb").alias("nb"))
    out = of.join(lrd, "a").select(F.col("a").alias("vec_id"), (F.col("nb") / F.col("lrd")).alias("lof"))
    out = written(out, "lof")
    cut = quantile(out, "lof", 1 - contamination)
    return out.withColumn("is_anomaly", F.col("lof") > F.lit(cut) if cut is not None else F.lit(False))


def quantile(df: DataFrame, column: str, share: float, bins: int = 1024, few: int = 10_000) -> float | None:
    """The value below which a share of the column lies, between neighbours by their distance; None without values.

    Exact, without all values in one task: counts over bins of the range narrow it to the bin that holds the value,
    again and again, until few values are left. df is read once a pass, so it should be cheap to read.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    first = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not first["n"]:
        return None
    place = share * (first["n"] - 1)

    def at(rank: int) -> float:
        lo, hi, n, below = first["lo"], first["hi"], first["n"], 0
        while n > few and lo < hi:
            width = (hi - lo) / bins
            b = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
            found = rows.where(F.col("x").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()  # at most `bins` rows
            for r in found:
                if below + r["n"] > rank:
                    break
                below += r["n"]
            if (r["lo"], r["hi"]) == (lo, hi):
                break
            lo, hi, n = r["lo"], r["hi"], r["n"]
        if lo == hi:
            return lo
        held = sorted(r["x"] for r in rows.where(F.col("x").between(lo, hi)).groupBy("x").count().collect() for _ in range(r["count"])) if n <= few else [lo] * n
        return held[rank - below]

    low = int(place)
    value = at(low)
    return value if place == low else value + (place - low) * (at(low + 1) - value)


def _average_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, score, is_anomaly) by own isolation trees, grown on the driver from at most trees * sample vectors.

    Each tree's sample is drawn by a hash of the id; the bound does not depend on the table. Scoring is one Arrow pass.
    """
    df = df.where(F.col(vector_col).isNotNull())
    n = df.count()
    share = min(1.0, trees * sample / max(1, n))
    drawn = df.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(id_col, V.doubles(F.col(vector_col)).alias("v")).orderBy(id_col).collect()
    data, rng = np.array([r["v"] for r in drawn]), np.random.default_rng(seed)
    size = min(sample, len(data))
    deepest = int(np.ceil(np.log2(max(2, size))))

    def grow(rows: np.ndarray, depth: int) -> tuple:
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if depth >= deepest or len(rows) <= 1 or not spread.any():
            return (depth + float(_average_path(len(rows))),)
        at = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(rows[:, at].min(), rows[:, at].max()))
        low = rows[:, at] < cut
        return at, cut, grow(rows[low], depth + 1), grow(rows[~low], depth + 1)

    forest = [grow(data[rng.choice(len(data), size, replace=False)], 0) for _ in range(trees)] if size else []

    def depths(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if len(tree) == 1 or not len(rows):
            out[rows] += tree[0] if len(tree) == 1 else 0
            return
        low = x[rows, tree[0]] < tree[1]
        depths(tree[2], x, rows[low], out)
        depths(tree[3], x, rows[~low], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, out = search.matrix(batch.column(1)), np.zeros(batch.num_rows)
                for tree in forest:
                    depths(tree, x, np.arange(len(x)), out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2 ** -(out / max(1, len(forest)) / max(float(_average_path(size)), 1e-9)))], [id_col, "score"])

    scored = df.where(F.col(vector_col).isNotNull()).select(id_col, V.doubles(F.col(vector_col)).alias("v")).mapInArrow(run, f"{id_col} long, score double")
    scored = written(scored, "scores")
    cut = quantile(scored, "score", 1 - contamination)
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(cut) if cut is not None else F.lit(False))


def one_class_boundary(df: DataFrame, normal: DataFrame, nu: float = 0.1, features: int = 256, seed: int = 42, steps: int = 25, soft: float = 0.02, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, score, is_anomaly) by a one-class machine on random Fourier features of an RBF kernel, fitted on all
    normal vectors; the kernel's width is one over dimension times variance.

    Least |u|^2 / 2 - rho + mean(hinge(rho - z u)) / nu, with a hinge rounded over `soft`, by Newton steps. A step reads
    the vectors once, for the value at several lengths of its direction and the sums that give the next one where the
    first length is the best, and again for these sums where it is not; what leaves a task has a fixed size. rho is then the exact nu-quantile of the normal scores. Scores under zero are
    anomalies. Without a normal vector every score is 0 and nothing is an anomaly.
    """
    rows = written(spread(normal.where(F.col(vector_col).isNotNull()).select(V.doubles(F.col(vector_col)).alias("v"))), "points")
    moments = rows.select(F.size("v").alias("d"), V.total(F.col("v")).alias("s"), V.dot(F.col("v"), F.col("v")).alias("q")).agg(F.count("*").alias("n"), F.max("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not moments["n"]:
        return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"))
    entries = moments["n"] * moments["d"]
    variance = moments["q"] / entries - (moments["s"] / entries) ** 2
    rng = np.random.default_rng(seed)
    gamma = 1 / (moments["d"] * max(variance, 1e-12))
    w, b = rng.normal(0, np.sqrt(2 * gamma), (moments["d"], features)), rng.uniform(0, 2 * np.pi, features)
    lift = lambda x: np.sqrt(2 / features) * np.cos(x @ w + b)
    fit = OneClassFit(nu, soft, features, int(moments["n"]))
    curved = lambda: _summed(rows, lambda x, point=fit.point: fit.curvature(lift(x), point))
    sums = curved()
    for _ in range(steps):
        if not fit.turn(sums):
            break
        lines = fit.candidates()

        def both(x: np.ndarray, lines: np.ndarray = lines) -> np.ndarray:
            z = lift(x)
            return np.concatenate([fit.values(z, lines), fit.curvature(z, lines[0])])

        found = _summed(rows, both)
        sums = found[len(lines) :] if fit.move(found[: len(lines)]) == 0 else curved()
    u = fit.point[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lift(search.matrix(batch.column(1))) @ u)], [id_col, "score"])

    scores = lambda x: x.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), V.doubles(F.col(vector_col)).alias("v")).mapInArrow(run, f"{id_col} long, score double")
    rho = quantile(written(scores(normal), "scores"), "score", nu)
    return scores(df).select(id_col, (F.col("score") - rho).alias("score")).withColumn("is_anomaly", F.col("score") < 0)


class OneClassFit:
    """Newton's method on the rounded one-class objective; the sums over rows are taken elsewhere."""

    def __init__(self, nu: float, soft: float, features: int, n: int) -> None:
        self.nu, self.soft, self.n = nu, soft, n
        self.point = np.zeros(features + 1)  # u, then rho
        self.direction = self.point

    def curvature(self, z: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Sums of the hinge's first and second derivatives over the rows, flat."""
        z = np.concatenate([-z, np.ones((len(z), 1))], 1)
        t = z @ point
        first = np.clip(t / self.soft, 0, 1)
        inside = z[(t > 0) & (t < self.soft)]
        return np.concatenate([first @ z, (inside.T @ inside / self.soft).ravel()])

    def turn(self, sums: np.ndarray) -> bool:
        """Sets the direction from the sums; False where the gradient is nothing."""
        k, scale = len(self.point), 1 / (self.nu * self.n)
        own = np.append(self.point[:-1], -1.0)
        gradient = own + scale * sums[:k]
        hessian = np.diag(np.append(np.ones(k - 1), 1e-9)) + scale * sums[k:].reshape(k, k)
        self.direction = -np.linalg.solve(hessian, gradient)
        return bool(np.abs(gradient).max() > 1e-9)

    def candidates(self) -> np.ndarray:
        """Points along the direction; it may be very long where no row lies on the hinge's round part."""
        length = np.abs(self.direction[-1])
        first = min(1.0, 1.0 / length) if length > 0 else 1.0
        return np.stack([self.point + first * 0.5**i * self.direction for i in range(24)])

    def values(self, z: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The hinge's sum over the rows at each point."""
        t = points[:, -1][:, None] - points[:, :-1] @ z.T
        return np.where(t <= 0, 0, np.where(t < self.soft, t * t / (2 * self.soft), t - self.soft / 2)).sum(1)

    def move(self, sums: np.ndarray) -> int:
        """To the lowest of the candidates, whose place is returned."""
        points = self.candidates()
        at = int(np.argmin((points[:, :-1] ** 2).sum(1) / 2 - points[:, -1] + sums / (self.nu * self.n)))
        self.point = points[at]
        return at


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], at_once: int = 4096) -> np.ndarray:
    """The sum over all rows of an array that `of` gives for some vectors. Each task sends one array; those of more than
    GROUPS tasks are added up in groups first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = of(search.matrix(batch.column(0).slice(at, at_once)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["a"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["a"])

    parts = rows.mapInArrow(each, "a binary")
    if rows.rdd.getNumPartitions() > GROUPS:
        parts = parts.repartition(GROUPS).mapInArrow(added, "a binary")
    parts = parts.collect()  # at most GROUPS arrays
    return np.sum([np.frombuffer(r["a"]) for r in parts], axis=0)


def ensemble(votes: list[DataFrame], id_col: str = "vec_id") -> DataFrame:
    """(vec_id, votes, share, confidence, is_anomaly) of detectors' (vec_id, is_anomaly): over half must agree. The
    confidence is the mean of those detectors that give one, null without any."""
    one = lambda v: v.select(id_col, "is_anomaly", (F.col("confidence") if "confidence" in v.columns else F.lit(None)).cast("double").alias("confidence"))
    union = one(votes[0])
    for v in votes[1:]:
        union = union.unionByName(one(v))
    out = union.groupBy(id_col).agg(F.sum(F.col("is_anomaly").cast("long")).alias("votes"), F.avg(F.col("is_anomaly").cast("double")).alias("share"), F.avg("confidence").alias("confidence"))
    return out.withColumn("is_anomaly", F.col("share") > 0.5)


def anomaly_report(found: DataFrame) -> DataFrame:
    """(total, anomalies, rate, high, medium, low): anomalies by confidence over 0.8, 0.5 to 0.8, and under 0.5."""
    bad, c = F.col("is_anomaly"), F.col("confidence")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    out = found.agg(F.count("*").alias("total"), count(bad).alias("anomalies"), count(bad & (c > 0.8)).alias("high"), count(bad & (c <= 0.8) & (c >= 0.5)).alias("medium"), count(bad & (c < 0.5)).alias("low"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("anomalies").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


# --- clusters


def kmeans(df: DataFrame, k: int, seed: int = 42, n_init: int = 10, vector_col: str = "embedding", most: int = 20, move: float = 1e-4) -> tuple[DataFrame, float, float]:
    """df with its cluster, the inertia and the (squared-L2) silhouette, of the best of n_init seeded starts.

    All starts go side by side, so a step of all of them is one pass over the vectors: first a pass for each centre,
    drawn with a chance in proportion to the squared distance from those before it, then Lloyd's steps until no
    centre moves by more than `move` (or `most` of them). What leaves a task has a fixed size. Rows without a vector
    are left out; equal vectors have one chance together, and a cluster that nothing is nearest to keeps its centre.
    Without two different vectors there is no silhouette (NaN).
    """
    rows = df.where(F.col(vector_col).isNotNull())
    points = written(spread(rows.select(V.doubles(F.col(vector_col)).alias("v"), F.xxhash64(V.doubles(F.col(vector_col))).alias("h"))), "points")
    centres = _first_centres(points, k, seed, n_init)
    if centres is None:
        return rows.withColumn("cluster", F.lit(None).cast("int")), 0.0, float("nan")
    d = centres.shape[2]

    def step(x: np.ndarray) -> np.ndarray:
        d = search._squared(x, centres.reshape(-1, centres.shape[2])).reshape(len(x), n_init, k)
        return np.concatenate([_lloyd(x, d[:, i]) for i in range(n_init)])

    for turn in range(most + 1):
        sums = _summed(points, step).reshape(n_init, k * (d + 1) + 1)
        cost, n = sums[:, -1], sums[:, : k].reshape(n_init, k, 1)
        new = np.where(n > 0, sums[:, k:-1].reshape(n_init, k, d) / np.maximum(n, 1), centres)
        moved = np.sqrt(((new - centres) ** 2).sum(2)).max()
        if moved <= move or turn == most:
            break
        centres = new
    best = int(np.argmin(cost))
    nearest = F.array(*[F.struct(V.squared_l2(F.col(vector_col), V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres[best].tolist())])
    out = rows.withColumn("cluster", F.array_min(nearest)["i"].cast("int"))
    found = silhouette(out, vector_col)
    return out, float(cost[best]), float("nan") if found is None else found


def _lloyd(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of the vectors nearest to each centre by squared distances: their numbers, their sums, and last the squared
    distances of all, flat."""
    at = d.argmin(1)
    own = (at[:, None] == np.arange(d.shape[1])).astype(float)
    return np.concatenate([own.sum(0), (own.T @ x).ravel(), [d[np.arange(len(x)), at].sum()]])


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) drawn by a hash of the rows' hashes and a salt."""
    z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _first_centres(points: DataFrame, k: int, seed: int, starts: int) -> np.ndarray | None:
    """(starts, k, d) centres: each drawn by the squared distance from the nearest one before it, as the smallest of
    exponential waiting times, of which only the smallest of each task leaves it. None without a vector."""
    chosen = np.zeros((starts, 0, 0))
    for turn in range(k):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, h = search.matrix(batch.column(0)), batch.column(1).to_numpy()
                for s in range(starts):
                    weight = search._squared(x, chosen[s]).min(1) if turn else np.ones(len(x))  # noqa: B023
                    with np.errstate(divide="ignore"):
                        wait = -np.log(_uniform(h, (seed * 1009 + s) * 64 + turn)) / weight  # noqa: B023
                    i = int(np.lexsort((h, wait))[0])
                    best[s] = min(best.get(s, (np.inf, [])), (float(wait[i]), x[i].tolist()))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([w for w, _ in best.values()]), pa.array([v for _, v in best.values()], pa.list_(pa.float64()))], ["s", "wait", "v"])

        drawn = points.select("v", "h").mapInArrow(run, "s int, wait double, v array<double>").groupBy("s").agg(F.min(F.struct("wait", "v")).alias("m")).collect()  # a row for each start
        if not drawn:
            return None
        new = {r["s"]: r["m"]["v"] for r in drawn}
        # where every vector is a centre already nothing is left to draw, and the first centre stands twice
        column = np.array([new[s] if new.get(s) else chosen[s, 0].tolist() for s in range(starts)])
        chosen = column[:, None, :] if not turn else np.concatenate([chosen, column[:, None, :]], 1)
    return chosen


def best_k(df: DataFrame, most: int = 8, **how: object) -> tuple[int, dict[int, tuple[float, float]]]:
    """The number of clusters from 2 on with the highest silhouette, and (inertia, silhouette) of each."""
    seen = {k: kmeans(df, k, **how)[1:] for k in range(2, most + 1)}
    return max(seen, key=lambda k: -np.inf if np.isnan(seen[k][1]) else seen[k][1]), seen


def dbscan(df: DataFrame, eps: float, min_samples: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster): density clusters by L2, -1 for noise; a border point joins its lowest core's cluster.

    Pairs within eps come from the block-wise join on unit-free products; core labels spread by joins until nothing
    changes, each round written to the shared folder.
    """
    ids = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("v"))
    near = within(df, eps, id_col, vector_col)
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "near")
    cores = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("v"))
    alone = ids.where(F.lit(min_samples <= 1))
    cores = written(cores.union(alone).distinct(), "cores")
    edges = written(both.join(cores.withColumnRenamed("v", "a"), "a", "left_semi").join(cores.withColumnRenamed("v", "b"), "b", "left_semi"), "edges")
    labels = cores.withColumn("label", F.col("v"))
    while True:
        low = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("low"))
        moved = labels.join(low, "v", "left").select("v", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        now = written(moved.join(moved.select(F.col("v").alias("label"), F.col("label").alias("to")), "label").select("v", "was", F.least("label", "to").alias("label")), "labels")
        if now.where("label <> was").isEmpty():
            break
        labels = now.select("v", "label")
    labels = now.select("v", "label")
    border = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("border"))
    out = ids.join(labels, "v", "left").join(border, "v", "left")
    return out.select(F.col("v").alias(id_col), F.coalesce("label", "border", F.lit(-1)).alias("cluster"))


def within(df: DataFrame, eps: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b) with a < b and L2 distance at most eps, by products of packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, data, l, m, same = (batch.column(c)[r].as_py() for c in range(6))  # noqa: E741
                x, y = np.frombuffer(ids, "<i8"), np.frombuffer(l, "<i8")
                v, w = np.frombuffer(data, "<f8").reshape(-1, dim), np.frombuffer(m, "<f8").reshape(-1, dim)
                i, j = search.may_reach(search.NEAREST, w, np.full(len(w), -eps * eps - 1e-12), v)
                d = np.concatenate([np.empty(0), *(search.squared_pairs(w[i[at : at + search.HELD]], v[j[at : at + search.HELD]]) for at in range(0, len(i), search.HELD))])
                a, b = y[i], x[j]
                keep = (a < b if same else a != b) & (d <= eps * eps + 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    return search.block_pairs(df, id_col, vector_col).mapInArrow(run, "a long, b long")


def _agglomerate(x: np.ndarray, size: np.ndarray, n_clusters: int) -> list[int]:
    """Ward's agglomeration of points that stand for so many rows each: a cluster's number for each point, by first place."""
    n, size, label = len(x), size.astype(float), np.arange(len(x))
    d = np.stack([((x - y) ** 2).sum(1) * size * m / (size + m) for y, m in zip(x, size, strict=True)]) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    for _ in range(max(0, n - n_clusters)):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        si, sj = size[i], size[j]
        merged = ((si + size) * d[i] + (sj + size) * d[j] - size * d[i, j]) / (si + sj + size)
        d[i], d[:, i] = merged, merged
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += sj
        label[label == j] = i
    names = {c: k for k, c in enumerate(dict.fromkeys(label.tolist()))}
    return [names[c] for c in label.tolist()]


def ward(df: DataFrame, n_clusters: int, most: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster): Ward's agglomeration in one NumPy group, for at most `most` rows; more are refused.

    Larger tables take `hierarchy.ward`.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"Ward's agglomeration takes at most {most} rows; cluster centres instead")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["i"].to_numpy())
        x = np.array(table["v"].to_pylist())[order]
        return pa.table({id_col: table["i"].to_numpy()[order], "cluster": pa.array(_agglomerate(x, np.ones(len(x)), n_clusters), pa.int32())})

    one = df.select(F.lit(0).alias("g"), F.col(id_col).cast("long").alias("i"), V.doubles(F.col(vector_col)).alias("v"))
    return one.groupBy("g").applyInArrow(run, f"{id_col} long, cluster int")


def ward_of_all(df: DataFrame, n_clusters: int, centres: int = 200, most: int = 2000, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster) of every row with a vector, whatever their number; `hierarchy.ward` is exact for all of them.

    Up to `most` rows it is exact (`ward`). More are put to k-means centres first; Ward joins the centres, each with
    the weight of its rows, and a row has the cluster of its centre. That differs from exact Ward where a centre's
    rows would have parted.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector_col).isNotNull())
    if rows.limit(most + 1).count() <= most:
        return ward(rows, n_clusters, most, id_col, vector_col)
    lifted = rows.select(F.col(id_col).cast("long").alias(id_col), array_to_vector(V.doubles(F.col(vector_col))).alias("_f"))
    model = KMeans(k=max(centres, n_clusters), seed=seed, featuresCol="_f", predictionCol="_c").fit(lifted)
    found = _agglomerate(np.array(model.clusterCenters()), np.maximum(model.summary.clusterSizes, 1), n_clusters)
    return model.transform(lifted).select(id_col, F.get(F.array(*map(F.lit, found)), "_c").cast("int").alias("cluster"))


def cluster_summary(clustered: DataFrame, text_col: str = "text", id_col: str = "doc_id", cluster_col: str = "cluster", keep: int = 3) -> DataFrame:
    """(cluster, n, percentage, first_ids): noise (-1) is skipped. Only the first ids are kept while aggregating."""
    total = clustered.count()
    rank = F.row_number().over(Window.partitionBy(cluster_col).orderBy(id_col))
    rows = clustered.where(F.col(cluster_col) >= 0)
    sizes = rows.groupBy(cluster_col).agg(F.count("*").alias("n"))
    first = rows.withColumn("r", rank).where(F.col("r") <= keep).groupBy(cluster_col).agg(F.array_sort(F.collect_list(id_col)).alias("first_ids"))
    return sizes.join(first, cluster_col).withColumn("percentage", F.col("n") * 100.0 / total)


def pca(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[float]]:
    """(id, point) on the first k axes of the centred vectors, and the explained shares. The covariance is aggregated
    block by block; only its d x d entries reach the driver. Each axis points where its largest entry is positive.
    Without a vector there are no axes and no rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = search.matrix(batch.column(0))
                n, s, c = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if c is None else c)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([c.ravel().tolist()])], ["n", "s", "c"])

    src = df.where(F.col(vector_col).isNotNull())
    parts = src.select(V.doubles(F.col(vector_col)).alias("v")).mapInArrow(moments, "n long, s array<double>, c array<double>")
    entries = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "c")).alias("at", "x"))
    summed = [r["x"] for r in entries.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]  # 1 + d + d * d rows
    if not summed:
        return src.select(id_col, F.array().cast("array<double>").alias("point")), []
    d = int(np.sqrt(len(summed) - 1))
    n, s, c = summed[0], np.array(summed[1 : 1 + d]), np.array(summed[1 + d :]).reshape(d, d)
    mean = s / n
    values, axes = np.linalg.eigh(c / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    point = F.array(*[V.dot(V.subtract(F.col(vector_col), V.literal(mean)), V.literal(axes[:, i])) for i in range(len(order))])
    return src.select(id_col, point.alias("point")), [float(values[i] / values.sum()) for i in order]


def trajectory(df: DataFrame, group_col: str, time_col: str, value: Column) -> DataFrame:
    """df in time order within each group: place, value, and the step from the value before."""
    w = Window.partitionBy(group_col).orderBy(time_col)
    out = df.withColumn("value", value).withColumn("place", F.row_number().over(w))
    return out.withColumn("step", F.col("value") - F.lag("value").over(w))


def cluster_results(results: DataFrame, n_clusters: int = 3, text_col: str = "text", id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, topic) of a search's results; fewer results than clusters are all noise (-1, no topic)."""
    from vectrine.operators import analytics

    if results.limit(n_clusters).count() < n_clusters:
        return results.select(id_col, F.lit(-1).alias("cluster"), F.lit("").alias("topic"))
    grouped, _, _ = kmeans(results, n_clusters, vector_col=vector_col)
    return grouped.join(analytics.topics(grouped, "cluster", text_col), "cluster").select(id_col, "cluster", "topic")


def cluster_profiles(clustered: DataFrame, keep: int = 3, words: int = 5, text_col: str = "text", id_col: str = "doc_id", cluster_col: str = "cluster") -> DataFrame:
    """(cluster, n, percentage, first_texts, keywords): sizes, the texts of the first ids, and the most frequent words.
    Noise (a cluster of -1) is skipped. Only the first rows and the most frequent words are gathered."""
    from vectrine.operators import analytics

    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row a cluster
    sizes = clustered.groupBy(cluster_col).agg(F.count("*").alias("n")).withColumn("percentage", F.col("n") * 100.0 / total)
    rows = clustered.where(F.col(cluster_col).cast("string") != "-1")
    rank = F.row_number().over(Window.partitionBy(cluster_col).orderBy(id_col))
    first = rows.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy(cluster_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text_col))), lambda x: x[text_col]).alias("first_texts"))
    found = analytics.group_keywords(rows, cluster_col, words, text_col)
    top = found.groupBy(cluster_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return sizes.join(first, cluster_col).join(top, cluster_col, "left")


def silhouette(clustered: DataFrame, vector_col: str = "embedding", cluster_col: str = "cluster") -> float | None:
    """The mean (squared-L2) silhouette of all rows but noise; None for fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = clustered.where(F.col(cluster_col) >= 0)
    number = rows.select(cluster_col).distinct()
    if number.limit(2).count() < 2:
        return None
    # the evaluator wants labels as doubles; a density cluster is named by an id, which a double may not hold
    label = F.pmod(F.xxhash64(cluster_col), F.lit(1 << 52)).cast("double")
    rows = rows.select(array_to_vector(V.doubles(F.col(vector_col))).alias("_f"), label.alias("_c"))
    return float(ClusteringEvaluator(featuresCol="_f", predictionCol="_c").evaluate(rows))


def compare_algorithms(df: DataFrame, k: int = 3, eps: float | tuple[float, ...] = 0.6, min_samples: int = 3, n_init: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(algorithm, clusters, noise, silhouette) of k-means, Ward's agglomeration and density clusters over the same rows;
    density clusters once for each of several eps, which they are named by then."""
    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    found = {"kmeans": kmeans(rows, k, n_init=n_init, vector_col=vector_col)[0].select(id_col, "cluster"), "ward": hierarchy.ward(rows, k, id_col, vector_col)}
    widths = eps if isinstance(eps, tuple) else (eps,)
    found |= {"density" if len(widths) == 1 else f"density {x:g}": dbscan(rows, x, min_samples, id_col, vector_col) for x in widths}
    out = []
    for name, clustered in found.items():
        clustered = written(clustered, name)
        row = clustered.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("c"), F.count_if(F.col("cluster") < 0).alias("n")).first()
        out.append((name, row["c"], row["n"], silhouette(clustered.join(rows, id_col), vector_col)))
    return df.sparkSession.createDataFrame(out, "algorithm string, clusters long, noise long, silhouette double")
