"""Recommendations from behaviour logs: user vectors, content, neighbours, mixtures, cold starts and experiments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import peers, search
from vectrine.session import written

#: Users that are folded at once, and common ratings of two blocks of users that are compared at once.
USERS, AT_ONCE = 1024, 1 << 21

# The score of each kind of action; any other counts 1.
ACTION_SCORES = {"view": 1.0, "like": 3.0, "purchase": 5.0, "skip": -1.0}


def action_score(action: Column, scores: dict[str, float] | None = None) -> Column:
    out = F.lit(1.0)
    for name, value in (scores or ACTION_SCORES).items():
        out = F.when(action == name, F.lit(value)).otherwise(out)
    return out


def latest(behaviours: DataFrame, n: int = 20, user_col: str = "user_id", time_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each user's n latest rows. Ranks are first taken within salted parts, so a very busy user is split."""
    part = F.pmod(F.xxhash64(tie), F.lit(16))
    order = (F.desc(time_col), F.desc(tie))
    first = behaviours.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy(user_col, "_p").orderBy(*order))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(user_col).orderBy(*order))).where(F.col("_r") <= n).drop("_p", "_r")


def user_vectors(behaviours: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """(user_id, embedding): the score-weighted mean of each user's n latest items; zeros where weights are not
    positive in sum. behaviours: user_id, item_id, score, ts, event_id; items: item_id, embedding."""
    # the items that behaviours name are met by key once; a user's n latest rows are then folded where they lie
    joined = latest(behaviours, n).join(items.where(F.col("embedding").isNotNull()), "item_id")
    rows = joined.groupBy("user_id").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("w"), V.doubles(F.col("embedding")).alias("v"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, USERS):
                part = batch.slice(at, USERS)
                of, flat = part.column(1).value_lengths().to_numpy(), part.column(1).flatten()
                w, first = flat.field("w").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(of)[:-1]]).astype(int)
                v = search.matrix(flat.field("v"))
                w = np.where(np.isnan(w), 0.0, w)
                n, total = np.add.reduceat(w, first), np.add.reduceat(v * w[:, None], first)
                out = np.divide(total, n[:, None], out=np.zeros_like(total), where=n[:, None] > 0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], ["user_id", "embedding"])

    return rows.mapInArrow(run, f"user_id {behaviours.schema['user_id'].dataType.simpleString()}, embedding array<double>")


def content_based(users: DataFrame, items: DataFrame, seen: DataFrame, limit: int = 5, metric: str = "cosine") -> DataFrame:
    """(user_id, item_id, score, rank): the items most like the user's vector among those not in seen.

    What a user has seen goes with the block of users, so it is left out where scores are made and only the best `limit`
    of the rest leave a task, however much anyone has seen.
    """
    touched = seen.where("user_id is not null and item_id is not null").groupBy("user_id").agg(F.collect_set(F.col("item_id").cast("long")).alias("seen"))
    none = F.array().cast("array<bigint>")
    asked = users.join(touched, "user_id", "left").select("user_id", "embedding", F.coalesce("seen", none).alias("seen"))
    q = written(_packed_users(asked), "blocks")
    v = written(search.packed(items.select(F.col("item_id").alias("vec_id"), "embedding"), "vec_id", "embedding"), "blocks")
    found = search.best_between_blocks(q, v, limit, metric, _users_of)
    return _ranked(found.select(F.col("query_id").alias("user_id"), F.col("vec_id").alias("item_id"), "score"), limit)


def _packed_users(users: DataFrame) -> DataFrame:
    """(dim, list, ids, data): blocks of users of one dimension, of which data has the vectors, then the number of items
    that each one has seen, then these items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, USERS):
                part = batch.slice(at, USERS)
                size = part.column(1).value_lengths().to_numpy()
                for dim in np.unique(size):
                    own = part.take(pa.array(np.flatnonzero(size == dim)))
                    n, items = own.column(2).value_lengths().to_numpy().astype("<i8"), own.column(2).flatten().to_numpy().astype("<i8")
                    data = search.matrix(own.column(1)).astype("<f8").tobytes() + n.tobytes() + items.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([0], pa.int64()), pa.array([own.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([data], pa.binary())], ["dim", "list", "ids", "data"])

    rows = users.where(F.col("user_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.select(F.col("user_id").cast("long"), V.doubles(F.col("embedding")), "seen").mapInArrow(run, "dim int, list long, ids binary, data binary")


def _users_of(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's users and vectors, and (place of the user, item) of all that they have seen."""
    users = np.frombuffer(ids, "<i8")
    n = np.frombuffer(data, "<i8", len(users), 8 * dim * len(users))
    items = np.frombuffer(data, "<i8", int(n.sum()), 8 * (dim + 1) * len(users))
    return users, np.frombuffer(data, "<f8", dim * len(users)).reshape(-1, dim), np.repeat(np.arange(len(users)), n), items


def _ranked(df: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def ratings(behaviours: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(user_id, item_id, score): the latest score of each pair, of the named kinds of behaviour."""
    rows = behaviours.where(F.col("event_type").isin(*kinds))
    return rows.groupBy("user_id", "item_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"))


def collaborative(rated: DataFrame, neighbours: int = 5, limit: int = 5) -> DataFrame:
    """(user_id, item_id, score, rank): items of the most similar users, score times similarity, the best neighbour's
    value for an item that several bring; items the user rated go.

    Similarity is 1 / (1 + RMSE) over common items with finite scores; a user has one score for an item at most. Users
    with the same ratings are looked up once, as one class; a class finds its peers by scores that are near its own
    (`peers.nearest`), so no pair of users is a row and few are compared.
    """
    rows = rated.where("user_id is not null and item_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.struct(F.col("item_id").cast("long").alias("item_id"), F.col("score").cast("double").alias("score")).alias("r"))
    profiles = written(rows.groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("r")), "rated")
    # of a class its smallest users, as many as could be peers of one of them; first of its parts, so none is collected whole
    smallest = lambda users: F.slice(F.array_sort(users), 1, neighbours + 1)
    parts = profiles.groupBy("r", F.pmod(F.xxhash64("user_id"), F.lit(16))).agg(smallest(F.collect_list("user_id")).alias("users"))
    grouped = parts.groupBy("r").agg(smallest(F.flatten(F.collect_list("users"))).alias("users"))
    scored = F.filter("r", lambda x: F.abs(x["score"]) < float("inf"))
    classes = written(grouped.select(F.get("users", F.lit(0)).alias("user_id"), "r", "users", scored.alias("scored")), "classes")
    looked = classes.where(F.size("scored") > 0).select("user_id", F.col("scored").alias("r"))
    near = peers.nearest(looked, neighbours, _alikeness)
    order = lambda s, peer: F.struct((-F.round(s, 9)).alias("o"), peer.alias("peer"), s.alias("similarity"))
    first = lambda found: F.slice(F.array_sort(found), 1, neighbours)
    named = near.join(classes.select(F.col("user_id").alias("peer"), F.slice("users", 1, neighbours).alias("users")), "peer")
    others = named.select("user_id", "similarity", F.explode("users").alias("peer")).groupBy("user_id").agg(first(F.collect_list(order(F.col("similarity"), F.col("peer")))).alias("others"))
    found = classes.join(others, "user_id", "left").select("r", F.when(F.size("scored") > 0, F.col("users")).otherwise(F.array().cast("array<bigint>")).alias("own"), F.coalesce("others", F.array().cast(others.schema["others"].dataType)).alias("others"))
    own = F.transform(F.filter("own", lambda x: x != F.col("user_id")), lambda x: order(F.lit(1.0), x))
    alike = profiles.join(found.hint("merge"), "r").select("user_id", F.explode(first(F.concat("others", own))).alias("p")).select("user_id", "p.peer", "p.similarity")
    theirs = alike.join(profiles.select(F.col("user_id").alias("peer"), F.col("r").alias("theirs")), "peer")
    brought = theirs.groupBy("user_id").agg(F.collect_list(F.struct("similarity", "theirs")).alias("brought")).join(profiles, "user_id")
    return brought.select("user_id", "r", "brought").mapInArrow(_brought(limit), "user_id long, item_id long, score double, rank int")


def _brought(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(user_id, item_id, score, rank) of users with their ratings and those of their peers: of an item not rated the
    highest value, the best of them first, values that are null last."""

    def best(part: pa.RecordBatch) -> pa.RecordBatch:
        users, mine, peers_of = part.column(0).to_numpy(), part.column(1), part.column(2)
        each = peers_of.flatten()
        theirs = each.field("theirs")
        row, n = np.repeat(np.arange(len(users)), peers_of.value_lengths().to_numpy()), theirs.value_lengths().to_numpy()
        rated, flat = mine.flatten(), theirs.flatten()
        seen, items = rated.field("item_id").to_numpy(), flat.field("item_id").to_numpy()
        row, value = np.repeat(row, n), flat.field("score").to_numpy(zero_copy_only=False) * np.repeat(each.field("similarity").to_numpy(), n)
        none = flat.field("score").is_null().to_numpy(zero_copy_only=False)
        _, code = np.unique(np.concatenate([seen, items]), return_inverse=True)
        wide = int(code.max(initial=0)) + 1
        own = np.repeat(np.arange(len(users)), mine.value_lengths().to_numpy()) * wide + code[: len(seen)]
        key = row * wide + code[len(seen) :]
        left = np.flatnonzero(~np.isin(key, own))
        left = left[np.lexsort((-value[left], none[left], key[left]))]  # the highest value of each user and item first
        left = left[np.concatenate([[True], key[left][1:] != key[left][:-1]])[: len(left)]]
        left = left[np.lexsort((items[left], -np.floor(value[left] * 1e9 + 0.5), none[left], row[left]))]
        rank = np.arange(len(left)) - np.searchsorted(row[left], row[left]) + 1
        left, rank = left[rank <= limit], rank[rank <= limit]
        return pa.RecordBatch.from_arrays([pa.array(users[row[left]]), pa.array(items[left]), pa.array(value[left], mask=none[left]), pa.array(rank.astype(np.int32))], ["user_id", "item_id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, USERS):
                yield best(batch.slice(at, USERS))

    return run


def _alikeness(some: tuple, others: tuple) -> np.ndarray:
    """1 / (1 + RMSE) over common items of all users of two blocks, given as their number and (place of the user, item,
    score) by item; minus infinity without any."""
    (rows, who, items, scores), (columns, peer, theirs, values) = some, others
    first = np.searchsorted(theirs, items)
    n = np.searchsorted(theirs, items, "right") - first
    end = np.cumsum(n)
    common, gaps = np.zeros(rows * columns), np.zeros(rows * columns)
    at = 0
    while at < len(n):  # as many ratings of the first block as have so many in common with the second, one at least
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + AT_ONCE, "right")))
        a = np.repeat(np.arange(at, to), n[at:to])
        b = first[a] + np.arange(len(a)) - (end[a] - n[a] - (end[at - 1] if at else 0))
        pair = who[a] * columns + peer[b]
        common += np.bincount(pair, minlength=len(common))
        gaps += np.bincount(pair, (scores[a] - values[b]) ** 2, len(gaps))
        at = to
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(common > 0, 1 / (1 + np.sqrt(gaps / common)), -np.inf).reshape(rows, columns)


def mixed(content: DataFrame, peers: DataFrame, limit: int = 5, content_weight: float = 0.6, peer_weight: float = 0.4) -> DataFrame:
    """Weighted scores of both lists, summed by item."""
    union = content.select("user_id", "item_id", (F.col("score") * content_weight).alias("score")).unionByName(peers.select("user_id", "item_id", (F.col("score") * peer_weight).alias("score")))
    return _ranked(union.groupBy("user_id", "item_id").agg(F.sum("score").alias("score")), limit)


def popular(behaviours: DataFrame, limit: int = 10, kinds: tuple[str, ...] = ("view", "like", "purchase")) -> DataFrame:
    """(item_id, score, n): highest mean score, then most behaviours, then the smaller id, of the named kinds.

    A log that has its own word for a like names it in kinds.
    """
    rows = behaviours.where(F.col("event_type").isin(*kinds)).groupBy("item_id").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return rows.orderBy(F.desc(F.round("score", 9)), F.desc("n"), "item_id").limit(limit)


def cold_start(users: DataFrame, known: DataFrame, top: DataFrame) -> DataFrame:
    """(user_id, item_id, score, reason, real_time) for users without a row in known: the popular items.

    The popular items are a report of fixed length, so they are one array constant of the plan.
    """
    items = [(r["item_id"], r["score"]) for r in top.collect()]
    new = users.select("user_id").distinct().join(known.select("user_id").distinct(), "user_id", "left_anti")
    rows = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(s).alias("score")) for i, s in items]) if items else F.array().cast("array<struct<item_id:bigint,score:double>>")
    return new.select("user_id", F.inline(rows)).select("user_id", "item_id", "score", F.lit("popular").alias("reason"), F.lit(False).alias("real_time"))


def serve(requests: DataFrame, cached: DataFrame, top: DataFrame, limit: int = 10) -> DataFrame:
    """Cached recommendations where a user has any, the cold start elsewhere."""
    hit = cached.join(requests.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", "score", F.lit("cached").alias("reason"), F.lit(True).alias("real_time"))
    return _ranked(hit.unionByName(cold_start(requests, cached, top)), limit)


def experiment(requests: DataFrame, cached: DataFrame, top: DataFrame, boost: float = 1.2) -> DataFrame:
    """Group A is served as ever, group B gets popular items at a boosted score, other groups get nothing."""
    a = serve(requests.where("test_group = 'A'"), cached, top).withColumn("test_group", F.lit("A"))
    nobody = cached.limit(0)
    b = cold_start(requests.where("test_group = 'B'"), nobody, top)
    b = _ranked(b.withColumn("score", F.col("score") * boost), 10).withColumn("test_group", F.lit("B"))
    return a.unionByName(b)


def diversity(candidates: DataFrame, previous: DataFrame, items: DataFrame, weight: float = 0.1, last: int = 5) -> DataFrame:
    """candidates with diversity = 1 - mean product with the user's `last` best previous items (0 without any) and
    final_score = score + weight * diversity."""
    before = _ranked(previous, last).select("user_id", F.col("item_id").alias("p"))
    pv = before.join(items.select(F.col("item_id").alias("p"), F.col("embedding").alias("pv")), "p")
    pairs = candidates.join(items, "item_id").join(pv, "user_id").groupBy("user_id", "item_id").agg((1 - F.avg(V.dot(F.col("embedding"), F.col("pv")))).alias("diversity"))
    out = candidates.join(pairs, ["user_id", "item_id"], "left").fillna(0.0, ["diversity"])
    return out.withColumn("final_score", F.col("score") + weight * F.col("diversity"))


def explanation(behaviours: DataFrame) -> DataFrame:
    """(user_id, event_type, n, reason): the user's most frequent kind of behaviour, ties by name."""
    counts = behaviours.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("event_type"), (-F.col("b.m")).alias("n"), F.concat(F.lit("based on your "), F.col("b.event_type"), F.lit(" history")).alias("reason"))
