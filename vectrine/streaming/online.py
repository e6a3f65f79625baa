"""Vectors of users and items that follow a stream of actions exactly, and recommendations renewed as users change.

An action moves its user's and its item's vector, so each depends on the one before it of the same user and the one
before it of the same item. `two_sided` works through a batch in waves: items are dealt into buckets, a task goes
through its bucket's actions in order as far as the users' vectors it needs are known, and hands a user on whose next
action lies in another bucket. A wave is two shuffles; the result is that of acting one by one.

Items that a user has in common stay in one bucket, and so on along the chain (`linked_items`): hand-overs between
buckets would make about as many waves as a chain has actions. What is not linked is worked through side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vectrine.functions import vectors as V
from vectrine.operators import search, store
from vectrine.session import scratch, written

#: Actions of a batch for each bucket: so many are gone through by one task before others help.
BUCKET_ACTIONS = 100_000
#: Batches after which all vectors are written in one place, which bounds what a batch reads.
SNAPSHOT_EVERY = 16
_WAITING_ITEM, _ACTION, _DONE_ITEM, _MESSAGE, _DONE_USER = range(5)


def hashed_start(key: Column, salt: str, dimensions: int, spread: float = 0.2) -> Column:
    """A start vector of which every component is drawn from [-spread / 2, spread / 2) by an MD5 digest; the same in SQL."""
    digits = lambda d: F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt), d.cast("string"))), 1, 7)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: (F.conv(digits(d), 16, 10).cast("double") / F.lit(float(1 << 28)) - 0.5) * spread)


def two_sided(actions: DataFrame, users: DataFrame, items: DataFrame, rate: float = 0.01, decay: float = 0.001, per_bucket: int = BUCKET_ACTIONS) -> DataFrame:
    """(side, key, vector): every user's and item's vector after all actions, one by one by (ts, event_id).

    actions: event_id, ts, user_id, item_id, score, none of them null; rows that tie in both order columns keep one
    order for all of them. users and items: (key, vector), one row for each that acts. An action takes its error
    once, moves the user, then the item by the user's new vector. A task holds the vectors of its bucket's items and
    streams the actions, so one item or user with very many of them costs time in sequence, as it must, but no memory.
    """
    spark = actions.sparkSession
    ordered = written(actions.select("event_id", "ts", "user_id", "item_id", "score").withColumn("n", F.monotonically_increasing_id()), "ordered")
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, min(most, -(-ordered.count() // per_bucket)))
    bucket = F.lit(0) if buckets == 1 else F.pmod(F.xxhash64("linked"), F.lit(buckets)).cast("int")
    links = None if buckets == 1 else linked_items(ordered)
    dealt = lambda rows: (rows if links is None else rows.join(links, "item_id")).withColumn("b", bucket)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id", "n")
    linked = dealt(ordered).withColumn("next", F.lead("n").over(w)).withColumn("next_b", F.lead("b").over(w)).withColumn("head", F.row_number().over(w) == 1)
    heads = linked.where("head").join(users.select(F.col("key").alias("user_id"), F.col("vector").alias("vec")), "user_id")
    columns = [F.col(c) for c in ("b", "ts", "event_id", "n", "user_id", "item_id", "score", "next", "next_b", "vec")]
    later = linked.where("not head").withColumn("vec", F.lit(None).cast("array<double>"))
    rows = heads.select(F.lit(_ACTION).alias("kind"), *columns).unionByName(later.select(F.lit(_ACTION).alias("kind"), *columns))
    own = dealt(items.select(F.col("key").alias("item_id"), F.col("vector").alias("vec")))
    state = rows.unionByName(own.select(F.lit(_WAITING_ITEM).alias("kind"), "b", "item_id", "vec"), allowMissingColumns=True)
    done = []
    while True:
        wave = state.repartition(buckets, "b").sortWithinPartitions("b", "kind", "ts", "event_id", "n").mapInArrow(_wave(rate, decay), state.schema)
        wave = written(wave, "wave")
        done.append(wave.where(F.col("kind").isin(_DONE_ITEM, _DONE_USER)))
        waiting = wave.where(F.col("kind") == _ACTION)
        if waiting.isEmpty():
            break
        told = wave.where(F.col("kind") == _MESSAGE).select(F.col("next").alias("n"), F.col("vec").alias("told"))
        handed = waiting.join(told, "n", "left").withColumn("vec", F.coalesce("vec", "told")).drop("told")
        state = handed.unionByName(wave.where(F.col("kind") == _WAITING_ITEM))
    rows = reduce(DataFrame.unionByName, done)
    is_user = F.col("kind") == _DONE_USER
    return rows.select(F.when(is_user, "users").otherwise("items").alias("side"), F.when(is_user, F.col("user_id")).otherwise(F.col("item_id")).alias("key"), F.col("vec").alias("vector"))


def linked_items(actions: DataFrame) -> DataFrame:
    """(item_id, linked): the smallest item that each is linked with through users who acted on both, directly or along a
    chain. Labels spread between items and users, and pointers are doubled, until nothing changes."""
    pairs = written(actions.select("user_id", "item_id").distinct(), "pairs")
    labels = pairs.select("item_id").distinct().withColumn("linked", F.col("item_id"))
    while True:
        users = pairs.join(labels, "item_id").groupBy("user_id").agg(F.min("linked").alias("low"))
        low = pairs.join(users, "user_id").groupBy("item_id").agg(F.min("low").alias("low"))
        moved = labels.join(low, "item_id").select("item_id", F.col("linked").alias("was"), F.least("linked", "low").alias("linked"))
        on = moved.select(F.col("item_id").alias("linked"), F.col("linked").alias("further"))
        now = written(moved.join(on, "linked").select("item_id", "was", F.least("linked", "further").alias("linked")), "links")
        labels = now.select("item_id", "linked")
        if now.where("linked <> was").isEmpty():
            return labels


def _wave(rate: float, decay: float):  # noqa: ANN202
    """One pass over sorted buckets: a bucket's items first, then its actions in order. An action whose user's vector is
    not known yet stops its item; all others go on. Actions of a batch that share neither user nor item with one between
    them are moved together (`_moved`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, np.ndarray] = {}
        held: dict[int, np.ndarray] = {}  # users whose next action is further on in this bucket, by that action
        stopped: set[int] = set()
        at, schema = None, None

        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds, b, user, item, nxt, vec = zip(*found, strict=True)
            known = {"kind": kinds, "b": b, "user_id": user, "item_id": item, "next": nxt, "vec": [x.tolist() for x in vec]}
            return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(found), f.type) for f in schema], schema=schema)

        def flush() -> list[tuple]:
            found = [(_WAITING_ITEM if i in stopped else _DONE_ITEM, at, None, i, None, v) for i, v in items.items()]
            items.clear()
            stopped.clear()
            return found

        def act(own: dict[str, list], rows: list[int]) -> tuple[list[tuple], list[int], list]:
            """What the actions of one bucket bring, those that stay, and their users' vectors where known."""
            going, source, level, stay, whose = [], [], [], [], []
            by_next: dict[int, int] = {}  # the place in `going` of the action before an action of the same user
            last: dict[int, int] = {}
            for r in rows:
                item, n = own["item_id"][r], own["n"][r]
                before = by_next.pop(n, None)
                start = own["vec"][r] if own["vec"][r] is not None else held.pop(n, None)
                if item in stopped or (before is None and start is None):
                    stopped.add(item)
                    stay.append(r)
                    whose.append((before, start))
                    continue
                level.append(1 + max(last.get(item, -1), -1 if before is None else level[before]))
                last[item] = level[-1]
                if own["next"][r] is not None and own["next_b"][r] == at:
                    by_next[own["next"][r]] = len(going)
                going.append(r)
                source.append((before, start))
            if not going:
                return [], stay, [None if x is None else list(x) for _, x in whose]
            slots = {i: k for k, i in enumerate(dict.fromkeys(own["item_id"][r] for r in going))}
            vectors = np.stack([items[i] for i in slots])
            users = np.zeros((len(going), vectors.shape[1]))
            for k, (_, start) in enumerate(source):
                if start is not None:
                    users[k] = start
            prior = np.array([-1 if p is None else p for p, _ in source])
            _moved(users, vectors, prior, np.array([slots[own["item_id"][r]] for r in going]), np.array([own["score"][r] for r in going]), np.array(level), rate, decay)
            items.update((i, vectors[k]) for i, k in slots.items())
            held.update((n, users[k].copy()) for n, k in by_next.items())
            found = []
            for k, r in enumerate(going):
                nxt = own["next"][r]
                if nxt is None:
                    found.append((_DONE_USER, at, own["user_id"][r], None, None, users[k]))
                elif own["next_b"][r] != at:
                    found.append((_MESSAGE, at, own["user_id"][r], None, nxt, users[k]))
            return found, stay, [users[p].tolist() if p is not None else None if x is None else list(x) for p, x in whose]

        for batch in batches:
            schema = batch.schema
            own = {f.name: batch.column(k).to_pylist() for k, f in enumerate(schema) if f.name in ("kind", "b", "n", "user_id", "item_id", "score", "next", "next_b", "vec")}
            found: list[tuple] = []
            stay, vectors = [], []
            edges = [r for r in range(batch.num_rows) if not r or own["b"][r] != own["b"][r - 1]] + [batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if own["b"][lo] != at:
                    found += flush()
                    at = own["b"][lo]
                actions = []
                for r in range(lo, hi):
                    if own["kind"][r] == _WAITING_ITEM:
                        items[own["item_id"][r]] = np.array(own["vec"][r])
                    else:
                        actions.append(r)
                more, left, known = act(own, actions)
                found, stay, vectors = found + more, stay + left, vectors + known
            if stay:
                part = batch.take(pa.array(stay))
                yield part.set_column(schema.get_field_index("vec"), schema.field("vec"), pa.array(vectors, schema.field("vec").type))
            if found:
                yield made(found)
        if items:
            yield made(flush())

    return run


def _moved(users: np.ndarray, items: np.ndarray, prior: np.ndarray, item: np.ndarray, score: np.ndarray, level: np.ndarray, rate: float, decay: float) -> None:
    """Moves both sides in place, level by level; no two actions of a level share a user or an item. users has a row for
    each action, which starts as that of its prior action where there is one."""
    order = np.argsort(level, kind="stable")
    for k in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        u = np.where(prior[k, None] >= 0, users[prior[k]], users[k])
        v = items[item[k]]
        error = (score[k] - np.einsum("ij,ij->i", u, v))[:, None]
        u = u + rate * (error * v - decay * u)
        users[k], items[item[k]] = u, v + rate * (error * u - decay * v)


class OnlineModel:
    """User and item vectors that follow a stream of actions, and recommendations renewed as users change.

    Everything is a table below `path`, what a batch changed in a directory of its own, so a batch that runs twice
    overwrites its own: `users` and `items` (key, vector), `kinds` (user_id, event_type, n) and `recommendations`. The
    latest row of a key is its vector; every few batches all of them are written to `users_all` and `items_all`, so a
    batch reads the last such snapshot and what came after it. Tables that a batch works with are deleted at its end.

    A batch's actions move both sides exactly as one by one would (`two_sided`); recommendations are renewed once a
    batch, for the users in it, after its last action.
    """

    def __init__(self, spark: SparkSession, path: str, dimensions: int = 50, limit: int = 10, rate: float = 0.01, decay: float = 0.001, keep_seen: bool = False, diversity: float = 0.1, snapshot_every: int = SNAPSHOT_EVERY, per_bucket: int = BUCKET_ACTIONS) -> None:
        self.spark, self.path, self.dimensions, self.limit, self.rate, self.decay = spark, path, dimensions, limit, rate, decay
        self.keep_seen, self.diversity, self.snapshot_every, self.per_bucket = keep_seen, diversity, snapshot_every, per_bucket

    def _read(self, name: str, schema: str, before: int | None = None, since: int | None = None) -> DataFrame:
        """Rows of a table's batches in [since, before); none where nothing was written yet."""
        path = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(path)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows if since is None else rows.where(F.col("batch") >= since)

    def vectors(self, side: str, before: int | None = None) -> DataFrame:
        """(key, vector): the latest vector of each user or item that has one, from batches under `before`."""
        schema = "key long, vector array<double>"
        snapshots = self._read(f"{side}_all", schema, before)
        last = snapshots.agg(F.max("batch")).first()[0]  # from the names of the folders
        rows = self._read(side, schema, before, last if last is None else last + 1)
        if last is not None:
            rows = snapshots.where(F.col("batch") == last).unionByName(rows)
        return store.distinct_latest(rows, "key", "batch").select("key", "vector")

    def _known(self, keys: DataFrame, side: str, batch: int) -> DataFrame:
        found = keys.distinct().join(self.vectors(side, batch), "key", "left")
        return found.select("key", F.coalesce("vector", hashed_start(F.col("key"), side, self.dimensions)).alias("vector"))

    def update(self, actions: DataFrame, batch: int) -> DataFrame:
        """Learns one batch of (event_id, ts, user_id, item_id, score) and, where there is one, event_type; rows with a
        null among the five are left out. The recommendations of the batch's users are written and returned."""
        columns = ["event_id", "ts", "user_id", "item_id", "score"]
        kind = F.col("event_type") if "event_type" in actions.columns else F.lit(None).cast("string")
        with scratch(self.spark):
            rows = written(actions.dropna(subset=columns).select(*columns, kind.alias("event_type")), "actions")
            users, items = (written(self._known(rows.select(F.col(c).cast("long").alias("key")), side, batch), side) for c, side in (("user_id", "users"), ("item_id", "items")))
            moved = written(two_sided(rows, users, items, self.rate, self.decay, self.per_bucket), "moved")
            for side in ("users", "items"):
                moved.where(F.col("side") == side).select("key", "vector").write.mode("overwrite").parquet(f"{self.path}/{side}/batch={batch}")
                if self.snapshot_every and batch % self.snapshot_every == self.snapshot_every - 1:
                    self.vectors(side, batch + 1).write.mode("overwrite").parquet(f"{self.path}/{side}_all/batch={batch}")
            rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/kinds/batch={batch}")
            seen = None if self.keep_seen else rows.select("user_id", "item_id").distinct()
            asked = rows.select("user_id").distinct()
            out = self.recommend(asked, seen, batch)
            out.write.mode("overwrite").parquet(f"{self.path}/recommendations/batch={batch}")
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/recommendations/batch={batch}")

    def recommend(self, users: DataFrame, seen: DataFrame | None = None, batch: int | None = None) -> DataFrame:
        """(user_id, item_id, score, rank, reason): each user's best items by the product of the vectors, plus
        `diversity` times one minus the mean product with the five best items the user was recommended before.

        The diversity of an item is one minus its product with a mean, so the score of all items is the product with
        one vector of the user, which the block-wise search takes; no pair of items is made. seen: pairs that are left
        out. The reason is the kind of action that the user takes most, ties by name.
        """
        from vectrine.operators import recommend

        schema = "user_id long, item_id long, score double, rank int, reason string"
        asked = users.join(self.vectors("users").select(F.col("key").alias("user_id"), F.col("vector").alias("u")), "user_id")
        items = written(self.vectors("items").select(F.col("key").alias("item_id"), F.col("vector").alias("embedding")), "items")
        old = self._read("recommendations", schema, batch).where("rank <= 5").join(users, "user_id", "left_semi")
        last = old.groupBy("user_id").agg(F.max("batch").alias("batch"))
        cached = old.join(last, ["user_id", "batch"]).join(items, "item_id")
        mean = search.mean_vectors(cached, "user_id").select("user_id", F.col("centroid").alias("mean"))
        turned = F.when(F.col("mean").isNull(), F.col("u")).otherwise(V.subtract(F.col("u"), V.scale(F.col("mean"), self.diversity)))
        asked = written(asked.join(mean, "user_id", "left").select("user_id", turned.alias("embedding"), F.when(F.col("mean").isNull(), 0.0).otherwise(self.diversity).alias("bonus")), "asked")
        if seen is None:
            near = search.knn(asked.select(F.col("user_id").alias("vec_id"), "embedding"), items.select(F.col("item_id").alias("vec_id"), "embedding"), self.limit, "ip", exclude_self=False)
            near = near.select(F.col("query_id").alias("user_id"), F.col("vec_id").alias("item_id"), "score", "rank")
        else:
            near = recommend.content_based(asked.select("user_id", "embedding"), items, seen, self.limit, "ip")
        kinds = self._read("kinds", "user_id long, event_type string, n long", None if batch is None else batch + 1).join(users, "user_id", "left_semi")
        counted = kinds.where("event_type is not null").groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))
        why = counted.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type"))["event_type"].alias("kind"))
        reason = F.coalesce(F.concat(F.lit("based on your "), F.col("kind"), F.lit(" history")), F.lit("new for you"))
        out = near.join(asked.select("user_id", "bonus"), "user_id").join(why, "user_id", "left")
        return out.select("user_id", "item_id", (F.col("score") + F.col("bonus")).alias("score"), "rank", reason.alias("reason"))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Learns a stream batch by batch; each batch's recommendations are a directory of `recommendations`."""

        def learn(batch: DataFrame, n: int) -> None:
            self.update(batch, n)

        return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
