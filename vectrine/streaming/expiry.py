"""A cache whose entries expire, as keyed state that follows event time.

An entry lives for a fixed time from when it was set. A request finds it (hit) or not (miss, which sets it anew); an
entry that is past its time when it is asked for, or when the watermark passes it, is evicted. The state of a key is
the end of its entry and nothing else, so it holds live entries only; counts leave as differences that add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as keyed processors need; the session's setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def requests(times: np.ndarray, until: int | None, ttl_us: int) -> tuple[int, int, int, int]:
    """(hits, misses, evictions, end of the entry) after requests at the sorted times, from an entry that ends at until."""
    hits = misses = evictions = at = 0
    while at < len(times):
        if until is None or times[at] >= until:
            evictions += until is not None
            misses, until, at = misses + 1, int(times[at]) + ttl_us, at + 1
        live = int(np.searchsorted(times, until))  # all requests before the entry's end are hits
        hits, at = hits + max(0, live - at), max(at, live)
    return hits, misses, evictions, until


class ExpiringCache(StatefulProcessor):
    def __init__(self, key: str, ttl_seconds: int) -> None:
        self.key, self.ttl_us = key, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def _row(self, key: tuple, hits: int, misses: int, evictions: int) -> Row:
        return Row(**{self.key: key[0], "hits": hits, "misses": misses, "evictions": evictions})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        times = np.sort(np.fromiter((r["at"] for r in rows), np.int64))
        before = self.until.get()[0] if self.until.exists() else None
        hits, misses, evictions, until = requests(times, before, self.ttl_us)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.until.update((until,))
            self.handle.registerTimer(self._timer(until))
        yield self._row(key, hits, misses, evictions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.until.exists() and self._timer(self.until.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield self._row(key, 0, 0, 1)

    @staticmethod
    def _timer(until_us: int) -> int:
        return -(-until_us // 1000)


def expiring_cache(stream: DataFrame, key: str, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """(key, hits, misses, evictions) as differences of each batch; their sums by key are the cache's counters.

    stream has the key (a bigint) and the event time `ts`; rows without either are left out. An entry that the watermark,
    `delay` behind the latest row, has not passed at the end is live and stays in the state. Rows later than the
    watermark are dropped, as by every operator in event time. A batch's times of one key are held together, eight bytes
    each: bound the batch by the files a trigger takes. Start it inside `rocksdb`.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("long").alias(key), "ts", F.unix_micros("ts").alias("at"))
    return rows.withWatermark("ts", delay).groupBy(key).transformWithState(ExpiringCache(key, ttl_seconds), f"`{key}` long, hits long, misses long, evictions long", "append", "EventTime")
