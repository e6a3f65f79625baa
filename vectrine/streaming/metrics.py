"""Metrics of running streams, kept as a table: what each batch observed and how fast it was.

The metrics are observed while a batch runs, so they cost no pass of their own; a listener takes them from the progress
that Spark reports after each batch and appends them to a table of (query, batch, metric_name, value, timestamp).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

TICKS = "query string, batch long, metric_name string, value double, timestamp timestamp"


def observed(stream: DataFrame, name: str = "actions", user_col: str = "user_id") -> DataFrame:
    """stream with its rows and active users counted in each batch; users by a sketch of fixed size."""
    return stream.observe(name, F.count("*").cast("double").alias("rows"), F.approx_count_distinct(user_col).cast("double").alias("active_users"))


class MetricTicks(StreamingQueryListener):
    """Appends a row for each metric of each batch to `path`: the observed ones, the rows read and the rates.

    A batch is reported once it has ended; one that is repeated after a failure is reported for its own query run only,
    so (query, batch) may come twice and the latest timestamp holds. Batches without rows are not reported.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.open: set[str] = set()  # runs that have begun and not been reported to have ended

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.open.add(str(event.runId))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.open.discard(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        if not p.numInputRows:
            return
        found = {"input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "batch_ms": p.batchDuration}
        for row in p.observedMetrics.values():
            found |= {k: v for k, v in row.asDict().items() if v is not None}
        rows = [(p.name or str(p.id), p.batchId, k, float(v), p.timestamp) for k, v in sorted(found.items())]
        ticks = self.spark.createDataFrame(rows, TICKS.replace("timestamp timestamp", "timestamp string"))
        ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)


@contextmanager
def reported(spark: SparkSession, path: str, patience: float = 30.0) -> Iterator[MetricTicks]:
    """Streams that run inside report to `path`; the end waits until reports that are on their way have come."""
    listener = MetricTicks(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        end = time.monotonic() + patience
        while listener.open and time.monotonic() < end:
            time.sleep(0.1)
        spark.streams.removeListener(listener)


def ticks(spark: SparkSession, path: str) -> DataFrame:
    """The latest report of each metric of each batch."""
    rows = spark.read.schema(TICKS).parquet(path)
    return rows.groupBy("query", "batch", "metric_name").agg(F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp"))
