"""Joins on time that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time; null without one.

    Both sides are stacked and swept once in time order within the key: one shuffle, one sort, no row meets another.
    Right rows of one time are taken as they sort by their values, the last of them wins.
    """
    rest = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.lit(1).alias("_side"), *rest, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(key, time, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(key).orderBy(time, "_side", *[f"_{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_m", last).where("_side = 1").select(key, time, *rest, *[F.col(f"_m.{v}").alias(v) for v in values])


def within_after(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key with left_time < right_time <= left_time + seconds.

    Times are cut into bins of that length; a left row looks into its own bin and the next, so the equi-join is on
    (key, bin) and a busy key is spread over its bins.
    """
    step = seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.withColumn("_lt", micros(left_time)).withColumn("_bin", F.explode(F.array(F.floor(F.col("_lt") / step), F.floor(F.col("_lt") / step) + 1)))
    b = right.withColumn("_rt", micros(right_time)).withColumn("_bin", F.floor(F.col("_rt") / step))
    return a.join(b, [key, "_bin"]).where((F.col("_rt") > F.col("_lt")) & (F.col("_rt") <= F.col("_lt") + step)).drop("_lt", "_rt", "_bin")
