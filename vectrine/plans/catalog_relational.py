"""Relational queries over the star schema, an extension: joins, sets, grouping sets, windows, ranges and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.catalog import query
from vectrine.operators import temporal
from vectrine.session import table


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def r(c: object, name: str, digits: int = 2) -> object:
    return F.round(c, digits).alias(name)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), "sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue"), r(F.avg("l_discount"), "avg_disc", 6), F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, o_orderkey LIMIT 10")
def rel_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    joined = c.join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x")).orderBy(F.desc("x"), "o_orderkey").limit(10).select("o_orderkey", r("x", "revenue"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name")
def rel_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "revenue"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def rel_customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) GROUP BY 1")
def rel_parts_in_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = t(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, sf_dir, "part").join(big, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus) HAVING count(*) > 1")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(r(F.sum("o_totalprice"), "total"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, CAST(row_number() OVER w AS INTEGER) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def rel_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", r(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), "running"), F.row_number().over(w).alias("place"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem")
def rel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).exceptAll(t(spark, sf_dir, "lineitem").select("l_partkey")).distinct()


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 25 AS band, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2")
def rel_json_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 25).alias("band")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT p.event_id, v.event_id AS before_id, round(p.value, 2) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def rel_asof_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("before_id"))
    return temporal.asof_join(left, right, "user_id", "ts", ["before_id"]).select("event_id", "before_id", r("value", "value"))


@query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    v = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("pts"), F.col("event_id").alias("purchase_id"))
    return temporal.within_after(v, p, "user_id", "ts", "pts", 6 * 3600).select("view_id", "purchase_id")


@query("PIVOT (SELECT l_returnflag, year(l_shipdate) AS y, l_quantity FROM lineitem) ON l_returnflag IN ('A', 'N', 'R') USING CAST(count(*) AS BIGINT) GROUP BY y")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").cast("long").alias("y"))
    return rows.groupBy("y").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
