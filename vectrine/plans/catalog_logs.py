"""Queries over behaviour logs, conversations, growing tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.catalog import query
from vectrine.functions import vectors as V
from vectrine.operators import analytics, learn, recommend, store
from vectrine.session import table, work_path, written
from vectrine.sources import files
from vectrine.streaming import expiry, metrics, recommender

#: Clicks stand for likes and errors for skips, in batches and streams alike.
SCORES = {"view": 1.0, "click": 3.0, "purchase": 5.0, "error": -1.0}
ENGAGED = ("view", "click", "purchase")
A_SQL = "a AS (SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, event_type, value, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 5.0 WHEN 'error' THEN -1.0 ELSE 1.0 END::DOUBLE AS score FROM events)"


def r6(c: str) -> object:
    return F.round(c, 6).alias(c)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "event_type", "value", recommend.action_score(F.col("event_type"), SCORES).alias("score"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


_USERS = f"""{A_SQL}, e AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM a), h AS (SELECT user_id, score, v FROM l JOIN e USING (item_id) WHERE r <= 20),
x AS (SELECT user_id, score, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM h), m AS (SELECT user_id, d, CASE WHEN sum(score) > 0 THEN sum(score * x) / sum(score) ELSE 0 END AS x FROM x GROUP BY user_id, d),
u AS (SELECT user_id, list(x ORDER BY d) AS u FROM m GROUP BY user_id)"""


@query(f"WITH {_USERS} SELECT user_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(list_sum(u), 6) AS total FROM u")
def rec_user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = recommend.user_vectors(actions(spark, sf_dir), items(spark, sf_dir))
    return u.select("user_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.total(F.col("embedding")), 6).alias("total"))


_CONTENT = f"""{_USERS}, ci AS (SELECT user_id, item_id, CASE WHEN list_dot_product(u, u) = 0 THEN 0 ELSE list_cosine_similarity(u, v) END AS s FROM u, e),
cf AS (SELECT user_id, item_id, s, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS r FROM ci ANTI JOIN (SELECT DISTINCT user_id, item_id FROM a) t USING (user_id, item_id))"""


@query(f"WITH {_CONTENT} SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM cf WHERE r <= 5")
def rec_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, i = actions(spark, sf_dir), items(spark, sf_dir)
    return recommend.content_based(recommend.user_vectors(a, i), i, a).select("user_id", "item_id", r6("score"), "rank")


_INTEREST = _CONTENT.replace("CASE WHEN sum(score) > 0 THEN sum(score * x) / sum(score) ELSE 0 END", "avg(x)")


@query(f"WITH {_INTEREST} SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM cf WHERE r <= 5")
def rec_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain mean of each user's latest items as an interest, and the items nearest to it."""
    a, i = actions(spark, sf_dir), items(spark, sf_dir)
    users = recommend.user_vectors(a.withColumn("score", F.lit(1.0)), i)
    return recommend.content_based(users, i, a).select("user_id", "item_id", r6("score"), "rank")


_PEERS = """rt AS (SELECT user_id, item_id, arg_max(value, (ts, event_id)) AS s FROM a WHERE event_type IN ('view', 'click') GROUP BY user_id, item_id),
al AS (SELECT x.user_id, y.user_id AS peer, 1 / (1 + sqrt(avg((x.s - y.s) * (x.s - y.s)))) AS sim FROM rt x JOIN rt y USING (item_id) WHERE x.user_id <> y.user_id GROUP BY 1, 2),
nr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, peer) AS r FROM al),
br AS (SELECT nr.user_id, y.item_id, max(y.s * sim) AS s FROM nr JOIN rt y ON y.user_id = peer WHERE r <= 5 AND NOT EXISTS (SELECT 1 FROM rt z WHERE z.user_id = nr.user_id AND z.item_id = y.item_id) GROUP BY 1, 2),
pf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS r FROM br)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.ratings(actions(spark, sf_dir).withColumn("score", F.col("value")), ("view", "click"))


@query(f"WITH {A_SQL}, {_PEERS} SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM pf WHERE r <= 5")
def rec_collaborative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.collaborative(rated(spark, sf_dir)).select("user_id", "item_id", r6("score"), "rank")


@query(f"WITH {_CONTENT}, {_PEERS}, mx AS (SELECT user_id, item_id, 0.6 * s AS s FROM cf WHERE r <= 5 UNION ALL SELECT user_id, item_id, 0.4 * s FROM pf WHERE r <= 5), ms AS (SELECT user_id, item_id, sum(s) AS s FROM mx GROUP BY 1, 2), mr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS r FROM ms) SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM mr WHERE r <= 5")
def rec_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, i = actions(spark, sf_dir), items(spark, sf_dir)
    content = recommend.content_based(recommend.user_vectors(a, i), i, a)
    return recommend.mixed(content, recommend.collaborative(rated(spark, sf_dir))).select("user_id", "item_id", r6("score"), "rank")


_POPULAR = f"{A_SQL}, po AS (SELECT item_id, avg(score) AS score, count(*) AS n FROM a WHERE event_type IN ('view', 'click', 'purchase') GROUP BY item_id ORDER BY round(avg(score), 9) DESC, count(*) DESC, item_id LIMIT 10)"


@query(f"WITH {_POPULAR} SELECT item_id, round(score, 6) AS score, CAST(n AS BIGINT) AS n FROM po")
def rec_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.popular(actions(spark, sf_dir), kinds=ENGAGED).select("item_id", r6("score"), "n")


@query(f"WITH {_POPULAR}, cu AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) SELECT user_id, item_id, round(score, 6) AS score, 'popular' AS reason, false AS real_time FROM cu, po")
def rec_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any event are the new users."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    a = actions(spark, sf_dir)
    return recommend.cold_start(users, a, recommend.popular(a, kinds=ENGAGED)).select("user_id", "item_id", r6("score"), "reason", "real_time")


@query(f"WITH {A_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type, CAST(n AS BIGINT) AS n, 'based on your ' || event_type || ' history' AS reason FROM r WHERE r = 1")
def rec_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.explanation(actions(spark, sf_dir))


_BEFORE = "bf AS (SELECT user_id, e.v AS pv FROM pf JOIN e USING (item_id) WHERE r <= 5)"


@query(f"WITH {_CONTENT}, {_PEERS}, {_BEFORE}, dv AS (SELECT cf.user_id, cf.item_id, 1 - avg(list_dot_product(e.v, pv)) AS d FROM cf JOIN e USING (item_id) JOIN bf ON bf.user_id = cf.user_id WHERE cf.r <= 5 GROUP BY 1, 2) SELECT cf.user_id, cf.item_id, round(coalesce(d, 0), 6) AS diversity, round(s + 0.1 * coalesce(d, 0), 6) AS final_score FROM cf LEFT JOIN dv ON dv.user_id = cf.user_id AND dv.item_id = cf.item_id WHERE r <= 5")
def rec_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, i = actions(spark, sf_dir), items(spark, sf_dir)
    out = recommend.diversity(recommend.content_based(recommend.user_vectors(a, i), i, a), recommend.collaborative(rated(spark, sf_dir)), i)
    return out.select("user_id", "item_id", r6("diversity"), r6("final_score"))


@query(f"WITH {_POPULAR}, {_PEERS}, rq AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS test_group FROM a), sv AS (SELECT rq.user_id, item_id, s AS score, 'A' AS test_group FROM rq JOIN pf USING (user_id) WHERE test_group = 'A' AND r <= 5 UNION ALL SELECT rq.user_id, item_id, score, 'A' FROM rq, po WHERE test_group = 'A' AND rq.user_id NOT IN (SELECT user_id FROM pf WHERE r <= 5) UNION ALL SELECT user_id, item_id, score * 1.2, 'B' FROM rq, po WHERE test_group = 'B') SELECT user_id, item_id, round(score, 6) AS score, test_group FROM sv")
def rec_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir)
    requests = a.select("user_id", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("test_group")).distinct()
    return recommend.experiment(requests, recommend.collaborative(rated(spark, sf_dir)), recommend.popular(a, kinds=ENGAGED)).select("user_id", "item_id", r6("score"), "test_group")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS test_group, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS rate FROM events GROUP BY 1")
def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("test_group"), (F.col("event_type") == "click").alias("clicked"))
    return analytics.experiment_report(e).select("test_group", "n", "clicks", r6("rate"))


@query("SELECT event_type AS metric_name, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY event_type")
def metrics_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric_name"), "value", F.col("ts").cast("timestamp").alias("timestamp"))
    return analytics.recent_metrics(m, F.lit("2024-01-15 12:00:00").cast("timestamp"), 24).select("metric_name", r6("avg"), "max", "min")


@query("SELECT 'item ' || json_extract_string(props, '$.k') AS query, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view stands for a search for its item."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.concat(F.lit("item "), F.get_json_object("props", "$.k")).alias("query"))
    return analytics.top_queries(e)


@query("SELECT CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS searches, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view'), 6) AS rate FROM events")
def log_click_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return analytics.click_rate(e.where("event_type = 'view'"), e.where("event_type = 'click'")).select("searches", "clicks", r6("rate"))


_SUGGEST = """h AS (SELECT event_type || ' ' || json_extract_string(props, '$.k') AS s, max(ts) AS o FROM events GROUP BY 1), hq AS (SELECT s, row_number() OVER (ORDER BY o DESC, s) AS r FROM h WHERE s ILIKE 'cl%' AND length(s) > 2 QUALIFY r <= 10),
t AS (SELECT url AS s, max(page_id) AS o FROM pages GROUP BY 1), tq AS (SELECT s, row_number() OVER (ORDER BY o DESC, s) AS r FROM t WHERE s ILIKE '%cl%' QUALIFY r <= 10), u AS (SELECT s, 0 AS l, r FROM hq UNION ALL SELECT s, 1, r FROM tq)"""


@query(f"WITH {_SUGGEST} SELECT suggestion FROM (SELECT s AS suggestion, min((l, r)) AS o FROM u GROUP BY s ORDER BY o LIMIT 10)")
def log_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), F.col("ts").alias("timestamp"))
    t = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.col("page_id").alias("view_count"))
    return analytics.suggestions(h, t, "cl")


@query("SELECT 'documents' AS \"table\", count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def log_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overview({n: table(spark, sf_dir, n) for n in ("documents", "events", "embeddings")})


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(n_chars), 0), 6) AS chars FROM documents GROUP BY lang, source")
def log_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(analytics.average_or_zero("n_chars"), 6).alias("chars"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '系统' ELSE '用户' END || ': ' || coalesce(text, '') AS line FROM conversations)
SELECT conv_id, turn, md5(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS context FROM l""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.context_window(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("context").alias("context"))


# --- growing tables


@query("""WITH n AS (SELECT CAST(d.doc_id AS VARCHAR) AS title, d.text AS content, 'q' || l.quality AS category FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT 'b' || item_id, text, 'benchmark' FROM benchmark),
o AS (SELECT CAST(doc_id AS VARCHAR) AS title, text AS content, lang AS category FROM documents)
SELECT coalesce(o.title, n.title) AS title, md5(coalesce(o.content, n.content)) AS content, coalesce(n.category, o.category) AS category, CAST(CASE WHEN o.title IS NULL OR n.title IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version FROM o FULL JOIN n ON o.title = n.title AND o.content = n.content""")
def kb_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the old entries; labelled ones come again with a new category, benchmark items are new."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), "lang")
    labelled = d.join(table(spark, sf_dir, "labels"), "doc_id").select("title", "content", F.concat(F.lit("q"), "quality").alias("category"))
    fresh = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("title"), F.col("text").alias("content"), F.lit("benchmark").alias("category"))
    out = store.incremental_merge(d.select("title", "content", F.col("lang").alias("category"), F.lit(1).cast("long").alias("version")), labelled.unionByName(fresh))
    return out.select("title", F.md5("content").alias("content"), "category", "version")


@query("SELECT d.doc_id AS id, CAST(coalesce(l.quality, d.n_chars) AS BIGINT) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def kb_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels replace the rows of their documents."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("value"))
    return store.upsert(old, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("value")))


@query("SELECT vec_id AS item_id, CAST(count(event_id) AS BIGINT) AS views FROM embeddings LEFT JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) ON k = vec_id GROUP BY vec_id")
def kb_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_counts(items(spark, sf_dir).select("item_id"), actions(spark, sf_dir), "item_id", "item_id", "views")


@query(f"WITH {A_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM a) SELECT user_id, event_id, event_type FROM r WHERE r = 1")
def kb_latest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_latest(actions(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT range AS id, ['alpha', 'beta', 'gamma'][range % 3 + 1] || ' - 版本' || (range + 1) AS text FROM range(1000)")
def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.variants(spark, ["alpha", "beta", "gamma"], 1000)


@query()
def source_template_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.template_corpus(spark, "retrieval", 1000)


# --- streams, run over what is there


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path is a pattern, which a stream reads whether the table is one file or a folder."""
    return recommender.actions(spark, f"{sf_dir}/event[s].parquet", scores=SCORES)


@query("SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode, so late rows count too."""
    out = recommender.run_to_table(recommender.windowed(_stream(spark, sf_dir)), "daily")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT ts, event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recommender.run_to_table(recommender.windowed(_stream(spark, sf_dir), size="2 hours", slide="1 hour"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recommender.run_to_table(recommender.sessions(_stream(spark, sf_dir)), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def stream_online_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommender.run_to_table(recommender.online_users(_stream(spark, sf_dir)), "online")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM e),
m AS (SELECT user_id, min(ts) AS t FROM e GROUP BY user_id UNION ALL SELECT m.user_id, e.ts FROM m ASOF JOIN e ON m.user_id = e.user_id AND m.t + INTERVAL 1 DAY <= e.ts),
s AS (SELECT user_id, count(*) AS misses, max(t) + INTERVAL 1 DAY AS until FROM m GROUP BY user_id)
SELECT user_id, CAST(n - misses AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CAST(misses - (until > w)::INT AS BIGINT) AS evictions FROM s JOIN n USING (user_id), w""")
def stream_expiring_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and evictions by user of a cache whose entries live for a day."""
    with expiry.rocksdb(spark):
        rows = recommender.run_to_table(expiry.expiring_cache(_stream(spark, sf_dir), "user_id", 86_400), "cache", "append")
    return rows.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "evictions")])


@query("SELECT CAST(0 AS BIGINT) AS batch, unnest(['input_rows', 'rows']) AS metric_name, CAST(count(*) AS DOUBLE) AS value FROM events")
def stream_metric_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of a stream reported: the rows it read and those it observed. Rates and active users, which are
    timed and sketched, are in the table too and not compared."""
    at = work_path(spark, "ticks")
    with metrics.reported(spark, f"{at}/metrics"):
        recommender.to_table(metrics.observed(_stream(spark, sf_dir)), f"{at}/rows", f"{at}/state").awaitTermination()
    rows = metrics.ticks(spark, f"{at}/metrics").where(F.col("metric_name").isin("input_rows", "rows"))
    return rows.select("batch", "metric_name", "value")


@query()
def stream_user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recommender.run_to_table(recommender.user_state(_stream(spark, sf_dir)), "vectors", "update", ["user_id"])
    return out.select("user_id", "n", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e), m AS (SELECT list(x ORDER BY d) AS c FROM (SELECT d, avg(x) AS x FROM u GROUP BY d)), w AS (SELECT vec_id, list_distance(v, c) AS d FROM e, m), h AS (SELECT avg(d) + 2 * stddev_pop(d) AS t FROM w) SELECT vec_id, round(d, 6) AS distance, 'high' AS severity FROM w, h WHERE d > t")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    live = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/embedding[s].parquet")
    out = recommender.run_to_table(recommender.alerts(live, learn.profile(df)), "alerts", "append")
    return out.select("vec_id", r6("distance"), "severity")


_START = "list_transform(range(0, 50), lambda d: (CAST(('0x' || substr(md5({k} || ':{s}:' || d), 1, 7)) AS BIGINT) / 268435456.0 - 0.5) * 0.2)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_STEP = "list_transform(list_zip({a}, {b}), lambda z: z[1] + 0.01 * ({e} * z[2] - 0.001 * z[1]))"


@query(f"""WITH {A_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ru, row_number() OVER (PARTITION BY item_id ORDER BY ts, event_id) AS ri FROM a WHERE item_id IS NOT NULL),
o AS (SELECT user_id, item_id, score, {_START.format(k="user_id", s="users")} AS u, {_START.format(k="item_id", s="items")} AS i FROM f WHERE ru = 1 AND ri = 1),
e AS (SELECT *, score - {_DOT.format(a="u", b="i")} AS e FROM o), n AS (SELECT *, {_STEP.format(a="u", b="i", e="e")} AS nu FROM e)
SELECT user_id, item_id, round(list_sum(nu), 6) AS user_total, round({_DOT.format(a="nu", b="nu")}, 6) AS user_square, round(list_sum({_STEP.format(a="i", b="nu", e="e")}), 6) AS item_total FROM n""")
def online_first_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides after the actions that are the first of their user and of their item, learned as one batch."""
    a = actions(spark, sf_dir).where("item_id is not null")
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    batch = written(a.withColumn("_u", first("user_id")).withColumn("_i", first("item_id")).where("_u = 1 and _i = 1").select("event_id", "ts", "user_id", "item_id", "score"), "first")
    model = recommender.OnlineModel(spark, work_path(spark, "model"))
    model.update(batch, 0)
    side = lambda name, key: model.vectors(name).select(F.col("key").alias(key), F.col("vector").alias(name))
    out = batch.select("user_id", "item_id").join(side("users", "user_id"), "user_id").join(side("items", "item_id"), "item_id")
    return out.select("user_id", "item_id", F.round(V.total(F.col("users")), 6).alias("user_total"), F.round(V.dot(F.col("users"), F.col("users")), 6).alias("user_square"), F.round(V.total(F.col("items")), 6).alias("item_total"))


def _folded(name: str, until: str = "true") -> str:
    """Tables of a state named so: both sides' vectors after the actions until then, one by one. Each step of the
    recursion takes every action that is the next one of its user and of its item, and replaces their rows; k counts
    the actions that a row has seen."""
    moved = _STEP.format(a="{a}", b="{b}", e="e")
    rank = "row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id)"
    return f"""{name}_o AS MATERIALIZED (SELECT user_id, item_id, score, {rank.format("user_id")} AS ru, {rank.format("item_id")} AS ri FROM a WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND {until}),
{name}(side, id, k, v) USING KEY (side, id) AS (SELECT 'users' AS side, user_id AS id, CAST(0 AS BIGINT) AS k, {_START.format(k="user_id", s="users")} AS v FROM (SELECT DISTINCT user_id FROM {name}_o)
UNION ALL SELECT 'items', item_id, 0, {_START.format(k="item_id", s="items")} FROM (SELECT DISTINCT item_id FROM {name}_o)
UNION SELECT unnest(['users', 'items']), unnest([user_id, item_id]), unnest([ru, ri]), unnest([nu, {moved.format(a="i", b="nu")}]) FROM (SELECT *, {moved.format(a="u", b="i")} AS nu
FROM (SELECT o.user_id, o.item_id, o.ru, o.ri, u.v AS u, i.v AS i, o.score - list_dot_product(u.v, i.v) AS e FROM (SELECT 1 FROM {name} LIMIT 1) s, recurring.{name} u JOIN {name}_o o ON u.side = 'users' AND u.id = o.user_id AND o.ru = u.k + 1
JOIN recurring.{name} i ON i.side = 'items' AND i.id = o.item_id AND o.ri = i.k + 1)))"""


def _why(name: str, until: str = "true") -> str:
    return f"{name}_w AS (SELECT user_id, 'based on your ' || event_type || ' history' AS reason FROM (SELECT user_id, event_type, count(*) AS n FROM a WHERE item_id IS NOT NULL AND {until} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)"


@query(f"WITH RECURSIVE {A_SQL}, {_folded('f')} SELECT side, id AS key, round(list_sum(v), 6) AS total, round(list_dot_product(v, v), 6) AS square FROM f WHERE side <> 'at'")
def online_all_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides after all actions, learned as one batch and as one by one."""
    model = recommender.OnlineModel(spark, work_path(spark, "model"))
    model.update(actions(spark, sf_dir), 0)
    side = lambda name: model.vectors(name).select(F.lit(name).alias("side"), "key", F.round(V.total(F.col("vector")), 6).alias("total"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("square"))
    return side("users").unionByName(side("items"))


_TOP = "SELECT u.id AS user_id, i.id AS item_id, list_dot_product(u.v, i.v) AS s FROM {0} u JOIN {0} i ON u.side = 'users' AND i.side = 'items'"
_BEST = "row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id)"


@query(f"WITH RECURSIVE {A_SQL}, {_folded('f')}, {_why('f')}, t AS (SELECT *, {_BEST} AS r FROM ({_TOP.format('f')}) QUALIFY r <= 10) SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank, reason FROM t JOIN f_w USING (user_id)")
def online_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all events learned by both sides; every user's ten best items, those acted on included, after the
    last batch that user is in, with the reason."""
    model = recommender.OnlineModel(spark, work_path(spark, "model"), keep_seen=True)
    model.follow(_stream(spark, sf_dir), work_path(spark, "follow")).awaitTermination()
    return _served(model)


def _served(model: recommender.OnlineModel) -> DataFrame:
    """The recommendations of each user's last batch."""
    rows = model.spark.read.parquet(f"{model.path}/recommendations")
    last = F.max("batch").over(Window.partitionBy("user_id"))
    return rows.withColumn("_l", last).where("batch = _l").select("user_id", "item_id", r6("score"), "rank", "reason")


_HALF = "ts < TIMESTAMP '2024-01-16 00:00:00'"


@query(f"""WITH RECURSIVE {A_SQL}, {_folded('h', _HALF)}, {_folded('f')}, {_why('h', _HALF)}, {_why('f')}, t1 AS (SELECT *, {_BEST} AS r FROM ({_TOP.format('h')}) QUALIFY r <= 10),
p AS (SELECT user_id, i.id AS item_id, i.v FROM t1 JOIN f i ON i.side = 'items' AND i.id = t1.item_id WHERE r <= 5), again AS (SELECT DISTINCT user_id FROM a WHERE item_id IS NOT NULL AND NOT ({_HALF})),
d AS (SELECT p.user_id, i.id AS item_id, 1 - avg(list_dot_product(p.v, i.v)) AS d FROM p JOIN f i ON i.side = 'items' GROUP BY 1, 2),
t2 AS (SELECT *, {_BEST} AS r FROM (SELECT t.user_id, t.item_id, t.s + coalesce(0.1 * d, 0) AS s FROM ({_TOP.format('f')}) t JOIN again USING (user_id) LEFT JOIN d ON d.user_id = t.user_id AND d.item_id = t.item_id) QUALIFY r <= 10)
SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank, reason FROM t2 JOIN f_w USING (user_id)
UNION ALL SELECT user_id, item_id, round(s, 6), CAST(r AS INTEGER), reason FROM t1 JOIN h_w USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM again)""")
def online_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the second renews its users' recommendations with a bonus for what differs from the five best before."""
    model, rows = recommender.OnlineModel(spark, work_path(spark, "model"), keep_seen=True), actions(spark, sf_dir)
    for batch, part in enumerate((rows.where(_HALF), rows.where(f"NOT ({_HALF})"))):
        model.update(part, batch)
    return _served(model)
