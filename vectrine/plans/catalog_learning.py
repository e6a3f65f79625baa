"""Queries of classification, anomalies, clusters and projections over the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.catalog import query
from vectrine.operators import hierarchy, learn, projection, search
from vectrine.plans.catalog_vectors import _CENTROIDS, E_SQL, r6, vectors

_SCORES = f"{E_SQL}, {_CENTROIDS}, s AS (SELECT vec_id, label, class, list_cosine_similarity(v, c) AS s FROM e, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, class) AS r FROM s)"


@query(f"WITH {_SCORES} SELECT vec_id, class, round(s, 6) AS score FROM b WHERE r = 1")
def classify_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.best_class(df, learn.centroids(df)).select("vec_id", "class", r6("score"))


@query(f"WITH {_SCORES} SELECT vec_id, class, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT vec_id, class, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, class) AS r FROM s WHERE s >= 0.2)")
def classify_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.classify(df, learn.centroids(df), 0.2).select("vec_id", "class", r6("score"), "rank")


@query(f"WITH {_SCORES} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (class = label) AS BIGINT) AS correct, round(count(*) FILTER (class = label) / count(*), 6) AS accuracy FROM b WHERE r = 1 AND s >= 0.1 GROUP BY label")
def classify_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.accuracy(learn.best_class(df, learn.centroids(df), 0.1)).select("label", "n", "correct", r6("accuracy"))


@query(f"WITH {_SCORES} SELECT CAST(t AS DOUBLE) AS threshold, CAST(count(*) FILTER (s >= t) AS BIGINT) AS classified FROM b, (SELECT unnest([0.1, 0.2, 0.3, 0.5]) AS t) WHERE r = 1 GROUP BY t")
def classify_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    best = learn.best_class(df, learn.centroids(df)).select("score", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.2, 0.3, 0.5)])).alias("threshold"))
    return best.groupBy("threshold").agg(F.sum((F.col("score") >= F.col("threshold")).cast("long")).alias("classified"))


@query(f"WITH {E_SQL}, {_CENTROIDS}, mg AS (SELECT vec_id, round(list_cosine_similarity(v, p.c) - list_cosine_similarity(v, n.c), 9) AS m FROM e, c p, c n WHERE p.class = 0 AND n.class = 1) SELECT vec_id, round(m, 6) AS margin, CASE WHEN m > 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM mg")
def classify_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two centroids, of labels 0 and 1, stand for the two sentiments."""
    df = vectors(spark, sf_dir)
    known = dict(learn.centroids(df))
    return learn.sentiment(df, known[0], known[1]).select("vec_id", r6("margin"), "sentiment")


_PROFILE = f"{E_SQL}, u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e), m AS (SELECT list(x ORDER BY d) AS c FROM (SELECT d, avg(x) AS x FROM u GROUP BY d)), w AS (SELECT vec_id, v, c, list_distance(v, c) AS d FROM e, m), h AS (SELECT avg(d) + 2 * stddev_pop(d) AS t FROM w), f AS (SELECT vec_id, d, d > t AS bad, CASE WHEN d > t THEN least(d / t, 1) ELSE 1 - d / t END AS conf, list_cosine_similarity(v, c) AS sim FROM w, h)"


@query(f"WITH {_PROFILE} SELECT vec_id, round(d, 6) AS distance, bad AS is_anomaly, round(conf, 6) AS confidence FROM f")
def anomaly_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.distance_anomalies(df, learn.profile(df)).select("vec_id", r6("distance"), "is_anomaly", r6("confidence"))


@query(f"WITH {_PROFILE} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (bad) AS BIGINT) AS anomalies, CAST(count(*) FILTER (bad AND conf > 0.8) AS BIGINT) AS high, CAST(count(*) FILTER (bad AND conf BETWEEN 0.5 AND 0.8) AS BIGINT) AS medium, CAST(count(*) FILTER (bad AND conf < 0.5) AS BIGINT) AS low, round(count(*) FILTER (bad) / count(*), 6) AS rate FROM f")
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    out = learn.anomaly_report(learn.distance_anomalies(df, learn.profile(df)))
    return out.select("total", "anomalies", "high", "medium", "low", r6("rate"))


@query(f"WITH {_PROFILE} SELECT vec_id, round(sim, 6) AS similarity, sim < 0.05 AS is_anomaly FROM f")
def anomaly_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.similarity_anomalies(df, learn.profile(df)[0], 0.05).select("vec_id", r6("similarity"), "is_anomaly")


@query(f"""WITH {E_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 / (1 + list_distance(a.v, b.v)), 9) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id),
n AS (SELECT a, b, d FROM p WHERE r <= 5), kd AS (SELECT a, max(d) AS kd FROM n GROUP BY a),
re AS (SELECT n.a, n.b, greatest(n.d, kd.kd) AS reach FROM n JOIN kd ON kd.a = n.b), l AS (SELECT a, 1 / (avg(reach) + 1e-10) AS lrd FROM re GROUP BY a),
o AS (SELECT re.a, avg(l.lrd) AS nb FROM re JOIN l ON l.a = re.b GROUP BY re.a),
f AS (SELECT o.a AS vec_id, o.nb / l.lrd AS lof FROM o JOIN l ON l.a = o.a) SELECT vec_id, round(lof, 6) AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS is_anomaly FROM f""")
def anomaly_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.local_outlier_factor(vectors(spark, sf_dir)).select("vec_id", r6("lof"), "is_anomaly")


@query()
def anomaly_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.isolation_forest(vectors(spark, sf_dir))


@query()
def anomaly_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return learn.one_class_boundary(df, df)


@query()
def anomaly_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    votes = [learn.distance_anomalies(df, learn.profile(df)), learn.isolation_forest(df), learn.local_outlier_factor(df), learn.one_class_boundary(df, df)]
    return learn.ensemble(votes)


@query()
def cluster_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = learn.kmeans(vectors(spark, sf_dir), 5)
    return learn.cluster_summary(out, id_col="vec_id")


@query()
def cluster_best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, inertia, silhouette, best) for two to eight clusters, each the best of ten starts."""
    best, seen = learn.best_k(vectors(spark, sf_dir))
    return spark.createDataFrame([(k, a, b, k == best) for k, (a, b) in seen.items()], "k int, inertia double, silhouette double, best boolean")


@query()
def cluster_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters of all vectors by Ward's agglomeration, exactly."""
    return hierarchy.ward(vectors(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {E_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 1.1), k AS (SELECT a AS v FROM p GROUP BY a HAVING count(*) + 1 >= 3),
g AS (SELECT a, b FROM p WHERE a IN (SELECT v FROM k) AND b IN (SELECT v FROM k)), r AS (SELECT v, v AS c FROM k UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v AND r.c < g.b), l AS (SELECT v, min(c) AS label FROM r GROUP BY v),
x AS (SELECT p.a AS v, min(label) AS border FROM p JOIN l ON l.v = p.b GROUP BY p.a) SELECT vec_id, coalesce(l.label, border, -1) AS cluster FROM e LEFT JOIN l ON l.v = vec_id LEFT JOIN x ON x.v = vec_id""")
def cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.dbscan(vectors(spark, sf_dir), 1.1, 3)


@query()
def project_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = learn.pca(vectors(spark, sf_dir), 3)
    return out.select("vec_id", F.transform("point", lambda x: F.round(x, 6)).alias("point"))


@query()
def project_tsne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of all vectors; not in SQL, a test compares the neighbours it keeps with the plain method's."""
    return projection.tsne(vectors(spark, sf_dir)).select("vec_id", r6("x"), r6("y"))


@query(f"WITH {E_SQL}, t AS (SELECT vec_id, label, list_dot_product(v, q) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM e, q) SELECT vec_id, label, CAST(place AS INTEGER) AS place, round(x, 6) AS value, round(x - lag(x) OVER (PARTITION BY label ORDER BY vec_id), 6) AS step FROM t")
def project_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-dimensional course within each label, along the direction of vector 0."""
    from vectrine.functions import vectors as V

    df = vectors(spark, sf_dir)
    out = learn.trajectory(df, "label", "vec_id", V.dot(F.col("embedding"), V.literal(search.vector_of(df, 0))))
    return out.select("vec_id", "label", "place", r6("value"), r6("step"))


@query()
def cluster_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three algorithms over all vectors; eps as surveyed leaves these vectors, which lie far apart, as noise, so a
    second one at which groups appear stands beside it."""
    return learn.compare_algorithms(vectors(spark, sf_dir), eps=(0.6, 1.1))
