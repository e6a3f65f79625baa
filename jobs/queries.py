"""The jobs as registered queries: each runs twice into one new folder and returns the whole output, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import knowledge_base, recommendations
from vectrine.plans import catalog_logs as logs
from vectrine.plans import catalog_text as texts
from vectrine.session import work_path


def job1_knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work_path(spark, "job1")
    for _ in range(2):
        knowledge_base.run(spark, f"{sf_dir}/documents.parquet", f"{at}/knowledge", f"{at}/checkpoint")
    out = knowledge_base.current(spark, f"{at}/knowledge")
    return out.select("doc_id", "chunk_index", "lang", "source", "content", "token_count", "embedding")


def job2_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work_path(spark, "job2")
    for _ in range(2):
        recommendations.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/embeddings.parquet", f"{sf_dir}/customer.parquet", at)
    return recommendations.made(spark, at)


_TOKENS = texts._embedded("cv", f"SELECT {{'d': doc_id, 'k': chunk_index}} AS id, unnest({texts._TOK.replace('text', 'content')}) AS term FROM x")

JOB1_SQL = (
    f"""WITH RECURSIVE r AS (SELECT doc_id, nullif(lang, '') AS lang, source, {texts._SPACES} AS body FROM documents WHERE doc_id IS NOT NULL AND length({texts._SPACES}) > 0),
d AS (SELECT doc_id, lang, source, body AS text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(body) DESC, coalesce(lang, '') DESC, coalesce(source, '') DESC) = 1),"""
    + r"""c AS (SELECT doc_id, text, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM d
UNION ALL SELECT doc_id, text, k + 1, CASE WHEN b IS NULL THEN 0 ELSE b - 50 END, CASE WHEN s + 200 < length(text) AND p > 101 THEN s + p ELSE s + 200 END
FROM (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE b - 50 END AS s, length(regexp_replace(substr(text, CASE WHEN b IS NULL THEN 1 ELSE b - 49 END, 200), '[^。.\n]*$', '')) AS p FROM c) WHERE s < length(text)),"""
    + f"""w AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, {texts._STRIP.format("substr(text, a + 1, b - a)")} AS content FROM c WHERE k > 0), x AS (SELECT * FROM w WHERE length(content) > 0), {_TOKENS},
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM cv)
SELECT x.doc_id, x.chunk_index, lang, source, content, CAST(floor(length(regexp_replace(content, '[^一-鿿]', '', 'g')) / 1.5 + (length(content) - length(regexp_replace(content, '[^一-鿿]', '', 'g'))) / 4.0) AS INTEGER) AS token_count,
  list_transform(range(0, 64), lambda i: CASE WHEN coalesce(n.n, 0) = 0 THEN 0.0::DOUBLE ELSE round(v[i + 1] / n.n, 4) END) AS embedding
FROM x JOIN d USING (doc_id) LEFT JOIN n ON n.id = {{'d': x.doc_id, 'k': x.chunk_index}}"""
)

JOB2_SQL = f"""WITH {logs._CONTENT}, {logs._PEERS}, mx AS (SELECT user_id, item_id, 0.6 * s AS s FROM cf WHERE r <= 5 UNION ALL SELECT user_id, item_id, 0.4 * s FROM pf WHERE r <= 5),
ms AS (SELECT user_id, item_id, sum(s) AS s FROM mx GROUP BY 1, 2), mr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS r FROM ms QUALIFY r <= 5),
po AS (SELECT item_id, avg(score) AS s, count(*) AS n FROM a WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY item_id ORDER BY round(avg(score), 9) DESC, count(*) DESC, item_id LIMIT 10),
pr AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, item_id) AS r FROM po QUALIFY r <= 5),
ex AS (SELECT user_id, 'based on your ' || event_type || ' history' AS reason FROM (SELECT user_id, event_type, count(*) AS n FROM a WHERE item_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
us AS (SELECT CAST(c_custkey AS BIGINT) AS user_id FROM customer UNION SELECT user_id FROM a WHERE item_id IS NOT NULL),
sv AS (SELECT user_id, item_id, s, r, reason, true AS real_time FROM mr JOIN ex USING (user_id)
  UNION ALL SELECT us.user_id, item_id, s, r, 'popular', false FROM us, pr WHERE us.user_id IS NOT NULL AND us.user_id NOT IN (SELECT user_id FROM mr))
SELECT user_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank, reason, real_time, (SELECT CAST(max(ts) AS DATE) FROM events) AS as_of, CAST(user_id % 8 AS INTEGER) AS bucket FROM sv"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_knowledge_base, job2_recommendations)}


def oracle_sql() -> dict[str, str]:
    return {"job1_knowledge_base": JOB1_SQL, "job2_recommendations": JOB2_SQL}
