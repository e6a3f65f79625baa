"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.common import held_out, work_path

TIKTOKEN_RANKS = "byte_bpe_50k.tiktoken"
PACKING_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column, kind: Callable[[Column], Column]) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import media

    return media.store_and_read(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import topk

    rows = _table(spark, sf_dir, "embeddings")
    return topk.exact_topk(rows, rows["vec_id"] % 50 == 0, k=5)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import pii

    found = pii.scan(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    kind = lambda s: s["kind"]
    return found.select("doc_id", *map(of, pii.BASE), F.sha2(_joined(base, kind), 256).alias("base_sha256"), _joined(F.col("spans"), kind).alias("spans"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TIKTOKEN_RANKS), public_tokenizers.PATTERN)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import secrets

    return _secrets_digest(secrets.scan(_table(spark, sf_dir, "documents")))


def secrets_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger over two runs: the documents by the base rules, then documents and benchmark items by all rules. The
    second run scans the items' blobs by every rule and the documents' blobs by the added rules only, and its findings
    for the documents are those of a single run."""
    from vectrine.llm import secrets

    docs, ledger = _table(spark, sf_dir, "documents").select("doc_id", "text"), work_path(spark, "ledger")
    secrets.scan(docs, ledger, secrets.BASE_RULES)
    items = _table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    found = secrets.scan(secrets.union_of([docs, items]), ledger)
    return _secrets_digest(found.where("doc_id >= 0 or doc_id is null"))


def _secrets_digest(found: DataFrame) -> DataFrame:
    from vectrine.llm import secrets

    kind = lambda s: F.split_part(s["rule"], F.lit("@"), F.lit(1))
    n_base = len(secrets.BASE_RULES)
    of = lambda k, r: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{r.kind}")
    base = F.filter("spans", lambda s: s["kind"] < n_base)
    return found.select("doc_id", *[of(k, r) for k, r in enumerate(secrets.BASE_RULES)], F.sha2(_joined(base, kind), 256).alias("base_sha256"), _joined(F.col("spans"), kind).alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import language

    docs = _table(spark, sf_dir, "documents")
    known = language.train(docs, ~held_out(F.col("doc_id")))
    return language.identify(docs, known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import suffixes

    out = suffixes.strip_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import warc

    return warc.store_and_read(_table(spark, sf_dir, "pages"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrine.llm import fim

    out = fim.transform(_table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50, unit="line")
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_packing, op3_neardup, op4_media, op5_topk, op6_pii, op7_bpe, op8_secrets, op9_language, op10_suffixes, op11_warc, op12_fim, secrets_two_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_neardup": OP3_SQL, "op5_topk": OP5_SQL, "op8_secrets": op8_sql(), "secrets_two_runs": op8_sql(), "op10_suffixes": OP10_SQL, "op11_warc": OP11_SQL, "op12_fim": OP12_SQL}


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(31))]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]) END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
c AS (SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY v)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
x AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id),
k AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM x),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM k),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM sp),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM m
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM t),
n AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op8_sql() -> str:
    """Places come from the text between matches and the matches, as in the operator's own expression."""
    from vectrine.llm import secrets

    lists = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
        start = f"CAST({lengths('b' + str(k) + '[1:i]')} + {lengths('m' + str(k) + '[1:i - 1]')} AS BIGINT)"
        span = f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(v{k}[i]) >= {r.least}), lambda i: {{'s': {start}, 'k': {k}, 'e': {start} + length(m{k}[i])}})"
        lists.append((f"regexp_extract_all(t, '{p}') AS m{k}, regexp_extract_all(t, '{p}', {r.group}) AS v{k}, string_split_regex(t, '{p}') AS b{k}", span))
    names = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    joined = lambda x: f"array_to_string(list_transform({x}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    n = lambda k, r: f"CAST(len(list_filter(a, lambda x: x.k = {k})) AS BIGINT) AS n_{r.kind}"
    base = len(secrets.BASE_RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {", ".join(x for x, _ in lists)} FROM t),
s AS (SELECT doc_id, list_sort(flatten([{", ".join(x for _, x in lists)}])) AS a FROM m)
SELECT doc_id, {", ".join(n(k, r) for k, r in enumerate(secrets.BASE_RULES))}, sha256({joined(f"list_filter(a, lambda x: x.k < {base})")}) AS base_sha256, {joined("a")} AS spans FROM s
"""
