"""A deterministic embedder and the registry that other embedders plug into.

The default hashes tokens into buckets with signs from their MD5 digest and normalises the sums. It is a stand-in for
a model: the same text gives the same vector in every process and in SQL, but it knows no meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions import text as T
from vectrine.functions import vectors as V

#: Hexadecimal digits of the digest that make the bucket; the next one gives the sign.
BUCKET_DIGITS = 4
#: Bound of a worker's memo of token digests, about 20 MB; the ones asked for last are kept.
MAX_KNOWN = 100_000
#: Rows whose terms a worker unfolds at once.
ROWS_AT_ONCE = 256
#: Different terms of a batch that a worker holds as Python objects at once.
TERMS_AT_ONCE = 1 << 16


def token_bucket(token: Column, dimensions: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, BUCKET_DIGITS), 16, 10).cast("int") % dimensions).cast("int")


def token_sign(token: Column) -> Column:
    return F.when(F.substring(F.md5(token), BUCKET_DIGITS + 1, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed_embedding(text: Column, dimensions: int) -> Column:
    """Sum of signed token buckets, normalised; a text without tokens gives zeros. One fold over the tokens."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    step = F.transform(T.word_tokens(text), lambda t: F.struct(token_bucket(t, dimensions).alias("b"), token_sign(t).alias("s")))
    return V.normalize(F.aggregate(step, zero, lambda acc, t: F.transform(acc, lambda x, j: F.when(j == t["b"], x + t["s"]).otherwise(x))))


def embed_table(df: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """(id, embedding) by a pre-aggregated token table: one pass, no array is searched once for each bucket.

    Rows without tokens are left out; join back and fill where they matter.
    """
    tokens = df.select(F.col(id_col).alias("id"), F.explode(T.word_tokens(F.col(text_col))).alias("t"))
    sums = tokens.groupBy("id", token_bucket(F.col("t"), dimensions).alias("b")).agg(F.sum(token_sign(F.col("t"))).alias("s"))
    pairs = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "s"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return pairs.select("id", V.normalize(dense).alias("embedding"))


def embed_terms(forward: DataFrame, dimensions: int) -> DataFrame:
    """(id, embedding) of (doc_id, terms array<struct<term, tf>>): `embed_table` from terms that are counted already.

    Each row is embedded by itself, without a shuffle, and each term of a batch hashed once. Rows without terms are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for vectors in sums_of_terms(batch.column(1), dimensions):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(vectors)), vectors], ["id", "embedding"])
                at += len(vectors)

    kind = forward.schema["doc_id"].dataType.simpleString()
    return forward.where(F.size("terms") > 0).select("doc_id", "terms").mapInArrow(run, f"id {kind}, embedding array<double>")


def sums_of_terms(terms: pa.ListArray, dimensions: int) -> Iterator[pa.ListArray]:
    """The embedding of each row of counted terms, by slices of ROWS_AT_ONCE rows; a row without terms has zeros."""
    words = terms.flatten().field(0).dictionary_encode()
    buckets = np.concatenate([_buckets(words.dictionary.slice(at, TERMS_AT_ONCE), dimensions) for at in range(0, max(1, len(words.dictionary)), TERMS_AT_ONCE)])
    edge = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
    for at in range(0, len(terms), ROWS_AT_ONCE):
        part = terms.slice(at, ROWS_AT_ONCE)
        tf = part.flatten().field(1).to_numpy()
        place = buckets[words.indices.slice(edge[at], len(tf)).to_numpy()]
        row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
        out = np.bincount(row * dimensions + place[:, 0], place[:, 1] * tf, len(part) * dimensions).astype(float).reshape(-1, dimensions)
        n = np.sqrt((out * out).sum(1, keepdims=True))
        out = np.divide(out, n, out=out, where=n > 0)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimensions), pa.int32()), pa.array(out.ravel()))


def _buckets(tokens: pa.Array, dimensions: int) -> np.ndarray:
    """(bucket, sign) of each token, from the bytes of all digests at once: most of a batch's different tokens are rare,
    and no memo holds them."""
    digests = np.frombuffer(b"".join([hashlib.md5(t).digest() for t in tokens.cast(pa.binary()).to_numpy(zero_copy_only=False)]), np.uint8).reshape(-1, 16).astype(np.int64)
    at = BUCKET_DIGITS // 2
    bucket = sum(digests[:, k] << 8 * (at - 1 - k) for k in range(at)) % dimensions
    return np.stack([bucket, np.where(digests[:, at] < 128, 1, -1)], 1)


@lru_cache(MAX_KNOWN)
def _bucket(token: str, dimensions: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:BUCKET_DIGITS], 16) % dimensions, 1 if digest[BUCKET_DIGITS] < "8" else -1


def vectors_of(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """`hashed_embedding` of texts in Python, for steps that embed within a row."""
    out = np.zeros((len(texts), dimensions))
    for row, text in enumerate(texts):
        own = [0] * dimensions
        for token in T.tokens_of(text):
            b, sign = _bucket(token, dimensions)
            own[b] += sign
        out[row] = own
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def hashed_in_batches(text: Column, dimensions: int) -> Column:
    """`hashed_embedding` by batches of texts in Python, for many texts: the fold does as many steps a token as there
    are dimensions."""

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        parts = (vectors_of([x or "" for x in texts[at : at + 1024]], dimensions) for at in range(0, len(texts), 1024))
        return pd.Series([v for x in parts for v in x], dtype=object).where(texts.notna().to_numpy(), None)

    return embedded(text)


@dataclass(frozen=True)
class Provider:
    name: str
    dimensions: int
    max_batch: int
    max_tokens: int
    embed: Callable[[Column, int], Column]


_PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    """Adds an embedder; embed may wrap an iterator pandas_udf that loads its model once a worker."""
    _PROVIDERS[provider.name] = provider


def provider(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise KeyError(f"no embedder {name!r}; known: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]


def embed_with_cache(texts: DataFrame, cache: DataFrame, text_col: str = "text", name: str = "hashed", dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all texts with embeddings, rows to append to the cache): only texts that the cache lacks are embedded."""
    own = provider(name)
    wanted = texts.select(text_col).where(F.col(text_col).isNotNull()).distinct()
    fresh = wanted.join(cache, text_col, "left_anti").withColumn("embedding", own.embed(F.col(text_col), dimensions or own.dimensions))
    return texts.join(cache.unionByName(fresh), text_col, "left"), fresh


def embed_batches(df: DataFrame, batch_embed: Callable[[list[str]], np.ndarray] = vectors_of, name: str = "hashed", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding, error): the provider's embedder called with at most max_batch texts at a time.

    A text over max_tokens by the token estimate has an error and no embedding, as has every text of a batch whose
    call raises; null and blank texts have an error too. No row is lost.
    """
    own = provider(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, own.max_batch):
                part = batch.slice(at, own.max_batch)
                texts, tokens = part.column(1).to_pylist(), part.column(2).to_pylist()
                errors = ["empty text" if not x or not x.strip() else f"over {own.max_tokens} tokens" if n > own.max_tokens else None for x, n in zip(texts, tokens, strict=True)]
                good = [k for k, e in enumerate(errors) if e is None]
                vectors: list[list[float] | None] = [None] * len(texts)
                try:
                    for k, v in zip(good, batch_embed([texts[k] for k in good]) if good else (), strict=True):
                        vectors[k] = [float(x) for x in v]
                except Exception as e:  # noqa: BLE001 - a remote embedder may raise anything
                    vectors = [None] * len(texts)
                    errors = [x or str(e) or type(e).__name__ for x in errors]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], [id_col, "embedding", "error"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"), T.token_estimate(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return rows.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<double>, error string")


def embed_by_language(df: DataFrame, dimensions: int = 64, text_col: str = "text") -> DataFrame:
    """(text, language, normalised, embedding): one row for each distinct text, embedded as its language is written."""
    rows = df.select(F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("language", T.detect_language(F.col("text")))
    rows = rows.withColumn("normalised", T.normalize_for_language(F.col("text"), F.col("language")))
    return rows.withColumn("embedding", hashed_embedding(F.col("normalised"), dimensions))


def cached_levels(requests: DataFrame, memory: DataFrame, store: DataFrame, now: Column, text_col: str = "text", name: str = "hashed", dimensions: int | None = None) -> DataFrame:
    """(…, key, level, embedding) of every request: level is memory, store or fresh, in that order of preference.

    memory and store hold (key, embedding), store also expires_at, and each key once. Only what both lack, or the store
    holds no longer, is embedded, each distinct text once.
    """
    own = provider(name)
    asked = requests.withColumn("key", T.content_key(F.col(text_col)))
    keys = asked.where(F.col(text_col).isNotNull()).groupBy("key").agg(F.first(text_col).alias("_t"))
    levels = keys.join(memory.select("key", F.col("embedding").alias("_m")), "key", "left").join(store.where(F.col("expires_at") > now).select("key", F.col("embedding").alias("_s")), "key", "left")
    level = F.when(F.col("_m").isNotNull(), "memory").when(F.col("_s").isNotNull(), "store").otherwise("fresh")
    vector = F.coalesce("_m", "_s", F.when(F.col("_m").isNull() & F.col("_s").isNull(), own.embed(F.col("_t"), dimensions or own.dimensions)))
    return asked.join(levels.select("key", level.alias("level"), vector.alias("embedding")), "key", "left")


def cache_counters(served: DataFrame) -> DataFrame:
    """(requests, memory_hits, store_hits, misses, hit_rate) of `cached_levels`; no requests have a rate of 0."""
    n = lambda x: F.count_if(F.col("level") == x)
    out = served.agg(F.count("*").alias("requests"), n("memory").alias("memory_hits"), n("store").alias("store_hits"), n("fresh").alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide((F.col("memory_hits") + F.col("store_hits")).cast("double"), F.col("requests").cast("double")), F.lit(0.0)))


register(Provider("hashed", 64, 10, 8192, hashed_embedding))
