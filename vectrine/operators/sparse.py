"""BM25 over a long term table, and fusions of sparse and dense rankings for many queries at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions import embed
from vectrine.functions import text as T
from vectrine.session import spread, written


#: Parts that the postings of a term are dealt over, so that those of a stop word are not one task's.
SALTS = 16
#: Terms of queries, counted over all of them, that are sent to every task at most; about 30 MB.
BROADCAST_ROWS = 500_000
#: Scores, and products that are summed to them, which a task makes at once.
CELLS, PRODUCTS = 1 << 17, 1 << 20
#: Rows of the best that a task holds before it puts them out.
HELD = 1 << 20
#: Scores this near may be the same when rounded to nine digits.
NEAR = 2e-9


@dataclass(frozen=True)
class SparseIndex:
    """forward: one row a document, (doc_id, dl, terms array<struct<term, tf>>), in the shared folder.

    Everything else is read from it: postings (doc_id, dl, term, tf), terms (term, df), corpus of one row (n_docs,
    avgdl), docs (doc_id), and vectors (id, embedding) where it was built with dimensions. Postings that only a few terms ask for are filtered before any row moves.
    """

    forward: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.forward.select("doc_id", "dl", F.inline("terms"))

    @property
    def terms(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def corpus(self) -> DataFrame:
        return self.forward.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    @property
    def docs(self) -> DataFrame:
        return self.forward.select("doc_id")

    @property
    def vectors(self) -> DataFrame:
        """As `embed.embed_terms` gives them; documents without terms are left out."""
        return self.forward.where("dl > 0").select(F.col("doc_id").alias("id"), "embedding")


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None, dimensions: int | None = None) -> SparseIndex:
    """Tokenises every text once, counts its terms within its row, without a shuffle, and writes the result.

    Null texts are documents without terms; they count in the corpus. Rows that repeat an id are documents of their own.
    With only (term), for queries that are known before, other terms are counted in dl and left out of the index; more
    than BROADCAST_ROWS of them leave nothing out. With dimensions each row has its embedding by all its terms, so that
    they need not be kept for it.
    """
    wanted = only.select("term").distinct().limit(BROADCAST_ROWS + 1).toArrow()["term"].to_pylist() if only is not None else None
    sent = df.sparkSession.sparkContext.broadcast(frozenset(wanted)) if wanted is not None and len(wanted) <= BROADCAST_ROWS else None

    def counted(counts: list[dict[str, int]]) -> pa.ListArray:
        rows = pa.StructArray.from_arrays([pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counts)]), pa.int32()), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = [T.tokens_of(x) if x else [] for x in part.column(1).to_pylist()]
                counts: list[dict[str, int]] = [Counter(x) for x in tokens]
                vectors = [pa.concat_arrays(embed.sums_of_terms(counted(counts), dimensions))] if dimensions else []
                if sent is not None:
                    counts = [{t: c[t] for t in c if t in sent.value} for c in counts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, tokens)), pa.int32()), counted(counts), *vectors], names)

    names = ["doc_id", "dl", "terms", *(["embedding"] if dimensions else [])]
    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return SparseIndex(written(rows.mapInArrow(run, f"doc_id {kind}, dl int, terms array<struct<term:string,tf:bigint>>" + (", embedding array<double>" if dimensions else "")), "index"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, times): a repeated token counts as often as it stands."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(T.word_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


@dataclass(frozen=True)
class _Asked:
    """Queries as every task gets them: the ids, the terms, and of each term the places of its queries and their weights."""

    queries: pa.Array
    terms: pa.Array
    first: np.ndarray
    size: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    avgdl: float


def bm25(index: SparseIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term with the query; all others score 0 (`filled`).

    Up to BROADCAST_ROWS terms of queries go to the documents, whose terms are summed where they lie, so that no posting
    and no score is shuffled; more of them meet the postings by an equi-join on term and salt. Where only the best are
    wanted, `bm25_best` lets only those leave a task.
    """
    found = _asked(index, queries, id_col, text_col)
    if found is None:
        return _joined(index, queries, k1, b, id_col, text_col)
    asked, again = found
    scores = _scored(index.forward, asked, queries.schema[id_col].dataType.simpleString(), None, k1, b)
    return scores if again is None else _summed(scores)


def bm25_best(index: SparseIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of `bm25`, as `ranked` gives them.

    A task keeps each query's best over all documents it reads and puts out little more than k rows a query, not a row
    for each query and document. Rows of an id that stands twice are summed before they are ranked.
    """
    found = _asked(index, queries, id_col, text_col)
    if found is None:
        return ranked(_joined(index, queries, k1, b, id_col, text_col), k)
    asked, again = found
    kind = queries.schema[id_col].dataType.simpleString()
    if again is None:
        return ranked(_scored(index.forward, asked, kind, k, k1, b), k)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once, several = (index.forward.join(again, same, how) for how in ("left_anti", "left_semi"))
    return ranked(_scored(once, asked, kind, k, k1, b).unionByName(_summed(_scored(several, asked, kind, None, k1, b))), k)


def _summed(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def _asked(index: SparseIndex, queries: DataFrame, id_col: str, text_col: str) -> tuple[_Asked, DataFrame | None] | None:
    """The queries to send to every task, and the ids (again) that several rows of the index have, if there are any; none
    where the queries have more than BROADCAST_ROWS terms."""
    rows = query_terms(queries, id_col, text_col).limit(BROADCAST_ROWS + 1).toArrow().combine_chunks()
    if rows.num_rows > BROADCAST_ROWS:
        return None
    coded = [pa.concat_arrays(rows[c].chunks or [pa.array([], rows.schema.field(c).type)]).dictionary_encode("encode") for c in ("query_id", "term")]
    (ids, place), (terms, term) = ((x.dictionary, x.indices.to_numpy()) for x in coded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms), np.int64)
        for batch in batches:
            n += np.bincount(pc.index_in(batch.column(0).flatten().field(0), terms).drop_null().to_numpy(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["at", "n"])

    by_id = index.forward.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    row = by_id.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"), F.count_if(F.col("n") > 1).alias("again")).first()
    again = by_id.where("n > 1").select(F.col("doc_id").alias("again")) if row["again"] else None
    n_docs, df = row["n"] or 0, np.zeros(len(terms), np.int64)
    if len(terms):
        counts = index.forward.select("terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        df[counts["at"].to_numpy()] = counts["n"].to_numpy()
    order, size = np.argsort(term, kind="stable"), np.bincount(term, minlength=len(terms))
    weight = rows["times"].to_numpy()[order] * np.log((n_docs - df + 0.5) / (df + 0.5) + 1)[term[order]]
    return _Asked(ids, terms, np.cumsum(size) - size, size, place[order], weight, (row["dl"] or 0) / max(1, n_docs) or 1.0), again


def _scored(forward: DataFrame, asked: _Asked, kind: str, k: int | None, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of each row of the index and each query that shares a term with it; with k only what may
    be among the k best of a query. A row's products are summed in the order of the terms, so equal texts score the same."""
    sent = forward.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        width = len(q.queries)
        if not width:
            return
        bar = np.full(width, -np.inf)
        held: tuple[np.ndarray, pa.Array, np.ndarray] | None = None
        put = lambda c, ids, s: pa.RecordBatch.from_arrays([q.queries.take(pa.array(c)), ids, pa.array(s)], ["query_id", "doc_id", "score"])
        for batch in batches:
            terms = batch.column(2)
            at = pc.index_in(terms.flatten().field(0), q.terms)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            at = at.drop_null().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())[known]
            order = np.argsort(row * len(q.terms) + at)
            row, at, tf = row[order], at[order], terms.flatten().field(1).to_numpy()[known[order]]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column(1).to_numpy()[row] / q.avgdl))
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            made = np.concatenate([[0], np.cumsum(q.size[at])])[edge]
            found, start = [], 0
            while start < batch.num_rows:
                end = max(start + 1, min(start + max(1, CELLS // width), int(np.searchsorted(made, made[start] + PRODUCTS, "right")) - 1, batch.num_rows))
                own = slice(edge[start], edge[end])
                n = q.size[at[own]]
                if not len(n):
                    start = end
                    continue
                entry = np.repeat(q.first[at[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat((row[own] - start) * width, n) + q.place[entry]
                s = np.bincount(cell, q.weight[entry] * np.repeat(part[own], n), (end - start) * width)
                seen = np.zeros(len(s), bool)
                seen[cell] = True
                s[~seen] = -np.inf
                s = s.reshape(-1, width)
                if k is not None and len(s) >= k and len(low := np.flatnonzero(np.isneginf(bar))):
                    bar[low] = np.partition(s[:, low], len(s) - k, axis=0)[len(s) - k]
                a, c = np.nonzero((s >= bar - NEAR) & (s > -np.inf))
                if k is None:
                    yield put(c, batch.column(0).take(pa.array(a + start)), s[a, c])
                else:
                    found.append((c, a + start, s[a, c]))
                start = end
            if found:
                c, a, s = map(np.concatenate, zip(*found, strict=True))
                ids = batch.column(0).take(pa.array(a))
                if held is not None:
                    c, ids, s = np.concatenate([held[0], c]), pa.concat_arrays([held[1], ids]), np.concatenate([held[2], s])
                held = _cut(c, ids, s, k, bar)
                if len(held[0]) > HELD:
                    yield put(*held)
                    held = None
        if held is not None:
            yield put(*held)

    return forward.select("doc_id", "dl", "terms").mapInArrow(run, f"query_id {kind}, doc_id {forward.schema['doc_id'].dataType.simpleString()}, score double")


def _cut(c: np.ndarray, ids: pa.Array, s: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The rows that may be among the k best of each query c: those that rounding may bring to the k-th score, of each
    score the k smallest ids. bar is raised to the k-th scores."""
    code = np.empty(len(s), np.int64)
    code[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(s))
    order = np.lexsort((code, -s, c))
    c, s = c[order], s[order]
    first, end = np.searchsorted(c, c), np.searchsorted(c, c, "right")
    kth = s[np.minimum(first + k, end) - 1]
    new = np.ones(len(s), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    place = np.arange(len(s)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = (s >= kth - NEAR) & (place < k)
    full = end - first >= k
    bar[c[full]] = np.maximum(bar[c[full]], kth[full])
    return c[keep], ids.take(pa.array(order[keep])), s[keep]


def _joined(index: SparseIndex, queries: DataFrame, k1: float, b: float, id_col: str, text_col: str) -> DataFrame:
    """`bm25` by an equi-join of postings and the terms of many queries; only postings of those terms become rows."""
    row = index.corpus.first()
    n, avgdl = float(row["n_docs"]), float(row["avgdl"] or 0) or 1.0
    asked = query_terms(queries, id_col, text_col)
    postings = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.col("times") * idf(F.lit(n), F.col("df"))
    terms = written(asked.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").select("term", "query_id", weight.alias("weight")), "terms")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    salted = postings.select("term", "doc_id", part.alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"])
    return joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def filled(scores: DataFrame, index: SparseIndex, queries: DataFrame, k: int, id_col: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best documents, those that share no term with it at score 0.

    Fewer than k documents score for a query that needs any, so the 2 k smallest ids hold all it may get: a constant.
    """
    first = [r["doc_id"] for r in index.docs.where("doc_id is not null").distinct().orderBy("doc_id").limit(2 * k).collect()]
    best = ranked(scores, k).drop("rank")
    if not first:
        return ranked(best, k)
    zero = queries.select(F.col(id_col).alias("query_id")).distinct().select("query_id", F.explode(F.array(*[F.lit(x).cast(scores.schema["doc_id"].dataType) for x in first])).alias("doc_id"), F.lit(0.0).alias("score"))
    return ranked(best.unionByName(zero.join(best, ["query_id", "doc_id"], "left_anti")), k)


def ranked(scores: DataFrame, k: int | None = None, by: str = "score", digits: int = 9) -> DataFrame:
    """scores with rank from 1 for each query_id, ids ascending among equals; the best k only where k is given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(by, digits)), "doc_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def fuse_ranks(lists: list[DataFrame], k: int, constant: int = 60, fetch: int = 2) -> DataFrame:
    """Reciprocal rank fusion: the best fetch * k of each list, 1 / (constant + rank) summed by document."""
    parts = [ranked(x, fetch * k).select("query_id", "doc_id", (1.0 / (constant + F.col("rank"))).alias("part")) for x in lists]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    return ranked(union.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def fuse_weighted(sparse: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5, epsilon: float = 1e-10, n_docs: int | None = None) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse after min-max scaling over each query's rows.

    dense needs (query_id, doc_id, score, lo, hi): each query's k best documents and all that have a sparse score,
    with the least and the highest dense score of all documents. A document without a sparse score cannot be among the
    k best unless it is among the k best dense ones, so no others are needed. n_docs tells whether some document has
    no sparse score, whose least is then 0.
    """
    both = dense.select("query_id", "doc_id", F.col("score").alias("d"), "lo", "hi").join(sparse.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"], "left").fillna(0.0, ["s"])
    of = sparse.groupBy("query_id").agg(F.min("score").alias("least"), F.max("score").alias("hi_s"), F.count("*").alias("n"))
    of = of.select("query_id", "hi_s", F.when(F.col("n") < F.lit(n_docs if n_docs is not None else 1 << 62), 0.0).otherwise(F.col("least")).alias("lo_s"))
    joined = both.join(of, "query_id", "left").fillna(0.0, ["hi_s", "lo_s"])
    d, s = (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(epsilon)), (F.col("s") - F.col("lo_s")) / (F.col("hi_s") - F.col("lo_s") + F.lit(epsilon))
    return ranked(joined.select("query_id", "doc_id", (alpha * d + (1 - alpha) * s).alias("score")), k)


def fuse_first_seen(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The best k of both lists together; a document of both keeps the first list's score, on its own scale."""
    union = ranked(first, k).withColumn("list", F.lit(0)).unionByName(ranked(second, k).withColumn("list", F.lit(1)))
    once = union.groupBy("query_id", "doc_id").agg(F.min_by("score", "list").alias("score"))
    return ranked(once, k)


def fuse_signals(signals: list[tuple[Column, float]]) -> Column:
    """Weighted sum of scores that stand side by side, such as 0.4 dense, 0.3 sparse and 0.3 multi-vector."""
    out = F.lit(0.0)
    for score, weight in signals:
        out = out + F.coalesce(score, F.lit(0.0)) * weight
    return out


def alpha_for(query: Column) -> Column:
    """A guide: keyword-like queries lean on terms (0.3), question-like ones on vectors (0.7), others on both (0.5)."""
    return F.when(query.rlike("[0-9]|[A-Z]{2,}"), 0.3).when(query.rlike("[?？]|^(?i)(how|why|what|when|who|where)"), 0.7).otherwise(0.5)
