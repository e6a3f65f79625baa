"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Texts with equal shingle sets are one class from the start, so exact copies cost nothing later. Classes that share a
band are candidates; the connected clusters of candidates are compared in blocks of bounded size, each pair of
blocks its own group, on full shingle sets. In clusters of many blocks, one block is first compared with all others;
what that already joins needs no further comparison, and only blocks that still hold separate components meet. No
task sees more than two blocks and no pair of texts is ever a row unless it is a confirmed link of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.llm import shingles
from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents, partitions_for, tasks_for, written
from vectrine.llm.graph import Spread, by_group, components, hot_of, spread_join

#: Classes of a block, columns of a piece of the incidence matrix, bins of a sketch at most.
BLOCK, COLUMNS, MAX_BINS = 128, 8192, 128
#: Shingles that are sorted together.
AT_ONCE = 400_000
#: Classes of one file.
CLASS_ROWS = 6_000


def banding(percent: int, miss: float = 1e-6, most: int = MAX_BINS) -> tuple[int, int]:
    """(rows, bands): the longest bands for which a pair at the threshold meets in none with less than this chance."""
    s = percent / 100
    fits = [(r, math.ceil(math.log(miss) / math.log(1 - s**r))) for r in range(1, 9) if s < 1] or [(1, 1)]
    return max([x for x in fits if x[0] * x[1] <= most] or fits[:1])


def sketches(df: DataFrame, width: int, rows: int, bands: int, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n_shingles, v, bands): v is a 128-bit digest of the shingle set; v and bands are null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, v, keys = [], [], []
                for text in part.column(1).to_pylist():
                    own = shingles.shingle_set(text, width)
                    n.append(len(own))
                    v.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    keys.append(shingles.band_keys(shingles.sketch(own, rows * bands), rows) if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(v, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "v", "bands"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_shingles long, v binary, bands array<long>")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. The range of hashes is gone through in parts, of which each set, being
    sorted, has a slice, so sets of very long texts are never sorted together at once."""
    both = np.zeros((len(sets), len(sets)))
    parts = max(1, -(-sum(map(len, sets)) // AT_ONCE))
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    places = [[0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in sets]
    for p in range(parts):
        own = [x[at[p] : at[p + 1]] for x, at in zip(sets, places, strict=True)]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in own])
        _, column, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        kept = df[column] > 1
        owner, column = owner[kept], column[kept]
        used, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, len(used), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            piece = np.zeros((len(sets), min(COLUMNS, len(used) - at)), np.float32)
            piece[owner[lo:hi], column[lo:hi] - at] = 1
            both += piece @ piece.T
    return both


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by counting shared shingles."""
    size = np.array([len(x) for x in sets])
    both = _shared(sets)
    union = size[:, None] + size[None, :] - both
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * union, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _compare(blocks: DataFrame, percent: int, spread: Spread) -> DataFrame:
    """(a, b) confirmed links of each group (label, i, j) of (label, i, j, v, own)."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sets = [], []
        for batch in batches:
            v += batch.column(3).to_pylist()
            sets += [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
        found = links(sets, percent) if len(v) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i, _ in found], pa.binary()), pa.array([v[j] for _, j in found], pa.binary())], ["a", "b"])

    return by_group(blocks, ["label", "i", "j"], [], spread, fn, "a binary, b binary")


def _sets(docs: DataFrame, members: DataFrame, width: int, files: int) -> DataFrame:
    """(v, label, n, own): the full shingle set of each member, from the text of its class's smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [shingles.shingle_set(x, width) for x in part.column(3).to_pylist()]
                here = pa.array([xxhash.xxh3_128_digest(x.tobytes()) == v for x, v in zip(own, part.column(0).to_pylist(), strict=True)])
                whole = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in own], pa.binary())], ["v", "label", "n", "own"])
                yield whole.filter(here)  # an id that occurs with several texts brings only the right one

    joined = docs.join(members, docs[ID] == members["id"]).select("v", "label", "n", TEXT)
    return written(joined.mapInArrow(run, "v binary, label binary, n long, own binary"), "sets", files)


def _confirmed(sets: DataFrame, percent: int, spread: Spread) -> DataFrame:
    """(a, b): links whose components are those of all links inside clusters."""
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = sets.withColumn("nb", blocks.cast("int")).withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    other = placed.withColumn("x", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).when((F.col("nb") == 2) | (F.col("b") > 0), F.array(F.when(F.col("b") == 0, F.lit(1)).otherwise(F.lit(0)))).otherwise(F.sequence(F.lit(1), F.col("nb") - 1))))
    first = other.select("label", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "v", "own")
    found = _compare(first, percent, spread)
    large = placed.where("nb > 2")
    if large.isEmpty():
        return found
    found = written(found, "links")
    # what the first block left separate
    joined = components(found.join(large.select(F.col("v").alias("a")), "a", "left_semi"))
    known = large.select("label", "v").join(joined.select("v", F.col("label").alias("c")), "v", "left").select("label", "v", F.coalesce("c", "v").alias("c"))
    counts = known.groupBy("label", "c").agg(F.count("*").alias("m"))
    known = spread_join(known, counts, ["label", "c"]).withColumn("c", F.when(F.col("m") >= BLOCK // 2, F.col("c")).otherwise(F.lit(b"")))
    sub = known.groupBy("label", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    known = written(spread_join(known, sub, ["label", "c"]).select("label", "v", "c", F.pmod(F.xxhash64("v", F.lit(1)), F.col("subs")).cast("int").alias("s")), "blocks", spread.tasks)
    block = known.select("label", "c", "s").distinct()
    block = block.withColumn("i", F.xxhash64("c", "s"))
    left, right = block.select("label", F.col("c").alias("c1"), F.col("i").alias("i")), block.select("label", F.col("c").alias("c2"), F.col("i").alias("j"))
    pairs = left.join(right, "label").where((F.col("i") <= F.col("j")) & ((F.col("c1") != F.col("c2")) | (F.col("c1") == F.lit(b"")))).select("label", "i", "j")
    ends = pairs.select("label", "i", "j", F.col("i").alias("at")).union(pairs.where("i != j").select("label", "i", "j", F.col("j").alias("at")))
    rows = known.select("label", "v", F.xxhash64("c", "s").alias("at")).join(ends, ["label", "at"]).select("label", "i", "j", "v")
    rest = rows.join(sets.select("v", "own").dropDuplicates(["v"]), "v").select("label", "i", "j", "v", "own")
    return found.union(_compare(rest, percent, spread))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable over links, kept tells whether it is the row's own. Candidates at the threshold are missed with a
    chance under 1e-6; every link is confirmed on full sets. Null, empty and wordless texts have no shingles and no
    links. Rows with a null id have no links either: component_id null, kept true. Repeated rows share a component
    and are kept or not alike. An empty table gives an empty table.
    """
    spread = Spread(partitions_for(df), tasks_for(df))
    rows, bands = banding(percent)
    docs = documents(df, id_col, text_col)
    drawn = written(sketches(docs, width, rows, bands), "sketches")
    usable = drawn.where("v is not null and doc_id is not null")
    about = drawn.count()  # from the files' footers
    classes = written(usable.groupBy("v").agg(F.min(ID).alias("id"), F.first("bands").alias("bands"), F.count("*").alias("n")), "classes", -(-about // CLASS_ROWS))
    n_classes = classes.count()
    members = classes.select("v", F.explode("bands").alias("key"))
    buckets = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("leader")).where("n > 1"), "buckets", -(-n_classes // CLASS_ROWS))
    candidates = spread_join(members, buckets.select("key", "leader"), ["key"], hot=hot_of(buckets, ["key"], n_classes * bands)).where("v != leader").select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    # a class meets one leader a band at most: hang it and its other leaders on the smallest, and few edges are left
    hung = candidates.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    stars = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    clusters = components(hung.select(F.inline(stars)).where("a <> b"), about)
    sizes = written(clusters.groupBy("label").agg(F.count("*").alias("n")), "sizes", 1 + n_classes // CLASS_ROWS)
    wanted = spread_join(clusters, sizes, ["label"], hot=hot_of(sizes, ["label"], clusters.count())).join(classes.select("v", "id"), "v").select("v", "label", "n", "id")
    joined = components(_confirmed(_sets(docs, wanted, width, spread.tasks), percent, spread), about)
    named = written(classes.select("v", "id").join(joined, "v", "left").withColumn("label", F.coalesce("label", "v")), "named", -(-about // CLASS_ROWS))
    smallest = written(named.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "smallest", 1 + n_classes // CLASS_ROWS)
    by_class = spread_join(named, smallest.drop("n"), ["label"], hot=hot_of(smallest, ["label"], n_classes)).select("v", "component_id")
    out = spread_join(drawn.drop("bands"), written(by_class, "by-class", 1 + n_classes // CLASS_ROWS), ["v"], "left", hot=hot_of(classes, ["v"], about))
    component = F.when(F.col(ID).isNotNull(), F.coalesce("component_id", ID))
    return out.select(ID, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(ID), F.lit(True)).alias("kept")).coalesce(spread.tasks)
