"""Removal of text repeated from documents of smaller id, by a distributed merge sort of suffixes.

A string of SPAN bytes repeats iff the suffixes that start it share SPAN bytes. Sorting all suffixes would move many
times the input, so suffixes are sorted at content-defined anchors only: each window of SPAN bytes holds GRAM-byte
strings, the one with the least hash is the window's anchor, and equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a group; its suffix runs from the anchor to the end of the last window, and
the bytes before the anchor back to the first window follow it as a tie-break.

1. Anchor hashes meet by bucket; those that occur in one document only are dropped.
2. Each chunk of documents sorts the suffixes at its other anchors. Of equal ones only those of the smallest id go on,
   so very common text is one entry a chunk. The sorted runs are front-coded and exchanged by bucket.
3. Each bucket merges its runs with a loser tree that keeps, for every head, the prefix it shares with the last
   output, and never compares known prefixes again. Those common prefixes decide what repeats: neighbours that share
   enough bytes after the anchor, and enough before it, share a whole window.
4. The repeated ranges go back to the documents.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.common import ID, TEXT, partitions_for, release, tasks_for, written
from vectrine.llm.graph import Spread, by_group
from vectrine.llm.shingles import mix

SPAN, GRAM = 50, 24
#: Bytes of the longest suffix; texts and suffixes that are worked on at once.
WIDTH, TEXTS, BLOCK_ROWS = 2 * SPAN - GRAM + 1, 64, 8192
_CHOICES = SPAN - GRAM + 1
#: Bytes of documents in a chunk, positions of a segment, anchors that a task of the first step holds at once.
CHUNK_BYTES, SEGMENT, HELD = 12 << 20, 1 << 19, 1_000_000
_PLACE = np.uint64(SEGMENT * 2 - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S16, _S23, _S29 = np.uint64(16), np.uint64(23), np.uint64(29)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchored(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (text, first window, last window, anchor, key) of all groups of windows, a segment at a time.

    Windows and anchors are places in their text; key is a hash of the anchor's GRAM bytes.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - SPAN + 1, SEGMENT - SPAN + 1):
            part = text[at : at + SEGMENT]
            if size + len(part) > SEGMENT and held:
                yield _segment(held)
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield _segment(held)


def _segment(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = b"".join(x[2] for x in parts)
    n = len(data)
    word = np.ndarray((n - 7,), "<u8", data, 0, (1,)).copy()
    h = word[: n - GRAM + 1] * _A
    h ^= h >> _S29
    h += word[8 : n - GRAM + 9] * _B
    h ^= h >> _S23
    h *= _C
    h += word[16 : n - GRAM + 17]
    h *= _A
    h ^= h >> _S29
    h *= _B
    place = np.arange(len(h), dtype=np.uint64)
    least = (_sliding_min((h & ~_PLACE) | place, _CHOICES) & _PLACE).astype(np.int64)  # ties go left
    length = np.array([len(x[2]) for x in parts])
    owner = np.repeat(np.arange(len(parts)), length)
    inside = owner[: n - SPAN + 1] == owner[SPAN - 1 :]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.concatenate([new[1:], [len(least)]]) - 1
    new, last = new[inside[new]], last[inside[new]]
    anchor, part = least[new], owner[new]
    shift = np.array([x[1] for x in parts])[part] - (np.cumsum(length) - length)[part]
    return np.array([x[0] for x in parts])[part], new + shift, last + shift, anchor + shift, mix(h[anchor] + _C)


def _zip(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays) + 1}I", len(arrays), *(x.nbytes for x in arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (k,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{k}I", data, 4)
    at, out = 4 + 4 * k, []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _route(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of a key."""
    return (key >> np.uint64(40)) % np.uint64(buckets), (key & np.uint64(0xFFFFFFFF)).astype("<u4")


# --- step 1: which anchors occur in more than one document


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): keys of the anchors of a task's documents, with their chunk and whether two of them share it."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        bucket, key, chunk, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort([doc, chunk, key, bucket])
        bucket, key, chunk, doc = bucket[order], key[order], chunk[order], doc[order]
        same = (bucket[1:] == bucket[:-1]) & (key[1:] == key[:-1]) & (chunk[1:] == chunk[:-1])
        other = np.concatenate([[False], same & (doc[1:] != doc[:-1])])
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        several = np.logical_or.reduceat(other, at)
        bucket, key, chunk = bucket[at], key[at], chunk[at]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for lo, hi in zip(edge, [*edge[1:], len(bucket)], strict=True):
            k = key[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[lo])], pa.int32()), pa.array([_zip(np.diff(k, prepend=k.dtype.type(0)), chunk[lo:hi].astype("<u4"), several[lo:hi].astype("u1"))], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = done = 0
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, TEXTS):
                texts = [x.encode("utf-8", "replace") for x in batch.column(2).slice(at, TEXTS).to_pylist()]
                for text, _, _, _, key in anchored(texts):
                    bucket, low = _route(key, buckets)
                    held.append((bucket.astype("<u4"), low, chunk[at + text], text + done))
                    n += len(key)
                done += len(texts)
                if n >= HELD:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)
        pa.default_memory_pool().release_unused()  # a worker that waits holds little

    return docs.mapInArrow(run, "bucket int, blob binary")


def _shared(anchors: DataFrame, spread: Spread) -> DataFrame:
    """(chunk, bucket, blob): the keys of each chunk that occur in more than one document anywhere."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, chunks, several = [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                step, chunk, flag = _unzip(blob, "<u4", "<u4", "u1")
                keys.append(np.cumsum(step, dtype=np.uint32))
                chunks.append(chunk)
                several.append(flag)
        k, c, s = np.concatenate(keys), np.concatenate(chunks), np.concatenate(several)
        order = np.lexsort([c, k])
        k, c, s = k[order], c[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.concatenate([first, [len(k)]]))
        keep = np.repeat((n > 1) | (np.maximum.reduceat(s, first) > 0), n)
        k, c = k[keep], c[keep]
        order = np.lexsort([k, c])
        k, c = k[order], c[order]
        if not len(k):
            return
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        k, c = k[fresh], c[fresh]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        for lo, hi in zip(edge, [*edge[1:], len(c)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(c[lo])], pa.int32()), pa.array([key[0]], pa.int32()), pa.array([_zip(k[lo:hi])], pa.binary())], ["chunk", "bucket", "blob"])

    return by_group(anchors, ["bucket"], [], spread, fn, "chunk int, bucket int, blob binary")


# --- step 2: sorted, front-coded runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    m = min(len(a), len(b))
    differ = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (differ.bit_length() + 7) // 8


class Suffixes(NamedTuple):
    """Suffixes in one matrix, a row each, padded with zeros, and their numbers; a few arrays whatever their count."""

    data: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    buckets: np.ndarray

    def at(self, which: np.ndarray | slice) -> Suffixes:
        return Suffixes(*(x[which] for x in self))


def packed(suffixes: list[bytes], ids: list[int], rows: list[int], places: list[int], buckets: list[int]) -> Suffixes:
    data = np.frombuffer(b"".join(x.ljust(WIDTH, b"\0") for x in suffixes), "u1").reshape(-1, WIDTH)
    return Suffixes(data, np.array([len(x) for x in suffixes], "u1"), np.array(ids, "<i8"), np.array(rows, "<u4"), np.array(places, "<u4"), np.array(buckets, "<u4"))


def _cut_out(raw: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and sizes of the suffixes of groups of windows in texts that start at `start` of raw: the bytes from the
    anchor to the end of the last window, those from the first window to the anchor, and how many the latter are."""
    out, after, back = np.zeros((len(start), WIDTH), "u1"), last + SPAN - anchor, anchor - first
    column = np.arange(WIDTH)
    for lo in range(0, len(start), BLOCK_ROWS):
        x = slice(lo, lo + BLOCK_ROWS)
        tail = column >= after[x, None]
        place = (start + anchor)[x, None] + column - np.where(tail, (after + back)[x, None], 0)
        here = column < (after + back)[x, None]
        out[x][here] = raw[place[here]]
    size = after + back + 1
    out[np.arange(len(start)), size - 1] = back
    return out, size.astype("u1")


def ordered(x: Suffixes) -> Suffixes:
    """x in the order of its suffixes; equal ones keep their order."""
    by_size = np.argsort(x.size, kind="stable")  # of two suffixes that differ by the padding only, the shorter one is first
    data = np.ascontiguousarray(x.data[by_size]).view(f"S{WIDTH}").ravel()
    return x.at(by_size[np.argsort(data, kind="stable")])


def prefixes(x: Suffixes) -> np.ndarray:
    """The length of the prefix that each suffix shares with the one before it; 0 for the first."""
    out = np.zeros(len(x.size), "u1")
    for lo in range(1, len(out), BLOCK_ROWS):
        hi = min(lo + BLOCK_ROWS, len(out))
        differ = x.data[lo:hi] != x.data[lo - 1 : hi - 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        out[lo:hi] = np.minimum(first, np.minimum(x.size[lo:hi], x.size[lo - 1 : hi - 1]))
    return out


def front_code(x: Suffixes) -> bytes:
    """A sorted run as shared prefix lengths, the rest of each suffix, and the numbers."""
    shared, column, rest = prefixes(x), np.arange(WIDTH), []
    for lo in range(0, len(shared), BLOCK_ROWS):
        part = slice(lo, lo + BLOCK_ROWS)
        rest.append(x.data[part][(column >= shared[part, None]) & (column < x.size[part, None])])
    return _zip(shared, x.size - shared, np.concatenate(rest), x.ids, x.rows, x.places)


class Run:
    """A front-coded run; shared[i] is the prefix that suffix i has in common with suffix i - 1. Suffixes are decoded
    one by one as they are asked for."""

    def __init__(self, blob: bytes, source: int = 0) -> None:
        shared, sizes, rest, ids, rows, places = _unzip(blob, "u1", "u1", "u1", "<i8", "<u4", "<u4")
        self.source, self.shared, self.sizes, self.rest = source, shared.tobytes(), sizes.tobytes(), rest.tobytes()
        self.ids, self.rows, self.places = array("q", ids.tobytes()), array("I", rows.tobytes()), array("I", places.tobytes())

    def __iter__(self) -> Iterator[bytes]:
        at, before = 0, b""
        for n, size in zip(self.shared, self.sizes, strict=True):
            before = before[:n] + self.rest[at : at + size]
            at += size
            yield before


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int]]:
    """(prefix shared with the previous output, suffix, run, entry) of all runs in order.

    A loser tree in which every head carries the length of the prefix it shares with the last suffix put out. Of two
    heads the one that shares more is the smaller; only if they share equally much are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    left = [iter(r) for r in runs]
    head: list[bytes | None] = [next(x, None) for x in left] + [None] * (size - len(runs))
    known, at = [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner, loser; the loser keeps the prefix it shares with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        if (x, a) < (y, b) if n == len(x) or n == len(y) else x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    winners = list(range(size))
    nodes = [0] * size + winners
    for node in range(size - 1, 0, -1):
        nodes[node], losers[node] = play(nodes[2 * node], nodes[2 * node + 1])
    best = nodes[1] if size > 1 else 0
    while head[best] is not None:
        yield known[best], head[best], best, at[best]
        run, i = runs[best], at[best] + 1
        at[best] = i
        head[best] = next(left[best], None)
        if head[best] is not None:
            known[best] = run.shared[i]
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def _runs(docs: DataFrame, shared: DataFrame, buckets: int, spread: Spread) -> DataFrame:
    """(kind, target, source, blob): kind 0 are runs for a bucket, kind 1 ranges already known repeated, for a chunk."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        held: list[Suffixes] = []
        wanted, row = None, 0
        for batch in batches:
            kinds, ids, texts = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            n_blobs = kinds.count(0)
            for bucket, blob in zip(ids.slice(0, n_blobs).to_pylist(), batch.column(4).slice(0, n_blobs).to_pylist(), strict=True):
                known.append(_unzip(blob, "<u4")[0].astype(np.uint64) | np.uint64(bucket << 32))
            if n_blobs == len(kinds):
                continue
            if wanted is None:
                wanted = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
                known = []
            number, has_id = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            for lo in range(n_blobs, len(kinds), TEXTS):
                part = [x.encode("utf-8", "replace") for x in texts.slice(lo, TEXTS).to_pylist()]
                raw = np.frombuffer(b"".join(part), "u1")
                start = np.cumsum([0, *map(len, part)])
                for text, first, last, anchor, hashed in anchored(part) if len(wanted) else ():
                    bucket, low = _route(hashed, buckets)
                    full = low.astype(np.uint64) | (bucket << np.uint64(32))
                    hit = wanted[np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)] == full
                    hit &= has_id[lo + text]
                    if not hit.any():
                        continue
                    text, first, last, anchor, bucket = (x[hit] for x in (text, first, last, anchor, bucket))
                    data, size = _cut_out(raw, start[text], first, last, anchor)
                    held.append(Suffixes(data, size, number[lo + text], (row + text).astype("<u4"), first.astype("<u4"), bucket.astype("<u4")))
                row += len(part)
        if not held:
            return
        every = Suffixes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = []
        every = ordered(every)  # rows come by id, so equal suffixes are by id, row and place
        again = (prefixes(every) == every.size) & (np.diff(every.size, prepend=every.size[:1]) == 0)
        again[0] = False
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
        of_least = every.ids == every.ids[head]
        repeated = every.at(~of_least)
        every = every.at(of_least)
        every = every.at(np.argsort(every.buckets, kind="stable"))
        edge = np.flatnonzero(np.concatenate([[True], every.buckets[1:] != every.buckets[:-1]]))
        for lo, hi in zip(edge, [*edge[1:], len(every.size)], strict=True):
            yield _row(0, int(every.buckets[lo]), key[0], front_code(every.at(slice(lo, hi))))
        if len(repeated.size):
            yield _row(1, key[0], key[0], _ranges(repeated.rows, repeated.places, repeated.places + repeated.size - 1))

    return _with_documents(docs, shared.select("chunk", F.lit(0).alias("kind"), F.col("bucket").cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "blob"), spread, fn, "kind int, target int, source int, blob binary")


def _row(kind: int, target: int, source: int, blob: bytes) -> pa.RecordBatch:
    number = lambda x: pa.array([x], pa.int32())
    return pa.RecordBatch.from_arrays([number(kind), number(target), number(source), pa.array([blob], pa.binary())], ["kind", "target", "source", "blob"])


def _ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges of rows, overlapping ones of a row joined."""
    row, start, end = (x.astype(np.int64) for x in (row, start, end))
    order = np.lexsort([start, row])
    row, start, end = row[order], start[order], end[order]
    reach = np.maximum.accumulate(row << 32 | end)  # the furthest end so far of the row
    at = np.flatnonzero(np.concatenate([[True], (row[1:] << 32 | start[1:]) > reach[:-1]]))
    return _zip(row[at].astype("<u4"), start[at].astype("<u4"), (reach[np.append(at[1:], len(row)) - 1] & 0xFFFFFFFF).astype("<u4"))


def _with_documents(docs: DataFrame, blobs: DataFrame, spread: Spread, fn, schema: str | T.StructType) -> DataFrame:
    """Calls fn for each chunk with its blobs first, then its documents by id and text, so that rows have numbers."""
    extra = [c for c in docs.columns if c == "carried"]
    rows = docs.select("chunk", F.lit(1).alias("kind"), F.col(ID).alias("id"), TEXT, F.lit(None).cast("binary").alias("blob"), *extra)
    if extra:
        blobs = blobs.withColumn("carried", F.lit(None).cast(docs.schema["carried"].dataType))
    return by_group(blobs.union(rows), ["chunk"], ["kind", "id", "text"], spread, fn, schema)


# --- step 3: the merge


def _resolve(runs: DataFrame, spread: Spread) -> DataFrame:
    """(chunk, blob): ranges of each chunk that also occur under a smaller id, from the merged runs of each bucket."""

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Run(blob, source) for batch in batches for source, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        found: dict[int, list[tuple[int, int, int]]] = {}
        group: list[tuple[int, bytes, list[tuple[int, int, int, int]]]] = []  # distinct suffixes of one anchor: (id, chunk, row, place)
        for shared, suffix, r, i in merge(own):
            run = own[r]
            entry = (run.ids[i], run.source, run.rows[i], run.places[i])
            if group and shared == len(suffix) == len(group[-1][1]):
                group[-1][2].append(entry)
                continue
            if shared < GRAM and group:
                _decide(group, found)
                group = []
            group.append((shared, suffix, [entry]))
        if group:
            _decide(group, found)
        for chunk, ranges in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_ranges(*np.array(ranges).T)], pa.binary())], ["chunk", "blob"])

    return by_group(runs.select(F.col("target").alias("bucket"), "source", "blob"), ["bucket"], ["source"], spread, fn, "chunk int, blob binary")


def _decide(group: list[tuple[int, bytes, list[tuple[int, int, int, int]]]], found: dict[int, list[tuple[int, int, int]]]) -> None:
    """Adds the ranges of a group of merged suffixes with one anchor whose windows occur under a smaller id.

    The window that begins d bytes before the anchor is the last d bytes of what precedes it and the first SPAN - d of
    what follows. Suffixes with equal first SPAN - d bytes are neighbours in the merge whose common prefixes all reach
    that far; within such a stretch, sorted by what precedes the anchor read backwards, equal windows are neighbours
    that share d bytes. No window is made or hashed.
    """
    rows = []
    for shared, suffix, entries in group:
        back = suffix[-1]
        least = min(entries)[0]
        keep = []
        for e in entries:
            if e[0] > least:  # the same windows, all of them, under a smaller id
                found.setdefault(e[1], []).append((e[2], e[3], e[3] + len(suffix) - 1))
            else:
                keep.append(e)
        rows.append((shared, len(suffix) - 1 - back, suffix[-1 - back : -1][::-1], least, keep))

    def mark(row: tuple, low: int, high: int) -> None:
        """The windows that begin low to high bytes before the anchor repeat."""
        back = len(row[2])
        for _, chunk, at, place in row[4]:
            found.setdefault(chunk, []).append((at, place + back - high, place + back - low + SPAN))

    if len(rows) == 2:
        one, two = rows
        low, high = SPAN - min(two[0], one[1], two[1]), common_prefix(one[2], two[2])
        if low <= high and one[3] != two[3]:
            mark(max(one, two, key=lambda r: r[3]), max(low, 0), high)
    elif len(rows) > 2:
        hits: dict[int, list[int]] = {}
        for d in range(max(0, SPAN - max(r[0] for r in rows[1:])), max(len(r[2]) for r in rows) + 1):
            need, start = SPAN - d, 0
            for end in range(1, len(rows) + 1):
                if end < len(rows) and rows[end][0] >= need:
                    continue
                here = sorted((rows[i][2][:d], i) for i in range(start, end) if rows[i][1] >= need and len(rows[i][2]) >= d) if end - start > 1 else ()
                at = 0
                for k in range(1, len(here) + 1):
                    if k < len(here) and here[k][0] == here[at][0]:
                        continue
                    if k - at > 1:
                        smallest = min(rows[i][3] for _, i in here[at:k])
                        for _, i in here[at:k]:
                            if rows[i][3] > smallest:
                                hits.setdefault(i, []).append(d)
                    at = k
                start = end
        for i, ds in hits.items():
            low = ds[0]
            for k, d in enumerate(ds):
                if k + 1 == len(ds) or ds[k + 1] != d + 1:
                    mark(rows[i], low, d)
                    low = ds[k + 1] if k + 1 < len(ds) else 0


# --- step 4: documents without what repeats


def strip_repeats(df: DataFrame, id_col: str = ID, text_col: str = TEXT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): each row's bytes without those covered by a SPAN-byte string
    that also starts in a row of smaller id.

    With columns named in carry there are also kept_text, the kept bytes as text without the characters that a cut
    went through, and carried, a struct of those columns, whose names therefore may be any.

    Strings are judged on the input; overlaps count; matches never cross rows. Ids must be integers. Rows of one id
    (repeated rows included) remove nothing from each other. Rows with a null id take no part and stay whole. Null
    and empty texts have no bytes. An empty table gives an empty table.
    """
    spark = df.sparkSession
    spread = Spread(partitions_for(df), tasks_for(df))
    docs = df.select(df[id_col].cast("long").alias(ID), F.coalesce(df[text_col].cast("string"), F.lit("")).alias(TEXT), *([F.struct(*[df[c] for c in carry]).alias("carried")] if carry else []))
    total = docs.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    chunks = max(spread.partitions, -(-int(total) // CHUNK_BYTES))
    docs = docs.select(F.pmod(F.xxhash64(F.coalesce(ID, F.xxhash64(TEXT))), F.lit(chunks)).cast("int").alias("chunk"), ID, TEXT, *docs.columns[2:])
    bare = docs.select("chunk", ID, TEXT)
    shared = written(_shared(_anchors(bare.where(f"{ID} is not null"), chunks), spread), "anchors")
    release(spark)
    runs = written(_runs(bare, shared, chunks, spread), "runs")
    release(spark)
    known = written(_resolve(runs.where("kind = 0"), spread).union(runs.where("kind = 1").select(F.col("target").alias("chunk"), "blob")), "ranges", spread.tasks)
    release(spark)

    def fn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[np.ndarray] = []
        ranges, row = None, 0
        for batch in batches:
            n_blobs = batch.column(1).to_pylist().count(0)
            blobs += [np.stack(_unzip(x, "<u4", "<u4", "<u4"), 1) for x in batch.column(4).slice(0, n_blobs).to_pylist()]
            if n_blobs == batch.num_rows:
                continue
            if ranges is None:
                ranges = np.concatenate(blobs) if blobs else np.empty((0, 3), "<u4")
                ranges = ranges[np.lexsort([ranges[:, 1], ranges[:, 0]])]
            for lo in range(n_blobs, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                out = []
                for text in part.column(3).to_pylist():
                    raw = text.encode("utf-8", "replace")
                    a, b = np.searchsorted(ranges[:, 0], [row, row + 1])
                    out.append((len(raw), *_cut(raw, ranges[a:b, 1:].tolist())))
                    row += 1
                size, removed, spans, pieces = zip(*out, strict=True)
                long = lambda x: pa.array(x, pa.int64())
                kept = [long(size), long(removed), long(spans), pa.array([b"".join(x) for x in pieces], pa.binary())]
                if carry:
                    kept += [pa.array(["".join(y.decode("utf-8", "ignore") for y in x) for x in pieces], pa.string()), *part.columns[5:]]
                yield pa.RecordBatch.from_arrays([part.column(2), *kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "carried"][: 1 + len(kept)])

    blobs = known.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "blob")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])
    if carry:
        schema = schema.add("kept_text", T.StringType()).add("carried", docs.schema["carried"].dataType)
    return _with_documents(docs, blobs, spread, fn, schema)


def _cut(raw: bytes, ranges: list[list[int]]) -> tuple[int, int, list[bytes]]:
    """Bytes removed, maximal runs removed, and the pieces that are kept; ranges come by start."""
    out, at, spans, end = [], 0, 0, -1
    for a, b in ranges:
        if a > end:
            spans += 1
            out.append(raw[at:a])
        if b > end:
            at = end = b
    out.append(raw[at:])
    return len(raw) - sum(map(len, out)), spans, out


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """The same by a table of all windows; for tests."""
    least: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, x in raw:
        for at in range(len(x) - SPAN + 1):
            w = x[at : at + SPAN]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for at in range(len(x) - SPAN + 1):
            if least[x[at : at + SPAN]] < i:
                gone[at : at + SPAN] = b"\1" * SPAN
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
