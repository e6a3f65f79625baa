"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths matters for the plan, and it has at most `capacity` entries whatever the input.
The driver therefore plans over counts: for the longest open length it looks up, in indexes of single lengths, pair
sums and triple sums, a combination that fills the gap exactly, and consumes it as often as the availability counts
allow; what has no exact complement is packed best-fit. The plan is a list of ranges (length, ranks, sequence,
offset); each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents, tasks_for, written

CAPACITY = 2048
assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are written as little-endian 32-bit"
#: Bound of a worker's memo of encoded words; a full one is emptied.
MAX_WORDS, MAX_CACHED_CHARS = 900_000, 40
_WORD_END = "</w>"
#: Characters before this one have the lower-case forms that the tokenizer gives them.
_SIMPLE = "\u0130"
_WIDE = re.compile("[\u0130-\U0010ffff]").search


class WordEncoder:
    """Ids of a tokenizer that lower-cases, drops white space and never merges across it.

    Texts are cut at plain blanks, so each distinct word needs the tokenizer once. A vocabulary whose declaration lets
    words depend on their neighbours is encoded whole instead, and so is a text with an added token.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.by_word = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.added = tuple(x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(_WORD_END)]] = True

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [self._whole(x) for x in texts]
        low = [x.lower() if x.isascii() or not _WIDE(x) else x for x in texts]
        # added tokens are matched before the tokenizer lower-cases, so a text that holds one in any case stays as it is
        odd = {k for k, x in enumerate(low) if any(a in x for a in self.added) or (x is texts[k] and any(a in x.lower() for a in self.added))}
        split = [[] if k in odd else x.replace("\n", " ").split(" ") for k, x in enumerate(low)]
        if len(self.words) > MAX_WORDS:
            self.words = {}
        words = self.words
        words[""] = b""
        out = [list(map(words.get, found)) for found in split]
        holes = [[i for i, x in enumerate(ids) if x is None] if None in ids else [] for ids in out]
        missing = {found[i] for found, at in zip(split, holes, strict=True) for i in at}
        if missing:
            self._learn(missing)
            for found, at, ids in zip(split, holes, out, strict=True):
                for i in at:
                    ids[i] = words[found[i]]
            for x in missing:
                if len(x) > MAX_CACHED_CHARS:
                    del words[x]
        return [self._whole(texts[k]) if k in odd else b"".join(ids) for k, ids in enumerate(out)]

    def _learn(self, missing: set[str]) -> None:
        """Adds words. One of letters with closing marks is cut before the marks, where the tokenizer cuts it too, and
        its letters are lower-cased as the tokenizer does; words of letters alone are then encoded joined by blanks
        and told apart by their word ends, others one by one."""
        words = self.words
        cut: list[tuple[str, str, str]] = []
        plain: set[str] = set()
        other: set[str] = set()
        for x in missing:
            core = x.rstrip(".,;:!?*#$%&")
            if core.isalpha() and (core.isascii() or max(core) < _SIMPLE):
                if len(core) < len(x) or not core.islower():
                    marks, core = x[len(core) :], core.lower()
                    if marks and marks not in words:
                        other.add(marks)
                    cut.append((x, core, marks))
                    if core in words:
                        continue
                plain.add(core)
            else:
                other.add(x)
        order = list(plain)
        lines = [order[at : at + 512] for at in range(0, len(order), 512)]
        for line, got in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = array("I", got.ids)
            stops = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1) * 4
            if len(stops) == len(line):
                data, at = ids.tobytes(), 0
                for word, stop in zip(line, stops.tolist(), strict=True):
                    words[word] = data[at:stop]
                    at = stop
            else:
                other.update(line)
        rest = list(other)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                words[word] = array("I", got.ids).tobytes()
        for x, core, marks in cut:
            words[x] = words[core] + words[marks] if marks else words[core]


def splits_at_blanks(declared: dict) -> bool:
    """Whether a tokenizer, by its own declaration, encodes words between blanks one by one: it normalises by NFC,
    blanks and lower case only, keeps what a pattern without white space finds, and has no added token with blanks."""
    normaliser, splitter = declared.get("normalizer") or {}, declared.get("pre_tokenizer") or {}
    steps = normaliser.get("normalizers") or [normaliser]
    cuts = splitter.get("pretokenizers") or [splitter]
    calm = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ") for x in steps)
    lowers = any(x.get("type") == "Lowercase" for x in steps)
    first = cuts[0]
    finds = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and isinstance(first.get("pattern", {}).get("Regex"), str)
    finds = finds and not regex.search(first["pattern"]["Regex"], " \t\r\n\u00a0\u2003")
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in cuts[1:])
    whole = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not re.search(r"\s", x["content"]) for x in declared.get("added_tokens", []))
    model = declared.get("model", {})
    return calm and lowers and finds and rest and whole and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _WORD_END and not declared.get("truncation")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces of every text, each ended by id 0.

    part and nth number the pieces of one length within a task of the scan. The table is written once, so the
    numbers hold whatever is recomputed later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part_id = encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch):
                take, piece, start, length, crc, nth = [], [], [], [], [], []
                for row, ids in enumerate(own.encode_all(part.column(1).to_pylist())):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[at : at + 4 * capacity]
                        n = len(one) // 4
                        take.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(one))
                        nth.append(seen.get(n, 0))
                        seen[n] = nth[-1] + 1
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), long(start), long(length), long(crc), pa.array([part_id] * len(take), pa.int32()), long(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    src = documents(df, id_col, text_col)
    return written(src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")


class _Counts:
    """Availability counts by length, with look-ups of exact complements."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest member; two of one length need a count of two."""
        there = self.n[: gap + 1] > 0
        both = there & there[::-1]
        both[0] = both[gap] = False
        if gap % 2 == 0 and both[gap // 2]:
            both[gap // 2] = self.n[gap // 2] > 1
        at = np.flatnonzero(both)
        return (int(at[-1]), gap - int(at[-1])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.n[:gap] > 0)[::-1]:
            a = int(a)
            self.n[a] -= 1
            rest = self.pair(gap - a) if gap - a > 1 else None
            self.n[a] += 1
            if rest:
                return (a, *rest)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of offset) and how many sequences follow each.

    Each step uses a length up or leaves fewer of it than the pattern needs, so the number of patterns is bounded by
    the number of lengths times a small factor, not by the number of pieces.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    known, out = _Counts(counts), []

    def times(pattern: tuple[int, ...]) -> int:
        need = dict.fromkeys(pattern, 0)
        for x in pattern:
            need[x] += 1
        return min(int(counts[x]) // k for x, k in need.items())

    def use(pattern: tuple[int, ...]) -> None:
        k = times(pattern)
        out.append((pattern, k))
        for x in pattern:
            counts[x] -= k

    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            gap = capacity - length
            counts[length] -= 1
            rest = () if gap == 0 else known.single(gap) or known.pair(gap) or known.triple(gap)
            if rest is None:  # best fit: the longest that fits, until an exact complement of what is left turns up
                rest = ()
                taken: list[int] = []
                while gap > 0:
                    fit = known.single(gap) or (known.pair(gap) if taken else None) or (known.triple(gap) if taken else None)
                    if fit is None:
                        below = np.flatnonzero(counts[: gap + 1] > 0)
                        if not len(below):
                            break
                        fit = (int(below[-1]),)
                    for x in fit:
                        counts[x] -= 1
                        gap -= x
                        taken.append(x)
                for x in taken:
                    counts[x] += 1
                rest = tuple(taken)
            counts[length] += 1
            use((length, *rest))
    return out


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each text.

    Only texts of more than capacity tokens are cut. Null and empty texts are one piece of the end id alone. Equal
    lengths are ordered by task and place, so repeated rows and null ids are packed like any others. An empty table
    gives an empty table.
    """
    pieces = cut(df, tokenizer, capacity, id_col, text_col)
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_part = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_part = written(by_part, "lengths", tasks_for(df))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    starts: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, sequences, offset
    used: dict[int, int] = {}
    sequence = 0
    for pattern, k in plan(histogram, capacity):
        at = 0
        for length in pattern:
            starts.append((length, used.get(length, 0), sequence, k, at))
            used[length] = used.get(length, 0) + k
            at += length
        sequence += k
    table = np.array(sorted(starts), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {int(x): int(np.searchsorted(table[:, 0], x)) for x in np.unique(table[:, 0])}
        last = {x: int(np.searchsorted(table[:, 0], x, "right")) for x in first}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.empty(len(length), np.int64)
            for x in np.unique(length):
                here = length == x
                lo, hi = first[int(x)], last[int(x)]
                row[here] = lo + np.searchsorted(table[lo:hi, 1], rank[here], "right") - 1
            hit = table[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    # lengths times tasks grows with the table, so this side is shuffled, never broadcast
    ranked = pieces.join(by_part.select("length", "part", "before").hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").coalesce(tasks_for(df))
