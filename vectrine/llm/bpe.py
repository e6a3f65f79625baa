"""Byte-level BPE encoding and decoding in linear time.

Token byte strings are mapped to Latin-1 so that an Aho-Corasick automaton over str finds every token occurrence.
A text piece is then encoded by backtracking: take the longest token at the current place, accept it if it may
follow the previous token, else try its next shorter prefix token, else give the previous token up. Two adjacent
tokens are compatible if undoing their merges never exposes a pair that the merge order would have joined first;
the answers are memoised. Each place is given up at most once, so the work is linear in the piece's length, and
the result equals the rank-ordered merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vectrine.llm.common import ID, TEXT, documents

#: Bounds of the per-worker memo tables; a full table is emptied, results do not depend on it.
MAX_PIECES, MAX_PAIRS, MAX_CACHED_CHARS = 500_000, 1_000_000, 48


class BytePairCodec:
    """Encodes and decodes with the ranks of one vocabulary file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocab = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.size = {i: len(b) for b, i in ranks.items()}
        self.shorter = {i: self._prefix(b) for b, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        for i in sorted(self.vocab):
            self._split(i)
        self.pairs.clear()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _split(self, i: int) -> None:
        """Finds the two earlier tokens whose merge makes token i; single bytes are their own halves."""
        token = self.vocab[i]
        left = self.shorter[i]
        while left is not None:
            right = self.ranks.get(token[self.size[left] :])
            if right is not None and left < i and right < i and self.compatible(left, right):
                self.merged[left, right] = i
                self.halves[i] = (left, right)
                return
            left = self.shorter[left]
        self.halves[i] = (i, i)

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        below = len(self.vocab) + 1  # only merges ranked under this were still possible across the boundary
        while True:
            if self.merged.get((left, right), below) < below:
                return False
            for side in (0, 1) if left > right else (1, 0):
                if side == 0:
                    part = self.halves[left][1]
                    if part != left:
                        below, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        below, right = right + 1, part
                        break
            else:
                return True

    def _longest(self, piece: str) -> list[int]:
        """The longest token starting at each place."""
        best, most = [0] * len(piece), [0] * len(piece)
        for end, (i, n) in self.automaton.iter(piece):
            at = end - n + 1
            if n > most[at]:
                most[at], best[at] = n, i
        return best

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        longest, open_ = self._longest(piece.decode("latin-1")), bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None:
                end = at + self.size[token]
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(piece) else None
                    break
                token = self.shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_[at] = 0
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.find(text):
            got = pieces.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= MAX_CACHED_CHARS:
                    if len(pieces) >= MAX_PIECES:
                        pieces.clear()
                    pieces[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec.from_file(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>): the ids of each whole text; null and empty texts give an empty array.

    Rows map one to one, so ties, repeated rows and null ids pass through; an empty table gives an empty table.
    vocabulary is a rank file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [own.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what it encoded, and digests both in one pass.

    ids_sha256 is over the decimal ids joined by one space; null and empty texts have no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        decimal = {i: str(i) for i in own.vocab}.__getitem__
        for batch in batches:
            for part in slices(batch):
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = own.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices of a batch, so that few texts are Python objects at once; then what Arrow keeps of earlier batches
    for later goes back to the system, as a worker holds it otherwise while it waits for its next task."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
