"""Fill-in-middle transformation by bit-parallel big integers.

A text's UTF-8 bytes are one big integer for each class of bytes: bytes.translate writes a digit for every byte, and bit
i of the integer says whether byte i is of the class. Shifted boolean operations then mark where units begin and where
a marker stands, bit_count tells how many units there are, and the place of the k-th unit is found by recursive
halving: count the bits of the lower half, go on in the half that holds the k-th. Every step is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")


def _table(members: bytes) -> bytes:
    """For bytes.translate: the digit 1 for the class's bytes, 0 for all others."""
    return bytes(49 if b in members else 48 for b in range(256))


_NEWLINE, _OPEN, _LETTER, _CLOSE = (_table(x) for x in (b"\n", b"<", b"PSM", b">"))
_SOLID = _table(bytes(set(range(256)) - set(b" \t\n\v\f\r")))
_LEAD = _table(bytes(set(range(256)) - set(range(0x80, 0xC0))))


class Bits:
    """The class masks of one text; bit i is byte i."""

    def __init__(self, data: bytes) -> None:
        self.size, self._reversed = len(data), data[::-1]  # the last digit is the lowest bit

    def mask(self, table: bytes) -> int:
        return int(self._reversed.translate(table), 2) if self.size else 0

    def starts(self, unit: str) -> int:
        """Where units begin: after each newline, at the first byte of each run of non-blanks, or at each code point.
        The first unit begins at byte 0, so blanks before the first word belong to it."""
        if not self.size:
            return 0
        if unit == "line":
            return (self.mask(_NEWLINE) << 1 | 1) & (1 << self.size) - 1
        if unit == "word":
            solid = self.mask(_SOLID)
            first = solid & ~(solid << 1)
            return first & ~(first & -first) | 1
        return self.mask(_LEAD) | 1

    def has_marker(self) -> bool:
        return bool(self.mask(_OPEN) & self.mask(_LETTER) >> 1 & self.mask(_CLOSE) >> 2)


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, from 0; there must be one."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - n, at + half, width - half
    return at


def transform_bytes(data: bytes, h: tuple[int, int, int, int], fim_percent: int, spm_percent: int, unit: str) -> tuple:
    """(units, form, code points of prefix and middle or None, output) of one text by four draws."""
    bits = Bits(data)
    starts = bits.starts(unit)
    n = starts.bit_count()
    if not data or h[2] % 100 >= fim_percent or bits.has_marker():
        return n, "plain", None, None, data
    a, b = sorted(select(starts, cut) if cut < n else len(data) for cut in (h[0] % (n + 1), h[1] % (n + 1)))
    lead = bits.mask(_LEAD)
    before, until = ((lead & (1 << x) - 1).bit_count() for x in (a, b))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h[3] % 100 < spm_percent:
        return n, "spm", before, until - before, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", before, until - before, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def draws(doc_id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the SHA-256 of seed:id as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transform(df: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = "line", id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row's whole text.

    n is the number of units: lines, words (with the blanks after them) or code points. The two cuts and the form follow
    from seed and id alone, so repeated rows come out alike. form is plain, and the output the text itself, for an empty
    or null text, for one that holds a marker, and for the share of ids beyond fim_percent; lengths are null there. Rows
    map one to one; extra columns are not read; an empty table gives an empty table.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, drawn = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows = [transform_bytes(x, tuple(h), fim_percent, spm_percent, unit) for x, h in zip(texts, drawn, strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = documents(df, id_col, text_col)
    rows = src.select(ID, F.col(TEXT).cast("binary").alias(TEXT), draws(F.col(ID), seed).alias("h"))
    out = rows.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made from. No marker can begin inside another one's place, and texts that
    hold one stay plain, so the first place of each marker is the one that was put there."""
    first = lambda mark: F.instr(output, mark)
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = F.substring(output, first(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(first(PREFIX), first(SUFFIX)), rest, between(first(SUFFIX), first(MIDDLE)))
    spm = F.concat(between(first(PREFIX), first(MIDDLE)), rest, between(first(SUFFIX), first(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
