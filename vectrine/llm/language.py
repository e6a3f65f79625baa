"""Language identification by compression.

Each language owns a Zstandard raw-content dictionary cut from its training texts. A text, lower-cased and with all
but letters as spaces, is compressed with every dictionary; the language whose dictionary leaves the fewest bytes
wins. Long texts are compressed in blocks, each starting from the dictionary, so that all of a text counts and not
just the part before it has taught the compressor its own words. Where the best two sizes lie within a narrow margin
the text is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents, tasks_for

UNDETERMINED = "und"
#: A dictionary's bytes, the texts drawn for it and the characters of a cut, per language. What holds is the bytes: they
#: take about 128 full cuts of one-byte letters, so drawing more texts only helps where texts are short.
DICTIONARY_BYTES, SAMPLE_TEXTS, CUT = 64 * 1024, 600, 512
#: Bytes of a block and the level of compression.
BLOCK, LEVEL = 2_000, 12
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Rejected when the runner-up needs less than this share more bytes.
MARGIN = 0.002


def train(df: DataFrame, usable: Column, id_col: str = ID, text_col: str = TEXT, lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, cut: int = CUT, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, learned from the usable rows with a text and a language.

    At most about sample_texts texts a language are read for it, chosen by a hash of the id, and at most `cut`
    characters of each, from its middle. They are joined in order of the hash, and the last dictionary_bytes bytes are
    the dictionary: of long texts it holds dictionary_bytes / cut (by default 128), and earlier ones have no effect.
    All bounds are parameters and do not grow with the table. The number of languages must be small. Without usable
    rows there are no languages.
    """
    rows = df.select(df[id_col].alias(ID), df[text_col].cast("string").alias(TEXT), df[lang_col].cast("string").alias("lang")).where(usable).where("length(text) > 0 and lang is not null")
    draw = F.pmod(F.xxhash64("lang", ID), F.lit(1 << 40))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 40) * min(1.0, sample_texts / n)))])
    taken = rows.where(draw <= share[F.col("lang")]).withColumn("at", F.greatest(F.lit(1), F.floor((F.length(TEXT) - cut) / 2) + 1))
    taken = taken.select("lang", draw.alias("draw"), F.col(TEXT).substr(F.col("at").cast("int"), F.lit(cut)).alias("cut"))
    found: dict[str, bytes] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["draw"], r["cut"])):
        found[r["lang"]] = found.get(r["lang"], b"") + normal(r["cut"]) + b" "
    return {lang: x[-dictionary_bytes:] for lang, x in found.items()}


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN) -> None:
        self.margin = margin
        self.compressors = [(lang, self._compressor(dictionaries[lang]).compress) for lang in sorted(dictionaries)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, rejected. Equal sizes: the first language by name, and rejected."""
        if not self.compressors or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        raw = normal(text)
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(map(len, map(f, blocks))), lang) for lang, f in self.compressors)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
        return sizes[0][1], 1 - 0.5 * math.exp(-40 * margin), margin < self.margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text.

    Null texts and texts without a letter are "und" with score 0 and rejected; other texts always name a learned
    language, and rejected tells that its lead is narrow. Rows map one to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CompressionClassifier(dictionaries, margin)
        for batch in batches:
            for part in slices(batch):
                got = [own.predict(x) for x in part.column(1).to_pylist()]
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")



def accepted(df: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_col: str = TEXT) -> DataFrame:
    """The rows of df, all columns, whose text is not rejected; no join, so repeated rows and null ids are safe."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CompressionClassifier(dictionaries, margin)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not own.predict(x or "")[2] for x in part.column(at).to_pylist()], pa.bool_()))

    return df.coalesce(tasks_for(df)).mapInArrow(run, df.schema)
