"""Text, document and table files as DataFrames, and synthetic corpora."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.sources import pdf

SUPPORTED = ("txt", "md", "pdf", "docx")
MAX_LINES = 10


def text_lines(spark: SparkSession, path: str, most: int | None = MAX_LINES) -> DataFrame:
    """(line_number from 1, text) of the non-blank lines of a file, stripped; over `most` lines raise ValueError.

    The file is read as one value, which keeps the order of its lines.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 0)).alias("p", "text"))
    out = whole.select((F.col("p") + 1).alias("line_number"), "text")
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"over {most} lines")
    return out


def decode(data: bytes) -> str:
    """UTF-8, or GBK where that fails."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gbk", "replace")


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file, each ended by a line end; a broken file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "".join("".join(t.text or "" for t in p.iter(f"{ns}t")) + "\n" for p in root.iter(f"{ns}p"))


def pdf_text(data: bytes) -> str:
    """Pages' text by a PDF library where one is installed, else by `pdf.text_of`."""
    try:
        import fitz
    except ImportError:
        return pdf.text_of(data)
    with fitz.open(stream=data, filetype="pdf") as doc:
        return "".join(page.get_text() for page in doc)


_READERS = {"txt": decode, "md": decode, "docx": docx_text, "pdf": pdf_text}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, file_type, size, content) of the supported files right in a folder; id is the path's MD5."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.withColumn("file_type", kind).where(F.col("file_type").isin(*SUPPORTED)).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "file_type", F.col("length").alias("size"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_READERS[k](c or b"") for k, c in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], ["path", "filename", "file_type", "size", "content"])

    out = files.mapInArrow(run, "path string, filename string, file_type string, size long, content string")
    return out.select(F.md5("path").alias("id"), "*")


def vector_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved index; Parquet, never pickles."""
    return spark.read.parquet(path)


def variants(spark: SparkSession, base: list[str], n: int) -> DataFrame:
    """(id, text): n texts, base[i % len(base)] with the number of its version."""
    words = F.array(*[F.lit(x) for x in base])
    return spark.range(n).select("id", F.concat(F.element_at(words, (F.col("id") % len(base)).cast("int") + 1), F.lit(" - 版本"), (F.col("id") + 1).cast("string")).alias("text"))


def template_corpus(spark: SparkSession, category: str, n: int, noise: bool = True, seed: int = 42) -> DataFrame:
    """(id, text, category, is_noise): n texts from templates, and a fifth as many noise texts (one at least).

    Choices come from a hash of the id and the seed, so a row is the same however it is computed.
    """
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(options)))).cast("int") + 1)
    heads = (f"{category}: an overview", f"Notes on {category}", f"{category} in practice", f"A short history of {category}")
    more = ("It covers methods and limits.", "Examples follow.", "Open questions remain.", "Results are compared.")
    main = spark.range(n).select("id", F.concat_ws(" ", pick(heads, 1), pick(more, 2), pick(more, 3)).alias("text"), F.lit(category).alias("category"), F.lit(False).alias("is_noise"))
    if not noise:
        return main
    other = ("The weather was mild.", "A recipe for soup.", "Train times for Sunday.", "A list of colours.")
    return main.unionByName(spark.range(n, n + max(1, n // 5)).select("id", pick(other, 4).alias("text"), F.lit("noise").alias("category"), F.lit(True).alias("is_noise")))


def write_lines(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, vector_col: str = "embedding") -> None:
    """Vectors as lines of numbers with four digits."""
    df.select(F.array_join(F.transform(F.col(vector_col), lambda x: F.format_string("%.4f", x.cast("double"))), " ").alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
