"""Media columns: texts stored as greyscale images in archives, read back by a Spark data source.

Writing: a text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of a PNG image 64
wide. Each task writes its images as stored members of one ZIP archive in the shared folder; the rows it returns name
the archives of the tasks that ended, so leftovers of failed attempts are never read.

Reading: the data source plans byte ranges of the archives from their sizes alone. A task opens its archive's
directory, takes the members whose header starts in its range, reads neighbouring ones at once, streams them as Arrow
batches, and fetches each member that did not come whole, by its CRC, again on its own from its offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents, work_path

WIDTH = 64
#: Bytes of an archive that one reading task takes, of a streamed batch, and attempts at a member.
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 8 << 20, 4 << 20, 4
#: Bytes read beyond a stretch of members for the last one's name and extra fields; it is fetched alone if they are longer.
HEADER_ROOM = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_png(samples: bytes, level: int = 1) -> bytes:
    """A lossless 8-bit greyscale image of the samples, row by row, without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image made by to_png; damage raises ValueError."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, data, size = 8, b"", None
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != image[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if not size or size[0] != WIDTH:
        raise ValueError("no header of the right width")
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], WIDTH + 1)[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation, entropy and mean step of the samples, as JSON with fixed digits."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    value = np.arange(256)
    mean = float(counts @ value) / len(x)
    var = float(counts @ value**2) / len(x) - mean**2
    step = float(np.abs(np.diff(x.astype(np.int16))).sum()) / max(1, len(x) - 1)
    return json.dumps({"mean": f"{mean:.6f}", "std": f"{max(0.0, var) ** 0.5:.6f}", "entropy": f"{abs(float(-(share * np.log2(share)).sum())):.6f}", "step": f"{step:.6f}"})


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Local, HDFS and object-store folders alike."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_archives(df: DataFrame, folder: str, id_col: str = ID, text_col: str = TEXT) -> list[str]:
    """Stores each row as one member; returns the archives' names, one for each task that had rows.

    A member is named by its row's place in the task and carries the id (null allowed) and unpadded length as its
    comment, so repeated ids are separate members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip"
        fs, root = filesystem(folder)
        archive, out, n = None, None, 0
        for batch in batches:
            for part in slices(batch):
                if archive is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    info = zipfile.ZipInfo(f"{n}.png")
                    info.comment = json.dumps([key, len(text.encode("utf-8", "replace"))]).encode()
                    archive.writestr(info, to_png(payload(text)))
                    n += 1
        if archive is not None:
            archive.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "members"])

    return sorted(r["archive"] for r in documents(df, id_col, text_col).mapInArrow(run, "archive string, members long").collect())


def neighbours(members: list[zipfile.ZipInfo]) -> Iterator[list[zipfile.ZipInfo]]:
    """The members by offset in stretches of about BATCH_BYTES, or of one member that is longer."""
    some: list[zipfile.ZipInfo] = []
    for x in sorted(members, key=lambda x: x.header_offset):
        if some and x.header_offset + x.file_size - some[0].header_offset > BATCH_BYTES:
            yield some
            some = []
        some.append(x)
    if some:
        yield some


class ArchiveRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


def member(read: bytes, at: int, size: int, crc: int | None, where: str) -> bytes:
    """A stored member's bytes out of bytes read before, its local header at `at`; OSError if cut short or damaged."""
    head = read[at : at + 30]
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {where}")
    names, extra = struct.unpack("<HH", head[26:30])
    data = read[at + 30 + names + extra : at + 30 + names + extra + size]
    if len(data) != size:
        raise OSError(f"member at {where} is cut short")
    if crc is not None and zlib.crc32(data) != crc:
        raise OSError(f"member at {where} is damaged")
    return data


def fetch(source: pa.NativeFile, offset: int, size: int, crc: int | None = None, attempts: int = ATTEMPTS) -> bytes:
    """One member's bytes by the offset of its local header; a read that fails or whose bytes do not have the member's
    CRC is tried again, alone, with longer waits."""
    for k in range(attempts):
        try:
            source.seek(offset)
            head = source.read(30)
            room = sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 else 0
            return member(head + source.read(room + size), 0, size, crc, str(offset))
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(0.1 * 2**k)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, archives: list[str], range_bytes: int) -> None:
        self.folder, self.archives, self.range_bytes = folder, archives, range_bytes

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges from the archives' sizes; no member is listed on the driver."""
        fs, root = filesystem(self.folder)
        infos = fs.get_file_info([f"{root}/{x}" for x in self.archives])
        return [ArchiveRange(i.base_name, at, at + self.range_bytes) for i in infos for at in range(0, i.size, self.range_bytes)]

    def read(self, partition: ArchiveRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where no range was planned
            return
        fs, root = filesystem(self.folder)
        with fs.open_input_file(f"{root}/{partition.archive}") as source:
            members = [x for x in zipfile.ZipFile(source).infolist() if partition.start <= x.header_offset < partition.end]
            for some in neighbours(members):
                yield self._batch(list(self._rows(source, some)))

    @staticmethod
    def _rows(source: pa.NativeFile, members: list[zipfile.ZipInfo]) -> Iterator[tuple[str | None, int, bytes]]:
        """Members that lie side by side by one read; one that the read did not bring whole is fetched by itself."""
        start, last = members[0].header_offset, members[-1]
        try:
            source.seek(start)
            read = source.read(last.header_offset - start + 30 + HEADER_ROOM + last.file_size)
        except OSError:
            read = b""
        for x in members:
            key, n = json.loads(x.comment)
            try:
                data = member(read, x.header_offset - start, x.file_size, x.CRC, str(x.header_offset))
            except OSError:
                data = fetch(source, x.header_offset, x.file_size, x.CRC)
            yield None if key is None else str(key), n, data

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        keys, n, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["key", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("archives", JSON list).load(folder): key, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, n_bytes long, media binary"

    def reader(self, schema: object) -> ArchiveReader:
        folder = self.options["path"]
        names = self.options.get("archives")
        if names is None:
            fs, root = filesystem(folder)
            names = json.dumps(sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.extension == "zip"))
        return ArchiveReader(folder, json.loads(names), int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: object, folder: str, archives: list[str] | None = None) -> DataFrame:
    """(key, n_bytes, media) of every member; an empty list of archives gives an empty table."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archive")
    if archives is not None:
        reader = reader.option("archives", json.dumps(archives))
    return reader.load(folder)


def describe(media: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Decodes stored images and digests what was read back; damage fails the task rather than losing the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for image in part.column(2).to_pylist():
                    x = from_png(image)
                    rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(x)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = media.select("key", "n_bytes", "media").mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(out["key"].cast(id_type).alias("doc_id"), *out.columns[1:])


def store_and_read(df: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Writes every row's text (null: empty) as media, reads it back and describes it; one row for each input row."""
    spark = df.sparkSession
    folder = work_path(spark, "media")
    archives = write_archives(df, folder, id_col, text_col)
    return describe(read_archives(spark, folder, archives), df.schema[id_col].dataType.simpleString())
