"""WARC archives: pages written as gzip-compressed records, read back by byte ranges, revisits resolved by an index.

Writing: each task writes the records of its rows to archives of its own in the shared folder, one gzip member a record,
and returns a capture for each: the sort key, and where the record lies. Of equal payloads only one is stored; the
others are revisit records that name it. Captures of tasks that ended name the archives, so leftovers of failed
attempts are never read.

Reading: stretches of whole records are dealt over tasks, which stream them. A revisit has no payload of its own: the
capture it names is found by the two-level index (`capture_index`) and its record is fetched by one range read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm import capture_index
from vectrine.llm.bpe import slices
from vectrine.llm.common import partitions, spread, tasks_for, work_path, written
from vectrine.llm.graph import hot_of, spread_join
from vectrine.llm.media import filesystem

#: Bytes of payload from which equal ones are stored once; compressed bytes of an archive, of a reading task's stretch,
#: of one read, and of payloads in a streamed batch.
LEAST_BYTES, ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES, BATCH_BYTES = 100, 1 << 30, 8 << 20, 1 << 16, 4 << 20
#: Bytes of the table that one writing task takes.
TASK_BYTES = 256 << 20
#: The table has no times of capture, so all records carry this one unless another is given.
DATE = "2000-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "capture string, key string, url string, record_type string, digest string, file string, offset long, length long"
RECORDS = "key string, url string, record_type string, digest string, refers_key string, refers_url string, payload binary"


class Archive(NamedTuple):
    """A folder of archives with its captures (a table), its index and the type of the rows' ids."""

    folder: str
    captures: DataFrame
    index: capture_index.Index
    id_type: str


def _line(value: str) -> str:
    """A header value: blanks and control characters, which would end it, as %20."""
    return "".join(c if c > " " and c != "\x7f" else "%20" for c in value)


def record_id(key: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([key, url, digest]))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def capture_record(key: str | None, url: str | None, payload: bytes | None, digest: str, first: tuple[str | None, str | None] | None, date: str) -> bytes:
    """The response record of a payload or, where first is the (key, url) of another capture of it, a revisit record.
    Keys are written as JSON, so any string and null can be read back."""
    headers = [("WARC-Record-ID", record_id(key, url, digest)), ("WARC-Date", date), ("WARC-Target-URI", _line(url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Row-Key", json.dumps(key)), ("X-Row-Url", json.dumps(url))]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is None:
        return record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], status + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    refers = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Target-URI", _line(first[1] or "")), ("WARC-Refers-To-Date", date), ("X-Refers-Key", json.dumps(first[0])), ("X-Refers-Url", json.dumps(first[1]))]
    return record("revisit", [*headers, *refers, ("Content-Type", "application/http; msgtype=response")], status + b"\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise OSError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise OSError("a record is cut short")
    return headers, rest[:size]


def _row(data: bytes) -> tuple | None:
    """A row of RECORDS; None for records that are no captures. The digest of a response is that of the payload read; one
    that differs from what its header says is damage."""
    headers, block = parse(data)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    told = lambda name, other=None: json.loads(headers[name]) if name in headers else other
    url = told("x-row-url", headers.get("warc-target-uri"))
    digest = headers.get("warc-payload-digest", "")
    refers = (told("x-refers-key"), told("x-refers-url", headers.get("warc-refers-to-target-uri"))) if kind == "revisit" else (None, None)
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None:
        found = "sha256:" + hashlib.sha256(payload).hexdigest()
        if digest.startswith("sha256:") and digest != found:
            raise OSError("a payload does not have its digest")
        digest = found
    return told("x-row-key"), url, kind, digest.removeprefix("sha256:"), *refers, payload


def rows_of(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest) of every row; null payloads are empty."""
    payload = F.coalesce(df[payload_col].cast("string").cast("binary"), F.lit(b""))
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def firsts(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, first, n): of each payload of `least` bytes or more that several rows have, the (id, url) of the row with
    the smallest id. Null ids are not smallest. Combined in each task before anything moves."""
    one = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    found = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min(one).alias("first"), F.count("*").alias("n"))
    return found.where("n > 1 and first is not null")


def write_records(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record for each row of df into folder and returns the captures (CAPTURES).

    Payloads stay in the task that read them, unless very many payloads have copies: rows meet the small table of
    payloads with copies, which Spark broadcasts below its own threshold, and hot payloads do not move in any case.
    """
    rows = rows_of(df, id_col, url_col, payload_col)
    known = written(firsts(rows, least), "firsts")
    copies = known.agg(F.sum("n")).first()[0]
    rows = spread(rows)
    rows = rows.coalesce(tasks_for(df, TASK_BYTES))
    if copies:
        rows = spread_join(rows, known.select("digest", "first"), ["digest"], "left", hot_of(known, ["digest"], copies))
    else:
        rows = rows.withColumn("first", F.lit(None).cast(known.schema["first"].dataType))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    text = lambda c: F.when(again, c.cast("string"))
    ready = rows.select(F.col("id").cast("string").alias("key"), "url", F.when(~again, F.col("payload")).alias("payload"), "digest", text(F.col("first.id")).alias("first_key"), text(F.col("first.url")).alias("first_url"), again.alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = filesystem(folder)
        out, name, at, n = None, "", 0, 0
        for batch in batches:
            for part in slices(batch):
                places = []
                for key, url, payload, digest, first_key, first_url, again in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        name, at, n = f"{stem}-{n:04d}.warc.gz", 0, n + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = gzip.compress(record("warcinfo", [("WARC-Record-ID", record_id(None, name, "")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), 6, mtime=0)
                        at += out.write(info)
                    data = gzip.compress(capture_record(key, url, payload, digest, (first_key, first_url) if again else None, date), 6, mtime=0)
                    out.write(data)
                    places.append(("revisit" if again else "response", name, at, len(data)))
                    at += len(data)
                kinds, names, offsets, lengths = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kinds), part.column(3), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "url", "record_type", "digest", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = ready.mapInArrow(run, CAPTURES.partition(", ")[2])
    return captures.select(capture_index.capture(F.col("url"), F.col("key")).alias("capture"), "*")


def write_archive(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> Archive:
    """Writes df's rows as records and indexes their captures."""
    folder = folder or work_path(df.sparkSession, "warc")
    captures = written(write_records(df, f"{folder}/archives", id_col, url_col, payload_col, least, date), "captures")
    return Archive(folder, captures, capture_index.build(captures, f"{folder}/index"), df.schema[id_col].dataType.simpleString())


def inflate(source: pa.NativeFile, buffer: bytearray, at: int) -> tuple[bytes | None, int]:
    """The content of the gzip member at buffer[at:] and where it ends; more is read from source as needed. None if no
    WARC record begins there. A member that is damaged after a record's first bytes raises OSError."""
    d, out = zlib.decompressobj(31), bytearray()
    while True:
        if at >= len(buffer):
            more = source.read(READ_BYTES)
            if not more and not out.startswith(b"WARC/1."):
                return None, at
            if not more:
                raise OSError("an archive ends inside a record")
            buffer += more
        piece = bytes(buffer[at : at + (READ_BYTES >> 2)])
        try:
            out += d.decompress(piece)
        except zlib.error as e:
            if not out.startswith(b"WARC/1."):
                return None, at
            raise OSError(f"a record is damaged: {e}") from e
        if len(out) >= 7 and not out.startswith(b"WARC/1."):
            return None, at
        at += len(piece) - len(d.unused_data)
        if d.eof:
            return (bytes(out) if out.startswith(b"WARC/1.") else None), at


def members(source: pa.NativeFile, start: int, end: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record that begins in [start, end). whole: a record begins at start; else the first one
    is looked for by the bytes that begin a gzip member, and by what is in it."""
    source.seek(start)
    buffer, base, at = bytearray(), start, 0
    while base + at < end:
        if len(buffer) - at < len(MAGIC):
            more = source.read(READ_BYTES)
            buffer += more
            if len(buffer) - at < len(MAGIC):
                if whole and len(buffer) > at:
                    raise OSError(f"bytes after the last record, at {base + at}")
                return
        if not whole:
            found = buffer.find(MAGIC, at)
            if found < 0:
                at = len(buffer) - len(MAGIC) + 1
                continue
            if base + found >= end:
                return
            at = found
        data, after = inflate(source, buffer, at) if buffer[at : at + len(MAGIC)] == MAGIC else (None, at)
        if data is None:
            if whole:
                raise OSError(f"no record at {base + at}")
            at += 1
            continue
        yield base + at, data
        whole, at = True, after
        del buffer[:at]
        base, at = base + at, 0


def _batches(rows: Iterator[tuple], extra: tuple[pa.DataType, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose last value is a payload, of about BATCH_BYTES."""
    kinds = (*extra, *[pa.string()] * 6, pa.binary())
    names = [f"c{i}" for i in range(len(extra))] + [x.split()[0] for x in RECORDS.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for r in rows:
        held.append(r)
        size += len(r[-1] or b"") + 200
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_ranges(ranges: DataFrame, folder: str) -> DataFrame:
    """The records (RECORDS) that begin in the ranges (file, start, end, whole) of folder's archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, start, end, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with fs.open_input_file(f"{root}/{file}") as source:
                        for _, data in members(source, start, end, whole):
                            row = _row(data)
                            if row is not None:
                                yield row

        yield from _batches(rows())

    return ranges.select("file", "start", "end", "whole").mapInArrow(run, RECORDS)


def read_captures(archive: Archive, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record that the captures name, in stretches of whole records of about range_bytes, dealt over tasks."""
    part = F.floor(F.col("offset") / range_bytes)
    ranges = archive.captures.groupBy("file", part.alias("part")).agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
    ranges = written(ranges.withColumn("whole", F.lit(True)), "ranges")
    return read_ranges(ranges.repartition(max(1, ranges.count())), f"{archive.folder}/archives")


def read_folder(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every response and revisit record of a folder's *.warc.gz, of which nothing else is known. A range's first record
    is looked for; one that is damaged there cannot be told from other bytes, and is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    ranges = files.where("length > 0").select("file", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = written(ranges.select("file", "start", (F.col("start") + range_bytes).alias("end"), (F.col("start") == 0).alias("whole")), "ranges")
    return read_ranges(ranges.repartition(max(1, ranges.count())), folder)


def fetch(found: DataFrame, folder: str) -> DataFrame:
    """The records at found's (file, offset), each by one range read, with the columns of RECORDS and the place."""
    rows = found.select("file", "offset", "length").distinct()
    n = partitions(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)

        def read() -> Iterator[tuple]:
            name, source = None, None
            for batch in batches:
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, fs.open_input_file(f"{root}/{file}")
                    source.seek(offset)
                    yield file, offset, *_row(gzip.decompress(source.read(length)))

        yield from _batches(read(), (pa.string(), pa.int64()))

    return rows.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, f"file string, offset long, {RECORDS}")


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(wanted, capture, key, url, record_type, digest, file, offset, length): the captures of each distinct URL of urls."""
    wanted = urls.select(urls[url_col].cast("string").alias("wanted")).where("wanted is not null").distinct()
    key = capture_index.url_key(F.col("wanted"))
    asked = wanted.select("wanted", F.concat(key, F.lit(" ")).alias("low"), F.concat(key, F.lit("!")).alias("high"))
    return capture_index.find(asked, archive.index).where(F.col("url") == F.col("wanted")).drop("low", "high")


def of_host(archive: Archive, spark: SparkSession, host: str, subdomains: bool = False) -> DataFrame:
    """The captures of one host, or also of all hosts below it, out of the blocks that can hold them."""
    name = ",".join(reversed(host.lower().split(".")))
    asked = spark.createDataFrame([(name + ")", name + ("-" if subdomains else "*"))], "low string, high string")
    return capture_index.find(asked, archive.index).drop("low", "high")


def read_back(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by what the archives hold.

    A revisit's numbers are those of the record it refers to: each such record is looked up and read once, whatever
    number of revisits refer to it, and the numbers are joined back without moving those of hot payloads.
    """
    read = written(read_captures(archive).select("key", "record_type", "digest", "refers_key", "refers_url", F.length("payload").cast("long").alias("payload_bytes")), "records")
    ids = lambda c: F.col(c).cast(archive.id_type)
    own = read.where("record_type = 'response'").select(ids("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(archive.id_type).alias("refers_to"))
    revisits = read.where("record_type = 'revisit'").select("key", "digest", "refers_key", "refers_url")
    counted = written(revisits.groupBy("digest").agg(F.min(F.struct("refers_key", "refers_url")).alias("to"), F.count("*").alias("n")), "targets")
    copies = counted.agg(F.sum("n")).first()[0]
    if not copies:
        return own
    low = capture_index.capture(F.col("to.refers_url"), F.col("to.refers_key"))
    asked = counted.select(low.alias("low"), F.concat(low, F.lit("\u0001")).alias("high"), F.col("digest").alias("asked_digest"))
    places = capture_index.find(asked, archive.index, first=True)
    sizes = written(fetch(places, f"{archive.folder}/archives").groupBy("digest").agg(F.max(F.length("payload")).cast("long").alias("payload_bytes")), "sizes")
    seen = spread_join(revisits, sizes, ["digest"], "left", hot_of(counted, ["digest"], copies))
    size = F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response record of "), F.col("digest"))).cast("long"))
    again = seen.select(ids("key").alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), ids("refers_key").alias("refers_to"))
    return own.unionByName(again)


def store_and_read(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Writes every row's payload (null: empty) as a record and reads the archives back; one row for each row of df.

    Of equal payloads of `least` bytes or more the row with the smallest id is a response and the others revisit it;
    rows that share the smallest id are all responses, as each is that record. A row without an id is a revisit where
    another row with an id has its payload, else a response. Null and odd URLs are archived; extra columns are not
    read; an empty table gives an empty table.
    """
    return read_back(write_archive(df, None, id_col, url_col, payload_col, least))
