"""A two-level index of captures.

Captures are sorted by their URL with the host reversed, then by row key. Each task of the sorted table writes one
shard: blocks of lines, each compressed on its own, and a sparse directory with the first capture of each block. A
look-up finds its shards among their first captures, its blocks by binary search in the shard's directory, reads those
blocks by their byte ranges and searches inside them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.llm.common import partitions
from vectrine.llm.media import filesystem

#: Lines of a block; captures of a shard, from which their number follows; and how many shards there are at most.
BLOCK_LINES, SHARD_CAPTURES, MAX_SHARDS = 3000, 1_000_000, 4096
FIELDS = ("key", "url", "record_type", "digest", "file", "offset", "length")


class Shard(NamedTuple):
    first: str
    last: str
    name: str


class Index(NamedTuple):
    """A folder of shards and the list of them in order, at most MAX_SHARDS whatever the number of captures."""

    folder: str
    shards: list[Shard]


def _plain(text: Column) -> Column:
    """Without blanks and control characters, which the lines and captures use."""
    return F.regexp_replace(text, r"[\x00-\x20\x7F]", "%20")


def url_key(url: Column) -> Column:
    """com,example,www:8080)/path?query for a URL; the scheme, a user name and the host's case are left out. What is no
    URL is )text, and null is )."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    head = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(u, head + r"(?:[^/?#@]*@)?([^/?#]*)", 1))
    name = F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.substring(host, F.length(name) + 1, F.length(host))
    rest = F.regexp_replace(u, head + r"[^/?#]*", "")
    return _plain(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), rest))


def capture(url: Column, key: Column) -> Column:
    """What captures are sorted by: the URL's key, one blank, the row's key."""
    return F.concat(url_key(url), F.lit(" "), _plain(F.coalesce(key.cast("string"), F.lit(""))))


def build(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts the captures and writes the shards. Ties of a capture are ordered by place, so a page with very many
    captures is divided among shards like all others."""
    total = captures.count()
    n = min(MAX_SHARDS, max(partitions(captures.sparkSession), -(-total // SHARD_CAPTURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = filesystem(folder)
        lines, directory, out, at = [], [], None, 0

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append(json.dumps([lines[0].partition("\t")[0], at, len(block)]))
            at += len(block)
            lines.clear()

        last = None
        for batch in batches:
            for one, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.blocks", compression=None)
                lines.append(f"{one}\t{entry}")
                last = one
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([json.loads(directory[0])[0]]), pa.array([last]), pa.array([name])], ["first", "last", "name"])

    order = ["capture", "file", "offset"]
    lines = captures.select("capture", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("entry"), "file", "offset")
    rows = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "first string, last string, name string").collect()
    return Index(folder, sorted(Shard(*r) for r in rows))


class Reader:
    """Looks captures up; keeps the directory and the block it read last, as neighbours are asked for in turn."""

    def __init__(self, index: Index) -> None:
        self.shards = index.shards
        self.lasts = [s.last for s in index.shards]
        self.fs, self.root = filesystem(index.folder)
        self.name, self.directory, self.source = None, [], None
        self.block_at, self.lines, self.blocks_read = None, [], 0

    def _open(self, name: str) -> None:
        if name != self.name:
            with self.fs.open_input_file(f"{self.root}/{name}.directory") as f:
                self.directory = [json.loads(x) for x in f.read().decode().split("\n")]
            self.firsts = [x[0] for x in self.directory]
            if self.source is not None:
                self.source.close()
            self.source = self.fs.open_input_file(f"{self.root}/{name}.blocks")
            self.name, self.block_at = name, None

    def _block(self, k: int) -> list[str]:
        if k != self.block_at:
            _, at, size = self.directory[k]
            self.source.seek(at)
            self.lines = zlib.decompress(self.source.read(size)).decode().split("\n")
            self.block_at, self.blocks_read = k, self.blocks_read + 1
        return self.lines

    def between(self, low: str, high: str) -> Iterator[tuple[str, dict]]:
        """(capture, entry) of the captures in [low, high), in order."""
        for s in range(bisect_left(self.lasts, low), len(self.shards)):
            if self.shards[s].first >= high:
                return
            self._open(self.shards[s].name)
            # captures equal to low may end the block before the one that begins with it
            for k in range(max(0, bisect_left(self.firsts, low) - 1), len(self.firsts)):
                if self.firsts[k] >= high:
                    break
                lines = self._block(k)
                for i in range(bisect_left(lines, low), len(lines)):
                    one, _, entry = lines[i].partition("\t")
                    if one >= high:
                        break
                    yield one, json.loads(entry)


def find(asked: DataFrame, index: Index, first: bool = False) -> DataFrame:
    """asked (with columns low and high) joined with the captures in [low, high) and their fields.

    With first, asked also has asked_digest, and each row gets the first response record of that digest only, however
    many captures lie in its range. Rows are dealt in order of low, so a task reads each block it needs about once.
    """
    columns = asked.columns
    low, high = columns.index("low"), columns.index("high")
    digest = columns.index("asked_digest") if first else None
    kinds = [pa.string()] * 6 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)

        def batch_of(part: pa.RecordBatch, held: list) -> pa.RecordBatch:
            own = part.take(pa.array([h[0] for h in held], pa.int64()))
            return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(list(zip(*held, strict=True))[1:], kinds, strict=True))], [*columns, "capture", *FIELDS])

        for part in batches:
            rows, held = list(zip(*(c.to_pylist() for c in part.columns), strict=True)), []
            for i, row in enumerate(rows):
                for one, entry in reader.between(row[low], row[high]):
                    if first and (entry["record_type"] != "response" or entry["digest"] != row[digest]):
                        continue
                    held.append((i, one, *(entry[f] for f in FIELDS)))
                    if len(held) >= 10_000:
                        yield batch_of(part, held)
                        held = []
                    if first:
                        break
            if held:
                yield batch_of(part, held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    dealt = asked.repartitionByRange(partitions(asked.sparkSession), "low").sortWithinPartitions("low")
    return dealt.mapInArrow(run, f"{schema}, capture string, key string, url string, record_type string, digest string, file string, offset long, length long")
