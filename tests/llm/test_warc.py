"""WARC archives and their index: the query against brute force, look-ups against all captures, foreign folders, damage."""

import gzip
import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from vectrine.llm import capture_index, queries, warc

PAGE = "<html><body>" + "word " * 30 + "é漢😀</body></html>"
ROWS = [
    (4, "https://Ex.Example.org/a?b=1", PAGE),
    (2, "http://ex.example.org:8080/b", PAGE),
    (9, "http://user@x.example.org/", PAGE),
    (9, "http://user@x.example.org/", PAGE),
    (None, "http://no.id/", PAGE),
    (7, None, "short"),
    (8, "not a url \t\n", "short"),
    (1, "", ""),
    (3, "http://null.example.net", None),
    (5, "http://tie.net/", "t" * 200),
    (5, "http://tie.net/", "t" * 200),
    (6, "http://tie.net/", "t" * 200),
    (None, "http://a.b/", "n" * 150),
    (None, "http://a.b/c", "n" * 150),
    (10, "http://edge.net/99", "e" * 99),
    (11, "http://edge.net/99b", "e" * 99),
    (12, "http://edge.net/100", "f" * 100),
    (13, "http://edge.net/100b", "f" * 100),
    (14, "http://long.net/", "x\r\n\r\nWARC/1.1\r\n" * 50_000),
]
SCHEMA = "page_id long, url string, html string, digest string, first string, record_type string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(parts)


def plain(rows, least=100):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        first = min(ids) if ids and len(data) >= least else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def test_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op11_warc(spark, sf)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == plain(pages)


def test_awkward_rows(spark):
    assert Counter(tuple(r) for r in warc.store_and_read(table(spark, ROWS)).collect()) == plain(ROWS)
    assert warc.store_and_read(table(spark, [])).collect() == []
    only = spark.createDataFrame([("b", None, "x" * 120), ("a\n", "u", "x" * 120)], "page_id string, url string, html string")
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.store_and_read(only).collect()} == {("a\n", "response", None), ("b", "revisit", "a\n")}


def test_a_hot_payload_and_many_copies(spark):
    """A payload of a third of the rows, and more groups of copies than fit one block."""
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 7}.net/{i}", "hot " * 50 if i % 3 == 0 else f"page {rng.randrange(200)} " * 20) for i in range(1500)]
    assert Counter(tuple(r) for r in warc.store_and_read(table(spark, rows, 7)).collect()) == plain(rows)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rng = random.Random(2)
    hosts = ["example.org", "www.example.org", "example.org.uk", "xexample.org", "a.b.c.net", "hot.net"]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.randrange(40)}" if i % 3 else "https://hot.net/same", f"<p>{i % 400}</p>" * 30) for i in range(1200)]
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    made = warc.write_archive(table(spark, rows, 5), folder)
    small = capture_index.build(made.captures, f"{folder}/small", block_lines=16)
    return rows, made._replace(index=small)


def test_look_ups_find_all_captures_and_no_others(spark, archive):
    rows, made = archive
    urls = sorted({u for _, u, _ in rows}) + ["https://example.org/none", "https://zzz.net/", "http://a.b.c.net/1", "https://EXAMPLE.org/1"]
    got = Counter((r["wanted"], r["key"]) for r in warc.lookup(made, spark.createDataFrame([(u,) for u in urls * 2], "url string")).collect())
    assert got == Counter((u, str(i)) for i, u, _ in rows)


def test_hosts(spark, archive):
    rows, made = archive
    of = lambda *a: Counter(r["url"] for r in warc.of_host(made, spark, *a).collect())
    among = lambda *hosts: Counter(u for _, u, _ in rows if u.split("/")[2] in hosts)
    assert of("Example.org") == among("example.org")
    assert of("example.org", True) == among("example.org", "www.example.org")
    assert of("net", True) == among("a.b.c.net", "hot.net")
    assert of("nobody.com", True) == Counter()


def test_a_look_up_reads_few_blocks(archive):
    rows, made = archive
    assert len(made.index.shards) > 1
    reader = capture_index.Reader(made.index)
    one = next(i for i, u, _ in rows if u == "https://hot.net/same" and i > 600)
    low = f"net,hot)/same {one}"
    assert [x["key"] for _, x in reader.between(low, low + "\u0001")] == [str(one)]
    assert reader.blocks_read <= 2
    n = sum(1 for _ in reader.between("net,hot)/same ", "net,hot)/same!"))
    assert n == sum(u == "https://hot.net/same" for _, u, _ in rows)


def test_url_keys(spark):
    urls = ["https://WWW.Example.org:8080/A b?q#f", "http://u:p@h.net", "mailto:x@y", None, "", "http://[::1]:80/x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(capture_index.url_key(F.col("u"))).collect()]
    assert got == ["org,example,www:8080)/A%20b?q#f", "net,h)", ")mailto:x@y", ")", ")", "[::1]:80)/x"]


def test_archives_are_warc_files_of_single_members(archive):
    rows, made = archive
    seen = Counter()
    for path in Path(made.folder.removeprefix("file://"), "archives").glob("*.warc.gz"):
        for part in gzip.decompress(path.read_bytes()).split(b"WARC/1.1\r\n")[1:]:
            head, _, rest = part.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
            assert rest[int(headers["Content-Length"]) :] == b"\r\n\r\n" and headers["WARC-Record-ID"].startswith("<urn:uuid:")
            seen[headers["WARC-Type"]] += 1
            if headers["WARC-Type"] == "revisit":
                assert b"<p>" not in rest and headers["WARC-Refers-To"]
    assert seen["response"] == 400 and seen["revisit"] == 800 and seen["warcinfo"] >= 1


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 20])
def test_ranges_lose_and_double_no_record(spark, archive, range_bytes):
    rows, made = archive
    want = Counter((str(i), u) for i, u, _ in rows)
    if range_bytes > 100:
        assert Counter((r["key"], r["url"]) for r in warc.read_captures(made, range_bytes).collect()) == want
    files = spark.read.format("binaryFile").load(f"{made.folder}/archives").select("length").collect()
    if range_bytes > 500 or sum(r["length"] for r in files) < 200_000:
        assert Counter((r["key"], r["url"]) for r in warc.read_folder(spark, f"{made.folder}/archives", range_bytes).collect()) == want


def test_members_from_any_place(tmp_path):
    payloads = [bytes([i]) * (i * 37 % 500) + b"\x1f\x8b\x08" * (i % 3) for i in range(40)]
    records = [gzip.compress(warc.capture_record(str(i), "u", p, hashlib.sha256(p).hexdigest(), None, warc.DATE), i % 10, mtime=0) for i, p in enumerate(payloads)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(records))
    starts = [sum(map(len, records[:i])) for i in range(len(records))]
    fs = pafs.LocalFileSystem()
    end = starts[-1] + len(records[-1])
    for cut in range(0, end, 13):
        with fs.open_input_file(str(tmp_path / "x.warc.gz")) as f:
            a = [at for at, _ in warc.members(f, 0, cut, True)]
            b = [at for at, _ in warc.members(f, cut, end, False)]
        assert a + b == starts


def test_damage_is_reported(tmp_path):
    one = gzip.compress(warc.capture_record("1", "u", b"p" * 300, hashlib.sha256(b"p" * 300).hexdigest(), None, warc.DATE), mtime=0)
    fs = pafs.LocalFileSystem()
    for name, data in (("cut", one + one[:-20]), ("crc", one + one[:-6] + b"\0\0" + one[-4:]), ("tail", one + b"\x1f"), ("other", one + b"xxxxxx" + one)):
        (tmp_path / name).write_bytes(data)
        with fs.open_input_file(str(tmp_path / name)) as f, pytest.raises(OSError):
            list(warc.members(f, 0, len(data), True))
    bad = warc.capture_record("1", "u", b"p" * 300, "0" * 64, None, warc.DATE)
    with pytest.raises(OSError):
        warc._row(bad)
    assert json.loads(json.dumps(warc._row(warc.record("warcinfo", [], b"")))) is None
