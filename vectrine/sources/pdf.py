"""Text of PDF files without a PDF library: content streams are inflated and their text operators read.

Covers what word processors write: pages in a tree, Flate streams, object streams, literal and hexadecimal strings,
kerned arrays, and fonts with or without a map to Unicode (Latin-1 otherwise). Encrypted files and pictures of text
have none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*)\bendstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/()<>\[\]{}%]*|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
# What the escapes of a literal string stand for.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: Thousandths of the font size by which kerning moves on for it to be a blank.
BLANK = -200


def _unescaped(m: re.Match) -> bytes:
    x = m[1]
    return bytes([int(x, 8) & 255]) if x[:1].isdigit() and x[:1] < b"8" else _ESCAPES.get(x, x)


def _string(token: bytes) -> bytes:
    if token[:1] == b"(":
        return _ESCAPE.sub(_unescaped, token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Objects:
    """The numbered objects of a file, those in object streams too; the last of a number holds."""

    def __init__(self, data: bytes) -> None:
        self.of = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.of.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                inside, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                head = list(map(int, inside[:first].split()))
                ends = [*head[3::2], len(inside) - first]
                self.of |= {n: inside[first + a : first + b] for n, a, b in zip(head[::2], head[1::2], ends, strict=True) if n not in self.of}

    def stream(self, body: bytes) -> bytes:
        """The inflated stream of an object; other filters than Flate give nothing."""
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" in m[1]:
            try:
                return zlib.decompressobj().decompress(m[2])
            except zlib.error:
                return b""
        return b"" if b"/Filter" in m[1] else m[2]

    def refs(self, body: bytes, key: bytes) -> list[bytes]:
        """The objects that a key of a dictionary refers to, one or an array."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        found = [self.of.get(int(n), b"") for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
        return found if len(found) != 1 or not re.match(rb"\s*\[", found[0]) else [self.of.get(int(n), b"") for n in re.findall(rb"(\d+)\s+\d+\s+R", found[0])]

    def pages(self) -> Iterator[bytes]:
        """Pages in the order of the tree; a page without its own resources gets those of the node above."""

        def below(node: bytes, resources: bytes, depth: int) -> Iterator[bytes]:
            own = node if b"/Resources" in node else node + resources
            if re.search(rb"/Type\s*/Pages\b", node):
                handed = re.search(rb"/Resources\s*(?:\d+\s+\d+\s+R|<<.*>>)", own, re.S)
                for kid in self.refs(node, b"Kids") if depth < 50 else ():
                    yield from below(kid, handed[0] if handed else b"", depth + 1)
            elif re.search(rb"/Type\s*/Page\b", node):
                yield own

        for root in (x for x in self.of.values() if re.search(rb"/Type\s*/Catalog\b", x)):
            for top in self.refs(root, b"Pages"):
                yield from below(top, b"", 0)

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[bytes, str]]]:
        """By name: the bytes of a code and the map to Unicode of fonts that have one."""
        held = b"".join(self.refs(page, b"Resources")) or page
        held = b"".join(self.refs(held, b"Font")) or held
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", held):
            maps = self.refs(self.of.get(int(n), b""), b"ToUnicode")
            if maps:
                out[name] = unicode_map(self.stream(maps[0]))
        return out


def unicode_map(cmap: bytes) -> tuple[int, dict[bytes, str]]:
    """(bytes of a code, code to text) of a ToUnicode map."""
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    found: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        found |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                to = text(listed[k]) if k < len(listed) else "" if listed else text(one)[:-1] + chr(ord(text(one)[-1:] or "\0") + k)
                found[(int(a, 16) + k).to_bytes(len(a) // 2)] = to
    return (len(width[1]) // 2 if width else 1), found


def page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[bytes, str]]]) -> str:
    """What the text operators of a content stream show; a move to another line is a line end."""
    out, operands, font = [], [], None

    def shown(data: bytes) -> str:
        if font is None:
            return data.decode("latin-1")
        width, codes = font
        return "".join(codes.get(data[i : i + width], "") for i in range(0, len(data), width))

    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/+-.0123456789" and token not in (b"<<", b">>"):
            operands.append(token)
            continue
        if token in (b"Td", b"TD") and len(operands) > 1 and float(operands[-1]) != 0 or token in (b"T*", b"Tm", b"ET", b"'", b'"'):
            if out and out[-1] != "\n":
                out.append("\n")
        if token == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2][1:])
        elif token in (b"Tj", b"'", b'"') and operands:
            out.append(shown(_string(operands[-1])))
        elif token == b"TJ":
            for x in operands:
                if x[:1] in b"(<":
                    out.append(shown(_string(x)))
                elif x[:1] in b"+-.0123456789" and float(x) < BLANK:
                    out.append(" ")
        operands = []
    return "".join(out)


def text_of(data: bytes) -> str:
    """The text of all pages, one after the other; empty for what is no PDF file, is damaged or encrypted."""
    if not data.startswith(b"%PDF") or b"/Encrypt" in data:
        return ""
    try:
        held = Objects(data)
        return "".join(page_text(b"\n".join(held.stream(x) for x in held.refs(p, b"Contents")), held.fonts(p)) for p in held.pages())
    except (ValueError, IndexError, TypeError):
        return ""


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the PDF files of a folder, by Spark's own reader of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text_of(batch.column(1)[k].as_py() or b"")])], ["path", "text"])

    return files.mapInArrow(run, "path string, text string")
