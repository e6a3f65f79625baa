"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digit pairs, digits joined by a
dot, schemes and identifier cues. A deterministic local parser expands each anchor to the boundaries of an e-mail
address, network address, card, phone number, web address or account number and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vectrine.llm.bpe import slices
from vectrine.llm.common import ID, TEXT, documents

#: The base kinds in the order of results, then the kinds this method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("url", "account")
KINDS = BASE + ADDED
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_ACCOUNT = re.compile(r"(?:[\x20]?(?:no\.?|number|id))?[\x20:#=]{1,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,19})")
_CUES = ("iban", "account", "acct", "ssn", "passport")
_AUTOMATON: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        own = ahocorasick.Automaton()
        words = {"@": "email", "://": "url"} | {f"+{d}": "phone" for d in _DIGITS}
        words |= {f"{a}.{b}": "ip" for a, b in product(_DIGITS, _DIGITS)}
        words |= {f"{a}{mid}{b}": "card" for a, mid, b in product(_DIGITS, ("", " ", "-"), _DIGITS)}
        words |= {form: "account" for cue in _CUES for form in (cue, cue.title(), cue.upper())}
        for word, kind in words.items():
            own.add_word(word, (kind, len(word)))
        own.make_automaton()
        _AUTOMATON.append(own)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    start = at
    while start > since and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at) if start < at else None
    return (start, m.end(), True) if m else None


def _ip(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    start = at
    while start > since:
        if text[start - 1] in _DIGITS:
            start -= 1
        elif text[start - 1] == "." and start - 2 >= since and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    m = _QUAD.match(text, start)
    return (start, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())) if m else None


def _card(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    start = at
    while start > since:
        if text[start - 1] in _DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 2 >= since and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    m = _CHAIN.match(text, start)
    if not m:
        return None
    digits = m[0].replace(" ", "").replace("-", "") if m.end() - start <= 40 else ""
    return start, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at)
    return (at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15) if m else None


def _url(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    start = at
    while start > since and text[start - 1] in _NAME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    m = _URL_REST.match(text, at) if start < at else None
    if not m:
        return None
    end = m.end()
    while text[end - 1] in ".,;:!?)":
        end -= 1
    return start, end, end > at + 3


def _account(text: str, at: int, since: int) -> tuple[int, int, bool] | None:
    """at is the end of the cue here."""
    m = _ACCOUNT.match(text, at)
    if not m:
        return None
    value = m[1].replace(" ", "").replace("-", "")
    return m.start(1), m.end(1), iban(value) if value[0].isalpha() else True


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive.

    Per kind the spans are those that a leftmost scan without overlaps finds: an expansion never reaches back over
    the end of an earlier one, and one that fails its checks still uses up its characters.
    """
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    until = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _automaton().iter(text):
        at = last + 1 if kind == "account" else last - n + 1
        if at < until[kind]:
            continue
        got = _PARSERS[kind](text, at, until[kind])
        if got:
            until[kind] = got[1]
            if got[2]:
                found[kind].append((kind, got[0], got[1]))
    return [x for k in KINDS for x in found[k]]


def scan(df: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every whole text, spans in the order of find_spans.

    Null and empty texts have no spans. Rows map one to one, whatever their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(x)] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    src = documents(df, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
