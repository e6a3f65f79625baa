"""Fill-in-middle: masks against regular expressions, the query against a plain version, exact round trips."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import TEXTS, awkward, empty
from vectrine.llm import fim, queries

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A[ \t\n\v\f\r]*[^ \t\n\v\f\r]*[ \t\n\v\f\r]*|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", "char": r"(?s)."}


def units(text, unit):
    return [x for x in re.findall(UNIT[unit], text) if x]


def plain(doc_id, text, seed=7, fim_percent=100, spm_percent=50, unit="line"):
    text = text or ""
    u = units(text, unit)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@given(st.integers(0, 1 << 300), st.data())
def test_select_finds_ranked_bits(bits, data):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    if places:
        k = data.draw(st.integers(0, len(places) - 1))
        assert fim.select(bits, k) == places[k]


@settings(max_examples=300)
@given(st.text(alphabet="ab\n \t<PSM>é漢😀", max_size=60), st.sampled_from(fim.UNITS), st.integers(0, 10_000))
def test_one_text_equals_regular_expressions(text, unit, doc_id):
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    *got, output = fim.transform_bytes(text.encode(), h, 100, 50, unit)
    assert (*got, output.decode()) == plain(doc_id, text, unit=unit)


def test_query_equals_a_plain_version(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_fim(spark, sf).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(got) == len(texts) and {r["form"] for r in got} >= {"psm", "spm"}
    for r in got:
        n, form, prefix, middle, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, prefix, middle, sha(output), sha(texts[r["doc_id"]] or ""))


@pytest.mark.parametrize("unit", fim.UNITS)
def test_awkward(spark, unit):
    assert fim.transform(empty(spark)).collect() == []
    out = fim.transform(awkward(spark), 3, 80, 20, unit)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain(i, t, 3, 80, 20, unit), t or "") for i, t in TEXTS), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == want


def test_markers_near_the_cuts_and_long_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", ">", "P", "S", "M", "\n", "é"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["x\n" * 400_000, "y" * 900_000, "<P", "S>\n<", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for unit in fim.UNITS:
        rows = fim.transform(df, unit=unit).select("doc_id", "n", "form", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        for r in rows:
            n, form, _, _, output = plain(r["doc_id"], texts[r["doc_id"]], unit=unit)
            assert (r["n"], r["form"], r["output"], r["back"]) == (n, form, output, texts[r["doc_id"]])


def test_a_unit_of_another_kind_is_refused(spark):
    with pytest.raises(ValueError):
        fim.transform(empty(spark), unit="page")
