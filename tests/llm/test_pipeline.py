"""The pipeline's stages, each against a plain version of it on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm.fixtures import empty
from tests.llm.test_maps import base_secrets, check_packing
from tests.llm.test_neardup import brute
from vectrine.llm import language, suffixes
from vectrine.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_shape(steps):
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "secrets", "packing"]
    assert all(df.columns == COLUMNS and df.dtypes == steps[0].dtypes for df in steps[:-1])


def test_language_drops_only_what_it_rejects(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after.items()) <= set(before.items())
    assert len(after) >= 0.98 * len(before)


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = {i for i, (_, c) in brute(list(before.items()), 5, 80).items() if i == c}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_an_id_with_several_texts_keeps_each_once(spark):
    a, b = ("the first text tells of ships that sail at night", "another one is about bread and how to bake it")
    data = [(1, a, "en", "z", 48), (1, a, "en", "y", 48), (1, b, "en", "x", 45), (2, a, "en", "w", 48), (None, b, "en", "v", 45)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    out = pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == COLUMNS
    assert {(r["doc_id"], r["text"], r["source"]) for r in out.collect()} == {(1, a, "y"), (1, b, "x"), (None, b, "v")} and out.count() == 3


def test_stages_keep_genuine_marks_and_columns_of_any_name(spark):
    passage = "all of this passage stands in two documents, word for word, as a repeat"
    names = ["doc_id", "text", "n_removed", "kept", "n_bytes", "n_spans", "kept_text", "carried", "others", "_o", "_blob", "_spans", "blob", "row", "lang"]
    rows = [(1, f"first \ufffd {passage}", *"abcdefghijkl", "en"), (2, f"bad \ufffd char {passage} tail \ufffd password=hunter2secret", *"abcdefghijkl", "en")]
    docs = spark.createDataFrame(rows, names)
    out = written(pipeline.drop_repeated_passages(spark, docs, SF), "names")
    assert out.columns == names
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and tuple(got[1])[2:] == rows[0][2:] and tuple(got[2])[2:] == rows[1][2:]
    assert got[2]["text"].startswith("bad \ufffd char") and " tail \ufffd password" in got[2]["text"] and "word for word" not in got[2]["text"]
    clean = written(pipeline.mask_secrets(spark, out, SF), "clean")
    assert clean.columns == names and {r["doc_id"]: r["text"] for r in clean.collect()}[2].endswith("tail \ufffd [secret]")
    again = written(pipeline.drop_near_duplicates(spark, clean, SF), "again")
    assert again.columns == names and again.count() == 2
    few = docs.select("doc_id", "text")
    for stage in (pipeline.drop_near_duplicates, pipeline.drop_repeated_passages, pipeline.mask_secrets):
        few = written(stage(spark, few, SF), "few")
        assert few.columns == ["doc_id", "text"] and few.count() == 2


def test_repeated_passages(steps):
    before, after = rows(steps[2]), rows(steps[3])
    least = {}
    for i, t in before.items():
        x = t.encode()
        for at in range(len(x) - 49):
            w = x[at : at + 50]
            least[w] = min(least.get(w, i), i)
    for i, t in before.items():
        x, gone = t.encode(), set()
        for at in range(len(x) - 49):
            if least[x[at : at + 50]] < i:
                gone.update(range(at, at + 50))
        kept = bytes(c for k, c in enumerate(x) if k not in gone).decode("utf-8", "ignore")
        assert after.get(i, "") == kept or (i not in after and not kept.strip(" "))
    assert any(len(after.get(i, "")) < len(t) for i, t in before.items())
    again = {r[0] for r in suffixes.brute_force(list(before.items())) if not r[2]}
    assert again <= set(after)


def test_secrets_are_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    hit = {i for i, t in before.items() if base_secrets(t)}
    assert hit and all(not base_secrets(after[i]) for i in hit)
    assert all(after[i] == t for i, t in before.items() if i not in hit and not re.search(r"BEGIN|eyJ", t))


def test_packing(steps):
    check_packing(steps[5].collect(), list(rows(steps[4]).items()))


def test_run_equals_the_stages(spark, steps):
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(steps[5])


def test_awkward_rows_pass_every_stage(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the quick brown fox and the lazy dog were at the barn with password=hunter2secret " * 3
    data = [(1, text, "en", None, None), (1, text, "en", None, None), (2, text, None, "s", 5), (None, text, "en", "s", 1), (3, None, "en", "s", 1), (4, "", None, None, None), (5, "der hund war im stall und der fuchs auch, wie jeden tag im herbst", "de", "s", 2)]
    docs = spark.createDataFrame(data, kind)
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "awkward")
        assert docs.columns == COLUMNS
    left = Counter(r["doc_id"] for r in docs.collect())
    assert left[1] == 1 and left[None] == 1 and 2 not in left and 3 not in left
    assert pipeline.pack_sequences(spark, docs, SF).count() == sum(left.values())
    none = empty(spark).selectExpr("doc_id", "text", "score lang", "blob source", "doc_id n_chars")
    for _, stage in pipeline.STAGES:
        none = written(stage(spark, none, SF), "none")
        assert none.count() == 0


def test_language_margin_is_a_parameter():
    c = language.CompressionClassifier({"a": b"abcabc " * 50, "b": b"xyzxyz " * 50}, margin=0.99)
    assert c.predict("abcabc abcabc")[2]
