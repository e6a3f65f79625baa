"""Suffix de-duplication against a table of all windows; the loser tree against sorting."""

import hashlib
import random
from collections import Counter

import pytest

from tests.llm.fixtures import TEXTS, awkward, empty
from vectrine.llm import queries, suffixes


def as_rows(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def test_query_on_a_small_table(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op10_suffixes(spark, sf).collect())
    want = suffixes.brute_force(rows)
    assert sum(r[2] for r in want) > 0
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_with_shared_parts(spark, seed):
    """Passages of 45 to 120 bytes cut at random, repetitive texts, and texts longer than a segment."""
    rng = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdé \n"
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(45, 120))) for _ in range(12)] + ["x" * 90, "This " * 25]
    rows = []
    for i in range(60):
        pieces = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(parts)
            a = rng.randint(0, 20)
            pieces += [p[a : len(p) - rng.randint(0, 20)], "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))]
        rows.append((rng.randint(0, 70), "".join(pieces)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(suffixes.strip_repeats(df)) == sorted(suffixes.brute_force(rows))


def test_texts_longer_than_a_segment(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [(1, long), (2, "y" + long[100:4000] + "z" + long[:300])]
    want = [(text, [tuple(x) for x in zip(*(a.tolist() for a in part), strict=True)]) for text, part in zip("ab", suffixes.anchored([t.encode() for _, t in texts]), strict=False)]
    assert want
    whole = {(t, i): k for t, f, l, _, key in suffixes.anchored([x.encode() for _, x in texts]) for t, f, l, k in zip(t, f, l, key, strict=True) for i in range(f, l + 1)}
    monkeypatch.setattr(suffixes, "SEGMENT", 512)
    split = {(t, i): k for t, f, l, _, key in suffixes.anchored([x.encode() for _, x in texts]) for t, f, l, k in zip(t, f, l, key, strict=True) for i in range(f, l + 1)}
    assert whole == split and len(whole) == sum(len(t) - 49 for _, t in texts)


@pytest.mark.parametrize("seed", range(3))
def test_many_contexts_of_one_anchor(spark, seed):
    """One passage that very many texts share in different lengths, before and after different words."""
    rng = random.Random(seed)
    core = "the committee met on the third day of the month and agreed upon nothing at all"
    rows = []
    for i in range(150):
        a, b = rng.randint(0, 30), rng.randint(0, 30)
        rows.append((i // 2, rng.choice("xyz") * rng.randint(0, 3) + core[a : len(core) - b] + rng.choice("pqr") * rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(suffixes.strip_repeats(df)) == sorted(suffixes.brute_force(rows))


def test_kept_text_loses_only_cut_characters(spark):
    passage = "0123456789" * 3 + "wxyz" * 6 + "é"
    raw = passage.encode()
    assert len(raw) == 56
    rows = [(1, "a " + passage + " b"), (2, "genuine \ufffd here " + passage[:-1] + "ê and \ufffd there")]
    out = {r["doc_id"]: r for r in suffixes.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), carry=("doc_id",)).collect()}
    assert out[1]["kept_text"] == rows[0][1] and out[2]["n_removed"] > 50
    assert out[2]["kept_text"] == "genuine \ufffd here and \ufffd there"
    assert out[2]["carried"]["doc_id"] == 2


def test_awkward(spark):
    out = suffixes.strip_repeats(awkward(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in TEXTS)
    by = {r["doc_id"]: r for r in out}
    assert bytes(by[2]["kept"]) == b"" and by[2]["n_removed"] == len(TEXTS[1][1]) and by[2]["n_spans"] == 1
    assert by[1]["n_removed"] == 0 and by[9]["n_removed"] == 0 and by[4]["n_bytes"] == 0
    assert bytes(by[None]["kept"]).decode() == "a text without an id, seen a@b.co"
    assert suffixes.strip_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 16])
def test_loser_tree_equals_sorting_and_gives_prefixes(runs):
    rng = random.Random(runs)
    sets = []
    for r in range(runs):
        own = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))), r, i, i) for i in range(rng.randint(0, 60)))
        sets.append(own)
    decoded = [suffixes.Run(suffixes.front_code(suffixes.packed(*zip(*x, strict=True), [0] * len(x))), k) for k, x in enumerate(sets) if x]
    assert [list(r) for r in decoded] == [[e[0] for e in x] for x in sets if x]
    out = list(suffixes.merge(decoded)) if decoded else []
    assert [x[1] for x in out] == sorted(e[0] for x in sets for e in x)
    before = b""
    for shared, s, _, _ in out:
        assert shared == suffixes.common_prefix(before, s)
        before = s
    assert Counter((r, i) for _, _, r, i in out) == Counter((k, i) for k, r in enumerate(decoded) for i in range(len(r.ids)))
