"""Pairs ruled out by single-precision products before they are made exactly."""

import numpy as np
import pytest

from vectrine.operators import hierarchy, search

METRICS = search.FAST | {"nearest": search.NEAREST, "ward": hierarchy.WARD}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("scale", [1.0, 1e4, 1e30])
def test_no_pair_that_reaches_its_bar_is_ruled_out(metric, scale):
    """Bars are scores of pairs themselves, which rounding to single precision could put on either side."""
    rng = np.random.default_rng(7)
    q, v = rng.normal(0, scale, (700, 9)), rng.normal(0, scale, (300, 9))
    if metric == "ward":
        q[:, 0], v[:, 0] = rng.integers(1, 50, 700), rng.integers(1, 50, 300)
    of = METRICS[metric]
    s = of(q, v)
    bar = np.sort(s, axis=1)[:, -5]
    a, b = search.may_reach(of, q, bar, v)
    may = np.zeros(s.shape, bool)
    may[a, b] = True
    assert may[s >= bar[:, None]].all()
    assert scale > 1e4 or may.sum() < 2 * (s >= bar[:, None]).sum()  # numbers too large for floats rule nothing out
    assert np.allclose(of.pairs(q[a], v[b]), s[a, b], rtol=1e-9, atol=1e-12 * scale * scale)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_later_blocks_are_not_compared_exactly(spark, monkeypatch, metric):
    """All scores of every pair of blocks were made in double precision; now only those of a query's first block are."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.knn(df, df, 4, metric).collect()}
    x = np.array([r[1] for r in rows])
    s = search.BLOCK_METRICS[metric](x, x)
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, r + 1): int(p) for i in range(240) for r, p in enumerate(np.argsort(-s[i], kind="stable")[:4])}
    made = []
    slow = search.Products(*[getattr(search.FAST[metric], f) for f in ("asks", "offers", "pairs")], lambda q, v: made.append(len(q) * len(v)) or search.BLOCK_METRICS[metric](q, v))
    out, blocks = [], [(np.arange(a, a + 60).astype("<i8"), x[a : a + 60]) for a in range(0, 240, 60)]
    bars = np.full(240, -np.inf)
    for ids, v in blocks:
        new = np.isneginf(bars)
        if new.any():
            out.append(search._over(slow(x[new], v), bars[new], 4, np.flatnonzero(new), np.arange(240), ids, True, None))
        else:
            a, b = search.may_reach(slow, x, bars - search.EQUAL, v)
            keep = a != ids[b]
            out.append((a[keep], ids[b[keep]], slow.pairs(x[a[keep]], v[b[keep]])))
        a, best, score = search._cut(*map(np.concatenate, zip(*out, strict=True)), 4)
        bars = score.reshape(240, 4)[:, 3]
    assert sum(made) == 240 * 60
    assert {(int(i), n % 4 + 1): int(p) for n, (i, p) in enumerate(zip(a, best, strict=True))} == got


def test_scores_equal_to_nine_digits_go_by_id():
    """The third best was 1e-10 better than one with a smaller id, which SQL puts first."""
    a, ids, s = search._cut(np.zeros(4, int), np.array([9, 8, 7, 1]), np.array([0.9, 0.8, 0.5 + 1e-10, 0.5]), 3)
    assert ids.tolist() == [9, 8, 1]
