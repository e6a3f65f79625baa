"""Like-minded users, found by blocks."""

import re

import numpy as np

from vectrine.operators import recommend


def rows_of(n_users, n_items, seed=3):
    rng = np.random.default_rng(seed)
    return [(u, i, float(rng.integers(0, 4))) for u in range(n_users) for i in range(n_items) if rng.random() < 0.4]


def test_peers_equal_a_plain_search(spark):
    """Few values make many ties, of which the smaller user counts."""
    rated = rows_of(60, 12)
    by = {}
    for u, i, s in rated:
        by.setdefault(u, {})[i] = s
    want = {}
    for u, own in by.items():
        alike = []
        for p, theirs in by.items():
            both = own.keys() & theirs.keys()
            if p != u and both:
                alike.append((-round(1 / (1 + np.sqrt(np.mean([(own[i] - theirs[i]) ** 2 for i in both]))), 9), p))
        brought = {}
        for s, p in sorted(alike)[:3]:
            for i, value in by[p].items():
                if i not in own:
                    brought[i] = max(brought.get(i, -1), -s * value)
        want[u] = [(i, round(s, 6)) for s, i in sorted((-round(s, 9), i) for i, s in brought.items())[:4] for s in (-s,)]
    got = {}
    found = recommend.collaborative(spark.createDataFrame(rated, "user_id long, item_id long, score double"), 3, 4)
    for r in sorted(found.collect(), key=lambda r: (r["user_id"], r["rank"])):
        got.setdefault(r["user_id"], []).append((r["item_id"], round(r["score"], 6)))
    assert got == {u: x for u, x in want.items() if x}


def test_no_pair_of_users_is_a_row(spark):
    found = recommend.collaborative(spark.createDataFrame(rows_of(20, 5), "user_id long, item_id long, score double"))
    assert not re.search(r"Join \[item_id#\d+L?\], \[item_id", found._jdf.queryExecution().toString())


def test_common_ratings_are_compared_in_parts(monkeypatch):
    """Blocks with more ratings in common than are compared at once, down to one rating that has more by itself."""
    rng = np.random.default_rng(5)
    some = 4, np.array([0, 1, 2, 3, 0]), np.array([1, 1, 1, 2, 3]), rng.random(5)
    others = 3, np.array([0, 1, 2, 0]), np.array([1, 1, 1, 3]), rng.random(4)
    whole = recommend._alikeness(some, others)
    monkeypatch.setattr(recommend, "AT_ONCE", 2)
    assert np.array_equal(recommend._alikeness(some, others), whole)
    assert np.isneginf(whole[3]).all() and np.isfinite(whole[:3]).all()
