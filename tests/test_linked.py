"""Buckets of an online batch: what is linked stays together."""

import datetime as dt

import numpy as np

from vectrine.streaming import online


def test_linked_items_along_a_chain(spark):
    """A chain of forty items, each two of which have one user in common, and two items apart."""
    rows = [(u, i) for u in range(39) for i in (u, u + 1)] + [(100, 50), (100, 51), (101, 60)]
    found = {r["item_id"]: r["linked"] for r in online.linked_items(spark.createDataFrame(rows, "user_id long, item_id long")).collect()}
    assert found == {**{i: 0 for i in range(40)}, 50: 50, 51: 50, 60: 60}


def test_a_batch_of_linked_items_is_one_wave(spark, monkeypatch):
    """Hand-overs between buckets took a wave for each step along the chain of users."""
    rng = np.random.default_rng(1)
    day = dt.datetime(2024, 1, 1)
    rows = [(n, day + dt.timedelta(minutes=n), int(rng.integers(6)), int(rng.integers(8)), 1.0) for n in range(300)]
    actions = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, item_id long, score double")
    start = lambda n: spark.range(n).selectExpr("id as key", "array(0.1D, 0.2D) as vector")
    waves, before = [], online.written
    monkeypatch.setattr(online, "written", lambda df, tag, *a: (waves.append(tag), before(df, tag, *a))[1])
    assert online.two_sided(actions, start(6), start(8), per_bucket=50).count() == 14
    assert waves.count("wave") == 1
