"""The jobs on copies: runs over growing input, repeated runs, replaced days, awkward rows, the command line."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import knowledge_base, queries, recommendations
from jobs.common import configuration, watched
from tests.test_oracle import TABLES, norm
from vectrine.functions import embed
from vectrine.operators import chunking

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCUMENTS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_job_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = norm(got.columns, got.collect()), norm(columns, want.fetchall())
    assert len(a) == len(b) > 0
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def base(spark, tmp_path):
    """The folders of a knowledge base and a function that runs it."""
    at = {k: f"file://{tmp_path}/{k}" for k in ("documents", "target", "checkpoint")}
    return at, lambda: knowledge_base.run(spark, at["documents"], at["target"], at["checkpoint"])


def held(spark, at):
    rows = knowledge_base.current(spark, at["target"]).select("doc_id", "chunk_index", "content", "lang").collect()
    return {(r["doc_id"], r["chunk_index"], r["content"], r["lang"]) for r in rows}


def test_knowledge_base_takes_only_what_is_new(spark, base):
    at, run = base
    long = "A sentence of some words. " * 40
    add(spark, at["documents"], [(1, "First  text.", "en", "web"), (2, long, "de", "web"), (3, None, "en", "x"), (4, " \n ", "en", "x"), (None, "no id", "en", "x")])
    first = run()
    assert (first["documents"], first["entries"], first["errors"]) == (5, 2, 0)
    chunks = chunking.fixed_size(long.strip(), 200, 50)
    assert held(spark, at) == {(1, 0, "First text.", "en")} | {(2, k, c, "de") for k, c in enumerate(chunks)}
    assert run() == {"batches": 0, "documents": 0, "entries": 0, "chunks": 0, "errors": 0}
    before = held(spark, at)
    # 1 comes again as it was, 2 with another text, 5 twice, 6 without a language
    add(spark, at["documents"], [(1, "First text.", "en", "web"), (2, "Short now.", "de", "web"), (5, "b", "", "x"), (5, "b", "", "x"), (6, "c", None, None)])
    second = run()
    assert (second["documents"], second["entries"], second["chunks"]) == (5, 3, 3)
    assert held(spark, at) == {x for x in before if x[0] == 1} | {(2, 0, "Short now.", "de"), (5, 0, "b", None), (6, 0, "c", None)}


def test_a_repeated_batch_changes_nothing(spark, base):
    at, run = base
    add(spark, at["documents"], [(1, "one", "en", "a"), (2, "two", "en", "a")])
    run()
    add(spark, at["documents"], [(2, "two, changed", "en", "a"), (3, "three", "fr", "a")])
    run()
    before = held(spark, at)
    batch = spark.createDataFrame([(2, "two, changed", "en", "a"), (3, "three", "fr", "a")], DOCUMENTS)
    assert knowledge_base.take(batch, 1, at["target"], knowledge_base.DEFAULTS)["entries"] == 2
    assert held(spark, at) == before
    shutil.rmtree(at["checkpoint"].removeprefix("file://"))  # a lost checkpoint: everything is read again, nothing doubles
    run()
    assert held(spark, at) == before


def test_vectors_of_chunks(spark, base):
    at, run = base
    add(spark, at["documents"], [(1, "red green blue red", "en", "a"), (2, "...", "en", "a")])
    run()
    got = {r["content"]: r["embedding"] for r in knowledge_base.current(spark, at["target"]).collect()}
    for text, vector in got.items():
        assert vector == pytest.approx(list(embed.vectors_of([text], 64)[0]), abs=5e-5)
    assert set(got["..."]) == {0.0}


def test_an_empty_folder_and_an_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "documents")
    assert knowledge_base.run(spark, f"{tmp_path}/documents", f"{tmp_path}/target", f"{tmp_path}/checkpoint")["batches"] == 0
    assert knowledge_base.current(spark, f"{tmp_path}/target").collect() == []
    add(spark, f"{tmp_path}/documents", [])
    assert knowledge_base.run(spark, f"{tmp_path}/documents", f"{tmp_path}/target", f"{tmp_path}/checkpoint")["entries"] == 0


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    return spark.createDataFrame([(n, t, u, k, v, p) for n, (t, u, k, v, p) in enumerate(rows)], EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture
def shop(spark, tmp_path):
    log = [("2024-01-01 10:00:00", 1, "view", 3.0, '{"k": 0}'), ("2024-01-01 11:00:00", 2, "click", 3.0, '{"k": 0}'), ("2024-01-01 12:00:00", 2, "view", 5.0, '{"k": 1}'), ("2024-01-02 09:00:00", 1, "purchase", 1.0, '{"k": 2}'), ("2024-01-02 10:00:00", None, "view", 1.0, '{"k": 2}'), ("2024-01-02 10:00:00", 3, "view", 1.0, None)]
    paths = {k: f"{tmp_path}/{k}" for k in ("events", "items", "users", "target")}
    events(spark, log).write.parquet(paths["events"])
    spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>").write.parquet(paths["items"])
    spark.createDataFrame([(1,), (9,), (None,)], "c_custkey int").write.parquet(paths["users"])
    return paths


def days(spark, paths):
    return {(str(r["as_of"]), r["user_id"], r["item_id"], r["rank"], r["reason"], r["score"]) for r in recommendations.made(spark, paths["target"]).collect()}


def test_days_are_made_again_apart_from_each_other(spark, shop):
    make = lambda day=None: recommendations.run(spark, shop["events"], shop["items"], shop["users"], shop["target"], day)
    assert make("2024-01-01")["actions"] == 3
    first = days(spark, shop)
    assert {x[0] for x in first} == {"2024-01-01"} and {x[1] for x in first} == {1, 2, 9}
    assert all(x[4] == "popular" for x in first if x[1] == 9) and all("history" in x[4] for x in first if x[1] != 9)
    assert not {(1, 0), (2, 0), (2, 1)} & {x[1:3] for x in first}
    assert make()["as_of"] == "2024-01-02"
    both = days(spark, shop)
    assert first < both and {x[0] for x in both - first} == {"2024-01-02"}
    make("2024-01-01")
    make("2024-01-02")
    assert days(spark, shop) == both


def test_no_actions(spark, shop, tmp_path):
    events(spark, []).write.parquet(f"{tmp_path}/none")
    assert recommendations.run(spark, f"{tmp_path}/none", shop["items"], shop["users"], shop["target"])["rows"] == 0
    assert recommendations.run(spark, shop["events"], shop["items"], shop["users"], shop["target"], "2023-12-31")["rows"] == 0


def test_settings_and_paths(tmp_path):
    (tmp_path / "c.json").write_text('{"overlap": 10}')
    assert configuration(str(tmp_path / "c.json"), {"overlap": 50, "size": 1}) == {"overlap": 10, "size": 1}
    (tmp_path / "c.json").write_text('{"overlaps": 10}')
    with pytest.raises(ValueError, match="overlaps"):
        configuration(str(tmp_path / "c.json"), {"overlap": 50})
    assert watched("/a/b.parquet/") == "/a/b.parque[t]" and watched("/a/*.parquet") == "/a/*.parquet"


def test_configuration_files_name_known_settings():
    for job in (knowledge_base, recommendations):
        name = job.__name__.split(".")[1]
        assert configuration(f"{ROOT}/jobs/{name}.json", job.DEFAULTS) == job.DEFAULTS


def test_the_command_line_runs_twice(spark, tmp_path, sf):
    add(spark, f"{tmp_path}/in", [(1, "one. two.", "en", "a")])
    call = [sys.executable, "-m", "jobs.knowledge_base", "--documents", f"{tmp_path}/in", "--target", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/ck", "--config", "jobs/knowledge_base.json"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    for k in range(2):
        done = subprocess.run(call, cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
        assert done.returncode == 0, done.stderr[-2000:]
        assert json.dumps(k == 0) == json.dumps("wrote 1 entries" in done.stderr)
    assert held(spark, {"target": f"{tmp_path}/out"}) == {(1, 0, "one. two.", "en")}
