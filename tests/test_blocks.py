"""Blocks of vectors that meet: how they are dealt, and that the driver sees none of them."""

import numpy as np
import pyarrow as pa
import pytest

from vectrine import catalog
from vectrine.operators import hierarchy, learn, projection, search
from vectrine.session import table


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def test_blocks_are_never_broadcast(vectors):
    """Blocks copied for each group are far larger than the file they come from, so Spark's own judgement of the table's
    size sent them through the driver."""
    some, others = vectors.where("vec_id % 2 = 0"), vectors.where("vec_id % 2 = 1")
    plans = [search.similar_pairs(vectors, 0.4), search.pairwise_l2(vectors), search.pairs_between(some, others, 0.4), learn.within(vectors, 1.1), search.knn(some, vectors, 3), search.all_scores(some, vectors)]
    for df in plans:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()


def test_grid_of_blocks(vectors):
    """A grid has about the cells asked for; many results a query keep the groups of vectors few."""
    blocks = search.packed(vectors, "vec_id", "embedding")
    few = search.packed(vectors.where("vec_id = 0"), "vec_id", "embedding")
    assert search._grid(few, blocks, 40)[0] < 10 < search._grid(few, blocks, 40)[1]
    even, wide = search._grid(blocks, blocks, 64, 1), search._grid(blocks, blocks, 64, 500)
    assert even[0] * even[1] >= 64 and wide[1] < even[1] and wide[0] * wide[1] >= 64


def test_matrix_cells_are_not_joined(spark, sf):
    """Three metrics of a cell were three tables, joined cell by cell."""
    found = catalog.queries()["vec_matrix_cells"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("Join ") == 1


def test_few_blocks_are_not_copied_for_many_groups(spark):
    """Two hundred cells for one block on each side would copy every vector up to two hundred times."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>").coalesce(1)
    blocks = search.packed(df, "vec_id", "embedding")
    rows, columns = search._grid(blocks, blocks, 200, 90)
    assert rows <= 2 and columns <= 2


def test_a_chain_joins_as_the_nearest_pairs_do():
    rng = np.random.default_rng(3)
    x, size = rng.normal(0, 1, (90, 6)), rng.integers(1, 5, 90)
    plain, chain = hierarchy.joins_of(x, size), hierarchy.chain_joins(x, size)
    assert [r[:2] for r in chain] == [r[:2] for r in plain] and np.allclose([r[2] for r in chain], [r[2] for r in plain])
    assert hierarchy.chain_joins(x[:1], size[:1]) == []


def test_copies_are_joined_without_rounds(spark, monkeypatch):
    """Forty copies took a round of searches each, as only two of them can be each other's nearest."""
    rounds, knn = [], search.knn
    monkeypatch.setattr(search, "knn", lambda *a, **k: rounds.append(1) or knn(*a, **k))
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(40, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in hierarchy.ward(df, 2, last=1).collect()}
    assert len(rounds) <= 2 and {got[i] for i in range(40)} == {0} and got[40] == 1


def test_vectors_become_a_matrix_without_python_numbers():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]).slice(1)
    assert search.matrix(column).tolist() == [[3, 4], [5, 6]]
    x, centres = np.array([[0.0], [1.0], [9.0]]), np.array([[0.0], [10.0]])
    assert learn._lloyd(x, search._squared(x, centres)).tolist() == [2, 1, 1, 9, 2]


def test_a_part_of_the_map_is_one_row():
    """What other parts read of a part are the first bytes of it."""
    blob = projection._point_blob([np.array([3, 8]), np.array([0.5, 1.5]), np.array([2.0, 4.0])])
    for data, each in ((blob, projection.POINT), (blob[: 2 * projection.FAR], projection.FAR)):
        ids, y = projection._places(data, each)
        assert ids.tolist() == [3, 8] and y.tolist() == [[0.5, 2.0], [1.5, 4.0]]
