import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemesh.llm import neighbours as N

NAN = float("nan")


def vectors(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")


def test_unusable_vectors_and_copies_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [1.0], "b"), (3, None, "c"), (4, [NAN, 1.0], "d"), (5, [None, 1.0], "e"), (None, [1.0, 1.0], "f"), (6, [], "g")], "s long, vec array<double>, v string")
    assert rows(N.usable_vectors(df, "s", F.col("vec"), 2)) == [(1, [1.0, 2.0])]


def test_graph_finds_nearly_all_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (25, 12))
    v = np.concatenate([centres[i % 25] + rng.normal(0, 0.1, 12) for i in range(900)]).reshape(900, 12)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    true = {(min(i, j), max(i, j)) for i in range(900) for j in np.argsort(d[i], kind="stable")[:5]}
    g = N.neighbour_graph(vectors(spark, v), k=10, trees=2, leaf=40, sample_rows=300).cache()
    found = {tuple(r) for r in rows(N.near_pairs(g, 5, 10.0), "a", "b")}
    assert len(found & true) >= 0.97 * len(true) and len(found - true) <= 0.03 * len(true)
    near = {r.id: r.near for r in g.collect()}
    assert len(near) == 900 and all(abs(e.d - d[i, e.id]) < 1e-9 for i, l in near.items() for e in l)
    asked = vectors(spark, v).filter("id % 20 = 0")
    got = rows(N.search(g, vectors(spark, v), asked, k=5, leaf=60, sample_rows=300), "query_id", "id")
    np.fill_diagonal(d, 0)
    want = {(i, j) for i in range(0, 900, 20) for j in np.argsort(d[i], kind="stable")[:5]}
    assert len(set(got) & want) >= 0.9 * len(want)


def test_copies_tiny_and_empty_collections(spark):
    same = vectors(spark, [[1.0, 1.0]] * 30)
    g = N.neighbour_graph(same, k=3, trees=1, leaf=10, sample_rows=10)
    assert all(len(r.near) == 3 and all(e.d == 0 for e in r.near) for r in g.collect()) and g.count() == 30
    assert rows(N.neighbour_graph(same.limit(1), k=3)) == [(0, [])] or N.neighbour_graph(same.limit(1), k=3).count() == 1
    assert rows(N.neighbour_graph(same.limit(0), k=3)) == []
    assert rows(N.search(g, same, same.limit(0))) == [] and rows(N.search(g.limit(0), same.limit(0), same)) == []
    two = N.neighbour_graph(vectors(spark, [[0.0, 0.0], [3.0, 4.0]]), k=3)
    assert rows(N.near_pairs(two, 5, 5.0)) == [(0, 1, 5.0)] and rows(N.near_pairs(two, 5, 4.9)) == []
