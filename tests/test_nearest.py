import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemesh.functions import kdtree
from tidemesh.operators import spatial


def _brute(q, p, k, exclude_self, reach):
    """Rows (group, query, point, rank) of arrays (group, id, x, y, z)."""
    out = []
    for g, i, *at in q:
        own = p[p[:, 0] == g]
        d = own[:, 2:] - np.array(at)
        d = d * d
        d = d[:, 0] + d[:, 1] + d[:, 2]
        keep = [j for j in np.lexsort((own[:, 1], d)) if not (exclude_self and own[j, 1] == i) and (reach is None or d[j] <= reach * reach)]
        out += [(int(g), int(i), int(own[j, 1]), r + 1) for r, j in enumerate(keep[:k])]
    return sorted(out)


def _table(spark, rows_, name):
    return spark.createDataFrame([(int(g), int(i), *map(float, v)) for g, i, *v in rows_], f"g long, {name} long, x double, y double, z double")


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_POINTS", 40)
    monkeypatch.setattr(spatial, "LEAF_QUERIES", 50)


def _uneven(seed=1):
    rng = np.random.default_rng(seed)
    p = np.c_[rng.integers(0, 3, 700), np.arange(700), np.round(rng.normal(0, 5, (700, 3)), 1)]
    p[:60, 2:] = 1.0  # one place
    p[60:200, 2:] += 300.0  # far from the rest
    q = np.c_[rng.integers(0, 4, 150), np.arange(150), np.round(rng.normal(0, 9, (150, 3)), 1)]
    q[:40, 2:] += 150.0
    return q, p


@pytest.mark.parametrize("k, exclude_self, reach", [(1, False, None), (5, True, None), (2, True, 20.0)])
def test_leaves_give_what_brute_force_gives(spark, small_leaves, k, exclude_self, reach):
    q, p = _uneven()
    got = rows(spatial.knn(_table(spark, q, "q"), _table(spark, p, "p"), k, "q", "p", ["g"], exclude_self, reach), "g", "q", "p", "rank")
    assert got == _brute(q, p, k, exclude_self, reach)


def test_far_queries_are_sent_to_few_leaves(spark, small_leaves):
    side = np.stack(np.meshgrid(np.arange(40), np.arange(40)), -1).reshape(-1, 2)
    p = np.c_[np.zeros(1600), np.arange(1600), side, np.zeros(1600)]
    q = p.copy()
    q[:, 2:] += [0.45, 0.4, 7.0]
    a, b = spatial._sides(_table(spark, q, "q"), _table(spark, p, "p"), "q", "p", ["g"], False)
    top, rest = spatial._neighbours(a, b, 1, ["g"], False, None)
    assert top.count() == 1600 and rest is not None
    assert top.agg(F.sum(F.size("_ask"))).first()[0] < 4 * 1600
    assert rows(spatial._rows(top, rest, ["g"]).select("_q", "_p")) == [(i, i) for i in range(1600)]


def test_leaves_tile_space():
    rng = np.random.default_rng(2)
    xyz, groups = rng.uniform(0, 9, (900, 3)), rng.integers(-2, 2, 900)
    xyz[:300] = 4.0
    leaves = kdtree.Leaves(groups, xyz, 20)
    of = leaves.of(groups, xyz)
    assert (leaves.low[of] <= xyz).all() and (xyz < leaves.high[of]).all()
    assert (leaves.names[leaves.tree[of]] == groups).all()
    assert leaves.of(np.array([7]), xyz[:1]).tolist() == [-1]


def test_mutual_distances_over_leaves(spark, small_leaves):
    from tidemesh.operators import filters

    q, p = _uneven()
    forth = {x[:2]: x[2] for x in _brute(q, p, 1, False, 60.0)}
    back = {x[:2]: x[2] for x in _brute(p, q, 1, False, 60.0)}
    want = sorted((int(g), int(i), j if (j := forth.get((g, i))) is not None and back.get((g, j)) == i else -1) for g, i in q[:, :2])
    got = filters.c2c(_table(spark, q, "source_id"), _table(spark, p, "target_id"), max_distance=60.0, both_ways=True, by=["g"])
    assert rows(got.select("g", "source_id", F.coalesce("target_id", F.lit(-1)))) == want
    assert any(j >= 0 for *_, j in want)


def test_mutual_distances_join_once(spark, small_leaves):
    from tidemesh.operators import filters

    q, p = _uneven()
    got = filters.c2c(_table(spark, q, "source_id"), _table(spark, p, "target_id"), max_distance=60.0, both_ways=True, by=["g"])
    assert got.columns == ["g", "source_id", "target_id", "distance"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1  # forth and back, each once
    assert rows(got.groupBy().agg(F.count("*"), F.sum((F.col("target_id").isNull() != F.col("distance").isNull()).cast("int")))) == [(150, 0)]


def test_outliers_over_leaves(spark, small_leaves):
    from tidemesh.operators import filters

    _, p = _uneven()
    place = {int(i): v for _, i, *v in p}
    far = {}
    for g, i, j, _ in _brute(p, p, 6, True, None):
        far.setdefault((g, i), []).append(np.linalg.norm(np.subtract(place[i], place[j])))
    mean = {key: np.mean(v) for key, v in far.items()}
    limit = {g: np.mean(v := [m for (h, _), m in mean.items() if h == g]) + np.std(v) for g in range(3)}
    got = filters.sor(_table(spark, p, "point_id"), 6, 1.0, by=["g"])
    assert [(g, i, o) for g, i, o in rows(got.select("g", "point_id", "outlier"))] == sorted((g, i, bool(m > limit[g])) for (g, i), m in mean.items())
    assert all(abs(m - mean[g, i]) < 1e-9 for g, i, m in rows(got.select("g", "point_id", "mean_distance")))
    assert not hasattr(filters, "knn")  # one number a point is kept, not its neighbours


@pytest.mark.parametrize("sliced, sent", [(False, 1), (True, 2)])
def test_points_are_sent_once_to_their_own_search(spark, monkeypatch, sliced, sent):
    monkeypatch.setattr(spatial, "LEAF_POINTS", 40)
    if sliced:
        monkeypatch.setattr(spatial, "LEAF_QUERIES", 20)
    _, p = _uneven()
    calls, placed, boxes = [], spatial._placed, spatial._boxes
    monkeypatch.setattr(spatial, "_boxes", lambda *a: (boxes(*a), calls.clear())[0])
    monkeypatch.setattr(spatial, "_placed", lambda *a: (calls.append(1), placed(*a))[1])
    monkeypatch.setattr(spatial, "materialise", lambda df, make=spatial.materialise: (make(df), calls.append(None))[0])
    got = rows(spatial.mean_distance(_table(spark, p, "point_id"), 6, "point_id", ["g"]), "g", "point_id", "mean_distance")
    assert calls[: calls.index(None)].count(1) == sent
    place = {int(i): v for _, i, *v in p}
    far = {}
    for g, i, j, _ in _brute(p, p, 6, True, None):
        far.setdefault((g, i), []).append(np.linalg.norm(np.subtract(place[i], place[j])))
    assert [x[:2] for x in got] == sorted(far) and all(abs(m - np.mean(far[g, i])) < 1e-9 for g, i, m in got)


def _surface(spark):
    i = np.arange(900)
    x, y = i % 30, i // 30
    return spark.createDataFrame([(int(k), float(a), float(b), float(np.sin(a / 3) + np.cos(b / 4)), float(-np.cos(a / 3) / 3), float(np.sin(b / 4) / 4), 1.0) for k, a, b in zip(i, x, y)], "point_id long, x double, y double, z double, nx double, ny double, nz double")


def _motion(spark, monkeypatch, fit):
    from tidemesh.operators import registration

    gone = []
    monkeypatch.setattr(registration, "discard", lambda *t: gone.extend(t), raising=False)
    ref = _surface(spark)
    moved = registration.transform(ref, registration.Transformation.of([[1, 0, 0, 0.04], [0, 1, 0, -0.03], [0, 0, 1, 0.05]]))
    t = getattr(registration, fit)(ref, moved, 3, 1e-9).array()
    assert gone  # pairs of finished rounds are deleted
    return t


def test_icp_over_leaves(spark, small_leaves, monkeypatch):
    assert np.allclose(_motion(spark, monkeypatch, "icp")[:3], [[1, 0, 0, -0.04], [0, 1, 0, 0.03], [0, 0, 1, -0.05]], atol=1e-6)


def test_plane_gaps_over_leaves(spark, small_leaves):
    from tidemesh.operators import registration

    ref = _surface(spark)
    q = ref.select(F.col("point_id").alias("q"), *[(F.col(a) + 0.1 * F.col(f"n{a}")).alias(a) for a in "xyz"])
    got = rows(registration.plane_gap(q, "q", ref, "point_id"))
    assert [i for i, *_ in got] == list(range(900))
    length = {i: 0.1 * v for i, v in rows(ref.select("point_id", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + 1.0)))}
    assert all(abs(gap - length[i]) < 1e-9 and abs(d - length[i]) < 1e-9 for i, gap, d in got)


def test_plane_gaps_come_with_the_search(spark, small_leaves):
    from tidemesh.operators import registration

    ref = _surface(spark)
    q = ref.select(F.col("point_id").alias("q"), "x", "y", (F.col("z") + 0.1).alias("z"))
    once = registration.plane_gap(q, "q", ref, "point_id")
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()
    twice = registration.plane_gap(q.unionByName(q), "q", ref.unionByName(ref), "point_id")
    assert rows(twice) == rows(once) and once.count() == 900  # repeated rows count once


def test_plane_icp_over_leaves(spark, small_leaves, monkeypatch):
    t = _motion(spark, monkeypatch, "plane_icp")
    assert np.allclose(t[:3], [[1, 0, 0, -0.04], [0, 1, 0, 0.03], [0, 0, 1, -0.05]], atol=1e-2)


@pytest.mark.parametrize("fit", ["icp", "plane_icp"])
def test_icp_searches_its_reference_without_joins(spark, small_leaves, monkeypatch, fit):
    from tidemesh.operators import registration

    plans, boxed, boxes = [], [], spatial._boxes
    monkeypatch.setattr(spatial, "_boxes", lambda *a: (boxed.append(1), boxes(*a))[1])
    monkeypatch.setattr(registration, "materialise", lambda df, make=registration.materialise: (plans.append(df._jdf.queryExecution().executedPlan().toString()), make(df))[1])
    _motion(spark, monkeypatch, fit)
    assert len(plans) == 5 and not any("Join" in p for p in plans)  # two clouds, three rounds
    assert len(boxed) == 1  # the reference stays as it is


@pytest.mark.parametrize("k, reach", [(1, None), (3, 20.0)])
def test_columns_come_along(spark, small_leaves, k, reach):
    q, p = _uneven()
    points = _table(spark, p, "p").withColumn("more", F.when(F.col("p") % 5 > 0, F.col("p") * 2))
    got = rows(spatial.knn(_table(spark, q, "q"), points, k, "q", "p", ["g"], False, reach, carry=["x", "z", "more"]))
    own, other = ({(int(g), int(i)): v for g, i, *v in side.tolist()} for side in (q, p))
    assert sorted((g, i, j, r) for g, i, j, _, r, *_ in got) == _brute(q, p, k, False, reach)
    for g, i, j, _, _, qx, qy, qz, x, z, more in got:
        assert [qx, qy, qz] == own[g, i] and [x, z] == other[g, j][::2] and more == (j * 2 if j % 5 else None)


def test_groups_may_have_any_name(spark, small_leaves):
    q, p = _uneven()
    a, b = (_table(spark, t, n).withColumn("_g", F.col("g").cast("int")).drop("g") for t, n in ((q, "q"), (p, "p")))
    assert rows(spatial.knn(a, b, 2, "q", "p", ["_g"]), "_g", "q", "p", "rank") == _brute(q, p, 2, False, None)
