"""Operators of the change analysis against literal fixtures and numpy."""

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemesh.functions import linalg
from tidemesh.operators import filters, m3c2, m3c2ep, octree, planes, registration, spatial, voxel

NAN = float("nan")


def cloud(spark, xyz, name="point_id", **more):
    return spark.createDataFrame([(i, *map(float, p), *[v[i] for v in more.values()]) for i, p in enumerate(np.asarray(xyz, float))], f"{name} long, x double, y double, z double" + "".join(f", {k} {'double' if isinstance(v[0], float) else 'long'}" for k, v in more.items()))


def test_eigenvalues_and_normals_equal_lapack(spark):
    rng = np.random.default_rng(0)
    m = [a @ a.T for a in rng.normal(size=(60, 3, 3))] + [np.eye(3), np.diag([4.0, 1.0, 0.0]), np.zeros((3, 3))]
    df = spark.createDataFrame([(i, *[float(a[k]) for k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]) for i, a in enumerate(m)], "id long, c_xx double, c_xy double, c_xz double, c_yy double, c_yz double, c_zz double")
    got = rows(linalg.with_normal(linalg.with_eigenvalues(df, "c"), "c", F.col("l3"), (0.0, 0.0, 1.0)), "id", "l1", "l2", "l3", "nx", "ny", "nz")
    for i, *v in got:
        w, e = np.linalg.eigh(m[i])
        assert v[:3] == pytest.approx(w[::-1], abs=1e-12 + 1e-12 * w.max())
        if i < 60:
            assert abs(np.dot(v[3:], e[:, 0])) == pytest.approx(1, abs=1e-6) and v[5] >= 0
    assert got[60][4] is None and got[62][4] is None


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.floats(0.2, 2.0))
def test_grid_joins_equal_brute_force(spark, seed, r):
    rng = np.random.default_rng(seed)
    q, p = rng.uniform(-4, 4, (15, 3)), rng.uniform(-4, 4, (120, 3))
    n = rng.normal(size=(15, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    qd = cloud(spark, q, "q", nx=n[:, 0].tolist(), ny=n[:, 1].tolist(), nz=n[:, 2].tolist())
    pd_ = cloud(spark, p, "p")
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    assert rows(spatial.radius_join(qd, pd_, r, "q", "p"), "_q", "p") == sorted(zip(*map(list, np.nonzero(d < r * r))))
    along = ((p[None] - q[:, None]) * n[:, None]).sum(-1)
    want = (d - along**2 <= r * r) & (np.abs(along) < max(3.0, r))
    assert rows(spatial.cylinder_join(qd, pd_, r, 3.0, "q", "p"), "_q", "p") == sorted(zip(*map(list, np.nonzero(want))))
    order = np.lexsort((np.broadcast_to(np.arange(120), d.shape), d))[:, :4]
    assert [(a, b) for a, _, b in rows(spatial.knn(qd, pd_, 4, "q", "p"), "q", "rank", "p")] == [(i, j) for i in range(15) for j in order[i]]


def test_radius_bound_is_open_or_closed_and_unusable_rows_are_out(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, NAN, 0.0, 0.0)], "q long, x double, y double, z double")
    p = spark.createDataFrame([(5, 1.0, 0.0, 0.0), (6, None, 0.0, 0.0), (5, 1.0, 0.0, 0.0)], "p long, x double, y double, z double")
    assert rows(spatial.radius_join(q, p, 1.0, "q", "p")) == []
    assert rows(spatial.radius_join(q, p, 1.0, "q", "p", strict=False), "_q", "p") == [(1, 5)]
    assert rows(spatial.knn(q, p, 3, "q", "p"), "q", "p", "rank") == [(1, 5, 1)]
    assert rows(spatial.knn(q, p.limit(0), 3, "q", "p")) == []
    assert rows(spatial.nearest(q, p, "q", "p", max_distance=0.5)) == [(1, None, None)]


def test_knn_many_copies_at_one_place(spark):
    p = cloud(spark, [[0, 0, 0]] * 40 + [[5, 0, 0]])
    got = rows(spatial.knn(p, p.withColumnRenamed("point_id", "o"), 2, "point_id", "o", exclude_self=True), "point_id", "o", "d2")
    assert got[:4] == [(0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 2, 0.0)] and got[-2:] == [(40, 0, 25.0), (40, 1, 25.0)]


def test_cylinder_on_a_unit_grid_has_23_points(spark):
    g = [[i, j, 0] for i in range(21) for j in range(21)]
    s = 0.5**0.5
    q = cloud(spark, [[10, 10, 0]], "q", nx=[s], ny=[s], nz=[0.0])
    assert spatial.cylinder_join(q, cloud(spark, g), 1.0, 5.0, "q", "point_id").count() == 23


FIVE = [[0.1, 0.1, 0.1], [0.9, 0.2, 0.1], [1.1, 0.1, 0.1], [1.9, 0.1, 0.1], [0.1, 1.1, 0.1]]


def test_voxel_counts_centroids_delta_and_masks(spark):
    c = cloud(spark, FIVE)
    assert rows(voxel.features(c, 1.0, ["count", "density"])) == [(0, 0, 0, 2, 2.0), (0, 1, 0, 1, 1.0), (1, 0, 0, 2, 2.0)]
    got = {r[:3]: r[3:] for r in rows(voxel.features(c, 1.0, ["centroid"]))}
    assert got[0, 0, 0] == pytest.approx((0.5, 0.15, 0.1)) and got[1, 0, 0] == pytest.approx((1.5, 0.1, 0.1)) and got[0, 1, 0] == pytest.approx((0.1, 1.1, 0.1))
    d = cloud(spark, [[1.1, 0.1, 0.1], [2.1, 0.1, 0.1]])
    assert rows(voxel.delta(c, d, 1.0), "vx", "vy", "vz", "change_type") == [(0, 0, 0, 1), (0, 1, 0, 1), (1, 0, 0, 3), (2, 0, 0, 2)]
    assert rows(voxel.select_by_mask(c, d, 1.0), "point_id") == [(2,), (3,)]
    assert rows(voxel.select_by_mask(c, d, 1.0, False), "point_id") == [(0,), (1,), (4,)]
    assert voxel.select_by_mask(c, cloud(spark, [[50, 0, 0]]), 1.0, False).count() == 5  # without overlap all stay
    assert rows(voxel.features(c, 1.0, ["closest_to_center"]), "near_center_point_id") == [(1,), (2,), (4,)]
    with pytest.raises(ValueError):
        voxel.features(c, 1.0, ["colour"])


def test_voxel_change_of_equal_and_of_separate_clouds(spark):
    rng = np.random.default_rng(1)
    a = cloud(spark, rng.uniform(0, 1, (30, 3)))
    assert rows(voxel.mahalanobis(a, a, 1.0), "mahalanobis", "significance", "changed") == [(0.0, 0, 0)]
    b = cloud(spark, rng.uniform(5, 6, (30, 3)))
    assert rows(voxel.mahalanobis(a, b, 1.0), "change_type", "mahalanobis", "changed") == [(1, None, 1), (2, None, 1)]
    t = spark.createDataFrame([(7.814727903251179,), (0.024297585815692576,)], "d double").select(voxel.chi2_3_tail(F.col("d")).alias("p"))
    assert [r[0] for r in rows(t)] == pytest.approx([0.05, 0.999], abs=1e-9)


def test_c2c_literal(spark):
    s, t = cloud(spark, [[0, 0, 0], [2, 0, 0]], "source_id"), cloud(spark, [[1, 0, 0], [4, 0, 0]], "target_id")
    assert [r[2] for r in rows(filters.c2c(s, t))] == [1.0, 1.0]
    s, t = cloud(spark, [[0, 0, 0], [0.2, 0, 0]], "source_id"), cloud(spark, [[0.05, 0, 0]], "target_id")
    assert [(r[0], r[2]) for r in rows(filters.c2c(s, t, both_ways=True), "source_id", "target_id", "distance")] == [(0, pytest.approx(0.05)), (1, None)]
    assert [r[2] for r in rows(filters.c2c(s, t.limit(0)))] == [None, None]


def test_sor_literal(spark):
    x = np.array([0.0, 1, 2, 10])
    for k in (1, 2):
        d = np.abs(x[:, None] - x[None])
        m = np.sort(d, 1)[:, 1 : k + 1].mean(1)
        got = rows(filters.sor(cloud(spark, np.c_[x, x * 0, x * 0]), k, 1.0))
        assert [r[1] for r in got] == pytest.approx(m.tolist()) and [r[2] for r in got] == (m > m.mean() + m.std()).tolist()
    assert rows(filters.sor(cloud(spark, [[1, 1, 1]]), 3)) == [(0, 0.0, False)]
    with pytest.raises(ValueError):
        filters.sor(cloud(spark, FIVE), 0)


def test_scor_closed_form(spark):
    def at(r, az, el):
        a, e = np.radians(az), np.radians(el)
        return [r * np.cos(e) * np.cos(a), r * np.cos(e) * np.sin(a), r * np.sin(e)]

    p = np.array([at(10, 0, 0), at(10, 1, 0), at(10, 0, 1), at(30, 40, 0)])
    got = [r[1] for r in rows(filters.scor(cloud(spark, p), (0.0, 0.0, 0.0), 1.0))]
    seen = np.mean([np.linalg.norm(p[0] - p[1]), np.linalg.norm(p[0] - p[2])])
    assert got[0] == pytest.approx(min(1, 10 * np.tan(np.radians(1)) / seen)) and got[3] == pytest.approx(30 * np.tan(np.radians(1)) / 99999)
    for bad in ((0.0, 0.5), (1.0, 0.3), (1.0, 0)):
        with pytest.raises(ValueError):
            filters.scor(cloud(spark, p), (0.0, 0.0, 0.0), *bad)


def core(spark, xyz, normal=(0.0, 0.0, 1.0)):
    n = len(xyz)
    return cloud(spark, xyz, "corepoint_id", nx=[normal[0]] * n, ny=[normal[1]] * n, nz=[normal[2]] * n)


def test_m3c2_mean_median_and_empty_sides(spark):
    rng = np.random.default_rng(2)
    a = np.c_[rng.uniform(-1, 1, (80, 2)), rng.normal(0, 0.1, 80)]
    b = np.c_[rng.uniform(-1, 1, (62, 2)), rng.normal(0.5, 0.1, 62)]
    c = core(spark, [[0, 0, 0], [40, 0, 0]])
    za, zb = (v[np.hypot(v[:, 0], v[:, 1]) <= 0.8, 2] for v in (a, b))
    got = rows(m3c2.m3c2(c, cloud(spark, a), cloud(spark, b), 0.8, 3.0, 0.1))
    lod = 1.96 * (np.sqrt(za.var(ddof=1) / len(za) + zb.var(ddof=1) / len(zb)) + 0.1)
    assert got[0][1:] == pytest.approx((zb.mean() - za.mean(), lod, za.std(ddof=1), len(za), zb.std(ddof=1), len(zb)))
    assert got[1] == (1, None, None, None, 0, None, 0)
    got = rows(m3c2.m3c2(c, cloud(spark, a), cloud(spark, b), 0.8, 3.0, robust=True))

    def quartile(v, k):
        v, i = np.sort(v), k * len(v) // 4
        return (v[i] + v[i - 1]) / 2 if len(v) % 4 == 0 else v[i]

    assert got[0][1] == pytest.approx(np.median(zb) - np.median(za)) and got[0][3] == pytest.approx(quartile(za, 3) - quartile(za, 1))
    same = rows(m3c2.m3c2(c, cloud(spark, a), cloud(spark, a), 0.8, 3.0, 1.0))
    assert same[0][1] == pytest.approx(0, abs=1e-12) and same[0][2] > 1.96
    halved = rows(m3c2.cloudcompare(c, cloud(spark, a), cloud(spark, b), searchscale=1.6, searchdepth=3.0, registrationerror=0.1))
    assert halved[0][2] == pytest.approx(lod)
    own = rows(m3c2.m3c2_custom(c, cloud(spark, a), cloud(spark, b), 0.8, lambda p, q: (q["along"].max() - p["along"].max(), 0.0), 3.0))
    assert own == [(0, pytest.approx(zb.max() - za.max()), 0.0)]
    with pytest.raises(Exception, match="no good"):
        m3c2.m3c2_custom(c, cloud(spark, a), cloud(spark, b), 0.8, lambda p, q: (_ for _ in ()).throw(ValueError("no good")), 3.0).collect()


def test_directions_of_a_tilted_plane_and_of_nothing(spark):
    rng = np.random.default_rng(3)
    uv = rng.uniform(-2, 2, (300, 2))
    n = np.array([0.6, 0.0, 0.8])
    p = uv[:, :1] * np.array([0.8, 0, -0.6]) + uv[:, 1:] * np.array([0, 1.0, 0])
    got = rows(m3c2.directions(cloud(spark, [[0, 0, 0], [90, 0, 0]], "corepoint_id"), cloud(spark, p), [0.5, 1.5]))
    assert got[0][1:4] == pytest.approx(n.tolist(), abs=1e-9) and got[1][1:] == (None, None, None, None)
    down = rows(m3c2.directions(cloud(spark, [[0, 0, 0]], "corepoint_id"), cloud(spark, p), [1.0], orientation=(0.0, 0.0, -1.0)))
    assert down[0][3] == pytest.approx(-0.8)


def test_m3c2ep_equals_a_numpy_twin(spark):
    rng = np.random.default_rng(4)
    a = np.c_[rng.uniform(-1, 1, (40, 2)), rng.normal(0, 0.05, 40)]
    b = np.c_[rng.uniform(-1, 1, (30, 2)), rng.normal(0.3, 0.05, 30)]
    o, sr, ss, sy = np.array([5.0, -3.0, 20.0]), 0.01, 2e-4, 1e-4
    t = np.array([[1, -0.01, 0, 0.02], [0.01, 1, 0, 0.01], [0, 0, 1, 0.005]])
    x0 = np.array([0.5, 0.5, 0.0])
    g = rng.normal(size=(12, 12)) * 1e-4
    cxx = g @ g.T
    scan = spark.createDataFrame([(1, *map(float, o), sr, ss, sy)], "scanpos_id int, ox double, oy double, oz double, sigma_range double, sigma_scan double, sigma_yaw double")
    got = rows(m3c2ep.m3c2ep(core(spark, [[0, 0, 0], [50, 0, 0]]), cloud(spark, a, scanpos_id=[1] * 40), cloud(spark, b, scanpos_id=[1] * 30), scan, 0.9, 2.0, t.tolist(), cxx.tolist(), x0.tolist()))

    def side(p, moved, rot, second):
        inside = (np.hypot(moved[:, 0], moved[:, 1]) <= 0.9) & (np.abs(moved[:, 2]) <= 2)
        cs, al = [], []
        for q, m in zip(p[inside], moved[inside]):
            d = q - o
            r, yaw = np.linalg.norm(d), np.arctan2(d[1], d[0])
            sc = np.pi / 2 - np.arctan(d[2] / np.hypot(d[0], d[1]))
            j = np.array([[np.cos(yaw) * np.sin(sc), np.sin(yaw) * np.sin(sc), np.cos(sc)], [-r * np.sin(yaw) * np.sin(sc), r * np.cos(yaw) * np.sin(sc), 0], [r * np.cos(yaw) * np.cos(sc), r * np.sin(yaw) * np.cos(sc), -r * np.sin(sc)]])
            c = sum(s2 * np.outer(rot @ v, rot @ v) for s2, v in zip((sr**2 + sr * 1e-6 * r * r, ss**2, sy**2), j))
            cs.append(c)
            gv = np.r_[m - x0, 1]
            ix = [[0, 1, 2, 9], [3, 4, 5, 10], [6, 7, 8, 11]]
            al.append(np.array([[gv @ cxx[np.ix_(u, v)] @ gv for v in ix] for u in ix]) if second else np.zeros((3, 3)))
        w = [np.linalg.inv(c) for c in cs]
        return np.linalg.solve(sum(w), sum(i @ m for i, m in zip(w, moved[inside]))), (sum(cs) + sum(al)) / len(cs), len(cs)

    m1, l1, n1 = side(a, a, np.eye(3), False)
    m2, l2, n2 = side(b, (b - x0) @ t[:, :3].T + t[:, 3] + x0, t[:, :3], True)
    n = np.array([0, 0, 1.0])
    want = (n @ (m1 - m2), np.sqrt(7.814727903251179 / (n @ np.linalg.inv(l1 + l2) @ n)), np.sqrt(n @ l1 @ n), np.sqrt(n @ l2 @ n), n1, n2)
    assert got[0][1:7] == pytest.approx(want, rel=1e-6) and got[0][7] == pytest.approx(l1[0, 0], rel=1e-6)
    assert got[1][1:7] == (None, None, None, None, 0, 0)


def test_planes_of_two_epochs(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 1, (60, 2))
    seg = [k % 2 for k in range(60)]
    a = np.c_[xy + np.array(seg)[:, None] * 10, rng.normal(0, 0.01, 60)]
    b = a + [0, 0, 0.25]
    first, second = cloud(spark, a, segment_id=seg), cloud(spark, b, segment_id=[5 + s for s in seg])
    for options in ({}, {"both_ways": True}):
        got = rows(planes.pbm3c2(first, second, 3.0, **options))
        assert [(r[0], r[1]) for r in got] == [(0, 5), (1, 6)] and [r[2] for r in got] == pytest.approx([0.25, 0.25], abs=5e-3)
    assert rows(planes.pbm3c2(first, second, 0.1)) == []
    ids = planes.global_ids(first, second)
    assert rows(ids) == [(0, 0, 1), (0, 1, 2), (1, 5, 3), (1, 6, 4)]
    pairs = spark.createDataFrame([(0, 5, 1), (1, 5, 0), (9, 5, 1)], "id0 long, id1 long, label int")
    assert rows(planes.remap(pairs, ids)) == [(1, 3, 1), (2, 3, 0)]
    labelled = spark.createDataFrame([(0, 5, 1), (1, 6, 1), (0, 6, 0), (1, 5, 0)] * 4, "id0 long, id1 long, label int")
    assert [(r[0], r[1]) for r in rows(planes.pbm3c2(first, second, 20.0, labelled, "random_forest"))] == [(0, 5), (1, 6)]
    for bad in ({"method": "guess"}, {"method": "random_forest"}):
        with pytest.raises(ValueError):
            planes.pbm3c2(first, second, 1.0, **bad)
    with pytest.raises(ValueError):
        planes.pbm3c2(first, second, 1.0, labelled.filter("label = 1"), "random_forest")


def test_transform_there_and_back_turns_normals(spark):
    t = registration.Transformation.of_parts([[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1, 2, 3], (5.0, 0.0, 0.0))
    back = registration.Transformation.of(np.linalg.inv(t.array()), (5.0, 0.0, 0.0))
    c = core(spark, FIVE, (1.0, 0.0, 0.0))
    moved = registration.transform(c, t)
    assert rows(moved, "nx", "ny", "nz")[0] == (0.0, 1.0, 0.0)
    assert np.array(rows(registration.transform(moved, back), "corepoint_id", "x", "y", "z"))[:, 1:] == pytest.approx(np.array(FIVE))
    with pytest.raises(ValueError):
        registration.Transformation.of(np.eye(3))


def _wave(rng, n=300):
    xy = rng.uniform(0, 10, (n, 2))
    z = np.sin(xy[:, 0]) + 0.5 * np.cos(1.3 * xy[:, 1])
    nrm = np.c_[-np.cos(xy[:, 0]), 0.65 * np.sin(1.3 * xy[:, 1]), np.ones(n)]
    return np.c_[xy, z], nrm / np.linalg.norm(nrm, axis=1)[:, None]


@pytest.mark.parametrize("planes_", [False, True])
def test_icp_recovers_a_small_motion(spark, planes_):
    p, n = _wave(np.random.default_rng(7))
    a = 0.01
    rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    x0 = (5.0, 5.0, 0.0)
    q = (p - x0) @ rot.T + [0.03, -0.02, 0.02] + x0
    ref = cloud(spark, p, nx=n[:, 0].tolist(), ny=n[:, 1].tolist(), nz=n[:, 2].tolist())
    t = (registration.plane_icp if planes_ else registration.icp)(ref, cloud(spark, q), 5, 1e-6, x0)
    back = (q - x0) @ t.array()[:3, :3].T + t.array()[:3, 3] + x0
    assert np.abs(back - p).max() < 1e-2


def test_supervoxels_cover_every_point_once_and_stable_icp_moves_back(spark):
    p, n = _wave(np.random.default_rng(8), 200)
    more = dict(nx=n[:, 0].tolist(), ny=n[:, 1].tolist(), nz=n[:, 2].tolist())
    ref = cloud(spark, p, **more)
    s = rows(registration.supervoxels(ref, 3.0, 15), "point_id", "supervoxel_id")
    assert [r[0] for r in s] == list(range(200)) and 5 < len({r[1] for r in s}) < 60
    t = registration.stable_icp(ref, cloud(spark, p + [0.02, 0.01, 0.03], **more), 1.0, 0.1, 3.0, 3.0, min_points=4, k=15, max_rounds=1, fit_iterations=4)
    assert t.array()[:3, 3] == pytest.approx([-0.02, -0.01, -0.03], abs=0.02)
    with pytest.raises(ValueError):
        registration.stable_icp(ref, cloud(spark, p + [0, 0, 50], **more), 0.1, 0.05, 3.0, 3.0, min_points=4, k=15, max_rounds=1, fit_iterations=2)


def test_octree_keys_round_trip_and_statistics(spark):
    rng = np.random.default_rng(9)
    p = cloud(spark, rng.uniform(0, 8, (200, 3)))
    box = octree.bounding_box(p)
    key = octree.morton(box)
    got = p.select(octree.cell_coordinates(key).alias("c"), *[F.floor((F.col(a) - box[a][0]) / box[a][1] * 1024).alias(f"i{a}") for a in "xyz"])
    assert all((r.c.ix, r.c.iy, r.c.iz) == (r.ix, r.iy, r.iz) for r in got.collect())
    s = rows(octree.level_statistics(p, key))
    assert s[0] == (0, 1, 200, 200.0, 0.0) and len(s) == 11 and all(a[1] <= b[1] for a, b in zip(s, s[1:]))
    cells = octree.cells(p, key, 2)
    assert cells.agg(F.sum("points")).first()[0] == 200 and octree.in_cells(p, key, cells, 2).count() == 200
    flat = octree.bounding_box(cloud(spark, [[1, 1, 1], [1, 4, 1]]))
    assert flat["x"][1] == 1.0 and flat["y"][1] == 4.0 and octree.bounding_box(cloud(spark, [[1, 1, 1], [1, 4, 1]]), True)["x"][1] == 4.0
