from datetime import datetime

import numpy as np
from conftest import rows

from tidemesh.llm import clusters as C

S = "analysis_id long, corepoint_id long, epoch_idx int, distance double, lodetection double, spread2 double, num_samples2 long, ingested_at timestamp"
T = datetime(2024, 1, 1)


def distances(spark, series):
    return spark.createDataFrame([(a, c, e, float(v), 0.1, 0.1, 9, T) for (a, c), s in series.items() for e, v in enumerate(s) if v is not None], S)


def places(spark, at):
    return spark.createDataFrame([(a, c, *map(float, p), "x") for (a, c), p in at.items()], "analysis_id long, corepoint_id long, x double, y double, z double, n string")


def wave(k, off=0.0):
    return [0.3 * np.sin(e / 3 + k) + off + 0.0001 * (e % 5) for e in range(40)]


def test_groups_are_cliques_with_no_other_link(spark):
    s = {(1, i): wave(0, 0.001 * i) for i in range(4)} | {(1, 10 + i): wave(2) for i in range(2)} | {(1, 20 + i): wave(4, 0.03 * i) for i in range(3)} | {(2, 30 + i): wave(0) for i in range(3)} | {(1, 40): wave(0)}
    at = {k: (k[1] % 10, 0, 0) for k in s} | {(1, 40): (500, 0, 0)}
    d, p = distances(spark, s), places(spark, at)
    got = rows(C.like_groups(d, p), "cluster_id", "corepoint_id")
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (30, 30), (30, 31), (30, 32)]  # 20 and 22 differ by 0.06: no clique
    assert [r[:2] for r in rows(C.described(C.like_groups(d, p)), "cluster_id", "size", "typical")] == [(0, 4), (30, 3)]
    assert rows(C.like_groups(d, p, within=0.08), "cluster_id", "corepoint_id") == [(0, 0), (0, 1), (0, 2), (0, 3), (20, 20), (20, 21), (20, 22), (30, 30), (30, 31), (30, 32)]


def test_share_of_epochs_missing_readings_and_unusable_rows(spark):
    a, b = wave(0), wave(0)
    b[:6] = [v + 1.0 for v in b[:6]]  # 34 of 40 agree: 85 in 100
    c = wave(0)
    c[:7] = [v + 1.0 for v in c[:7]]
    s = {(1, 1): a, (1, 2): [None] * 20 + a[20:], (1, 3): b}
    p = places(spark, {k: (0, 0, 0) for k in s})
    assert len(rows(C.like_groups(distances(spark, s), p))) == 3
    assert rows(C.like_groups(distances(spark, s | {(1, 3): c}), p)) == []
    bad = places(spark, {(1, 1): (0, 0, 0), (1, 2): (float("nan"), 0, 0), (1, 3): (0, 0, 0)}).unionByName(p.filter("corepoint_id = 1"))
    assert rows(C.like_groups(distances(spark, s), bad)) == []
    assert rows(C.like_groups(distances(spark, s).limit(0), p)) == [] and rows(C.like_groups(distances(spark, s), p.limit(0))) == []


def test_leaves_list_all_within_reach_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 300, (240, 2))
    kind = rng.integers(0, 3, 240)
    s = {(1, i): wave(kind[i] * 2, 0.001 * (i % 3)) for i in range(240)}
    at = {(1, i): (*xy[i], 0) for i in range(240)}
    p = places(spark, at)
    leaves = C.bisect(p.selectExpr("corepoint_id id", "analysis_id tree", "x", "y", "z"), 40.0, 20.0)
    listed = {}
    for r in leaves.collect():
        listed.setdefault(r.leaf, {})[r.id] = r.home
    home = {i: l for l, m in listed.items() for i, h in m.items() if h}
    assert len(home) == 240 and len(listed) > 4
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    assert all(j in listed[home[i]] for i in range(240) for j in np.flatnonzero(d2[i] <= 1600))
    d = distances(spark, s)
    whole = rows(C.like_groups(d, p, reach=12.0, compact=1e9), "cluster_id", "corepoint_id")
    monkeypatch.setattr(C, "PART", 16)
    assert rows(C.like_groups(d, p, reach=12.0, compact=25.0), "cluster_id", "corepoint_id") == whole and len(whole) >= 6


def test_nodes_are_split_until_all_are_compact_whatever_their_size(spark):
    two = [(k, 1, 100.0 * (k % 2), 0.0, 0.0) for k in range(4)] + [(10 + k, 2, float(k), 0.0, 0.0) for k in range(3)] + [(20, 3, 5.0, 5.0, 5.0), (21, 3, 5.0, 5.0, 5.0)]
    p = spark.createDataFrame(two, "id long, tree long, x double, y double, z double")
    leaves = C.bisect(p, 10.0).cache()
    assert rows(leaves.filter("home")) == [(0, 1, "0", True), (1, 1, "1", True), (2, 1, "0", True), (3, 1, "1", True), (10, 2, "", True), (11, 2, "", True), (12, 2, "", True), (20, 3, "", True), (21, 3, "", True)]
    r = rows(C.leaf_report(leaves, p, 2))
    assert [x[:3] + x[4:] for x in r] == [(1, "0", 2, 1, 0), (1, "0", 2, 2, 2), (1, "1", 2, 1, 1), (1, "1", 2, 2, 3), (2, "", 3, 1, 11), (2, "", 3, 2, 10), (3, "", 2, 1, 20), (3, "", 2, 2, 21)]
    assert max(x[3] for x in r) <= 10.0 and rows(C.bisect(p.limit(0), 10.0)) == []


def test_most_typical_members_by_rank(spark):
    g = spark.createDataFrame([(1, k, float(x), 0.0, 0.0, 0.0) for k, x in enumerate((0, 10, 4, 6, 5))] + [(2, 9, 1.0, 1.0, 1.0, 0.0)], "cluster_id long, corepoint_id long, x double, y double, z double, mean double")
    assert rows(C.described(g, members=3), "cluster_id", "size", "rank", "typical") == [(1, 5, 1, 4), (1, 5, 2, 2), (1, 5, 3, 3), (2, 1, 1, 9)]
