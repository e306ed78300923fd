"""Series operators against literal vectors and plain loops."""

import numpy as np
import pytest
from conftest import rows

from tidemesh.operators import obc, timeseries as T
from tidemesh.plans import reference_queries as Q

NAN = float("nan")

# A signal with its known change points, for checking that results agree.
SIGNAL = [-9.30567119, -6.50542506, -5.25334064, -3.95708071, -10.62295044, -6.00679331, -7.10972198, -4.75825001, -6.7100845, -8.11943878, -9.56607421, -4.94672353, -6.67989247, -4.65803801, -7.37845623, -7.48818285, -5.78868842, -5.63853894, -6.82157223, -4.36439707, -10.23610407, -7.17848293, -10.35211983, -11.3509054, -11.61486292, -9.35727084, -10.34027666, -10.86800044, -9.93429977, -8.48897875, -15.3695928, -14.26784041, -9.31700749, -10.71438333, -6.79820964, -9.38362261, -10.55322992, -10.752245, -13.40571741, -14.18765576, -9.54996564, -19.35102448, -20.7635553, -19.26623954, -20.00548551, -17.99023991, -18.37537823, -17.53357472, -23.12740104, -17.55591524, -20.86915052, -17.75074536, -20.28542954, -20.5310157, -18.73412243, -19.07024164, -20.43017388, -21.11249791, -18.45269281, -18.07089436, -19.96608851, -26.63058919, -28.97962105, -25.47049917, -26.02732842, -25.42334059, -24.96684487, -22.69612178, -24.85381947, -25.34017963, -27.46753899, -24.05766122, -29.416168, -19.5100961, -25.98309514, -26.24838995, -25.40961916, -23.21292358, -26.63478854, -29.04883697, -16.35986185, -12.87413666, -16.2863866, -15.55762212, -21.88964465, -17.68327092, -16.60648862, -13.49961018, -15.97483962, -17.23104101, -18.17963806, -16.19978101, -17.62239823, -17.14176606, -14.73581351, -14.62187256, -20.06316631, -14.96743604, -19.01623592, -15.53150285]
NOISE = [5.89091385, 3.09297892, 7.54350943, 5.70123322, 11.45957527, 6.65151675, 6.66711702, 4.32121252, 5.36729293, 6.3855735, 6.15007257, 4.60662807, 2.93636227, 5.14934393, 4.08923314, 8.09501888, 7.34253289, 4.77373406, 4.23434058, 6.46301976]


def test_change_points_of_a_known_signal():
    assert T.change_points(SIGNAL, 24, 12, 1, 1.0) == [20, 41, 61, 80, 100]
    assert T.change_points(SIGNAL, 12, 6, 6, 1.0) == [18, 42, 60, 78, 100]
    at, score = T.window_scores(np.array(NOISE), 6, 1)
    assert at[0] == 3 and score == pytest.approx([0.7606029, 0.9658838, 0.89199268, 1.28422382, 1.83171059, 0.50144418, 0.78277964, 0.76066486, 1.9793425, 2.06083943, 0.54271586, 2.73590482, 3.25329975, 0.37560987])
    assert len(T.window_scores(np.array(NOISE), 20, 1)[1]) == 0
    assert T.change_points(np.zeros(30)) == [30] and T.change_points([1.0]) == [1]


def test_maxima_wrap_around_one_end():
    s = np.array([1.0, 5.0, 2.0, 3.0, 2.5, 4.0])
    assert T.ring_maxima(s, 1) == [1, 3, 5] and T.ring_maxima(s, 2) == [1] and T.ring_maxima(s, 6) == []


def test_l1_cost():
    s = np.array([-8.75263237, -12.4498439, -5.95124875, -7.85988551, -6.3420341, -8.12835494, -9.1555907, -8.99132828, -8.23779461, -7.04616777, -10.19556631, -7.24568867])
    assert T.l1_cost(s) == pytest.approx(15.20937643) and T.l1_cost(s[4:10]) == pytest.approx(4.86815678) and T.l1_cost(s[1:1]) == 0


def test_dtw_equals_a_plain_table_and_skips_gaps():
    a, b = np.array([1.0, 5, 4, 2]), np.array([1.0, 2, 4, 1])
    assert T.dtw(a, b) == 3
    assert T.dtw(np.array([1, NAN, 5, 4, 2]), np.array([1, 7, 2, 4, 1.0])) == 3
    assert np.isnan(T.dtw(np.array([NAN]), np.array([1.0]))) and T.normalised_dtw(np.array([NAN]), np.array([1.0])) == 1.0 and T.normalised_dtw(np.zeros(3), np.ones(3)) == 1.0
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.normal(size=(2, 9))
        t = np.full((10, 10), np.inf)
        t[0, 0] = 0
        for i in range(9):
            for j in range(9):
                t[i + 1, j + 1] = abs(x[i] - y[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert T.dtw(x, y) == pytest.approx(t[9, 9])


def test_seeds_of_a_bump():
    x = np.r_[np.zeros(20), np.linspace(0.2, 2, 10), np.linspace(1.8, 0, 12), np.zeros(18)]
    got = T.seeds_of(x, 8, 4, 1, 0.05, 6, 0.5)
    assert got and all(b - a >= 6 for a, b in got) and 14 <= got[0][0] <= 28
    assert T.seeds_of(np.zeros(40), 8, 4, 1, 0.05, 6) == []
    with pytest.raises(ValueError):
        T.seeds_of(x, 99)


def series(spark, data):
    return spark.createDataFrame([(1, c, e, None if v is None else float(v)) for c, s in data.items() for e, v in enumerate(s)], "analysis_id long, corepoint_id long, epoch_idx int, distance double")


def test_smoothing_window_counts_epochs_and_never_uses_the_last(spark):
    s = series(spark, {1: [0, 10, 2, None, 4, 99]})
    assert [r[2] for r in rows(T.temporal_averaging(s, 2))] == [0.0, 5.0, 6.0, 2.0, 4.0, 4.0]
    assert [r[2] for r in rows(T.temporal_averaging(s, 1))] == [0.0, 10.0, 2.0, None, 4.0, 99.0]
    gaps = s.filter("distance is not null")
    assert [r[1:] for r in rows(T.temporal_averaging(gaps, 2))] == [(0, 0.0), (1, 5.0), (2, 6.0), (4, 4.0), (5, 4.0)]


def test_filling_between_and_at_the_ends(spark):
    s = series(spark, {1: [None, 1, None, 3, None, None, 0, None], 2: [1, None, 2, None]})
    got = rows(T.fill_gaps(s), "corepoint_id", "epoch_idx", "distance")
    assert [r[2] for r in got if r[0] == 1] == [1.0, 1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.0] and [r[2] for r in got if r[0] == 2] == [1.0, None, 2.0, None]
    e = spark.createDataFrame([(1, k) for k in range(4)], "analysis_id long, epoch_idx int")
    assert len(rows(T.densify(series(spark, {1: [5.0]}), e))) == 4
    assert rows(T.magnitude(s, 1, 6)) == [(1, -1.0), (2, None)]


def bump(n):
    return [2 * float(np.exp(-(((k - 30) / 6) ** 2))) + 0.02 * float(np.sin(1.7 * k)) + 0.001 * n for k in range(60)]


def test_objects_cover_the_changed_patch_once(spark):
    data = {i: bump(i) if i % 6 < 3 else [0.01 * float(np.sin(1.7 * k)) for k in range(60)] for i in range(36)}
    s = T.arrays(series(spark, data))
    core = spark.createDataFrame([(1, i, float(i % 6), float(i // 6), 0.0) for i in range(36)], "analysis_id long, corepoint_id long, x double, y double, z double")
    seeds = T.seed_scores(T.find_seeds(s, width=8, min_size=4, penalty=0.001, minperiod=6, height=0.5), s, core, 1.5)
    ranked = rows(seeds, "seed_rank", "corepoint_id")
    assert ranked and [r[0] for r in ranked] == list(range(1, len(ranked) + 1)) and {r[1] % 6 for r in ranked} <= {0, 1, 2}
    found = obc.objects_by_change(seeds, s, core, 1.5, least=4, variation=None)
    members = rows(found, "object_id", "corepoint_id")
    assert {c % 6 for o, c in members if o == 0} == {0, 1, 2} and len({c for o, c in members if o == 0}) == 18
    assert rows(found.groupBy("object_id").agg({"dtw": "min"}))[0][1] == 0.0
    assert rows(obc.objects_by_change(seeds, s, core, 1.5, first_rank=999)) == []


def test_threshold_choice():
    g = [dict.fromkeys(range(k), 0.0) for k in (2, 3, 10, 11)]
    assert obc.best_threshold(g, [0.1, 0.2, 0.3, 0.4], 2, 99) == (0.2, g[1])
    assert obc.best_threshold(g, [0.1, 0.2, 0.3, 0.4], 5, 99) == (0.2, {})
    assert obc.best_threshold(g, [0.1, 0.2, 0.3, 0.4], 2, 10)[0] == 0.2
    assert obc.best_threshold([{0: 0.0}, {0: 0.0}], [0.1, 0.2], 5, 99) == (0.2, {0: 0.0})
    assert obc.best_threshold([dict.fromkeys(range(12), 0.0), {0: 0.0}], [0.1, 0.2], 2, 12)[0] == 0.1


def test_clusters_and_components_of_series(spark):
    rng = np.random.default_rng(0)
    data = {i: (np.linspace(0, 1, 12) * (1 if i < 10 else -1) + rng.normal(0, 0.01, 12)).tolist() for i in range(20)}
    s = series(spark, data)
    a = T.arrays(s)
    k = dict(rows(T.kmeans(a, 2)))
    assert len({k[i] for i in range(10)}) == 1 and k[0] != k[15]
    m = rows(T.cluster_medians(s, T.kmeans(a, 2)))
    assert len(m) == 24
    p = [r[2] for r in rows(T.pca(a, 2)) if r[0] == 0]
    assert abs(np.corrcoef(p, np.linspace(0, 1, 12))[0, 1]) > 0.99


def test_clusters_and_components_read_every_epoch_of_each_analysis(spark, tmp_path):
    size = {1: 40, 2: 30}
    at = {a: [3 * t + 2 for t in range(n)] for a, n in size.items()}
    d = [(a, 100 * a + c, at[a][t], float(c % 2 and t == 1), "2020-01-01") for a, n in size.items() for c in range(10) for t in range(n)]
    tables = {
        "distances": (d, "analysis_id long, corepoint_id long, epoch_idx int, distance double, ingested_at string"),
        "epochs": ([(1000 * a + e, a, e) for a in size for e in at[a]], "epoch_id long, analysis_id long, epoch_idx int"),
        "analyses": (list(size.items()), "analysis_id long, n_epochs int"),
    }
    for name, (r, schema) in tables.items():
        spark.createDataFrame(r, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    m = Q.series_clusters(spark, str(tmp_path)).collect()
    assert {(r.analysis_id, r.cluster, r.epoch_idx): r.median for r in m} == {(a, c, e): float(c and e == at[a][1]) for a in size for c in (0, 1) for e in at[a]}
    p = Q.series_components(spark, str(tmp_path)).collect()
    assert {(r.analysis_id, r.component, r.epoch_idx): r.loading for r in p} == {(a, 0, e): float(e == at[a][1]) for a in size for e in at[a]}


def test_components_of_groups_equal_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = {g: rng.normal(size=(25, n)) * np.linspace(1, 3, n) for g, n in ((1, 6), (2, 9))}
    df = spark.createDataFrame([(g, 100 * g + i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)], "g long, corepoint_id long, values array<double>")
    got = {}
    for r in T.pca(df, 2, by=["g"]).collect():
        got.setdefault((r.g, r.component), {})[r.epoch_idx] = r.loading
    for (g, j), v in got.items():
        want = np.linalg.eigh(np.cov(x[g].T))[1][:, -1 - j]
        assert abs(want @ [v[i] for i in range(len(v))]) == pytest.approx(1)
    assert len(got) == 4
