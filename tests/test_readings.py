from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows

from tidemesh.operators import regular, series, spikes
from tidemesh.functions.segments import medians, tail_bins, tail_cutoff

NAN, INF = float("nan"), float("inf")
T0 = datetime(2024, 1, 1)
SCHEMA = "site_id int, analysis_id long, corepoint_id long, epoch_idx int, distance double, lodetection double, spread1 double, num_samples1 long, spread2 double, num_samples2 long, ingested_at timestamp, items string, before double"


def table(spark, *readings):
    """(corepoint, epoch, distance[, lodetection, spread2, samples, hours after T0])"""
    out = []
    for r in readings:
        c, e, d, lod, sp, n, h = (*r, *(0.02, 0.01, 20, 0)[len(r) - 3 :])
        out.append((17, 1, c, e, d, lod, 0.01, 9, sp, n, T0 + timedelta(hours=h) if h is not None else None, "x", 1.0))
    return spark.createDataFrame(out, SCHEMA)


def wavy(c, n=20, start=0):
    return [(c, start + e, round(0.01 * (e % 3) + 0.001 * e, 5)) for e in range(n)]


def found(df):
    return rows(spikes.flag_readings(df).filter("(spike and returned) or stuck or impossible"), "corepoint_id", "epoch_idx")


def changed(base, **at):
    return [(c, e, at.get(f"e{e}", d)) for c, e, d in base]


def test_spikes_of_one_and_two_readings_but_not_of_three(spark):
    df = table(spark, *changed(wavy(1), e5=3.0), *changed(wavy(2), e5=-3.0, e6=-3.1), *changed(wavy(3), e5=3.0, e6=3.1, e7=3.0), *changed(wavy(4), e0=3.0), *changed(wavy(5), e19=3.0), *changed(wavy(6), e10=9.0, e11=9.0, e12=9.0, e13=9.1, e14=9.1, e15=9.0, e16=9.0, e17=9.1, e18=9.0, e19=9.1))
    assert found(df) == [(1, 5), (2, 5), (2, 6)]


def test_stuck_and_impossible_values_do_not_mark_neighbours(spark):
    stuck = [(1, e, 0.5 if 5 <= e < 10 else d) for _, e, d in wavy(1)]
    four = [(2, e, 0.5 if 5 <= e < 9 else d) for _, e, d in wavy(2)]
    beyond = changed(wavy(3), e5=9999.0)
    fields = [(4, e, d, -1.0 if e == 3 else INF if e == 7 else 0.02, -0.5 if e == 9 else 0.01, -2 if e == 11 else 20) for _, e, d in wavy(4)]
    assert found(table(spark, *stuck, *four, *beyond, *fields)) == [*((1, e) for e in range(5, 10)), (3, 5), (4, 3), (4, 7), (4, 9), (4, 11)]


def test_versions_copies_nulls_and_empty(spark):
    base = changed(wavy(1), e5=3.0)
    late = [(1, 5, 0.02, 0.02, 0.01, 20, 5), (1, 5, 0.02, 0.02, 0.01, 20, 5)]
    nulls = [(2, e, None if e % 2 else NAN, None, None, None) for e in range(9)]
    df = table(spark, *base, *late, *nulls, (3, 0, 1.0), (1, 7, 50.0, 0.02, 0.01, 20, None))
    assert found(df) == []
    assert found(table(spark, *base, (1, 5, None, 0.02, 0.01, 20, 5))) == []
    assert found(df.limit(0)) == []
    gone = df.withColumn("corepoint_id", df["corepoint_id"] * None)
    assert found(gone) == []


def test_long_series_in_blocks_equal_whole_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    r = []
    for c in (1, 2):
        d = np.round(np.cumsum(rng.normal(0, 0.01, 300)), 5)
        d[rng.choice(300, 12, False)] += 4
        d[60:70] = d[60]
        d[150] = 99.0
        r += [(c, int(e), float(v)) for e, v in enumerate(d) if e % 7]
    df = table(spark, *r)
    whole = found(df)
    assert len(whole) > 20
    monkeypatch.setattr(series, "BLOCK", 16)
    monkeypatch.setattr(spikes, "BLOCK", 16)
    assert found(df) == whole


def test_tail_cutoff_follows_the_risk_whatever_spikes_there_are():
    rng = np.random.default_rng(2)
    v = rng.exponential(1.0, 20_000)
    cut = lambda x: tail_cutoff(*np.unique(tail_bins(x), return_counts=True), 1e-3)
    assert cut(v) == pytest.approx(np.log(1000), rel=0.15)
    assert cut(np.r_[v, np.full(200, 1e6)]) == pytest.approx(np.log(1000), rel=0.3)
    assert np.isnan(cut(v[:30])) and np.isnan(cut(np.r_[np.zeros(1000), 5.0, 6.0]))
    assert medians(np.array([0, 0, 2]), np.array([1.0, 2.0, 5.0]), 3).tolist()[::2] == [1.5, 5.0]


@pytest.mark.parametrize("law", ["normal", "laplace", "walk", "season"])
def test_clean_series_exceed_at_about_the_stated_risk(law):
    rng = np.random.default_rng(7)
    shape = (2000, 40)
    x = {"normal": rng.normal(size=shape), "laplace": rng.laplace(size=shape), "walk": np.cumsum(rng.normal(size=shape), 1), "season": 0.1 * rng.normal(size=shape) + 3 * np.sin(2 * np.pi * np.arange(40) / 7)}[law].ravel()
    seg, e, one = np.repeat(np.arange(2000), 40), np.tile(np.arange(40.0), 2000), np.ones(80_000)
    h = spikes.judge(seg, [e, 0.01 * x, one, one, one], 2000, tuple(range(2, 13)), 10.0, 5, 25.0)["height"][0]
    z = tail_cutoff(*np.unique(tail_bins(h), return_counts=True), 1e-3)
    assert 0.5e-3 <= (h > z).mean() <= 2e-3


def test_seasons_are_told_from_noise_and_taken_off(spark):
    rng = np.random.default_rng(1)
    seg, e = np.repeat(np.arange(200), 40), np.tile(np.arange(40.0), 200)
    wave = 2 * np.sin(2 * np.pi * e / 5)
    assert (spikes.seasonal(seg, e, rng.normal(size=8000), 200, (2, 3, 5, 7, 12), np.ones(200)) != 0).mean() < 0.02
    got = spikes.seasonal(seg, e, wave + 0.1 * rng.normal(size=8000) + 0.05 * e, 200, (2, 3, 5, 7, 12), np.ones(200))
    assert np.abs(got - wave).max() < 0.4
    # a bump of three median changes stands out only beside the season
    r = [(c, k, round(float(0.2 * np.sin(2 * np.pi * k / 5) + 0.002 * rng.normal() + (0.1 if (c, k) == (3, 20) else 0)), 5)) for c in range(40) for k in range(40)]
    f = spikes.flag_readings(table(spark, *r))
    assert rows(f.filter("spike and corepoint_id = 3 and epoch_idx = 20"), "returned") == [(False,)]
    plain = spikes.flag_readings(table(spark, *r), periods=())
    assert rows(plain.filter("spike and corepoint_id = 3 and epoch_idx = 20")) == []


def test_spikes_need_the_tail(spark):
    """A spike is one by the fitted level alone: at a risk that no reading reaches there is none, though the rule names it."""
    rng = np.random.default_rng(4)
    r = [(c, k, round(float(0.01 * rng.normal() + (0.5 if (c, k) == (3, 20) else 0)), 5)) for c in range(60) for k in range(40)]
    df = table(spark, *r)
    assert (3, 20) in found(df)
    f = spikes.flag_readings(df, risk=1e-200)
    assert rows(f.filter("spike and epoch_idx = 20")) == [] and (3, 20) in rows(f.filter("returned"), "corepoint_id", "epoch_idx")


def grid(spark, times, d, hours=6, **options):
    n = len(times)
    dist = table(spark, *[(1, e, v) for e, v in enumerate(d)])
    ep = spark.createDataFrame([(e, 1, e, t, None) for e, t in enumerate(times)] * 2, "epoch_id int, analysis_id long, epoch_idx int, ts timestamp, registered_at timestamp")
    an = spark.createDataFrame([(1, 2, T0, hours, n)], "analysis_id long, site_id int, reference_ts timestamp, grid_hours int, n_epochs int")
    return regular.regularise(dist, ep, an, **options)


def test_grid_means_coverage_and_missing(spark):
    t = [T0 + timedelta(hours=h) for h in (1, 4, 5, 20)]
    first = int(T0.timestamp()) // 21600
    got = rows(grid(spark, t, [1.0, 2.0, 3.0, 4.0]))
    assert [(r[1] - first, r[2], r[5]) for r in got] == [(0, 3, False), (1, 0, True), (2, 0, True), (3, 1, False)]
    assert got[0][3] == pytest.approx((3 * 1 + 1 * 2 + 1 * 3) / 5) and got[0][4] == pytest.approx(5 / 6)
    assert got[1][3] == 3.0 and got[1][4] == pytest.approx(5 / 6)
    assert got[2][3] is None and got[2][4] == 0
    assert got[3][4] == pytest.approx(4 / 6)
    assert [r[1] - first for r in rows(grid(spark, t, [1.0, 2.0, 3.0, 4.0], only_missing=True))] == [1, 2]


def test_grid_unplaced_and_empty(spark):
    t = [T0, None, T0 + timedelta(hours=30)]
    first = int(T0.timestamp()) // 21600
    assert [r[1] - first for r in rows(grid(spark, t, [1.0, 1.0, 99.0], only_missing=True))] == [1, 2, 3, 4]
    assert rows(grid(spark, t, [1.0, 1.0, None])) and len(rows(grid(spark, t, [1.0, 1.0, None]))) == 1
    assert rows(grid(spark, t, [None, 1.0, NAN])) == []
    assert rows(grid(spark, t, [1.0, 1.0, 1.0], hours=0)) == []


def test_grid_in_blocks_equals_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = [T0 + timedelta(hours=float(h)) for h in np.cumsum(rng.exponential(20, 60))]
    d = [float(v) for v in rng.normal(0, 1, 60)]
    whole = rows(grid(spark, t, d))
    monkeypatch.setattr(series, "BLOCK", 5)
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(grid(spark, t, d))] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in whole]
