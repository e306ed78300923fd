import numpy as np
import pytest
from conftest import rows

from tidemesh.functions.runtime import hot_keys, salted
from tidemesh.operators.near import points_near, regions_holding
from pyspark.sql import functions as F

NAN = float("nan")


def test_points_near_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q, p = rng.uniform(-3, 3, (40, 3)), rng.uniform(-3, 3, (400, 3))
    qd = spark.createDataFrame([(i, *map(float, v), "x") for i, v in enumerate(q)], "q long, x double, y double, z double, cx string")
    pd_ = spark.createDataFrame([(i, *map(float, v), 1.0) for i, v in enumerate(p)], "p long, x double, y double, z double, d2 double")
    want = sorted((i, j) for i in range(40) for j in range(400) if ((q[i] - p[j]) ** 2).sum() <= 0.81)
    assert rows(points_near(qd, pd_, 0.9, "q", "p"), "q", "p") == want


def test_points_near_bounds_copies_and_unusable(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "q long, x double, y double, z double")
    p = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (8, NAN, 0.0, 0.0), (9, float("inf"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "p long, x double, y double, z double")
    assert rows(points_near(q, p, 1.0, "q", "p"), "q", "p") == [(1, 7)]
    assert rows(points_near(q, p, 1.0, "q", "p", strict=True)) == []
    assert rows(points_near(q, p.limit(0), 1.0, "q", "p")) == []
    assert rows(points_near(q.limit(0), p, 1.0, "q", "p")) == []
    with pytest.raises(ValueError):
        points_near(q, p, 0.0, "q", "p")


def test_hot_cells_are_sliced_and_keep_every_pair(spark):
    big = spark.range(5000).select(F.col("id").alias("p"), F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.1).alias("z"))
    key = F.xxhash64(F.floor("x"))
    assert list(hot_keys(big, key, 1000).values()) == [5]
    a, b = salted(big, big.limit(2).withColumnRenamed("p", "q"), key, F.col("p"), 1000)
    assert a.select("_salt").distinct().count() == 5 and b.count() == 10
    assert a.join(b.select("_salt", "q"), "_salt").count() == 10_000


SQUARE = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]


def _zones(spark, *rings):
    return spark.createDataFrame([(i, r, "s") for i, r in enumerate(rings)], "zone_id long, ring array<double>, px string")


def test_regions_equal_crossing_parity(spark):
    rng = np.random.default_rng(5)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 25))
    r = rng.uniform(2, 60, 25)
    star = np.c_[100 + r * np.cos(angle), 5000 + r * np.sin(angle)]
    p = np.c_[rng.uniform(30, 170, 500), rng.uniform(4930, 5070, 500)]

    def inside(v):
        n = 0
        for (x1, y1), (x2, y2) in zip(star, np.roll(star, -1, 0)):
            n += (y1 > v[1]) != (y2 > v[1]) and v[0] < x1 + (v[1] - y1) * (x2 - x1) / (y2 - y1)
        return n % 2 == 1

    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "p long, x double, y double")
    ring = [float(v) for v in star.ravel()]
    turned = [float(v) for v in star[::-1].ravel()]
    z = _zones(spark, ring, [*turned, *turned[:2]])
    got = rows(regions_holding(pts, z, "p", "zone_id"), "p", "zone_id")
    assert got == sorted((i, k) for i, v in enumerate(p) if inside(v) for k in (0, 1))


def test_regions_outline_degenerate_and_levels(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 0.0, 0.0), (4, 50.0, 5.0), (5, NAN, 5.0), (6, None, 1.0), (1, 5.0, 5.0)], "p long, x double, y double")
    huge = [-9e4, -9e4, 9e4, -9e4, 9e4, 9e4, -9e4, 9e4]
    z = _zones(spark, SQUARE, None, [], [0.0, 0.0, 1.0], [0.0, 0.0, 9.0, 9.0, 0.0, 0.0], [0.0, 0.0, NAN, 9.0, 9.0, 0.0], huge)
    assert rows(regions_holding(pts, z, "p", "zone_id"), "p", "zone_id") == [(1, 0), (1, 6), (2, 0), (2, 6), (3, 0), (3, 6), (4, 6)]
    assert rows(regions_holding(pts, z, "p", "zone_id", on_outline=False), "p", "zone_id") == [(1, 0), (1, 6), (2, 6), (3, 6), (4, 6)]
    assert rows(regions_holding(pts, z.limit(0), "p", "zone_id")) == []
    assert rows(regions_holding(pts.limit(0), z, "p", "zone_id")) == []
