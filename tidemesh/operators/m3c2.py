"""M3C2: local directions, projected distances between two epochs and their level of detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import AXES, clean, cylinder_join, radius_join

#: What a distance callback must aggregate, per corepoint and side: value, spread, and the count n.
Statistic = Callable[[Column], list[Column]]


def directions(corepoints: DataFrame, cloud: DataFrame, radii: Sequence[float], corepoint_id: str = "corepoint_id", point_id: str = "point_id", orientation: tuple[float, float, float] = (0.0, 0.0, 1.0), by: Sequence[str] = ()) -> DataFrame:
    """Multiscale normals: (by, corepoint_id, nx, ny, nz, normal_radius) for every usable corepoint.

    For each radius the points strictly within it give a sample covariance; the radius of highest planarity
    (l2 - l3) / l1 > 0 wins, the smaller one on a tie, and the eigenvector of l3 is turned towards `orientation`. Null
    where no radius has a planarity. The eigenvectors come from LAPACK over Arrow batches of corepoints, which holds near
    degenerate neighbourhoods too. One join at the largest radius serves all radii, by conditional moments about the
    corepoint. A fresh neighbourhood is taken per radius.
    """
    radii = sorted(float(r) for r in radii)
    if not radii or radii[0] <= 0:
        raise ValueError("radii must be positive")
    pairs = radius_join(corepoints, cloud, radii[-1], corepoint_id, point_id, by)
    pairs = pairs.withColumns({f"d{a}": F.col(a) - F.col(f"q_{a}") for a in AXES})
    aggs = []
    for k, r in enumerate(radii):
        near = F.col("d2") < r * r
        aggs.append(F.count(F.when(near, 1)).alias(f"n{k}"))
        for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")):
            f = F.var_samp if a == b else F.covar_samp
            aggs.append(f(*[F.when(near, F.col(f"d{c}")) for c in ([a] if a == b else [a, b])]).alias(f"c{k}_{a}{b}"))
    m = pairs.groupBy(*by, "_q").agg(*aggs)
    up = np.array(orientation, float)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).cast("double").fill_null(float("nan")).to_numpy(zero_copy_only=False)
            best, normal, radius = np.zeros(b.num_rows), np.full((b.num_rows, 3), np.nan), np.full(b.num_rows, np.nan)
            for k, r in enumerate(radii):
                m = np.stack([col(f"c{k}_{p}") for p in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")], 1).reshape(-1, 3, 3)
                ok = np.flatnonzero((col(f"n{k}") > 1) & np.isfinite(m).all((1, 2)))
                if not len(ok):
                    continue
                value, vector = np.linalg.eigh(m[ok])
                with np.errstate(all="ignore"):
                    planar = np.nan_to_num((value[:, 1] - value[:, 0]) / value[:, 2])
                won = planar > np.maximum(best[ok], 1e-12)
                best[ok[won]], normal[ok[won]], radius[ok[won]] = planar[won], vector[won, :, 0], r
            normal = np.where((normal @ up < 0)[:, None], -normal, normal)
            none = np.isnan(radius)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in (*by, "_q")], *[pa.array(normal[:, k], mask=none) for k in range(3)], pa.array(radius, mask=none)], names=[*by, corepoint_id, "nx", "ny", "nz", "normal_radius"])

    keys = ", ".join(f"{n} {m.schema[c].dataType.simpleString()}" for c, n in zip((*by, "_q"), (*by, corepoint_id)))
    n = m.mapInArrow(solve, f"{keys}, nx double, ny double, nz double, normal_radius double")
    own = clean(corepoints, corepoint_id, by).select(*by, corepoint_id)
    return own.join(n, [*by, corepoint_id], "left")


def mean_spread(a: Column) -> list[Column]:
    """Mean and sample standard deviation along the axis."""
    return [F.avg(a).alias("value"), F.stddev_samp(a).alias("spread")]


def _ordered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Median and interquartile range of `along` per group by order statistics: quartiles at n // 4 and 3 n // 4, averaged with the value before only if n % 4 = 0."""
    w = Window.partitionBy(*keys)
    r = pairs.select(*keys, "along", F.row_number().over(w.orderBy("along")).alias("r"), F.count("*").over(w).alias("n"))
    n = F.col("n")

    def at(lo: Column, exact: Column) -> Column:
        return F.avg(F.when((F.col("r") == lo + 1) | ((F.col("r") == lo) & exact), F.col("along")))

    half, q1, q3 = F.floor(n / 2), F.floor(n / 4), F.floor(3 * n / 4)
    g = r.groupBy(*keys).agg(at(half, n % 2 == 0).alias("value"), (at(q3, n % 4 == 0) - at(q1, n % 4 == 0)).alias("spread"), F.max("n").alias("n"))
    return g


def m3c2(corepoints: DataFrame, first: DataFrame, second: DataFrame, radius: float, max_distance: float = 0.0, registration_error: float = 0.0, robust: bool = False, corepoint_id: str = "corepoint_id", point_id: str = "point_id", by: Sequence[str] = (), finder: Callable[..., DataFrame] | None = None, statistic: Statistic | None = None) -> DataFrame:
    """Distances of two epochs at corepoints with directions (nx, ny, nz).

    One row per usable corepoint: distance = value2 - value1 along the direction, lodetection =
    1.96 * (sqrt(spread1^2 / n1 + spread2^2 / n2) + registration_error), spread1, num_samples1, spread2, num_samples2.
    value and spread are mean and sample standard deviation, or with `robust` median and interquartile range. Where a side
    is empty, distance and lodetection are null and the counts 0; a spread needs two points.

    Both epochs are joined in one pass, as one cloud with a side, so corepoints are repeated over cells once. `finder`
    replaces the cylinder (it takes corepoints, cloud and `by` and gives pairs with `_q`, `side` and `along`); `statistic`
    replaces mean_spread by other aggregates of the position along the axis, named value and spread.
    """
    cloud = first.select(*by, point_id, *AXES, F.lit(1).alias("side")).unionByName(second.select(*by, point_id, *AXES, F.lit(2).alias("side")))
    if finder is None:
        pairs = cylinder_join(corepoints, cloud.withColumn("_pid", F.struct("side", point_id)).drop(point_id), radius, max_distance, corepoint_id, "_pid", by, ["side"])
    else:
        pairs = finder(corepoints, cloud, by)
    keys = [*by, "_q", "side"]
    g = _ordered(pairs, keys) if robust else pairs.groupBy(*keys).agg(*(statistic or mean_spread)(F.col("along")), F.count("*").alias("n"))
    cols = ("value", "spread", "n")
    both = g.groupBy(*by, "_q").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (1, 2) for c in cols])
    own = clean(corepoints, corepoint_id, by).select(*by, F.col(corepoint_id).alias("_q"))
    return _levels(own.join(both, [*by, "_q"], "left"), registration_error, [*by, F.col("_q").alias(corepoint_id)])


def _levels(both: DataFrame, error: float, keys: list) -> DataFrame:
    var = [F.col(f"spread{s}") * F.col(f"spread{s}") / F.col(f"n{s}") for s in (1, 2)]
    lod = 1.96 * (F.sqrt(var[0] + var[1]) + float(error))
    distance = F.col("value2") - F.col("value1")
    return both.select(*keys, distance.alias("distance"), F.when(distance.isNotNull(), lod).alias("lodetection"), F.col("spread1"), F.coalesce("n1", F.lit(0)).cast("long").alias("num_samples1"), F.col("spread2"), F.coalesce("n2", F.lit(0)).cast("long").alias("num_samples2"))


def m3c2_series(corepoints: DataFrame, cloud: DataFrame, epoch: str, reference: int, radius: float, max_distance: float = 0.0, registration_error: float = 0.0, corepoint_id: str = "corepoint_id", point_id: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """Distances of every epoch of `cloud` against the reference epoch, in one join: (by, corepoint_id, epoch, distance, ...).

    Rows come for every corepoint and epoch in which its cylinder holds points.
    """
    cloud = cloud.withColumn("_pid", F.struct(epoch, point_id)).drop(point_id)  # ids may recur from epoch to epoch
    pairs = cylinder_join(corepoints, cloud, radius, max_distance, corepoint_id, "_pid", [*by], [epoch])
    g = pairs.groupBy(*by, "_q", epoch).agg(*mean_spread(F.col("along")), F.count("*").alias("n"))
    ref = g.filter(F.col(epoch) == reference).select(*by, "_q", *[F.col(c).alias(f"{c}1") for c in ("value", "spread", "n")])
    both = g.select(*by, "_q", epoch, *[F.col(c).alias(f"{c}2") for c in ("value", "spread", "n")]).join(ref, [*by, "_q"], "left")
    return _levels(both, registration_error, [*by, F.col("_q").alias(corepoint_id), epoch])


def m3c2_custom(corepoints: DataFrame, first: DataFrame, second: DataFrame, radius: float, callback: Callable[[pd.DataFrame, pd.DataFrame], tuple[float, float]], max_distance: float = 0.0, corepoint_id: str = "corepoint_id", point_id: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """As m3c2 with a Python function of the two working sets (frames of x, y, z, along), giving (distance, lodetection). One group is one corepoint's cylinder; errors of the callback are raised."""
    cloud = first.select(*by, point_id, *AXES, F.lit(1).alias("side")).unionByName(second.select(*by, point_id, *AXES, F.lit(2).alias("side")))
    pairs = cylinder_join(corepoints, cloud.withColumn("_pid", F.struct("side", point_id)).drop(point_id), radius, max_distance, corepoint_id, "_pid", by, ["side"]).select(*by, "_q", "side", *AXES, "along")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, u = callback(pdf[pdf["side"] == 1], pdf[pdf["side"] == 2])
        return pdf.iloc[:1][[*by, "_q"]].assign(distance=d, lodetection=u)

    schema = ", ".join([*[f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*by, "_q")], "distance double", "lodetection double"])
    return pairs.groupBy(*by, "_q").applyInPandas(run, schema).withColumnRenamed("_q", corepoint_id)


def cloudcompare(corepoints: DataFrame, first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """m3c2 under CloudCompare's parameter names: searchscale and normalscale are diameters, searchdepth the half length, registrationerror and usemedian as they say."""
    known = {"searchscale": "radius", "searchdepth": "max_distance", "registrationerror": "registration_error", "usemedian": "robust"}
    kwargs = {known.get(k, k): v for k, v in options.items() if k != "normalscale"}
    kwargs["radius"] = kwargs["radius"] * 0.5
    if "normalscale" in options:
        n = directions(corepoints, first, [options["normalscale"] * 0.5], by=kwargs.get("by", ()))
        corepoints = corepoints.drop("nx", "ny", "nz", "normal_radius").join(n.drop("normal_radius"), [*kwargs.get("by", ()), "corepoint_id"])
    return m3c2(corepoints, first, second, **kwargs)


def normals(cloud: DataFrame, radius: float, point_id: str = "point_id", orientation: tuple[float, float, float] = (0.0, 0.0, 1.0), by: Sequence[str] = ()) -> DataFrame:
    """A normal for every point from its own cloud, at one radius."""
    return directions(cloud, cloud.withColumnRenamed(point_id, "_own"), [radius], point_id, "_own", orientation, by)


def significant(distances: DataFrame) -> DataFrame:
    """Rows whose |distance| exceeds the level of detection."""
    return distances.filter(F.abs("distance") > F.col("lodetection"))
