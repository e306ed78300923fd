"""Voxel views of points: groups, features, reductions, masks and bitemporal comparison."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import linalg

VOXEL = ("vx", "vy", "vz")
AXES = ("x", "y", "z")
MOMENTS = ("count", "density", "centroid", "voxel_center", "local_centroid", "closest_to_center", "closest_to_centroid")
EIGEN = ("eigenvalues", "linearity", "planarity", "sphericity", "sum_of_eigenvalues", "omnivariance", "eigenentropy", "anisotropy", "surface_variation")
#: 0.1 % quantile of chi-squared with 3 degrees of freedom, the limit at alpha 0.999. Fixed value.
CHI2_3_AT_0001 = 0.024297585815692576


def with_voxels(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Adds vx, vy, vz = floor((p - origin) / size); null coordinates give null voxels."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    return points.withColumns({v: F.floor((F.col(a) - float(o)) / float(size)) for v, a, o in zip(VOXEL, AXES, origin)})


def center(size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, Column]:
    """Columns of the voxel's center."""
    return {a: F.col(v) * float(size) + float(o) + float(size) / 2 for a, v, o in zip(AXES, VOXEL, origin)}


def covariance(population: bool = True) -> list[Column]:
    """Aggregates c_xx .. c_zz of ux, uy, uz; the diagonal is at least 0."""
    cov, var = (F.covar_pop, F.var_pop) if population else (F.covar_samp, F.var_samp)
    return [(F.greatest(var(f"u{a}"), F.lit(0.0)) if a == b else cov(f"u{a}", f"u{b}")).alias(f"c_{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]


def _local(points: DataFrame, size: float, origin: tuple[float, float, float]) -> DataFrame:
    """Adds ux, uy, uz, the place relative to the voxel's center: sums of it lose no digits, however far the frame's origin is."""
    mid = center(size, origin)
    return points.withColumns({f"u{a}": F.col(a) - mid[a] for a in AXES})


def usable_points(points: DataFrame) -> DataFrame:
    from ..functions.runtime import usable

    return points.filter(usable(*[F.col(a) for a in AXES]))


def features(points: DataFrame, size: float, names: Sequence[str], origin: tuple[float, float, float] = (0.0, 0.0, 0.0), point_id: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """One row per occupied voxel with the named features (MOMENTS, "covariance" and EIGEN), and vx, vy, vz.

    Only what the names need is aggregated, in one shuffle with map-side partial sums. centroid gives x.., voxel_center
    center_x.., local_centroid local_x.., closest_* the coordinates and id of the point nearest to the center or centroid
    (ties: the smaller id). Ratios with no variance are 0. Points without usable coordinates are in no voxel.
    """
    unknown = set(names) - {*MOMENTS, *EIGEN, "covariance"}
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    eigen = [n for n in names if n in EIGEN]
    p = _local(with_voxels(usable_points(points), size, origin), size, origin)
    keys = [*by, *VOXEL]
    mid = center(size, origin)
    aggs = [F.count("*").alias("count"), *[F.avg(f"u{a}").alias(f"l{a}") for a in AXES]]
    if eigen or "covariance" in names:
        aggs += covariance()
    if "closest_to_center" in names:
        d2 = sum(F.col(f"u{a}") * F.col(f"u{a}") for a in AXES)
        aggs.append(F.min_by(F.struct(*AXES, point_id), F.struct(d2, point_id)).alias("near_center"))
    v = p.groupBy(*keys).agg(*aggs)
    if "closest_to_centroid" in names:
        c = p.join(v.select(*keys, *[F.col(f"l{a}").alias(f"_m{a}") for a in AXES]), keys)
        d2 = sum((F.col(f"u{a}") - F.col(f"_m{a}")) * (F.col(f"u{a}") - F.col(f"_m{a}")) for a in AXES)
        v = v.join(c.groupBy(*keys).agg(F.min_by(F.struct(*AXES, point_id), F.struct(d2, point_id)).alias("near_centroid")), keys)
    if eigen:
        v = eigen_features(linalg.with_eigenvalues(v, "c"))
    out: list[Column] = [F.col(k) for k in keys]
    for n in names:
        if n == "count":
            out.append(F.col("count"))
        elif n == "density":
            out.append((F.col("count") / float(size) ** 3).alias("density"))
        elif n == "centroid":
            out += [(mid[a] + F.col(f"l{a}")).alias(a) for a in AXES]
        elif n == "voxel_center":
            out += [mid[a].alias(f"center_{a}") for a in AXES]
        elif n == "local_centroid":
            out += [F.col(f"l{a}").alias(f"local_{a}") for a in AXES]
        elif n == "covariance":
            out += linalg.parts("c")
        elif n == "eigenvalues":
            out += [F.col(k) for k in ("l1", "l2", "l3")]
        elif n.startswith("closest_to_"):
            s = "near_" + n[len("closest_to_") :]
            out += [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in (*AXES, point_id)]
        else:
            out.append(F.col(n))
    return v.select(*out)


def eigen_features(v: DataFrame) -> DataFrame:
    """Adds the shape features of eigenvalues l1 >= l2 >= l3; a feature without variance is 0."""
    a, b, c = F.col("l1"), F.col("l2"), F.col("l3")
    total = a + b + c

    def ratio(x, y):
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    entropy = sum(F.when(x > 0, -ratio(x, total) * F.ln(F.when(x > 0, ratio(x, total)).otherwise(1.0))).otherwise(0.0) for x in (a, b, c))
    return v.withColumns({"linearity": ratio(a - b, a), "planarity": ratio(b - c, a), "sphericity": ratio(c, a), "sum_of_eigenvalues": total, "omnivariance": F.pow(a * b * c, F.lit(1 / 3)), "eigenentropy": entropy, "anisotropy": ratio(a - c, a), "surface_variation": ratio(c, total)})


def reduce(points: DataFrame, size: float, mode: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), point_id: str = "point_id", averaged: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One point per voxel: closest_to_center, closest_to_centroid (a real point, with its id and `averaged` as they are there), voxel_center or centroid (made; `averaged` columns are means)."""
    if mode in ("closest_to_center", "closest_to_centroid"):
        s = "near_" + mode[len("closest_to_") :]
        v = features(points, size, [mode], origin, point_id, by)
        v = v.select(*by, *VOXEL, *[F.col(f"{s}_{c}").alias(c) for c in (*AXES, point_id)])
        return v.join(points.select(*by, point_id, *averaged).dropDuplicates([*by, point_id]), [*by, point_id]) if averaged else v
    if mode not in ("voxel_center", "centroid"):
        raise ValueError(f"unknown mode: {mode}")
    p = _local(with_voxels(usable_points(points), size, origin), size, origin)
    v = p.groupBy(*by, *VOXEL).agg(*[F.avg(f"u{a}").alias(f"l{a}") for a in AXES], *[F.avg(c).alias(c) for c in averaged], F.count("*").alias("count"))
    mid = center(size, origin)
    return v.withColumns({a: mid[a] + F.col(f"l{a}") if mode == "centroid" else mid[a] for a in AXES}).drop(*[f"l{a}" for a in AXES])


def select_by_mask(points: DataFrame, mask: DataFrame, size: float, inside: bool = True, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), by: Sequence[str] = ()) -> DataFrame:
    """Points whose voxel is (or is not) occupied in mask; without overlap, `inside=False` keeps all."""
    m = with_voxels(usable_points(mask), size, origin).select(*by, *VOXEL).distinct()
    return with_voxels(usable_points(points), size, origin).join(m, [*by, *VOXEL], "left_semi" if inside else "left_anti")


def map_back(points: DataFrame, voxels: DataFrame, size: float, columns: Sequence[str], origin: tuple[float, float, float] = (0.0, 0.0, 0.0), by: Sequence[str] = ()) -> DataFrame:
    """Points with the named columns of their voxel."""
    return with_voxels(usable_points(points), size, origin).join(voxels.select(*by, *VOXEL, *columns), [*by, *VOXEL], "left")


def delta(first: DataFrame, second: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), by: Sequence[str] = ()) -> DataFrame:
    """Occupied voxels of either epoch: change_type 1 only first, 2 only second, 3 both; at the voxel's center."""
    keys = [*by, *VOXEL]
    both = with_voxels(usable_points(first), size, origin).select(*keys, F.lit(1).alias("t")).unionByName(with_voxels(usable_points(second), size, origin).select(*keys, F.lit(2).alias("t")))
    v = both.groupBy(*keys).agg((F.max(F.when(F.col("t") == 1, 1).otherwise(0)) + F.max(F.when(F.col("t") == 2, 2).otherwise(0))).cast("tinyint").alias("change_type"))
    return v.withColumns(center(size, origin))


def mahalanobis(first: DataFrame, second: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), min_points: int = 1, limit: float = CHI2_3_AT_0001, by: Sequence[str] = ()) -> DataFrame:
    """Bitemporal change per voxel: change_type, mahalanobis (the larger squared distance), p_value, significance, changed.

    Both epochs are aggregated in one pass over their union. Distances are taken only in voxels of both; covariances get a
    ridge of (trace + 1e-6) * 1e-6. significance is 1 where the larger distance exceeds `limit`; changed also holds for
    voxels of one epoch only or with fewer than min_points in either.
    """
    keys = [*by, *VOXEL]
    both = with_voxels(usable_points(first), size, origin).select(*keys, *AXES, F.lit(1).alias("t")).unionByName(with_voxels(usable_points(second), size, origin).select(*keys, *AXES, F.lit(2).alias("t")))
    side = _local(both, size, origin).groupBy(*keys, "t").agg(F.count("*").alias("n"), *[F.avg(f"u{a}").alias(a) for a in AXES], *covariance())
    ridge = (F.col("c_xx") + F.col("c_yy") + F.col("c_zz") + 1e-6) * 1e-6
    side = side.withColumn("_r", ridge).withColumns({f"c_{k}": F.col(f"c_{k}") + F.col("_r") for k in ("xx", "yy", "zz")}).withColumn("det", linalg.det3(*linalg.parts("c"))).drop("_r")
    row = F.struct(*[c for c in side.columns if c not in keys and c != "t"])
    v = side.groupBy(*keys).agg(F.max(F.when(F.col("t") == 1, row)).alias("a"), F.max(F.when(F.col("t") == 2, row)).alias("b"))
    gap = [F.col(f"a.{x}") - F.col(f"b.{x}") for x in AXES]

    def against(s: str) -> Column:
        return F.greatest(linalg.quad_inverse([F.col(f"{s}.c_{k}") for k in linalg.PARTS], gap, F.col(f"{s}.det")), F.lit(0.0))

    v = v.withColumns({"d_b": against("b"), "d_a": against("a")})
    kind = F.when(F.col("b").isNull(), 1).when(F.col("a").isNull(), 2).otherwise(3).cast("tinyint")
    v = v.withColumn("change_type", kind).withColumn("mahalanobis", F.when(F.col("change_type") == 3, F.greatest("d_a", "d_b")))
    v = v.withColumn("significance", F.when(F.col("change_type") == 3, (F.col("mahalanobis") > limit).cast("int")))
    v = v.withColumn("p_value", chi2_3_tail(F.when(F.col("change_type") == 3, F.least("d_a", "d_b"))))
    few = (F.coalesce("a.n", F.lit(0)) < min_points) | (F.coalesce("b.n", F.lit(0)) < min_points)
    v = v.withColumn("changed", ((F.col("change_type") != 3) | few | (F.coalesce("significance", F.lit(0)) == 1)).cast("int"))
    return v.withColumns(center(size, origin)).select(*keys, *AXES, "change_type", "mahalanobis", "p_value", "significance", "changed")


@F.pandas_udf(T.DoubleType())  # the engine has no erf
def _erf(x: pd.Series) -> pd.Series:
    import math

    return x.map(math.erf, na_action="ignore")


def chi2_3_tail(d2: Column) -> Column:
    """1 - cdf of chi-squared with 3 degrees of freedom."""
    return F.when(d2.isNotNull(), F.greatest(1 - _erf(F.sqrt(d2 / 2)) + F.sqrt(d2 * 2 / F.lit(3.141592653589793)) * F.exp(-d2 / 2), F.lit(0.0)))
