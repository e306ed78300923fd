"""Symmetric 3x3 matrices as columns: eigenvalues, eigenvectors, inverses.

A matrix is named by a prefix p: its columns are p_xx, p_xy, p_xz, p_yy, p_yz, p_zz.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def parts(p: str) -> list[Column]:
    return [F.col(f"{p}_{k}") for k in PARTS]


def det3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def quad_inverse(m: list[Column], v: list[Column], det: Column) -> Column:
    """v' M^-1 v for symmetric M with determinant det."""
    xx, xy, xz, yy, yz, zz = m
    x, y, z = v
    adj = x * x * (yy * zz - yz * yz) + y * y * (xx * zz - xz * xz) + z * z * (xx * yy - xy * xy) + 2 * (x * y * (xz * yz - xy * zz) + x * z * (xy * yz - xz * yy) + y * z * (xy * xz - xx * yz))
    return adj / det


def inverse(m: list[Column], det: Column) -> list[Column]:
    xx, xy, xz, yy, yz, zz = m
    return [(yy * zz - yz * yz) / det, (xz * yz - xy * zz) / det, (xy * yz - xz * yy) / det, (xx * zz - xz * xz) / det, (xy * xz - xx * yz) / det, (xx * yy - xy * xy) / det]


def with_eigenvalues(df: DataFrame, p: str, clamp: bool = True) -> DataFrame:
    """Adds l1 >= l2 >= l3 of matrix p (at least 0 if clamp); null where the matrix is null."""
    xx, xy, xz, yy, yz, zz = parts(p)
    df = df.withColumn("_eq", (xx + yy + zz) / 3)
    q = F.col("_eq")
    df = df.withColumn("_ep", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    s = F.when(F.col("_ep") > 0, F.col("_ep")).otherwise(1.0)
    df = df.withColumn("_er", F.least(F.greatest(det3((xx - q) / s, xy / s, xz / s, (yy - q) / s, yz / s, (zz - q) / s) / 2, F.lit(-1.0)), F.lit(1.0)))
    df = df.withColumn("_ef", F.acos("_er") / 3)
    df = df.withColumn("l1", q + 2 * F.col("_ep") * F.cos("_ef")).withColumn("l3", q + 2 * F.col("_ep") * F.cos(F.col("_ef") + F.lit(2 * math.pi / 3)))
    df = df.withColumn("l2", 3 * q - F.col("l1") - F.col("l3"))
    if clamp:
        df = df.withColumns({k: F.when(F.col(k).isNotNull(), F.greatest(F.col(k), F.lit(0.0))) for k in ("l1", "l2", "l3")})
    return df.drop("_eq", "_ep", "_er", "_ef")


def with_normal(df: DataFrame, p: str, eigenvalue: Column, orientation: tuple[float, float, float], out: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Adds the unit eigenvector of matrix p for an eigenvalue, turned to the side of `orientation`; null where it is not single."""
    xx, xy, xz, yy, yz, zz = parts(p)
    e = eigenvalue
    rows = [(xx - e, xy, xz), (xy, yy - e, yz), (xz, yz, zz - e)]

    def cross(a, b):
        return F.struct((a[1] * b[2] - a[2] * b[1]).alias("x"), (a[2] * b[0] - a[0] * b[2]).alias("y"), (a[0] * b[1] - a[1] * b[0]).alias("z"))

    df = df.withColumn("_c", F.array(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])))
    df = df.withColumn("_c", F.expr("array_max(transform(_c, c -> struct(c.x * c.x + c.y * c.y + c.z * c.z as n, c.x as x, c.y as y, c.z as z)))"))
    turn = F.when(F.col("_c.x") * orientation[0] + F.col("_c.y") * orientation[1] + F.col("_c.z") * orientation[2] < 0, -1.0).otherwise(1.0)
    df = df.withColumn("_s", F.when(F.col("_c.n") > 0, turn / F.sqrt("_c.n")))
    return df.withColumns({o: F.col(f"_c.{a}") * F.col("_s") for o, a in zip(out, "xyz")}).drop("_c", "_s")
