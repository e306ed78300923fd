"""M3C2 with error propagation: weighted local centres and covariances from scan geometry and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.runtime import if_small
from .spatial import AXES, clean, cylinder_join

#: 95 % quantile of chi-squared with 3 degrees of freedom. Fixed value.
CHI2_3_AT_95 = 7.814727903251179
_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _outer(j: Sequence[Column]) -> list[Column]:
    return [j[a] * j[b] for a, b in _PAIRS]


def _measurement(rotation: Sequence[Sequence[float]] | None, swapped: bool) -> list[Column]:
    """Covariance of one point from range, yaw and scan angle uncertainty; columns ox.., sigma_* and px, py, pz (as scanned)."""
    dx, dy, dz = (F.col(f"p{a}") - F.col(f"o{a}") for a in AXES)
    flat = F.sqrt(dx * dx + dy * dy)
    reach = F.sqrt(dx * dx + dy * dy + dz * dz)
    yaw, scan = F.atan2(dy, dx), F.lit(1.5707963267948966) - F.atan(F.try_divide(dz, flat))
    cy, sy, cs, ss = F.cos(yaw), F.sin(yaw), F.cos(scan), F.sin(scan)
    j_range = [cy * ss, sy * ss, cs]
    j_yaw = [-reach * sy * ss, reach * cy * ss, F.lit(0.0)]
    j_scan = [reach * cy * cs, reach * sy * cs, -reach * ss]
    s_yaw, s_scan = (F.col("sigma_scan"), F.col("sigma_yaw")) if swapped else (F.col("sigma_yaw"), F.col("sigma_scan"))
    s2_range = F.col("sigma_range") * F.col("sigma_range") + F.col("sigma_range") * 1e-6 * reach * reach
    out = [F.lit(0.0)] * 6
    for s2, j in ((s2_range, j_range), (s_yaw * s_yaw, j_yaw), (s_scan * s_scan, j_scan)):
        if rotation is not None:
            j = [sum(float(rotation[r][c]) * j[c] for c in range(3)) for r in range(3)]
        out = [o + s2 * v for o, v in zip(out, _outer(j))]
    return out


def _alignment(cxx: Sequence[Sequence[float]], origin: Sequence[float]) -> list[Column]:
    """Covariance that the 12 alignment parameters give a point: rows X, Y, Z use parameters (0,1,2,9), (3,4,5,10), (6,7,8,11)."""
    g = [F.col(a) - float(o) for a, o in zip(AXES, origin)] + [F.lit(1.0)]
    rows = ((0, 1, 2, 9), (3, 4, 5, 10), (6, 7, 8, 11))
    return [sum(float(cxx[rows[u][i]][rows[v][k]]) * g[i] * g[k] for i in range(4) for k in range(4)) for u, v in _PAIRS]


def m3c2ep(corepoints: DataFrame, first: DataFrame, second: DataFrame, scanpos: DataFrame, radius: float, max_distance: float, transform: Sequence[Sequence[float]], cxx: Sequence[Sequence[float]], reduction_point: Sequence[float] = (0.0, 0.0, 0.0), apply_transform: bool = True, least: int = 5, swapped: bool = True, corepoint_id: str = "corepoint_id", point_id: str = "point_id", scan_keys: Sequence[str] = ("scanpos_id",), by: Sequence[str] = ()) -> DataFrame:
    """Error-propagated distances at corepoints with directions, in one aggregate plan.

    Epoch 2 is moved by p' = R (p - x0) + t + x0, with [R | t] = transform, if apply_transform, and searched as moved.
    Cylinders are closed on all sides. Each point gets a 3x3 covariance from its scan position (looked up by scan_keys)
    and, in epoch 2, the alignment's from cxx. Per corepoint and side: the centre weighted by inverse point covariances
    and Lambda, the mean of the summed covariances. Gives distance = n . (centre1 - centre2) (the sign is opposite to
    m3c2), lodetection = sqrt(chi2 / (n' (Lambda1 + Lambda2)^-1 n)), spreads sqrt(n' Lambda n), counts and the six parts
    of cov1 and cov2. With fewer than `least` points on a side all but the counts are null. `swapped` reads the yaw and scan
    uncertainties in the reference's order.
    """
    rot = [list(map(float, r[:3])) for r in transform]
    shift = [float(r[3]) for r in transform]
    x0 = [float(v) for v in reduction_point]
    keep = [*scan_keys]

    def side(cloud: DataFrame, s: int) -> DataFrame:
        p = clean(cloud, point_id, by, keep).withColumns({f"p{a}": F.col(a) for a in AXES})
        if s == 2 and apply_transform:
            d = [F.col(f"p{a}") - o for a, o in zip(AXES, x0)]
            p = p.withColumns({a: sum(rot[k][c] * d[c] for c in range(3)) + shift[k] + x0[k] for k, a in enumerate(AXES)})
        p = p.join(if_small(scanpos.select(*scan_keys, "ox", "oy", "oz", "sigma_range", "sigma_scan", "sigma_yaw").dropDuplicates([*scan_keys]), scan=True), [*scan_keys])
        return p.select(*by, F.struct(F.lit(s).alias("side"), F.col(point_id).alias("id")).alias("_pid"), F.lit(s).alias("side"), *AXES, *[f"p{a}" for a in AXES], "ox", "oy", "oz", "sigma_range", "sigma_scan", "sigma_yaw")

    cloud = side(first, 1).unionByName(side(second, 2))
    extra = [*[f"p{a}" for a in AXES], "ox", "oy", "oz", "sigma_range", "sigma_scan", "sigma_yaw", "side"]
    pairs = cylinder_join(corepoints, cloud, radius, max_distance, corepoint_id, "_pid", by, extra, closed_ends=True)
    own, turned, aligned = _measurement(None, swapped), _measurement(rot, swapped), _alignment(cxx, x0)
    two = F.col("side") == 2
    pairs = pairs.withColumns({f"m_{k}": F.when(two, t).otherwise(o) for k, o, t in zip(linalg.PARTS, own, turned)} | {f"g_{k}": F.when(two, a).otherwise(0.0) for k, a in zip(linalg.PARTS, aligned)})
    pairs = pairs.withColumn("det", linalg.det3(*linalg.parts("m")))
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 1.0)
    safe = F.when(F.col("det") != 0, F.col("det")).otherwise(1.0)
    pairs = pairs.withColumns({f"i_{k}": F.when(F.col("det") != 0, v).otherwise(e) for k, v, e in zip(linalg.PARTS, linalg.inverse(linalg.parts("m"), safe), one)})
    d = [F.col(a) - F.col(f"q_{a}") for a in AXES]
    xx, xy, xz, yy, yz, zz = linalg.parts("i")
    weighted = (xx * d[0] + xy * d[1] + xz * d[2], xy * d[0] + yy * d[1] + yz * d[2], xz * d[0] + yz * d[1] + zz * d[2])
    keys = [*by, "_q"]
    g = pairs.groupBy(*keys, "side").agg(F.count("*").alias("n"), *[F.avg(F.col(f"m_{k}") + F.col(f"g_{k}")).alias(f"L_{k}") for k in linalg.PARTS], *[F.sum(f"i_{k}").alias(f"W_{k}") for k in linalg.PARTS], *[F.sum(w).alias(f"w_{a}") for w, a in zip(weighted, AXES)])
    g = g.withColumn("wd", linalg.det3(*linalg.parts("W")))
    g = g.withColumns({f"V_{k}": v for k, v in zip(linalg.PARTS, linalg.inverse(linalg.parts("W"), F.when(F.col("wd") != 0, F.col("wd"))))})
    vxx, vxy, vxz, vyy, vyz, vzz = linalg.parts("V")
    w = [F.col(f"w_{a}") for a in AXES]
    centre = (vxx * w[0] + vxy * w[1] + vxz * w[2], vxy * w[0] + vyy * w[1] + vyz * w[2], vxz * w[0] + vyz * w[1] + vzz * w[2])
    g = g.withColumns({f"m_{a}": c for a, c in zip(AXES, centre)})
    kept = ["n", *[f"m_{a}" for a in AXES], *[f"L_{k}" for k in linalg.PARTS]]
    both = g.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in (1, 2) for c in kept])
    base = clean(corepoints, corepoint_id, by, ["nx", "ny", "nz"]).select(*by, F.col(corepoint_id).alias("_q"), "nx", "ny", "nz")
    r = base.join(both, keys, "left")
    n = [F.col("nx"), F.col("ny"), F.col("nz")]
    enough = (F.coalesce("n_1", F.lit(0)) >= least) & (F.coalesce("n_2", F.lit(0)) >= least)

    def quad(m: list[Column]) -> Column:
        return n[0] * n[0] * m[0] + n[1] * n[1] * m[3] + n[2] * n[2] * m[5] + 2 * (n[0] * n[1] * m[1] + n[0] * n[2] * m[2] + n[1] * n[2] * m[4])

    lam = [[F.col(f"L_{k}_{s}") for k in linalg.PARTS] for s in (1, 2)]
    total = [a + b for a, b in zip(*lam)]
    r = r.withColumn("td", linalg.det3(*total))
    distance = sum(n[k] * (F.col(f"m_{a}_1") - F.col(f"m_{a}_2")) for k, a in enumerate(AXES))
    lod = F.sqrt(F.lit(CHI2_3_AT_95) / linalg.quad_inverse(total, n, F.when(F.col("td") != 0, F.col("td"))))
    out = {"distance": distance, "lodetection": lod, "spread1": F.sqrt(quad(lam[0])), "spread2": F.sqrt(quad(lam[1]))}
    cov = [F.when(enough, F.col(f"L_{k}_{s}")).alias(f"cov{s}_{k}") for s in (1, 2) for k in linalg.PARTS]
    return r.select(*by, F.col("_q").alias(corepoint_id), *[F.when(enough, v).alias(k) for k, v in out.items()], *[F.coalesce(f"n_{s}", F.lit(0)).cast("long").alias(f"num_samples{s}") for s in (1, 2)], *cov)
