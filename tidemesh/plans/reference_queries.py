"""Queries of the change-analysis operators over the whole domain tables, with their SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters, m3c2, m3c2ep, obc, octree, planes, registration, series, spatial, timeseries, voxel
from ..functions.runtime import shared_dir
from ..sources.files import cube_mesh, read_las, regular_corepoints, write_las
from ..sources.store import load_epoch, save_epoch
from .tables import POINTS, cloud, corepoints, epochs, side, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Means of numbers in thousandths often end in a 5; moved by this much, both engines round them the same way.
_NUDGE = 1e-7


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})


def nudged(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(_NUDGE), digits) + F.lit(0.0) for c in names})


BY = ["analysis_id"]
SIZE = 2.0
_VOX = "floor(x / 2e0)::bigint vx, floor(y / 2e0)::bigint vy, floor(z / 2e0)::bigint vz"
_LOCAL = f"loc as (select *, x - (vx * 2e0 + 1) ux, y - (vy * 2e0 + 1) uy, z - (vz * 2e0 + 1) uz from (select *, {_VOX} from cloud))"
_MID = {a: f"(v{a} * 2e0 + 1)" for a in "xyz"}

# --- points ------------------------------------------------------------------------------------------------------


@query(f"with {POINTS} select point_id, epoch_id, intensity from pts where return_number = number_of_returns")
def last_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "points").filter("return_number = number_of_returns")
    p = p.filter("not isnan(x) and not isnan(y) and not isnan(z) and not (x = 0 and y = 0 and z = 0)")
    return p.dropDuplicates(["point_id"]).select("point_id", "epoch_id", "intensity")


_TURN = registration.Transformation.of([[0.8, -0.6, 0, 1.5], [0.6, 0.8, 0, -2.0], [0, 0, 1, 0.25]], (320000.0, 5000000.0, 500.0))


@query(f"""with {POINTS}, d as (select point_id, x - 320000e0 dx, y - 5000000e0 dy, z - 500e0 dz from pts)
select point_id, round(0.8e0 * dx - 0.6e0 * dy + 1.5e0 + 320000e0, 4) x, round(0.6e0 * dx + 0.8e0 * dy - 2e0 + 5000000e0, 4) y, round(dz + 0.25e0 + 500e0, 4) z from d""")
def transform_points(spark: SparkSession, sf: str) -> DataFrame:
    p = cloud_all(spark, sf).select("point_id", "x", "y", "z")
    return rounded(registration.transform(p, _TURN), 4, "x", "y", "z")


def cloud_all(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "points")
    return p.filter("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z) and not (x = 0 and y = 0 and z = 0)").dropDuplicates(["point_id"])


@query(f"with {POINTS} select analysis_id, side, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 from cloud group by 1, 2")
def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return registration.bounding_boxes(cloud(spark, sf), ["analysis_id", "side"])


_SEEN = f"""{POINTS}, pos as (select distinct epoch_id, scanpos_id, ox, oy, oz, sigma_range, sigma_scan, sigma_yaw from scanpos),
rel as (select point_id, epoch_id, x, y, z, x - ox dx, y - oy dy, z - oz dz from pts join pos using (epoch_id, scanpos_id)),
sph as (select *, sqrt(dx * dx + dy * dy + dz * dz) "range", atan2(dz, sqrt(dx * dx + dy * dy)) elevation, atan2(dy, dx) azimuth from rel)"""


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    pos = table(spark, sf, "scanpos").dropDuplicates(["epoch_id", "scanpos_id"])
    return cloud_all(spark, sf).join(pos, ["epoch_id", "scanpos_id"])


@query(f"""with {_SEEN} select point_id, round("range", 6) "range", round(elevation, 6) elevation, round(azimuth, 6) azimuth from sph""")
def scan_geometry(spark: SparkSession, sf: str) -> DataFrame:
    p = filters.spherical(_seen(spark, sf), ("ox", "oy", "oz"))
    return rounded(p.select("point_id", "range", "elevation", "azimuth"), 6, "range", "elevation", "azimuth")


@query(f"""with {_SEEN} select epoch_id, round_even(degrees(elevation) / 1e0, 0)::bigint phi, round_even(degrees(azimuth) / 1e0, 0)::bigint theta, count(*) points from sph group by 1, 2, 3""")
def angular_bins(spark: SparkSession, sf: str) -> DataFrame:
    p = filters.angular_bins(_seen(spark, sf), ("ox", "oy", "oz"), 1.0)
    return p.groupBy("epoch_id", "phi", "theta").agg(F.count("*").alias("points"))


@query("select i * 40 + j corepoint_id, round(10e0 + i * (90e0 / 29), 6) x, round(20e0 + j * (60e0 / 39), 6) y, 1.5e0 z from range(30) a(i), range(40) b(j)")
def corepoint_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regular_corepoints(spark, (10.0, 20.0), (100.0, 80.0), (30, 40), 1.5), 6, "x", "y")


# --- voxels ------------------------------------------------------------------------------------------------------


@query(f"""with {POINTS}, {_LOCAL}, v as (select analysis_id, vx, vy, vz, count(*) "count", avg(ux) mx, avg(uy) my, avg(uz) mz from loc group by 1, 2, 3, 4)
select analysis_id, vx, vy, vz, "count", "count" / 8e0 density, round({_MID["x"]} + mx + 1e-7, 4) x, round({_MID["y"]} + my + 1e-7, 4) y, round({_MID["z"]} + mz + 1e-7, 4) z, {_MID["x"]} center_x, {_MID["y"]} center_y, {_MID["z"]} center_z,
round(mx + 1e-7, 4) + 0e0 local_x, round(my + 1e-7, 4) + 0e0 local_y, round(mz + 1e-7, 4) + 0e0 local_z from v""")
def voxel_moments(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel.features(cloud(spark, sf), SIZE, ["count", "density", "centroid", "voxel_center", "local_centroid"], by=BY)
    return nudged(v, 4, "x", "y", "z", "local_x", "local_y", "local_z")


@query(f'with {POINTS}, {_LOCAL} select analysis_id, vx, vy, vz, count(*) "count", ' + ", ".join(f"round({f'var_pop(u{a})' if a == b else f'covar_pop(u{a}, u{b})'}, 5) + 0e0 c_{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))) + " from loc group by 1, 2, 3, 4")
def voxel_covariance(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel.features(cloud(spark, sf), SIZE, ["count", "covariance"], by=BY)
    return rounded(v, 5, *[c for c in v.columns if c.startswith("c_")])


_EIG = f"""{_LOCAL}, m as (select analysis_id, vx, vy, vz, count(*) n, var_pop(ux) xx, covar_pop(ux, uy) xy, covar_pop(ux, uz) xz, var_pop(uy) yy, covar_pop(uy, uz) yz, var_pop(uz) zz from loc group by 1, 2, 3, 4),
q as (select *, (xx + yy + zz) / 3 q from m), p as (select *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) p from q),
d as (select *, case when p > 0 then p else 1 end s from p), f as (select *, acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (s * s * s) / 2, -1), 1)) / 3 f from d),
e as (select *, q + 2 * p * cos(f) a, q + 2 * p * cos(f + 2 * pi() / 3) c from f), l as (select analysis_id, vx, vy, vz, n, greatest(a, 0) l1, greatest(3 * q - a - c, 0) l2, greatest(c, 0) l3 from e)"""


@query(f"""with {POINTS}, {_EIG}
select analysis_id, vx, vy, vz, n "count", round(coalesce((l1 - l2) / nullif(l1, 0), 0), 4) + 0e0 linearity, round(coalesce((l2 - l3) / nullif(l1, 0), 0), 4) + 0e0 planarity, round(coalesce(l3 / nullif(l1, 0), 0), 4) + 0e0 sphericity, round(l1 + l2 + l3, 4) sum_of_eigenvalues,
round(coalesce((l1 - l3) / nullif(l1, 0), 0), 4) + 0e0 anisotropy, round(coalesce(l3 / nullif(l1 + l2 + l3, 0), 0), 4) surface_variation from l""")
def voxel_shape(spark: SparkSession, sf: str) -> DataFrame:
    names = ["linearity", "planarity", "sphericity", "sum_of_eigenvalues", "anisotropy", "surface_variation"]
    v = voxel.features(cloud(spark, sf), SIZE, ["count", *names], by=BY)
    return rounded(v, 4, *names)


@query(f"""with {POINTS}, {_EIG}, t as (select *, nullif(l1 + l2 + l3, 0) s from l)
select analysis_id, vx, vy, vz, n "count", round(l1, 4) l1, round(l2, 4) l2, round(l3, 4) l3, round(pow(l1 * l2 * l3, 1e0 / 3), 3) omnivariance,
round(-({" + ".join(f"case when l{k} > 0 then coalesce(l{k} / s, 0) * ln(l{k} / s) else 0 end" for k in (1, 2, 3))}) + 0e0, 4) + 0e0 eigenentropy from t""")
def voxel_entropy(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel.features(cloud(spark, sf), SIZE, ["count", "eigenvalues", "omnivariance", "eigenentropy"], by=BY)
    return rounded(rounded(v, 4, "l1", "l2", "l3", "eigenentropy"), 3, "omnivariance")


def _argmin(at: str) -> str:
    d = " + ".join(f"(u{a} - {c}) * (u{a} - {c})" for a, c in zip("xyz", at.split()))
    return f"""with {POINTS}, {_LOCAL}, h as (select *, avg(ux) over w mx, avg(uy) over w my, avg(uz) over w mz from loc window w as (partition by analysis_id, vx, vy, vz)),
r as (select *, row_number() over (partition by analysis_id, vx, vy, vz order by {d}, point_id) k from h) select analysis_id, vx, vy, vz, point_id from r where k = 1"""


@query(_argmin("0 0 0"))
def voxel_closest_to_center(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.reduce(cloud(spark, sf), SIZE, "closest_to_center", by=BY).select("analysis_id", "vx", "vy", "vz", "point_id")


@query(_argmin("mx my mz"))
def voxel_closest_to_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.reduce(cloud(spark, sf), SIZE, "closest_to_centroid", by=BY).select("analysis_id", "vx", "vy", "vz", "point_id")


@query(f'with {POINTS}, {_LOCAL} select analysis_id, vx, vy, vz, round({_MID["x"]} + avg(ux) + 1e-7, 4) x, round({_MID["y"]} + avg(uy) + 1e-7, 4) y, round({_MID["z"]} + avg(uz) + 1e-7, 4) z, round(avg(intensity), 6) intensity, count(*) "count" from loc group by 1, 2, 3, 4')
def voxel_mean_points(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel.reduce(cloud(spark, sf), SIZE, "centroid", averaged=["intensity"], by=BY)
    return rounded(nudged(v, 4, "x", "y", "z"), 6, "intensity")


_TWO = f"""{POINTS}, a as (select distinct analysis_id, {_VOX} from cloud where side = 1), b as (select distinct analysis_id, {_VOX} from cloud where side = 2)"""


@query(f"with {_TWO} select analysis_id, vx, vy, vz, (case when b.vx is null then 1 when a.vx is null then 2 else 3 end)::tinyint change_type, vx * 2e0 + 1 x, vy * 2e0 + 1 y, vz * 2e0 + 1 z from a full join b using (analysis_id, vx, vy, vz)".replace("b.vx is null", "kb is null").replace("a.vx is null", "ka is null").replace("from a full join b", "from (select *, 1 ka from a) full join (select *, 1 kb from b)"))
def voxel_delta(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    return voxel.delta(side(c, 1), side(c, 2), SIZE, by=BY)


def _mask_sql(kind: str) -> str:
    return f"with {_TWO}, p as (select point_id, analysis_id, {_VOX} from cloud where side = 2) select point_id, analysis_id from p {kind} join a using (analysis_id, vx, vy, vz)"


@query(_mask_sql("semi"))
def voxel_mask_inside(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    return voxel.select_by_mask(side(c, 2), side(c, 1), SIZE, True, by=BY).select("point_id", "analysis_id")


@query(_mask_sql("anti"))
def voxel_mask_outside(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    return voxel.select_by_mask(side(c, 2), side(c, 1), SIZE, False, by=BY).select("point_id", "analysis_id")


@query(f"with {POINTS}, v as (select point_id, analysis_id, {_VOX} from cloud) select point_id, count(*) over (partition by analysis_id, vx, vy, vz) \"count\" from v")
def voxel_map_back(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    return voxel.map_back(c, voxel.features(c, SIZE, ["count"], by=BY), SIZE, ["count"], by=BY).select("point_id", "count")


def _inverse_quad(s: str) -> str:
    xx, xy, xz, yy, yz, zz = (f"{s}.{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    det = f"({xx} * ({yy} * {zz} - {yz} * {yz}) - {xy} * ({xy} * {zz} - {yz} * {xz}) + {xz} * ({xy} * {yz} - {yy} * {xz}))"
    return f"greatest((dx * dx * ({yy} * {zz} - {yz} * {yz}) + dy * dy * ({xx} * {zz} - {xz} * {xz}) + dz * dz * ({xx} * {yy} - {xy} * {xy}) + 2 * (dx * dy * ({xz} * {yz} - {xy} * {zz}) + dx * dz * ({xy} * {yz} - {xz} * {yy}) + dy * dz * ({xy} * {xz} - {xx} * {yz}))) / {det}, 0)"


_SIDE = "select analysis_id, vx, vy, vz, 1 k, count(*) n, avg(ux) mx, avg(uy) my, avg(uz) mz, var_pop(ux) xx, covar_pop(ux, uy) xy, covar_pop(ux, uz) xz, var_pop(uy) yy, covar_pop(uy, uz) yz, var_pop(uz) zz from loc where side = %d group by 1, 2, 3, 4"
_MAHA = f"""with {POINTS}, {_LOCAL}, a0 as ({_SIDE % 1}), b0 as ({_SIDE % 2}),
a as (select * replace (xx + (xx + yy + zz + 1e-6) * 1e-6 as xx, yy + (xx + yy + zz + 1e-6) * 1e-6 as yy, zz + (xx + yy + zz + 1e-6) * 1e-6 as zz) from a0),
b as (select * replace (xx + (xx + yy + zz + 1e-6) * 1e-6 as xx, yy + (xx + yy + zz + 1e-6) * 1e-6 as yy, zz + (xx + yy + zz + 1e-6) * 1e-6 as zz) from b0),
j as (select analysis_id, vx, vy, vz, a, b, a.mx - b.mx dx, a.my - b.my dy, a.mz - b.mz dz from a full join b using (analysis_id, vx, vy, vz)),
m as (select analysis_id, vx, vy, vz, case when b.k is null then 1 when a.k is null then 2 else 3 end::tinyint change_type, coalesce(a.n, 0) na, coalesce(b.n, 0) nb, case when a.k is not null and b.k is not null then greatest({_inverse_quad("a")}, {_inverse_quad("b")}) end d from j)
select analysis_id, vx, vy, vz, change_type, (d > 0.024297585815692576)::int significance, (change_type <> 3 or na < 4 or nb < 4 or coalesce(d > 0.024297585815692576, false))::int changed from m"""


@query(_MAHA)
def voxel_change(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    v = voxel.mahalanobis(side(c, 1), side(c, 2), SIZE, min_points=4, by=BY)
    return v.select("analysis_id", "vx", "vy", "vz", "change_type", "significance", "changed")


@query(_MAHA[: _MAHA.rindex("select analysis_id")] + "select analysis_id, vx, vy, vz, round(d, case when d < 1e6 then 3 else -3 end) mahalanobis from m")
def voxel_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    v = voxel.mahalanobis(side(c, 1), side(c, 2), SIZE, min_points=4, by=BY)
    return v.select("analysis_id", "vx", "vy", "vz", F.when(F.col("mahalanobis") < 1e6, F.round("mahalanobis", 3)).otherwise(F.round("mahalanobis", -3)).alias("mahalanobis"))


@query()
def voxel_p_values(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    v = voxel.mahalanobis(side(c, 1), side(c, 2), SIZE, min_points=4, by=BY)
    return rounded(v.select("analysis_id", "vx", "vy", "vz", "p_value"), 6, "p_value")


@query(f"with {POINTS} select count(*) vertices, round(sum(vx * 2e0 + 1 + dx), 3) sum_x, 0::bigint + 12 * (count(*) // 8) faces from (select distinct analysis_id, {_VOX} from cloud), (values (-1e0), (1e0)) t(dx), range(4)")
def voxel_mesh(spark: SparkSession, sf: str) -> DataFrame:
    v = voxel.features(cloud(spark, sf), SIZE, ["voxel_center"], by=BY).select("vx", "vy", "vz", *[F.col(f"center_{a}").alias(a) for a in "xyz"])
    corners, faces = cube_mesh(v, SIZE)
    return corners.agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 3).alias("sum_x")).crossJoin(F.broadcast(faces.agg(F.count("*").alias("faces"))))  # two single rows


# --- spatial joins -----------------------------------------------------------------------------------------------

_D2 = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)"


@query(f"with {POINTS}, d as (select analysis_id, corepoint_id, point_id, {_D2} d2 from core c join cloud p using (analysis_id)) select analysis_id, corepoint_id, point_id, round(sqrt(d2), 6) distance from d where d2 < 1e0")
def radius_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    c = spatial.radius_join(corepoints(spark, sf), cloud(spark, sf), 1.0, "corepoint_id", "point_id", BY)
    return rounded(c.select("analysis_id", F.col("_q").alias("corepoint_id"), "point_id", F.sqrt("d2").alias("distance")), 6, "distance")


@query(f"with {POINTS} select a.analysis_id, a.corepoint_id corepoint_a, b.corepoint_id corepoint_b from core a join core b on a.analysis_id = b.analysis_id and a.corepoint_id < b.corepoint_id where (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 25e0")
def corepoint_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    c = corepoints(spark, sf)
    e = spatial.radius_join(c, c.withColumnRenamed("corepoint_id", "corepoint_b"), 5.0, "corepoint_id", "corepoint_b", BY, strict=False)
    return e.filter("_q < corepoint_b").select("analysis_id", F.col("_q").alias("corepoint_a"), "corepoint_b")


_CYL = f"""{POINTS}, axes as (select * from core where isfinite(nx) and isfinite(ny) and isfinite(nz)),
cand as (select c.analysis_id, c.corepoint_id, p.point_id, p.side, p.epoch_idx, c.nx * (p.x - c.x) + c.ny * (p.y - c.y) + c.nz * (p.z - c.z) along, {_D2} d2 from axes c join cloud p on c.analysis_id = p.analysis_id and abs(p.x - c.x) < 4 and abs(p.y - c.y) < 4),
cyl as (select * from cand where d2 - along * along <= 1e0 and abs(along) < 3e0)"""


@query(f"with {_CYL} select analysis_id, corepoint_id, point_id, round(along, 6) + 0e0 along from cyl")
def cylinder_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    c = spatial.cylinder_join(corepoints(spark, sf), cloud(spark, sf), 1.0, 3.0, "corepoint_id", "point_id", BY)
    return rounded(c.select("analysis_id", F.col("_q").alias("corepoint_id"), "point_id", "along"), 6, "along")


_KNN = f"""{POINTS}, d as (select c.analysis_id, c.corepoint_id, p.point_id, {_D2} d2 from core c join cloud p on c.analysis_id = p.analysis_id),
k as (select *, row_number() over (partition by analysis_id, corepoint_id order by d2, point_id) r from d)"""


@query(f"with {_KNN} select analysis_id, corepoint_id, point_id, round(sqrt(d2), 6) distance, r::int rank from k where r <= 6")
def nearest_points(spark: SparkSession, sf: str) -> DataFrame:
    k = spatial.knn(corepoints(spark, sf), cloud(spark, sf), 6, "corepoint_id", "point_id", BY)
    return rounded(k.select("analysis_id", "corepoint_id", "point_id", F.sqrt("d2").alias("distance"), "rank"), 6, "distance")


_C2C = f"""{POINTS}, f as (select a.analysis_id, a.point_id source_id, b.point_id target_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) d2 from cloud a join cloud b on a.analysis_id = b.analysis_id and a.side = 1 and b.side = 2),
fw as (select * from (select *, row_number() over (partition by analysis_id, source_id order by d2, target_id) r from f) where r = 1 and d2 <= 9e0),
bw as (select * from (select *, row_number() over (partition by analysis_id, target_id order by d2, source_id) r from f) where r = 1 and d2 <= 9e0)"""


def _two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = cloud(spark, sf)
    return side(c, 1).withColumnRenamed("point_id", "source_id"), side(c, 2).withColumnRenamed("point_id", "target_id")


@query(f"with {_C2C} select c.analysis_id, point_id source_id, target_id, round(sqrt(d2), 6) distance from cloud c left join fw on c.analysis_id = fw.analysis_id and c.point_id = fw.source_id where side = 1")
def c2c_distances(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_sides(spark, sf)
    return rounded(filters.c2c(a, b, max_distance=3.0, by=BY), 6, "distance")


@query(f"with {_C2C}, m as (select fw.* from fw join bw using (analysis_id, source_id, target_id)) select c.analysis_id, point_id source_id, target_id, round(sqrt(d2), 6) distance from cloud c left join m on c.analysis_id = m.analysis_id and c.point_id = m.source_id where side = 1")
def c2c_mutual(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_sides(spark, sf)
    return rounded(filters.c2c(a, b, max_distance=3.0, both_ways=True, by=BY), 6, "distance")


@query(f"""with {POINTS}, d as (select a.analysis_id, a.side, a.point_id, b.point_id other, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) d2 from cloud a join cloud b on a.analysis_id = b.analysis_id and a.side = b.side and a.point_id <> b.point_id),
k as (select *, row_number() over (partition by analysis_id, side, point_id order by d2, other) r from d), m as (select analysis_id, side, point_id, avg(sqrt(d2)) m from k where r <= 6 group by 1, 2, 3),
a as (select c.analysis_id, c.side, c.point_id, coalesce(m, 0) m from cloud c left join m using (analysis_id, side, point_id)), l as (select analysis_id, side, avg(m) + stddev_pop(m) l from a group by 1, 2)
select analysis_id, side, point_id, round(m, 6) mean_distance, m > l outlier from a join l using (analysis_id, side)""")
def sor_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(filters.sor(cloud(spark, sf), 6, 1.0, by=["analysis_id", "side"]), 6, "mean_distance")


@query(f"""with {_SEEN}, b as (select *, "range" rng, round_even(degrees(elevation) / 1e0, 0)::bigint phi, round_even(degrees(azimuth) / 1e0, 0)::bigint theta from (select sph.*, pts.scanpos_id from sph join pts using (point_id))),
o as (select i, j, tan(radians(1e0) * sqrt(i * i + j * j)) t from range(-1, 2) a(i), range(-1, 2) b(j) where i <> 0 or j <> 0),
n as (select q.point_id, avg(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) observed from b q, o join b p on p.epoch_id = q.epoch_id and p.scanpos_id = q.scanpos_id and p.phi = q.phi + i and p.theta = q.theta + j group by 1)
select b.epoch_id, b.scanpos_id, b.point_id, round(least(greatest(rng * (select avg(t) from o) / (case when coalesce(observed, 99999) = 0 then 1e-6 else coalesce(observed, 99999e0) end), 0), 1), 5) score from b left join n using (point_id)""")
def scor_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every point's score as seen from the position it was scanned from."""
    return rounded(filters.scor(_seen(spark, sf), ("ox", "oy", "oz"), 1.0, 1, by=["epoch_id", "scanpos_id"]), 5, "score")


# --- M3C2 --------------------------------------------------------------------------------------------------------

_LOD = "round(1.96 * (sqrt(s1 * s1 / n1 + s2 * s2 / n2) + 0.05), 5) lodetection"
_OUT = f"""select c.analysis_id, c.corepoint_id, round(v2 - v1, 6) + 0e0 distance, case when v1 is not null and v2 is not null then {_LOD.removesuffix(" lodetection")} end lodetection, round(s1, 5) spread1, coalesce(n1, 0) num_samples1, round(s2, 5) spread2, coalesce(n2, 0) num_samples2 from core c left join w using (analysis_id, corepoint_id)"""
_WIDE = "w as (select analysis_id, corepoint_id, max(v) filter (side = 1) v1, max(s) filter (side = 1) s1, max(n) filter (side = 1) n1, max(v) filter (side = 2) v2, max(s) filter (side = 2) s2, max(n) filter (side = 2) n2 from g group by 1, 2)"


@query(f"with {_CYL}, g as (select analysis_id, corepoint_id, side, avg(along) v, stddev_samp(along) s, count(*) n from cyl group by 1, 2, 3), {_WIDE} {_OUT}")
def m3c2_mean(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    d = m3c2.m3c2(corepoints(spark, sf), side(c, 1), side(c, 2), 1.0, 3.0, 0.05, by=BY)
    return rounded(rounded(d, 5, "lodetection", "spread1", "spread2"), 6, "distance")


_SORTED = "t as (select analysis_id, corepoint_id, side, list_sort(list(along)) l, count(*) n from cyl group by 1, 2, 3), g as (select analysis_id, corepoint_id, side, n, case when n % 2 = 1 then l[n // 2 + 1] else (l[n // 2] + l[n // 2 + 1]) / 2 end v, case when n % 4 = 0 then (l[3 * n // 4] + l[3 * n // 4 + 1]) / 2 - (l[n // 4] + l[n // 4 + 1]) / 2 else l[3 * n // 4 + 1] - l[n // 4 + 1] end s from t)"


@query(f"with {_CYL}, {_SORTED}, {_WIDE} {_OUT}")
def m3c2_median(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    d = m3c2.m3c2(corepoints(spark, sf), side(c, 1), side(c, 2), 1.0, 3.0, 0.05, robust=True, by=BY)
    return rounded(rounded(d, 5, "lodetection", "spread1", "spread2"), 6, "distance")


@query(f"with {_CYL}, g as (select analysis_id, corepoint_id, side, avg(along) v, stddev_samp(along) s, count(*) n from cyl group by 1, 2, 3), {_WIDE} select analysis_id, corepoint_id, round(v2 - v1, 6) distance from w where abs(v2 - v1) > 1.96 * (sqrt(s1 * s1 / n1 + s2 * s2 / n2) + 0.05)")
def m3c2_significant(spark: SparkSession, sf: str) -> DataFrame:
    c = cloud(spark, sf)
    d = m3c2.significant(m3c2.m3c2(corepoints(spark, sf), side(c, 1), side(c, 2), 1.0, 3.0, 0.05, by=BY))
    return rounded(d.select("analysis_id", "corepoint_id", "distance"), 6, "distance")


@query(f"""with {_CYL}, g as (select analysis_id, corepoint_id, epoch_idx, avg(along) v, stddev_samp(along) s, count(*) n from cyl group by 1, 2, 3), r as (select analysis_id, corepoint_id, v v1, s s1, n n1 from g where epoch_idx = 0)
select analysis_id, corepoint_id, epoch_idx, round(v - v1, 6) + 0e0 distance, coalesce(n1, 0) num_samples1, n num_samples2 from g left join r using (analysis_id, corepoint_id)""")
def m3c2_series(spark: SparkSession, sf: str) -> DataFrame:
    d = m3c2.m3c2_series(corepoints(spark, sf), cloud(spark, sf), "epoch_idx", 0, 1.0, 3.0, by=BY)
    return rounded(d.select("analysis_id", "corepoint_id", "epoch_idx", "distance", "num_samples1", "num_samples2"), 6, "distance")


@query()
def m3c2_directions(spark: SparkSession, sf: str) -> DataFrame:
    d = m3c2.directions(corepoints(spark, sf), cloud(spark, sf), [0.5, 1.0, 2.0], by=BY)
    return rounded(d, 4, "nx", "ny", "nz")


@query()
def point_normals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m3c2.normals(cloud(spark, sf), 1.0, by=BY), 4, "nx", "ny", "nz")


@query()
def m3c2_error_propagated(spark: SparkSession, sf: str) -> DataFrame:
    c, core = cloud(spark, sf), corepoints(spark, sf)
    small = [[1e-10 if i == j else 0.0 for j in range(12)] for i in range(12)]
    same = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    d = m3c2ep.m3c2ep(core, side(c, 1), side(c, 2), table(spark, sf, "scanpos"), 1.5, 3.0, same, small, (320000.0, 5000000.0, 500.0), least=3, scan_keys=("epoch_id", "scanpos_id"), by=BY)
    return rounded(d.select("analysis_id", "corepoint_id", "distance", "lodetection", "spread1", "spread2", "num_samples1", "num_samples2"), 5, "distance", "lodetection", "spread1", "spread2")


@query(_MAHA[: _MAHA.rindex("select analysis_id")].replace(POINTS, POINTS.replace("cloud as (", "cloud as materialized (")) + f""", hot as (select distinct analysis_id, vx, vy, vz from m where change_type <> 3 or na < 4 or nb < 4 or coalesce(d > 0.024297585815692576, false)),
kept as (select p.* from (select *, {_VOX} from cloud) p semi join hot using (analysis_id, vx, vy, vz)), {_CYL[len(POINTS) + 2:].replace("join cloud p", "join kept p")}, g as (select analysis_id, corepoint_id, side, avg(along) v, stddev_samp(along) s, count(*) n from cyl group by 1, 2, 3), {_WIDE} {_OUT}""")
def hierarchical_change(spark: SparkSession, sf: str) -> DataFrame:
    """M3C2 only where voxels changed significantly."""
    c = cloud(spark, sf)
    v = voxel.mahalanobis(side(c, 1), side(c, 2), SIZE, min_points=4, by=BY).filter("changed = 1")
    kept = voxel.select_by_mask(c, v, SIZE, True, by=BY)
    d = m3c2.m3c2(corepoints(spark, sf), side(kept, 1), side(kept, 2), 1.0, 3.0, 0.05, by=BY)
    return rounded(rounded(d, 5, "lodetection", "spread1", "spread2"), 6, "distance")


# --- segments ----------------------------------------------------------------------------------------------------


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    return cloud(spark, sf).withColumn("segment_id", F.floor(F.col("x") / 4) * 10_000_000 + F.floor(F.col("y") / 4))


def _named(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Segmented points with `name`: analysis_id * 10^15 + segment_id, a bigint where those of all analyses fit into one, else a decimal of 38 digits."""
    s = _segmented(spark, sf)
    most = table(spark, sf, "analyses").agg(F.max(F.abs("analysis_id"))).first()[0] or 0
    kind = "bigint" if most < 9223 else "decimal(38,0)"
    return s.withColumn(name, (F.col("analysis_id").cast(kind) * F.lit(1_000_000_000_000_000).cast(kind) + F.col("segment_id").cast(kind)).cast(kind))


_SEG = f"{POINTS}, seg as (select *, floor(x / 4e0)::bigint * 10000000 + floor(y / 4e0)::bigint segment_id from cloud), m as (select analysis_id, side, segment_id, count(*) n, avg(x) x, avg(y) y, avg(z) z from seg group by 1, 2, 3 having count(*) >= 3)"


@query(f"with {_SEG} select analysis_id, side, segment_id, n num_points, round(x + 1e-7, 4) x, round(y + 1e-7, 4) y, round(z + 1e-7, 4) z from m")
def segment_centres(spark: SparkSession, sf: str) -> DataFrame:
    m = planes.segment_metrics(_segmented(spark, sf), by=["analysis_id", "side"])
    return nudged(m.select("analysis_id", "side", "segment_id", "num_points", "x", "y", "z"), 4, "x", "y", "z")


@query()
def segment_shapes(spark: SparkSession, sf: str) -> DataFrame:
    m = planes.segment_metrics(_segmented(spark, sf), by=["analysis_id", "side"])
    return rounded(m.drop("x", "y", "z"), 4, "nx", "ny", "nz", "linearity", "planarity", "sphericity", "roughness")


@query(f"with {_SEG}, s as (select distinct side, analysis_id * 1000000000000000 + segment_id segment_id from seg) select side - 1 epoch, segment_id, row_number() over (order by side, segment_id) new_id from s")
def segment_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = _named(spark, sf, "segment_id")
    return planes.global_ids(side(s, 1), side(s, 2))


@query(f"""with {_SEG}, d as (select a.analysis_id, a.segment_id id0, b.segment_id id1, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) d2 from m a join m b on a.analysis_id = b.analysis_id and a.side = 1 and b.side = 2),
f as (select *, row_number() over (partition by analysis_id, id0 order by d2, id1) r, row_number() over (partition by analysis_id, id1 order by d2, id0) s from d) select analysis_id, id0, id1 from f where r = 1 and s = 1 and d2 <= 9e0""")
def segment_matches(spark: SparkSession, sf: str) -> DataFrame:
    s = _segmented(spark, sf)
    a, b = (planes.segment_metrics(side(s, k), by=BY) for k in (1, 2))
    return planes.nearest_segments(a, b, 3.0, True, by=BY)


@query()
def segment_distances(spark: SparkSession, sf: str) -> DataFrame:
    s = _segmented(spark, sf)
    return rounded(planes.pbm3c2(side(s, 1), side(s, 2), 3.0, by=BY), 5, "distance", "uncertainty")


@query()
def segment_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Random forest correspondences; the labels are same cell and other cell."""
    s = _segmented(spark, sf)
    a, b = (planes.segment_metrics(side(s, k), by=BY) for k in (1, 2))
    pairs = planes.candidates(a, b, 6.0, by=BY)
    labelled = pairs.withColumn("label", (F.col("id0") == F.col("id1")).cast("int"))
    return planes.pbm3c2(side(s, 1), side(s, 2), 6.0, labelled, "random_forest", by=BY).select("analysis_id", "id0", "id1")


# --- series ------------------------------------------------------------------------------------------------------

_HELD = "held as (select corepoint_id, epoch_idx, arg_max(analysis_id, ingested_at) analysis_id, arg_max(struct_pack(v := distance), ingested_at).v distance from distances group by 1, 2), readings as (select * from held where distance is not null and not isnan(distance))"


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return series.readings(table(spark, sf, "distances")).select("analysis_id", "corepoint_id", "epoch_idx", "distance")


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.densify(_readings(spark, sf), epochs(spark, sf))


@query(f"with {_HELD} select * from readings")
def valid_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf)


@query(f"with {_HELD}, u as (select *, case when epoch_idx < (select max(epoch_idx) from readings) then distance end v from readings) select corepoint_id, epoch_idx, round(median(v) over (partition by corepoint_id order by epoch_idx range between 12 preceding and 11 following), 9) distance from u")
def smoothed_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.temporal_averaging(_readings(spark, sf), 24), 9, "distance")


_DENSE = f"{_HELD}, k as (select distinct analysis_id, corepoint_id from readings), e as (select distinct analysis_id, epoch_idx from epochs join analyses using (analysis_id)), dense as (select k.analysis_id, k.corepoint_id, e.epoch_idx, r.distance from k join e using (analysis_id) left join readings r on r.corepoint_id = k.corepoint_id and r.epoch_idx = e.epoch_idx)"


@query(f"""with {_DENSE}, s as (select *, count(distance) over (partition by corepoint_id) n, last_value(case when distance is not null then struct_pack(t := epoch_idx::double, v := distance) end ignore nulls) over (partition by corepoint_id order by epoch_idx rows between unbounded preceding and current row) a,
first_value(case when distance is not null then struct_pack(t := epoch_idx::double, v := distance) end ignore nulls) over (partition by corepoint_id order by epoch_idx rows between current row and unbounded following) b from dense)
select analysis_id, corepoint_id, epoch_idx, round(case when n >= 3 then coalesce(distance, a.v + (b.v - a.v) * (epoch_idx - a.t) / nullif(b.t - a.t, 0), a.v, b.v) else distance end, 9) distance from s""")
def filled_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.fill_gaps(_dense(spark, sf)), 9, "distance")


@query("with e as (select distinct epoch_id, analysis_id, epoch_idx, ts from epochs join (select distinct analysis_id from analyses) using (analysis_id)) select epoch_id, analysis_id, epoch_idx, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by analysis_id)) / 1e6, 3) delta_seconds from e")
def epoch_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.time_deltas(epochs(spark, sf)).select("epoch_id", "analysis_id", "epoch_idx", "delta_seconds"), 3, "delta_seconds")


@query(f"with {_HELD} select corepoint_id, round(max(distance) filter (epoch_idx = 10) - max(distance) filter (epoch_idx = 0), 6) change from readings where epoch_idx in (0, 10) group by 1")
def change_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.magnitude(_readings(spark, sf), 0, 10), 6, "change")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.arrays(timeseries.fill_gaps(_dense(spark, sf)))


@query()
def change_points(spark: SparkSession, sf: str) -> DataFrame:
    s = timeseries.with_change_points(_series(spark, sf), 8, 4, 1, 0.05)
    return s.select("analysis_id", "corepoint_id", F.explode("change_points").alias("change_point"))


_SEEDS = {"width": 8, "min_size": 4, "penalty": 0.05, "minperiod": 6, "height": 0.05}


@query()
def change_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.find_seeds(_series(spark, sf), **_SEEDS)


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, c = _series(spark, sf), corepoints(spark, sf)
    return timeseries.seed_scores(timeseries.find_seeds(s, **_SEEDS), s, c, 20.0), s, c


@query()
def seed_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ranked(spark, sf)[0], 6, "score")


@query()
def objects_by_change(spark: SparkSession, sf: str) -> DataFrame:
    seeds, s, c = _ranked(spark, sf)
    return rounded(obc.objects_by_change(seeds, s, c, 20.0, least=3), 6, "dtw")


@query()
def series_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """k-means of each analysis' series over all its epochs, with the median of each cluster's distances by epoch."""
    return rounded(timeseries.cluster_medians(_readings(spark, sf), timeseries.kmeans(_series(spark, sf), 5, by=BY), by=BY), 6, "median")


@query()
def series_components(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components of each analysis' series over all its epochs."""
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy("epoch_idx")) - 1
    e = epochs(spark, sf).select("analysis_id", "epoch_idx").distinct().withColumn("place", place)
    p = timeseries.pca(_series(spark, sf), 3, by=BY).withColumnRenamed("epoch_idx", "place").join(e, ["analysis_id", "place"])
    return rounded(p.select("analysis_id", "component", "epoch_idx", "loading"), 4, "loading")


# --- octree ------------------------------------------------------------------------------------------------------

def _spread_ctes() -> str:
    """Each step in a select of its own, so that expressions stay short."""
    out, src = [], "cell"
    for k, (s, m) in enumerate(((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))):
        out.append(f"b{k} as (select point_id, " + ", ".join(f"({a} | ({a} << {s})) & {m} {a}" for a in ("ix", "iy", "iz")) + f" from {src})")
        src = f"b{k}"
    return ", ".join(out)


_OCT = f"""{POINTS}, lim as (select {", ".join(f"min({a}) lo{a}, max({a}) hi{a}, case when max({a}) > min({a}) then pow(2e0, ceil(log2(max({a}) - min({a})))) else 1e0 end s{a}" for a in "xyz")} from pts),
cell as (select point_id, {", ".join(f"least(greatest(floor(({a} - ((hi{a} + lo{a}) / 2 - s{a} / 2)) / s{a} * 1024), 0), 1023)::bigint i{a}" for a in "xyz")} from pts, lim), {_spread_ctes()},
keys as (select point_id, ix | (iy << 1) | (iz << 2) zkey from b3)"""


@query(f"with {_OCT} select point_id, zkey from keys")
def morton_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = cloud_all(spark, sf)
    return p.select("point_id", octree.morton(octree.bounding_box(p)).alias("zkey"))


@query(f"with {_OCT}, c as (select l level, zkey >> (3 * (10 - l))::int cell, count(*) n from keys, range(11) t(l) group by 1, 2) select level::int level, count(*) cells, max(n)::bigint max_points, round(avg(n), 4) mean_points, round(stddev_pop(n), 4) std_points from c group by 1")
def octree_levels(spark: SparkSession, sf: str) -> DataFrame:
    p = cloud_all(spark, sf)
    return rounded(octree.level_statistics(p, octree.morton(octree.bounding_box(p))), 4, "mean_points", "std_points")


@query(f"with {_OCT} select zkey >> 9 cell, count(*) points from keys group by 1")
def octree_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = cloud_all(spark, sf)
    return octree.cells(p, octree.morton(octree.bounding_box(p)), 7)


# --- regions, registration ---------------------------------------------------------------------------------------


@query()
def supervoxel_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of every side of every analysis."""
    p = cloud(spark, sf).filter("nx is not null and ny is not null and nz is not null")
    s = registration.supervoxels(p, 4.0, 20, by=["analysis_id", "side"])
    return s.groupBy("analysis_id", "side", "supervoxel_id").agg(F.count("*").alias("points"))


@query()
def icp_recovers(spark: SparkSession, sf: str) -> DataFrame:
    """The motion found between the corepoints and a slightly moved copy of them."""
    core = corepoints(spark, sf).select(F.col("corepoint_id").alias("point_id"), "x", "y", "z")
    r = core.agg(*[F.avg(a) for a in "xyz"]).first()
    moved = registration.transform(core, registration.Transformation.of([[1, 0, 0, 0.04], [0, 1, 0, -0.03], [0, 0, 1, 0.05]], tuple(r)))
    t = registration.icp(core, moved, 10, 1e-6, tuple(r))
    return spark.createDataFrame([(i, *[round(v, 3) + 0.0 for v in row]) for i, row in enumerate(t.matrix)], "row int, a double, b double, c double, t double")


@query(f"with {_OCT}, full_cells as (select zkey >> 12 cell from keys group by 1 having count(*) >= 100) select point_id, zkey >> 12 cell from keys where zkey >> 12 in (select cell from full_cells)")
def octree_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the cells of level 6 that hold at least 100."""
    p = cloud_all(spark, sf)
    key = octree.morton(octree.bounding_box(p))
    return octree.in_cells(p, key, octree.cells(p, key, 6).filter("points >= 100"), 6).select("point_id", "cell")


_ENDS = ", ".join(f"{f}(struct_pack(k := {a}, p := point_id, x := x, y := y, z := z)).{c} {f}_{a}_{c}" for a in "xyz" for f in ("max", "min") for c in "xyz")


@query(f"with {_SEG}, p as (select analysis_id * 1000000000000000 + segment_id supervoxel_id, point_id, x, y, z from seg where side = 1) select supervoxel_id, count(*) points, {_ENDS} from p group by 1 having count(*) >= 5")
def patch_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """The six extreme points of every segment of the first side."""
    s = side(_named(spark, sf, "supervoxel_id"), 1)
    shapes = registration.patch_shapes(s, least=5)
    ends = [F.col("ends")[k][c].alias(f"{f}_{a}_{c}") for k, (a, f) in enumerate((a, f) for a in "xyz" for f in ("max", "min")) for c in "xyz"]
    return shapes.select("supervoxel_id", "points", *ends)


@query(f"with {POINTS} select count(*)::bigint supervoxels from (select distinct floor((x - x0) / 4e0), floor((y - y0) / 4e0), floor((z - z0) / 4e0) from pts, (select min(x) x0, min(y) y0, min(z) z0 from pts))")
def supervoxel_count(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(registration.supervoxel_count(cloud_all(spark, sf), 4.0),)], "supervoxels long")


@query(f"""with {POINTS}, d as (select c.corepoint_id, p.nx, p.ny, p.nz, c.x - p.x dx, c.y - p.y dy, c.z - p.z dz, {_D2} d2, row_number() over (partition by c.corepoint_id order by {_D2}, p.point_id) r from core c, pts p)
select corepoint_id, round(coalesce(case when isfinite(nx) and isfinite(ny) and isfinite(nz) then abs(dx * nx + dy * ny + dz * nz) / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0) end, sqrt(d2)), 5) gap, round(sqrt(d2), 5) distance from d where r = 1""")
def plane_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every corepoint to the plane of the point nearest to it, of all analyses."""
    points = cloud_all(spark, sf).select("point_id", "x", "y", "z", "nx", "ny", "nz")
    return rounded(registration.plane_gap(corepoints(spark, sf).select("corepoint_id", "x", "y", "z"), "corepoint_id", points, "point_id"), 5, "gap", "distance")


@query(f"with {POINTS}, n as (select b.point_id, min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) d2 from cloud a, cloud b where a.side = 1 and b.side = 2 group by 1) select round(avg(sqrt(d2)) + stddev_pop(sqrt(d2)), 4) threshold from n")
def distance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Mean plus one deviation of the distances of the second sides' points to the first sides'."""
    c = cloud(spark, sf)
    return spark.createDataFrame([(round(registration.distance_threshold(side(c, 1), side(c, 2)), 4),)], "threshold double")


@query()
def plane_icp_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The motion of the second sides' points onto the planes of the first sides' (three iterations)."""
    c = cloud(spark, sf)
    r = c.agg(*[F.avg(a) for a in "xyz"]).first()
    t = registration.plane_icp(side(c, 1), side(c, 2), 3, 1e-6, tuple(v or 0.0 for v in r))
    return spark.createDataFrame([(i, *[round(v, 4) + 0.0 for v in row]) for i, row in enumerate(t.matrix)], "row int, a double, b double, c double, t double")


# --- files and stores ---------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the tables of this application."""
    return f"{shared_dir(spark).removeprefix('file:')}/tidemesh-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(f"with {POINTS} select point_id, round(x, 3) x, round(y, 3) y, round(z, 3) z, coalesce(intensity, 0) intensity, return_number, number_of_returns, epoch_id from pts where return_number between 0 and 15 and number_of_returns between 0 and 15 and coalesce(intensity, 0) between 0 and 65535")
def las_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All points written to LAS files, with standard fields and extra dimensions, and read again."""
    p = cloud_all(spark, sf).filter("return_number between 0 and 15 and number_of_returns between 0 and 15 and coalesce(intensity, 0) between 0 and 65535")
    path = _folder(spark, "las")
    write_las(p.withColumn("own_id", F.col("point_id")).repartition(4, "point_id"), path, ["intensity", "return_number", "number_of_returns", "own_id", "epoch_id"])
    names = {c: c for c in ("intensity", "return_number", "number_of_returns", "own_id", "epoch_id")}
    parts = [read_las(spark, str(f), additional=names) for f in sorted(Path(path).glob("*.las"))]
    back = parts[0] if parts else p.withColumn("own_id", F.col("point_id"))
    for part in parts[1:]:
        back = back.unionByName(part)
    back = back.drop("point_id").withColumnRenamed("own_id", "point_id")
    return rounded(back.select("point_id", "x", "y", "z", F.coalesce(F.col("intensity").cast("int"), F.lit(0)).alias("intensity"), F.col("return_number").cast("int").alias("return_number"), F.col("number_of_returns").cast("int").alias("number_of_returns"), F.col("epoch_id").cast("int").alias("epoch_id")), 3, "x", "y", "z")


@query(f"with {POINTS} select point_id, epoch_id, x, y, z from pts")
def saved_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The cloud saved as an epoch and loaded again."""
    path = _folder(spark, "epoch")
    save_epoch(cloud_all(spark, sf).select("point_id", "epoch_id", "x", "y", "z"), path)
    return load_epoch(spark, path)[0].select("point_id", "epoch_id", "x", "y", "z")
