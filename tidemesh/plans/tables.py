"""The cleaned tables the queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import if_small, usable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Every scan once, with the number of scans of its analysis."""
    a = table(spark, sf, "analyses").select("analysis_id", "n_epochs").dropDuplicates(["analysis_id"])
    return table(spark, sf, "epochs").dropDuplicates(["epoch_id"]).join(if_small(a, scan=True), "analysis_id")


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Usable points with analysis_id, epoch_idx and side: 1 for scans in the first half of their analysis, 2 after it. No-hit points (at the origin) are left out."""
    p = table(spark, sf, "points").filter(usable(F.col("x"), F.col("y"), F.col("z")) & ~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0))).dropDuplicates(["point_id"])
    e = epochs(spark, sf).select("epoch_id", "analysis_id", "epoch_idx", F.when(F.col("epoch_idx") * 2 < F.col("n_epochs"), 1).otherwise(2).alias("side"))
    return p.join(if_small(e, scan=True), "epoch_id")


def side(cloud_: DataFrame, s: int) -> DataFrame:
    return cloud_.filter(F.col("side") == s)


def corepoints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corepoints").dropDuplicates(["corepoint_id"]).filter(usable(F.col("x"), F.col("y"), F.col("z")))


POINTS = """pts as (select distinct * from points where isfinite(x) and isfinite(y) and isfinite(z) and not (x = 0 and y = 0 and z = 0)),
eps as (select distinct epoch_id, analysis_id, epoch_idx, ts, n_epochs from epochs join (select distinct analysis_id, n_epochs from analyses) using (analysis_id)),
cloud as (select pts.*, analysis_id, epoch_idx, case when epoch_idx * 2 < n_epochs then 1 else 2 end side from pts join eps using (epoch_id)),
core as (select distinct * from corepoints where isfinite(x) and isfinite(y) and isfinite(z))"""
