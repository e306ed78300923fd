"""Queries p4 to p8: the training-data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline_queries import RULES
from . import clusters, leakage, mixing, neighbours, truncation


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "segments").filter("size(cloud) = 24 and size(normals) = 24")
    return neighbours.usable_vectors(s, "segment_id", F.concat("cloud", "normals"), 48)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of segments of which one is among the other's 5 nearest, at most 0.7 apart."""
    pairs = neighbours.near_pairs(neighbours.neighbour_graph(_segments(spark, sf)), 5, 0.7)
    return pairs.select(F.col("a").alias("segment_a"), F.col("b").alias("segment_b")).distinct()


def p4_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy graph search: the 5 nearest of all segments for every segment whose id is divisible by 20."""
    v = _segments(spark, sf)
    found = neighbours.search(neighbours.neighbour_graph(v), v, v.filter("id % 20 = 0"), k=6)
    return found.filter("query_id <> id").select("query_id", F.col("id").alias("segment_id"), F.round("d", 6).alias("distance"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Corepoints in groups that are alike in series and place."""
    return clusters.like_groups(_table(spark, sf, "distances"), _table(spark, sf, "corepoints")).select("cluster_id", "corepoint_id")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's size and its five most typical members by rank."""
    d = clusters.described(clusters.like_groups(_table(spark, sf, "distances"), _table(spark, sf, "corepoints")), members=5)
    return d.select("cluster_id", "size", "rank", "typical", *[F.round(c, 3).alias(c) for c in ("x", "y", "z", "mean")])


def p5_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves of bisecting k-means over the places of each analysis: size, spread and the five members nearest to the centre."""
    members = clusters.materialise(clusters.places(_table(spark, sf, "corepoints")))
    r = clusters.leaf_report(clusters.materialise(clusters.bisect(members, 40.0)), members)
    return r.select(F.col("tree").alias("analysis_id"), "leaf", "size", F.round("spread", 3).alias("spread"), "rank", F.col("id").alias("corepoint_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return leakage.leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """The leaked items: documents that hold them and the longest passage."""
    found = leakage.leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("matched").alias("longest_passage"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares the mix reaches."""
    return mixing.mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut, those left out whose ending is complete by the rule."""
    judged = truncation.judge_endings(_table(spark, sf, "documents"))
    return judged.filter("cut and not (verdict = 'complete' and evidence = 'limit')").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.cut_rates(truncation.judge_endings(_table(spark, sf, "documents")))


QUERIES = {f.__name__: f for f in (p4_found, p4_search, p5_found, p5_groups, p5_leaves, p6_found, p6_items, p7_mix, p7_shares, p8_found, p8_rates)}

_NEAR = """
with v as (select distinct segment_id id, [x::double for x in list_concat(cloud, normals)] v from segments where len(cloud) = 24 and len(normals) = 24),
u as (select * from v where len([x for x in v if x is not null and isfinite(x)]) = 48),
d as (select a.id a, b.id b, list_distance(a.v, b.v) d from u a join u b on a.id <> b.id)
"""

ORACLE: dict[str, str] = {
    "p4_found": _NEAR + """, k as (select a, b, d, row_number() over (partition by a order by d, b) r from d)
select distinct least(a, b) segment_a, greatest(a, b) segment_b from k where r <= 5 and d <= 0.7""",
    "p5_found": RULES + """, good as (select r.corepoint_id, epoch_idx, distance from readings r anti join (select corepoint_id, epoch_idx from rules where returned or stuck or impossible) using (corepoint_id, epoch_idx)),
core as (select distinct corepoint_id, analysis_id, x, y, z from corepoints where isfinite(x) and isfinite(y) and isfinite(z) and corepoint_id in (select corepoint_id from good)),
pairs as (select a.corepoint_id a, b.corepoint_id b from core a join core b on a.analysis_id = b.analysis_id and a.corepoint_id < b.corepoint_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1600 + 1e-9),
alike as (select a, b from pairs join good g on g.corepoint_id = a join good h on h.corepoint_id = b and h.epoch_idx = g.epoch_idx group by 1, 2 having 100 * count(*) filter (abs(g.distance - h.distance) <= 0.05 + 1e-9) >= 85 * count(*)),
near as (select a id, b other from alike union all select b, a from alike union all select corepoint_id, corepoint_id from core),
sets as (select id, list_sort(list(other)) s from near group by 1),
whole as (select s from sets group by 1 having count(*) = len(s) and len(s) >= 3)
select s[1] cluster_id, id corepoint_id from sets where s in (select s from whole)""",
}
