"""Queries p1 to p3: the general data-pipeline problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import near, regular, spikes


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Points within 0.7505 m of each corepoint, and the zones whose outline holds it."""
    core = _table(spark, sf, "corepoints").select("corepoint_id", "x", "y", "z")
    points = near.points_near(core, _table(spark, sf, "points"), 0.7505, "corepoint_id", "point_id")
    zones = near.regions_holding(core, _table(spark, sf, "zones"), "corepoint_id", "zone_id")
    return points.select(F.lit("point").alias("kind"), "corepoint_id", F.col("point_id").alias("other_id")).unionByName(zones.select(F.lit("zone").alias("kind"), "corepoint_id", F.col("zone_id").alias("other_id")))


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flagged reading with its reasons."""
    f = spikes.flag_readings(_table(spark, sf, "distances"))
    return f.select("corepoint_id", "epoch_idx", "spike", "returned", "stuck", "impossible")


def p2_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The readings that the exact rules name, by rule."""
    f = spikes.flag_readings(_table(spark, sf, "distances"))
    return f.filter("returned or stuck or impossible").select("corepoint_id", "epoch_idx", "returned", "stuck", "impossible")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes beyond the fitted tail that the exact rule confirms, stuck and impossible readings."""
    return spikes.flag_readings(_table(spark, sf, "distances")).filter("(spike and returned) or stuck or impossible").select("corepoint_id", "epoch_idx")


def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The regular series: readings, time-weighted mean and coverage per slot."""
    g = regular.regularise(_table(spark, sf, "distances"), _table(spark, sf, "epochs"), _table(spark, sf, "analyses"))
    return g.select("corepoint_id", "slot", "n_readings", F.round(F.col("value") + F.lit(1e-9), 6).alias("value"), F.round("coverage", 6).alias("coverage"), "missing")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Slots strictly between a corepoint's first and last reading that have none."""
    g = regular.regularise(_table(spark, sf, "distances"), _table(spark, sf, "epochs"), _table(spark, sf, "analyses"), only_missing=True)
    return g.select("corepoint_id", "slot")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_rules, p2_flags, p3_found, p3_grid)}

_HELD = """held as (
  select corepoint_id, epoch_idx, arg_max(analysis_id, ingested_at) analysis_id, arg_max(struct_pack(v := distance), ingested_at).v distance,
    arg_max(struct_pack(v := lodetection), ingested_at).v lodetection, arg_max(struct_pack(v := spread2), ingested_at).v spread2, arg_max(struct_pack(v := num_samples2), ingested_at).v num_samples2
  from distances group by 1, 2),
readings as (select * from held where distance is not null and not isnan(distance))"""

_SERIES = " union all ".join(
    f"select '{name}' f, corepoint_id, epoch_idx, {name} v from marked where {name} is not null and not isnan({name}) and not ({wrong})" + (" and not stuck" if name == "distance" else "")
    for name, wrong in (("distance", "abs(distance) > 25"), ("lodetection", "lodetection < 0 or isinf(lodetection)"), ("spread2", "spread2 < 0 or isinf(spread2)"))
)
_USUAL = " union all ".join(
    f"select '{name}' f, corepoint_id, epoch_idx, {name} v from readings where {name} is not null and not isnan({name}) and not ({wrong})"
    for name, wrong in (("distance", "abs(distance) > 25"), ("lodetection", "lodetection < 0 or isinf(lodetection)"), ("spread2", "spread2 < 0 or isinf(spread2)"))
)

#: SQL of the readings that the rules of problem 2 name: readings, and rules with one column for each.
RULES = """
with @HELD,
numbered as (select *, row_number() over (partition by corepoint_id order by epoch_idx) k, row_number() over (partition by corepoint_id, distance order by epoch_idx) j from readings),
marked as (select *, count(*) over (partition by corepoint_id, distance, k - j) >= 5 stuck from numbered),
usual as (select f, corepoint_id, median(abs(c)) m from (select f, corepoint_id, v - lag(v) over (partition by f, corepoint_id order by epoch_idx) c from (@USUAL)) where c is not null group by 1, 2),
around as (select s.*, m, lag(v, 2) over w p2, lag(v) over w p1, lead(v) over w n1, lead(v, 2) over w n2 from (@SERIES) s join usual using (f, corepoint_id) window w as (partition by f, corepoint_id order by epoch_idx)),
out_and_back as (select distinct corepoint_id, epoch_idx from around where
  (p1 is not null and n1 is not null and (v - greatest(p1, n1) > 10 * m or least(p1, n1) - v > 10 * m))
  or (p1 is not null and n1 is not null and n2 is not null and (least(v, n1) - greatest(p1, n2) > 10 * m or least(p1, n2) - greatest(v, n1) > 10 * m))
  or (p2 is not null and p1 is not null and n1 is not null and (least(v, p1) - greatest(p2, n1) > 10 * m or least(p2, n1) - greatest(v, p1) > 10 * m))),
rules as (select corepoint_id, epoch_idx, o.corepoint_id is not null returned, stuck, coalesce(abs(distance) > 25 or (not isnan(lodetection) and (lodetection < 0 or isinf(lodetection))) or (not isnan(spread2) and (spread2 < 0 or isinf(spread2))) or num_samples2 < 0, false) impossible
  from marked left join out_and_back o using (corepoint_id, epoch_idx))
""".replace("@HELD", _HELD).replace("@USUAL", _USUAL).replace("@SERIES", _SERIES)

ORACLE = {
    "p1_found": """
with core as (select distinct corepoint_id, x, y, z from corepoints where isfinite(x) and isfinite(y) and isfinite(z)),
pts as (select distinct point_id, x, y, z from points where isfinite(x) and isfinite(y) and isfinite(z)),
flat as (select distinct corepoint_id, x, y from corepoints where isfinite(x) and isfinite(y)),
rings as (select distinct zone_id, ring r, len(ring) // 2 n from zones where ring is not null and len(ring) >= 6 and len(ring) % 2 = 0),
edges as (select zone_id, n, r[2 * i + 1] x1, r[2 * i + 2] y1, r[2 * ((i + 1) % n) + 1] x2, r[2 * ((i + 1) % n) + 2] y2 from (select *, unnest(range(n)) i from rings)),
good as (select zone_id from edges group by 1 having bool_and(coalesce(isfinite(x1) and isfinite(y1), false)) and count(distinct (x1, y1)) >= 3),
inside as (select corepoint_id, zone_id from flat, edges where zone_id in (select zone_id from good) and (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) group by 1, 2 having count(*) % 2 = 1)
select 'point' kind, corepoint_id, point_id other_id from core c join pts p on p.x between c.x - 0.76 and c.x + 0.76 and p.y between c.y - 0.76 and c.y + 0.76
  where (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) <= 0.7505 * 0.7505
union all select 'zone', corepoint_id, zone_id from inside""",
    "p2_found": RULES + "select corepoint_id, epoch_idx from rules where returned or stuck or impossible",
    "p2_rules": RULES + "select * from rules where returned or stuck or impossible",
    "p3_found": f"""
with {_HELD},
timed as (select distinct analysis_id, epoch_idx, floor(epoch_us(ts) / (grid_hours * 3600e6))::bigint slot from (select distinct analysis_id, epoch_idx, ts from epochs where ts is not null) join (select distinct analysis_id, grid_hours from analyses where grid_hours > 0) using (analysis_id)),
has as (select distinct corepoint_id, slot from readings join timed using (analysis_id, epoch_idx)),
span as (select corepoint_id, unnest(range(min(slot) + 1, max(slot))) slot from has group by 1)
select corepoint_id, slot from span anti join has using (corepoint_id, slot)""",
    "p3_grid": f"""
with {_HELD},
timed as (select distinct analysis_id, epoch_idx, epoch_us(ts) us, grid_hours * 3600000000 step from (select distinct analysis_id, epoch_idx, ts from epochs where ts is not null) join (select distinct analysis_id, grid_hours from analyses where grid_hours > 0) using (analysis_id)),
r as (select corepoint_id, us, step, us // step slot, distance, least(us + step, coalesce(lead(us) over (partition by corepoint_id order by us, distance), us + step)) until from readings join timed using (analysis_id, epoch_idx)),
span as (select corepoint_id, any_value(step) step, unnest(range(min(slot), max(slot) + 1)) slot from r group by 1),
n as (select corepoint_id, slot, count(*) n from r group by 1, 2),
parts as (select corepoint_id, unnest(range(slot, (greatest(until, us + 1) - 1) // step + 1)) slot, us, until, step, distance from r),
cover as (select corepoint_id, slot, sum((least(until, (slot + 1) * step) - greatest(us, slot * step)) / step::double) c, sum(distance * (least(until, (slot + 1) * step) - greatest(us, slot * step)) / step::double) a from parts group by 1, 2)
select corepoint_id, slot, coalesce(n, 0)::int n_readings, round(case when c > 0 then a / c + 1e-9 end, 6) "value", round(coalesce(c, 0), 6) coverage, n is null missing
from span left join n using (corepoint_id, slot) left join cover using (corepoint_id, slot)""",
}
