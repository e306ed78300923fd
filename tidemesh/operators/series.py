"""Readings of a space-time table: the valid row per (corepoint, epoch), and series packed into bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise

#: Positions (epochs or grid slots) in one packed block; bounds what a task holds of one series.
BLOCK = 4096


def held_rows(distances: DataFrame, fields: list[str]) -> DataFrame:
    """The row with the latest ingested_at of every (corepoint_id, epoch_idx), with analysis_id and `fields`.

    Rows without corepoint_id or epoch_idx belong to no series and are left out; a row without ingested_at counts as the
    oldest. Rows with equal ingested_at are taken to agree. Copies are merged before the shuffle (max_by per field).
    """
    when = F.coalesce(F.col("ingested_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62_000_000_000)))
    rows = distances.filter(F.col("corepoint_id").isNotNull() & F.col("epoch_idx").isNotNull())
    rows = rows.select("corepoint_id", "epoch_idx", when.alias("_at"), *[F.col(c).cast("double").alias(c) if c in ("distance", "lodetection", "spread1", "spread2") else F.col(c) for c in ("analysis_id", *fields)])
    return rows.groupBy("corepoint_id", "epoch_idx").agg(*[F.max_by(c, "_at").alias(c) for c in ("analysis_id", *fields)])


def readings(distances: DataFrame, fields: tuple[str, ...] = ("distance",)) -> DataFrame:
    """Held rows whose distance is neither null nor NaN."""
    fields = tuple(dict.fromkeys(("distance", *fields)))
    return held_rows(distances, list(fields)).filter(F.col("distance").isNotNull() & ~F.isnan("distance"))


def pack(rows: DataFrame, keys: list[str], position: Column, order: str, values: list[str], halo: int, longest: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, block of BLOCK positions): `items`, sorted structs of (order, values), with `before` and `after`.

    before / after hold the `halo` nearest items of the neighbouring blocks of the same series (empty lists at its ends).
    A block is at most BLOCK positions long, so no series, however long, is collected in one place. `longest`: if the
    caller knows that all positions lie in 0..longest < BLOCK, there is but one block each and the halo step is left out.
    also: columns of which a block keeps its largest value.
    """
    block = F.floor(position / F.lit(BLOCK)).cast("long")
    p = rows.withColumn("block", block).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("items"), *[F.max(c).alias(c) for c in also])
    empty = F.expr("slice(items, 1, 0)")
    if longest is not None and longest < BLOCK:
        return p.select("*", empty.alias("before"), empty.alias("after"))
    p = materialise(p)
    w = Window.partitionBy(*keys).orderBy("block")  # over block ends only: one short row per block
    ends = p.select(*keys, "block", F.expr(f"slice(items, greatest(size(items) - {halo - 1}, 1), {halo})").alias("tail"), F.expr(f"slice(items, 1, {halo})").alias("head"))
    back = F.flatten(F.collect_list("tail").over(w.rowsBetween(-halo, -1)))
    ahead = F.flatten(F.collect_list("head").over(w.rowsBetween(1, halo)))
    ends = ends.select(*keys, "block", back.alias("back"), ahead.alias("ahead"))
    ends = ends.select(*keys, "block", F.expr(f"slice(back, greatest(size(back) - {halo - 1}, 1), {halo})").alias("before"), F.expr(f"slice(ahead, 1, {halo})").alias("after"))
    return p.join(ends, [*keys, "block"])


def longest_position(distances: DataFrame) -> int:
    """Largest epoch_idx (one number from a scan of one column); negative ones force blocks as well."""
    lo, hi = distances.agg(F.min("epoch_idx"), F.max("epoch_idx")).first()
    return BLOCK if lo is not None and lo < 0 else int(hi or 0)
