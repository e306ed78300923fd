"""Scans as streams: distances of arriving epochs against a reference, and windowed counts of arriving points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import m3c2
from ..operators.voxel import with_voxels


def distances_sink(points: DataFrame, corepoints: DataFrame, reference: DataFrame, out: str, checkpoint: str, radius: float, max_distance: float = 0.0, epoch: str = "epoch_id", **trigger) -> StreamingQuery:
    """Starts a query that appends, for every micro-batch of scan points, the distances of its epochs to the static reference epoch.

    Rows are keyed by batch, so a batch that runs again replaces what it wrote. An epoch has to arrive within one batch
    (one file per scan); the reference joins as a batch table.
    """
    base = reference.withColumn(epoch, F.lit(-1))

    def one(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c in base.columns]
        cloud = base.select(*cols).unionByName(batch.select(*cols))
        d = m3c2.m3c2_series(corepoints, cloud, epoch, -1, radius, max_distance).filter(F.col(epoch) != -1)
        d.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def voxel_counts(points: DataFrame, size: float, window: str = "1 hour", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Points per voxel and event-time window; points later than the watermark are dropped."""
    p = with_voxels(points, size).withWatermark(ts, late)
    return p.groupBy(F.window(ts, window), "vx", "vy", "vz").agg(F.count("*").alias("count")).select("window.start", "vx", "vy", "vz", "count")
