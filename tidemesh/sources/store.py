"""Space-time store: a folder of Parquet tables for one analysis, and saved epochs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import m3c2, timeseries
from .files import timestamp

VERSION = 1
DERIVED = ("smoothed", "seeds", "objects")


class Folder:
    """Tables and small JSON notes below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists", **options) -> None:
        df.write.mode(mode).options(**options).parquet(f"{self.path}/{name}")

    def note(self, value: dict) -> None:
        out = self._fs.create(self._at("meta.json"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def notes(self) -> dict | None:
        if not self.has("meta.json"):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/meta.json").collect()))


def save_epoch(cloud: DataFrame, path: str, when=None, transformations: list | None = None) -> None:
    """Writes a cloud with all its columns, its time and the transformations applied to it."""
    f = Folder(cloud.sparkSession, path)
    f.write("points", cloud)
    t = timestamp(when)
    f.note({"version": VERSION, "timestamp": t.isoformat() if t else None, "transformations": transformations or []})


def load_epoch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(cloud, notes); a later version than this library's is refused."""
    f = Folder(spark, path)
    meta = f.notes()
    if meta is None:
        raise FileNotFoundError(f"no epoch at {path}")
    if meta["version"] > VERSION:
        raise ValueError(f"the epoch has version {meta['version']}; up to {VERSION} can be read")
    return f.read("points"), meta


class SpaceTimeStore:
    """An analysis on disk: reference epoch and corepoints (set once), distances by epoch (appended), and derived tables."""

    def __init__(self, spark: SparkSession, path: str, force: bool = False):
        self.folder = Folder(spark, path)
        if force:
            self.folder.drop("")
        meta = self.folder.notes()
        if meta is None:
            self.folder.note({"version": VERSION, "epochs": 0, "reference": None})
        elif meta["version"] > VERSION:
            raise ValueError(f"the store has version {meta['version']}; up to {VERSION} can be read")

    def _meta(self, **change) -> dict:
        meta = self.folder.notes() | change
        if change:
            self.folder.note(meta)
        return meta

    @property
    def reference_epoch(self) -> DataFrame:
        return self.folder.read("reference")

    def set_reference_epoch(self, cloud: DataFrame, when) -> None:
        """Once; needs a time."""
        t = timestamp(when)
        if t is None:
            raise ValueError("the reference epoch needs a timestamp")
        self.folder.write("reference", cloud)
        self._meta(reference=t.isoformat())

    @property
    def corepoints(self) -> DataFrame:
        return self.folder.read("corepoints")

    def set_corepoints(self, corepoints: DataFrame) -> None:
        """Once; with directions nx, ny, nz."""
        self.folder.write("corepoints", corepoints)

    def add_epochs(self, *epochs: tuple[DataFrame, object], **m3c2_options) -> None:
        """Appends the distances of (cloud, time) pairs to the reference, in order of time; what was derived is dropped."""
        timed = sorted(((timestamp(t), c) for c, t in epochs), key=lambda e: (e[0] is None, e[0]))
        if any(t is None for t, _ in timed):
            raise ValueError("every epoch needs a timestamp")
        self.invalidate(seeds=True, objects=True, smoothed=True)
        n, reference = self._meta()["epochs"], datetime.fromisoformat(self._meta()["reference"])
        spark = self.folder.spark
        for t, cloud in timed:
            d = m3c2.m3c2(self.corepoints, self.reference_epoch, cloud, **m3c2_options).withColumn("epoch_idx", F.lit(n))
            self.folder.write(f"distances/epoch={n}", d, "overwrite")  # a retry writes the same epoch again
            row = spark.createDataFrame([(n, t, (t - reference).total_seconds())], "epoch_idx int, ts timestamp_ntz, delta_seconds double")
            self.folder.write(f"epochs/epoch={n}", row, "overwrite")
            n += 1
            self._meta(epochs=n)

    @property
    def distances(self) -> DataFrame:
        return self.folder.read("distances").drop("epoch")

    @property
    def epochs(self) -> DataFrame:
        return self.folder.read("epochs").drop("epoch")

    def smooth(self, window: int = 24) -> None:
        self.folder.drop("smoothed")
        self.folder.write("smoothed", timeseries.temporal_averaging(self.distances, window))

    @property
    def distances_for_compute(self) -> DataFrame:
        """Smoothed distances if there are any, else raw ones."""
        if self.folder.has("smoothed"):
            return self.folder.read("smoothed")
        return self.distances.select("corepoint_id", "epoch_idx", "distance")

    def put(self, name: str, df: DataFrame) -> None:
        """Stores seeds or objects, once until they are invalidated."""
        if name not in DERIVED:
            raise ValueError(f"{name} is no derived table")
        self.folder.write(name, df)

    def get(self, name: str) -> DataFrame:
        return self.folder.read(name)

    def invalidate(self, seeds: bool = True, objects: bool = True, smoothed: bool = False) -> None:
        for name, gone in (("seeds", seeds), ("objects", objects), ("smoothed", smoothed)):
            if gone:
                self.folder.drop(name)
