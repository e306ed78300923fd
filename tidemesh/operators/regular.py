"""Irregular readings onto a regular grid, by step-function validity intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import if_small
from ..functions.segments import list_parts
from .series import pack, readings

GRID = "corepoint_id long, slot long, n_readings int, value double, coverage double, missing boolean"
#: Grid cells worked on at once in a task; batches of series are cut to it.
CELLS = 1_000_000


def timed_readings(distances: DataFrame, epochs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Readings (corepoint_id, us, step, distance): time and grid step in microseconds; those without either are left out."""
    step = analyses.select("analysis_id", (F.col("grid_hours").cast("long") * 3_600_000_000).alias("step")).filter("step > 0").dropDuplicates(["analysis_id"])
    at = epochs.filter(F.col("ts").isNotNull()).select("analysis_id", "epoch_idx", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).dropDuplicates(["analysis_id", "epoch_idx"])
    at = if_small(at.join(if_small(step, scan=True), "analysis_id"))
    return readings(distances).join(at, ["analysis_id", "epoch_idx"]).select("corepoint_id", "us", "step", "distance")


def _grid(row: np.ndarray, us: np.ndarray, v: np.ndarray, step: np.ndarray, until: np.ndarray, next_us: np.ndarray, before: tuple, age: float):
    """Cells of the series in row order; until: slot to stop before, or -1 for the slot of the last reading."""
    n = len(step)
    slot = us // step[row]
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, row, slot)
    last = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(last, row, slot)
    last = np.where(until >= 0, until - 1, last)
    cells = last - first + 1
    base = np.cumsum(cells) - cells
    total = int(cells.sum())
    count = np.bincount(base[row] + slot - first[row], minlength=total)
    end = np.r_[us[1:], 0]
    tail = np.r_[row[1:] != row[:-1], True]
    end[tail] = np.where(next_us >= 0, next_us, np.iinfo(np.int64).max)[row[tail]]
    b_row, b_us, b_v = before  # the reading before a block holds on into it
    start = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(start, row, us)
    r, s, e, x = np.r_[row, b_row], np.r_[us, b_us], np.r_[end, start[b_row]], np.r_[v, b_v]
    e = np.minimum(e, s + (age * step[r]).astype(np.int64))
    s, e = np.maximum(s, first[r] * step[r]), np.minimum(e, (last[r] + 1) * step[r])
    ok = e > s
    r, s, e, x = r[ok], s[ok], e[ok], x[ok]
    lo, hi = s // step[r], (e - 1) // step[r]
    k = hi - lo + 1
    at = np.repeat(np.arange(len(r)), k)
    cell = lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
    r = r[at]
    part = (np.minimum(e[at], (cell + 1) * step[r]) - np.maximum(s[at], cell * step[r])) / step[r]
    where = base[r] + cell - first[r]
    cover = np.bincount(where, part, total)
    area = np.bincount(where, part * x[at], total)
    out_row = np.repeat(np.arange(n), cells)
    return out_row, first[out_row] + np.arange(total) - base[out_row], count, area, cover


def regularise(distances: DataFrame, epochs: DataFrame, analyses: DataFrame, age: float = 1.0, only_missing: bool = False) -> DataFrame:
    """One row per corepoint and grid slot from its first to its last slot with a reading.

    slot = floor(unix seconds of the scan / (grid_hours * 3600)). A reading is valid from its time to the next one's, for
    `age` grid steps at most; value is the time-weighted mean over the part of the slot that is covered (null if none),
    coverage that part, n_readings the readings in it, missing = no reading in it. only_missing gives just those slots.

    Readings without a time (epoch unknown or ts null) and analyses without a positive grid_hours are not placed. Several
    readings at one time: each counts in n_readings, the one with the largest distance holds on. Repeated epochs count
    once; superseded rows: see held_rows. Empty tables give an empty result; further columns are ignored.
    """
    rows = timed_readings(distances, epochs, analyses)
    position = F.expr("(us - pmod(us, step)) div step")
    p = pack(rows, ["corepoint_id", "step"], position, "us", ["distance"], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            ends = _last_slots(whole)
            for lo, hi in _chunks(ends):
                yield from _one(whole.slice(lo, hi - lo), age, only_missing)

    return p.select("corepoint_id", "step", "before", "items", "after").mapInArrow(run, GRID)


def _last_slots(b: pa.RecordBatch) -> np.ndarray:
    """Cells that each packed block will give."""
    step = b.column(1).to_numpy()
    row, (us, _) = list_parts(b.column(3))
    after_row, (after, _) = list_parts(b.column(4))
    lo, hi = np.full(len(step), np.iinfo(np.int64).max), np.zeros(len(step), np.int64)
    np.minimum.at(lo, row, us.astype(np.int64))
    np.maximum.at(hi, row, us.astype(np.int64))
    hi[after_row] = after.astype(np.int64)
    return (hi - lo) // step + 2


def _chunks(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    part = np.cumsum(cells) // CELLS
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(cells)]
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _one(b: pa.RecordBatch, age: float, only_missing: bool) -> Iterator[pa.RecordBatch]:
    step = b.column(1).to_numpy()
    row, (us, v) = list_parts(b.column(3))
    us = us.astype(np.int64)
    after_row, (after_us, _) = list_parts(b.column(4))
    before_row, (before_us, before_v) = list_parts(b.column(2))
    next_us = np.full(len(step), -1, np.int64)
    next_us[after_row] = after_us.astype(np.int64)
    until = np.where(next_us >= 0, next_us // step, -1)
    r, slot, count, area, cover = _grid(row, us, v, step, until, next_us, (before_row, before_us.astype(np.int64), before_v), age)
    k = np.flatnonzero(count == 0) if only_missing else np.arange(len(r))
    with np.errstate(all="ignore"):
        value = pa.array(area[k] / cover[k], mask=cover[k] <= 0)
    yield pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(r[k])), pa.array(slot[k]), pa.array(count[k].astype(np.int32)), value, pa.array(cover[k]), pa.array(count[k] == 0)],
        names=[c.split()[0] for c in GRID.split(", ")],
    )
