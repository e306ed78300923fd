"""Readings that cannot be trusted: spikes, stuck values and impossible values, against a series' own behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import if_small, materialise
from ..functions.segments import LOWEST, list_parts, medians, tail_bins, tail_cutoff
from .series import BLOCK, longest_position, pack, readings

FIELDS = ("distance", "lodetection", "spread2", "num_samples2")
#: Readings of the neighbouring blocks that a block of a very long series looks at; no run of impossible or stuck values at
#: its border should be longer.
HALO = 64
FLAGS = "corepoint_id long, epoch_idx int, spike boolean, returned boolean, stuck boolean, impossible boolean, height double, cutoff double"


def _excursions(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """How far each value, alone or with one neighbour, lies beyond both levels around it; 0 if it doesn't."""
    n, h = len(x), np.zeros(len(x))
    for run in (1, 2):
        if n < run + 2:
            break
        before, after = x[: n - run - 1], x[run + 1 :]
        inner = np.stack([x[1 + i : n - run + i] for i in range(run)])
        up = inner.min(0) - np.maximum(before, after)
        down = np.minimum(before, after) - inner.max(0)
        far = np.where(seg[: n - run - 1] == seg[run + 1 :], np.maximum(up, down), 0)
        for i in range(run):
            np.maximum(h[1 + i : n - run + i], far, out=h[1 + i : n - run + i])
    return h


def _runs(x: np.ndarray, seg: np.ndarray, least: int) -> np.ndarray:
    """True in runs of at least `least` exactly equal successive values of a segment."""
    if not len(x):
        return np.zeros(0, bool)
    new = np.r_[True, (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= least


def seasonal(seg: np.ndarray, e: np.ndarray, v: np.ndarray, n: int, periods: tuple[int, ...], usual: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The seasonal part of every value of n series (sorted by series and epoch e), 0 in series without a season.

    A series has the season, of the `periods` in epochs of which it has four or more cycles, whose phases explain most of
    what is left of it beside a moving mean of one period, if they explain more than `share` of that (adjusted for their
    number). What is left is cut at five of its `usual` changes first, so spikes do not make seasons.
    """
    out = np.zeros(len(v))
    if not len(v) or not periods:
        return out
    count = np.bincount(seg, minlength=n)
    start = np.cumsum(count) - count
    size = 5 * np.nan_to_num(usual)[seg]
    x = v - v.mean()
    sums = np.r_[0.0, np.cumsum(x)]
    at, whole_e = np.arange(len(v)), e.astype(np.int64)
    first, last = start[seg], (start + count)[seg]

    def left(p: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left beside the moving mean of those of the values k that have a whole period around them, and which these are."""
        lo, hi = k - (p - 1) // 2, k + p // 2 + 1
        k = k[(lo >= first[k]) & (hi <= last[k])]
        r = x[k] - (sums[k + p // 2 + 1] - sums[k - (p - 1) // 2]) / p
        return np.clip(r, -size[k], size[k]), k

    best, season = np.full(n, share), np.zeros(n, np.int64)
    for p in periods:
        r, k = left(p, at[(count >= 4 * p)[seg]] if (count < 4 * p).any() else at)
        if not len(k):
            continue
        s = seg[k]
        phase = s * p + whole_e[k] % p
        m, by = np.bincount(s, minlength=n), np.bincount(phase, minlength=n * p)
        part = np.bincount(phase, r, n * p)
        with np.errstate(all="ignore"):
            square = np.bincount(s, r * r, n)
            whole = square - part.reshape(n, p).sum(1) ** 2 / m
            within = square - np.nan_to_num(part**2 / by).reshape(n, p).sum(1)
            told = np.nan_to_num(1 - within / (m - p) / (whole / (m - 1)), nan=-1.0)
        better = told > best
        best[better], season[better] = told[better], p
    for p in np.unique(season[season > 0]).tolist():
        mine = at[(season == p)[seg]]
        r, k = left(p, mine)
        level = np.nan_to_num(medians(seg[k] * p + whole_e[k] % p, r, n * p))
        out[mine] = level[seg[mine] * p + whole_e[mine] % p]
    return out


def judge(row: np.ndarray, fields: list[np.ndarray], n: int, periods: tuple[int, ...], times: float, stuck: int, furthest: float, scale: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Flags and excursions for readings in series order; row: series number of each. fields: epoch, then FIELDS. scale: 3 x n medians, NaN to take those of the rows at hand.

    height: 3 x readings, excursions of what is left beside the season, in median changes of the series; NaN where a field has no value to judge.
    """
    epoch, d, lod, spread, samples = fields
    with np.errstate(invalid="ignore"):
        wrong = {"distance": np.abs(d) > furthest, "lodetection": (lod < 0) | np.isinf(lod), "spread2": (spread < 0) | np.isinf(spread)}
        out = {"impossible": wrong["distance"] | wrong["lodetection"] | wrong["spread2"] | (samples < 0), "stuck": _runs(d, row, stuck)}
    out |= {"returned": np.zeros(len(row), bool), "height": np.full((3, len(row)), np.nan)}
    for k, (name, x) in enumerate((("distance", d), ("lodetection", lod), ("spread2", spread))):
        good = ~wrong[name] & ~np.isnan(x)
        s, v = row[good], x[good]
        usual = _usual(s, v, n)
        if scale is not None:
            usual = np.where(np.isnan(scale[k]), usual, scale[k])
        keep = good & ~out["stuck"] if name == "distance" else good
        s, v, e = row[keep], x[keep], epoch[keep]
        at = np.flatnonzero(keep)
        out["returned"][at] |= _excursions(v, s) > np.where(np.isnan(usual), np.inf, times * usual)[s]
        season = seasonal(s, e, v, n, periods, usual)
        size = usual
        if (has := np.bincount(s, np.abs(season), n) > 0).any():
            size = np.where(has, np.fmax(_usual(s, v - season, n), usual / 10), usual)
        with np.errstate(all="ignore"):
            h = _excursions(v - season, s)
            out["height"][k, at] = np.where(np.isnan(size[s]), np.nan, np.where(h > 0, h / size[s], 0))
    return out


def _usual(s: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Median absolute change between successive values of each series."""
    same = s[1:] == s[:-1]
    return medians(s[1:][same], np.abs(np.diff(v))[same], n) if len(v) else np.full(n, np.nan)


def _packed(distances: DataFrame, furthest: float) -> DataFrame:
    longest = longest_position(distances)
    p = pack(readings(distances, FIELDS), ["corepoint_id"], F.col("epoch_idx"), "epoch_idx", list(FIELDS), HALO, longest, ("analysis_id",))
    if longest < BLOCK:
        return p.withColumn("scale", F.expr("cast(null as array<double>)"))
    # Only series of several blocks need their median changes from all of them: exact percentiles of exploded changes.
    long = p.filter("size(before) > 0 or size(after) > 0")
    scale = None
    for name in ("distance", "lodetection", "spread2"):
        c = long.select("corepoint_id", F.explode(F.expr(_changes(name, furthest))).alias("c"))
        m = c.groupBy("corepoint_id").agg(F.expr("percentile(c, 0.5)").alias(name))
        scale = m if scale is None else scale.join(m, "corepoint_id", "full")
    scale = scale.select("corepoint_id", F.array("distance", "lodetection", "spread2").alias("scale"))
    return p.join(scale, "corepoint_id", "left")


def _changes(name: str, furthest: float) -> str:
    """Absolute changes between successive possible values of a block, and into it from the one before."""
    ok = f"i -> not isnan(i.{name}) and " + (f"abs(i.distance) <= {furthest}" if name == "distance" else f"i.{name} >= 0 and i.{name} < double('inf')")
    last = f"slice(filter(before, {ok}), greatest(size(filter(before, {ok})), 1), 1)"
    vals = f"transform(concat({last}, filter(items, {ok})), i -> i.{name})"
    return f"zip_with(slice({vals}, 1, greatest(size({vals}) - 1, 0)), slice({vals}, 2, greatest(size({vals}) - 1, 0)), (a, b) -> abs(b - a))"


def _batches(batches: Iterator[pa.RecordBatch], periods: tuple[int, ...], times: float, stuck: int, furthest: float):
    """Per batch of packed blocks: series number, fields, flags and which readings are not halo."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        parts = [list_parts(b.column(b.schema.get_field_index(c))) for c in ("before", "items", "after")]
        row = np.concatenate([p[0] for p in parts])
        fields = [np.concatenate([p[1][k] for p in parts]).astype(float) for k in range(1 + len(FIELDS))]
        own = np.concatenate([np.full(len(p[0]), i == 1) for i, p in enumerate(parts)])
        o = np.lexsort((fields[0], row))
        row, fields, own = row[o], [f[o] for f in fields], own[o]
        scale = b.column(b.schema.get_field_index("scale"))
        sc = None if scale.null_count == n else np.array([[np.nan] * 3 if s is None else [np.nan if v is None else v for v in s] for s in scale.to_pylist()]).T
        yield b, row, fields, own, judge(row, fields, n, periods, times, stuck, furthest, sc)


_JUDGED = "analysis_id long, corepoint_id long, epoch_idx int, returned boolean, stuck boolean, impossible boolean, h0 double, h1 double, h2 double, field int, bin int, n long"


def _cutoffs(risk: float, times: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = tail_cutoff(pdf["bin"].to_numpy(), pdf["n"].to_numpy(), risk)
        return pd.DataFrame({"analysis_id": pdf["analysis_id"].iloc[:1], "field": pdf["field"].iloc[:1], "cutoff": [times if np.isnan(z) else z]})

    return run


def tail_levels(judged: DataFrame, risk: float, times: float) -> DataFrame:
    """(analysis_id, cuts): the tail cutoff of each field, in a series' median changes."""
    bins = judged.filter("n is not null").groupBy("analysis_id", "field", "bin").agg(F.sum("n").alias("n"))
    cuts = bins.groupBy("analysis_id", "field").applyInPandas(_cutoffs(risk, times), "analysis_id long, field int, cutoff double")
    return cuts.groupBy("analysis_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "cutoff"))).alias("cuts"))


def flag_readings(distances: DataFrame, times: float = 10.0, risk: float = 1e-3, stuck: int = 5, furthest: float = 25.0, periods: tuple[int, ...] = tuple(range(2, 13)), floor: float = 2.0) -> DataFrame:
    """The readings of `distances` that cannot be trusted, with the reasons.

    Columns: corepoint_id, epoch_idx; spike: its excursion exceeds the tail cutoff of a field; returned: the excursion of
    one or two readings goes beyond `times` the series' median absolute change and comes back; stuck: in a run of `stuck`
    or more equal distances; impossible: |distance| > furthest, lodetection or spread2 negative or infinite, num_samples2
    negative; height and cutoff of the field that exceeds its cutoff most, in median changes of the series. Readings with
    no flag are not given.

    Spikes are peaks over a threshold. A series' residuals are its values beside its season (`seasonal`); an excursion is
    the part of one or two residuals beyond both levels around them, in units of the series' own median change. The
    excursions of an analysis, which are alike in those units, get one generalised Pareto tail per field (`tail_cutoff`),
    and its level of risk `risk` a reading is the cutoff: each source has its own level in metres, and the tail is fitted to
    hundreds of excesses where a single series would offer four. Excursions of under `floor` median changes are no spikes.
    An analysis with too few excesses to fit takes `times` for its cutoff. Impossible values and stuck distances take no
    part as levels. A series with no two values has no spikes.

    Plan: one pass over the series gives the readings of note and the counts of excursions by size; the cutoffs, one per
    analysis and field, come from the counts and are joined to the readings of note.

    Null or NaN distances are no readings; other missing fields are skipped in their own series. Repeated and superseded
    rows: see held_rows. Empty tables give an empty result; further columns are ignored.
    """
    p = _packed(distances, furthest)
    names = [c.split()[0] for c in _JUDGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, fields, own, f in _batches(batches, periods, times, stuck, furthest):
            group = np.unique(b.column(b.schema.get_field_index("analysis_id")).fill_null(-1).to_numpy(), return_inverse=True)
            h = f["height"]
            with np.errstate(invalid="ignore"):
                k = np.flatnonzero(own & (f["returned"] | f["stuck"] | f["impossible"] | (np.fmax.reduce(h) >= floor)))
            nothing = lambda n, t: pa.nulls(n, t)
            aid = b.column(b.schema.get_field_index("analysis_id")).fill_null(-1)
            yield pa.RecordBatch.from_arrays(
                [aid.take(pa.array(row[k])), b.column(b.schema.get_field_index("corepoint_id")).take(pa.array(row[k])), pa.array(fields[0][k].astype(np.int32)), *[pa.array(f[c][k]) for c in ("returned", "stuck", "impossible")], *[pa.array(x[k], mask=np.isnan(x[k])) for x in h], nothing(len(k), pa.int32()), nothing(len(k), pa.int32()), nothing(len(k), pa.int64())],
                names=names,
            )
            for field in range(3):
                ok = own & ~np.isnan(h[field])
                key, n = np.unique(group[1][row[ok]].astype(np.int64) * 1000 + tail_bins(h[field][ok]) - LOWEST, return_counts=True)
                m = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[0][key // 1000]), nothing(m, pa.int64()), nothing(m, pa.int32()), *[nothing(m, pa.bool_())] * 3, *[nothing(m, pa.float64())] * 3, pa.array(np.full(m, field, np.int32)), pa.array((key % 1000 + LOWEST).astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=names,
                )

    judged = materialise(p.select("corepoint_id", F.col("analysis_id").cast("long").alias("analysis_id"), "before", "items", "after", "scale").mapInArrow(run, _JUDGED))
    cuts = if_small(tail_levels(judged, risk, times))
    r = judged.filter("n is null").join(cuts, "analysis_id", "left")
    over = [F.col(f"h{k}") / F.col("cuts")[k] for k in range(3)]
    r = r.withColumn("o", F.greatest(*[F.coalesce(F.when(F.col(f"h{k}") >= floor, v), F.lit(0.0)) for k, v in enumerate(over)]))
    which = lambda of: F.coalesce(*[F.when(over[k] == F.col("o"), of(k)) for k in range(3)])
    r = r.withColumns({"spike": F.col("o") > 1, "height": which(lambda k: F.col(f"h{k}")), "cutoff": which(lambda k: F.col("cuts")[k])})
    return r.filter("spike or returned or stuck or impossible").select(*[c.split()[0] for c in FLAGS.split(", ")])


def trusted_series(distances: DataFrame, times: float = 10.0, stuck: int = 5, furthest: float = 25.0) -> DataFrame:
    """Packed series without the readings that are returned spikes, stuck or impossible: (corepoint_id, block, epochs array<int>, distances array<double>)."""
    p = _packed(distances, furthest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, fields, own, f in _batches(batches, (), times, stuck, furthest):
            k = np.flatnonzero(own & ~(f["returned"] | f["stuck"] | f["impossible"]))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[k], minlength=b.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (fields[0][k].astype(np.int32), fields[1][k])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["corepoint_id", "block", "epochs", "distances"])

    return p.select("corepoint_id", "block", "before", "items", "after", "scale").mapInArrow(run, "corepoint_id long, block long, epochs array<int>, distances array<double>")
