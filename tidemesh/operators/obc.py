"""4D objects-by-change: region growing of seeds over neighbouring series, and the ordered sweep over ranked seeds."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import radius_join
from .timeseries import normalised_dtw

THRESHOLDS = tuple(round(0.1 * k, 1) for k in range(1, 10))


def grow(seed: int, start: int, end: int, series: dict[int, np.ndarray], near: dict[int, list[int]], threshold: float, least: int, most: int, distance: Callable = normalised_dtw, known: dict[int, float] | None = None) -> dict[int, float]:
    """Members and their distances to the seed, grown over neighbours at one threshold; `known` keeps distances between calls.

    The nearest member is worked off first (ties: the smaller id), its neighbours in order of nearness. From `least`
    members on, only those below the 5 % largest of the distinct distances so far may spread further.
    """
    members, out, queue, distinct, gate = {seed: 0.0}, set(), [(0.0, seed)], [0.0], threshold
    origin, known = series[seed], {} if known is None else known
    while queue and len(members) < most:
        _, at = heapq.heappop(queue)
        for other in near.get(at, ()):
            if other in members or other in out or other not in series:
                continue
            if other not in known:
                known[other] = distance(origin[start : end + 1], series[other][start : end + 1], origin[0], series[other][0])
            d = known[other]
            if d < threshold:
                members[other] = d
                k = int(np.searchsorted(distinct, d))
                if k == len(distinct) or distinct[k] != d:
                    distinct.insert(k, d)
                if d < gate:
                    heapq.heappush(queue, (d, other))
                if len(members) >= least:
                    gate = distinct[len(distinct) - 1 - int(0.05 * len(distinct))]
                if len(members) >= most:
                    break
            else:
                out.add(other)
    return members


def best_threshold(grown: list[dict[int, float]], thresholds: Sequence[float], least: int, most: int) -> tuple[float, dict[int, float]]:
    """The object of the threshold after which size jumps least; a full one wins at once; one below `least` is dropped ({}); the last if none is picked."""
    last = 0.5
    for i, g in enumerate(grown):
        if len(g) >= most:
            return thresholds[i], g
        if i + 1 < len(grown):
            ratio = len(g) / len(grown[i + 1])
            if ratio <= last:
                return thresholds[i], g if len(g) >= least else {}
            last = ratio
    return thresholds[-1], grown[-1]


def objects_by_change(seeds: DataFrame, series: DataFrame, corepoints: DataFrame, radius: float = 1.0, thresholds: Sequence[float] = THRESHOLDS, least: int = 20, most: int | None = None, by: Sequence[str] = ("analysis_id",), key: str = "corepoint_id", first_rank: int = 1, last_rank: int | None = None, variation: float | None = 0.8, distance: Callable = normalised_dtw) -> DataFrame:
    """(by, object_id, seed_rank, corepoint_id, dtw, start_epoch, end_epoch, threshold) of the accepted objects.

    seeds: (by, key, start_epoch, end_epoch, seed_rank); series: (by, key, values), filled. Analyses are worked off side by
    side, and within one the seeds in rank order: a seed is skipped if an earlier object holds its corepoint over an
    overlapping time, before anything is spent on it. Objects whose distances vary by more than `variation` (deviation over mean) are left out. An analysis is one group: its
    series and neighbours are what a scan area holds.
    """
    edges = radius_join(corepoints, corepoints.withColumnRenamed(key, "_n"), radius, key, "_n", by).filter(F.col("_q") != F.col("_n"))
    near = edges.groupBy(*by, "_q").agg(F.array_sort(F.collect_list(F.struct("d2", F.col("_n").alias("id")))).alias("near")).select(*by, F.col("_q").alias(key), F.transform("near", lambda e: e["id"]).alias("near"))
    s = seeds.filter(F.col("seed_rank") >= first_rank)
    if last_rank is not None:
        s = s.filter(F.col("seed_rank") <= last_rank)
    mine = s.groupBy(*by, key).agg(F.collect_list(F.struct("seed_rank", "start_epoch", "end_epoch")).alias("seeds"))
    busy = mine.select(*by).distinct()
    rows = series.select(*by, key, "values").join(busy, [*by], "left_semi").join(near, [*by, key], "left").join(mine, [*by, key], "left")
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in by], f"object_id int, seed_rank int, {key} {rows.schema[key].dataType.simpleString()}, dtw double, start_epoch int, end_epoch int, threshold double"])
    steps = sorted(thresholds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = {k: np.asarray(v, float) for k, v in zip(pdf[key], pdf["values"])}
        links = {k: list(n) for k, n in zip(pdf[key], pdf["near"]) if n is not None}
        todo = sorted((e["seed_rank"], k, e["start_epoch"], e["end_epoch"]) for k, es in zip(pdf[key], pdf["seeds"]) if es is not None for e in es)
        limit = most or len(values) + 1
        held: dict[int, list[tuple[int, int]]] = {}
        out, number = [], 0
        for rank, k, a, b in todo:
            if any(a < y and x < b for x, y in held.get(k, ())):
                continue
            known: dict[int, float] = {}
            t, g = best_threshold([grow(k, a, b, values, links, t, least, limit, distance, known) for t in steps], steps, least, limit)
            if not g:
                continue
            d = np.array([v for v in g.values()])
            if variation is not None and d.mean() > 0 and d.std() / d.mean() > variation:
                continue
            for m in g:
                held.setdefault(m, []).append((a, b))
            out += [(*[pdf[c].iloc[0] for c in by], number, rank, m, v, a, b, t) for m, v in g.items()]
            number += 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(*by).applyInPandas(run, schema)
