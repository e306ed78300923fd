"""Series of a space-time table: smoothing, filling, change points, seeds and dynamic time warping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .spatial import radius_join

NO_SCORE = 9999999.0


def temporal_averaging(series: DataFrame, window: int = 24, key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance", last: int | None = None) -> DataFrame:
    """Moving median of `value` over the epochs [i - window / 2, i + window / 2), missing ones skipped; (key, epoch, value).

    The last epoch of the table (`last`, or the largest that occurs) is never used, as a source of medians. Windows count
    epochs, not rows, so gaps keep their width. A window below 2 leaves the series as it is.
    """
    s = series.select(key, epoch, F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias(value))
    half = window // 2
    if half < 1:
        return s
    if last is None:
        last = s.agg(F.max(epoch)).first()[0]  # one number
    used = F.when(F.col(epoch) < F.lit(last), F.col(value))
    w = Window.partitionBy(key).orderBy(epoch).rangeBetween(-half, half - 1)
    return s.withColumn("_v", used).select(key, epoch, F.expr("percentile(_v, 0.5)").over(w).alias(value))


def fill_gaps(series: DataFrame, key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance") -> DataFrame:
    """Missing values on the line between their neighbours in epochs, ends held; series with fewer than three values are left as they are.

    Rows of missing epochs must be there (see densify).
    """
    back = Window.partitionBy(key).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(epoch).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    here = F.when(v.isNotNull(), F.struct(F.col(epoch).cast("double").alias("t"), v.alias("v")))
    s = series.select("*", here.alias("_h")).withColumns({"_a": F.last("_h", True).over(back), "_b": F.first("_h", True).over(ahead), "_n": F.count("_h").over(whole)})
    t = F.col(epoch).cast("double")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (t - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    filled = F.coalesce(F.col("_h.v"), line, F.col("_a.v"), F.col("_b.v"))
    return s.withColumn(value, F.when(F.col("_n") >= 3, filled).otherwise(F.col("_h.v"))).drop("_h", "_a", "_b", "_n")


def densify(series: DataFrame, epochs: DataFrame, by: str = "analysis_id", key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance") -> DataFrame:
    """A row for every key and every epoch of its `by`; value null where there was none."""
    keys = series.select(by, key).distinct()
    grid = keys.join(epochs.select(by, epoch).distinct(), by)
    return grid.join(series.select(key, epoch, value), [key, epoch], "left").select(by, key, epoch, value)


def magnitude(series: DataFrame, start: int, end: int, key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance") -> DataFrame:
    """Change of every key between two epochs, in one aggregate."""
    at = lambda e: F.max(F.when(F.col(epoch) == e, F.col(value)))
    return series.filter(F.col(epoch).isin(start, end)).groupBy(key).agg((at(end) - at(start)).alias("change"))


def arrays(series: DataFrame, by: Sequence[str] = ("analysis_id",), key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance") -> DataFrame:
    """(by, key, start, values): each key's values in epoch order, one per row of the (dense) series."""
    items = F.array_sort(F.collect_list(F.struct(epoch, F.coalesce(F.col(value), F.lit(float("nan"))).alias("v"))))
    return series.groupBy(*by, key).agg(items.alias("i")).select(*by, key, F.expr(f"i[0].{epoch}").alias("start"), F.expr("transform(i, x -> x.v)").alias("values"))


# --- change points -----------------------------------------------------------------------------------------------


def l1_cost(x: np.ndarray) -> float:
    """Sum of absolute deviations from the median."""
    return float(np.abs(x - np.median(x)).sum()) if len(x) else 0.0


def window_scores(x: np.ndarray, width: int, jump: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (multiples of jump, half a window from both ends) and how much cost a break there saves in its window."""
    h = width // 2
    n = len(x)
    at = np.arange(0, n, jump)
    at = at[(at >= h) & (at < n - h)]
    if not len(at) or h < 1:
        return at[:0], np.zeros(0)
    both = np.lib.stride_tricks.sliding_window_view(x, 2 * h)
    half = np.lib.stride_tricks.sliding_window_view(x, h)
    whole = np.abs(both - np.median(both, axis=1)[:, None]).sum(1)
    part = np.abs(half - np.median(half, axis=1)[:, None]).sum(1)
    return at, whole[at - h] - part[at - h] - part[at]


def ring_maxima(score: np.ndarray, order: int) -> list[int]:
    """Places strictly above all within `order` on both sides; a side that is cut by an end goes on from the other end.

    After a maximum the next candidate is order + 1 further. No maxima if order reaches the number of scores.
    """
    n = len(score)
    if order < 1 or n < 2 or order >= n:
        return []
    out, i = [], 0
    while i < n:
        left = score[max(0, i - order) : i]
        right = score[i + 1 : i + order + 1]
        top_left = left.max() if len(left) else 0.0
        top_right = right.max() if len(right) else 0.0
        if i < order:
            rest = score[n - (order - len(left)) :].max()
            top_left = max(top_left, rest) if len(left) else rest
        elif i > n - order - 1:
            rest = score[: order - len(right)].max()
            top_right = max(top_right, rest) if len(right) else rest
        if score[i] > top_left and score[i] > top_right:
            out.append(i)
            i += order + 1
        else:
            i += 1
    return out


def change_points(x: np.ndarray, width: int = 24, min_size: int = 12, jump: int = 1, penalty: float = 1.0) -> list[int]:
    """Ends of the pieces of a series by sliding windows with L1 cost; the last is its length."""
    x = np.asarray(x, float)
    at, score = window_scores(x, width, jump)
    order = max(max(width, 2 * min_size) // (2 * jump), 1)
    peaks = sorted(ring_maxima(score, order), key=lambda k: -score[k])
    cuts = [len(x)]
    cost = lambda ends: sum(l1_cost(x[a:b]) for a, b in zip([0, *ends], ends))
    now = cost(cuts)
    for k in peaks:
        then_cuts = sorted([*cuts, int(at[k])])
        then = cost(then_cuts)
        if now - then <= penalty:
            break
        cuts, now = then_cuts, then
    return cuts


def with_change_points(series: DataFrame, width: int = 24, min_size: int = 12, jump: int = 1, penalty: float = 1.0) -> DataFrame:
    """Adds change_points (array<int>) to rows with `values`; gaps filled; null for series with over T - 3 missing values or no more than `width` epochs."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or len(v) <= width or (f := filled(np.asarray(v, float))) is None else change_points(f, width, min_size, jump, penalty))

    return series.withColumn("change_points", run("values"))


def filled(x: np.ndarray) -> np.ndarray | None:
    """x with missing values interpolated, ends held; None if fewer than three values are there."""
    bad = np.isnan(x)
    if bad.sum() > len(x) - 3:
        return None
    if not bad.any():
        return x
    t = np.arange(len(x))
    return np.interp(t, t[~bad], x[~bad])


# --- seeds -------------------------------------------------------------------------------------------------------


def seeds_of(x: np.ndarray, width: int = 24, min_size: int = 12, jump: int = 1, penalty: float = 1.0, minperiod: int = 24, height: float = 0.0, use_unfinished: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the changes that begin at the change points of a filled series."""
    n = len(x)
    if width >= n:
        raise ValueError("the window must be shorter than the series")
    up = x + abs(x.min() + 0.1)
    down = -up + abs(up.max()) + 0.1
    out: list[tuple[int, int]] = []
    for c in change_points(x, width, min_size, jump, penalty)[:-1]:
        if out and c <= out[-1][1]:
            continue
        if c >= n - minperiod:
            break
        u = down if up[c] >= up[c + minperiod] else up
        below = np.flatnonzero(u[c + 2 :] < u[c])
        if len(below):
            end = c + 2 + int(below[0])
            if end - c >= minperiod and np.ptp(u[c : end + 1]) >= height:
                out.append((c, end))
        elif use_unfinished:
            out.append((c, n - 1))
    return out


def find_seeds(series: DataFrame, by: Sequence[str] = ("analysis_id",), key: str = "corepoint_id", **options) -> DataFrame:
    """(by, key, start_epoch, end_epoch) of rows with `values`; series that are too short or too empty have none."""
    width = options.get("width", 24)

    @F.pandas_udf("array<struct<start_epoch: int, end_epoch: int>>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or len(v) <= width or (x := filled(np.asarray(v, float))) is None:
                return []
            return [{"start_epoch": a, "end_epoch": b} for a, b in seeds_of(x, **options)]

        return values.map(one)

    return series.select(*by, key, F.explode(run("values")).alias("s")).select(*by, key, "s.*")


# --- dynamic time warping ----------------------------------------------------------------------------------------


def dtw(a: np.ndarray, b: np.ndarray, norm_a: float = 0.0, norm_b: float = 0.0) -> float:
    """Dynamic time warping distance with absolute cost; places missing in either series are dropped; NaN if none is left.

    Rows are worked off as whole vectors: a path within a row adds its costs, so the row's minimum is a running one.
    """
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok] - norm_a, b[ok] - norm_b
    if not len(a):
        return float("nan")
    cost = np.abs(a[:, None] - b[None, :])
    row = np.cumsum(cost[0])
    for c in cost[1:]:
        enter = np.minimum(row, np.r_[np.inf, row[:-1]])
        total = np.cumsum(c)
        row = total + np.minimum.accumulate(enter - (total - c))
    return float(row[-1])


def normalised_dtw(a: np.ndarray, b: np.ndarray, norm_a: float = 0.0, norm_b: float = 0.0) -> float:
    """min(1, dtw / sum |a|); 1 where that is undefined."""
    d, total = dtw(a, b, norm_a, norm_b), float(np.nansum(np.abs(a)))
    if np.isnan(d) or total == 0:
        return 1.0
    return min(1.0, d / total)


def seed_scores(seeds: DataFrame, series: DataFrame, corepoints: DataFrame, radius: float, by: Sequence[str] = ("analysis_id",), key: str = "corepoint_id", distance: Callable[[np.ndarray, np.ndarray], float] = dtw) -> DataFrame:
    """Seeds with score, the mean distance over [start, end] to the series of corepoints within radius, and seed_rank (ascending score).

    NO_SCORE for seeds with fewer than two neighbours. Ranks break ties by corepoint and start.
    """
    edges = radius_join(corepoints, corepoints.withColumnRenamed(key, "_n"), radius, key, "_n", by).filter(F.col("_q") != F.col("_n")).select(*by, F.col("_q").alias(key), "_n")
    v = series.select(*by, key, "values")
    pairs = seeds.join(edges, [*by, key]).join(v, [*by, key]).join(v.select(*by, F.col(key).alias("_n"), F.col("values").alias("other")), [*by, "_n"])

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([distance(np.asarray(x, float)[i : j + 1], np.asarray(y, float)[i : j + 1]) for x, y, i, j in zip(a, b, s, e)])

    d = pairs.select(*by, key, "start_epoch", "end_epoch", run("values", "other", "start_epoch", "end_epoch").alias("d")).groupBy(*by, key, "start_epoch", "end_epoch").agg(F.sum(F.when(~F.isnan("d"), F.col("d"))).alias("total"), F.count("*").alias("m"))
    out = seeds.join(d, [*by, key, "start_epoch", "end_epoch"], "left")
    score = F.when(F.coalesce("m", F.lit(0)) >= 2, F.col("total") / F.col("m")).otherwise(F.lit(NO_SCORE))
    out = out.select(*by, key, "start_epoch", "end_epoch", score.alias("score"))
    return out.withColumn("seed_rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", key, "start_epoch")))


def time_deltas(epochs: DataFrame, by: str = "analysis_id") -> DataFrame:
    """Epochs with delta_seconds to the first timed epoch of their analysis."""
    e = epochs.dropDuplicates([by, "epoch_idx"])
    first = e.filter(F.col("ts").isNotNull()).groupBy(by).agg(F.min("ts").alias("_first"))
    return e.join(first, by, "left").withColumn("delta_seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("_first").cast("timestamp")) / 1e6).drop("_first")


def cluster_medians(series: DataFrame, clusters: DataFrame, key: str = "corepoint_id", epoch: str = "epoch_idx", value: str = "distance", by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, epoch, median) of the series of each cluster."""
    return series.join(clusters.select(*by, key, "cluster"), [*by, key]).groupBy(*by, "cluster", epoch).agg(F.median(value).alias("median"))


def lloyd(x: np.ndarray, k: int, seed: int = 1, rounds: int = 300) -> np.ndarray:
    """The cluster of every row of x: k-means++ starts, then rounds until none moves. At most k clusters, numbered by their first rows."""
    rng = np.random.default_rng(seed)
    away = lambda centres: np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    centres = x[[rng.integers(len(x))]]
    near = away(centres)[:, 0]
    while len(centres) < k and near.sum() > 0:
        centres = np.r_[centres, x[[rng.choice(len(x), p=near / near.sum())]]]
        near = np.minimum(near, away(centres[-1:])[:, 0])
    label = away(centres).argmin(1)
    for _ in range(rounds):
        held = np.unique(label)
        centres = np.stack([x[label == c].mean(0) for c in held])
        then = away(centres).argmin(1)
        if (held[then] == label).all():
            break
        label = then
    _, first, label = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def kmeans(series: DataFrame, k: int, key: str = "corepoint_id", seed: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, cluster): k-means of whole series of equal length in `values`; series with missing values are left out.

    With `by`, each group is clustered by itself, in one task, and only its own series need be of equal length.
    """
    rows = series.filter(~F.exists("values", lambda v: v.isNull() | F.isnan(v)))
    if by:
        fields = rows.select(*by, key).withColumn("cluster", F.lit(0)).schema

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(key)
            return g[[*by, key]].assign(cluster=lloyd(np.stack(g["values"].to_list()), k, seed).astype(np.int32))

        return rows.select(*by, key, "values").groupBy(*by).applyInPandas(run, fields)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(key, array_to_vector("values").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))


def components(gram: np.ndarray, total: np.ndarray, n: int, k: int) -> np.ndarray:
    """The first k principal components (columns, largest loading positive) from sums of n series and of their products; fewer where fewer vary."""
    value, vector = np.linalg.eigh(gram - np.outer(total, total) / n)
    vector = vector[:, ::-1][:, : min(k, int((value > 1e-10 * max(np.trace(gram), 1e-300)).sum()))]
    return vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])]) if vector.size else vector


def pca(series: DataFrame, k: int, key: str = "corepoint_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, component, epoch_idx, loading): principal components over time of whole series; the Gram matrix is epochs x epochs.

    epoch_idx is the place in `values`. With `by`, each group has its own components, and only its own series need be of
    equal length; a group's products are summed batch by batch, so none is held whole.
    """
    rows = series.filter(~F.exists("values", lambda v: v.isNull() | F.isnan(v)))
    if by:
        sums = StructType([*rows.select(*by).schema, StructField("n", LongType()), StructField("total", ArrayType(DoubleType())), StructField("gram", ArrayType(DoubleType()))])
        fields = StructType([*rows.select(*by).schema, StructField("component", IntegerType()), StructField("epoch_idx", IntegerType()), StructField("loading", DoubleType())])

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(*name, len(x), x.sum(0), (x.T @ x).ravel()) for name, g in b.groupby([*by]) for x in [np.stack(g["values"].to_list())]]
                yield pd.DataFrame(out, columns=sums.names)

        def whole(g: pd.DataFrame) -> pd.DataFrame:
            total = np.stack(g["total"].to_list()).sum(0)
            v = components(np.stack(g["gram"].to_list()).sum(0).reshape(len(total), -1), total, int(g["n"].sum()), k)
            return pd.DataFrame([(*g[[*by]].iloc[0], j, i, float(v[i, j])) for j in range(v.shape[1]) for i in range(len(v))], columns=fields.names)

        return rows.select(*by, "values").repartition(*by).sortWithinPartitions(*by).mapInPandas(part, sums).groupBy(*by).applyInPandas(whole, fields)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(key, array_to_vector("values").alias("features"))
    m = PCA(k=k, inputCol="features", outputCol="p").fit(rows).pc.toArray()
    return series.sparkSession.createDataFrame([(j, i, float(m[i, j])) for j in range(m.shape[1]) for i in range(m.shape[0])], "component int, epoch_idx int, loading double")
