"""Cloud-to-cloud distances and outlier filters: SOR and ScOR."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import if_small, materialise, salted, usable
from .spatial import AXES, clean, mean_distance, nearest


def c2c(source: DataFrame, target: DataFrame, source_id: str = "source_id", target_id: str = "target_id", max_distance: float | None = None, both_ways: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, source_id, target_id, distance): nearest target of every usable source; null beyond max_distance or without targets.

    both_ways keeps a distance only where the source is also its target's nearest source.
    """
    if not both_ways:
        return nearest(source, target, source_id, target_id, by, max_distance)
    source, target = materialise(clean(source, source_id, by)), materialise(clean(target, target_id, by))
    forward = nearest(source, target, source_id, target_id, by, max_distance, ready=True)
    back = nearest(target, source, target_id, source_id, by, max_distance, ready=True)  # every target once
    back = back.filter(F.col(source_id).isNotNull()).select(*by, source_id, target_id, F.lit(True).alias("_both"))
    pairs = forward.join(back, [*by, source_id, target_id], "left")
    return pairs.select(*by, source_id, *[F.when(F.col("_both"), F.col(c)).alias(c) for c in (target_id, "distance")])


def sor(points: DataFrame, k: int = 6, multiplier: float = 1.0, point_id: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, point_id, mean_distance, outlier): statistical outliers, whose mean distance to their k nearest others exceeds mean + multiplier * population deviation over all (of their `by`).

    With fewer than k other points all of them count; a single point has mean 0.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    mean = materialise(mean_distance(points, k, point_id, by))
    limit = mean.groupBy(*by).agg((F.avg("mean_distance") + float(multiplier) * F.stddev_pop("mean_distance")).alias("limit"))
    out = mean.join(if_small(limit), list(by)) if by else mean.crossJoin(F.broadcast(limit))  # one row
    return out.select(*by, point_id, "mean_distance", (F.col("mean_distance") > F.col("limit")).alias("outlier"))


def spherical(points: DataFrame, position: tuple) -> DataFrame:
    """Adds range, elevation and azimuth (radians) as seen from a scan position: three numbers, or names of columns."""
    d = [F.col(a) - (F.col(o) if isinstance(o, str) else float(o)) for a, o in zip(AXES, position)]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    return points.withColumns({"range": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), "elevation": F.atan2(d[2], flat), "azimuth": F.atan2(d[1], d[0])})


def angular_offsets(increment: float) -> list[tuple[int, int]]:
    """Bins around one's own: four neighbours for 0.5, else the full window of `increment` bins without its centre."""
    if increment == 0.5:
        return [(-1, 0), (0, -1), (0, 1), (1, 0)]
    if increment < 1 or increment != int(increment):
        raise ValueError("increment must be 0.5 or a positive whole number")
    m = int(increment)
    return [(i, j) for i in range(-m, m + 1) for j in range(-m, m + 1) if (i, j) != (0, 0)]


def angular_bins(points: DataFrame, position: tuple, resolution: float) -> DataFrame:
    """Adds phi and theta: elevation and azimuth from a scan position, in degrees over resolution, rounded half to even."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    return spherical(points, position).withColumns({"phi": F.rint(F.degrees("elevation") / resolution).cast("long"), "theta": F.rint(F.degrees("azimuth") / resolution).cast("long")})


def scor(search: DataFrame, position: tuple, resolution: float, increment: float = 0.5, candidates: DataFrame | None = None, point_id: str = "point_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, point_id, score): expected over observed mean distance to the points in the angular bins around, within [0, 1].

    Bins are elevation and azimuth in degrees over resolution, rounded half to even; a point's own bin is left out and
    azimuth does not wrap. expected = range * mean of tan(resolution * offset); observed is the mean 3D distance to all
    candidates in the offset bins, 99999 if there is none; an observed 0 counts as 1e-6. Candidates are the search points
    unless others (one or more epochs, united) are given.
    """
    from math import hypot, radians, tan

    offsets = angular_offsets(increment)
    factor = sum(tan(radians(resolution) * hypot(i, j)) for i, j in offsets) / len(offsets)

    def binned(p: DataFrame) -> DataFrame:
        return angular_bins(p, position, resolution)

    seen_from = [o for o in position if isinstance(o, str)]
    q = binned(clean(search, point_id, by, seen_from)).select(*by, F.col(point_id).alias("_q"), "range", *[F.col(a).alias(f"q_{a}") for a in AXES], "phi", "theta")
    c = candidates if candidates is not None else search
    p = binned(c.filter(usable(*[F.col(a) for a in AXES])).select(*by, *AXES, *seen_from)).select(*by, *AXES, "phi", "theta")
    ring = F.explode(F.array(*[F.struct((F.col("phi") + i).alias("phi"), (F.col("theta") + j).alias("theta")) for i, j in offsets]))
    asked = q.select(*by, "_q", "q_x", "q_y", "q_z", ring.alias("b")).select(*by, "_q", "q_x", "q_y", "q_z", "b.phi", "b.theta")
    d = F.sqrt(sum((F.col(a) - F.col(f"q_{a}")) * (F.col(a) - F.col(f"q_{a}")) for a in AXES))
    p, asked = salted(p, asked, F.xxhash64(*by, "phi", "theta"), F.hash(*AXES))
    seen = asked.join(p, [*by, "phi", "theta", "_salt"]).groupBy(*by, "_q").agg(F.avg(d).alias("observed"))
    out = q.select(*by, "_q", "range").join(seen, [*by, "_q"], "left")
    observed = F.coalesce("observed", F.lit(99999.0))
    score = F.least(F.greatest(F.col("range") * factor / F.when(observed == 0, 1e-6).otherwise(observed), F.lit(0.0)), F.lit(1.0))
    return out.select(*by, F.col("_q").alias(point_id), score.alias("score"))
