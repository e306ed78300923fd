"""Z-order keys of points and statistics of their cells, as column arithmetic."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 10
AXES = ("x", "y", "z")
#: Steps that spread 10 bits over every third place. Fixed values.
_SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def spread_bits(v: Column) -> Column:
    """10 bits, two empty places after each."""
    v = v.cast("bigint")
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def gather_bits(v: Column) -> Column:
    """Every third bit of v, the inverse of spread_bits."""
    v = v.bitwiseAND(F.lit(0x09249249))
    for shift, mask in reversed([(s, m) for (s, _), m in zip(_SPREAD, (0x3FF, 0x030000FF, 0x0300F00F, 0x030C30C3))]):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def bounding_box(points: DataFrame, cubic: bool = False) -> dict[str, tuple[float, float]]:
    """(low, size) per axis: the next power of two that holds the extent (1 if there is none), centered; cubic takes the largest for all."""
    r = points.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    size = {a: 2.0 ** ceil(log2(r[f"hi{a}"] - r[f"lo{a}"])) if r[f"hi{a}"] > r[f"lo{a}"] else 1.0 for a in AXES}
    if cubic:
        size = dict.fromkeys(AXES, max(size.values()))
    return {a: ((r[f"hi{a}"] + r[f"lo{a}"]) / 2 - size[a] / 2, size[a]) for a in AXES}


def morton(box: dict[str, tuple[float, float]]) -> Column:
    """Z-order key of x, y, z: 10 bits per axis, x in the lowest place."""
    cells = [F.least(F.greatest(F.floor((F.col(a) - box[a][0]) / box[a][1] * 2**DEPTH), F.lit(0)), F.lit(2**DEPTH - 1)) for a in AXES]
    x, y, z = (spread_bits(c) for c in cells)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def at_level(key: Column, level: int | Column) -> Column:
    """Key of the cell of a level (0 the whole box, 10 the finest)."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.floor(key / F.pow(F.lit(8.0), F.lit(DEPTH) - level)).cast("bigint")


def cell_coordinates(key: Column) -> Column:
    """Struct (ix, iy, iz) of a finest key."""
    return F.struct(gather_bits(key).alias("ix"), gather_bits(F.shiftright(key, 1)).alias("iy"), gather_bits(F.shiftright(key, 2)).alias("iz"))


def cells(points: DataFrame, key: Column, level: int) -> DataFrame:
    """(cell, points): occupied cells of a level and their population."""
    return points.groupBy(at_level(key, level).alias("cell")).agg(F.count("*").alias("points"))


def level_statistics(points: DataFrame, key: Column) -> DataFrame:
    """(level, cells, max_points, mean_points, std_points) for all levels; finest cells are counted first, so points shuffle once."""
    fine = points.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    each = fine.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "k", "n")
    c = each.groupBy("level", at_level(F.col("k"), F.col("level")).alias("cell")).agg(F.sum("n").alias("n"))
    return c.groupBy("level").agg(F.count("*").alias("cells"), F.max("n").alias("max_points"), F.avg("n").alias("mean_points"), F.stddev_pop("n").alias("std_points"))


def in_cells(points: DataFrame, key: Column, wanted: DataFrame, level: int) -> DataFrame:
    """Points whose cell of a level is among `wanted` (column cell)."""
    return points.withColumn("cell", at_level(key, level)).join(wanted.select("cell").distinct(), "cell", "left_semi")


def search_level(radius: float, box: dict[str, tuple[float, float]], means: dict[int, float]) -> int:
    """Level whose cells are nearest in size to radius / 1.5 among those with at least 1.5 points on average."""
    size = max(s for _, s in box.values())
    fit = [k for k in range(DEPTH + 1) if means.get(k, 0) >= 1.5] or [0]
    return min(fit, key=lambda k: abs(size / 2**k - radius / 1.5))


def z_sorted(points: DataFrame, key: Column, partitions: int | None = None) -> DataFrame:
    """Points in Z-order, over ranges of the key: neighbours land in the same files."""
    p = points.withColumn("zkey", key)
    return (p.repartitionByRange(partitions, "zkey") if partitions else p.repartitionByRange("zkey")).sortWithinPartitions("zkey")
