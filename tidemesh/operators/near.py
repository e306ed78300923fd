"""Points near other points, and the regions that hold them, as grid-keyed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import salted, usable


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def points_near(queries: DataFrame, points: DataFrame, radius: float, query_id: str, point_id: str, strict: bool = False) -> DataFrame:
    """Pairs (query_id, point_id, d2) at most `radius` apart in 3D (closer than it, if strict).

    Both sides need x, y, z; other columns are ignored, whatever their names. Rows with a null, NaN or infinite
    coordinate or a null id give nothing. Repeated rows of an id count once (copies are taken to be equal). Empty tables
    give an empty result. Ties do not matter: every pair within the radius is given. A query side of the same name as the
    point side is allowed if the id columns differ.

    Plan: cubes of edge 2r, so that a query's ball touches 8 of them; the query side alone is repeated, so each pair
    meets once. Cubes that hold very many points are sliced by point id (`salted`).
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    size = 2.0 * radius
    axes = ("x", "y", "z")
    q = queries.select(F.col(query_id).alias("_q"), *[F.col(a).cast("double").alias(f"q{a}") for a in axes]).filter(usable(*[F.col(f"q{a}") for a in axes]) & F.col("_q").isNotNull())
    q = q.dropDuplicates(["_q"])
    for a in axes:
        q = q.withColumn(f"c{a}", F.explode(F.sequence(_cell(F.col(f"q{a}") - radius, size), _cell(F.col(f"q{a}") + radius, size))))
    p = points.select(F.col(point_id).alias("_p"), *[F.col(a).cast("double").alias(a) for a in axes]).filter(usable(*[F.col(a) for a in axes]) & F.col("_p").isNotNull())
    p = p.select("*", *[_cell(F.col(a), size).alias(f"c{a}") for a in axes])
    key = F.xxhash64("cx", "cy", "cz")
    p, q = salted(p, q, key, F.col("_p"))
    keys = ["cx", "cy", "cz", "_salt"]
    p = p.repartition(*keys).dropDuplicates([*keys, "_p"])  # copies meet in their cube; no further shuffle
    d2 = sum((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in axes)
    near = q.join(p, keys).withColumn("d2", d2)
    limit = F.lit(float(radius)) * F.lit(float(radius))
    near = near.filter(F.col("d2") < limit if strict else F.col("d2") <= limit)
    return near.select(F.col("_q").alias(query_id), F.col("_p").alias(point_id), "d2")


def ring_edges(regions: DataFrame, region_id: str, ring: str = "ring") -> DataFrame:
    """One row per edge (rid, x1, y1, x2, y2, xmin) of every usable ring, closed if it was open.

    A ring is a flat list x0, y0, x1, y1, ...; a null list, an odd length, a null, NaN or infinite number or fewer than
    three different corners give no edge. Repeated regions count once.
    """
    r = regions.select(F.col(region_id).alias("rid"), F.col(ring).cast("array<double>").alias("r")).dropDuplicates(["rid"])
    bad = F.exists("r", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    r = r.filter(F.col("rid").isNotNull() & F.col("r").isNotNull() & (F.size("r") % 2 == 0) & (F.size("r") >= 6) & ~F.coalesce(bad, F.lit(True)))
    r = r.withColumn("v", F.expr("transform(sequence(0, size(r) div 2 - 1), i -> struct(r[2 * i] as x, r[2 * i + 1] as y))"))
    r = r.filter(F.size(F.array_distinct("v")) >= 3).withColumn("xmin", F.expr("aggregate(v, v[0].x, (a, p) -> least(a, p.x))"))
    e = r.select("rid", "xmin", F.explode(F.expr("transform(v, (p, i) -> struct(p.x as x1, p.y as y1, v[(i + 1) % size(v)].x as x2, v[(i + 1) % size(v)].y as y2))")).alias("e"))
    return e.select("rid", "xmin", "e.*").filter("x1 <> x2 or y1 <> y2")


def regions_holding(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, ring: str = "ring", on_outline: bool = True, strip: float = 4.0, column: float = 16.0) -> DataFrame:
    """Pairs (point_id, region_id) where the point's (x, y) lies inside the region's ring; by crossing parity.

    Edges are binned into latitude strips of height `strip`; within a strip an edge stands in the columns from its
    region's west end to its own east end, since only points west of an edge can send a ray through it. Candidates join
    on (level, strip, column), and the crossings are counted by point and region: odd is inside. Points on an edge are
    decided by on_outline, apart from the parity. Long edges use bins doubled `level` times, so an edge never takes more
    than a bounded number of bins; points look into every level that occurs.

    Null, NaN or infinite coordinates and null ids give nothing, repeated rows count once, empty tables give an empty
    result; see ring_edges for unusable rings.
    """
    e = ring_edges(regions, region_id, ring)
    e = e.select("*", F.least("y1", "y2").alias("ylo"), F.greatest("y1", "y2").alias("yhi"), F.greatest("x1", "x2").alias("xhi"))
    spread = F.greatest((F.col("yhi") - F.col("ylo")) / strip, (F.col("xhi") - F.col("xmin")) / column, F.lit(1.0))
    e = e.withColumn("level", F.greatest(F.ceil(F.log2(spread / 12.0)), F.lit(0)).cast("int"))
    scale = F.pow(F.lit(2.0), F.col("level"))
    e = e.withColumn("sy", F.explode(F.sequence(F.floor(F.col("ylo") / (scale * strip)), F.floor(F.col("yhi") / (scale * strip)))))
    e = e.withColumn("sx", F.explode(F.sequence(F.floor(F.col("xmin") / (scale * column)), F.floor(F.col("xhi") / (scale * column)))))
    levels = [r[0] for r in e.select("level").distinct().collect()]  # at most some 40: powers of two of a length
    p = points.select(F.col(point_id).alias("pid"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter(usable(F.col("px"), F.col("py")) & F.col("pid").isNotNull())
    p = p.dropDuplicates(["pid"]).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
    p = p.select("*", F.floor(F.col("py") / (scale * strip)).alias("sy"), F.floor(F.col("px") / (scale * column)).alias("sx"))
    p, e = salted(p, e, F.xxhash64("level", "sy", "sx"), F.col("pid"))
    c = p.join(e, ["level", "sy", "sx", "_salt"])
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("px") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on = (side == 0) & F.col("px").between(F.least("x1", "x2"), F.col("xhi")) & F.col("py").between(F.col("ylo"), F.col("yhi"))
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    east = F.when(F.col("y2") > F.col("y1"), side > 0).otherwise(side < 0)
    c = c.withColumn("on", on.cast("int")).withColumn("cross", (spans & east).cast("int")).filter("on = 1 or cross = 1")
    hit = c.groupBy("pid", "rid").agg(F.sum("cross").alias("n"), F.max("on").alias("edge"))
    inside = hit.filter(F.when(F.col("edge") == 1, F.lit(on_outline)).otherwise(F.col("n") % 2 == 1))
    return inside.select(F.col("pid").alias(point_id), F.col("rid").alias(region_id))
