"""Range, cylinder and nearest-neighbour joins of points, on grid cells.

Points are DataFrames with an id and x, y, z; `by` names columns (a site, an epoch, ...) that both sides share and that must be
equal. Rows with a null, NaN or infinite coordinate or a null id take no part; repeated ids count once; empty sides give
empty results. Columns that are not asked for are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import kdtree
from ..functions.runtime import materialise, salted, usable

AXES = ("x", "y", "z")


def clean(points: DataFrame, point_id: str, by: Sequence[str] = (), keep: Sequence[str] = (), copies: bool = False) -> DataFrame:
    """by, point_id, x, y, z and `keep` of the usable points; one row per (by, id) unless copies are kept."""
    names = list(dict.fromkeys([*by, point_id, *AXES, *keep]))
    p = points.select(*[F.col(c).cast("double").alias(c) if c in AXES else F.col(c) for c in names])
    p = p.filter(usable(*[F.col(a) for a in AXES]) & F.col(point_id).isNotNull())
    return p if copies else p.dropDuplicates([*by, point_id])


def _queries(queries: DataFrame, query_id: str, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    q = clean(queries, query_id, by, keep)
    return q.select(*by, F.col(query_id).alias("_q"), *[F.col(a).alias(f"q_{a}") for a in AXES], *[F.col(c).alias(f"q_{c}") for c in keep if c not in AXES and c not in by and c != query_id])


def box_join(q: DataFrame, p: DataFrame, half: dict[str, Column], size: float, by: Sequence[str], row: Column) -> DataFrame:
    """Candidates: every q with every p within its box q_x +- half[x], ...; each pair once, since only q is repeated over cells."""
    cell = {a: F.floor(F.col(a) / F.lit(float(size))) for a in AXES}
    for a in AXES:
        q = q.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(f"q_{a}") - half[a]) / size), F.floor((F.col(f"q_{a}") + half[a]) / size))))
    p = p.withColumns({f"_c{a}": cell[a] for a in AXES})
    cells = [f"_c{a}" for a in AXES]
    p, q = salted(p, q, F.xxhash64(*by, *cells), row)
    return q.join(p, [*by, *cells, "_salt"]).drop(*cells, "_salt")


def radius_join(queries: DataFrame, points: DataFrame, radius: float, query_id: str, point_id: str, by: Sequence[str] = (), keep: Sequence[str] = (), keep_queries: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Pairs within radius (closer, if strict): by, query id as `_q`, q_x.., point columns, d2."""
    r = float(radius)
    q, p = _queries(queries, query_id, by, keep_queries), clean(points, point_id, by, keep)
    c = box_join(q, p, {a: F.lit(r) for a in AXES}, 2 * r, by, F.col(point_id))
    c = c.withColumn("d2", sum((F.col(a) - F.col(f"q_{a}")) * (F.col(a) - F.col(f"q_{a}")) for a in AXES))
    return c.filter(F.col("d2") < r * r if strict else F.col("d2") <= r * r)


def cylinder_join(queries: DataFrame, points: DataFrame, radius: float, max_distance: float, query_id: str, point_id: str, by: Sequence[str] = (), keep: Sequence[str] = (), keep_queries: Sequence[str] = (), closed_ends: bool = False) -> DataFrame:
    """Pairs with the point in the query's cylinder: axis (nx, ny, nz) through the query, `radius` inclusive, half length max(max_distance, radius).

    Ends are open unless closed_ends, which also takes max_distance as it is. Adds along (signed distance on the axis)
    and across2. Queries without a whole axis match nothing.
    """
    r = float(radius)
    half = float(max_distance) if closed_ends else max(float(max_distance), r)
    q = _queries(queries, query_id, by, ["nx", "ny", "nz", *keep_queries]).filter(usable(F.col("q_nx"), F.col("q_ny"), F.col("q_nz")))
    p = clean(points, point_id, by, keep)
    reach = {a: F.abs(F.col(f"q_n{a}")) * half + r * F.sqrt(F.greatest(1 - F.col(f"q_n{a}") * F.col(f"q_n{a}"), F.lit(0.0))) for a in AXES}
    c = box_join(q, p, reach, max(2 * r, half), by, F.col(point_id))
    d = {a: F.col(a) - F.col(f"q_{a}") for a in AXES}
    c = c.withColumn("along", sum(d[a] * F.col(f"q_n{a}") for a in AXES))
    c = c.withColumn("across2", sum(d[a] * d[a] for a in AXES) - F.col("along") * F.col("along"))
    ends = F.abs("along") <= half if closed_ends else F.abs("along") < half
    return c.filter((F.col("across2") <= r * r) & ends)


#: Points that a leaf of a cloud should hold, queries that meet it at once, and rows of a sample.
LEAF_POINTS, LEAF_QUERIES, SAMPLE = 16_000, 200_000, 40_000


def _sampled(t: DataFrame, by: Sequence[str], prefix: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows of t, and groups and places of at most SAMPLE of them; they steer only where points and queries meet."""
    n = t.count()
    s = t.select(_group(by).alias("g"), *[F.col(f"{prefix}{a}") for a in AXES])
    s = (s if n <= SAMPLE else s.sample(0.95 * SAMPLE / n, 1).limit(SAMPLE)).toPandas()
    return n, s["g"].to_numpy(np.int64), s[[f"{prefix}{a}" for a in AXES]].to_numpy(float)


def _group(by: Sequence[str]) -> Column:
    return F.xxhash64(*by) if by else F.lit(0).cast("long")


def _placed(t: DataFrame, by: Sequence[str], prefix: str, leaves: kdtree.Leaves, parts: np.ndarray, trim: tuple[str, int] | None = None) -> DataFrame:
    """t with `_leaf` and `_part`: queries are spread over their leaf's parts, points (`trim`: their id and how many count at one place) are repeated in all of them."""
    schema, kept = StructType([*t.schema.fields, StructField("_leaf", IntegerType()), StructField("_part", IntegerType())]), t.columns

    def place(batches):
        for batch in batches:
            xyz, g = kdtree.places(batch, prefix), batch.column("_hash").to_numpy(zero_copy_only=False)
            rows = np.arange(len(xyz))
            if trim:  # of many copies at one place only the smallest ids can be among the nearest
                order = np.lexsort((kdtree.ranks(batch.column(trim[0])), *xyz.T, g))
                v = np.c_[g[order].astype(float), xyz[order]]
                new = np.r_[True, (v[1:] != v[:-1]).any(1) | (g[order][1:] != g[order][:-1])] if len(order) else np.empty(0, bool)
                start = np.flatnonzero(new)
                rows = np.sort(order[np.arange(len(order)) - start[np.cumsum(new) - 1] < trim[1]]) if len(order) else order
            leaf = leaves.of(g[rows], xyz[rows])
            many = np.where(leaf >= 0, parts[leaf], 1) if len(parts) else np.ones(len(rows), int)
            if trim:
                part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows, leaf = np.repeat(rows, many), np.repeat(leaf, many)
            else:
                part = np.arange(len(rows)) % many
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in kept], pa.array(leaf, pa.int32()), pa.array(part, pa.int32())], names=schema.names)

    return t.withColumn("_hash", _group(by)).mapInArrow(place, schema)


def _boxes(p: DataFrame, by: Sequence[str], leaves: kdtree.Leaves) -> np.ndarray:
    """Points, and the corners of the box that holds them, of every leaf (7 numbers each)."""
    ends = [f(a) for f in (F.min, F.max) for a in AXES]
    out = np.full((len(leaves.low), 7), np.nan)
    out[:, 0] = 0
    for r in _placed(p, by, "", leaves, np.ones(len(leaves.low), int), ("_p", 2**31)).groupBy("_leaf").agg(F.count("*"), *ends).filter("_leaf >= 0").collect():
        out[r[0]] = r[1:]
    return out


def _neighbours(q: DataFrame, p: DataFrame, k: int, by: Sequence[str], exclude_self: bool, max_distance: float | None, mean: bool = False, carry: Sequence[str] = (), known: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Of tables q (by, _q, q_x, ..) and p (by, _p, x, ..): a table with a row (by, _q, _p, d2: lists by rank) of every query, and rows (by, _q, _p, d2) of those whose search went on (their `_ask` in the table is not empty), with a null _p for those that found nothing.

    Points are cut into leaves, boxes by the medians of a sample. Each query first meets the points of its own leaf. Where
    its k nearest of them are closer than the leaf's sides, these are the answer; other queries then meet the leaves whose
    points' boxes are no farther than the k-th found, or than the k-th can be by the boxes' counts. mean: q and p are one
    table, which is sent once where no leaf is sliced; d2 of settled queries holds one value, the mean distance, and _p nothing.
    carry: columns of p that come as lists beside _p, with the places of all queries. known: keeps p's leaves for the next
    search in the same p and by, and this search's table as `top`.
    """
    cap = None if max_distance is None else float(max_distance) * float(max_distance)
    known = {} if known is None else known
    if "leaves" not in known:
        n, group, xyz = _sampled(p, by, "")
        known["leaves"] = kdtree.Leaves(group, xyz, max(8, int(LEAF_POINTS * len(xyz) / max(n, 1))))
    leaves = known["leaves"]
    nq, q_group, q_xyz = (n, group, xyz) if mean else _sampled(q, by, "q_")
    asked = np.bincount(at[at >= 0] if len(at := leaves.of(q_group, q_xyz)) else np.empty(0, int), minlength=len(leaves.low))
    parts = np.maximum(1, np.ceil(asked * nq / max(len(q_group), 1) / LEAF_QUERIES)).astype(int)
    whole = len(leaves.low) == len(leaves.names)
    if "box" not in known:
        known["box"] = None if whole else _boxes(p, by, leaves)
    box = known["box"]
    need = k + exclude_self
    names = [f.name for f in q.select(*by, "_q").schema.fields]
    types = {f.name: f for f in [*q.schema.fields, *p.schema.fields]}
    lists = [StructField("_p", ArrayType(types["_p"].dataType)), StructField("d2", ArrayType(DoubleType()))]
    lists += [StructField(c, ArrayType(types[c].dataType)) for c in carry]
    own_place = [StructField(f"q_{a}", DoubleType()) for a in AXES]
    schema = StructType([*[types[c] for c in names], *own_place, *lists, StructField("_ask", ArrayType(IntegerType()))])
    at_open = [f"q_{a}" for a in AXES] if carry else []
    schema2 = StructType([*[types[c] for c in names], *(own_place if carry else []), *lists])

    def found(left: pa.Table, right: pa.Table, first: bool) -> pa.Table:
        ids, rank = right.column("_p").combine_chunks(), kdtree.ranks(right.column("_p"))
        at, pts = kdtree.places(left, "q_"), kdtree.places(right)
        own = None
        if exclude_self:
            own = pc.fill_null(pc.index_in(left.column("_q").combine_chunks(), value_set=ids), -1).to_numpy(zero_copy_only=False)
        bound = np.full(len(at), np.inf if cap is None else cap) if first else left.column("_bound").to_numpy()
        who, what, d2 = kdtree.search(pts, rank, at, k, bound, own)
        count = np.bincount(who, minlength=len(at))
        start = np.r_[0, np.cumsum(count)]
        ask, asks = np.empty(0, int), np.zeros(len(at), int)
        leaf = left.column("_leaf")[0].as_py() if len(at) else -1
        if first and leaf >= 0 and not whole:
            full = count == k
            bound[full] = d2[start[1:][full] - 1]
            side = np.minimum(at - leaves.low[leaf], leaves.high[leaf] - at)
            side = np.maximum(side, 0.0)
            out = np.flatnonzero(bound >= (side * side).min(1))
            beside = np.flatnonzero((leaves.tree == leaves.tree[leaf]) & (box[:, 0] > 0))
            counts, low, high = box[beside, 0], box[beside, 1:4], box[beside, 4:]
            got = []
            for a in range(0, len(out), step := max(1, 1_000_000 // max(1, len(beside)))):
                rows = out[a : a + step]
                near = kdtree.to_boxes(at[rows], low, high)
                limit = bound[rows]
                short = np.flatnonzero(~full[rows])  # fewer than k here: the boxes' farthest corners promise them
                for i in short:
                    far = np.maximum(np.abs(low - at[rows[i]]), np.abs(high - at[rows[i]]))
                    far = (far * far).sum(1) * (1 + 1e-12)
                    o = np.argsort(far)
                    held = np.searchsorted(np.cumsum(counts[o]), need)
                    if held < len(o):
                        limit[i] = min(limit[i], far[o[held]])
                bound[rows] = limit
                i, j = np.nonzero((near <= limit[:, None]) & (beside != leaf))
                got.append((rows[i], beside[j]))
            if got:
                who_asks, ask = (np.concatenate(v) for v in zip(*got))
                asks = np.bincount(who_asks, minlength=len(at))
        open_ = asks > 0
        values, offsets = ids.take(pa.array(what)), start
        if mean and first:
            settled = ~open_
            means = np.bincount(who, np.sqrt(d2), len(at)) / np.maximum(count, 1)
            keep = open_[who]
            size = np.where(open_, count, count > 0)
            d_offsets = np.r_[0, np.cumsum(size)]
            d_values = np.empty(d_offsets[-1])
            d_values[np.repeat(open_, size)] = d2[keep]
            d_values[d_offsets[:-1][settled & (count > 0)]] = means[settled & (count > 0)]
            values, offsets = ids.take(pa.array(what[keep])), np.r_[0, np.cumsum(np.where(open_, count, 0))]
        else:
            d_values, d_offsets = d2, start
        as_list = lambda o, v: pa.ListArray.from_arrays(pa.array(o, pa.int32()), v)
        coordinates = [pa.array(at[:, a], pa.float64(), mask=None if carry else ~open_) for a in range(3)]
        cols = [*[left.column(c) for c in names], *coordinates, as_list(offsets, values), as_list(d_offsets, pa.array(d_values, pa.float64()))]
        cols += [as_list(start, right.column(c).combine_chunks().take(pa.array(what))) for c in carry]
        if first:
            return pa.table([*cols, as_list(np.r_[0, np.cumsum(asks)], pa.array(ask, pa.int32()))], names=schema.names)
        return pa.table(cols if carry else [*cols[: len(names)], *cols[-2:]], names=schema2.names)

    at_leaf = [*by, "_leaf", "_part"]
    mine = _placed(q, by, "q_", leaves, parts)
    if mean and parts.max(initial=1) == 1:
        as_points = {"_q": "_p", **{f"q_{a}": a for a in AXES}}
        first = mine.groupBy(*at_leaf).applyInArrow(lambda a: found(a, a.rename_columns([as_points.get(c, c) for c in a.column_names]), True), schema)
    else:
        theirs = _placed(p, by, "", leaves, parts, ("_p", k + 1))
        first = mine.groupBy(*at_leaf).cogroup(theirs.groupBy(*at_leaf)).applyInArrow(lambda a, b: found(a, b, True), schema)
    top = known["top"] = materialise(first)
    if whole:
        return top, None
    open_ = top.filter(F.size("_ask") > 0)
    often = open_.select(F.explode("_ask").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()  # as many rows as leaves
    if not often:
        return top, None
    parts2 = np.zeros(len(leaves.low), int)  # leaves that nobody asks are not sent
    for r in often:
        parts2[r["l"]] = -(-r["n"] // LEAF_QUERIES)
    full = F.when(F.size("d2") >= k, F.col("d2")[k - 1])
    bound = F.coalesce(full, F.lit(float("inf")) if cap is None else F.lit(cap))
    wide = F.element_at(F.lit(parts2.tolist()), F.col("_leaf") + 1)
    more = open_.select(*by, "_q", *[f"q_{a}" for a in AXES], bound.alias("_bound"), F.explode("_ask").alias("_leaf"))
    more = more.withColumn("_part", F.pmod(F.xxhash64(*[f"q_{a}" for a in AXES], F.col("_q")), wide).cast("int"))
    theirs = _placed(p, by, "", leaves, parts2, ("_p", k + 1))
    rest = more.groupBy(*at_leaf).cogroup(theirs.groupBy(*at_leaf)).applyInArrow(lambda a, b: found(a, b, False), schema2)
    rest = rest.unionByName(open_.select(schema2.names))
    rest = rest.select(*names, *at_open, F.explode_outer(F.arrays_zip("_p", "d2", *carry)).alias("e")).select(*names, *at_open, "e.*")
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.asc_nulls_last("d2"), "_p"))
    return top, rest.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("_p").isNotNull() | (F.col("rank") == 1)))


def _sides(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, by: Sequence[str], ready: bool, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Tables (by, _q, q_x, ..) and (by, _p, x, ..); ready: both sides are tables already, of usable rows with distinct ids."""
    known = lambda t: t.dropna(subset=list(by)) if by else t  # noqa: E731 - a missing group equals nothing
    p = known(points.select(list(dict.fromkeys([*by, point_id, *AXES, *carry]))) if ready else clean(points, point_id, by, carry)).withColumnRenamed(point_id, "_p")
    q = queries if ready else clean(queries, query_id, by)
    kinds = dict(p.dtypes)
    q = q.select(*[F.col(c).cast(kinds[c]).alias(c) for c in by], F.col(query_id).alias("_q"), *[F.col(a).alias(f"q_{a}") for a in AXES])
    return (q, p) if ready else (materialise(q), materialise(p))


def _rows(top: DataFrame, rest: DataFrame | None, by: Sequence[str], every: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    settled = top if rest is None else top.filter(F.size("_ask") == 0)
    e = (F.posexplode_outer if every else F.posexplode)(F.arrays_zip("_p", "d2", *carry)).alias("i", "e")
    own = [*by, "_q", *([f"q_{a}" for a in AXES] if carry else [])]
    out = settled.select(*own, e).select(*own, "e.*", (F.col("i") + 1).alias("rank"))
    if rest is None:
        return out
    return out.unionByName(rest if every else rest.filter(F.col("_p").isNotNull()))


def knn(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, by: Sequence[str] = (), exclude_self: bool = False, max_distance: float | None = None, ready: bool = False, carry: Sequence[str] = (), known: dict | None = None) -> DataFrame:
    """(by, query_id, point_id, d2, rank): the k nearest points of every query, exactly; ties go to the smaller id.

    Fewer than k rows come out where there are fewer points (within max_distance, inclusive, if given). exclude_self leaves
    out the point whose id equals the query's. ready says that both sides are tables (see `materialise`) of usable points
    with distinct ids, which need no copy. Each query and point is sent once, and a query again only to the leaves that
    may hold something nearer (see _neighbours). carry: columns of points that come along, after the query's q_x, q_y, q_z.
    """
    q, p = _sides(queries, points, query_id, point_id, by, ready, carry)
    out = _rows(*_neighbours(q, p, k, by, exclude_self, max_distance, carry=carry, known=known), by, carry=carry)
    return out.select(*by, F.col("_q").alias(query_id), F.col("_p").alias(point_id), "d2", "rank", *([f"q_{a}" for a in AXES] if carry else []), *carry)


def mean_distance(points: DataFrame, k: int, point_id: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, point_id, mean_distance) of every usable point: the mean distance to its k nearest others, 0 if there are none. One number a point is kept, not its neighbours."""
    own = materialise(clean(points, point_id, by))
    q, p = _sides(own, own, point_id, point_id, by, True)
    top, rest = _neighbours(q, p, k, by, True, None, mean=True)
    settled = top if rest is None else top.filter(F.size("_ask") == 0)
    out = settled.select(*by, F.col("_q").alias(point_id), F.coalesce(F.try_element_at("d2", F.lit(1)), F.lit(0.0)).alias("mean_distance"))
    if rest is not None:
        more = rest.groupBy(*by, F.col("_q").alias(point_id)).agg(F.coalesce(F.avg(F.sqrt("d2")), F.lit(0.0)).alias("mean_distance"))
        out = out.unionByName(more)
    return out


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, by: Sequence[str] = (), max_distance: float | None = None, ready: bool = False) -> DataFrame:
    """(by, query_id, point_id, distance) of every usable query; null point and distance where none is within max_distance (inclusive)."""
    q, p = _sides(queries, points, query_id, point_id, by, ready)
    out = _rows(*_neighbours(q, p, 1, by, False, max_distance), by, True)
    return out.select(*by, F.col("_q").alias(query_id), F.col("_p").alias(point_id), F.sqrt("d2").alias("distance"))


def mutual(forward: DataFrame, backward: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of forward (a, b, ...) whose pair is also in backward (b, a)."""
    return forward.join(backward.select(*by, a, b).filter(F.col(a).isNotNull()).distinct(), [*by, a, b], "left_semi")
