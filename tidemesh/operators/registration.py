"""Rigid transformations: applying them, fitting them, and iterating fits over nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import discard, if_small, materialise, usable
from .spatial import AXES, clean, knn, nearest


@dataclass(frozen=True)
class Transformation:
    """p' = R (p - x0) + t + x0, with the 4x4 matrix [R | t] and the reduction point x0."""

    matrix: tuple[tuple[float, ...], ...]
    reduction_point: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @classmethod
    def of(cls, matrix, reduction_point=(0.0, 0.0, 0.0)) -> Transformation:
        m = np.eye(4)
        a = np.asarray(matrix, float)
        if a.shape not in ((3, 4), (4, 4)):
            raise ValueError("a transformation is a 3x4 or 4x4 matrix")
        m[: a.shape[0]] = a
        return cls(tuple(map(tuple, m.tolist())), tuple(float(v) for v in reduction_point))

    @classmethod
    def of_parts(cls, rotation, translation, reduction_point=(0.0, 0.0, 0.0)) -> Transformation:
        return cls.of(np.c_[np.asarray(rotation, float), np.asarray(translation, float).reshape(3, 1)], reduction_point)

    def array(self) -> np.ndarray:
        return np.array(self.matrix)

    def then(self, other: Transformation) -> Transformation:
        """This one, then another with the same reduction point."""
        return Transformation.of(other.array() @ self.array(), self.reduction_point)


def transform(points: DataFrame, t: Transformation) -> DataFrame:
    """Moves x, y, z and turns nx, ny, nz, if there are any; a projection with constant coefficients."""
    m, o = t.matrix, t.reduction_point
    d = [F.col(a) - o[k] for k, a in enumerate(AXES)]
    new = {a: sum(m[k][c] * d[c] for c in range(3)) + m[k][3] + o[k] for k, a in enumerate(AXES)}
    if {"nx", "ny", "nz"} <= set(points.columns):
        new |= {f"n{a}": sum(m[k][c] * F.col(f"n{b}") for c, b in enumerate(AXES)) for k, a in enumerate(AXES)}
    return points.withColumns(new)


def bounding_box(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    r = points.agg(*[F.min(a) for a in AXES], *[F.max(a) for a in AXES]).first()
    return np.array(r[:3], float), np.array(r[3:], float)


def bounding_boxes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x0, x1, y0, y1, z0, z1): the box of every group."""
    return points.groupBy(*by).agg(*[f(a).alias(f"{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))])


def corner_change(low: np.ndarray, high: np.ndarray, t: Transformation) -> float:
    """The farthest that a transformation moves a corner of a box's diagonal."""
    o = np.array(t.reduction_point)
    corners = np.stack([low, high])
    moved = (corners - o) @ t.array()[:3, :3].T + t.array()[:3, 3] + o
    return float(np.linalg.norm(moved - corners, axis=1).max())


def fit_points(pairs: DataFrame, reduction_point=(0.0, 0.0, 0.0)) -> Transformation:
    """Least-squares rigid motion of (ax, ay, az) onto (bx, by, bz): 15 sums in one aggregate, then a 3x3 SVD."""
    o = reduction_point
    a = [F.col(f"a{k}") - o[i] for i, k in enumerate(AXES)]
    b = [F.col(f"b{k}") - o[i] for i, k in enumerate(AXES)]
    r = pairs.agg(*[F.avg(v) for v in (*a, *b)], *[F.covar_pop(u, v) for u in a for v in b]).first()
    ma, mb, h = np.array(r[:3], float), np.array(r[3:6], float), np.array(r[6:], float).reshape(3, 3)
    u, _, vt = np.linalg.svd(h)
    rot = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    return Transformation.of_parts(rot, mb - rot @ ma, o)


def fit_planes(pairs: DataFrame, reduction_point=(0.0, 0.0, 0.0)) -> Transformation:
    """One Gauss-Newton step of (ax, ..) onto planes through (bx, ..) with normals (nx, ny, nz): 27 sums in one aggregate."""
    o = reduction_point
    a = [F.col(f"a{k}") - o[i] for i, k in enumerate(AXES)]
    n = [F.col(f"n{k}") for k in AXES]
    e = sum((F.col(f"a{k}") - F.col(f"b{k}")) * F.col(f"n{k}") for k in AXES)
    j = [-(a[1] * n[2] - a[2] * n[1]), -(a[2] * n[0] - a[0] * n[2]), -(a[0] * n[1] - a[1] * n[0]), *n]
    pairs = pairs.withColumns({f"_j{i}": v for i, v in enumerate(j)} | {"_e": e})
    r = pairs.agg(*[F.sum(F.col(f"_j{i}") * F.col(f"_j{k}")) for i in range(6) for k in range(i, 6)], *[F.sum(F.col(f"_j{i}") * F.col("_e")) for i in range(6)]).first()
    h = np.zeros((6, 6))
    h[np.triu_indices(6)] = r[:21]
    x = -np.linalg.lstsq(h + np.triu(h, 1).T, np.array(r[21:], float), rcond=None)[0]
    (ca, sa), (cb, sb), (cg, sg) = ((np.cos(v), np.sin(v)) for v in x[:3])
    rot = np.array([[cg, sg, 0], [-sg, cg, 0], [0, 0, 1]]) @ np.array([[cb, 0, -sb], [0, 1, 0], [sb, 0, cb]]) @ np.array([[1, 0, 0], [0, ca, sa], [0, -sa, ca]])
    return Transformation.of_parts(rot, x[3:], o)


def _icp(reference: DataFrame, points: DataFrame, max_iterations: int, tolerance: float, reduction_point, planes: bool, point_id: str) -> Transformation:
    cols = ["nx", "ny", "nz"] if planes else []
    ref = materialise(clean(reference, point_id, keep=cols))
    own = materialise(clean(points, point_id))
    now, before = Transformation.of(np.eye(4), reduction_point), 0.0
    known: dict = {}
    for _ in range(max_iterations):
        moved = transform(own, now)  # always the original cloud and one matrix: plans do not grow
        near = knn(moved, ref.withColumnRenamed(point_id, "_t"), 1, point_id, "_t", ready=True, carry=[*AXES, *cols], known=known)
        pairs = near.select(*[F.col(f"q_{a}").alias(f"a{a}") for a in AXES], *[F.col(a).alias(f"b{a}") for a in AXES], *cols, "d2")
        pairs = materialise(pairs.dropna(subset=cols) if planes else pairs)
        discard(known.pop("top"))
        step = (fit_planes if planes else fit_points)(pairs, reduction_point)
        now = now.then(step)
        mean = pairs.agg(F.avg(F.sqrt("d2"))).first()[0]
        discard(pairs)
        if mean is None or abs(mean - before) < tolerance:
            break
        before = mean
    return now


def icp(reference: DataFrame, points: DataFrame, max_iterations: int = 50, tolerance: float = 1e-5, reduction_point=(0.0, 0.0, 0.0), point_id: str = "point_id") -> Transformation:
    """Iterative closest points: the motion of `points` onto `reference`, until the mean distance settles."""
    return _icp(reference, points, max_iterations, tolerance, reduction_point, False, point_id)


def plane_icp(reference: DataFrame, points: DataFrame, max_iterations: int = 50, tolerance: float = 1e-5, reduction_point=(0.0, 0.0, 0.0), point_id: str = "point_id") -> Transformation:
    """As icp, onto the planes of the reference's normals (nx, ny, nz); points without normals are no targets."""
    return _icp(reference, points, max_iterations, tolerance, reduction_point, True, point_id)


def distance_threshold(reference: DataFrame, points: DataFrame, point_id: str = "point_id") -> float:
    """Mean plus one deviation of the nearest-neighbour distance."""
    near = nearest(points, reference.withColumnRenamed(point_id, "_t"), point_id, "_t")
    return float(near.agg(F.avg("distance") + F.stddev_pop("distance")).first()[0])


# --- supervoxels -------------------------------------------------------------------------------------------------


def supervoxel_count(points: DataFrame, resolution: float) -> int:
    """Occupied cubes of edge `resolution` from the lower corner."""
    low, _ = bounding_box(points)
    return points.select(*[F.floor((F.col(a) - float(low[k])) / resolution).alias(a) for k, a in enumerate(AXES)]).distinct().count()


def _apart(a: str, b: str, resolution: float) -> Column:
    """How unlike two points are: one less the cosine between their lines of normals, and 0.4 of their distance in resolutions."""
    turn = sum(F.col(f"{a}n{x}") * F.col(f"{b}n{x}") for x in AXES)
    d2 = sum((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in AXES)
    return 1 - F.abs(turn) + 0.4 * F.sqrt(d2) / resolution


def _named(points: DataFrame, by: Sequence[str], point_id: str, prefix: str, name: str) -> DataFrame:
    return points.select(*by, F.col(point_id).alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in (*AXES, "nx", "ny", "nz")])


def supervoxels(points: DataFrame, resolution: float, k: int = 50, point_id: str = "point_id", by: Sequence[str] = (), max_rounds: int = 80, trades: int = 3) -> DataFrame:
    """(by, supervoxel_id, point_id): patches of near points with like normals (nx, ny, nz), named by a member, about as many as cubes of edge `resolution` are occupied.

    Patches grow by rounds of edge contraction in the graph of the k nearest neighbours, all over the cluster at once. In a
    round every patch is a giver or a taker by a hash of its name; each giver goes over to the taker beside it for which
    its size times the unlikeness of the two namesakes (_apart) is least, if that lies below a limit, which starts at the
    usual unlikeness of nearest neighbours and doubles every round. When a cloud (of its `by`) has more givers than
    patches too many, only the cheapest go. In the end, `trades` times, each point goes over to the patch of a neighbour
    if that patch's namesake is more like it. Points without normals take no part; repeated ids count once.
    """
    keep = ["nx", "ny", "nz"]
    p = clean(points, point_id, by, keep).dropna(subset=keep)
    by = list(by)
    if not by:
        p, by = p.withColumn("_g", F.lit(0)), ["_g"]
    p = materialise(p.filter(usable(*[F.col(c) for c in keep])))
    low = p.groupBy(*by).agg(*[F.min(a).alias(f"lo{a}") for a in AXES])
    cubes = p.join(if_small(low), by).select(*by, *[F.floor((F.col(a) - F.col(f"lo{a}")) / resolution).alias(a) for a in AXES]).distinct().groupBy(*by).agg(F.count("*").alias("wanted"))
    near = knn(p, p.withColumnRenamed(point_id, "_o"), k, point_id, "_o", by, exclude_self=True)
    links = materialise(near.select(*by, F.col(point_id).alias("a"), F.col("_o").alias("b"), "rank"))
    first = links.filter("rank = 1").join(_named(p, by, point_id, "a_", "a"), [*by, "a"]).join(_named(p, by, point_id, "b_", "b"), [*by, "b"])
    usual = first.groupBy(*by).agg(F.percentile_approx(_apart("a_", "b_", resolution), 0.5).alias("usual"))
    goal = materialise(cubes.join(usual, by, "left").select(*by, "wanted", F.greatest("usual", F.lit(1e-9)).alias("usual")))
    patches = materialise(p.select(*by, F.col(point_id).alias("name"), F.lit(1).cast("long").alias("size")))
    edges = links.select(*by, "a", "b").unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    gone = []
    for r in range(max_rounds):
        many = patches.groupBy(*by).agg(F.count("*").alias("held")).join(goal, by).filter("held > wanted")
        many = materialise(many.select(*by, (F.col("held") - F.col("wanted")).alias("over"), "usual"))
        open_ = edges.join(if_small(many, scan=True), by, "left_semi")
        if not open_.limit(1).count():
            break
        gives = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 0
        met = open_.filter(gives("a") & ~gives("b")).join(if_small(many, scan=True), by)
        met = met.join(patches.withColumnRenamed("name", "a"), [*by, "a"]).join(_named(p, by, point_id, "a_", "a"), [*by, "a"]).join(_named(p, by, point_id, "b_", "b"), [*by, "b"])
        met = met.withColumn("cost", F.col("size") * _apart("a_", "b_", resolution)).filter(F.col("cost") < F.col("usual") * float(2**r))
        best = met.groupBy(*by, "a", "size", "over").agg(F.min(F.struct("cost", "b")).alias("m"))
        best = materialise(best.select(*by, "a", "size", "over", F.col("m.cost").alias("cost"), F.col("m.b").alias("b")))
        parts = ", ".join(str(x / 20) for x in range(1, 21))
        bar = best.groupBy(*by).agg(F.max("over").alias("over"), F.count("*").alias("n"), F.expr(f"percentile_approx(cost, array({parts}), 1000)").alias("c"))
        step = F.least(F.floor(20 * F.col("over") / F.col("n")).cast("int"), F.lit(19))
        bar = bar.select(*by, F.when(F.col("n") <= F.col("over"), F.lit(float("inf"))).otherwise(F.col("c")[step]).alias("bar"))
        moved = materialise(best.join(if_small(bar), by).filter(F.col("cost") <= F.col("bar")).select(*by, "a", "b", "size"))
        gone.append(moved.drop("size"))
        took = moved.groupBy(*by, F.col("b").alias("name")).agg(F.sum("size").alias("more"))
        patches = materialise(patches.join(moved.select(*by, F.col("a").alias("name")), [*by, "name"], "left_anti").join(took, [*by, "name"], "left").select(*by, "name", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        to = moved.select(*by, F.col("a").alias("_was"), F.col("b").alias("_is"))
        for end in ("a", "b"):
            edges = edges.join(to.withColumnRenamed("_was", end), [*by, end], "left").withColumn(end, F.coalesce("_is", end)).drop("_is")
        edges = materialise(edges.select(*by, "a", "b").filter("a <> b").distinct())
    of = p.select(*by, F.col(point_id).alias("a"), F.col(point_id).alias("name"))
    for m in gone:
        of = of.join(m.select(*by, F.col("a").alias("name"), F.col("b").alias("_is")), [*by, "name"], "left").select(*by, "a", F.coalesce("_is", "name").alias("name"))
    of = materialise(of)
    for _ in range(trades):
        seen = links.select(*by, "a", "b").join(of.select(*by, F.col("a").alias("b"), "name"), [*by, "b"]).select(*by, "a", "name")
        seen = seen.unionByName(of.select(*by, "a", "name")).distinct()
        seen = seen.join(_named(p, by, point_id, "a_", "a"), [*by, "a"]).join(_named(p, by, point_id, "b_", "name"), [*by, "name"])
        # at equal unlikeness a namesake stays with itself, others go to the smaller name
        own = (F.col("a") != F.col("name")).cast("int")
        of = materialise(seen.groupBy(*by, "a").agg(F.min_by("name", F.struct(own * _apart("a_", "b_", resolution), own, "name")).alias("name")))
    return of.select(*[c for c in by if c != "_g"], F.col("name").alias("supervoxel_id"), F.col("a").alias(point_id))


def patch_shapes(labelled: DataFrame, point_id: str = "point_id", least: int = 10) -> DataFrame:
    """Per supervoxel of at least `least` points: centre, mean normal and the six extreme points (struct arrays)."""
    ends = [f(F.struct(*AXES), F.struct(a, point_id)).alias(f"{n}_{a}") for a in AXES for n, f in (("max", F.max_by), ("min", F.min_by))]
    g = labelled.groupBy("supervoxel_id").agg(F.count("*").alias("points"), *[F.avg(a).alias(a) for a in AXES], *[F.avg(f"n{a}").alias(f"n{a}") for a in AXES], *ends).filter(F.col("points") >= least)
    return g.select("supervoxel_id", "points", *AXES, "nx", "ny", "nz", F.array(*[f"{n}_{a}" for a in AXES for n in ("max", "min")]).alias("ends"))


def plane_gap(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str) -> DataFrame:
    """(query_id, gap): distance of every query to the plane of its nearest target (with normal), or to the target if that has none."""
    normal = [f"n{a}" for a in AXES]
    p = knn(queries, targets, 1, query_id, target_id, carry=[*AXES, *normal])
    length = F.sqrt(sum(F.col(n) * F.col(n) for n in normal))
    along = F.when(usable(*[F.col(n) for n in normal]), F.abs(sum((F.col(f"q_{a}") - F.col(a)) * F.col(f"n{a}") for a in AXES) / F.nullif(length, F.lit(0.0))))
    return p.select(query_id, F.coalesce(along, F.sqrt("d2")).alias("gap"), F.sqrt("d2").alias("distance"))


def stable_icp(reference: DataFrame, points: DataFrame, initial_threshold: float, level_of_detection: float, reference_resolution: float, resolution: float, min_points: int = 10, k: int = 50, reduction_point=(0.0, 0.0, 0.0), max_rounds: int = 20, fit_iterations: int = 50, point_id: str = "point_id") -> Transformation:
    """Registration on the areas that did not change.

    Both clouds (with normals) are cut into supervoxels. A patch of `points` is stable if its centre and six extreme
    points lie within the threshold of the nearest reference patch's plane, and the extreme points within the threshold
    plus twice the mean point spacing of the reference's points. A plane fit on stable patches moves the cloud. The
    threshold follows the distances until the box moves by less than twice the level of detection, then shrinks by 0.8 a round down to it. No
    stable patch is an error.
    """
    ref = materialise(clean(reference, point_id, keep=["nx", "ny", "nz"]))
    own = materialise(clean(points, point_id, keep=["nx", "ny", "nz"]))
    rs = materialise(patch_shapes(supervoxels(ref, reference_resolution, k).join(ref, point_id), point_id, min_points))
    labelled = materialise(supervoxels(own, resolution, k).select("supervoxel_id", point_id).join(own, point_id))
    spacing = float(knn(ref, ref.withColumnRenamed(point_id, "_t"), 1, point_id, "_t", exclude_self=True).agg(F.avg(F.sqrt("d2"))).first()[0])
    low, high = bounding_box(own)
    threshold = max(initial_threshold, level_of_detection)
    now, shrinking = Transformation.of(np.eye(4), reduction_point), False
    targets = rs.select(F.col("supervoxel_id").alias("_t"), *AXES, "nx", "ny", "nz")
    for _ in range(max_rounds):
        moved = transform(labelled, now)
        shapes = materialise(patch_shapes(moved, point_id, min_points))
        ends = shapes.select("supervoxel_id", F.posexplode("ends").alias("k", "e")).select(F.struct("supervoxel_id", "k").alias("_e"), "supervoxel_id", "e.x", "e.y", "e.z")
        centre = plane_gap(shapes.select("supervoxel_id", *AXES), "supervoxel_id", targets, "_t").select("supervoxel_id", F.col("gap").alias("g"))
        edge = plane_gap(ends, "_e", targets, "_t").select("_e", "gap")
        point = knn(ends, ref.withColumnRenamed(point_id, "_t"), 1, "_e", "_t").select("_e", F.sqrt("d2").alias("d"))
        worst = edge.join(point, "_e").groupBy(F.col("_e.supervoxel_id").alias("supervoxel_id")).agg(F.max("gap").alias("gap"), F.max("d").alias("d"))
        stable = centre.join(worst, "supervoxel_id").filter((F.col("g") < threshold) & (F.col("gap") < threshold) & (F.col("d") < threshold + 2 * spacing)).select("supervoxel_id")
        part = materialise(moved.join(stable, "supervoxel_id", "left_semi").select(point_id, *AXES))
        if not part.limit(1).count():
            raise ValueError("no stable supervoxels; use a larger threshold")
        step = plane_icp(ref, part, fit_iterations, 1e-5, reduction_point, point_id)
        change = corner_change(low, high, step)
        now = now.then(step)
        if not shrinking and change < 2 * level_of_detection:
            shrinking = True
        elif threshold == level_of_detection:
            break
        threshold = max(level_of_detection, 0.8 * threshold if shrinking else distance_threshold(ref, part, point_id))
    return now
