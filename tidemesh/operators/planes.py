"""Plane-based M3C2: segments, their correspondences and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.runtime import if_small, materialise, usable
from .spatial import AXES, knn, mutual, radius_join


def segment_metrics(points: DataFrame, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """Per segment of at least three points: centre (x, y, z), normal turned to +z, linearity, planarity, sphericity (over the sum of eigenvalues), roughness, num_points."""
    p = points.filter(usable(*[F.col(a) for a in AXES]) & F.col(segment).isNotNull())
    cov = [(F.var_samp(a) if a == b else F.covar_samp(a, b)).alias(f"c_{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]
    m = p.groupBy(*by, segment).agg(F.count("*").alias("num_points"), *[F.avg(a).alias(a) for a in AXES], *cov).filter("num_points >= 3")
    return _shape(m, by, segment)


def _shape(m: DataFrame, by: Sequence[str], segment: str) -> DataFrame:
    m = linalg.with_normal(linalg.with_eigenvalues(m, "c"), "c", F.col("l3"), (0.0, 0.0, 1.0))
    total = F.col("l1") + F.col("l2") + F.col("l3")
    shape = {"linearity": F.col("l1") - F.col("l2"), "planarity": F.col("l2") - F.col("l3"), "sphericity": F.col("l3")}
    rough = F.sqrt(F.col("l3") * (F.col("num_points") - 1) / F.col("num_points"))
    return m.select(*by, segment, *AXES, "nx", "ny", "nz", *[F.coalesce(F.try_divide(v, total), F.lit(0.0)).alias(k) for k, v in shape.items()], rough.alias("roughness"), "num_points")


def global_ids(first: DataFrame, second: DataFrame, segment: str = "segment_id") -> DataFrame:
    """(epoch, segment, new_id): 1..n for the first epoch in order of its ids, going on for the second.

    The ids are sorted in ranges, each numbered in a task of its own; the ranges' sizes, one row each, give where they begin.
    """
    ids = first.select(F.lit(0).alias("epoch"), segment).unionByName(second.select(F.lit(1).alias("epoch"), segment)).filter(F.col(segment).isNotNull()).distinct()
    ranges = ids.sparkSession.sparkContext.defaultParallelism
    ids = materialise(ids.repartitionByRange(ranges, "epoch", segment).withColumn("_part", F.spark_partition_id()))
    sizes = ids.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("epoch", segment))
    return ids.withColumn("_place", place).join(if_small(start), "_part").select("epoch", segment, (F.col("_start") + F.col("_place")).cast("long").alias("new_id"))


def remap(pairs: DataFrame, ids: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Labelled pairs (id0, id1, label) in new ids; pairs with an unknown id are dropped."""
    a = ids.filter("epoch = 0").select(F.col(segment).alias("id0"), F.col("new_id").alias("new0"))
    b = ids.filter("epoch = 1").select(F.col(segment).alias("id1"), F.col("new_id").alias("new1"))
    return pairs.join(a, "id0").join(b, "id1").select(F.col("new0").alias("id0"), F.col("new1").alias("id1"), *[c for c in pairs.columns if c not in ("id0", "id1")])


def original_ids(new: DataFrame, ids: DataFrame, column: str, segment: str = "segment_id") -> DataFrame:
    """Rows with the original id behind the new id in `column` as original_id."""
    return new.join(ids.select(F.col("new_id").alias(column), F.col(segment).alias("original_id")), column, "left")


def _side(m: DataFrame, s: int, by: Sequence[str], segment: str) -> DataFrame:
    cols = (*AXES, "nx", "ny", "nz", "roughness", "num_points")
    return m.select(*by, F.col(segment).alias(f"id{s}"), *[F.col(c).alias(f"{c}{s}") for c in cols])


def pair_features(pairs: DataFrame, first: DataFrame, second: DataFrame, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """Pairs (id0, id1) with centre_distance, normal_angle and roughness_difference of their segments."""
    p = pairs.join(_side(first, 0, by, segment), [*by, "id0"]).join(_side(second, 1, by, segment), [*by, "id1"])
    d = F.sqrt(sum((F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(f"{a}1") - F.col(f"{a}0")) for a in AXES))
    dot = sum(F.col(f"n{a}0") * F.col(f"n{a}1") for a in AXES)
    return p.withColumns({"centre_distance": d, "normal_angle": F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))), "roughness_difference": F.abs(F.col("roughness0") - F.col("roughness1"))})


def train(features: DataFrame, trees: int = 100, seed: int = 42):
    """A random forest on labelled pair features (label 1 and 0 are both needed)."""
    from pyspark.ml.classification import RandomForestClassifier

    labels = {r[0] for r in features.select(F.col("label").cast("int")).distinct().collect()}
    if not {0, 1} <= labels:
        raise ValueError("training needs pairs of label 0 and of label 1")
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, seed=seed).fit(_vector(features).withColumn("label", F.col("label").cast("double")))


def _vector(features: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["centre_distance", "normal_angle", "roughness_difference"], outputCol="features", handleInvalid="skip").transform(features)


def candidates(first: DataFrame, second: DataFrame, search_radius: float, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, id0, id1): segments whose centres are at most search_radius apart."""
    c = radius_join(first, second.withColumnRenamed(segment, "_s"), search_radius, segment, "_s", by, strict=False)
    return c.select(*by, F.col("_q").alias("id0"), F.col("_s").alias("id1"))


def best_by_model(model, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The likeliest second segment of every first one, from pair features."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(_vector(pairs)).withColumn("likely", vector_to_array("probability")[1])
    return p.groupBy(*by, "id0").agg(F.max_by("id1", F.struct("likely", -F.col("id1"))).alias("id1"))


def nearest_segments(first: DataFrame, second: DataFrame, search_radius: float, both_ways: bool = False, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, id0, id1): the segment with the nearest centre, at most search_radius away; both_ways keeps mutual ones."""
    one = knn(first, second.withColumnRenamed(segment, "_s"), 1, segment, "_s", by).filter(F.col("d2") <= search_radius * search_radius).select(*by, F.col(segment).alias("id0"), F.col("_s").alias("id1"))
    if not both_ways:
        return one
    back = knn(second, first.withColumnRenamed(segment, "_s"), 1, segment, "_s", by).select(*by, F.col("_s").alias("id0"), F.col(segment).alias("id1"))
    return mutual(one, back, "id0", "id1", by)


def plane_distances(pairs: DataFrame, first: DataFrame, second: DataFrame, registration_error: float = 0.0, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, id0, id1, distance, uncertainty): centre difference along the first normal; 1.96 * sqrt(r0^2 / n0 + r1^2 / n1) + registration_error."""
    p = pairs.select(*by, "id0", "id1").join(_side(first, 0, by, segment), [*by, "id0"]).join(_side(second, 1, by, segment), [*by, "id1"])
    d: Column = sum((F.col(f"{a}1") - F.col(f"{a}0")) * F.col(f"n{a}0") for a in AXES)
    u = 1.96 * F.sqrt(sum(F.col(f"roughness{s}") * F.col(f"roughness{s}") / F.col(f"num_points{s}") for s in (0, 1))) + float(registration_error)
    return p.select(*by, "id0", "id1", d.alias("distance"), u.alias("uncertainty"))


def pbm3c2(first: DataFrame, second: DataFrame, search_radius: float, labelled: DataFrame | None = None, method: str = "nearest_neighbor", both_ways: bool = False, registration_error: float = 0.0, wanted: DataFrame | None = None, segment: str = "segment_id", by: Sequence[str] = ()) -> DataFrame:
    """Distances of corresponding segments of two segmented clouds, by random_forest (needs `labelled` pairs id0, id1, label) or nearest_neighbor.

    wanted limits the first segments (column of their ids). Gives (by, id0, id1, distance, uncertainty) with original ids.
    """
    if method not in ("random_forest", "nearest_neighbor"):
        raise ValueError(f"unknown method: {method}")
    a, b = segment_metrics(first, segment, by), segment_metrics(second, segment, by)
    asked = a if wanted is None else a.join(wanted.select(segment).distinct(), segment, "left_semi")
    if method == "nearest_neighbor":
        pairs = nearest_segments(asked, b, search_radius, both_ways, segment, by)
    else:
        if labelled is None:
            raise ValueError("random_forest needs labelled pairs")
        model = train(pair_features(labelled, a, b, segment, by))
        pairs = best_by_model(model, pair_features(candidates(asked, b, search_radius, segment, by), a, b, segment, by), by)
    return plane_distances(pairs, a, b, registration_error, segment, by)
