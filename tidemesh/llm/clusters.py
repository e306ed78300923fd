"""Groups of corepoints with like series and places: bisecting k-means down to compact leaves, then exact groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import BROADCAST_BYTES, if_small, materialise, measured, usable
from ..operators.spikes import trusted_series

#: Members compared at once in a task; larger leaves are compared in blocks of this many.
PART = 512


def bisect(members: DataFrame, reach: float, compact: float | None = None, rounds: int = 2, levels: int = 60) -> DataFrame:
    """Leaves of a bisecting k-means over places: (id, tree, leaf, home).

    members: (id, tree, x, y, z); every tree is split on its own. The node of largest dispersion (root mean square from
    its centre) is split in two by `rounds` of 2-means, seeded along its axis of largest dispersion, and so on until no
    node's dispersion exceeds `compact` (default `reach`). A split changes no other node, so the leaves are the same in
    whatever order nodes are taken; all that exceed the limit are split at once, in one round over the cluster. A member
    goes home to the nearer centre and is also listed, as a guest, on the other side if it lies within `reach` of the
    plane between them: so the leaf that is a member's home lists everything within `reach` of it. Centres are joined,
    never collected; nodes that stay as they are take no part in later rounds. Copies at one place have no dispersion, so
    `levels` is only reached by places that halve their spread no more.
    """
    compact = reach if compact is None else compact
    axes = ("x", "y", "z")
    active = members.select("id", "tree", F.lit("").alias("leaf"), F.lit(True).alias("home"), *axes)
    done = []
    for _ in range(levels):
        home = active.filter("home")
        stats = home.groupBy("tree", "leaf").agg(*[F.avg(a).alias(f"m{a}") for a in axes], *[F.var_pop(a).alias(f"s{a}") for a in axes])
        top = F.greatest("sx", "sy", "sz")
        along = {a: (F.col(f"s{a}") == top).cast("double") * F.sqrt(f"s{a}") for a in axes}
        wide = stats.filter(F.sqrt(F.col("sx") + F.col("sy") + F.col("sz")) > compact)
        centres = materialise(wide.select("tree", "leaf", *[(F.col(f"m{a}") - along[a]).alias(f"a{a}") for a in axes], *[(F.col(f"m{a}") + along[a]).alias(f"b{a}") for a in axes]))
        n, size = measured(centres)
        if not n:
            break
        small = F.broadcast if size <= BROADCAST_BYTES else lambda t: t  # later centres are no more
        side = sum((F.col(a) - (F.col(f"a{a}") + F.col(f"b{a}")) / 2) * (F.col(f"b{a}") - F.col(f"a{a}")) for a in axes)
        for _ in range(rounds):
            at = home.join(small(centres), ["tree", "leaf"]).withColumn("b", side > 0)
            mean = at.groupBy("tree", "leaf").agg(*[F.avg(F.when(~F.col("b"), F.col(a))).alias(f"a{a}") for a in axes], *[F.avg(F.when(F.col("b"), F.col(a))).alias(f"b{a}") for a in axes])
            centres = materialise(mean.dropna())
        length = F.sqrt(sum((F.col(f"b{a}") - F.col(f"a{a}")) * (F.col(f"b{a}") - F.col(f"a{a}")) for a in axes))
        cut = active.join(small(centres), ["tree", "leaf"]).withColumn("off", side / length).filter("off is not null")
        way = F.explode(F.expr(f"filter(array(struct('0' as c, off <= 0 as own, off <= {reach} as near), struct('1' as c, off > 0 as own, off > -{reach} as near)), s -> s.near)"))
        children = cut.select("id", "tree", "leaf", "home", *axes, way.alias("w")).select("id", "tree", F.concat("leaf", "w.c").alias("leaf"), (F.col("home") & F.col("w.own")).alias("home"), *axes)
        done.append(active.join(small(centres.select("tree", "leaf")), ["tree", "leaf"], "left_anti"))
        active = materialise(children)
    done.append(active)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "tree", "leaf", "home")


def leaf_report(leaves: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """(tree, leaf, size, spread, rank, id): each leaf's members at home, their root mean square from its centre, and its `most` members nearest to that centre by rank from 1; ties go to the smaller id."""
    at = leaves.filter("home").join(members.select("id", "x", "y", "z"), "id")
    centre = at.groupBy("tree", "leaf").agg(F.count("*").alias("size"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    off = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz")
    met = at.join(centre, ["tree", "leaf"]).withColumn("off", off).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = Window.partitionBy("tree", "leaf", "part").orderBy("off", "id")  # a large leaf is not ranked in one place
    few = met.withColumn("k", F.row_number().over(part)).filter(F.col("k") <= most)
    rank = F.row_number().over(Window.partitionBy("tree", "leaf").orderBy("off", "id"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= most).select("tree", "leaf", "size", "spread", "rank", "id")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of ids (splitmix)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _tally(reach: float, within: float, share: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy()
        place = pdf[["x", "y", "z"]].to_numpy(float)
        epochs = np.concatenate(pdf["epochs"].to_list()).astype(np.int64)
        row = np.repeat(np.arange(len(pdf)), pdf["epochs"].map(len).to_numpy())
        names, column = np.unique(epochs, return_inverse=True)
        table = np.full((len(pdf), max(len(names), 1)), np.nan)
        table[row, column] = np.concatenate(pdf["distances"].to_list())
        answering = pdf["answers"].to_numpy()
        asks, answers = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(answering)
        out = []
        mixed = [_mix(ids), _mix(ids ^ 0x5BF03635)]
        halves = np.stack([h for m in mixed for h in (m >> np.uint64(32), m & np.uint64(0xFFFFFFFF))]).astype(np.int64)
        with np.errstate(invalid="ignore"):
            for i in asks:
                near = answers[((place[answers] - place[i]) ** 2).sum(1) <= reach * reach + 1e-9]
                near = near[ids[near] != ids[i]]
                mine = np.flatnonzero(~np.isnan(table[i]))
                other = table[np.ix_(near, mine)]
                both = (~np.isnan(other)).sum(1)
                same = (np.abs(other - table[i, mine]) <= within + 1e-9).sum(1)
                like = near[(both > 0) & (100 * same >= share * both)]
                if answering[i]:
                    like = np.r_[like, i]  # a member is in its own neighbourhood, once over all blocks
                out.append((ids[i], len(like), ids[like].min() if len(like) else ids[i], *halves[:, like].sum(axis=1)))
        return pd.DataFrame(out, columns=["id", "n", "first", "h1", "h2", "h3", "h4"])

    return run


def _groups(tally: DataFrame, least: int) -> DataFrame:
    """(cluster_id, id) of members whose closed neighbourhoods are equal and no larger than their number.

    The hashes of a neighbourhood are sums of mixed ids, kept in two halves of 32 bits so that no sum overflows.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "h1", "h2", "h3", "h4")]
    t = materialise(tally.groupBy("id").agg(F.least(F.min("first"), F.first("id")).alias("first"), *sums))
    key = ["first", "n", "h1", "h2", "h3", "h4"]
    whole = t.groupBy(*key).agg(F.count("*").alias("members")).filter((F.col("members") == F.col("n")) & (F.col("n") >= least))
    return t.join(whole, key).select(F.col("first").alias("cluster_id"), "id")


def places(corepoints: DataFrame) -> DataFrame:
    """(id, tree, x, y, z): one row per corepoint with an analysis and usable coordinates."""
    c = corepoints.select(F.col("corepoint_id").alias("id"), F.col("analysis_id").alias("tree"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return c.filter(usable(F.col("x"), F.col("y"), F.col("z")) & F.col("id").isNotNull() & F.col("tree").isNotNull()).dropDuplicates(["id"])


def like_groups(distances: DataFrame, corepoints: DataFrame, reach: float = 40.0, within: float = 0.05, share: int = 85, least: int = 3, compact: float | None = None) -> DataFrame:
    """(cluster_id, corepoint_id, x, y, z, mean): groups of at least `least` corepoints, all alike with each other and nobody else.

    Two corepoints of one analysis are alike if they are at most `reach` apart and their distances differ by at most
    `within` at no less than `share` in 100 of the epochs at which both have a trusted reading (see trusted_series); with
    no such epoch they are not. cluster_id is the smallest corepoint_id.

    Candidates come from the leaves of `bisect`, which list everything within reach of their members. A leaf is compared
    in blocks of at most some PART members each way, so no hot leaf meets one task; each block gives a tally per member
    (how many are like it, the first of them and two hashes of them), never pairs. Members with equal closed
    neighbourhoods as many as their size are a group.

    The series take no part in the splits: alike ones may differ by anything at 15 in 100 epochs, so no distance that
    k-means could use keeps them together, while places do.

    A corepoint's series is one row here: it has at most as many readings as its analysis has scans.

    Corepoints with a null, NaN or infinite coordinate, without analysis or without trusted readings are in no group;
    repeated rows count once; empty tables give an empty result; further columns are ignored.
    """
    s = trusted_series(distances).filter("size(epochs) > 0").withColumnRenamed("corepoint_id", "id")
    s = s.groupBy("id").agg(F.flatten(F.collect_list("epochs")).alias("epochs"), F.flatten(F.collect_list("distances")).alias("distances"))
    m = materialise(places(corepoints).join(s, "id"))
    leaves = materialise(bisect(m.select("id", "tree", "x", "y", "z"), reach, compact))
    parts = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    listed = leaves.join(if_small(parts), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asks = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("asks"), (j == F.col("part")).alias("answers")))).otherwise(F.expr("cast(array() as array<struct<i: int, j: int, asks: boolean, answers: boolean>>)"))
    answers = F.filter(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))), lambda b: ~(F.col("home") & (b["i"] == F.col("part"))))
    blocks = listed.select("id", "tree", "leaf", F.explode(F.concat(asks, answers)).alias("b")).select("id", "tree", "leaf", "b.*")
    met = blocks.join(m.drop("tree"), "id")
    tally = met.groupBy("tree", "leaf", "i", "j").applyInPandas(_tally(reach, within, share), "id long, n long, first long, h1 long, h2 long, h3 long, h4 long")
    groups = _groups(tally, least)
    mean = F.expr("aggregate(distances, 0e0, (a, d) -> a + d) / size(distances)")
    return groups.join(m.select("id", "x", "y", "z", mean.alias("mean")), "id").withColumnRenamed("id", "corepoint_id")


def described(groups: DataFrame, reach: float = 40.0, within: float = 0.05, members: int = 1) -> DataFrame:
    """(cluster_id, size, rank, typical, x, y, z, mean): each group's size, its `members` members nearest to the centre of places (in units of reach) and mean distances (in units of within), by rank from 1, and that centre."""
    centre = groups.groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(c).alias(f"c{c}") for c in ("x", "y", "z", "mean")])
    off = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz") / (reach * reach) + (F.col("mean") - F.col("cmean")) * (F.col("mean") - F.col("cmean")) / (within * within)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(off, "corepoint_id"))
    near = groups.join(centre, "cluster_id").withColumn("rank", rank).filter(F.col("rank") <= members)
    return near.select("cluster_id", "size", "rank", F.col("corepoint_id").alias("typical"), *[F.col(f"c{c}").alias(c) for c in ("x", "y", "z", "mean")])
