"""A mix of sources at target shares of tokens, drawn by balanced (cube) sampling."""

from __future__ import annotations

import random
import zlib
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .tokens import TOKENIZER, with_token_counts
from .truncation import even_source

#: Documents that take part in one flight: bounds a task whatever a source's size.
FLIGHT = 4096
_UNITS = "doc_id long, source string, n_tokens long, p double"


def flight(size: list[float], p: list[float], draw: random.Random, land: bool = False) -> list[float]:
    """Moves the inclusion probabilities p to 0 or 1 along the null space of the two totals, sum(p) and sum(p * size).

    Three open units span a direction that changes neither total; a random step along it, of mean zero, settles at least
    one of them. At most two units stay open; `land` settles those too: the number of units is kept as long as there are
    two, and the last is drawn by its probability.
    """
    p, eps = list(p), 1e-9
    rest = [k for k in range(len(p) - 1, -1, -1) if eps < p[k] < 1 - eps]
    hand: list[int] = []
    while True:
        while len(hand) < 3 and rest:
            hand.append(rest.pop())
        if len(hand) == 3:
            a, b, c = (size[k] for k in hand)
            u = (b - c, c - a, a - b)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and (land or size[hand[0]] == size[hand[1]]):
            u = (1.0, -1.0)
        elif len(hand) == 1 and land:
            u = (1.0,)
        else:
            break
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(hand, u) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(hand, u) if v)
        step = up if draw.random() * (up + down) < down else -down
        for k, v in zip(hand, u):
            p[k] += step * v
            if p[k] < eps:
                p[k] = 0.0
            elif p[k] > 1 - eps:
                p[k] = 1.0
        hand = [k for k in hand if 0 < p[k] < 1]
    return p


def _fly(units: DataFrame, chunks: dict[str, int], seed: int, turn: int, land: bool) -> DataFrame:
    n = F.lit(1)
    for s, k in chunks.items():
        n = F.when(F.col("source") == s, F.lit(k)).otherwise(n)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        name = f"{seed}/{turn}/{pdf['source'].iloc[0]}/{pdf['chunk'].iloc[0]}"
        draw = random.Random(zlib.crc32(name.encode()))
        p = flight(pdf["n_tokens"].astype(float).tolist(), pdf["p"].tolist(), draw, land)
        return pdf.assign(p=p)[["doc_id", "source", "n_tokens", "p"]]

    return units.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed + turn)), n)).groupBy("source", "chunk").applyInPandas(run, _UNITS)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents of the mix with their copies, shares reached per source).

    The mix has (doc_id, source, n_tokens, copies), for copies > 0. Its size is total_tokens, or what the scarcest source
    can give at its share if none is named or it is more than that. A source's rate, share * size / its tokens, is split
    into whole copies of every document and a fraction, which becomes 0 or 1 per document by the cube method, in flights
    of at most some FLIGHT documents, whose few open units fly again until two per source are left to land.

    The report has (source, target_share, reached_share, tokens, documents, copies, available_tokens, max_repeats) for
    every target. Shares are scaled to add up to one; a source without tokens reaches 0, and the others share its part in
    proportion. Null sources and sources without target take no part; documents without tokens never enter. A null or
    non-positive target_share takes no part, a null max_repeats is 1; repeated targets count once. Further columns are
    ignored. Only per-source totals come to the driver: one row per target.
    """
    spark = documents.sparkSession
    docs = with_token_counts(documents.filter("source is not null").select("doc_id", even_source(F.col("source")).alias("source"), "text"), ["doc_id", "source"], path=tokenizer)
    docs = materialise(docs.filter("n_tokens > 0"))
    goals = targets.select(even_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)).alias("max_repeats")).filter("source is not null and share > 0 and not isnan(share)").dropDuplicates(["source"])
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = sorted(goals.join(have, "source", "left").collect())
    whole = sum(r["share"] for r in rows)
    able = [r for r in rows if r["tokens"] and r["max_repeats"] > 0]
    size = min((r["max_repeats"] * r["tokens"] * sum(x["share"] for x in able) / r["share"] for r in able), default=0.0)
    size = min(size, total_tokens) if total_tokens is not None else size
    rate = {r["source"]: min(size * r["share"] / sum(x["share"] for x in able) / r["tokens"], float(r["max_repeats"])) for r in able}
    full = {s: floor(v + 1e-9) for s, v in rate.items()}
    part = {s: max(v - full[s], 0.0) for s, v in rate.items()}
    table = spark.createDataFrame([(s, full[s], part[s] if part[s] > 1e-9 else 0.0) for s in rate] or [("", 0, 0.0)], "source string, whole long, p double")
    docs = docs.join(F.broadcast(table), "source")
    open_ = docs.filter("p > 0").select("doc_id", "source", "n_tokens", "p")
    left = {r["source"]: r["documents"] for r in able if part[r["source"]] > 1e-9}
    settled, turn = None, 0
    while left:
        land = all(n <= FLIGHT for n in left.values())
        flown = materialise(_fly(open_, {s: max(1, ceil(n / FLIGHT)) for s, n in left.items()}, seed, turn, land))
        done = flown.filter("p = 1").select("doc_id", F.lit(1).cast("long").alias("extra"))
        settled = done if settled is None else settled.unionByName(done)
        if land:
            break
        open_ = flown.filter("p > 0 and p < 1")
        left = {r[0]: r[1] for r in open_.groupBy("source").count().collect()}
        turn += 1
    extra = settled if settled is not None else spark.createDataFrame([], "doc_id long, extra long")
    mixed = docs.join(extra, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")).filter("copies > 0")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    all_ = spark.createDataFrame([(r["source"], r["share"] / whole, int(r["tokens"] or 0), int(r["max_repeats"])) for r in rows], "source string, target_share double, available_tokens long, max_repeats long")
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    report = all_.join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(total)).select("source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies")], "available_tokens", "max_repeats")
    return mixed, report
