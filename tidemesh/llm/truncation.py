"""Texts cut off by field limits or in transfer, and how often each source cuts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import if_small, materialise
from .endings import COMPLETE, HUNK_SHORT, OPEN, SENTENCE, WORD, ending, last_word, tail

_SCAN = "doc_id long, source string, word string, verdict string, chars long, bytes long, tail string"
#: Longer runs of letters are no words that a text could end inside of.
LONGEST_WORD = 64
_LETTERS = re.compile(r"[^\W\d_]+")


def even_source(source: Column) -> Column:
    """The source's name with case, blanks and hyphens evened out."""
    return F.lower(F.trim(F.regexp_replace(source, "-", "_")))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its ending; and, with a null verdict, the batch's words and how often each stands before another word or mark."""
    names = [c.split()[0] for c in _SCAN.split(", ")]
    for b in batches:
        ids, sources, texts = (b.column(k).to_pylist() for k in range(3))
        words: Counter[str] = Counter()
        rows = []
        for i, s, t in zip(ids, sources, texts):
            t = t or ""
            w = last_word(t)
            words.update(_LETTERS.findall(t.lower()))
            if w:
                words[w] -= 1
            rows.append((i, s, w if w and len(w) <= LONGEST_WORD else None, ending(t), len(t), len(t.encode("utf-8", "replace")), tail(t)))
        rows += [(None, None, w, None, n, None, None) for w, n in words.items() if n > 0]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)


def censored_lognormal(length: np.ndarray, count: np.ndarray, least: int = 5, deviations: float = 5.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Maximum likelihood of log-normal lengths right-censored at candidate limits, by EM over a histogram.

    Candidate limits are lengths held at least `least` times and by `deviations` standard deviations more often than the third
    most frequent of the ten lengths next to them: a limit stands alone, or with another beside it, while texts of one form
    heap up around their usual length.
    Gives the limits, the posterior that a value of that length was cut there, and mu and sigma.
    """
    o = np.argsort(length)
    x, c = length[o].astype(float), count[o].astype(float)
    ok = x > 0
    x, c = x[ok], c[ok]
    if c.sum() < 2 * least:
        return np.zeros(0), np.zeros(0), math.nan, math.nan
    beside = np.zeros((10, len(x)))
    for k, off in enumerate((-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)):
        at = np.minimum(np.searchsorted(x, x + off), len(x) - 1)
        beside[k] = np.where(x[at] == x + off, c[at], 0)
    around = np.sort(beside, axis=0)[-3]
    limit = (c >= least) & (c - around > deviations * np.sqrt(around + 1)) & (x >= 16)
    cut = np.where(limit, c - around, 0.0)  # expected count of censored records at each limit
    lx = np.log(x)
    erf = np.frompyfunc(math.erf, 1, 1)
    cdf = lambda v: 0.5 * (1 + erf(v / math.sqrt(2)).astype(float))
    mu, sigma = np.average(lx, weights=c), max(1e-3, math.sqrt(np.cov(lx, fweights=c.astype(int)) if len(x) > 1 else 1e-3))
    for _ in range(rounds):
        z = (lx - mu) / sigma
        beyond = np.maximum(1 - cdf(z), 1e-12)
        mills = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / beyond
        first, second = mu + sigma * mills, sigma**2 * (1 + z * mills) + 2 * mu * (mu + sigma * mills) - mu**2
        whole, n = c - cut, c.sum()
        m = (whole @ lx + cut @ first) / n
        var = (whole @ lx**2 + cut @ second) / n - m * m
        mu, sigma = m, math.sqrt(max(var, 1e-6))
        natural = n * (cdf((np.log(x + 0.5) - mu) / sigma) - cdf((np.log(np.maximum(x - 0.5, 0.5)) - mu) / sigma))
        cut = np.where(limit, np.maximum(c - np.maximum(natural, around), 0.0), 0.0)
    return x[limit], (cut / c)[limit], float(mu), float(sigma)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    limits, posterior, mu, sigma = censored_lognormal(pdf["length"].to_numpy(), pdf["n"].to_numpy())
    return pd.DataFrame({"source": pdf["source"].iloc[0], "unit": pdf["unit"].iloc[0], "length": limits.astype(np.int64), "posterior": posterior, "mu": mu, "sigma": sigma})


#: Verdicts that speak for a cut before any data are seen, and of these the ones that prove it: lines owed, quotes or addresses left open.
_SPEAKS, _PROVES = (HUNK_SHORT, WORD, SENTENCE), (HUNK_SHORT, WORD)


def evidence_odds(counts: list[tuple[str, str, str | None, float, int, float]], rounds: int = 100, weight: float = 10.0) -> tuple[float, dict[tuple[str, str], float], dict[str, float]]:
    """(rate of cuts elsewhere than at limits, (verdict, tail) -> how many times likelier that ending is in cut texts than in whole ones, limit -> share of its texts that were cut there).

    counts: (verdict, tail, limit, the length law's posterior of a cut at it, log2 of how much likelier the last word is
    inside a longer one, texts). A text is cut at a limit with the share of that limit, or elsewhere at a rate that is the
    same for all; given that, its ending and its last word do not depend on its length. EM over these two classes, with
    weak priors: a limit's share is its posterior by length, which counts as `weight` texts; 50 cut texts, most of them of
    verdicts that speak for a cut or ending in a letter, 1,000 whole ones of other verdicts, 2 in 40 cut elsewhere.
    """
    ends = sorted({(v, t) for v, t, *_ in counts})
    limits = sorted({c[2] for c in counts if c[2] is not None})
    at, lim = {e: k for k, e in enumerate(ends)}, {x: k for k, x in enumerate(limits)}
    k = np.array([at[v, t] for v, t, *_ in counts])
    j = np.array([lim.get(c[2], len(limits)) for c in counts])
    p, word, n = (np.array([c[i] for c in counts], float) for i in (3, 4, 5))
    word = 2.0**word
    law = np.zeros(len(limits) + 1)
    law[j] = np.where(j < len(limits), p, 0)
    held = np.bincount(j, n, len(law))
    speaks, proven = (np.array([v in w for v, _ in ends]) for w in (_SPEAKS, _PROVES))
    letter = np.array([t == "letter" for _, t in ends]) & ~speaks

    def spread(total: float, *shares: tuple[np.ndarray, float]) -> np.ndarray:
        return sum(total * w * mask / max(mask.sum(), 1) for mask, w in shares)

    prior_cut = spread(50, (speaks, 0.5), (letter, 0.4), (~speaks & ~letter, 0.1))
    prior_whole = spread(1000, (speaks, 0.0002 * max(speaks.sum(), 1)), (~speaks, 1.0))
    share, rate = law.copy(), 0.05
    r = np.where(speaks[k], 0.95, 0.05 * np.maximum(law[j], rate) * word / (1 + 0.05 * np.maximum(law[j], rate) * word))
    for _ in range(rounds):
        r[proven[k]] = 1.0
        cut = np.bincount(k, n * r, len(ends)) + prior_cut
        whole = np.bincount(k, n * (1 - r), len(ends)) + prior_whole
        prior = 1 - (1 - share[j]) * (1 - rate)
        here = n * r * share[j] / prior
        rate = ((n * r - here).sum() + 2) / (n.sum() + 40)
        share = (np.bincount(j, here, len(law)) + weight * law) / (held + weight)
        share[-1] = 0
        odds = (cut / cut.sum()) / (whole / whole.sum())
        prior = 1 - (1 - share[j]) * (1 - rate)
        load = prior * odds[k] * word
        r = load / (load + 1 - prior)
    return float(rate), {e: float(1e6 if proven[i] else odds[i]) for e, i in at.items()}, {x: float(share[i]) for x, i in lim.items()}


def _word_odds(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """(word, lean): log2, rounded and within +-12, of how much likelier a text ends in this word by a cut inside a longer one than by its end.

    By a cut after any letter of the corpus, this is what is left of a word as often as words begin with it, out of all
    letters; by an end, as often as it stands whole, out of all words.
    """
    words = materialise(seen.filter("verdict is null").groupBy("word").agg(F.sum("chars").alias("n")))
    last = materialise(rows.filter("word is not null").select("word").distinct())
    lengths = sorted(r[0] for r in last.select(F.length("word")).distinct().collect())  # at most LONGEST_WORD
    parts = F.explode(F.filter(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in lengths or [LONGEST_WORD]]), lambda x: x.isNotNull()))
    starts = words.select("n", parts.alias("word")).join(if_small(last), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("longer"))
    total = words.agg(F.sum("n"), F.sum(F.col("n") * F.length("word"))).first()
    w, letters = (float(x or 1) for x in total)
    whole = F.coalesce("n", F.lit(0)) + 0.25
    lean = F.log2((F.coalesce("longer", F.lit(0)) + whole) / letters / (whole / w))
    return last.join(starts, "word", "left").join(words, "word", "left").select("word", F.greatest(F.least(F.round(lean), F.lit(12.0)), F.lit(-12.0)).cast("int").alias("lean"))


def judge_endings(documents: DataFrame, surest: float = 0.5) -> DataFrame:
    """One row per document: doc_id, source (spelling evened out), verdict, evidence, limit, posterior, cut.

    limit is the probability that a text of this length was cut at a limit of its source: at first by right-censored length
    laws fitted per source to characters and to bytes, then weighed against how the texts of that length end. verdict is
    what the ending says: `hunk` (lines announced are missing), `sentence` or `word` (ends inside one), `open` (can't be
    told) or `complete`. posterior joins these for every text: the odds of a cut, at the limit or elsewhere, times how much
    likelier such an ending is in cut texts than in whole ones, which is learnt from the corpus (`evidence_odds`), times
    how much likelier its last word is the beginning of a longer one than a whole one (`_word_odds`). A text is cut if its
    posterior is `surest` or more; evidence is what speaks for it, `word` also where the last word does against the rest
    of the ending, `limit` where only the length does, or `none`.

    Null and blank texts are complete. A null source is a source of its own; doc_id null is kept as a row. Every copy is
    judged alike; empty tables give an empty result; further columns are ignored. Whole texts are read. Last words of over
    64 letters are no words.
    """
    docs = documents.select("doc_id", even_source(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    seen = materialise(docs.mapInArrow(_scan, _SCAN))
    rows = seen.filter("verdict is not null")
    words = _word_odds(seen, rows)
    units = rows.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"))
    lengths = units.select("source", "u.*").groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    fits = lengths.groupBy("source", "unit").applyInPandas(_fit, "source string, unit string, length long, posterior double, mu double, sigma double")
    fits = materialise(fits.select("source", "unit", "length", "posterior"))
    none = F.concat(F.lit("\x00"), F.xxhash64("doc_id").cast("string"))  # texts without a last word do not meet in one task
    out = rows.withColumn("word", F.coalesce("word", none)).join(if_small(words), "word", "left")
    for unit in ("chars", "bytes"):
        key = F.concat_ws("/", F.coalesce("source", F.lit("")), "unit", "length")
        f = if_small(fits.filter(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("length").alias(unit), F.struct(F.col("posterior").alias("p"), key.alias("key")).alias(f"p_{unit}")), scan=True)
        out = out.join(f, out["source"].eqNullSafe(f["_s"]) & (out[unit] == f[unit]), "left").drop(f[unit]).drop("_s")
    lean = F.when(F.col("tail") == "letter", F.coalesce("lean", F.lit(0))).otherwise(F.lit(0))
    out = materialise(out.select("doc_id", "source", "verdict", "tail", lean.alias("lean"), F.greatest("p_chars", "p_bytes").alias("at")))
    counts = out.groupBy("verdict", "tail", "lean", "at").agg(F.count("*").alias("n")).collect()  # some 100 rows for each limit of a source
    if not counts:
        return out.select("doc_id", "source", "verdict", F.lit("none").alias("evidence"), F.lit(0.0).alias("limit"), F.lit(0.0).alias("posterior"), F.lit(False).alias("cut"))
    rate, odds, shares = evidence_odds([(c["verdict"], c["tail"], c["at"] and c["at"]["key"], c["at"]["p"] if c["at"] else 0.0, c["lean"], c["n"]) for c in counts])
    by = F.create_map(*[F.lit(x) for (v, t), o in odds.items() for x in (f"{v}/{t}", o)])
    table = out.sparkSession.createDataFrame(list(shares.items()), "key string, limit double")
    out = out.withColumn("key", F.col("at.key")).join(if_small(table, scan=True), "key", "left").withColumn("limit", F.coalesce("limit", F.lit(0.0)))
    prior = 1 - (1 - F.col("limit")) * (1 - rate)
    load = prior * by[F.concat_ws("/", "verdict", "tail")] * F.pow(F.lit(2.0), F.col("lean"))
    out = out.withColumn("posterior", load / (load + 1 - prior)).withColumn("cut", F.col("posterior") >= surest)
    said = F.when(~F.col("verdict").isin(COMPLETE, OPEN), F.col("verdict")).when(F.col("lean") >= 2, "word").otherwise("limit")
    return out.select("doc_id", "source", "verdict", F.when(F.col("cut"), said).otherwise("none").alias("evidence"), "limit", "posterior", "cut")


def cut_rates(judged: DataFrame) -> DataFrame:
    """Documents, cut documents and their share for each source."""
    return judged.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("long")).alias("cut_documents"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))
