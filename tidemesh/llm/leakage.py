"""Passages of held-out items inside training texts: n-gram seeds joined on both sides, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import if_small, materialise, salted

_MARKS = re.compile(r"[^\w\s]|_")
#: Words of a seed. In 24 words with 3 changed at least five runs of five stay whole, in longer passages more.
SEED = 5
#: Words of an item that are aligned at once; longer items are cut into pieces of this many, which share twice the least passage.
PIECE = 256
FOUND = "doc_id long, item_id long, item_words int, matched int, errors int, score int"


def words(text: str | None) -> list[str]:
    """Lower-case words; punctuation and the marks of quotes, comments, lists and diffs are taken out."""
    return _MARKS.sub("", text.lower()).split() if text else []


def seed_words(whole: int, per: int) -> int:
    """Words of an item's seeds: SEED, and in items under 2 SEED words no more than the longest run that their errors must leave."""
    errors = whole // per
    return max(1, min(SEED, -(-(whole - errors) // (errors + 1)))) if whole < 2 * SEED else SEED


def seeds_needed(whole: int, least: int, per: int) -> tuple[int, int]:
    """(seeds that a passage of an item must keep, words of the longest passage that has to be looked for).

    A passage of 2 `least` words or more has a part of at least `least` that is one too, so lengths below that are enough.
    """
    q = seed_words(whole, per)
    lengths = range(min(least, whole), min(2 * least - 1, whole) + 1)
    return max(1, min(n - n // per - (q - 1) * (n // per + 1) for n in lengths)), lengths[-1]


class _Codes(dict):
    """Word -> 64-bit hash, remembered for as many words as fit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return code


def _runs(codes: np.ndarray, q: int) -> np.ndarray:
    """A well mixed code for each run of q words, from the words' codes; alignment compares the words themselves."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = np.full(n, q, np.uint64)
        for k in range(q):
            c = c * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        c = (c ^ (c >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        c = (c ^ (c >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return c ^ (c >> np.uint64(31))


def align(a: np.ndarray, b: np.ndarray, apart: np.ndarray | None = None, match: int = 1, other: int = -2, gap: int = 2) -> tuple[int, list[int], tuple[int, int, int, int]]:
    """Smith-Waterman of words: best score, its path (0 match, 1 change, 2 word of a missing, 3 word put in) and the ranges of a and b that it takes.

    apart: pairs of words (len(a) x len(b)) that count as unlike though they are equal.
    """
    n, m = len(a), len(b)
    like = a[:, None] == b[None, :]
    if apart is not None:
        like &= ~apart
    gain = np.where(like, match, other).astype(np.int32)
    h = np.zeros((n + 1, m + 1), np.int32)
    step = gap * np.arange(1, m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        t = np.maximum(h[i - 1, :-1] + gain[i - 1], h[i - 1, 1:] - gap)
        np.maximum(t, 0, out=t)
        h[i, 1:] = np.maximum.accumulate(t + step) - step
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    best, path, end = int(h[i, j]), [], (i, j)
    while h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + gain[i - 1, j - 1]:
            path.append(0 if like[i - 1, j - 1] else 1)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - gap:
            path.append(2)
            i -= 1
        else:
            path.append(3)
            j -= 1
    return best, path[::-1], (i, end[0], j, end[1])


def _beyond(a: np.ndarray, b: np.ndarray, errors: int) -> list[tuple[int, int]]:
    """(words of a, errors) of every stretch from the beginning of a and b that ends in a matched word, with at most `errors` errors."""
    b = b[: len(a) + errors]
    across = np.arange(len(b) + 1)
    row, out = across.copy(), []
    for i, w in enumerate(a, 1):
        same = b == w
        diagonal = row[:-1] + ~same
        if same.any() and (e := int(row[:-1][same].min())) <= errors:
            out.append((i, e))
        row = np.minimum.accumulate(np.r_[i, np.minimum(diagonal, row[1:] + 1)] - across) + across
        if row.min() > errors:
            break
    return out


def passage(path: list[int], least: int, per: int, whole: int, before: list[tuple[int, int]] = (), after: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """(item words, errors) of the longest stretch of a path with `least` item words (or the whole item) and at most one error in `per` words.

    before, after: stretches (words, errors) by which the path can go on at either end.
    """
    p = np.array(path)
    w, e = np.r_[0, np.cumsum(p != 3)], np.r_[0, np.cumsum(p != 0)]
    w1, e1 = (np.r_[[-x[k] for x in before], v].astype(int) for k, v in enumerate((w, e)))
    w2, e2 = (np.r_[v, [v[-1] + x[k] for x in after]].astype(int) for k, v in enumerate((w, e)))
    words_in, errors = w2[None, :] - w1[:, None], e2[None, :] - e1[:, None]
    ok = (words_in >= min(least, whole)) & (words_in > 0) & (errors >= 0) & (errors * per <= words_in)
    if not ok.any():
        return None
    i, j = np.unravel_index(np.where(ok, words_in * 1000 - errors, -1).argmax(), ok.shape)
    return int(words_in[i, j]), int(errors[i, j])


def held_whole(item: np.ndarray, text: np.ndarray) -> int:
    """Fewest errors (words changed, missing or put in) with which a text holds all of an item."""
    across = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        enter = np.r_[i, np.minimum(row[:-1] + (text != w), row[1:] + 1)]
        row = np.minimum.accumulate(enter - across) + across
    return int(row.min())


def held_passage(item: np.ndarray, text: np.ndarray, least: int, per: int) -> tuple[int, int, int] | None:
    """(matched item words, errors, score) of a passage of the item in the text: alignments in order of score, each without the matches of those before.

    None if no alignment, gone on with at both ends, holds `least` words (or the whole item) with one error in `per`. A
    passage of n words has a score of at least n - 3 (n // per), which ends the search.
    """
    whole = len(item)
    if whole < 2 * SEED:
        errors = held_whole(item, text)
        return (whole, errors, whole - 3 * errors) if errors * per <= whole else None
    floor = min(n - 3 * (n // per) for n in range(min(least, whole), min(2 * least - 1, whole) + 1))
    apart = np.zeros((whole, len(text)), bool)
    while True:
        score, path, (i0, i1, j0, j1) = align(item, text, apart)
        if score < floor:
            return None
        most = 2 * least // per
        before = _beyond(item[max(0, i0 - 2 * least) : i0][::-1], text[max(0, j0 - 3 * least) : j0][::-1], most)
        after = _beyond(item[i1 : i1 + 2 * least], text[j1 : j1 + 3 * least], most)
        if (p := passage(path, least, per, whole, before, after)) is not None:
            return *p, score
        i, j = i0, j0
        for s in path:
            apart[i, j] |= s == 0
            i, j = i + (s != 3), j + (s != 2)


def _close(places: np.ndarray, at: np.ndarray, need: int, span: int, q: int, errors: int) -> bool:
    """Whether some seed has `need` different ones, itself counted, within a passage that begins with it."""
    o = np.argsort(at, kind="stable")
    at, d = at[o], (places - at)[o]
    near = (at[None, :] >= at[:, None]) & (at[None, :] <= at[:, None] + span - q) & (np.abs(d[None, :] - d[:, None]) <= errors)
    row, k = np.nonzero(near)
    new = np.r_[True, (row[1:] != row[:-1]) | (at[k][1:] != at[k][:-1])] if len(row) else np.zeros(0, bool)
    return bool((np.bincount(row[new], minlength=1) >= need).any())


def windows(places: np.ndarray, at: np.ndarray, whole: int, least: int, per: int) -> list[tuple[int, int]]:
    """Ranges of a text's words where its seeds (places[k], at[k] in the item) can stand in one passage: enough of them near one diagonal.

    A range is at most some four times the item's length; neighbouring ranges overlap by more than a passage can take.
    Where very many seeds meet (words over and over) ranges are opened without a closer look.
    """
    need, span = seeds_needed(whole, least, per)
    q, reach = seed_words(whole, per), whole + whole // per + SEED
    o = np.argsort(places, kind="stable")
    places, at = places[o], at[o]
    out = []
    lo = 0
    while lo < len(places):
        hi = int(np.searchsorted(places, places[lo] + 2 * reach))
        if hi - lo >= need and (hi - lo > 1000 or _close(places[lo:hi], at[lo:hi], need, span, q, span // per)):
            out.append((max(0, int(places[lo]) - reach), int(places[hi - 1]) + reach))
        if hi == len(places):
            break
        lo = int(np.searchsorted(places, places[lo] + reach))
    return out


def _all_windows(places: np.ndarray, whole: int, per: int) -> list[tuple[int, int]]:
    """Ranges as of `windows` around all of the places, without a look at the seeds."""
    reach = whole + whole // per + SEED
    cell = np.unique(places // reach)
    return [(max(0, int(c - 1) * reach), int(c + 2) * reach) for c in cell]


def _met(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the text and place in the item of every seed of a list<struct<places, at>> column."""
    flat = col.flatten()
    entry_row = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    p, a = flat.field(0), flat.field(1)
    (np_, p0), (na, a0) = ((np.diff(o := x.offsets.to_numpy()), o[:-1]) for x in (p, a))
    pv, av = p.values.to_numpy(zero_copy_only=False), a.values.to_numpy(zero_copy_only=False)
    n = np_.astype(np.int64) * na
    e = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    return entry_row[e], pv[p0[e] + k // na[e]].astype(np.int64), av[a0[e] + k % na[e]].astype(np.int64)


def _pieces(whole: int, least: int) -> list[tuple[int, int]]:
    if whole <= PIECE:
        return [(0, whole)]
    step = PIECE - 2 * least
    return [(k, min(k + PIECE, whole)) for k in range(0, whole - 2 * least, step)]


def _items(items: DataFrame, least: int, per: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item_id, text_id) of all items; units (text_id, piece, item_words, words); seeds (code, text_id, piece, need, at)."""
    split = "item_id long, mark string, words array<string>"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            w = p["text"].map(words)
            yield pd.DataFrame({"item_id": p["item_id"], "mark": w.map(lambda x: xxhash.xxh3_128_hexdigest(" ".join(x))), "words": w})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    rows = materialise(rows.mapInPandas(read, split).filter("size(words) > 0"))
    texts = rows.groupBy("mark").agg(F.min("item_id").alias("text_id"), F.first("words").alias("words"))
    texts = materialise(texts)
    big, small = salted(rows.select("item_id", "mark"), texts.select("mark", "text_id"), F.xxhash64("mark"), F.col("item_id"))
    members = materialise(big.join(small, ["mark", "_salt"]).select("item_id", "text_id"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, k, len(w), list(w[a:b])) for i, w in zip(p["text_id"], p["words"]) for k, (a, b) in enumerate(_pieces(len(w), least))]
            yield pd.DataFrame(rows, columns=["text_id", "piece", "item_words", "words"])

    units = materialise(texts.select("text_id", "words").mapInPandas(cut, "text_id long, piece int, item_words int, words array<string>"))

    def seed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for p in parts:
            rows = []
            for i, k, w in zip(p["text_id"], p["piece"], p["words"]):
                q = seed_words(len(w), per)
                need = seeds_needed(len(w), least, per)[0]
                runs = _runs(np.fromiter(map(codes.__getitem__, w), np.uint64, len(w)), q).view(np.int64)
                code, where = np.unique(runs, return_inverse=True)
                rows += [(int(c), i, k, q, need, np.flatnonzero(where == n).astype(np.int32)) for n, c in enumerate(code)]
            yield pd.DataFrame(rows, columns=["code", "text_id", "piece", "q", "need", "at"])

    seeds = materialise(units.mapInPandas(seed, "code long, text_id long, piece int, q int, need int, at array<int>"))
    return members, units, seeds


def _sieve(seeds: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of the seeds' codes, two bits each, as bytes; its size follows their number, up to most_bits."""
    n = seeds.count()
    bits = min(most_bits, 1 << max(15, int(np.ceil(np.log2(32 * n + 1)))))
    at = seeds.select(F.explode(F.array(F.col("code").bitwiseAND(bits - 1), F.shiftrightunsigned("code", 32).bitwiseAND(bits - 1))).alias("b"))
    parts = at.groupBy(F.expr("b div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits")).collect()  # bits / 32768 rows of 4 kB
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for part, b in parts:
        out[part] = np.frombuffer(bytes(b), np.uint8)
    return out.ravel()


_SEEN = "doc_id long, mark string, words array<string>, hits array<struct<code: bigint, places: array<int>>>"


def _seek(sieve: np.ndarray, lengths: list[int], least_hits: int):
    """Texts with enough runs of words that the sieve lets through: their words and where the runs stand, by code."""
    mask = np.uint64(8 * len(sieve) - 1)
    kind = pa.struct([("code", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            texts = b.column(1).to_pylist()
            split = [words(t) for t in texts]
            size = np.array([len(w) for w in split], np.int64)
            flat = np.fromiter((c for w in split for c in map(codes.__getitem__, w)), np.uint64, int(size.sum()))
            start = np.cumsum(size) - size
            doc = np.repeat(np.arange(len(split)), size)
            found = []
            for q in lengths:
                c = _runs(flat, q)
                hit = doc[: len(c)] == doc[q - 1 :]
                for at in (c & mask, (c >> np.uint64(32)) & mask):
                    hit &= (sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                k = np.flatnonzero(hit)
                found.append((doc[k], c[k].view(np.int64), k - start[doc[k]]))
            d, c, k = (np.concatenate(x) for x in zip(*found))
            o = np.lexsort((k, c, d))
            d, c, k = d[o], c[o], k[o].astype(np.int32)
            keep = np.bincount(d, minlength=len(split)) >= least_hits
            ok = keep[d] if len(d) else np.zeros(0, bool)
            d, c, k = d[ok], c[ok], k[ok]
            docs = np.flatnonzero(keep)
            new = np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])] if len(c) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(c)].astype(np.int32)), pa.array(k))
            entries = pa.StructArray.from_arrays([pa.array(c[first]), places], fields=list(kind))
            ends = np.r_[np.searchsorted(d[first], docs), len(first)].astype(np.int32)
            marks = [xxhash.xxh3_128_hexdigest(texts[i]) for i in docs]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs)), pa.array(marks, pa.string()), pa.array([split[i] for i in docs], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), entries)], names=["doc_id", "mark", "words", "hits"])

    return run


_PLACED = "doc_id long, mark string, text_id long, piece int, lo int, hi int"


def _place(least: int, per: int):
    """Windows of the texts in which a piece's seeds can stand in one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            load = whole.column(5).to_numpy()
            heavy = load > 20_000_000  # one word over and over
            for k in np.flatnonzero(heavy):
                at = _all_windows(whole.column(6)[int(k)].values.field(0).flatten().to_numpy(), int(whole.column(4)[int(k)].as_py()), per)
                yield placed(whole, [(int(k), lo, hi) for lo, hi in at])
            whole = whole.filter(pa.array(~heavy))
            size = load[~heavy].cumsum()
            cuts = np.r_[0, np.flatnonzero(np.diff(size // 2_000_000)) + 1, whole.num_rows]
            for b in (whole.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo):
                length = b.column(4).to_numpy()
                shape = {int(n): (*seeds_needed(int(n), least, per),) for n in np.unique(length)}
                need, span = (np.array([shape[int(n)][k] for n in length]) for k in (0, 1))
                row, places, at = _met(b.column(6))
                # few rows have enough seeds near one diagonal: they are told apart all at once
                wide = 2 * (span // per + 1)
                stays = np.zeros(b.num_rows, bool)
                for x in (0, wide // 2):
                    band = (places - at + PIECE + (x if np.isscalar(x) else x[row])) // wide[row]
                    key = np.unique(((row << 31) + band) * PIECE + at)
                    box, n = np.unique(key // PIECE, return_counts=True)
                    who = box >> 31
                    stays[who[n >= need[who]]] = True
                o = np.argsort(row, kind="stable")
                edge = np.searchsorted(row[o], np.arange(b.num_rows + 1))
                out = [(k, *w) for k in np.flatnonzero(stays) for w in windows(places[o[edge[k] : edge[k + 1]]], at[o[edge[k] : edge[k + 1]]], int(length[k]), least, per)]
                yield placed(b, out)

    def placed(b: pa.RecordBatch, out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        k, lo, hi = (pa.array(np.array(c, np.int32)) for c in (zip(*out) if out else ((), (), ())))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(k) for c in range(4)), lo, hi], names=["doc_id", "mark", "text_id", "piece", "lo", "hi"])

    return run


def _judge(least: int, per: int):
    names = ("doc_id", "text_id", "item_words", "matched", "errors", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                vocab = {w: k for k, w in enumerate(dict.fromkeys(r["words"]), 1)}
                item = np.array([vocab[w] for w in r["words"]], np.int32)
                text = np.array([vocab.get(w, 0) for w in r["part"]], np.int32)
                if (p := held_passage(item, text, least, per)) is not None:
                    out.append((r["doc_id"], r["text_id"], r["item_words"], *p))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=pa.schema([(n, pa.int64() if k < 2 else pa.int32()) for k, n in enumerate(names)]))

    return run


def leaked_items(documents: DataFrame, items: DataFrame, least: int = 24, per: int = 8, most_bits: int = 1 << 28) -> DataFrame:
    """Pairs (doc_id, item_id) of which the text holds a passage of at least `least` consecutive words of the item, or all of it, with at most one word in `per` changed; with item_words, matched words, errors and score of one such passage.

    Words are compared without case, punctuation or the marks of quotes, comments, lists and diffs; a passage begins and
    ends with words that are the item's. Seeds are the items' runs of five words (fewer in items of under ten, which are
    compared as a whole). The corpus is read once: a Bloom filter of all seeds (at most most_bits bits; a fuller one lets
    more through, and loses nothing) leaves the texts that can hold one. These join the seeds on their codes, hot codes
    sliced; seeds of a (text, item) pair that fit one passage open a window of the text, however many items share them,
    and every window is aligned, best alignment first, until a passage is found or none is left. Items of over PIECE
    words are compared in pieces, so `matched` is at most PIECE; items of the same words are compared once.

    Null or empty texts and items match nothing; rows of a repeated item or document count once; empty tables give an
    empty result; further columns are ignored. Nothing about the result depends on partitions or on other rows.
    """
    members, units, seeds = _items(items, least, per)
    shape = seeds.agg(F.collect_set("q"), F.min("need")).first()
    if not shape[0]:
        return documents.sparkSession.createDataFrame([], FOUND)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null and doc_id is not null")
    seen = materialise(docs.mapInArrow(_seek(_sieve(seeds, most_bits), sorted(shape[0]), shape[1]), _SEEN))
    hits = seen.select("doc_id", "mark", F.explode("hits").alias("h")).select("doc_id", "mark", "h.code", "h.places")
    plain = seeds.drop("q")
    side = if_small(plain, scan=True)
    if side is plain:
        big, side = salted(hits, plain, F.col("code"), F.xxhash64("doc_id", "mark"))
        met = big.join(side, ["code", "_salt"])
    else:
        met = hits.join(side, "code")
    pairs = met.groupBy("doc_id", "mark", "text_id", "piece").agg(F.sum(F.size("at")).alias("n"), F.sum(F.size("at").cast("long") * F.size("places")).alias("load"), F.max("need").alias("need"), F.collect_set(F.struct("places", "at")).alias("seeds")).filter("n >= need")
    length = units.select("text_id", "piece", F.size("words").alias("whole"))
    placed = pairs.join(if_small(length, scan=True), ["text_id", "piece"]).select("doc_id", "mark", "text_id", "piece", "whole", "load", "seeds").mapInArrow(_place(least, per), _PLACED)
    placed = materialise(placed)
    texts = seen.select("doc_id", "mark", "words").dropDuplicates(["doc_id", "mark"]).withColumnRenamed("words", "_w")
    opened = placed.join(texts, ["doc_id", "mark"]).select("doc_id", "text_id", "piece", F.expr("slice(_w, lo + 1, hi - lo)").alias("part"))
    found = opened.join(if_small(units), ["text_id", "piece"]).select("doc_id", "text_id", "item_words", "words", "part").mapInArrow(_judge(least, per), "doc_id long, text_id long, item_words int, matched int, errors int, score int")
    best = found.groupBy("doc_id", "text_id").agg(F.max(F.struct("matched", -F.col("errors"), "score", "item_words")).alias("b"))
    best = materialise(best.select("doc_id", "text_id", F.col("b.item_words").alias("item_words"), F.col("b.matched").alias("matched"), (-F.col("b.col2")).alias("errors"), F.col("b.score").alias("score")))
    many, few = salted(best, members, F.col("text_id"), F.col("doc_id"))
    return many.join(few, ["text_id", "_salt"]).select("doc_id", "item_id", "item_words", "matched", "errors", "score")
