"""The nearest vectors of every vector: NN-descent over bounded leaves, and greedy search of its graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import discard, materialise

_GRAPH = "id long, near array<struct<d: double, id: long>>"


def usable_vectors(rows: DataFrame, vector_id: str, vector: Column, size: int) -> DataFrame:
    """(id, v): one row per id whose vector has `size` numbers, none of them null, NaN or infinite; lists of floats stay as they are, others become lists of doubles."""
    v = rows.select(F.col(vector_id).cast("long").alias("id"), vector.alias("v"))
    if v.schema["v"].dataType.simpleString() != "array<float>":
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == size) & ~F.coalesce(bad, F.lit(True))).dropDuplicates(["id"])


class Trees:
    """Planes that cut a bounded sample in halves again and again; every row then falls into one leaf per tree."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.planes, self.cuts = [], []
        for _ in range(trees):
            planes, cuts = np.zeros((2**depth - 1, sample.shape[1]), np.float32), np.full(2**depth - 1, np.inf, np.float32)
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for k in range(2**level):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2:
                        continue
                    a, b = rng.choice(at, 2, replace=False)
                    way = sample[a] - sample[b]
                    if not way.any():
                        way = rng.normal(size=sample.shape[1])
                    planes[2**level - 1 + k] = way
                    cuts[2**level - 1 + k] = np.median(sample[at] @ way.astype(np.float32))
                node = node * 2 + (np.einsum("ij,ij->i", sample, planes[2**level - 1 + node]) > cuts[2**level - 1 + node])
            self.planes.append(planes), self.cuts.append(cuts)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        out = np.zeros((len(v), len(self.planes)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(v), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (np.einsum("ij,ij->i", v, planes[at]) > cuts[at])
            out[:, t] = node
        return out


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of numbers from lists of them, or from their bytes as `as_bytes` writes them."""
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)
    if not len(col):
        return np.zeros((0, 1))
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    rows = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(col), -1)
    return np.ascontiguousarray(rows[:, 1:]).view(np.float32 if rows[0, 0] == 4 else np.float64).astype(np.float64)


def _kind(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.simpleString()


def as_bytes(vectors: DataFrame) -> DataFrame:
    """(id, v binary): the bytes of each vector's numbers after one that tells their width; shuffles and lists of them cost far less than of arrays."""
    wide = 4 if _kind(vectors) == "array<float>" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1)).astype(np.float32 if wide == 4 else np.float64) if b.num_rows else np.zeros((0, 1))
            rows = [bytes([wide]) + r.tobytes() for r in m]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def _nearest(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour's id and exact distance of the k nearest among the rows at hand."""
    n = len(v)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    sq = np.einsum("ij,ij->i", v, v)
    d = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
    row, near = np.repeat(np.arange(n), k), near.ravel()
    return row, ids[near], np.sqrt(((v[row] - v[near]) ** 2).sum(axis=1))


def _lists(row: np.ndarray, near: np.ndarray, d: np.ndarray, n: int) -> pa.Array:
    """Arrow lists of (d, id), n of them, from parts ordered by row."""
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d), pa.array(near)], ["d", "id"]))


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """One list of the k nearest per id from several short ones."""
    return parts.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def fitted(vectors: DataFrame, n: int, trees: int, leaf: int, sample_rows: int, seed: int) -> Trees:
    """Trees of a sample of at most sample_rows of the n vectors, deep enough for leaves of about `leaf` where the sample allows."""
    share = min(1.0, 1.2 * sample_rows / n)
    sample = (vectors.select("v").sample(share, seed).limit(sample_rows) if n > sample_rows else vectors.select("v")).toArrow()["v"].combine_chunks()
    depth = max(0, min(int(np.ceil(np.log2(n / leaf))), int(np.log2(max(len(sample), 2))) - 3))
    return Trees(_matrix(sample).astype(np.float32), trees, depth, seed)


def leaf_graph(vectors: DataFrame, k: int, trees: int, leaf: int, sample_rows: int, seed: int) -> DataFrame:
    """A first graph (id, near): the k nearest within the leaves of some random-plane trees and of one random division.

    The division gives every row a full list, wherever the trees put it. The planes are fitted to at most sample_rows rows; every row is placed. A leaf of more than 2 * leaf rows is cut at
    random into parts of about `leaf`: it loses neighbours for the descent to find again, never rows.
    """
    n = vectors.count()
    if n < 2:
        return vectors.select("id", F.expr("cast(array() as array<struct<d: double, id: long>>)").alias("near"))
    forest = fitted(vectors, n, trees, leaf, sample_rows, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.leaves(_matrix(b.column(1)).astype(np.float32))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(leaves[:, t])], names=["id", "v", "tree", "leaf"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, trees, np.int32)), pa.array(np.zeros(b.num_rows, np.int64))], names=["id", "v", "tree", "leaf"])

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        ids, v = group["id"].to_numpy(), _matrix(group["v"].combine_chunks())
        edges = [_nearest(ids[c], v[c], k) for c in np.array_split(np.arange(len(ids)), max(1, -(-len(ids) // (4 * leaf))))]
        base = np.cumsum([0, *[len(c) for c in np.array_split(np.arange(len(ids)), max(1, -(-len(ids) // (4 * leaf))))]])
        row = np.concatenate([e[0] + o for e, o in zip(edges, base)])
        return pa.table({"id": ids, "near": _lists(row, np.concatenate([e[1] for e in edges]), np.concatenate([e[2] for e in edges]), len(ids))})

    placed = vectors.mapInArrow(place, f"id long, v {_kind(vectors)}, tree int, leaf long")
    counts = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf)
    big = counts.select("tree", "leaf", F.ceil(F.col("n") / leaf).alias("parts"))
    placed = placed.join(big, ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.coalesce("parts", F.lit(1))))
    return _merged(placed.select("tree", "leaf", "part", "id", "v").groupBy("tree", "leaf", "part").applyInArrow(link, _GRAPH), k)


def descend(vectors: DataFrame, graph: DataFrame, k: int, most: int) -> DataFrame:
    """One round of NN-descent on (id, near, fresh): every node introduces its neighbours, and those that count it as theirs, to each other.

    fresh: the neighbours a node has had for less than a round. Two members met before unless one of them is fresh to the
    node that introduces them, so only such pairs are compared, and nodes without a fresh member send nothing. A node
    introduces its `most` nearest and `most` of those that link to it, fresh ones first.
    """
    near = graph.select("id", F.explode(F.slice("near", 1, most)).alias("e"), "fresh")
    forth = near.select(F.col("id").alias("hub"), F.col("e.id").alias("id"), F.col("e.d").alias("d"), F.array_contains("fresh", F.col("e.id")).alias("new"))
    # each link to a node draws a place by hash, and a place holds its nearest
    back = forth.select(F.col("id").alias("hub"), F.col("hub").alias("id"), "d", "new").withColumn("place", F.pmod(F.xxhash64("hub", "id"), F.lit(most)))
    back = back.groupBy("hub", "place").agg(F.min(F.struct((~F.col("new")).alias("old"), "d", "id")).alias("m")).select("hub", F.col("m.id").alias("id"), (~F.col("m.old")).alias("new"))
    members = forth.select("hub", "id", "new").unionByName(back).groupBy("hub").agg(F.collect_set(F.struct("id", "new")).alias("m"))  # 2 `most` at most
    members = members.filter(F.exists("m", lambda e: e["new"])).select("hub", F.explode("m").alias("m")).select("hub", "m.id", "m.new")
    bound = graph.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf"))).alias("bound"))
    sent = members.join(vectors.join(bound, "id"), "id").groupBy("hub").agg(F.collect_list(F.struct("id", "bound", "v", "new")).alias("met"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = b.column(0)
            sizes = np.diff(met.offsets.to_numpy())
            flat = met.flatten()
            ids, bound, v, fresh = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False), _matrix(flat.field(2)), flat.field(3).to_numpy(zero_copy_only=False)
            start = np.cumsum(sizes) - sizes
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for n in np.unique(sizes):
                if n < 2:
                    continue
                for at in np.array_split(start[sizes == n], max(1, int((sizes == n).sum() * n // 40_000))):
                    pos = at[:, None] + np.arange(n)[None, :]
                    x, i, c, f = v[pos], ids[pos], bound[pos], fresh[pos]
                    sq = (x * x).sum(-1)
                    d = np.sqrt(np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0))
                    g, a, z = np.nonzero((d <= c[:, :, None] + 1e-6) & (f[:, :, None] | f[:, None, :]) & (i[:, :, None] != i[:, None, :]))
                    exact = np.sqrt(((x[g, a] - x[g, z]) ** 2).sum(-1))
                    ok = exact < c[g, a]
                    out.append((i[g, a][ok], i[g, z][ok], exact[ok]))
            if out:
                a, z, d = (np.concatenate(p) for p in zip(*out))
                o = np.lexsort((z, d, a))
                a, z, d = a[o], z[o], d[o]
                new = np.r_[True, (a[1:] != a[:-1]) | (z[1:] != z[:-1])] if len(a) else np.zeros(0, bool)
                a, z, d = a[new], z[new], d[new]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                a, z, d = a[rank < k], z[rank < k], d[rank < k]
                if len(a):
                    who, row = np.unique(a, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(who), _lists(row, z, d, len(who))], names=["id", "near"])

    better = sent.select("met").mapInArrow(meet, _GRAPH)
    after = _merged(graph.select("id", "near").unionByName(better), k)
    ids = lambda c: F.transform(c, lambda e: e["id"])
    return after.join(graph.select("id", F.col("near").alias("had")), "id").select("id", "near", F.array_except(ids("near"), ids("had")).alias("fresh"))


def neighbour_graph(vectors: DataFrame, k: int = 12, trees: int = 5, leaf: int = 256, sample_rows: int = 40_000, rounds: int = 8, settled: float = 0.05, seed: int = 5, most: int = 12) -> DataFrame:
    """(id, near): about the k nearest of every vector by Euclidean distance, nearest first, by NN-descent.

    vectors: (id, v) as usable_vectors gives. Ties go to the smaller id. Each node introduces `most` neighbours of either
    direction in a round (see descend). Rounds end after `rounds`, or when fewer than `settled` of the links change. Fewer
    than two vectors give empty lists; an empty table gives no row. Exact copies are neighbours at distance 0 like any
    others.
    """
    vectors = materialise(as_bytes(vectors))
    first = leaf_graph(vectors, k, trees, leaf, sample_rows, seed)
    graph = materialise(first.withColumn("fresh", F.transform("near", lambda e: e["id"])))
    for _ in range(rounds):
        after = materialise(descend(vectors, graph, k, most))
        discard(graph)
        graph = after
        moved = graph.agg(F.sum(F.size("fresh")).alias("m"), F.sum(F.size("near")).alias("n")).first()
        if not moved["n"] or moved["m"] <= settled * moved["n"]:
            break
    return graph.select("id", "near")


def _entries(vectors: DataFrame, queries: DataFrame, beam: int, leaf: int, sample_rows: int, seed: int) -> DataFrame:
    """(query_id, best): for each query the `beam` nearest vectors of its leaf in one tree, and of one random group; a large leaf is parted at random, and a query looks into one part."""
    n = vectors.count()
    forest = fitted(vectors, n, 1, leaf, sample_rows, seed + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = forest.leaves(_matrix(b.column(1)).astype(np.float32))[:, 0]
                for t, l in ((0, at), (1, at * 0)):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, t, np.int32)), pa.array(l)], names=["id", "v", "asks", "tree", "leaf"])

    both = vectors.select("id", "v", F.lit(False).alias("asks")).unionByName(queries.select("id", "v", F.lit(True).alias("asks")))
    placed = both.mapInArrow(place, f"id long, v {_kind(both)}, asks boolean, tree int, leaf long")
    big = placed.filter("not asks").groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    placed = placed.join(big, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "asks"), F.col("parts")))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        asks, ids, v = group["asks"].to_numpy(), group["id"].to_numpy(), _matrix(group["v"].combine_chunks())
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        k = min(beam, len(p))
        if not k or not len(q):
            return pa.table({"id": pa.array([], pa.int64()), "near": _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)})
        d = (v[q] ** 2).sum(1)[:, None] + (v[p] ** 2).sum(1)[None] - 2 * v[q] @ v[p].T
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        row, at = np.repeat(np.arange(len(q)), k), p[at.ravel()]
        return pa.table({"id": ids[q], "near": _lists(row, ids[at], np.sqrt(((v[q][row] - v[at]) ** 2).sum(1)), len(q))})

    found = _merged(placed.select("tree", "leaf", "part", "id", "v", "asks").groupBy("tree", "leaf", "part").applyInArrow(meet, _GRAPH), beam)
    return found.select(F.col("id").alias("query_id"), F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), F.lit(False).alias("done"))).alias("best"))


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 16, leaf: int = 256, sample_rows: int = 40_000, rounds: int = 12, seed: int = 5) -> DataFrame:
    """(query_id, id, d, rank): greedy search of a neighbour graph for each query (id, v), by joins.

    A query starts from the nearest vectors of a leaf of one random-plane tree; in each round it looks at the neighbours of
    its `beam` best nodes not yet expanded, until none is nearer. A query that is itself in the collection finds itself
    too. Ties go to the smaller id; an empty side gives an empty result.
    """
    graph, vectors = materialise(graph.select("id", F.transform("near", lambda e: e["id"]).alias("near"))), materialise(vectors)
    q = materialise(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")))
    if not vectors.limit(1).count() or not q.limit(1).count():
        return q.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    far = F.sqrt(F.expr("aggregate(zip_with(q, v, (a, b) -> (a - b) * (a - b)), 0e0, (s, x) -> s + x)"))
    best = materialise(_entries(vectors, queries, beam, leaf, sample_rows, seed))
    for _ in range(rounds):
        ahead = best.select("query_id", F.explode("best").alias("b")).filter("not b.done").join(graph, F.col("b.id") == graph["id"]).select("query_id", F.explode("near").alias("id")).distinct()
        known = best.select("query_id", F.explode("best.id").alias("id"))
        worst = best.select("query_id", F.when(F.size("best") >= beam, F.element_at("best", -1)["d"]).otherwise(F.lit(float("inf"))).alias("worst"))
        met = ahead.join(known, ["query_id", "id"], "left_anti").join(vectors, "id").join(q, "query_id").select("query_id", "id", far.alias("d")).join(worst, "query_id").filter("d < worst")
        met = met.groupBy("query_id").agg(F.collect_list(F.struct("d", "id", F.lit(False).alias("done"))).alias("met"))
        after = best.join(met, "query_id", "left").select("query_id", F.slice(F.array_sort(F.concat(F.transform("best", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), F.lit(True).alias("done"))), F.coalesce("met", F.expr("cast(array() as array<struct<d: double, id: long, done: boolean>>)")))), 1, beam).alias("best"))
        best = materialise(after)
        if not best.filter(F.exists("best", lambda e: ~e["done"])).limit(1).count():
            break
    return best.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("pos", "e")).select("query_id", F.col("e.id").alias("id"), F.col("e.d").alias("d"), (F.col("pos") + 1).alias("rank"))


def near_pairs(graph: DataFrame, k: int, furthest: float) -> DataFrame:
    """Pairs (a, b, d), a < b, of which one is among the other's k nearest, at most `furthest` apart."""
    e = graph.select("id", F.explode(F.slice("near", 1, k)).alias("e")).filter(F.col("e.d") <= furthest)
    return e.select(F.least("id", "e.id").alias("a"), F.greatest("id", "e.id").alias("b"), F.col("e.d").alias("d")).distinct()
