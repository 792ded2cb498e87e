"""Nearest neighbours by cosine with vantage-point trees.

Vectors become unit vectors, whose chord length orders as cosine does. A small vantage-point tree over a bounded sample (`sample_rows`)
cuts space into shards: its thresholds, not the sample, say which side any vector is on, so every vector is indexed and the triangle inequality
bounds from below how near a shard can be. Each shard builds a tree of its own. A query first searches its home shard, which tells how
far its k-th best is, and then only the shards that may hold something nearer. Bounds are relaxed by `factor`: a shard or subtree is skipped if its
bound is above the k-th best divided by factor, so factor 1 is exact and larger ones skip more.

A shard meets its queries in blocks of about `block_rows`, so copies of vectors are at most shard_rows / block_rows for each visit of
a query to a shard; shards without queries are not moved. A shard that outgrows twice shard_rows (very many vectors at one distance)
is dealt into parts by a hash. Equal vectors are one point that carries the smallest k + 1 of their rows' ids,
so a vector with very many copies costs no more than one, and ties still go to the smallest id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.llm.common import materialize, read

HITS = "q bigint, query_id bigint, vec_id bigint, score double, dist double"
EPS = 1e-6  # chords come from dot products, which near zero are exact to about 1e-8


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first, so that no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of a and of b, unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def vantage_of(points: np.ndarray) -> int:
    """The point farthest from the first: it separates clusters well, and needs no random choice."""
    return int(np.argmin(points @ points[0]))


class Router:
    """Vantage points and thresholds that deal all of space into shards, fitted to a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, shards: int, first: int = 0):
        self.nodes: list = []  # (vantage, threshold, inner, outer) or the shard's number
        self.shards = 0
        self.first = first
        self._grow(sample, shards)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if shards > 1 and len(points) > 1:
            at = points[vantage_of(points)]
            d = chords(points, at[None])[:, 0]
            cut = float(np.median(d))
            inner = d <= cut
            if 0 < inner.sum() < len(points):
                left = shards // 2
                self.nodes[me] = (at, cut, self._grow(points[inner], shards - left), self._grow(points[~inner], left))
                return me
        self.nodes[me] = self.first + self.shards
        self.shards += 1
        return me

    def home(self, u: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(u), np.int64), [(0, np.arange(len(u)))]
        while stack:
            node, rows = stack.pop()
            n = self.nodes[node]
            if isinstance(n, int):
                out[rows] = n
            elif len(rows):
                inner = chords(u[rows], n[0][None])[:, 0] <= n[1]
                stack += [(n[2], rows[inner]), (n[3], rows[~inner])]
        return out

    def within(self, u: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for each shard that may hold a point no farther than the row's `far`."""
        rows_out, shards_out, stack = [], [], [(0, np.arange(len(u)))]
        while stack:
            node, rows = stack.pop()
            n = self.nodes[node]
            if isinstance(n, int):
                rows_out.append(rows)
                shards_out.append(np.full(len(rows), n))
            elif len(rows):
                over = chords(u[rows], n[0][None])[:, 0] - n[1]
                stack += [(n[2], rows[over <= far[rows] + EPS]), (n[3], rows[-over <= far[rows] + EPS])]
        return np.concatenate(rows_out), np.concatenate(shards_out)


class VPTree:
    """Flat vantage-point tree over unit vectors; leaves hold up to `leaf` points. Many queries go down together."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.nodes = points, []
        stack = [(np.arange(len(points)), None, 0)]
        while stack:
            at, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if len(at) <= leaf:
                self.nodes.append((at,))
                continue
            far = vantage_of(points[at])
            vantage, rest = at[far], np.delete(at, far)
            d = chords(points[rest], points[vantage][None])[:, 0]
            order = np.argsort(d, kind="stable")
            inner, outer = order[: len(order) // 2], order[len(order) // 2 :]
            self.nodes.append([np.array([vantage]), (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max()), None, None])
            stack += [(rest[outer], me, 3), (rest[inner], me, 2)]
        self.compared = 0  # distances taken, a measure of what pruning leaves

    def near(self, u: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(row of u, point) pairs that hold each row's nearest k points and all that tie with the last; exact for factor 1."""
        top, found = np.full((len(u), k), np.inf), []

        def meet(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            d = chords(u[rows], self.points[at])
            self.compared += d.size
            top[rows] = np.partition(np.concatenate([top[rows], d], axis=1), k - 1, axis=1)[:, :k]
            r, c = np.nonzero(d <= top[rows].max(axis=1)[:, None] + EPS)
            found.append((rows[r], at[c], d[r, c]))
            return d

        def sides(n, d: np.ndarray):
            lo_in, hi_in, lo_out, hi_out = n[1]
            return np.maximum(lo_in - d, d - hi_in), np.maximum(lo_out - d, d - hi_out)

        stack = [(0, np.arange(len(u)))]
        while stack:  # each row to its home leaf alone, for a first k-th best
            node, rows = stack.pop()
            n = self.nodes[node]
            if not len(rows):
                continue
            if len(n) == 1:
                if len(n[0]):
                    d = chords(u[rows], self.points[n[0]])
                    top[rows] = np.partition(np.concatenate([np.full((len(rows), k), np.inf), d], axis=1), k - 1, axis=1)[:, :k]
            else:
                inner, outer = sides(n, chords(u[rows], self.points[n[0]])[:, 0])
                stack += [(n[2], rows[inner <= outer]), (n[3], rows[inner > outer])]
        bound = top.max(axis=1)
        top[:] = np.inf
        stack = [(0, np.arange(len(u)), np.zeros(len(u)))]
        while stack:
            node, rows, low = stack.pop()
            best = np.minimum(bound[rows], top[rows].max(axis=1))
            keep = low <= best / factor + EPS
            rows, n = rows[keep], self.nodes[node]
            if not len(rows) or not len(n[0]):
                continue
            d = meet(rows, n[0])
            if len(n) > 1:
                inner, outer = sides(n, d[:, 0])
                stack += [(n[3], rows, outer), (n[2], rows, inner)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row, at, d = (np.concatenate(x) for x in zip(*found))
        ok = d <= top.max(axis=1)[row] + EPS
        return row[ok], at[ok]


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, each row on its own so that equal rows get equal values."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows with an id whose vector is not null, not zero and has only finite components."""
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(vec).isNotNull() & F.coalesce(fits, F.lit(False)) & F.exists(vec, lambda x: x != 0))


def _routers(distinct: DataFrame, shard_rows: int, sample_rows: int) -> dict[int, Router]:
    """A router for each dimension, its shards numbered on from the last one's."""
    out, first = {}, 0
    for r in sorted(distinct.groupBy(F.size("v").alias("dim")).count().collect()):
        shards, sample = -(-r["count"] // shard_rows), np.empty((0, r.dim))
        if shards > 1:
            share = min(1.0, sample_rows / r["count"])
            drawn = distinct.where((F.size("v") == r.dim) & (F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v").toPandas().v
            sample = unit(np.stack(drawn.to_list()).astype(float)) if len(drawn) else sample
            shards = min(shards, max(1, len(sample) // 4))
        out[r.dim] = Router(sample, shards, first)
        first += out[r.dim].shards
    return out


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 16_384, block_rows: int = 8_192, sample_rows: int = 16_384) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> (query_id, rank, vec_id, score): each query row's k nearest other rows.

    Ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take no part on either side, nor do
    null ids; a query meets only vectors of its own dimension. Every row counts: rows that share an id, or repeat, are candidates
    each, and a query leaves out one row of its own id and vector. Repeated query rows are answered each. Fewer candidates
    than k give fewer rows; empty tables give none. Other columns are not read.
    """
    as_point = lambda df, name: usable(df, "embedding").where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias(name), F.col("embedding").cast("array<double>").alias("v"))
    # a limit by rank is applied before the shuffle too, so copies of one vector do not meet in one task
    first = as_point(vectors, "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = materialize(spark, first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = materialize(spark, as_point(queries, "query_id").groupBy("query_id", "v").agg(F.count("*").cast("int").alias("copies")), "queries").withColumn("q", F.monotonically_increasing_id())
    routers = _routers(distinct, shard_rows, sample_rows)
    held = spark.sparkContext.broadcast(routers)  # at most sample_rows / 4 vantage points a dimension

    def by_dim(v):
        dims = np.array([len(x) for x in v])
        for dim in set(dims.tolist()) & set(held.value):
            at = np.flatnonzero(dims == dim)
            yield held.value[dim], at, unit(np.stack([v[i] for i in at]).astype(float))

    def place(frames):
        for f in frames:
            shard = np.full(len(f), -1, np.int64)
            for router, at, u in by_dim(f.v.to_list()):
                shard[at] = router.home(u)
            yield f.assign(shard=shard)[["shard", "v", "ids"]]

    def route(frames):
        for f in frames:
            far = f.far.to_numpy(float)
            for router, at, u in by_dim(f.v.to_list()):
                home, mine = router.home(u), far[at]
                if "seen" not in f:
                    yield f.iloc[at].assign(shard=home)[["shard", "q", "query_id", "v"]]
                else:
                    row, shard = router.within(u, mine / factor)
                    new = shard != home[row]
                    yield f.iloc[at[row[new]]].assign(shard=shard[new])[["shard", "q", "query_id", "v"]]

    def search(rows, qs):
        import pandas as pd

        out = []
        if len(rows) and len(qs):  # a shard is of one dimension
            m, q, ids = np.stack(rows.v.to_list()).astype(float), np.stack(qs.v.to_list()).astype(float), rows.ids.to_list()
            tree, names, own = VPTree(unit(m)), qs.q.to_numpy(), qs.query_id.to_numpy()
            for lo in range(0, len(q), 1024):
                u = unit(q[lo : lo + 1024])
                row, at = tree.near(u, k + 1, factor)
                row, s, same = row + lo, cosines(q[row + lo], m[at]), (q[row + lo] == m[at]).all(axis=1)
                order = np.lexsort((-s, row))
                hits: dict[int, list] = {}
                for r, a, x, me in zip(row[order].tolist(), at[order].tolist(), s[order].tolist(), same[order].tolist()):
                    others = list(ids[a])
                    if me and own[r] in others:
                        others.remove(own[r])
                    hits.setdefault(r, []).extend((-x, i, a) for i in others)
                for r, found in hits.items():
                    for x, i, a in sorted(found)[:k]:
                        out.append((names[r], own[r], i, -x, float(np.sqrt(((u[r - lo] - tree.points[a]) ** 2).sum()))))
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score", "dist"])

    placed = distinct.mapInPandas(place, "shard bigint, v array<double>, ids array<bigint>").where("shard >= 0")
    parts = materialize(spark, placed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts")), "shards")

    def visit(routed: DataFrame) -> DataFrame:
        routed = materialize(spark, routed, "routed")
        plan = routed.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).join(parts, "shard")
        deal = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # one row a shard
        left = placed.join(F.broadcast(plan), "shard").withColumn("part", deal("v", "parts")).withColumn("block", every("blocks"))
        right = routed.join(F.broadcast(plan), "shard").withColumn("block", deal("q", "blocks")).withColumn("part", every("parts"))
        return left.select("shard", "part", "block", "v", "ids").groupBy("shard", "part", "block").cogroup(right.select("shard", "part", "block", "q", "query_id", "v").groupBy("shard", "part", "block")).applyInPandas(search, HITS)

    kind = "shard bigint, q bigint, query_id bigint, v array<double>"
    near = materialize(spark, visit(asked.select("q", "query_id", "v", F.lit(0.0).alias("far")).mapInPandas(route, kind)), "home-hits")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("dist"))).where(F.col("n") == k).select("q", F.col("dist").alias("far"))
    again = asked.join(best, "q", "left").select("q", "query_id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"), F.lit(True).alias("seen"))
    hits = near.union(visit(again.mapInPandas(route, kind)))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    copies = asked.where("copies > 1").select("q", "copies")
    each = ranked.join(copies, "q", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return each.select("query_id", "rank", "vec_id", "score")


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, vectors, vectors.where("vec_id % 50 = 0"))
