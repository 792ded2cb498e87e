"""Resampling and verdicts over per-piece scores."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import md5


def verdict(lo: Column, hi: Column, margin: float = 0.01) -> Column:
    """Fixed order, strict comparisons: better, non-inferior, worse, no detectable difference."""
    return F.when(hi < 0, "better").when(hi < margin, "non-inferior").when(lo > 0, "worse").otherwise("no detectable difference")


#: P(N <= k) of a Poisson variable of mean 1, k = 0, 1, ...; a hash is a 32-bit number, which no more terms could tell apart.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12))
STEPS = tuple(math.floor(p * (1 << 32)) for p in POISSON)


def _drawn(units: DataFrame, sums: list[str], key: Column, replicates: int, by: list[str]) -> DataFrame:
    """(by, b, units, sums): the sums over each resample b, and over the units as they are at b = -1, with their number.

    Hashes are most of the work, some 500 a unit, so they are made by array operations, thousands of units at once.
    """
    from pyspark.sql import types as T

    held = units.select(*by, key.cast("string").alias("__k"), *(F.col(c).cast("double").alias(c) for c in sums))
    spark, k = units.sparkSession, len(sums)
    held = held.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))  # rows are small, their work is not
    schema = T.StructType([*held.schema.fields[: len(by)], T.StructField("b", T.IntegerType()), T.StructField("units", T.LongType()), *held.schema.fields[-k:]])
    blocks = (replicates - 1) // 4 + 1

    def hashed(keys):
        """For each block its number and the four words of all keys' hashes; those that are null, long or many-numbered one by one."""
        plain = np.array([x is not None and len(x.encode()) <= md5.MOST - 4 for x in keys], bool)
        rest = np.flatnonzero(~plain)
        short = [x.encode() for x, ok in zip(keys, plain) if ok]
        each = md5.numbered(short, range(min(blocks, 1000)))
        for c in range(blocks):
            out = np.empty((4, len(keys)), np.uint32)
            if c < 1000:
                out[:, plain] = next(each)[1]
            for j in rest if c < 1000 else range(len(keys)):
                out[:, j] = np.frombuffer(hashlib.md5((str(c) if keys[j] is None else f"{c}:{keys[j]}").encode()).digest(), "<u4")
            yield c, out.byteswap()  # hexadecimal digits begin with the lowest byte

    def run(batches):
        import pyarrow as pa

        tops, found = np.array(STEPS, np.uint32), {}
        for batch in batches:
            parts = -(-batch.num_rows // 8192)
            for lo, hi in ((i * batch.num_rows // parts, (i + 1) * batch.num_rows // parts) for i in range(parts)):
                b = batch.slice(lo, hi - lo)
                groups = list(zip(*(b.column(i).to_pylist() for i in range(len(by))))) or [()] * len(b)
                codes = {g: i for i, g in enumerate(dict.fromkeys(groups))}
                of = np.array([codes[g] for g in groups])
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], range(len(codes) + 1)).tolist()
                values = [b.column(len(by) + 1 + i) for i in range(k)]
                there = [np.asarray(v.is_valid()).astype(float) for v in values]
                v = np.array([*(np.asarray(x.fill_null(0.0)) for x in values), *there, np.ones(len(b))]).T[order]
                finite = np.isfinite(v).all()
                names = b.column(len(by)).to_pylist()
                stretches = [(found.setdefault(g, np.zeros((blocks * 4 + 1, 2 * k + 1))), x, y) for g, x, y in zip(codes, edges, edges[1:])]
                for acc, x, y in stretches:
                    acc[-1] += v[x:y].sum(0)
                for c, u in hashed([names[i] for i in order.tolist()]):
                    w = (u >= tops[0]).astype(float)
                    w += u >= tops[1]
                    high = u >= tops[2]
                    w[high] = np.searchsorted(tops, u[high], side="right")
                    for acc, x, y in stretches:
                        z = w[:, x:y]
                        acc[4 * c : 4 * c + 4] += z @ v[x:y] if finite else np.where(z[:, :, None] > 0, z[:, :, None] * v[None, x:y], 0).sum(1)
        for g, acc in found.items():
            at = [*(np.flatnonzero(acc[:replicates, -1] > 0)).tolist(), len(acc) - 1]
            acc = acc[at]
            number = pa.array([*at[:-1], -1], pa.int32())
            out = [pa.array(acc[:, i], mask=acc[:, k + i] == 0) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(at), batch.schema.field(i).type) for i, x in enumerate(g)), number, pa.array(acc[:, -1].astype(np.int64)), *out], schema.names)

    return held.mapInArrow(run, schema).groupBy(*by, "b").agg(F.sum("units").alias("units"), *(F.sum(c).alias(c) for c in sums))


def resampled(units: DataFrame, sums: list[str], key: Column, replicates: int, by: list[str] | None = None) -> DataFrame:
    """(by, b, sums): the sums over each of so many resamples of the units, without a join or a global order.

    In a resample each unit counts a Poisson(1) number of times (the large-table form of drawing with replacement), told by the md5 of key
    and replicate, so any engine gives the same. key must differ between units. Units should be sums by cluster already, for
    the work, though not the shuffle, grows with units times replicates: each task hands on one row a replicate and group.
    """
    whole = {f.name for f in units.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    r = _drawn(units, sums, key, replicates, by or []).where("b >= 0")
    return r.select(*(by or []), "b", *(F.col(c).cast("bigint").alias(c) if c in whole else F.col(c) for c in sums))


def intervals(units: DataFrame, top: str, bottom: str, key: Column, replicates: int, by: list[str] | None = None) -> DataFrame:
    """(by, estimate, units, lo, hi): sum(top) / sum(bottom) and its 95 % percentile interval over resampled units, in one pass over them."""
    by = by or []
    r = _drawn(units, [top, bottom], key, replicates, by)
    whole, drawn = F.col("b") == -1, (F.col("b") >= 0) & (F.col(bottom) != 0)
    ratio = F.when(drawn, F.col(top) / F.col(bottom))
    out = r.groupBy(*by).agg((F.max(F.when(whole, F.col(top))) / F.max(F.when(whole, F.col(bottom)))).alias("estimate"), F.coalesce(F.max(F.when(whole, F.col("units"))), F.lit(0)).alias("units"), F.percentile(ratio, F.lit(0.025)).alias("lo"), F.percentile(ratio, F.lit(0.975)).alias("hi"))
    return out.where("lo is not null") if by else out


def clusters(pieces: DataFrame, doc: str, piece: str, size: str, closes: int = 1900, truth: DataFrame | None = None) -> DataFrame:
    """pieces with cluster_id within their document: of a truth table (doc, piece, size, cluster_id) where all its sizes agree with the
    document's, else by length: a piece shorter than `closes` bytes ends its cluster.
    """
    w = Window.partitionBy(doc).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.withColumn("cluster_id", F.coalesce(F.sum((F.col(size) < closes).cast("bigint")).over(w), F.lit(0)))
    if truth is None:
        return out
    t = truth.select(F.col(doc).alias("__d"), F.col(piece).alias("__p"), F.col(size).alias("__s"), F.col("cluster_id").alias("__c"))
    met = out.join(t, (F.col(doc) == F.col("__d")) & (F.col(piece) == F.col("__p")), "left")
    whole = F.bool_and(F.coalesce(F.col("__s") == F.col(size), F.lit(False))).over(Window.partitionBy(doc))
    return met.withColumn("cluster_id", F.when(whole, F.col("__c")).otherwise(F.col("cluster_id"))).drop("__d", "__p", "__s", "__c")


def compare(pieces: DataFrame, a: str, b: str, size: str, piece: Column, cluster: list[str], replicates: int = 2000, by: list[str] | None = None) -> DataFrame:
    """Difference of two arms' scores per byte, (sum a - sum b) / sum size, with the interval over pieces, that over clusters, their
    widths' ratio and both numbers of units.
    """
    by = by or []
    d = pieces.withColumn("__d", (F.col(a) - F.col(b)).cast("double"))
    c = d.groupBy(*by, *cluster).agg(F.sum("__d").alias("__d"), F.sum(size).alias(size))
    one = intervals(d, "__d", size, piece, replicates, by).select(*by, "estimate", F.col("units").alias("pieces"), F.col("lo").alias("piece_lo"), F.col("hi").alias("piece_hi"))
    two = intervals(c, "__d", size, F.concat_ws("/", *(F.col(x).cast("string") for x in cluster)), replicates, by).select(*(F.col(x).alias(f"__{x}") for x in by), F.col("units").alias("clusters"), "lo", "hi")
    if by:
        on = F.lit(True)
        for x in by:
            on = on & F.col(x).eqNullSafe(F.col(f"__{x}"))
        met = one.join(two, on).drop(*(f"__{x}" for x in by))
    else:
        met = one.crossJoin(two)
    return met.withColumn("width_ratio", (F.col("hi") - F.col("lo")) / (F.col("piece_hi") - F.col("piece_lo")))


def bootstrap_ratio(units: DataFrame, top: str, bottom: str, order: str, replicates: int) -> DataFrame:
    """One row: point estimate of sum(top) / sum(bottom) and its 95 % percentile interval over resampled units."""
    return intervals(units, top, bottom, F.col(order), replicates)


def bootstrap_exact(df: DataFrame, key: str, top: str, bottom: str, order: str, replicates: int = 2000, seed: int = 0, chunk: int = 64) -> DataFrame:
    """The same by group with numpy's PCG64 draws, for parity with published protocols. A group's units are one task's, and a chunk of
    replicates draws chunk times their number; so units should be clusters, some millions a group at most. Beyond that, and for one group that holds
    a large share of all, use intervals."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        a, b, n = pdf[top].to_numpy(float), pdf[bottom].to_numpy(float), len(pdf)
        rng, out = np.random.default_rng(seed), []
        for lo in range(0, replicates, chunk):
            at = rng.integers(0, n, (min(chunk, replicates - lo), n))
            out.append(a[at].sum(1) / b[at].sum(1))
        r = np.concatenate(out)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "estimate": [a.sum() / b.sum()], "lo": [np.percentile(r, 2.5)], "hi": [np.percentile(r, 97.5)], "units": [n]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(one, f"{key} {kind}, estimate double, lo double, hi double, units bigint")


def mid_ranks(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with the mean rank of col among all rows, equal values sharing theirs and nulls last: counts of values are prefix-summed, and joined back."""
    counts = df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("__v", (before + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(col).eqNullSafe(F.col("__v"))).drop("__v")


def units_inside(spans: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """spans (key, a, b) with units: one more than the boundaries (key, off) strictly inside."""
    s, t = spans.withColumn("__s", F.struct("a", "b")).alias("s"), boundaries.alias("t")
    met = s.join(t, (F.col(f"s.{key}") == F.col(f"t.{key}")) & (F.col("s.a") < F.col("t.off")) & (F.col("t.off") < F.col("s.b")), "left")
    return met.groupBy(F.col(f"s.{key}").alias(key), F.col("s.a").alias("a"), F.col("s.b").alias("b")).agg((F.count("t.off") + 1).alias("units"))
