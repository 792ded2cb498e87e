"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at 3 or fewer differing bits, so in one of the two 32-bit halves they differ in
at most one. Over a half, the anchors are a covering code: a direct sum of perfect codes (Golay: 23 bits, radius 3; Hamming: 31 or 7 bits,
radius 1) and free bits (radius 0). Perfect codes give every half exactly one home anchor
within the covering radius, found from the syndrome. A half is replicated to every anchor within covering radius plus one
(counted part by part, which keeps only anchors that can be the home of a half one bit away), and at
each anchor the homes are compared with the replicas on all 64 bits. No link can be missed.

The code is chosen by the number of distinct fingerprints, so that anchors are at least as many (2^18, 2^21, 2^27 or, all bits free, 2^32 anchors a
half): an anchor is home to about one fingerprint, replicas are at most 33 a half, and comparisons grow with the
table, not with its square (beyond 2^32 fingerprints by one 2^32th of it).

Equal fingerprints are one row before anything is compared, so copies cost nothing here. A dense group of near copies would
still give all its pairs; so links to one pivot of each anchor are resolved into components first, and only
fingerprints that are not yet in one component are compared.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import materialize, read, small_batches, text_bytes
from glyphstream.llm.components import connected_components

GOLAY = 23, 0b101011100011, 3  # bits, generator polynomial and radius of the [23,12] code, fixed values
HAMMING7 = 7, 0b1011, 1  # of the [7,4] code
HAMMING31 = 31, 0b100101, 1  # of the [31,26] code
#: Parts of a 32-bit half by falling covering radius; the bits that are left are free.
COVERS = ((GOLAY, HAMMING7), (GOLAY,), (HAMMING31,), ())


def fingerprint(raw: bytes, n: int = 3, chunk: int = 65_536) -> int:
    """64-bit SimHash of the n-word shingles of UTF-8 text (A-Z lower-cased): a bit is set if over half the hashes have it."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= n:
        spans = [(0, len(line))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = list(zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()))
    h64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(spans), chunk):
        h = np.array([h64(line[a:b], 42) for a, b in spans[lo : lo + chunk]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, fp bigint, the fingerprint's bits); null texts have fingerprint zero."""

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(x, n) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_bytes().alias("raw"))
    return rows.mapInArrow(hashed, "doc_id bigint, text_hash bigint, fp bigint")


def _remainders(bits: int, poly: int) -> np.ndarray:
    """Syndrome of each single-bit word of a cyclic code."""
    deg, out = poly.bit_length() - 1, []
    for k in range(bits):
        v = 1 << k
        while v.bit_length() > deg:
            v ^= poly << (v.bit_length() - deg - 1)
        out.append(v)
    return np.array(out, np.int64)


class Code:
    """A perfect cyclic code: for each syndrome the error within the radius, and those one beyond it."""

    def __init__(self, bits: int, poly: int, radius: int):
        self.bits, self.single = bits, _remainders(bits, poly)
        size = 1 << (poly.bit_length() - 1)
        self.near, beyond = np.zeros(size, np.int64), [[] for _ in range(size)]
        for weight in range(radius + 2):
            for at in itertools.combinations(range(bits), weight):
                s = int(np.bitwise_xor.reduce(self.single[list(at)])) if at else 0
                e = sum(1 << k for k in at)
                if weight <= radius:
                    self.near[s] = e
                else:
                    beyond[s].append(e)
        self.far = np.full((size, max(map(len, beyond))), -1, np.int64)
        for s, es in enumerate(beyond):
            self.far[s, : len(es)] = es

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(x.shape, np.int64)
        for k in range(self.bits):
            s ^= np.where(x >> k & 1, self.single[k], 0)
        return s


def anchor_bits(cover: tuple) -> int:
    """Binary logarithm of the number of anchors of one half."""
    return 32 - sum(poly.bit_length() - 1 for _, poly, _ in cover)


def cover_for(n: int) -> tuple:
    """The cover with the fewest anchors, and so the fewest replicas, that has at least one anchor for each of n fingerprints."""
    return next((c for c in COVERS if n <= 1 << anchor_bits(c)), COVERS[-1])


def anchors(fp: np.ndarray, cover: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fp, anchor, is home) for signed 64-bit fingerprints; an anchor is half and 32-bit code word."""
    codes = [Code(*part) for part in cover]
    rows, keys, home = [], [], []
    for half in (0, 1):
        x = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
        at, word, found = 0, x.copy(), []
        for code in codes:
            part = x >> at & (1 << code.bits) - 1
            s = code.syndrome(part)
            word ^= code.near[s] << at
            found.append((at, part, s, code))
            at += code.bits

        def put(words, ok=None, first=False, half=half):
            ok = np.ones(len(words), bool) if ok is None else ok
            rows.append(np.flatnonzero(ok))
            keys.append((half << 32 | words)[ok])
            home.append(np.full(int(ok.sum()), first))

        put(word, first=True)
        for bit in range(at, 32):
            put(word ^ 1 << bit)
        for low, part, s, code in found:
            rest = word & ~((1 << code.bits) - 1 << low)
            for k in range(code.far.shape[1]):
                e = code.far[s, k]
                put(rest | (part ^ e) << low, e >= 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def links(spark: SparkSession, fps: DataFrame, within: int = 3) -> DataFrame:
    """Distinct fp bigint -> links (u, v) whose components are those of all pairs at `within` (3 at most) differing bits."""
    assert within <= 3, "two halves and radius plus one guarantee three differing bits"
    cover = cover_for(fps.count())

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.asarray(b.column(0))
            at, key, home = anchors(fp, cover)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(home)], ["anchor", "fp", "home"])

    placed = materialize(spark, fps.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean"), "anchors")
    homes, close = placed.where("home").select("anchor", F.col("fp").alias("u")), f"bit_count(u ^ v) <= {within}"
    pivots = homes.groupBy("anchor").agg(F.min("u").alias("u"))
    replicas = placed.select("anchor", F.col("fp").alias("v"))
    first = materialize(spark, replicas.join(pivots, "anchor").where(f"u <> v and {close}").select("u", "v"), "pivot-links")
    label = connected_components(spark, first)
    named = lambda df, x, c: df.join(label.select(F.col("node").alias(x), F.col("component").alias(c)), x, "left").withColumn(c, F.coalesce(c, x))
    left, right = named(homes, "u", "cu"), named(replicas, "v", "cv")
    second = left.join(right, (left.anchor == right.anchor) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & F.expr(close))
    return first.union(second.select("u", "v"))


def near_duplicates(spark: SparkSession, docs: DataFrame, within: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for each row of docs; component_id is the smallest doc_id that links reach,
    component one fingerprint that names the component where ids do not, and text_hash is xxhash64 of the text.

    Null and word-less texts have fingerprint zero and link like any other. A null doc_id is never a component_id unless the
    component has no other. Repeated rows stay repeated. An empty table gives no rows.
    """
    small_batches(spark)
    held = materialize(spark, fingerprints(docs), "fingerprints")
    groups = held.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(spark, links(spark, groups.select("fp"), within))
    named = groups.join(comp, groups.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    low = named.groupBy("c").agg(F.min("first").alias("component_id"))
    return held.join(named.join(low, "c").select("fp", F.col("c").alias("component"), "component_id"), "fp")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
