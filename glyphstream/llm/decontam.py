"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

For each benchmark item, the windows of a document that have the item's number of words are fingerprinted (64-bit SimHash over five-word
shingles). Fingerprints are cut into BLOCKS blocks; two within the radius differ by at most radius // BLOCKS bits in one block
at least, so items are listed under every value that close to a block of theirs, and no item within the radius is missed. At
radius 14 and five blocks an unrelated item is a candidate of about one window in 20. Of pairs near the threshold (similarity 0.80 to
0.82, items of 50 to 300 words) 97 to 99 % are within the radius, of those at 0.90 all that were tried (400 each). Each candidate is then
held to the exact weighted Jaccard similarity of the two bags of shingles, 0.8 or more.
Words that the benchmark lacks are told apart by a 64-bit hash. For the pairs beyond the radius there is an exact way: a window that holds
as many of an item's shingles as the similarity takes is a candidate as well, so no pair is missed.

A window that has no shingle of an item has similarity zero with it; so windows are fingerprinted only where a document
has a benchmark shingle, which leaves every pair that can pass and most text untouched.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import read, small_batches

WORD = re.compile(r"\w+")
MULT = np.uint64(0x100000001B3)
BLOCKS = 5
PAIRS = "doc_id bigint, text_hash bigint, item_id bigint, similarity double, word_start bigint, n_words bigint"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word ids (of the whole sequence if it is shorter)."""
    k = min(n, len(ids))
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i].astype(np.uint64)) * MULT + np.uint64(1)
    return _mix(h)


def _own_id(word: str) -> int:
    """Id of a word that the benchmark lacks: a hash below zero, where no id of its vocabulary lies."""
    import xxhash

    return (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1 << 63) - (1 << 64)


def _blocks(radius: int) -> list[tuple[int, int, np.ndarray]]:
    """(shift, mask, all differences of at most radius // BLOCKS bits) of each block of a fingerprint."""
    out, bounds = [], np.linspace(0, 64, BLOCKS + 1).astype(int)
    for a, b in zip(bounds, bounds[1:]):
        values = np.arange(1 << int(b - a), dtype=np.uint64)
        out.append((int(a), (1 << int(b - a)) - 1, values[np.bitwise_count(values) <= radius // BLOCKS]))
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags: sum of minima over sum of maxima."""
    low = sum(min(v, b[k]) for k, v in a.items() if k in b)
    both = sum(a.values()) + sum(b.values()) - low
    return low / both if both else 0.0


class Index:
    """Items of one block of the benchmark, ready to meet whole documents."""

    def __init__(self, items: list[tuple[int, str]], n: int, radius: int, least: float):
        self.n, self.radius, self.least, self.vocab = n, radius, least, {}
        self.items, self.by_shingle, self.blocks = [], {}, _blocks(radius)
        self.windows = self.candidates = self.near = 0  # windows met, pairs from the blocks, pairs within the radius
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            h = _shingle_hashes(np.array(ids, np.int64), n)
            k = len(self.items)
            fp = int(self._fp(self._bits(h).sum(axis=0, keepdims=True))[0])
            self.items.append((item_id, len(ids), self._bag(ids), Counter(h.tolist()), fp))
            for x in self.items[k][3]:
                self.by_shingle.setdefault(x, []).append(k)
        self.known = np.array(sorted(self.by_shingle), np.uint64)
        self.shortest = min((x[1] for x in self.items), default=0)
        self.fps = np.array([x[4] for x in self.items], np.uint64)
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # length -> for each block values in order and their items
        for m in {x[1] for x in self.items}:
            at = np.array([k for k, x in enumerate(self.items) if x[1] == m])
            self.lists[m] = []
            for shift, mask, near in self.blocks:
                values = ((self.fps[at] >> np.uint64(shift) & np.uint64(mask))[:, None] ^ near).ravel()
                order = np.argsort(values, kind="stable")
                self.lists[m].append((values[order], np.repeat(at, len(near))[order]))

    def _bag(self, ids: list[int]) -> Counter:
        k = min(self.n, len(ids))
        return Counter(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1))

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1

    @staticmethod
    def _fp(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item that a whole text contains."""
        if not text or not self.items:
            return []
        get, words = self.vocab.get, WORD.findall(text.lower())
        ids = np.array([get(w, 0) for w in words], np.int64)
        if not len(ids):
            return []
        out: dict[int, tuple[float, int, int]] = {}
        for n in {min(self.n, x[1]) for x in self.items} if self.shortest < self.n else {self.n}:
            self._scan(words, ids, min(n, len(ids)), n, out)
        return [(self.items[k][0], *best) for k, best in sorted(out.items())]

    def _scan(self, words: list[str], ids: np.ndarray, k: int, n: int, out: dict) -> None:
        run = np.concatenate([[0], np.cumsum(ids > 0)])
        whole = np.flatnonzero(run[k:] - run[:-k] == k)  # shingles all of whose words the benchmark has
        if not len(whole):
            return
        h = self._at(ids, whole, k)
        near = np.searchsorted(self.known, h)
        near[near == len(self.known)] = 0
        hit = self.known[near] == h
        wanted: dict[int, dict[int, dict[int, list[int]]]] = {}  # length -> item -> shingle -> where it is
        for p, x in zip(whole[hit].tolist(), h[hit].tolist()):
            for item in self.by_shingle[x]:
                m = self.items[item][1]
                if min(self.n, m) == n:
                    wanted.setdefault(m, {}).setdefault(item, {}).setdefault(x, []).append(p)
        if wanted:
            for j in np.flatnonzero(ids == 0).tolist():
                ids[j] = _own_id(words[j])
        for m, hits in wanted.items():
            size = min(m, len(ids))
            at = {p for found in hits.values() for ps in found.values() for p in ps}
            starts = sorted({s for p in at for s in range(max(0, p - size + k), min(p, len(ids) - size) + 1)})
            self._windows(ids, k, m, size, np.array(starts, np.int64), hits, out)

    def _shared(self, item: int, found: dict[int, list[int]], starts: np.ndarray, reach: int, capped: bool = True) -> np.ndarray:
        """How many shingles windows share with an item: each as often as both have it, or (capped false) as the window has it."""
        total = np.zeros(len(starts), np.int64)
        for x, at in found.items():
            inside = np.searchsorted(at, starts + reach, "right") - np.searchsorted(at, starts)
            total += np.minimum(inside, self.items[item][3][x]) if capped else inside
        return total

    @staticmethod
    def _at(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = (h ^ ids[at + i].astype(np.uint64)) * MULT + np.uint64(1)
        return _mix(h)

    def _near(self, m: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of items of m words within the radius, by the blocks' lists."""
        rows, items = [], []
        for (shift, mask, _), (values, listed) in zip(self.blocks, self.lists[m]):
            key = fps >> np.uint64(shift) & np.uint64(mask)
            first = np.searchsorted(values, key)
            count = np.searchsorted(values, key, "right") - first
            row = np.repeat(np.arange(len(fps)), count)
            rows.append(row)
            items.append(listed[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)])
        pair = np.unique(np.concatenate(rows) * len(self.items) + np.concatenate(items))
        row, item = np.divmod(pair, len(self.items))
        close = np.bitwise_count(fps[row] ^ self.fps[item]) <= self.radius
        self.windows, self.candidates, self.near = self.windows + len(fps), self.candidates + len(pair), self.near + int(close.sum())
        return row[close], item[close]

    def _windows(self, ids: np.ndarray, k: int, m: int, size: int, starts: np.ndarray, hits: dict, out: dict) -> None:
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            first, last = int(part[0]), int(part[-1]) + size
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(self._bits(_shingle_hashes(ids[first:last], k)), axis=0, dtype=np.int32)])
            row, item = self._near(m, self._fp(sums[part - first + size - k + 1] - sums[part - first]))
            for x, found in hits.items():  # an item without a shingle here has similarity zero
                bags = size - k + 1 + sum(self.items[x][3].values())
                enough = self._shared(x, found, part, size - k, capped=False) >= self.least * bags / (1 + self.least) - 1e-9
                enough[row[item == x]] = True
                at = part[enough]
                low = self._shared(x, found, at, size - k)
                sims = low / (bags - low)
                for j in np.flatnonzero(sims >= self.least - 1e-9).tolist() if len(at) else ():
                    if sims[j] > out.get(x, (0.0,))[0] + 1e-12:  # held to words, not their hashes
                        sim = similarity(self._bag(ids[at[j] : at[j] + size].tolist()), self.items[x][2])
                        if sim >= self.least and sim > out.get(x, (0.0,))[0]:
                            out[x] = (sim, int(at[j]), size)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = 14, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, word_start, n_words): for each row of docs the items it contains, with their best
    window; text_hash is xxhash64 of the text, which tells rows apart whose ids are null or equal.

    Words are maximal runs of word characters, lower-cased. Items of fewer than n words are one shingle. The benchmark's size is
    summed first; it goes to the workers in blocks of at most block_bytes of text each (one larger item is a block alone),
    and every block meets all documents. Null and empty texts on either side match nothing; repeated items and
    documents match each for itself. A null item_id is kept as null.
    """
    small_batches(spark)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    found = None
    for part in range(parts):
        mine = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else benchmark
        items = [(r[0], r[1]) for r in mine.select(F.col("item_id").cast("bigint"), "text").where("text is not null").collect()]
        held = spark.sparkContext.broadcast(sorted(items, key=lambda x: (x[1], x[0] is None, x[0] or 0)))

        def match(batches, held=held):
            import pyarrow as pa

            index = Index(held.value, n, radius, least)
            schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("word_start", pa.int64()), ("n_words", pa.int64())])
            for b in batches:
                rows = [(d, h, *m) for d, h, t in zip(*(c.to_pylist() for c in b.columns)) for m in index.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        got = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text").mapInArrow(match, PAIRS)
        found = got if found is None else found.union(got)
    return found


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")
