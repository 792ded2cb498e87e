"""Sequence packing by bin completion.

A document's ids are cut only where they exceed the capacity. Lengths are at most the capacity, so the whole problem is a histogram
with that many entries, however many documents there are; it is solved on the driver as patterns (which lengths share a
sequence, how often), and the patterns go back as a table of that order. Each piece finds its place by its rank among the pieces
of its length; ranks are local counts in the tokenizing tasks plus prefix sums over tasks, so no task sees all pieces of a length.

The solver completes bins around the largest remaining length. Largest-first greedy gives the first incumbent, greedy descents that take
the second to fourth filling in one bin better ones (at most `nodes` fillings). If they stay above the lower bound, a depth-first
search branches over all undominated fillings of the largest length and over how often each is used; branches whose
waste shows that they can't beat the incumbent are cut. It ends at the lower bound, with the tree exhausted (the incumbent is
then optimal), or after `nodes` fillings, where a bin with many lengths to choose from counts as more; nodes=None searches to the end.
"""

from __future__ import annotations

import functools
import math
import os
import re
from bisect import bisect_right
from collections import Counter
from itertools import chain, islice

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.llm.common import materialize, read, small_batches, text_bytes
from glyphstream.operators.tokens import byte_of_letter

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), bins


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """The larger of total over capacity and the bound by lengths above half the capacity (for every cut-off)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // cap)
    desc = sorted(counts.items(), reverse=True)
    for alpha in {0, *(s for s in counts if 2 * s <= cap)}:
        big = sum(n for s, n in desc if s > cap - alpha)
        mid = [(s, n) for s, n in desc if cap - alpha >= s > cap / 2]
        room = sum((cap - s) * n for s, n in mid)
        low = sum(s * n for s, n in desc if cap / 2 >= s >= alpha)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(low - room) // cap)))
    return best


class _Solver:
    def __init__(self, counts: dict[int, int], cap: int, nodes: float):
        self.cap, self.nodes, self.bound = cap, nodes, lower_bound(counts, cap)
        self.total = sum(s * n for s, n in counts.items())
        self.counts, self.budget = counts, nodes

    @staticmethod
    def _below(sizes: list[int], top: int) -> int:
        """Largest size at most top, 0 if there is none; sizes ascend."""
        k = bisect_right(sizes, top)
        return sizes[k - 1] if k else 0

    def fillings(self, sizes: list[int], left: dict[int, int], room: int, wide: int) -> list[tuple[int, ...]]:
        """Greedy fillings of room for the descents: a first item (of at most `wide`) completed by the largest that fit; least waste first."""
        found: dict[tuple[int, ...], None] = {}

        def complete(items: list[int], rest: int) -> None:
            used = Counter(items)
            while rest > 0:
                s = self._below(sizes, rest)
                while s and used[s] >= left.get(s, 0):
                    s = self._below(sizes, s - 1)
                if not s:
                    break
                items.append(s)
                used[s] += 1
                rest -= s
            found[tuple(sorted(items, reverse=True))] = None

        s, tried = self._below(sizes, room), 0
        while s and tried < wide:
            complete([s], room - s)
            rest = room - s
            if rest and s <= rest and (t := self._below(sizes, rest)) and t != s:
                complete([t], room - t)
            tried += 1
            s = self._below(sizes, s - 1)
        if not found:
            return [()]
        return sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))

    def run(self, wide: int, pick: int = 0, at: int = -1) -> list[Pattern] | None:
        """One descent: at every bin the least wasteful filling, but for the at-th bin, which takes the pick-th."""
        left, out, waste, k, bins = dict(self.counts), [], 0, 0, 0
        sizes = sorted(left)
        while sizes:
            big = sizes[-1]
            left[big] -= 1
            if not left[big]:
                sizes.pop()
            options = self.fillings(sizes, left, self.cap - big, wide)
            self.nodes -= len(options)
            fill = options[min(pick, len(options) - 1) if k == at else 0]
            need = Counter((big, *fill))
            left[big] += 1
            if left[big] == 1 and (not sizes or sizes[-1] != big):
                sizes.append(big)
            times = min(left[s] // n for s, n in need.items())
            for s, n in need.items():
                left[s] -= n * times
                if not left[s]:
                    del left[s]
                    sizes.pop(bisect_right(sizes, s) - 1)
            waste += (self.cap - sum(s * n for s, n in need.items())) * times
            bins += times
            k += 1
            out.append((tuple(sorted(need.items(), reverse=True)), times))
            if self.best is not None and (self.total + waste + self.cap - 1) // self.cap >= self.best_bins:
                return None  # the waste so far already costs as many bins as the incumbent has
        if self.best is None or bins < self.best_bins:
            self.best, self.best_bins = out, bins
        return out

    def _descents(self) -> None:
        self.best, self.best_bins = None, 0
        self.run(1)  # one candidate a bin: largest-first greedy, the incumbent
        for wide in (8, 64, 512):
            if self.best_bins > self.bound and self.nodes > 0:
                self.run(wide)
        depth = len(self.best)
        for pick in (1, 2, 3):
            for at in range(depth):
                if self.best_bins <= self.bound or self.nodes <= 0:
                    return
                self.run(64, pick, at)

    def _slack(self) -> int:
        """Waste that may still be added by a packing that beats the incumbent."""
        return (self.best_bins - 1) * self.cap - self.total - self.waste

    def _options(self, after: tuple | None):
        """(items with counts, waste, times, order) of each way to fill bins around the largest length left.

        Bins of one largest length are filled in the order of `order`, so that no set of bins is met twice.
        """
        big = max(self.left)
        room = self.cap - big
        avail = {s: n - (s == big) for s, n in self.left.items() if s <= room and n > (s == big)}
        self.nodes -= 1 + len(avail) // 32
        for waste, fill in undominated(avail, room, self._slack, after[0] if after else 0):
            self.nodes -= 1
            if self.nodes <= 0:
                return
            order = (waste, [-s for s in fill or ()])
            if fill is None or after and order <= after:
                continue
            need = Counter((big, *fill))
            for times in range(min(self.left[s] // n for s, n in need.items()), 0, -1):
                yield need, waste, times, order

    def _use(self, need: Counter, waste: int, times: int) -> None:
        for s, n in need.items():
            self.left[s] = self.left.get(s, 0) - n * times
            if not self.left[s]:
                del self.left[s]
        self.waste += waste * times

    def _search(self) -> None:
        """Depth-first branch-and-bound with backtracking."""
        self.left, self.waste, self.nodes, path = dict(self.counts), 0, self.budget, []
        stack = [self._options(None)]
        while stack and self.nodes > 0 and self.best_bins > self.bound:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    need, waste, times = path.pop()
                    self._use(need, waste, -times)
                continue
            need, waste, times, order = step
            if waste * times > self._slack():
                continue
            big = max(self.left)
            self._use(need, waste, times)
            path.append((need, waste, times))
            if self.left:
                stack.append(self._options(order if big in self.left else None))
            else:
                self.best = [(tuple(sorted(n.items(), reverse=True)), t) for n, _, t in path]
                self.best_bins = sum(t for *_, t in path)
                path.pop()
                self._use(need, waste, -times)

    def solve(self) -> list[Pattern]:
        self._descents()
        if self.best_bins > self.bound:
            self._search()
        return self.best


def undominated(left: dict[int, int], room: int, most, least: int = 0):
    """(waste, descending items) of each undominated filling of room, by waste from `least` while it is at most most(), larger items
    first; (waste, None) stands for a dominated one.

    A filling is dominated if a length left out can take the place of some of its items: of two or more with its sum or
    less, of a smaller one, or of none, within the room. What it replaces fits where that length would have been.
    """
    sizes = sorted(left)
    reach, mask, lengths = [1], (1 << room + 1) - 1, sum(1 << s for s in sizes)
    for s in sizes:  # bit x of reach[k]: the k smallest lengths have a filling with the sum x
        r, n, k = reach[-1], min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            r |= r << s * k & mask
            n, k = n - k, 2 * k
        reach.append(r)

    def exact(k: int, rest: int):
        if not rest:
            yield ()
            return
        for j in range(bisect_right(sizes, rest, 0, k) - 1, -1, -1):
            if not reach[j + 1] >> rest & 1:
                return
            s = sizes[j]
            for n in range(min(left[s], rest // s), 0, -1):
                if reach[j] >> rest - n * s & 1:
                    for tail in exact(j, rest - n * s):
                        yield (s,) * n + tail

    for waste in range(least, room + 1):
        if waste > most():
            return
        if not reach[-1] >> room - waste & 1:
            continue
        for fill in exact(len(sizes), room - waste):
            out = lengths
            for s, n in Counter(fill).items():
                if left[s] == n:
                    out ^= 1 << s
            one = two = 0  # sums of one item, of two or more
            for s in fill:
                two |= (two | one) << s
                one |= 1 << s
            worse = two & out or any((1 | one | two) << d & out for d in range(1, waste + 1))
            yield waste, None if worse else fill


def pack(counts: dict[int, int], cap: int, nodes: int | None = 200_000) -> list[Pattern]:
    """Patterns that hold exactly the given counts of lengths (1 to cap), in as few bins as the search finds; with nodes=None it goes on
    until that is proven the fewest, however long that takes.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > cap:
        raise ValueError("lengths must be 1 to the capacity")
    return _Solver(counts, cap, math.inf if nodes is None else nodes).solve()


def plan_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, bins, first sequence, offset) of each pattern's share of a length."""
    rows, rank, seq = [], Counter(), 0
    for items, times in patterns:
        at = 0
        for s, n in items:
            rows.append((s, rank[s], n * times, times, seq, at))
            rank[s] += n * times
            at += n * s
        seq += times
    return rows


#: Chunks whose tokens Python can cut as the vocabulary's normalizer and pre-tokenizer do: printable ASCII and Latin-1 letters, which are
#: composed already and are lowered one by one. Those with "<|" may hold a special token.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


@functools.cache
def coders(path: str) -> tuple:
    """(whole tokenizer, its merge model over words that white space separates, which ids end a word), read once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = False
    merges = Tokenizer(whole.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocab = merges.get_vocab()
    suffix = getattr(whole.model, "end_of_word_suffix", None)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
    return whole, merges, ends


class ChunkCodec:
    """Little-endian unsigned 32-bit ids of texts. White space separates the vocabulary's tokens, so distinct chunks are encoded once.

    A plain chunk is cut here, and its distinct pieces go straight to the merge model, thousands in one call, which gives
    the same ids as the whole tokenizer; all other chunks take the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.coder, self.merges, self.ends = coders(path)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most
        self.bytes = {b: c for c, b in byte_of_letter().items() if b != 0x20}

    def _whole(self, chunks: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.coder.encode_batch_fast([w.decode("utf-8") for w in chunks], add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of words, each of which is one token of the pre-tokenizer."""
        text = " ".join(words).encode().decode("latin-1").translate(self.bytes).split(" ")
        lines = [" ".join(text[lo : lo + 16]) for lo in range(0, len(text), 16)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):  # a vocabulary that does not mark ends of words
            return [b"".join([x.id.to_bytes(4, "little") for x in self.merges.model.tokenize(w)]) for w in text]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: list[bytes]) -> None:
        rest, plain, sizes, flat = [], [], [], []
        for w in new:
            text = w.decode("utf-8")
            if PLAIN.fullmatch(text) and "<|" not in text:
                text = text.lower()
                core = text.rstrip(".,;:!?")
                parts = [core, text[len(core) :]] if core.isalpha() and len(core) < len(text) else [text] if core.isalpha() else PIECE.findall(text)
                plain.append(w)
                sizes.append(len(parts))
                flat += parts
            else:
                rest.append(w)
        fresh = [w for w in dict.fromkeys(flat) if w not in self.pieces]
        for lo in range(0, len(fresh), 16_384):
            self.pieces.update(zip(fresh[lo : lo + 16_384], self._merge(fresh[lo : lo + 16_384])))
        ids = map(self.pieces.__getitem__, flat)
        self.known.update((w, next(ids) if n == 1 else b"".join(islice(ids, n))) for w, n in zip(plain, sizes))
        for lo in range(0, len(rest), 4096):
            self.known.update(zip(rest[lo : lo + 4096], self._whole(rest[lo : lo + 4096])))

    def encode(self, raws: list[bytes]) -> list[bytes]:
        parts = [r.split() for r in raws]
        for held in (self.known, self.pieces):
            if len(held) > self.most:
                held.clear()
        # in order of occurrence: chunks of one text lie side by side in memory, and a lookup costs half as much
        self._learn([w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def tokenized_pieces(docs: DataFrame, path: str, cap: int, end_id: int) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id, piece, start, length, ids_crc32, task, rank): rank among the task's pieces of that length."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        codec, task, seen, end = ChunkCodec(path), TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
        for b in batches:
            ids_, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for doc_id, ids in zip(ids_, codec.encode(raws)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * cap)):
                    part = ids[at : at + 4 * cap]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if x in ("piece", "task") else pa.int64()) for x, c in zip(names, cols)], names)

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("raw")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, cap: int = 2048, end_id: int = 0, nodes: int | None = 200_000) -> DataFrame:
    """Pieces of all documents with sequence_id and offset. Null and empty texts are the end id alone; repeated rows are packed each.

    An empty table gives no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    small_batches(spark)
    pieces = materialize(spark, tokenized_pieces(docs, path, cap, end_id), "pieces")
    by_task = pieces.groupBy("length", "task").count()
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = plan_rows(pack(counts, cap, nodes))
    before = by_task.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = pieces.join(before.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    plan = spark.createDataFrame(rows, "length bigint, lo bigint, ranks bigint, bins bigint, seq bigint, at bigint").groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "ranks", "bins", "seq", "at"))).alias("plan"))
    # one row a length, a few entries each: at most `cap` rows and as many patterns
    placed = ranked.join(F.broadcast(plan), "length").withColumn("p", F.filter("plan", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["lo"] + x["ranks"]))[0]).withColumn("r", F.col("rank") - F.col("p.lo"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p.seq") + F.col("r") % F.col("p.bins")).alias("sequence_id"),
        (F.col("p.at") + F.floor(F.col("r") / F.col("p.bins")) * F.col("length")).alias("offset"),
    )


def op8_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
