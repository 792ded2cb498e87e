"""LM scoring by subword lattice likelihood.

An existing subword vocabulary gives the pieces and the first weights of all segmentations. The public model's stored scores are ranks (it is a BPE
model), so they become log weights by Zipf's law: log w = -log(1 + rank). The weights are then re-estimated on the training texts by
`em_rounds` rounds of expected counts over all segmentations of every distinct training word, with the first weights as a prior of
`prior_mass` pseudo-counts, so that no piece dies. A text's score is the log10 of its marginal probability: the log-space
forward recursion sums every segmentation of every white-space token, and the text ends with the end piece. No
piece spans white space, so the recursion over a text is the sum over its tokens, and each distinct word needs it once.

Counts cover all training texts. Only the most frequent words (at most `head`, found from a histogram of counts) and the piece weights (as
many as the vocabulary has) go to every worker; all other words meet their counts and weights in a shuffle join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import blocks, crc_mod, materialize, read, small_batches, text_bytes

BASE = np.uint64(0x9E3779B97F4A7C15)
LN10 = math.log(10.0)


class Vocabulary:
    """Pieces of a sentencepiece model, their prior from the stored scores, and a hash index of their spellings."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.model, self.size, self.end = model, n, sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        stored = np.array([sp.get_score(i) for i in range(n)])
        # whole numbers are the ranks of a BPE model, anything else the natural-log weights of a unigram model
        weight = 1.0 / (1.0 - np.minimum(0.0, stored)) if np.array_equal(stored, np.rint(stored)) else np.exp(stored)
        prior = np.array([0.0 if sp.is_control(i) or sp.is_unknown(i) else 1.0 / n if sp.is_byte(i) else weight[i] for i in range(n)])
        prior[self.end] = 1.0 / n
        self.prior = prior / prior.sum()
        self.bytes = np.zeros(256, np.int64)
        keys = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i) and "▁" not in p[1:]:
                keys[spelling_hash(p)] = i
        self.longest = max((len(p) for i, p in enumerate(pieces) if prior[i] > 0), default=1)
        self.mask, self.slots = 20, []
        rest, mult = keys, 0x2545F4914F6CDD1D
        while rest:  # open tables one after the other, until every key has a slot of its own
            at_key, at_id, left = np.zeros(1 << self.mask, np.uint64), np.full(1 << self.mask, -1, np.int32), {}
            for k, i in rest.items():
                slot = (k * mult & 0xFFFFFFFFFFFFFFFF) >> (64 - self.mask)
                if at_id[slot] < 0:
                    at_key[slot], at_id[slot] = k, i
                else:
                    left[k] = i
            self.slots.append((np.uint64(mult), at_key, at_id))
            rest, mult = left, mult * 3 & 0xFFFFFFFFFFFFFFFF | 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for mult, at_key, at_id in self.slots:
            slot = (h * mult) >> np.uint64(64 - self.mask)
            hit = at_key[slot] == h
            out = np.where(hit & (at_id[slot] >= 0), at_id[slot], out)
        return out


def spelling_hash(p: str) -> int:
    h = 0
    for c in p:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _logsum(t: np.ndarray) -> np.ndarray:
    m = t.max(axis=0)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(t - safe).sum(axis=0))


def lattice(vocab: Vocabulary, logp: np.ndarray, words: list[str], weights: np.ndarray | None = None):
    """Natural-log marginal probability of each word; with weights also the expected count of every piece.

    Words are taken in groups of equal length, so that each step of the recursion runs over a whole group.
    A character that no piece spells is spelled by its UTF-8 byte pieces.
    """
    out = np.zeros(len(words))
    expected = np.zeros(vocab.size) if weights is not None else None
    lp = np.append(logp, -np.inf)
    by_len: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_len.setdefault(len(w) + 1, []).append(k)
    for length, members in by_len.items():
        step = max(1, 400_000 // length)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            text = "".join("▁" + words[k] for k in part)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length).T.copy()
            h = np.zeros((length, len(part)), np.uint64)
            arcs, scores = [], []
            for size in range(1, min(length, vocab.longest) + 1):
                h = h[: length - size + 1] * BASE + codes[size - 1 :].astype(np.uint64) + np.uint64(1)
                ids = vocab.ids(h)
                s = lp[ids]
                if size == 1 and (ids < 0).any():
                    for c in np.unique(codes[ids < 0]):
                        s[codes == c] = logp[vocab.bytes[list(chr(c).encode("utf-8", "surrogatepass"))]].sum()
                arcs.append(ids)
                scores.append(s)
            alpha = np.full((length + 1, len(part)), -np.inf)
            alpha[0] = 0.0
            for j in range(1, length + 1):
                alpha[j] = _logsum(np.stack([alpha[j - z] + scores[z - 1][j - z] for z in range(1, min(j, len(scores)) + 1)]))
            out[part] = alpha[length]
            if expected is None:
                continue
            beta = np.full((length + 1, len(part)), -np.inf)
            beta[length] = 0.0
            for i in range(length - 1, -1, -1):
                beta[i] = _logsum(np.stack([beta[i + z] + scores[z - 1][i] for z in range(1, min(length - i, len(scores)) + 1)]))
            w = weights[part]
            for z, (ids, s) in enumerate(zip(arcs, scores), 1):
                post = np.exp(alpha[: length - z + 1] + s + beta[z:] - alpha[length]) * w
                got = ids >= 0
                expected += np.bincount(ids[got], post[got], minlength=vocab.size)
                if z == 1 and not got.all():
                    for c in np.unique(codes[~got]):
                        expected[vocab.bytes[list(chr(c).encode("utf-8", "surrogatepass"))]] += post[~got & (codes == c)].sum()
    return (out, expected) if expected is not None else out


def forward_log10(vocab: Vocabulary, logp: np.ndarray, text: str) -> float:
    """log10 marginal probability of one whole text (tokens by white space, then the end piece)."""
    words = [w.decode("utf-8") for w in text.encode("utf-8").lower().split()]
    return float((lattice(vocab, logp, words).sum() + logp[vocab.end]) / LN10)


def word_counts(docs: DataFrame, flush: int = 250_000) -> DataFrame:
    """docs (raw binary, held_out) -> (word, c): every distinct token, with its count in the texts that are not held out."""

    def count(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for raw, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held:
                    seen.update(dict.fromkeys(raw.lower().split(), 0))
                else:
                    seen.update(raw.lower().split())
                if len(seen) > flush:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return docs.select("raw", "held_out").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def train(spark: SparkSession, words: DataFrame, texts: int, model: str, em_rounds: int = 4, prior_mass: float | None = None) -> np.ndarray:
    """Natural-log weight of each piece, from (word, c) of the whole training part and its number of texts.

    prior_mass: pseudo-counts that the stored scores share out; by default one for every hundred pieces. No words: the prior alone.
    """
    vocab = Vocabulary(model)
    mass = 0.01 * vocab.size if prior_mass is None else prior_mass
    with np.errstate(divide="ignore"):
        logp = np.log(vocab.prior)
        for _ in range(em_rounds if texts else 0):
            now = spark.sparkContext.broadcast(logp)

            def expected(batches, now=now):
                import pyarrow as pa

                v = Vocabulary(model)
                total = np.zeros(v.size)
                for t in blocks(batches, 100_000):
                    total += lattice(v, now.value, t.column(0).to_pylist(), np.asarray(t.column(1), float))[1]
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

            got = words.where("c > 0").mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
            counts = mass * vocab.prior
            counts[got.piece.to_numpy(np.int64)] += got.n.to_numpy(float)
            counts[vocab.end] += texts
            logp = np.log(counts / counts.sum())
    return logp


def frequent(words: DataFrame, head: int, per_octave: int = 64) -> Column:
    """Condition on c that holds for the most frequent words, at most `head` of them: whole bins of a histogram of log c from the top."""
    level = F.floor(F.log2(F.col("c").cast("double")) * per_octave).cast("int")
    left, cut = head, None
    for r in sorted(words.where("c > 0").groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        cut = r.level
    return F.lit(False) if cut is None else (F.col("c") > 0) & (level >= cut)


def score_corpus(spark: SparkSession, docs: DataFrame, model: str, held_out: str, head: int = 131_072, em_rounds: int = 4) -> DataFrame:
    """Score every row of docs (doc_id, text, and a boolean column named held_out) with a model learnt from the other rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), one row for each input row.
    Null and empty texts have the end token alone. Repeated rows are scored and counted each; other columns are not read. No training rows:
    the base counts are zero and the pieces keep the prior's weights. An empty table gives an empty result.
    """
    small_batches(spark)
    docs = docs.select("doc_id", F.col(held_out).alias("held_out"), text_bytes().alias("raw"))
    words = materialize(spark, word_counts(docs), "words")
    texts = docs.where(~F.col("held_out")).count()
    size, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total = size + texts
    log_all = math.log10(total + 1 * (distinct + (texts > 0) + 1))
    logp = spark.sparkContext.broadcast(train(spark, words, texts, model, em_rounds))

    def weigh(batches):
        import pyarrow as pa

        v = Vocabulary(model)
        for t in blocks(batches, 100_000):
            lp = lattice(v, logp.value, t.column("word").to_pylist()) / LN10
            yield pa.RecordBatch.from_arrays([t.column("word").combine_chunks(), t.column("c").combine_chunks(), pa.array(lp)], ["word", "c", "lp"])

    weighed, often = "word string, c bigint, lp double", frequent(words, head)
    top = words.where(often).mapInArrow(weigh, weighed).toPandas()
    known = spark.sparkContext.broadcast({w.encode(): (math.log10(c + 1) - log_all, lp, c > 0) for w, c, lp in zip(top.word, top.c.tolist(), top.lp.tolist())})
    tail = words.where(~often)  # the head's words go nowhere near the join
    end = (math.log10(texts + 1) - log_all, float(logp.value[Vocabulary(model).end]) / LN10, texts > 0)

    def split(batches):
        """For each text one row with the sums over the head's words, and one for each of its other words."""
        import pyarrow as pa

        at, row, get = TaskContext.get().partitionId() << 40, 0, known.value.get
        kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])
        for b in batches:
            keys, rare_words, ns, sums = [], [], [], []
            for doc_id, held, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                key, row = at + row, row + 1
                (base, lp, _), n_known, n_tokens, rare = end, int(end[2]), 1, []
                for w, n in Counter(raw.lower().split()).items():
                    n_tokens += n
                    hit = get(w)
                    if hit is None:
                        rare.append((w, n))
                    else:
                        base += n * hit[0]
                        lp += n * hit[1]
                        n_known += n if hit[2] else 0
                for w, n in rare or [(b" %d" % key, 0)]:  # no token has a space: this row meets no count, and spreads
                    keys.append(key)
                    rare_words.append(w)
                    ns.append(n)
                    sums.append(None)
                sums[-1] = {"doc_id": doc_id, "held_out": held, "n_tokens": n_tokens, "n_known": n_known, "base": base, "lp": lp}
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(sums, kind)], ["key", "word", "n", "doc"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "held_out", "raw").mapInArrow(split, "key bigint, word string, n bigint, doc struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,lp:double>")
    met = rows.join(tail.mapInArrow(weigh, weighed), "word", "left")
    c = F.coalesce("c", F.lit(0))
    # primitive maxima keep the aggregate hashed; the document's own columns are in one row of its key
    sums = met.select(
        "key", F.col("doc.doc_id").alias("doc_id"), F.col("doc.held_out").cast("int").alias("held"), F.col("doc.n_tokens").alias("n_tokens"),
        (F.coalesce("doc.n_known", F.lit(0)) + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.coalesce("doc.base", F.lit(0.0)) + F.col("n") * (F.log10(c + 1) - F.lit(log_all))).alias("base"),
        (F.coalesce("doc.lp", F.lit(0.0)) + F.col("n") * F.coalesce("lp", F.lit(0.0))).alias("score"),
    )
    by_doc = sums.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), F.max("n_tokens").alias("n_tokens"), *(F.sum(x).alias(x) for x in ("n_known", "base", "score")))
    return by_doc.select("doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score_corpus(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), "held_out")
