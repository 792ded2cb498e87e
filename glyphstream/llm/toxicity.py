"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words and word beginnings, trained in numpy from confirmed toxic texts (P) and texts drawn from all, their class unread (U). With class prior pi
(the toxic share among labelled training rows), the risk is pi * R(P, +) + max(0, R(U, -) - pi * R(P, -)): unlabelled texts are
negatives but for the prior's share, and an estimate below zero is overfitting, which the step then undoes.
Training takes a bounded sample of both (`per_class` texts each); scoring takes every text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import crc_mod, materialize, read, small_batches
from glyphstream.llm.langid import draw

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text and their beginnings of 4 and 5 characters, as stems."""
    if not text:
        return set()
    words = set(WORD.findall(text.lower()))
    return words | {"^" + w[:5] for w in words if len(w) > 5} | {"^" + w[:4] for w in words if len(w) > 4}


def features(rows: DataFrame, n_pos: int, n_unl: int, least: int, z: float) -> list[str]:
    """Words whose share of texts differs between P and U by at least z standard errors, strongest first.

    Counted on the executors over the sampled texts (p, words); only the chosen words reach the driver.
    """
    count = rows.select("p", F.explode("words").alias("w")).groupBy("w").agg(F.sum("p").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least)
    share = F.col("n") / (n_pos + n_unl)
    gap = F.abs(F.col("a") / n_pos - (F.col("n") - F.col("a")) / n_unl) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl))
    found = count.where(share < 1).withColumn("z", gap).where(F.col("z") >= z)
    return [r.w for r in found.orderBy(F.desc("z"), "w").collect()]


def train_pu(pos: list[list[int]], unl: list[list[int]], names: list[str], prior: float, steps: int = 1500, rate: float = 0.1, l2: float = 1e-4) -> tuple[dict[str, float], float]:
    """(weight of each name, bias) from texts given as positions in names. Without texts of both kinds: no weights, the prior's log odds."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    if not pos or not unl:
        return {}, bias

    def matrix(texts):
        return np.repeat(np.arange(len(texts)), list(map(len, texts))), np.array([k for t in texts for k in t], np.int64), len(texts)

    P, U = matrix(pos), matrix(unl)
    w, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    w[-1] = bias

    def out(x):
        return np.bincount(x[0], w[x[1]], minlength=x[2]) + w[-1]

    def grad(x, d):
        """Gradient of the mean of a loss whose derivative by the output is d."""
        return np.append(np.bincount(x[1], d[x[0]], minlength=len(names)), d.sum()) / x[2]

    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    for step in range(1, steps + 1):
        sp, su = out(P), out(U)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        g_neg = grad(U, sigmoid(su)) - prior * grad(P, sigmoid(sp))
        g = prior * grad(P, sigmoid(sp) - 1) + g_neg if negative >= 0 else -g_neg
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(names, w[:-1].tolist())), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, least: int = 5, z: float = 6.0) -> tuple[dict[str, float], float]:
    """docs (doc_id, text) to learn from, labels (doc_id, toxic). P: labelled toxic; U: a sample of all texts, labels unread.

    Repeated labels of one doc_id: toxic if any is. Null labels and texts are left out; rows that repeat id and text are one row of the
    sample. Other columns are not read. Without toxic labels, or texts: no weights, and the bias is the prior's log odds.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = docs.select("doc_id").join(known, "doc_id", "left_semi").count()
    toxic = docs.select("doc_id").join(known.where("toxic = 1"), "doc_id", "left_semi").count()
    texts = docs.where("text is not null").select("doc_id", "text")
    # drawn before the join, so that texts move only for the sample
    part = lambda salt, size: texts.where(draw("doc_id", salt) < per_class / max(size, per_class))
    positive = part("positive", toxic).join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    both = positive.withColumn("p", F.lit(1)).union(part("unlabelled", texts.select("doc_id").count()).withColumn("p", F.lit(0)))
    rows = materialize(spark, both.dropDuplicates(["doc_id", "text", "p"]).select("p", "text").mapInArrow(_word_sets, "p int, words array<string>"), "toxicity-sample")
    sizes = {r.p: r["count"] for r in rows.groupBy("p").count().collect()}
    names = features(rows, sizes[1], sizes[0], least, z) if len(sizes) == 2 else []
    at = {w: k for k, w in enumerate(names)}

    def positions(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[at[w] for w in t if w in at] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["p", "at"])

    got = rows.mapInArrow(positions, "p int, at array<int>").collect() if names else []
    parts = [[r["at"] for r in got if r.p == k] for k in (1, 0)]
    return train_pu(*parts, names, prior=toxic / n if n else 0.5)


def _word_sets(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("p").cast(pa.int32()), pa.array([sorted(words_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["p", "words"])


def score(spark: SparkSession, docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs (doc_id, text) with score (0 to 1) and predicted, one row for each. Null and empty texts get the bias alone; other columns,
    a score among them, are not read. An empty table gives no rows."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def scored(batches):
        import math

        import pyarrow as pa

        weights, bias = held.value
        get, keys = weights.get, weights.keys()
        for b in batches:
            s = [1 / (1 + math.exp(-max(-60.0, min(60.0, bias + sum(map(get, keys & words_of(t))))))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    found = score(spark, docs, fit(docs.where(learn), labels.where(learn)))
    return found.select("doc_id", (~learn).alias("held_out"), "score", "predicted")
