import random

import regex
from pyspark.sql import functions as F

from glyphstream.functions import patterns as P
from glyphstream.functions import text as X
from glyphstream.operators import bpe, prep


def test_repair_gives_the_mark_aware_pattern(spark):
    assert P.repair(P.PAT_A) == P.PAT_B
    rows = spark.createDataFrame([(P.PAT_A,), (P.PAT_B,), (None,)], "p string").select(P.pattern_class(F.col("p")).alias("k")).collect()
    assert [r.k for r in rows] == ["letter-regex", "mark-regex", "no-regex"]


def test_config_walk():
    config = {"pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": P.PAT_A}}, {"type": "ByteLevel"}]}}
    assert P.split_patterns(config) == [P.PAT_A]
    assert P.split_patterns(P.with_patterns(config, P.repair)) == [P.PAT_B]


def test_pretokens_equal_the_regex_module(spark):
    random.seed(5)
    texts = ["", "नेपालको सरकार", "a  b", "a \n b", "123456", "It's WE'LL  "] + ["".join(random.choices("aZé9 \t\n'.!िक", k=random.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in (P.PAT_A, P.PAT_B):
        got = {r.i: (r.p, r.n) for r in df.select("i", X.pretokens(F.col("t"), pattern).alias("p"), X.pretoken_count(F.col("t"), pattern).alias("n")).collect()}
        for i, t in enumerate(texts):
            want = regex.findall(pattern, t)
            assert got[i] == (want, len(want)), t


def test_packing_staging_and_grams(spark):
    row = spark.createDataFrame([("aa bb cc", "x1y", None)], "t string, s string, n string").select(
        X.packed_pieces(F.col("t"), 5).alias("p"), X.staged(F.col("s"), [r"[a-z]+|\d", "x|q"]).alias("st"), X.word_grams(F.col("t"), 2).alias("g"), X.char_grams(F.col("s"), 2, 1).alias("c"), X.word_grams(F.col("t"), 9).alias("none")
    ).first()
    assert row.p == ["aa bb", "cc"] and row.st == ["x", "1", "y"] and row.g == ["aa bb", "bb cc"] and row.c == ["x1", "1y"] and row.none == []


def test_budget_and_held_out(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "doc_id long, b long")
    assert sorted(r.doc_id for r in prep.within_budget(df, "b", "doc_id", 25).collect()) == [0, 1, 2]
    got = {r.doc_id: r.split for r in prep.held_out_split(df, "b", "doc_id", 15, 30).collect()}
    assert [got[i] for i in range(10)] == ["held"] * 2 + ["train"] * 3 + ["out"] * 5


def test_merges_equal_plain_python(spark):
    types = [("abab", 3), ("abc", 2), ("bcab", 1), ("q", 9)]
    got = bpe.train(spark, spark.createDataFrame([(list(t), n) for t, n in types], "symbols array<string>, n long"), 3)
    now, want = {t: list(t) for t, _ in types}, []
    for _ in range(3):
        c = {}
        for t, n in types:
            for a, b in zip(now[t], now[t][1:]):
                c[a, b] = c.get((a, b), 0) + n
        (a, b), n = min(c.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        want.append((a, b, n))
        for t in now:
            out = []
            for s in now[t]:
                if out and out[-1] == a and s == b:
                    out[-1] = a + b
                else:
                    out.append(s)
            now[t] = out
    assert got == want
    assert bpe.closed_filter([("a", "b"), ("ab", "c"), ("x", "y")], {"a", "b", "c"}, lambda s: True, 5) == [("a", "b"), ("ab", "c")]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 44
