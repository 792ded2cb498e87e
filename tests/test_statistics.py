"""Resampling, clusters and ranks against plain Python."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from glyphstream.operators import stats


def weight(block, q, key):
    u = int(hashlib.md5(f"{block}:{key}".encode()).hexdigest()[8 * q : 8 * q + 8], 16)
    return sum(u >= top for top in stats.STEPS)


def test_resampled_sums_and_intervals(spark):
    rows = [(k, g, float(k % 7 - 3), 10 + k % 3) for g in ("x", "y") for k in range(40)] + [(99, None, 1.0, 5)]
    df = spark.createDataFrame(rows, "k long, g string, d double, n long")
    key = F.concat_ws("/", "g", F.col("k").cast("string"))
    got = {r.g: r for r in stats.intervals(df, "d", "n", key, 30, ["g"]).collect()}
    for g in ("x", "y", None):
        mine = [(f"{g}/{k}" if g else str(k), d, n) for k, x, d, n in rows if x == g]
        ratios = []
        for b in range(30):
            w = [weight(b // 4, b % 4, k) for k, *_ in mine]
            if sum(w):
                ratios.append(sum(c * d for c, (_, d, _) in zip(w, mine)) / sum(c * n for c, (*_, n) in zip(w, mine)))
        want = np.percentile(ratios, [2.5, 97.5])
        assert np.allclose([got[g].lo, got[g].hi], want) and got[g].units == len(mine)
        assert np.isclose(got[g].estimate, sum(d for _, d, _ in mine) / sum(n for *_, n in mine))
    assert stats.intervals(df.limit(0), "d", "n", F.col("k"), 10, ["g"]).count() == 0


def test_hashes_of_many_keys_at_once():
    from glyphstream.functions import md5

    keys = [b"", b"7", "é/12".encode(), b"x" * (md5.MOST - 4), *(b"%d" % k for k in range(30))]
    for c, words in md5.numbered(keys, range(0, 1000, 37)):
        for j, k in enumerate(keys):
            assert b"".join(int(w[j]).to_bytes(4, "little") for w in words) == hashlib.md5(b"%d:" % c + k).digest()


def test_resampled_counts_nulls_and_odd_keys_as_the_engine_does(spark):
    rows = [("a" * n, None if n % 4 == 0 else n / 2, n) for n in (1, 2, 3, 4, 8, 50, 51, 52, 60, 90)] + [(None, 2.0, 3)]
    df = spark.createDataFrame(rows, "k string, d double, n long")
    got = {r.b: r for r in stats.resampled(df, ["d", "n"], F.col("k"), 4006).collect()}
    for b in (0, 7, 399, 3999, 4005):
        w = [sum(int(hashlib.md5((f"{b // 4}:{k}" if k is not None else str(b // 4)).encode()).hexdigest()[8 * (b % 4) :][:8], 16) >= top for top in stats.STEPS) for k, *_ in rows]
        assert got[b].n == sum(x * n for x, (*_, n) in zip(w, rows)) and np.isclose(got[b].d, sum(x * d for x, (_, d, _) in zip(w, rows) if d is not None))
    assert max(got) < 4006
    none = stats.intervals(df.limit(0), "d", "n", F.col("k"), 8).first()
    assert none.units == 0 and none.estimate is None and none.lo is None


def test_weights_are_poisson():
    w = [weight(b // 4, b % 4, k) for b in range(40) for k in range(500)]
    assert abs(np.mean(w) - 1) < 0.02 and abs(np.var(w) - 1) < 0.04


def test_interval_covers_as_numpy_draws(spark):
    rng = np.random.default_rng(3)
    d, n = rng.normal(0.1, 1, 400), rng.integers(5, 15, 400)
    df = spark.createDataFrame([("a", k, float(x), int(y)) for k, (x, y) in enumerate(zip(d, n))], "g string, k long, d double, n long")
    one = stats.intervals(df, "d", "n", F.col("k"), 1000).first()
    two = stats.bootstrap_exact(df, "g", "d", "n", "k", 1000).first()
    assert np.isclose(two.estimate, one.estimate) and two.units == one.units == 400
    assert abs((one.hi - one.lo) / (two.hi - two.lo) - 1) < 0.15


def test_exact_bootstrap_repeats_numpy(spark):
    d, n = np.arange(10.0), np.arange(10) + 1
    df = spark.createDataFrame([("a", k, float(x), int(y)) for k, (x, y) in enumerate(zip(d, n))], "g string, k long, d double, n long")
    rng = np.random.default_rng(0)
    r = np.concatenate([(d[at].sum(1) / n[at].sum(1)) for at in (rng.integers(0, 10, (64, 10)), rng.integers(0, 10, (36, 10)))])
    got = stats.bootstrap_exact(df, "g", "d", "n", "k", 100).first()
    assert (got.lo, got.hi) == (np.percentile(r, 2.5), np.percentile(r, 97.5))


def test_clusters_and_ranks(spark):
    rows = [(1, p, b) for p, b in enumerate([2000, 1900, 100, 50, 2000])] + [(2, 0, 10), (2, 1, 10)]
    df = spark.createDataFrame(rows, "doc long, piece long, bytes long")
    got = {(r.doc, r.piece): r.cluster_id for r in stats.clusters(df, "doc", "piece", "bytes").collect()}
    assert [got[1, p] for p in range(5)] == [0, 0, 0, 1, 2] and [got[2, p] for p in range(2)] == [0, 1]
    truth = spark.createDataFrame([(2, 0, 10, 7), (2, 1, 10, 7), (1, 0, 1, 5)], "doc long, piece long, bytes long, cluster_id long")
    got = {(r.doc, r.piece): r.cluster_id for r in stats.clusters(df, "doc", "piece", "bytes", truth=truth).collect()}
    assert got[2, 1] == 7 and got[1, 4] == 2
    ranks = sorted((r.v, r.rank) for r in stats.mid_ranks(spark.createDataFrame([(3,), (1,), (3,), (2,)], "v int"), "v", "rank").collect())
    assert ranks == [(1, 1.0), (2, 2.0), (3, 3.5), (3, 3.5)]


def test_null_values_are_ranked_last_and_kept(spark):
    df = spark.createDataFrame([(3.0,), (None,), (1.0,), (None,)], "v double")
    assert sorted((str(r.v), r.rank) for r in stats.mid_ranks(df, "v", "rank").collect()) == [("1.0", 1.0), ("3.0", 2.0), ("None", 3.5), ("None", 3.5)]


def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path):
    """Empty texts, sums whose order matters, and documents of one language in many ranges."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, ["", "bcs th", "the cat sat", "a b"][k % 4] if k % 9 else "", ["en", "de", "fr"][k % 3], "s", 5) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    prices = [0.1, 0.2, 0.3, 0.7, 1e6 + 0.4]
    orders = [(9 * c + k, c, prices[(c + k) % 5]) for c in range(60) for k in range(1 + c % 4)] + [(1000, 99, None), (1001, 99, None), (1002, 98, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("documents", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for q in ("syllable_units", "token_premium", "premium_factors", "unseen_bigrams"):
        got = sorted(map(str, map(tuple, entry.queries()[q](spark, str(tmp_path)).collect())))
        assert got == sorted(map(str, con.execute(entry.oracle_sql()[q]).fetchall())), q
    r = entry.queries()["correlations"](spark, str(tmp_path)).first()
    assert r.units == 62 and r.units == con.execute(entry.oracle_sql()["correlations"]).fetchone()[0]
