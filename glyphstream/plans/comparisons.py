"""Queries over scored pieces: clusters, comparisons with intervals, options, premiums, plans and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphstream.functions import patterns as P
from glyphstream.functions import text as X
from glyphstream.operators import prep, stats
from glyphstream.plans.catalog import A_RAW, A_TR, B_RAW, B_TR, PIECES_SQL, SCORES_SQL, TR, WORDS, boot_sql, docs, pieces, query, ratio, scores, table, tr, word_rows

B = 2000
r6 = lambda c: F.round(c, 6).alias(c)

# ---- clusters ----------------------------------------------------------------------------------------------------------------------

CLUSTER_SQL = "coalesce(sum(CASE WHEN bytes < 1900 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY piece_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("WITH " + PIECES_SQL + f", w AS (SELECT doc_id, piece_id, bytes, {CLUSTER_SQL} AS c FROM p) SELECT doc_id, CAST(c AS BIGINT) AS cluster_id, count(*) AS pieces, CAST(sum(bytes) AS BIGINT) AS bytes FROM w GROUP BY ALL")
def cluster_ids(spark, d):
    """A short piece closes its cluster; runs within a document."""
    return stats.clusters(pieces(spark, d), "doc_id", "piece_id", "bytes").groupBy("doc_id", "cluster_id").agg(F.count("*").alias("pieces"), F.sum("bytes").alias("bytes"))


TRUTH_SQL = "t AS (SELECT doc_id, piece_id, bytes + CASE WHEN doc_id % 5 = 0 AND piece_id = 2 THEN 1 ELSE 0 END AS bytes, piece_id // 3 AS cluster_id FROM p WHERE doc_id % 2 = 0)"


@query("WITH " + PIECES_SQL + ", " + TRUTH_SQL + f""", w AS (SELECT p.doc_id, p.piece_id, p.bytes, {CLUSTER_SQL.replace("bytes <", "p.bytes <").replace("BY doc_id", "BY p.doc_id").replace("BY piece_id", "BY p.piece_id")} AS c, t.cluster_id AS tc, bool_and(coalesce(t.bytes = p.bytes, false)) OVER (PARTITION BY p.doc_id) AS ok FROM p LEFT JOIN t ON p.doc_id = t.doc_id AND p.piece_id = t.piece_id)
SELECT doc_id, CAST(CASE WHEN ok THEN tc ELSE c END AS BIGINT) AS cluster_id, count(*) AS pieces FROM w GROUP BY ALL""")
def clusters_from_truth(spark, d):
    """Clusters of a truth table where its sizes agree with the document's, by length elsewhere."""
    p = pieces(spark, d)
    off = F.when((F.col("doc_id") % 5 == 0) & (F.col("piece_id") == 2), 1).otherwise(0)
    truth = p.where("doc_id % 2 = 0").select("doc_id", "piece_id", (F.col("bytes") + off).alias("bytes"), F.floor(F.col("piece_id") / 3).alias("cluster_id"))
    return stats.clusters(p, "doc_id", "piece_id", "bytes", truth=truth).groupBy("doc_id", "cluster_id").agg(F.count("*").alias("pieces"))


# ---- comparisons -------------------------------------------------------------------------------------------------------------------


@query("WITH " + SCORES_SQL + " SELECT lang, count(*) AS pieces, CAST(sum(bytes) AS BIGINT) AS bytes, 0::BIGINT AS unmatched, round(CAST(sum(r2 - r0) / sum(bytes) AS DOUBLE), 6) AS diff FROM s GROUP BY lang")
def two_arm_join(spark, d):
    """Two arms' pieces joined by place; pieces that lack a partner of equal bytes are counted, and must be none."""
    s = scores(spark, d)
    left, right = s.select("lang", "doc_id", "piece_id", "bytes", "r0"), s.select("doc_id", "piece_id", F.col("bytes").alias("b2"), "r2")
    met = left.join(right, ["doc_id", "piece_id"], "left")
    return met.groupBy("lang").agg(F.count("*").alias("pieces"), F.sum("bytes").alias("bytes"), F.count_if(~F.coalesce(F.col("bytes") == F.col("b2"), F.lit(False))).alias("unmatched"), F.round((F.sum(F.col("r2") - F.col("r0")) / F.sum("bytes")).cast("double"), 6).alias("diff"))


@query("WITH " + SCORES_SQL + f", k AS (SELECT *, {CLUSTER_SQL} AS c FROM s), x AS (SELECT doc_id, piece_id, CAST(r2 - r0 AS DOUBLE) AS d, bytes FROM k), y AS (SELECT doc_id, c, CAST(sum(CAST(r2 - r0 AS DOUBLE)) AS DOUBLE) AS d, sum(bytes) AS bytes FROM k GROUP BY ALL), " + boot_sql("x", "doc_id || '/' || piece_id", "d", "bytes", B) + ", " + boot_sql("y", "doc_id || '/' || CAST(c AS BIGINT)", "d", "bytes", B) + """
SELECT round(x.estimate, 6) AS estimate, x.units AS pieces, round(x.lo, 6) AS piece_lo, round(x.hi, 6) AS piece_hi, y.units AS clusters, round(y.lo, 6) AS lo, round(y.hi, 6) AS hi, round((y.hi - y.lo) / (x.hi - x.lo), 6) AS width_ratio FROM x_boot x, y_boot y""")
def compare_arms(spark, d):
    """Difference with both intervals, over pieces and over clusters, 2,000 resamples each."""
    s = stats.clusters(scores(spark, d), "doc_id", "piece_id", "bytes")
    c = stats.compare(s, "r2", "r0", "bytes", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("piece_id").cast("string")), ["doc_id", "cluster_id"], B)
    return c.select(r6("estimate"), "pieces", r6("piece_lo"), r6("piece_hi"), "clusters", r6("lo"), r6("hi"), r6("width_ratio"))


def pair_ctes(where: str = "true") -> str:
    return f"""l AS (SELECT lang, doc_id, bytes, unnest(['r1-r0', 'r2-r0', 'r2-r1']) AS pair, unnest([CAST(r1 - r0 AS DOUBLE), CAST(r2 - r0 AS DOUBLE), CAST(r2 - r1 AS DOUBLE)]) AS d FROM s WHERE {where}),
c AS (SELECT lang || ' ' || pair AS g, doc_id, sum(d) AS d, sum(bytes) AS bytes FROM l GROUP BY ALL), """ + boot_sql("c", "g || doc_id", "d", "bytes", B, "g")


VERDICT_SQL = "CASE WHEN hi < 0 THEN 'better' WHEN hi < 0.01 THEN 'non-inferior' WHEN lo > 0 THEN 'worse' ELSE 'no detectable difference' END"


def arm_pairs(s):
    """All three differences of arms, by language, summed to documents."""
    diff = lambda a, b: F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).cast("double").alias("d"))
    rows = s.where("lang is not null").select("lang", "doc_id", "bytes", F.explode(F.array(diff("r1", "r0"), diff("r2", "r0"), diff("r2", "r1"))).alias("z"))
    return rows.groupBy(F.concat_ws(" ", "lang", "z.pair").alias("g"), "doc_id").agg(F.sum("z.d").alias("d"), F.sum("bytes").alias("bytes"))


def with_verdicts(units):
    r = stats.intervals(units, "d", "bytes", F.concat("g", F.col("doc_id").cast("string")), B, ["g"])
    return r.select("g", r6("estimate"), "units", r6("lo"), r6("hi"), stats.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query(f"WITH {SCORES_SQL}, {pair_ctes()} SELECT g, round(estimate, 6) AS estimate, units, round(lo, 6) AS lo, round(hi, 6) AS hi, {VERDICT_SQL} AS verdict FROM c_boot")
def three_way_comparison(spark, d):
    """Every pair of three arms by language, resampled by document, with a verdict."""
    return with_verdicts(arm_pairs(scores(spark, d)))


@query(f"""WITH {SCORES_SQL}, {pair_ctes("piece_id < 3")}, k AS (SELECT sum(bytes) FILTER (WHERE piece_id < 3) / sum(bytes) AS share FROM s)
SELECT g, round(estimate, 6) AS estimate, units, round(lo, 6) AS lo, round(hi, 6) AS hi, {VERDICT_SQL} AS verdict, round((SELECT share FROM k), 6) AS compute_share FROM c_boot""")
def equal_compute(spark, d):
    """The comparison on each document's first pieces only, and the share of all bytes that they are."""
    s = scores(spark, d)
    share = s.agg((F.sum(F.when(F.col("piece_id") < 3, F.col("bytes"))) / F.sum("bytes")).alias("share"))
    return with_verdicts(arm_pairs(s.where("piece_id < 3"))).crossJoin(share).withColumn("compute_share", F.round("share", 6)).drop("share")


@query("WITH " + SCORES_SQL + f", w AS (SELECT lang, doc_id, piece_id, bytes, {CLUSTER_SQL} AS c FROM s WHERE piece_id < 4) SELECT doc_id, piece_id, dense_rank() OVER (PARTITION BY lang ORDER BY doc_id, c) - 1 AS cluster FROM w")
def prefix_clusters(spark, d):
    """Clusters of the first pieces, numbered anew without gaps within a language."""
    s = stats.clusters(scores(spark, d).where("piece_id < 4"), "doc_id", "piece_id", "bytes")
    return s.select("doc_id", "piece_id", (F.dense_rank().over(Window.partitionBy("lang").orderBy("doc_id", "cluster_id")) - 1).cast("bigint").alias("cluster"))


@query("WITH " + SCORES_SQL + ", a AS (SELECT doc_id, piece_id, bytes, (CAST(r0 AS DOUBLE) + CAST(r1 AS DOUBLE)) / 2 - CAST(r2 AS DOUBLE) AS d FROM s), c AS (SELECT doc_id, sum(d) AS d, sum(bytes) AS bytes FROM a GROUP BY doc_id), " + boot_sql("c", "doc_id", "d", "bytes", B) + " SELECT round(estimate, 6) AS estimate, units, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c_boot")
def seed_average(spark, d):
    """Two runs averaged piece by piece, then compared with the third arm over resampled documents."""
    long = scores(spark, d).select("doc_id", "piece_id", "bytes", "r2", F.explode(F.array("r0", "r1")).alias("nll"))
    mean = long.groupBy("doc_id", "piece_id").agg(F.avg(F.col("nll").cast("double")).alias("nll"), F.first("bytes").alias("bytes"), F.first("r2").cast("double").alias("r2"))
    c = mean.groupBy("doc_id").agg(F.sum(F.col("nll") - F.col("r2")).alias("d"), F.sum("bytes").alias("bytes"))
    return stats.intervals(c, "d", "bytes", F.col("doc_id"), B).select(r6("estimate"), "units", r6("lo"), r6("hi"))


ITEMS_SQL = "i AS (SELECT l.doc_id, coalesce(d.lang, '-') AS lang, CASE WHEN l.toxic = l.quality THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS right, 1.0::DOUBLE AS one FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND l.quality IS NOT NULL)"


@query("WITH " + ITEMS_SQL + ", " + boot_sql("i", "doc_id", '"right"', "one", B, "lang") + " SELECT lang, units AS n, round(estimate, 6) AS acc, round(lo, 6) AS lo, round(hi, 6) AS hi FROM i_boot")
def accuracy_by_lang(spark, d):
    """Share of right answers with its interval over resampled items."""
    j = table(spark, d, "labels").where("toxic is not null and quality is not null").join(docs(spark, d).select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang")), "doc_id")
    items = j.select("lang", "doc_id", F.when(F.col("toxic") == F.col("quality"), 1.0).otherwise(0.0).alias("right"), F.lit(1.0).alias("one"))
    return stats.intervals(items, "right", "one", F.col("doc_id"), B, ["lang"]).select("lang", F.col("units").alias("n"), F.round("estimate", 6).alias("acc"), r6("lo"), r6("hi"))


@query("WITH " + SCORES_SQL + ", w AS (SELECT l AS lang, p AS pair FROM (VALUES ('en'), ('de'), ('ne')) x(l), (VALUES ('r1-r0'), ('r2-r0'), ('r9-r0')) y(p)), " + pair_ctes() + " SELECT w.lang, w.pair, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, b.g IS NULL AS missing FROM w LEFT JOIN c_boot b ON b.g = w.lang || ' ' || w.pair")
def test_matrix(spark, d):
    """A fixed list of comparisons with intervals; those without data are reported, not failed."""
    want = spark.createDataFrame([(x, p) for x in ("en", "de", "ne") for p in ("r1-r0", "r2-r0", "r9-r0")], "lang string, pair string")
    got = with_verdicts(arm_pairs(scores(spark, d)))
    met = want.join(got, F.concat_ws(" ", "lang", "pair") == F.col("g"), "left")
    return met.select("lang", "pair", "estimate", "lo", "hi", F.col("g").isNull().alias("missing"))


@query("WITH " + SCORES_SQL + " SELECT lang, round(CAST(sum(r0) / sum(bytes) AS DOUBLE), 6) AS base, round(CAST(100 * 0.01 / (sum(r0) / sum(bytes)) AS DOUBLE), 6) AS margin_percent FROM s GROUP BY lang")
def margin_percent(spark, d):
    """The fixed margin as a percentage of each baseline."""
    s = scores(spark, d).groupBy("lang").agg((F.sum("r0") / F.sum("bytes")).cast("double").alias("b"))
    return s.select("lang", F.round("b", 6).alias("base"), F.round(F.lit(100 * 0.01) / F.col("b"), 6).alias("margin_percent"))


@query("""WITH o AS (SELECT l_orderkey AS item, l_linenumber AS option, -(l_extendedprice - 100 * l_tax) / l_quantity AS score FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, option) AS r, count(*) OVER (PARTITION BY item) AS n FROM o)
SELECT n AS options, count(*) AS items, round(avg(CASE WHEN option = item % n + 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b WHERE r = 1 GROUP BY n""")
def option_scoring(spark, d):
    """Each item's best option by length-normalised score, (full - prompt) by size, ties to the first, and the share that is the gold one."""
    score = -(F.col("l_extendedprice") - 100 * F.col("l_tax")) / F.col("l_quantity")
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.max_by("l_linenumber", F.struct(score, -F.col("l_linenumber"))).alias("best"), F.count("*").alias("options"))
    return items.groupBy("options").agg(F.count("*").alias("items"), F.round(F.avg((F.col("best") == F.col("item") % F.col("options") + 1).cast("double")), 6).alias("accuracy"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS p FROM orders GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM g)
SELECT count(*) AS units, round(corr(n, p), 6) AS pearson, round(corr(rn, rp), 6) AS spearman, round(regr_slope(ln(p), ln(n)), 6) AS exponent FROM r""")
def correlations(spark, d):
    """Linear and rank correlation, and the exponent of a power law, of two figures of each unit."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("p"))  # equal in whatever order, so ties are ties
    r = stats.mid_ranks(stats.mid_ranks(g, "n", "rn"), "p", "rp")
    return r.agg(F.count("*").alias("units"), F.round(F.corr("n", "p"), 6).alias("pearson"), F.round(F.corr("rn", "rp"), 6).alias("spearman"), F.round(F.regr_slope(F.log("p"), F.log("n")), 6).alias("exponent"))


# ---- premiums and arms -------------------------------------------------------------------------------------------------------------

SENT_SQL = f"n AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sent_id, {A_TR} AS a, {B_TR} AS b, {A_RAW} AS raw, strlen(text) AS bytes, length(text) AS chars FROM documents WHERE lang IS NOT NULL)"


def sentences(spark, d):
    """Documents of each language in order as the sentences of a parallel corpus."""
    count = X.pretoken_count
    n = docs(spark, d).where("lang is not null").select("lang", "doc_id", tr().alias("t"), "text")
    n = n.select("lang", "doc_id", F.lit(1).alias("one"), count(F.col("t"), P.PAT_A).alias("a"), count(F.col("t"), P.PAT_B).alias("b"), count(F.col("text"), P.PAT_A).alias("raw"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))
    # counts move, not texts, and a language's rows are numbered by ranges
    return prep.running(n, "one", "doc_id", ["lang"]).select("lang", F.col("before").alias("sent_id"), "a", "b", "raw", "bytes", "chars")


@query("WITH " + SENT_SQL + """ SELECT l.lang, count(*) AS sentences, round(sum(l.a) / sum(e.raw), 6) AS premium, round(sum(l.bytes) / sum(e.bytes), 6) AS byte_ratio, round(sum(l.chars) / sum(e.chars), 6) AS char_ratio
FROM n l JOIN n e ON l.sent_id = e.sent_id AND e.lang = 'en' WHERE l.lang <> 'en' GROUP BY l.lang""")
def token_premium(spark, d):
    """Tokens of each language over English's, sentence by sentence of a parallel corpus."""
    n = sentences(spark, d)
    e = n.where("lang = 'en'").select("sent_id", F.col("raw").alias("e_raw"), F.col("bytes").alias("e_bytes"), F.col("chars").alias("e_chars"))
    return n.where("lang <> 'en'").join(e, "sent_id").groupBy("lang").agg(F.count("*").alias("sentences"), ratio(F.sum("a"), F.sum("e_raw")).alias("premium"), ratio(F.sum("bytes"), F.sum("e_bytes")).alias("byte_ratio"), ratio(F.sum("chars"), F.sum("e_chars")).alias("char_ratio"))


@query("WITH " + SENT_SQL + """, s AS (SELECT l.lang, sum(l.a) AS t, sum(l.b) AS f, sum(l.raw) AS w, sum(e.raw) AS te FROM n l JOIN n e ON l.sent_id = e.sent_id AND e.lang = 'en' WHERE l.lang <> 'en' GROUP BY l.lang)
SELECT lang, round(w / te, 6) AS base, round(t / f, 6) AS regex, round(f / w, 6) AS vocab, round(t / te, 6) AS premium, abs(w / te * (t / f) * (f / w) - t / te) < 1e-9 AS whole, round(f / te, 6) AS floor FROM s""")
def premium_factors(spark, d):
    """The premium as a product: base text, regex and vocabulary; the product must be the premium."""
    n = sentences(spark, d)
    s = n.where("lang <> 'en'").join(n.where("lang = 'en'").select("sent_id", F.col("raw").alias("e")), "sent_id").groupBy("lang").agg(*(F.sum(c).cast("double").alias(k) for k, c in (("t", "a"), ("f", "b"), ("w", "raw"), ("te", "e"))))
    base, regex, vocab, premium = (F.col(a) / F.col(b) for a, b in (("w", "te"), ("t", "f"), ("f", "w"), ("t", "te")))
    return s.select("lang", F.round(base, 6).alias("base"), F.round(regex, 6).alias("regex"), F.round(vocab, 6).alias("vocab"), F.round(premium, 6).alias("premium"), (F.abs(base * regex * vocab - premium) < 1e-9).alias("whole"), ratio(F.col("f"), F.col("te")).alias("floor"))


ARMS_SQL = f"arms AS (SELECT lang, unnest(['alpha', 'beta', 'gamma', 'delta']) AS name, unnest([{A_RAW}, {B_RAW}, {A_TR}, {B_TR}]) AS n FROM documents)"


@query("WITH " + ARMS_SQL + """, c AS (SELECT name, lang, sum(n)::BIGINT AS n FROM arms GROUP BY ALL), s AS (SELECT name, string_agg(lang || ':' || n, ',' ORDER BY lang) AS sig FROM c GROUP BY name)
SELECT min(name) AS representative, count(*) AS members, string_agg(name, ',' ORDER BY name) AS names FROM s GROUP BY sig""")
def alias_groups(spark, d):
    """Tokenizers with equal token counts in every language: the first names the group."""
    arms = (("alpha", "text", P.PAT_A), ("beta", "text", P.PAT_B), ("gamma", "t", P.PAT_A), ("delta", "t", P.PAT_B))
    sums = docs(spark, d).where("lang is not null").select("lang", "text", tr().alias("t")).groupBy("lang").agg(*(F.sum(X.pretoken_count(F.col(c), p)).alias(n) for n, c, p in arms))
    c = sums.select("lang", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n, *_ in arms))).alias("z")).select("lang", "z.*")
    sig = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat_ws(":", x["lang"], x["n"].cast("string"))), ",")
    return c.groupBy("name").agg(sig.alias("sig")).groupBy("sig").agg(F.min("name").alias("representative"), F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).drop("sig")


@query(f"""WITH t AS ({WORDS}), w AS (SELECT DISTINCT lang, w FROM t WHERE w <> '' AND lang IS NOT NULL), k AS (SELECT w, min(lang) AS lang, count(*) AS n FROM w GROUP BY w),
c AS (SELECT lang, count(*) FILTER (WHERE regexp_matches(w, '^[A-Z]')) AS added, count(*) AS vocab FROM k WHERE n = 1 GROUP BY lang)
SELECT lang, added, vocab, CASE WHEN added > 1000 THEN 'added_tokens' WHEN vocab > 0 THEN 'merges' ELSE 'none' END AS mechanism FROM c""")
def mechanism_class(spark, d):
    """What a language's own types would be put in as: many whole words as added tokens, else merges."""
    types = word_rows(spark, d).where("lang is not null").select("lang", "w").distinct().groupBy("w").agg(F.min("lang").alias("lang"), F.count("*").alias("n")).where("n = 1")
    c = types.groupBy("lang").agg(F.count_if(F.col("w").rlike("^[A-Z]")).alias("added"), F.count("*").alias("vocab"))
    return c.withColumn("mechanism", F.when(F.col("added") > 1000, "added_tokens").when(F.col("vocab") > 0, "merges").otherwise("none"))


@query("""WITH t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), p AS (SELECT doc_id, unnest(list_zip(w[1:len(w)-1], w[2:])) AS z FROM t WHERE len(w) > 1),
r AS (SELECT DISTINCT z[1] AS a, z[2] AS b FROM p WHERE doc_id % 2 = 0), v AS (SELECT a AS w FROM r UNION SELECT b FROM r), e AS (SELECT z[1] AS a, z[2] AS b, count(*) AS n FROM p WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS bigrams, CAST(sum(n) FILTER (WHERE r.a IS NULL) AS BIGINT) AS unseen, CAST(sum(n) FILTER (WHERE r.a IS NULL AND x.w IS NOT NULL AND y.w IS NOT NULL) AS BIGINT) AS unseen_of_seen, count(*) AS types, count(*) FILTER (WHERE r.a IS NULL) AS unseen_types
FROM e LEFT JOIN r ON e.a = r.a AND e.b = r.b LEFT JOIN v x ON e.a = x.w LEFT JOIN v y ON e.b = y.w""")
def unseen_bigrams(spark, d):
    """Bigrams of odd documents that even ones lack, and those of them whose words even ones have. One aggregate over bigram types."""
    w = docs(spark, d).select((F.col("doc_id") % 2 == 0).alias("even"), X.words(F.col("text")).alias("w")).where(F.size("w") > 1)
    pair = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    n = w.select("even", F.explode(pair).alias("z")).groupBy("z.a", "z.b").agg(F.count_if("even").alias("seen"), F.count_if(~F.col("even")).alias("n"))
    old = n.where("seen > 0").select(F.explode(F.array("a", "b")).alias("w")).distinct()
    e = n.where("n > 0").join(old.select(F.col("w").alias("a"), F.lit(True).alias("x")), "a", "left").join(old.select(F.col("w").alias("b"), F.lit(True).alias("y")), "b", "left")
    new = F.col("seen") == 0
    return e.agg(F.sum("n").alias("bigrams"), F.sum(F.when(new, F.col("n"))).alias("unseen"), F.sum(F.when(new & F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("n"))).alias("unseen_of_seen"), F.count("*").alias("types"), F.count_if(new).alias("unseen_types"))


SPAN_SQL = """w AS (SELECT item_id, string_split(text, ' ') AS w, length(text) AS n FROM benchmark), t AS (SELECT item_id, unnest(range(len(w))) AS i, w FROM w),
s AS (SELECT item_id, i, list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) AS a, length(w[i + 1]) AS k FROM t), x AS (SELECT item_id, coalesce(a, 0)::BIGINT AS a, (coalesce(a, 0) + k)::BIGINT AS b FROM s),
y AS (SELECT item_id, unnest(range(0, n, 3)) AS off FROM w)"""


@query("WITH " + SPAN_SQL + """, u AS (SELECT x.item_id, x.a, x.b, count(y.off) + 1 AS units FROM x LEFT JOIN y ON x.item_id = y.item_id AND x.a < y.off AND y.off < x.b GROUP BY ALL)
SELECT count(*) AS tokens, CAST(sum(units) AS BIGINT) AS units, count(*) FILTER (WHERE units >= 2) AS two, count(*) FILTER (WHERE units >= 3) AS three, count(*) FILTER (WHERE units >= 4) AS four FROM u""")
def units_per_token(spark, d):
    """Units of a boundary table inside token spans (here a boundary at every third code point): a range join within each text."""
    w = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"), F.length("text").alias("n"))
    size = F.transform("w", lambda x: F.length(x) + 1)
    spans = w.select("item_id", F.posexplode("w").alias("i", "x"), size.alias("z")).select("item_id", F.aggregate(F.slice("z", 1, F.col("i")), F.lit(0), lambda s, v: s + v).alias("a"), F.length("x").alias("k")).select("item_id", "a", (F.col("a") + F.col("k")).alias("b"))
    offs = w.select("item_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(3))).alias("off"))
    u = stats.units_inside(spans, offs, "item_id")
    return u.agg(F.count("*").alias("tokens"), F.sum("units").alias("units"), *(F.count_if(F.col("units") >= k).alias(n) for k, n in ((2, "two"), (3, "three"), (4, "four"))))


@query("WITH " + SPAN_SQL + " SELECT item_id, a AS start, b AS stop FROM x")
def word_spans(spark, d):
    """Spans of a pattern's matches by a table function in a lateral join."""
    from glyphstream.functions import spans

    spans.register(spark)
    table(spark, d, "benchmark").createOrReplaceTempView("span_items")
    return spark.sql(r"SELECT item_id, CAST(s.start AS BIGINT) AS start, CAST(s.end AS BIGINT) AS stop FROM span_items, LATERAL regex_spans(text, '[^ ]+') s")


@query("""WITH o AS (SELECT item_id, i, 3 * i - CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END AS a, 3 * i + 3 AS b FROM (SELECT item_id, unnest(range(0, length(text) // 3)) AS i FROM benchmark)),
l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM o WINDOW w AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, count(*) - 1 AS boundaries, count(*) FILTER (WHERE a < pb OR a = pa) AS intra FROM l GROUP BY item_id""")
def offset_cuts(spark, d):
    """Cuts inside a character told from offsets: a token that overlaps the one before, or starts with it."""
    i = F.sequence(F.lit(0), F.floor(F.length("text") / 3).cast("int") - 1)
    spans = F.transform(i, lambda k: F.struct((3 * k - F.when(k % 4 == 1, 1).otherwise(0)).alias("start"), (3 * k + 3).alias("end")))
    from glyphstream.operators import tokens

    t = table(spark, d, "benchmark").select("item_id", F.when(F.length("text") >= 3, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans")).where(F.size("spans") > 0)
    return t.select("item_id", (F.size("spans") - 1).cast("bigint").alias("boundaries"), tokens.overlaps(F.col("spans")).cast("bigint").alias("intra"))


# ---- embeddings --------------------------------------------------------------------------------------------------------------------


@query("SELECT vec_id // 5 AS token, i AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 4) + 0.0::DOUBLE AS mean FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def embedding_mean_init(spark, d):
    """A new row is the element-wise mean of its constituents' rows (here five base ids each)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("token"), F.posexplode("embedding").alias("p", "x"))
    return e.groupBy("token", (F.col("p") + 1).cast("bigint").alias("pos")).agg((F.round(F.avg(F.col("x").cast("double")), 4) + 0.0).alias("mean"))


@query("SELECT count(*) AS old_rows, 0::BIGINT AS changed, (SELECT count(DISTINCT vec_id // 5) FROM embeddings) AS new_rows FROM embeddings")
def old_rows_unchanged(spark, d):
    """An extended embedding table holds every old row as it was, and the new ones after them."""
    old = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = old.groupBy(F.floor(F.col("vec_id") / 5).alias("t")).agg(F.first("embedding").alias("embedding")).select((F.col("t") + 1_000_000_000).alias("vec_id"), "embedding")
    both = old.union(new)
    changed = old.join(both.withColumnRenamed("embedding", "now"), "vec_id", "left")
    return changed.agg(F.count("*").alias("old_rows"), F.count_if(~F.coalesce(F.col("now") == F.col("embedding"), F.lit(False))).alias("changed")).crossJoin(new.agg(F.count("*").alias("new_rows")))


# ---- plans and reports -------------------------------------------------------------------------------------------------------------


@query("SELECT a AS arm, k, lang, md5(a || k || lang) AS seed FROM (VALUES ('R0'), ('R2')) x(a), (VALUES (0), (1000), (4000), (16000)) y(k), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def run_grid(spark, d):
    """Every arm with every size and language: a cross join of three short lists."""
    arms, ks = spark.createDataFrame([("R0",), ("R2",)], "arm string"), spark.createDataFrame([(0,), (1000,), (4000,), (16000,)], "k int")
    langs = docs(spark, d).where("lang is not null").select("lang").distinct()
    return arms.crossJoin(F.broadcast(ks)).crossJoin(F.broadcast(langs)).withColumn("seed", F.md5(F.concat("arm", F.col("k").cast("string"), "lang").cast("binary")))


@query("""WITH n AS (SELECT sum(len(string_split(text, ' ')) + 2) AS n FROM conversations WHERE text IS NOT NULL), p AS (SELECT (n - 1) // 64 AS n_win, 8 AS batch, 2 AS epochs FROM n)
SELECT n_win::BIGINT AS n_win, (n_win * epochs // batch)::BIGINT AS steps, greatest(0, (n_win * epochs // batch + 5) * batch - n_win * epochs)::BIGINT AS extra, (n_win * epochs // batch * batch * 64)::BIGINT AS tokens, round(6.0::DOUBLE * 1e8 * (n_win * epochs // batch * batch * 64), 1) AS flops FROM p""")
def run_summary(spark, d):
    """Windows, steps, windows that five more steps need, tokens and operations of a run over the stream."""
    n = table(spark, d, "conversations").where("text is not null").agg(F.sum(F.size(F.split("text", " ")) + 2).alias("n"))
    p = n.select(F.floor((F.col("n") - 1) / 64).alias("n_win")).withColumn("steps", F.floor(F.col("n_win") * 2 / 8))
    return p.select("n_win", "steps", F.greatest(F.lit(0), (F.col("steps") + 5) * 8 - F.col("n_win") * 2).cast("bigint").alias("extra"), (F.col("steps") * 8 * 64).alias("tokens"), F.round(F.lit(6e8) * F.col("steps") * 8 * 64, 1).alias("flops"))


@query("WITH " + SCORES_SQL + """, m AS (SELECT lang, unnest(['r0', 'r1', 'r2']) AS arm, unnest([sum(r0) / sum(bytes), sum(r1) / sum(bytes), sum(r2) / sum(bytes)]) AS v FROM s GROUP BY lang)
SELECT lang, coalesce(format('{:.4f}', CAST(max(v) FILTER (WHERE arm = 'r0') AS DOUBLE)), '--') AS r0, coalesce(format('{:.4f}', CAST(max(v) FILTER (WHERE arm = 'r2') AS DOUBLE)), '--') AS r2, coalesce(format('{:.4f}', CAST(max(v) FILTER (WHERE arm = 'r9') AS DOUBLE)), '--') AS r9 FROM m GROUP BY lang""")
def arm_table(spark, d):
    """Results from long to wide, formatted, a placeholder for arms without a run."""
    m = scores(spark, d).groupBy("lang").agg(*(F.round((F.sum(r) / F.sum("bytes")).cast("double"), 12).alias(r) for r in ("r0", "r1", "r2")))
    long = m.select("lang", F.explode(F.array(*(F.struct(F.lit(r).alias("arm"), F.col(r).alias("v")) for r in ("r0", "r1", "r2")))).alias("z")).select("lang", "z.*")
    wide = long.groupBy("lang").pivot("arm", ["r0", "r2", "r9"]).agg(F.max("v"))
    return wide.select("lang", *(F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))), F.lit("--")).alias(c) for c in ("r0", "r2", "r9")))


@query(f"""WITH s AS (SELECT lang, sum({A_TR}) / sum({B_TR}) AS h, sum({A_TR}) / sum(strlen({TR})) AS t FROM documents WHERE lang IS NOT NULL GROUP BY lang), r AS (SELECT lang, h, t, row_number() OVER (ORDER BY h DESC, lang) AS place FROM s)
SELECT place, lang, round(h, 4) AS headroom, round(t, 4) AS tokens_per_byte, CASE WHEN h < 1.15 THEN 'no room' ELSE 'room' END AS kind FROM r""")
def ranked_audit(spark, d):
    """Languages by falling headroom, with labels, as an audit table lists them."""
    t = docs(spark, d).where("lang is not null").select("lang", tr().alias("t"))
    s = t.groupBy("lang").agg(F.sum(X.pretoken_count(F.col("t"), P.PAT_A)).alias("a"), F.sum(X.pretoken_count(F.col("t"), P.PAT_B)).alias("b"), F.sum(F.octet_length("t")).alias("n"))
    h = F.col("a") / F.col("b")
    # one row a language
    return s.select(F.row_number().over(Window.orderBy(F.desc(h), "lang")).alias("place"), "lang", F.round(h, 4).alias("headroom"), F.round(F.col("a") / F.col("n"), 4).alias("tokens_per_byte"), F.when(h < 1.15, "no room").otherwise("room").alias("kind"))


@query("WITH " + SCORES_SQL + """, x AS (SELECT lang, sum(bytes) AS bytes, CAST(sum(r2) AS DOUBLE) / sum(bytes) AS bpb FROM s GROUP BY lang), y AS (SELECT lang, sum(strlen(replace(text, chr(10), ''))) AS bytes FROM documents GROUP BY lang)
SELECT x.lang, CAST(x.bytes AS BIGINT) AS bytes, round(bpb, 6) AS bpb, x.bytes = y.bytes AS sources_agree FROM x JOIN y ON x.lang IS NOT DISTINCT FROM y.lang""")
def joined_sources(spark, d):
    """A table from two sources that must agree on what they share."""
    x = scores(spark, d).groupBy("lang").agg(F.sum("bytes").alias("bytes"), (F.sum("r2").cast("double") / F.sum("bytes")).alias("bpb"))
    y = docs(spark, d).groupBy(F.col("lang").alias("l")).agg(F.sum(F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("b"))
    return x.join(y, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "bytes", r6("bpb"), (F.col("bytes") == F.col("b")).alias("sources_agree"))
