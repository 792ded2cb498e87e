"""The registered queries and, for those that SQL can express, the SQL that DuckDB runs.

The tables hold Latin text without combining marks, so queries about marks read derived text: lower case with letters replaced by
Devanagari vowel signs and letters. Scores of pieces are made from lengths: they exercise the statistics, not a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions import patterns as P
from glyphstream.functions import text as X
from glyphstream.operators import bpe, prep, stats, tokens

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ratio(a, b, digits: int = 6):
    return F.round(a / b, digits)


TR = f"translate(lower(text), '{P.TRANSLIT_FROM}', '{P.TRANSLIT_TO}')"
A_RAW, B_RAW = P.duckdb_count("text", P.PAT_A), P.duckdb_count("text", P.PAT_B)
A_TR, B_TR = P.duckdb_count(TR, P.PAT_A), P.duckdb_count(TR, P.PAT_B)
tr = lambda: X.translit(F.col("text"))


# ---- pre-token floors --------------------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT lang, strlen(text) AS bytes, length(text) AS chars, {A_TR} AS a, {B_TR} AS b, len(regexp_extract_all({TR}, '\\p{{M}}')) AS m, length({TR}) AS tc FROM documents)
SELECT lang, count(*) AS docs, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(a) AS BIGINT) AS floor_a, CAST(sum(b) AS BIGINT) AS floor_b, round(sum(a) / sum(b), 6) AS headroom, round(sum(m) / sum(tc), 6) AS mark_density FROM c GROUP BY lang""")
def floor_by_lang(spark, d):
    """Documents, bytes, floors under both patterns, headroom and mark density of the derived text, one scan and one aggregate."""
    c = docs(spark, d).select("lang", F.octet_length("text").alias("bytes"), tr().alias("t"))
    c = c.select("lang", "bytes", X.pretoken_count(F.col("t"), P.PAT_A).alias("a"), X.pretoken_count(F.col("t"), P.PAT_B).alias("b"), F.regexp_count("t", F.lit(r"\p{M}")).alias("m"), F.length("t").alias("tc"))
    return c.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.sum("a").alias("floor_a"), F.sum("b").alias("floor_b"), ratio(F.sum("a"), F.sum("b")).alias("headroom"), ratio(F.sum("m"), F.sum("tc")).alias("mark_density"))


@query(f"SELECT CAST(sum({A_RAW}) AS BIGINT) AS floor_a, CAST(sum({B_RAW}) AS BIGINT) AS floor_b, sum(CASE WHEN {A_RAW} <> {B_RAW} THEN 1 ELSE 0 END)::BIGINT AS differing FROM documents")
def regex_negative_control(spark, d):
    """Text without marks must cost the same under both patterns."""
    c = docs(spark, d).select(X.pretoken_count(F.col("text"), P.PAT_A).alias("a"), X.pretoken_count(F.col("text"), P.PAT_B).alias("b"))
    return c.agg(F.sum("a").cast("bigint").alias("floor_a"), F.sum("b").cast("bigint").alias("floor_b"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


@query(f"SELECT lang, round(sum({A_TR}) / sum({B_TR}), 6) AS headroom, sum({A_TR}) / sum({B_TR}) < 1.15 AS no_room FROM documents GROUP BY lang")
def headroom_by_lang(spark, d):
    c = docs(spark, d).select("lang", X.pretoken_count(tr(), P.PAT_A).alias("a"), X.pretoken_count(tr(), P.PAT_B).alias("b"))
    return c.groupBy("lang").agg(ratio(F.sum("a"), F.sum("b")).alias("headroom"), (F.sum("a") / F.sum("b") < 1.15).alias("no_room"))


@query(f"SELECT lang, round(sum(len(regexp_extract_all({TR}, '\\p{{M}}'))) / sum(length({TR})), 6) AS mark_density FROM documents GROUP BY lang")
def mark_density(spark, d):
    return docs(spark, d).select("lang", tr().alias("t")).groupBy("lang").agg(ratio(F.sum(F.regexp_count("t", F.lit(r"\p{M}"))), F.sum(F.length("t"))).alias("mark_density"))


WORDS = "SELECT doc_id, lang, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM documents"


def word_rows(spark, d):
    return docs(spark, d).select("doc_id", "lang", F.explode(X.words(F.col("text"))).alias("w"))


@query(f"WITH t AS ({WORDS}) SELECT w, count(*) AS n FROM t WHERE w <> '' GROUP BY w")
def type_counts(spark, d):
    """The one heavy shuffle of vocabulary work: distinct types with counts, partially aggregated before it."""
    return word_rows(spark, d).groupBy("w").agg(F.count("*").alias("n"))


@query(f"""WITH t AS ({WORDS}), c AS (SELECT w, count(*) AS n FROM t WHERE w <> '' GROUP BY w),
r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, w) / (SELECT sum(n) FROM c) AS share FROM c)
SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, (count(*) FILTER (WHERE share < 0.99) + 1)::BIGINT AS types_99, (count(*) FILTER (WHERE share < 0.999) + 1)::BIGINT AS types_999 FROM r""")
def coverage_rank(spark, d):
    """How many of the most frequent types reach 99 % and 99.9 % of tokens; the order within one count does not matter, so counts of counts do."""
    by_n = word_rows(spark, d).groupBy("w").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    total = by_n.agg(F.sum("k").alias("types"), F.sum(F.col("n") * F.col("k")).alias("tokens"))
    upto = by_n.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("k")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = lambda s: F.sum(F.greatest(F.lit(0), F.least("k", F.ceil((F.lit(s) * F.col("tokens") - F.col("before")) / F.col("n")) - 1))) + 1
    return upto.crossJoin(F.broadcast(total)).groupBy("types", "tokens").agg(below(0.99).cast("bigint").alias("types_99"), below(0.999).cast("bigint").alias("types_999"))


@query("""WITH t AS (SELECT string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT unnest(list_zip(w[1:len(w)-1], w[2:])) AS z FROM t WHERE len(w) > 1)
SELECT z[1] AS a, z[2] AS b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5""")
def word_bigrams(spark, d):
    """Adjacent pairs that occur five times or more, not across documents."""
    w = docs(spark, d).select(X.words(F.col("text")).alias("w")).where(F.size("w") > 1)
    pair = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return w.select(F.explode(pair).alias("z")).groupBy("z.a", "z.b").agg(F.count("*").alias("n")).where("n >= 5")


@query(f"""WITH t AS ({WORDS}), r AS (SELECT DISTINCT w FROM t WHERE doc_id % 2 = 0), e AS (SELECT lang, w, count(*) AS n FROM t WHERE doc_id % 2 = 1 AND w <> '' GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN r.w IS NULL THEN n ELSE 0 END) AS BIGINT) AS unseen, count(*) AS types, count(*) FILTER (WHERE r.w IS NULL) AS unseen_types FROM e LEFT JOIN r ON e.w = r.w GROUP BY lang""")
def unseen_rates(spark, d):
    """Tokens and types of odd documents that even ones lack. Both sides are aggregated to types before they meet."""
    t = word_rows(spark, d)
    seen = t.where("doc_id % 2 = 0").select("w").distinct().withColumn("s", F.lit(1))
    mine = t.where("doc_id % 2 = 1").groupBy("lang", "w").agg(F.count("*").alias("n"))
    return mine.join(seen, "w", "left").groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("s").isNull(), F.col("n")).otherwise(0)).alias("unseen"), F.count("*").alias("types"), F.count_if(F.col("s").isNull()).alias("unseen_types"))


# ---- corpus preparation ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NULL OR length(text) < 200")
def prep_short(spark, d):
    return docs(spark, d).where(prep.short(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT lang, count(*) AS docs, count(*) FILTER (WHERE nfc_normalize(replace(text, 'é', 'e' || chr(769))) = nfc_normalize(text)) AS same, CAST(sum(length(nfc_normalize(replace(text, 'é', 'e' || chr(769))))) AS BIGINT) AS chars FROM documents GROUP BY lang")
def nfc_roundtrip(spark, d):
    """Decomposed text composes back to the original."""
    c = docs(spark, d).select("lang", "text", X.nfc(F.replace(F.col("text"), F.lit("é"), F.lit("é"))).alias("n"))
    return c.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("n") == F.col("text")).alias("same"), F.sum(F.length("n")).alias("chars"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM documents")
def prep_dedup_exact(spark, d):
    return prep.first_of_equal(docs(spark, d).select("doc_id", "text")).select("doc_id", "dup")


GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"


def _gram_sql(n: int) -> str:
    g = GRAMS.format(n=n)
    split = "string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"
    return f"""WITH b AS (SELECT DISTINCT unnest({g}) AS gram FROM (SELECT {split} AS w FROM benchmark) WHERE len(w) >= {n}),
e AS (SELECT doc_id, unnest({g}) AS gram FROM (SELECT doc_id, {split} AS w FROM documents) WHERE len(w) >= {n}), h AS (SELECT DISTINCT doc_id FROM e SEMI JOIN b USING (gram))"""


@query(_gram_sql(10) + " SELECT doc_id FROM h")
def decontam_ngram10(spark, d):
    return prep.word_contaminated(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark")).where("contaminated").select("doc_id")


@query("""WITH b AS (SELECT DISTINCT unnest(list_transform(range(1, length(text) - 48), lambda i: substr(text, i, 50))) AS gram FROM benchmark WHERE length(text) >= 50),
e AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 48, 25), lambda i: substr(text, i, 50))) AS gram FROM documents WHERE length(text) >= 50)
SELECT DISTINCT doc_id FROM e SEMI JOIN b USING (gram)""")
def decontam_char50(spark, d):
    return prep.char_contaminated(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark")).where("contaminated").select("doc_id")


FUNNEL = _gram_sql(10) + """, f AS (SELECT lang, source, strlen(text) AS bytes, length(text) < 200 AS short,
row_number() OVER (PARTITION BY length(text) < 200, text ORDER BY doc_id) > 1 AS dup, doc_id IN (SELECT doc_id FROM h) AS contam FROM documents)
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE short) AS short, count(*) FILTER (WHERE NOT short AND dup) AS dup,
count(*) FILTER (WHERE NOT short AND NOT dup AND contam) AS contam, count(*) FILTER (WHERE NOT short AND NOT dup AND NOT contam) AS kept,
CAST(coalesce(sum(bytes) FILTER (WHERE NOT short AND NOT dup AND NOT contam), 0) AS BIGINT) AS bytes FROM f GROUP BY lang"""


@query(FUNNEL)
def prep_funnel(spark, d):
    """One reason per document, the first that applies: short, dup, contam; a contaminated text still makes its later copies dups."""
    c = docs(spark, d).select("doc_id", "lang", "text", prep.short(F.col("text")).alias("short"))
    long = prep.first_of_equal(c.where("not short"))
    marked = prep.word_contaminated(long, table(spark, d, "benchmark"))
    reason = F.when(F.col("dup"), "dup").when(F.col("contaminated"), "contam").otherwise("kept")
    all_ = marked.select("lang", reason.alias("r"), F.octet_length("text").alias("b")).union(c.where("short").select("lang", F.lit("short"), F.octet_length("text")))
    n = lambda x: F.count_if(F.col("r") == x).alias(x)
    return all_.groupBy("lang").agg(F.count("*").alias("docs"), n("short"), n("dup"), n("contam"), n("kept"), F.sum(F.when(F.col("r") == "kept", F.col("b")).otherwise(0)).cast("bigint").alias("bytes"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id) - strlen(text) AS before FROM documents) WHERE before < 50000")
def budget_prefix(spark, d):
    """Per language, documents in order until 50,000 bytes; the crossing one is kept."""
    return prep.within_budget(docs(spark, d).select("doc_id", "lang", F.octet_length("text").alias("bytes")), "bytes", "doc_id", 50_000, ["lang"]).select("doc_id", "lang")


@query("""WITH a AS (SELECT doc_id, strlen(text) AS b, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before FROM documents),
h AS (SELECT doc_id, b, before < 100000 AS held FROM a), t AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE b END) OVER (ORDER BY doc_id) - CASE WHEN held THEN 0 ELSE b END AS rest FROM h)
SELECT doc_id, CASE WHEN held THEN 'held' WHEN rest < 500000 THEN 'train' ELSE 'out' END AS split FROM t""")
def heldout_split(spark, d):
    return prep.held_out_split(docs(spark, d).select("doc_id", F.octet_length("text").alias("bytes")), "bytes", "doc_id", 100_000, 500_000).select("doc_id", "split")


@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS newlines FROM documents GROUP BY lang")
def flatten_newlines(spark, d):
    """Newline-flattening keeps every length and turns each newline into a space."""
    c = docs(spark, d).select("lang", "text", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("t"))
    return c.groupBy("lang").agg(F.sum(F.octet_length("t")).alias("bytes"), F.sum(F.length("t")).alias("chars"), F.sum(F.regexp_count("text", F.lit("\n"))).cast("bigint").alias("newlines"))


# ---- metrics -----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT lang, sum({B_RAW}) AS te, sum({A_TR}) AS a, sum({B_TR}) AS b, sum(strlen({TR})) AS bytes, sum(length({TR})) AS chars FROM documents GROUP BY lang)
SELECT lang, round(a / te, 6) AS premium_a, round(b / te, 6) AS premium_b, round(a / b, 6) AS regex_factor, round(a / bytes, 6) AS tokens_per_byte_a, round(bytes / b, 6) AS bytes_per_token_b, CAST(chars AS BIGINT) AS chars FROM s""")
def premium_decomposition(spark, d):
    """Derived text against the same documents' raw text: premiums under both patterns and their ratio, the regex factor."""
    c = docs(spark, d).select("lang", X.pretoken_count(F.col("text"), P.PAT_B).alias("te"), tr().alias("t"))
    s = c.groupBy("lang").agg(F.sum("te").alias("te"), F.sum(X.pretoken_count(F.col("t"), P.PAT_A)).alias("a"), F.sum(X.pretoken_count(F.col("t"), P.PAT_B)).alias("b"), F.sum(F.octet_length("t")).alias("bytes"), F.sum(F.length("t")).alias("chars"))
    return s.select("lang", ratio(F.col("a"), F.col("te")).alias("premium_a"), ratio(F.col("b"), F.col("te")).alias("premium_b"), ratio(F.col("a"), F.col("b")).alias("regex_factor"), ratio(F.col("a"), F.col("bytes")).alias("tokens_per_byte_a"), ratio(F.col("bytes"), F.col("b")).alias("bytes_per_token_b"), F.col("chars").cast("bigint").alias("chars"))


# ---- pieces, scores, resampling ----------------------------------------------------------------------------------------------------

PIECES_SQL = "q AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, lang, unnest(range(0, len(l))) AS piece_id, unnest(l) AS x FROM q), p AS (SELECT doc_id, lang, piece_id, strlen(x) AS bytes FROM u WHERE x <> '')"
SCORES_SQL = PIECES_SQL + ", s AS (SELECT *, bytes * 0.95::DOUBLE + (piece_id % 7) * 0.5::DOUBLE AS r0, bytes * 0.93::DOUBLE + (doc_id % 5) * 0.4::DOUBLE AS r1, bytes * 0.90::DOUBLE + (piece_id % 3) * 0.3::DOUBLE AS r2 FROM p)"


def pieces(spark, d):
    return docs(spark, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("piece_id", "x")).where("x <> ''").select("doc_id", "lang", F.col("piece_id").cast("bigint").alias("piece_id"), F.octet_length("x").cast("bigint").alias("bytes"))


def scores(spark, d):
    return pieces(spark, d).withColumns({"r0": F.col("bytes") * 0.95 + F.col("piece_id") % 7 * 0.5, "r1": F.col("bytes") * 0.93 + F.col("doc_id") % 5 * 0.4, "r2": F.col("bytes") * 0.90 + F.col("piece_id") % 3 * 0.3})


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: {'done': []::BIGINT[], 'cur': strlen(x)::BIGINT}) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(w, lambda a, x: {'done': CASE WHEN a.cur <> 0 AND a.cur + 1 + x.cur > 2000 THEN list_append(a.done, a.cur) ELSE a.done END, 'cur': CASE WHEN a.cur = 0 OR a.cur + 1 + x.cur > 2000 THEN x.cur ELSE a.cur + 1 + x.cur END}) AS s FROM w),
p AS (SELECT doc_id, CASE WHEN s.cur = 0 THEN s.done ELSE list_append(s.done, s.cur) END AS l FROM f)
SELECT doc_id, unnest(range(len(l)))::INT AS piece_id, unnest(l)::INT AS bytes FROM p""")
def piece_packing(spark, d):
    """Greedy pieces of at most 2,000 bytes."""
    c = docs(spark, d).select("doc_id", F.posexplode(X.packed_pieces(F.col("text"))).alias("piece_id", "piece"))
    return c.select("doc_id", "piece_id", F.octet_length("piece").alias("bytes"))


@query("WITH " + SCORES_SQL + " SELECT lang, round(CAST(sum(r0) / sum(bytes) AS DOUBLE), 6) AS r0, round(CAST(sum(r1) / sum(bytes) AS DOUBLE), 6) AS r1, round(CAST(sum(r2) / sum(bytes) AS DOUBLE), 6) AS r2 FROM s GROUP BY lang")
def bpb_by_arm(spark, d):
    return scores(spark, d).groupBy("lang").agg(*(F.round((F.sum(r) / F.sum("bytes")).cast("double"), 6).alias(r) for r in ("r0", "r1", "r2")))


WEIGHT_SQL = "CASE " + " ".join(f"WHEN u < {top} THEN {k}" for k, top in enumerate(stats.STEPS)) + f" ELSE {len(stats.STEPS)} END"


def boot_sql(units: str, key: str, top: str, bottom: str, replicates: int, by: str = "") -> str:
    """CTE bodies boot (by, estimate, units, lo, hi) of a table of units, in the order that they need."""
    g, g2 = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"p.{by} IS NOT DISTINCT FROM c.{by}" if by else "true"
    return f"""{units}_h AS (SELECT {g}{top}, {bottom}, blk, md5(concat_ws(':', blk, CAST({key} AS VARCHAR))) AS h FROM {units}, range({(replicates - 1) // 4 + 1}) r(blk)),
{units}_u AS (SELECT {g}{top}, {bottom}, blk * 4 + q AS b, ('0x' || substr(h, 8 * q + 1, 8))::BIGINT AS u FROM {units}_h, range(4) r(q)),
{units}_w AS (SELECT *, {WEIGHT_SQL} AS w FROM {units}_u WHERE b < {replicates}),
{units}_r AS (SELECT {g}b, CAST(sum({top} * w) / sum({bottom} * w) AS DOUBLE) AS r FROM {units}_w WHERE w > 0 GROUP BY {g}b),
{units}_boot AS (SELECT p.*, lo, hi FROM (SELECT {g}CAST(sum({top}) / sum({bottom}) AS DOUBLE) AS estimate, count(*) AS units FROM {units} {g2}) p JOIN (SELECT {g}quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM {units}_r {g2}) c ON {on})"""


@query("WITH " + SCORES_SQL + ", c AS (SELECT doc_id, CAST(sum(r2 - r0) AS DOUBLE) AS d, sum(bytes) AS bytes FROM s GROUP BY doc_id), " + boot_sql("c", "doc_id", "d", "bytes", 2000) + " SELECT round(estimate, 6) AS estimate, units, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c_boot")
def bootstrap_clustered(spark, d):
    """Difference of two arms' bits per byte, resampled 2,000 times by document: pieces are summed to documents before anything is drawn."""
    c = scores(spark, d).groupBy("doc_id").agg(F.sum(F.col("r2") - F.col("r0")).cast("double").alias("d"), F.sum("bytes").alias("bytes"))
    r = stats.bootstrap_ratio(c, "d", "bytes", "doc_id", 2000)
    return r.select(F.round("estimate", 6).alias("estimate"), "units", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query()
def bootstrap_exact(spark, d):
    """The same interval by language with numpy's generator, as published protocols draw it."""
    c = scores(spark, d).groupBy("lang", "doc_id").agg(F.sum(F.col("r2") - F.col("r0")).cast("double").alias("d"), F.sum("bytes").alias("bytes"))
    return stats.bootstrap_exact(c, "lang", "d", "bytes", "doc_id", 2000)


@query("""SELECT id, CASE WHEN hi < 0 THEN 'better' WHEN hi < 0.01 THEN 'non-inferior' WHEN lo > 0 THEN 'worse' ELSE 'no detectable difference' END AS verdict
FROM (VALUES (1, -0.02, -0.01), (2, -0.01, 0.0), (3, 0.004, 0.007), (4, 0.02, 0.03), (5, -0.02, 0.02), (6, 0.0, 0.02), (7, 0.001, 0.01)) AS t(id, lo, hi)""")
def verdicts(spark, d):
    rows = [(1, -0.02, -0.01), (2, -0.01, 0.0), (3, 0.004, 0.007), (4, 0.02, 0.03), (5, -0.02, 0.02), (6, 0.0, 0.02), (7, 0.001, 0.01)]
    return spark.createDataFrame(rows, "id int, lo double, hi double").select("id", stats.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query("WITH " + SCORES_SQL + """, m AS (SELECT lang, CAST(bytes AS DOUBLE) AS bytes, CAST(r0 AS DOUBLE) / 100 AS a, CASE WHEN r0 = r1 THEN NULL ELSE CAST(r1 AS DOUBLE) / 100 END AS b FROM s),
t AS (SELECT lang, bytes, a, b, CASE WHEN b IS NULL THEN a ELSE least(a, b) - ln(1 + exp(-abs(a - b))) END AS joint FROM m)
SELECT lang, round(sum(joint) / ln(2) / sum(bytes), 6) AS bpb, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS alt_wins FROM t GROUP BY lang""")
def two_way_score(spark, d):
    """-ln(e^-a + e^-b) in stable form; identical sequences count once."""
    m = scores(spark, d).select("lang", "bytes", (F.col("r0").cast("double") / 100).alias("a"), F.when(F.col("r0") != F.col("r1"), F.col("r1").cast("double") / 100).alias("b"))
    both = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b") - F.log(1 + F.exp(-F.abs(F.col("a") - F.col("b")))))
    return m.withColumn("both", both).groupBy("lang").agg(F.round(F.sum("both") / F.log(F.lit(2.0)) / F.sum("bytes"), 6).alias("bpb"), F.round(F.avg(F.when(F.col("b") < F.col("a"), 1.0).otherwise(0.0)), 6).alias("alt_wins"))


# ---- vocabulary extension ----------------------------------------------------------------------------------------------------------


def letter_types(spark, d):
    t = word_rows(spark, d).groupBy(F.regexp_replace(F.lower("w"), r"[^\p{L}\p{M}]", "").alias("t")).agg(F.count("*").alias("n")).where("t <> ''")
    return t.select(F.split("t", "").alias("symbols"), "n")


@query(f"""WITH t AS ({WORDS}), c AS (SELECT regexp_replace(lower(w), '[^\\p{{L}}\\p{{M}}]', '', 'g') AS t, count(*) AS n FROM t GROUP BY 1), s AS (SELECT string_split(t, '') AS s, n FROM c WHERE t <> ''),
p AS (SELECT unnest(list_zip(s[1:len(s)-1], s[2:])) AS z, n FROM s WHERE len(s) > 1) SELECT z[1] AS "left", z[2] AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""")
def pair_counts(spark, d):
    """Weighted adjacent-pair counts over distinct types: the first round of merge training."""
    return bpe.pair_counts(letter_types(spark, d))


@query()
def bpe_token_counts(spark, d):
    """Tokens, bytes and losslessness of a published byte-level vocabulary, by language."""
    import public_tokenizers

    e = bpe.encode(docs(spark, d).select("lang", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return e.groupBy("lang").agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"), F.bool_and("lossless").alias("lossless"))


def byte_config() -> dict:
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return json.load(f)


@query()
def token_integrity(spark, d):
    """Where a published vocabulary cuts the derived text, by language: tokens that start with a mark, broken syllables, cut characters."""
    import public_tokenizers

    lengths = {i: len(b) for i, b in tokens.id_bytes(byte_config()).items()}
    return tokens.integrity(tokens.cuts(docs(spark, d).select("lang", tr().alias("text")), lengths, vocabulary=public_tokenizers.path("byte_bpe_50k.json")), "lang")


ADDED = ["in", "ing", "an", "and", "er", "en", " de", " the"]
ADDED_RE = "|".join(sorted(ADDED, key=lambda t: (-len(t), t)))


@query(f"SELECT lang, CAST(coalesce(sum(len(regexp_extract_all(text, '{ADDED_RE}'))), 0) AS BIGINT) AS n FROM documents GROUP BY lang")
def added_token_counts(spark, d):
    """Matches of added tokens, leftmost and longest, by language."""
    return docs(spark, d).groupBy("lang").agg(F.coalesce(F.sum(tokens.added_count(F.col("text"), ADDED)), F.lit(0)).alias("n"))


@query()
def added_token_pathologies(spark, d):
    """Added tokens that begin or end inside a word, by language, with and without the single-word rule."""
    out = None
    for rule in (False, True):
        m = docs(spark, d).select("lang", F.explode(tokens.added_matches(F.col("text"), ADDED, rule, r"\p{L}")).alias("m"))
        got = m.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("m.starts_inside").alias("starts_inside"), F.count_if("m.ends_inside").alias("ends_inside")).withColumn("single_word", F.lit(rule))
        out = got if out is None else out.union(got)
    return out


@query()
def script_fragments(spark, d):
    """Tokens of a published vocabulary that hold a script's characters, or its characters and their pieces."""
    v = spark.createDataFrame(list(tokens.id_bytes(byte_config()).items()), "id int, bytes binary")
    out = None
    for script in ("Deva", "Mymr", "Hang"):
        n = lambda frag: tokens.script_tokens(v, script, frag).agg(F.count("*").alias("with_fragments" if frag else "whole"))  # noqa: B023, E731
        got = n(False).crossJoin(n(True)).select(F.lit(script).alias("script"), "whole", "with_fragments")
        out = got if out is None else out.union(got)
    return out


@query()
def pretok_alignment(spark, d):
    """Edit operations between the two patterns' pre-tokens over the derived text's sentences, by kind and length."""
    s = docs(spark, d).select(F.explode(F.split(tr(), r"[.\n]")).alias("t"))
    s = s.groupBy("t").agg(F.count("*").alias("n")).select("n", X.pretokens(F.col("t"), P.PAT_A).alias("a"), X.pretokens(F.col("t"), P.PAT_B).alias("b")).where("a <> b")
    return tokens.edit_counts(s, "a", "b", "n")


@query("WITH r AS (SELECT n_chars AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE n_chars IS NOT NULL) SELECT count(*) AS ids, CAST(sum(id) AS BIGINT) AS total, CAST(sum(id * (pos % 1009)) AS BIGINT) AS ordered FROM r")
def u32_stream(spark, d):
    """A stream of numbers written in order as unsigned 32-bit files in the shared folder and read back by ranges with their positions."""
    from glyphstream.sources.shared import folder
    from glyphstream.sources.u32 import U32Source, in_order

    spark.dataSource.register(U32Source)
    path = folder(spark, "u32")
    in_order(docs(spark, d).where("n_chars is not null").select(F.col("doc_id").alias("pos"), F.col("n_chars").cast("bigint").alias("id"))).write.format("u32").mode("append").save(path)
    return spark.read.format("u32").load(path).agg(F.count("*").alias("ids"), F.sum("id").alias("total"), F.sum(F.col("id") * (F.col("pos") % 1009)).alias("ordered"))


# ---- token streams -----------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, md5('7:' || role || ':' || conv_id || ':' || turn) AS k FROM conversations")
def interleave_order(spark, d):
    """The sort key of a seeded interleave: order by it."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.concat_ws(":", F.lit("7"), "role", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")).alias("k"))


@query("""WITH w AS (SELECT conv_id, turn, len(string_split(text, ' ')) + 2 AS n FROM conversations)
SELECT conv_id, turn, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY conv_id, turn) - n AS BIGINT) AS pos FROM w""")
def stream_positions(spark, d):
    """Start of each turn in the stream, begin and end marks counted."""
    w = table(spark, d, "conversations").select("conv_id", "turn", (F.size(F.split("text", " ")) + 2).cast("bigint").alias("n"))
    by_conv = w.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = prep.running(by_conv, "n", "conv_id").select("conv_id", F.col("before").alias("base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return w.join(base, "conv_id").select("conv_id", "turn", "n", (F.col("base") + inner).alias("pos"))


@query("SELECT role, count(*) AS turns, CAST(sum(len(string_split(text, ' ')) + 2) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def stream_accounting(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(F.split("text", " ")) + 2).cast("bigint").alias("tokens"))


@query("""SELECT doc_id, s AS "start", least(s + 2048, n) AS stop, CASE WHEN s = 0 THEN 0 ELSE 1024 END AS first FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 1024)) AS s FROM documents)""")
def sliding_score_windows(spark, d):
    """Windows of 2,048 at stride 1,024; each scores only what the one before did not."""
    n = docs(spark, d).select("doc_id", F.length("text").cast("bigint").alias("n")).where("n > 0")
    w = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(1024).cast("bigint"))).alias("start"))
    return w.select("doc_id", "start", F.least(F.col("start") + 2048, F.col("n")).alias("stop"), F.when(F.col("start") == 0, 0).otherwise(1024).alias("first"))


@query("SELECT s AS step, round(CASE WHEN s < 10 THEN 0.001 * (s + 1) / 10 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END, 9) AS lr FROM range(100) r(s)")
def lr_schedule(spark, d):
    s = F.col("step")
    return spark.range(100).select(F.col("id").alias("step")).select("step", F.round(F.when(s < 10, 0.001 * (s + 1) / 10).otherwise(0.001 * (0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * (s - 10) / 90.0)))), 9).alias("lr"))


@query("SELECT s AS step, r AS rank, m AS micro, s * 32 + (m * 4 + r) * 2 AS base FROM range(10) a(s), range(4) b(r), range(4) c(m)")
def step_plan(spark, d):
    """First window of each rank's micro-batch."""
    grid = spark.range(160).select(F.floor(F.col("id") / 16).alias("step"), F.floor(F.col("id") / 4 % 4).alias("rank"), (F.col("id") % 4).alias("micro"))
    return grid.withColumn("base", F.col("step") * 32 + (F.col("micro") * 4 + F.col("rank")) * 2)


# ---- reports -----------------------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr, coalesce(CAST(max(n_chars) FILTER (WHERE lang = 'fr') AS VARCHAR), '--') AS longest_fr FROM documents GROUP BY source")
def audit_pivot(spark, d):
    """Long to wide with a placeholder for missing cells."""
    g = docs(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").cast("string").alias("m"))
    return g.select("source", *(F.coalesce(f"{x}_n", F.lit(0)).alias(x) for x in ("de", "en", "es", "fr")), F.coalesce("fr_m", F.lit("--")).alias("longest_fr"))


@query("SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def stage_table(spark, d):
    return docs(spark, d).rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderpriority, round(avg(d), 6) AS mean, count(*) AS orders FROM (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS d FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def cluster_sums_by_attribute(spark, d):
    """Cluster sums joined with their attributes: lines to orders before the join."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    j = c.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), c.l_orderkey == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.round(F.avg("d"), 6).alias("mean"), F.count("*").alias("orders"))
