"""Corpus preparation: filters, exact de-duplication, decontamination, held-out and budget splits, funnel counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions.text import char_grams, word_grams


def short(text: Column, least: int = 200) -> Column:
    """Null, or shorter than least code points before any normalization."""
    return F.coalesce(F.length(text), F.lit(0)) < least


def first_of_equal(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """docs with a boolean dup: a row of smaller order has the same text. A null order comes last.

    Only hashes of texts move: groups of two or more are found by a grouped minimum, which copies of one text pre-aggregate for, and joined
    back by hash. Rows of equal text and equal order are none the first: none of them is marked for the other; see distinct_texts.
    """
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    first = docs.select(key.alias("__h"), order).groupBy("__h").agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    later = F.when(F.col(order).isNull(), F.col("__first").isNotNull()).otherwise(F.col(order) > F.col("__first"))
    return docs.withColumn("__h", key).join(first, "__h", "left").withColumn("dup", F.coalesce(later & F.col("__first").isNotNull(), F.lit(False))).drop("__h", "__first")


def distinct_texts(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One whole row for each text, the one of the smallest order (null last); rows that repeat in full count once."""
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__t"), F.struct(F.col(order).isNull(), F.col(order)).alias("__o"))
    return rows.groupBy(F.sha2("__t", 256)).agg(F.min_by("__row", "__o").alias("__row")).select("__row.*")


def _with_grams(docs: DataFrame, grams: Column, against: DataFrame, key: str, text: str, small: int = 1_000_000) -> DataFrame:
    """docs with contaminated. Grams meet as 128 bits of hashes; the other side goes to every task if it has at most `small`, and is
    shuffled if not. Rows are told apart by key and text, so null and shared keys do no harm, and texts do not move with grams.
    """
    hashes = lambda g: F.struct(F.xxhash64(g).alias("h"), F.xxhash64(g, F.lit(1)).alias("g"))
    rows = docs.withColumn("__t", F.xxhash64(text))
    mine = rows.select(key, "__t", F.explode(F.transform(grams, hashes)).alias("z")).select(F.col(key).alias("__k"), F.col("__t").alias("__u"), "z.h", "z.g")
    theirs = against.select(hashes(F.col("gram")).alias("z")).select("z.h", "z.g").distinct()
    hits = mine.join(F.broadcast(theirs) if theirs.count() <= small else theirs, ["h", "g"], "left_semi").select("__k", "__u").distinct().withColumn("contaminated", F.lit(True))
    met = rows.join(hits, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__u")), "left")
    return met.withColumn("contaminated", F.coalesce("contaminated", F.lit(False))).drop("__t", "__k", "__u")


def word_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """docs with contaminated: shares a run of n words with the benchmark."""
    return _with_grams(docs, word_grams(F.col("text"), n), benchmark.select(F.explode(word_grams(F.col("text"), n)).alias("gram")), key, "text")


def char_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 50, stride: int = 25, key: str = "doc_id") -> DataFrame:
    """The same by runs of n characters: every offset of the benchmark, every stride-th of a document."""
    return _with_grams(docs, char_grams(F.col("text"), n, stride), benchmark.select(F.explode(char_grams(F.col("text"), n, 1)).alias("gram")), key, "text")


def running(df: DataFrame, size: str, order: str, by: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """df with before: the sum of size over earlier rows by a numeric order, within groups of `by`; a null order comes last.

    Rows fall into ranges of the order between its quantiles; sums of ranges are prefix-summed, then rows within each range. So no task
    takes all rows, however ids are spread, nor all of one large group.
    """
    by = by or []
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.002)))
    low = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("__r", F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(low))
    sums = cut.groupBy(*by, "__r").agg(F.sum(size).alias("__s"))
    up = lambda *cols: Window.partitionBy(*by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__b", F.coalesce(F.sum("__s").over(up("__r")), F.lit(0)))
    base = base.select(*(F.col(x).alias(f"__{x}") for x in by), F.col("__r").alias("__q"), "__b")
    inner = F.sum(size).over(Window.partitionBy(*by, "__r").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("__r") == F.col("__q")
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    met = cut.withColumn("before", F.coalesce(inner, F.lit(0))).join(base if by else F.broadcast(base), same)  # without `by` at most buckets + 1 rows
    return met.withColumn("before", F.col("before") + F.col("__b")).drop("__r", "__q", "__b", *(f"__{x}" for x in by))


def within_budget(df: DataFrame, size: str, order: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order until their sizes reach the budget; the row that crosses it is kept."""
    return running(df, size, order, by).where(F.col("before") < budget).drop("before")


def held_out_split(df: DataFrame, size: str, order: str, held: int, budget: int) -> DataFrame:
    """df with split: held until their sizes reach held, then train until budget, then out."""
    first = running(df, size, order).withColumn("__held", F.col("before") < held).drop("before")
    rest = first.withColumn("__size", F.when(F.col("__held"), 0).otherwise(F.col(size)))
    out = running(rest, "__size", order)
    return out.withColumn("split", F.when(F.col("__held"), "held").when(F.col("before") < budget, "train").otherwise("out")).drop("__held", "__size", "before")
