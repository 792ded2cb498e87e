"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret redaction, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the shared folder and reads again
as the next stage's docs. All stages but the last return the columns of documents; columns that the stages add on the way
have names with two leading underscores, so that a score, margin or found of one's own is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.llm.common import crc_mod, materialize, read
from glyphstream.llm.decontam import contaminated
from glyphstream.llm.langid import identify, training
from glyphstream.llm.packing import pack_documents
from glyphstream.llm.secrets import redact, scan
from glyphstream.llm.simhash import near_duplicates

#: No SQL expresses zstandard sizes, SimHash components or the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang and all other columns stay as given."""
    dicts = training(docs, crc_mod(F.col("doc_id"), 3) == 1)
    return identify(spark, docs, dicts, into="__language").where(~F.col("__language.rejected")).drop("__language")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id; where rows of one group share it (or all ids are
    null), the one with the smallest text hash. Rows of other groups that have the same doc_id, or none, stay.
    """
    lowest = near_duplicates(spark, docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = lowest.groupBy("component").agg(F.max("doc_id").alias("id"), F.min("text_hash").alias("hash")).drop("component")
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(kept, rows.doc_id.eqNullSafe(kept.id) & (rows["__h"] == kept.hash), "left_semi")
    # a limit by rank is applied before the shuffle too: repeated rows do not meet in one task
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("text"))).where("__n = 1").drop("__n", "__h")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are told apart by doc_id and text, so null and shared ids do no harm."""
    hits = contaminated(spark, docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.withColumn("__h", F.xxhash64("text"))
    return rows.join(hits, rows.doc_id.eqNullSafe(hits.id) & (rows["__h"] == hits.hash), "left_anti").drop("__h")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the scan finds masked in text; n_chars, where there is one, follows the text."""
    found = scan(docs, into="__found")
    hit = F.size("__found") > 0
    masked = found.withColumn("text", F.when(hit, redact(F.col("text"), F.col("__found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 2048."""
    import public_tokenizers

    return pack_documents(spark, docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("dedup", dedup), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}
