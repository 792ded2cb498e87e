"""Corpus preparation over a stream: the length filter, and exact de-duplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.operators.prep import short


def clean_stream(docs: DataFrame, seen_at: str, lateness: str = "10 minutes") -> DataFrame:
    """Long enough documents, the first of equal texts within the watermark."""
    return docs.where(~short(F.col("text"))).withWatermark(seen_at, lateness).withColumn("hash", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["hash"]).drop("hash")
