"""Text sources and sinks: JSON strings, token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON string a line, inner newlines kept."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json(F.concat(F.lit('{"t":'), "value", F.lit("}")), "t string")["t"].alias("text"))


def write_json_strings(df: DataFrame, path: str, col: str = "text") -> None:
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(col).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    df.where(F.col(col).isNotNull()).select(quoted.alias("value")).write.text(path)


def u32_rows(df: DataFrame, ids: str = "ids") -> DataFrame:
    """ids (array of token ids) with bytes, their little-endian unsigned 32-bit form."""
    from pyspark.sql.types import BinaryType

    @F.udf(BinaryType(), useArrow=True)
    def packed(x):
        import numpy as np

        return None if x is None else np.asarray(x, "<u4").tobytes()

    return df.withColumn("bytes", packed(F.col(ids)))
