"""Line files, result files and written splits: readers that split large files, and writers that read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions.text import nfc

#: Line ends besides those of the text reader at which Python's splitlines breaks too.
BREAKS = "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, text) of a line file, or of a folder of them in order of name; ids count from 0 without gaps.

    Files are read in blocks by as many tasks; each block numbers its own lines and the blocks' counts are prefix-summed, so no
    task sees a whole file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows = raw.select("f", "b", "m", F.posexplode(F.split("value", BREAKS)).alias("p", "text"))
    counts = rows.groupBy("f", "b").count()
    # one row a block
    base = counts.select("f", "b", F.coalesce(F.sum("count").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("f", "b").orderBy("m", "p")) - 1
    return rows.withColumn("n", inner).join(F.broadcast(base), ["f", "b"]).select((F.col("base") + F.col("n")).alias("line_id"), "text")


def parallel_lines(spark: SparkSession, paths: dict[str, str], split: str) -> DataFrame:
    """(split, lang, sent_id, text): line i of each language's file is sentence i; NFC on load."""
    out = None
    for lang, path in paths.items():
        got = numbered_lines(spark, path).select(F.lit(split).alias("split"), F.lit(lang).alias("lang"), F.col("line_id").alias("sent_id"), nfc(F.col("text")).alias("text"))
        out = got if out is None else out.union(got)
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of any text file in NFC, blank ones dropped."""
    return spark.read.text(path).where("trim(value) <> ''").select(nfc(F.col("value")).alias("text"))


def resolve(spark: SparkSession, name: str, folder: str) -> str:
    """The path of a language code's file in folder if there is one, else name itself as a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return f"{folder}/{name}" if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else name


def results(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result files under folders named <arm>_K<number>, with arm and k from the name, in that order."""
    name = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).json(glob).select("*", F.regexp_extract(name, r"/([^/_]+)_K\d+/", 1).alias("arm"), F.regexp_extract(name, r"_K(\d+)/", 1).cast("int").alias("k"))
    return rows.orderBy("arm", "k")


def registry(spark: SparkSession, entries: list[tuple[str, str]], load: Callable, names: list[str] | None = None) -> DataFrame:
    """(name, path, value, error) of each entry (of the names asked for): what load makes of its path, or why that failed."""
    rows = spark.createDataFrame([e for e in entries if names is None or e[0] in names], "name string, path string")

    @F.udf("struct<value:string,error:string>")
    def tried(path):
        try:
            return str(load(path)), None
        except Exception as e:  # noqa: BLE001  a registry reports what it skips
            return None, type(e).__name__

    return rows.withColumn("r", tried("path")).select("name", "path", "r.value", "r.error")


def write_routed(df: DataFrame, path: str, by: str) -> None:
    """One pass; every value of `by` has a folder of its own."""
    df.write.partitionBy(by).mode("overwrite").parquet(path)


def rewrite_without(df: DataFrame, drop: DataFrame, key: str, path: str) -> DataFrame:
    """A new version of df at path/data without the keys of drop, and its counts as JSON at path/stats, which are returned; the input is never overwritten."""
    df.join(drop.select(key).distinct(), key, "left_anti").write.parquet(f"{path}/data")
    kept = df.sparkSession.read.parquet(f"{path}/data")
    stats = df.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")))
    stats.coalesce(1).write.json(f"{path}/stats")
    return df.sparkSession.read.schema("before bigint, kept bigint, bytes bigint").json(f"{path}/stats")
