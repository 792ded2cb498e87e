"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: whole texts of a bounded, documented sample of its labelled rows (`per_lang` rows chosen by a
hash of id and text), as many as it takes to reach `dict_bytes`. A whole text is cut into blocks, every block is compressed under
each dictionary, and the smallest sum wins. The margin is what the runner-up has more, in bytes, over the square root of the winner's bytes: so
much chance matches alone scatter with length (texts of random letters stay below 0.5 in 19 of 20 cases at any length, and one labelled text
in 200 is below, most of a few words). Texts whose margin is under `narrow`, exact ties above all, are rejected, and so are texts without a
letter, which are `und`.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstream.llm.common import crc_mod, read, small_batches

UND = "und"
WORD = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    """Lower-case words, one space around each: marks and digits, which no language owns, would win matches of their own."""
    return (" " + " ".join(WORD.findall(text.lower())) + " ").encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    """True if a character is a letter by Unicode; number forms such as a half or a Roman numeral sign are none."""
    return any(map(str.isalpha, text))


def draw(key: str, salt: str) -> Column:
    """A number from 0 to 1 by a hash of key and text: rows that share an id, or have none, are drawn each for itself."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), "text", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def sample_by_class(rows: DataFrame, key: str, cls: str, per_class: int) -> tuple[DataFrame, list]:
    """The classes by falling number of rows, and about per_class distinct rows of each, chosen by a hash of key and text.

    The first pass reads only the class column; the second keeps rows whose hash falls below a class's own share. Rows that
    repeat key and text are one row of the sample, so that they cannot swell it. rows: (key, text, cls).
    """
    counts = rows.groupBy(cls).count().orderBy(F.desc("count"), cls).collect()
    if not counts:
        return rows.limit(0), []
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, per_class / r[1])) for r in counts], T.StructType([rows.schema[cls], T.StructField("__share", T.DoubleType())]))
    drawn = rows.join(F.broadcast(shares), cls).where(draw(key, "sample") < F.col("__share")).select(rows.columns)
    return drawn.dropDuplicates([key, "text", cls]), [r[0] for r in counts]


def dictionaries(labelled: DataFrame, per_lang: int = 64, dict_bytes: int = 65_536) -> dict[str, bytes]:
    """labelled (doc_id, text, lang) -> raw-content dictionary of each language, the most frequent first."""
    rows, langs = sample_by_class(labelled.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "text", "lang"), "doc_id", "lang", per_lang)
    part = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("order")).alias("k"), "text")
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(part.collect(), key=lambda r: (r[0], r[1], r[2])):
        mine = texts.setdefault(lang, [])
        if sum(map(len, mine)) < dict_bytes:
            mine.append(letters_of(text))
    return {lang: b"\n".join(texts[lang]) for lang in langs if lang in texts}


class Compressor:
    """One zstandard coder for each language. The greedy strategy with 4-byte matches tells close languages apart better than
    the stronger parsers, whose own literals win over the dictionary's."""

    def __init__(self, dicts: dict[str, bytes], block: int = 8_192):
        import zstandard as z

        self.langs, self.block = list(dicts), block
        how = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=18, hash_log=16, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.coders = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dicts[x], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress for x in self.langs]

    def sizes(self, text: str) -> list[int]:
        raw = letters_of(text)
        parts = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
        return [sum(len(c(p)) for p in parts) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin) of one whole text; a lone language has no runner-up and an infinite margin."""
        if not self.langs or not text or not has_letter(text):
            return UND, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        lang = self.langs[sizes.index(best)]  # ties: the most frequent in training
        if len(sizes) == 1:
            return lang, 1.0, math.inf
        return lang, 1.0 / sum(math.exp(-(s - best) / (1.0 + 0.01 * best)) for s in sizes), (sorted(sizes)[1] - best) / math.sqrt(best)


def identify(spark: SparkSession, docs: DataFrame, dicts: dict[str, bytes], narrow: float = 0.5, into: str | None = None) -> DataFrame:
    """docs with columns lang_pred, score, margin, rejected added, which replace columns of these names; with `into`, as one struct column of that name.

    Null, empty and letter-less texts are `und` and rejected. Repeated rows are judged each; an empty table gives no rows.
    """
    small_batches(spark)
    model = spark.sparkContext.broadcast(dicts)
    kept = [c for c in docs.columns if into or c not in ("lang_pred", "score", "margin", "rejected")]
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*(docs.schema[c] for c in kept), *([T.StructField(into, T.StructType(found))] if into else found)])

    def classify(batches):
        import pyarrow as pa

        coder = Compressor(model.value)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for b in batches:
            told = [(*x, x[0] == UND or x[2] < narrow) for x in map(coder.classify, b.column("text").to_pylist())]
            cols = [pa.array(c, k) for c, k in zip(zip(*told) if told else [()] * 4, kinds)]
            if into:
                cols = [pa.StructArray.from_arrays(cols, [f.name for f in found])]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema.names)

    return docs.select(*kept).mapInArrow(classify, schema)


def training(docs: DataFrame, held_out: Column) -> dict[str, bytes]:
    return dictionaries(docs.where(~held_out).select("doc_id", "text", "lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and letter-less texts are `und` with score 0; ties go to the language with most training rows."""
    docs = read(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    found = identify(spark, docs.select("doc_id", "text"), training(docs, held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
