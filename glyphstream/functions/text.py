"""Column functions over texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphstream.functions.batches import by_bytes
from glyphstream.functions.patterns import PAT_A, TRANSLIT_FROM, TRANSLIT_TO


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    from unicodedata import normalize

    # few texts at a time are Python's; the rest stays in Arrow's bytes
    parts = [pa.array([None if t is None else normalize("NFC", t) for t in p.column(0).to_pylist()], pa.string()) for p in by_bytes(pa.record_batch([texts], ["t"]), "t")]
    return pa.concat_arrays(parts) if parts else texts


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in. Plain ASCII and null never reach Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def translit(text: Column) -> Column:
    return F.translate(F.lower(text), TRANSLIT_FROM, TRANSLIT_TO)


def java(pattern: str) -> Column:
    """Unicode classes: without the flag Java's white space is ASCII only. The contractions' apostrophe is looked for once, not seven times."""
    return F.lit("(?U)" + pattern.replace(r"(?i:'s|'t|'re|'ve|'m|'ll|'d)", r"'(?i:s|t|re|ve|m|ll|d)"))


def pretokens(text: Column, pattern: str = PAT_A) -> Column:
    return F.regexp_extract_all(text, java(pattern), F.lit(0))


def pretoken_count(text: Column, pattern: str = PAT_A) -> Column:
    """Number of matches of a pattern that matches no empty string: what stands between them is one part more, and mostly empty, so no pre-token is copied."""
    return F.when(text.isNotNull(), F.size(F.call_function("split", text, java(pattern))) - 1)


def staged(text: Column, patterns: list[str]) -> Column:
    """Each stage splits the pieces of the one before; a piece without a match stays whole; empty pieces go."""

    def stage(pieces: Column, pattern: str) -> Column:
        found = lambda x: F.regexp_extract_all(x, java(pattern), F.lit(0))
        split = F.transform(pieces, lambda x: _let(found(x), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(x))))
        return F.filter(F.flatten(split), lambda x: x != "")

    out = F.array(text)
    for p in patterns:
        out = stage(out, p)
    return out


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words by white space, none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_grams(text: Column, n: int) -> Column:
    """Runs of n words, space-joined; none if there are fewer."""
    none = F.array().cast("array<string>")
    return _let(words(text), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def char_grams(text: Column, n: int, stride: int) -> Column:
    """Substrings of n code points at every stride-th offset; none if the text is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1, F.lit(stride)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def packed_pieces(text: Column, limit: int = 2000) -> Column:
    """Greedy pieces of at most limit UTF-8 bytes, cut at single spaces; a longer word is a piece alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        joined = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        close = (F.octet_length(joined) > limit) & (acc["cur"] != "")
        return F.struct(F.when(close, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(close, w).otherwise(joined).alias("cur"))

    return F.aggregate(F.split(text, " "), start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def strip(text: Column) -> Column:
    """Unicode white space off both ends, as Python's strip does."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def pure_script(text: Column, script: str) -> Column:
    """Characters of one script alone, behind one space at most; script is a character class."""
    return text.rlike(f"^ ?{script}+$")


def valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def lossy_utf8(raw: Column) -> Column:
    """Bytes as text, a replacement sign for what is broken."""
    return F.make_valid_utf8(raw)


def syllable_starts(text: Column, consonants: str = r"[\x{1000}-\x{1021}]", stackers: str = r"[\x{1039}]", silencers: str = r"[\x{1039}\x{103A}]") -> Column:
    """Number of consonants that start a syllable: none behind a stacker, none before a silencer. All three are character classes."""
    return F.regexp_count(text, F.lit(f"(?<!{stackers}){consonants}(?!{silencers})"))


def wrapped(ids: Column, begin: int | None, end: int) -> Column:
    """ids between a begin mark, where there is one, and an end mark."""
    return F.concat(*([F.array(F.lit(begin))] if begin is not None else []), ids, F.array(F.lit(end)))


def fixed_windows(stream: DataFrame, pos: str, length: int) -> DataFrame:
    """stream with window: windows of length + 1 rows by position that overlap by one; an incomplete last one is left out.

    The row that two windows share is repeated, so windows need no join; the stream's length is one number.
    """
    last = stream.agg(F.max(pos).alias("__last"))
    own = F.floor(F.col(pos) / length).cast("bigint")
    at = F.when((F.col(pos) % length == 0) & (F.col(pos) > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = stream.withColumn("window", F.explode(at))
    return rows.join(F.broadcast(last), (F.col("window") + 1) * length <= F.col("__last")).drop("__last")
