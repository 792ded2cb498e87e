"""Table functions that give spans of texts: of a pattern's matches, and of a vocabulary's tokens."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_fields = lambda *ints: [T.StructField(c, T.IntegerType()) for c in ints]
REGEX_SPANS = T.StructType([*_fields("idx", "start", "end"), T.StructField("piece", T.StringType())])
TOKEN_SPANS = T.StructType([*_fields("idx", "id", "byte_start", "byte_end", "char_start"), T.StructField("intra", T.BooleanType())])


class RegexSpans:
    """regex_spans(text, pattern) -> (idx, start, end, piece) in code points, for each match; null gives none."""

    def eval(self, text, pattern):
        import regex

        for k, m in enumerate(regex.finditer(pattern, text) if text is not None and pattern is not None else ()):
            yield k, m.start(), m.end(), m[0]


class TokenSpans:
    """token_spans(text, file) -> (idx, id, byte_start, byte_end, char_start, intra) of a byte-level vocabulary's tokens; char_start is that of
    the code point which a token starts in, intra whether it starts inside one.
    """

    def __init__(self):
        self.held = {}

    def _load(self, path):
        if path not in self.held:
            import json

            from tokenizers import Tokenizer

            from glyphstream.operators.tokens import id_bytes

            with open(path) as f:
                self.held[path] = Tokenizer.from_file(path), {i: len(b) for i, b in id_bytes(json.load(f)).items()}
        return self.held[path]

    def eval(self, text, path):
        if text is None:
            return
        coder, size = self._load(path)
        raw, at, char, seen = text.encode(), 0, -1, 0
        for k, i in enumerate(coder.encode(text, add_special_tokens=False).ids):
            while seen <= at and seen < len(raw):
                char += raw[seen] & 0xC0 != 0x80
                seen += 1
            yield k, i, at, at + size[i], char, at < len(raw) and raw[at] & 0xC0 == 0x80
            at += size[i]


def register(spark: SparkSession) -> None:
    """Both functions for LATERAL joins in SQL."""
    spark.udtf.register("regex_spans", F.udtf(RegexSpans, returnType=REGEX_SPANS))
    spark.udtf.register("token_spans", F.udtf(TokenSpans, returnType=TOKEN_SPANS))
