"""Tokens against their text: cuts and integrity, tokens added before pre-tokenization, script fragments, config differences, alignment."""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstream.functions.batches import by_bytes

# The signs that suppress an inherent vowel, by code point.
VIRAMAS = (0x094D, 0x09CD, 0x0A4D, 0x0ACD, 0x0B4D, 0x0BCD, 0x0C4D, 0x0CCD, 0x0D4D, 0x0DCA, 0x0F84, 0x1039, 0x103A, 0x17D2)
# The blocks of each script, first and last code point.
SCRIPTS = {
    "Deva": ((0x0900, 0x097F), (0xA8E0, 0xA8FF)),
    "Beng": ((0x0980, 0x09FF),),
    "Taml": ((0x0B80, 0x0BFF), (0x11FC0, 0x11FFF)),
    "Telu": ((0x0C00, 0x0C7F),),
    "Sinh": ((0x0D80, 0x0DFF), (0x111E0, 0x111FF)),
    "Thai": ((0x0E00, 0x0E7F),),
    "Mymr": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "Ethi": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F), (0x1E7E0, 0x1E7FF)),
    "Hang": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF)),
}


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest moves up from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(moved)}


def id_bytes(config: dict) -> dict[int, bytes]:
    """id -> bytes of a byte-level tokenizer config; added tokens are literal text."""
    letters = byte_of_letter()
    out = {i: bytes(letters[c] for c in t) for t, i in config["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in config.get("added_tokens", [])}


# ---- cuts and integrity ------------------------------------------------------------------------------------------------------------


def cuts(texts: DataFrame, lengths: dict[int, int], text: str = "text", ids: str = "ids", vocabulary: str | dict | None = None) -> DataFrame:
    """texts with starts (code point offset of every token but the first that starts at a code point), intra (tokens that start inside
    one), marks (starts at a combining mark) and breaks (those, and starts of a letter after a virama).

    lengths: bytes of each id. Byte offsets are sums of token lengths, so the cuts are exact. Null texts and ids count as empty.
    With a vocabulary, texts are encoded by it on the way (bpe.encode), so that texts with their ids do not go between two programs.
    """
    import numpy as np

    from glyphstream.operators import bpe

    coded = None
    if vocabulary is not None:
        coded, kept = bpe.encoding(texts, vocabulary, text)
        schema = kept
    else:
        schema = texts.schema

    size = np.zeros(max(lengths, default=0) + 1, np.int64)
    size[list(lengths)] = list(lengths.values())
    sizes = texts.sparkSession.sparkContext.broadcast(size)
    schema = T.StructType([*schema.fields, T.StructField("starts", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.IntegerType()) for c in ("intra", "marks", "breaks"))])

    def kinds(codes):
        """For each code point: is it a mark, a letter, a virama."""
        seen, at = np.unique(codes, return_inverse=True)
        category = [unicodedata.category(chr(c))[0] for c in seen.tolist()]
        return (np.array([k == "M" for k in category], bool)[at], np.array([k == "L" for k in category], bool)[at], np.isin(seen, VIRAMAS)[at])

    def one(t, token_ids):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        at = np.cumsum(sizes.value[np.asarray(token_ids, np.int64)])[:-1]
        at = at[at < len(raw)]
        lead = (raw & 0xC0) != 0x80
        starts = (np.cumsum(lead) - 1)[at[lead[at]]]
        if not len(starts):
            return starts, len(at), 0, 0
        mark, letter, virama = kinds(np.frombuffer(t.encode("utf-32-le"), np.uint32))
        broken = mark[starts] | letter[starts] & virama[starts - 1]
        return starts, len(at) - len(starts), int(mark[starts].sum()), int(broken.sum())

    def run(batches):
        import pyarrow as pa

        for b in (x for whole in (coded(batches) if coded else batches) for x in by_bytes(whole, text)):
            rows = b.column(b.schema.get_field_index(ids))
            flat, size = np.asarray(rows.flatten()), np.asarray(rows.value_lengths().fill_null(0), np.int64)
            got = [one(t, i) for t, i in zip(b.column(b.schema.get_field_index(text)).to_pylist(), np.split(flat, np.cumsum(size)[:-1]))]
            starts = pa.ListArray.from_arrays(np.cumsum([0, *(len(g[0]) for g in got)]).astype(np.int32), pa.array(np.concatenate([np.asarray(g[0], np.int32) for g in got])))
            yield pa.RecordBatch.from_arrays([*b.columns, starts, *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2, 3))], schema.names)

    return texts.mapInArrow(run, schema)


def integrity(cut: DataFrame, *by: str, ids: str = "ids") -> DataFrame:
    """mark_initial by tokens, break_rate and intra_cp by cuts, over all rows of each group; denominators are 1 at least."""
    n_cuts = F.greatest(F.sum(F.size("starts") + F.col("intra")), F.lit(1))
    n_tokens = F.sum(F.greatest(F.size(ids), F.lit(0)))
    rate = lambda c, n: F.round(F.sum(c) / n, 6)
    return cut.groupBy(*by).agg(n_tokens.alias("tokens"), rate("marks", F.greatest(n_tokens, F.lit(1))).alias("mark_initial"), rate("breaks", n_cuts).alias("break_rate"), rate("intra", n_cuts).alias("intra_cp"))


def overlaps(spans: Column) -> Column:
    """Number of spans (start, end), in token order, that start before the end of the one before or where it starts: cuts inside a code point."""
    pairs = F.zip_with(F.slice(spans, 2, F.size(spans)), F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), lambda x, p: (x["start"] < p["end"]) | (x["start"] == p["start"]))
    return F.size(F.filter(pairs, lambda x: x))


# ---- added tokens ------------------------------------------------------------------------------------------------------------------


def added_pattern(tokens: list[str]) -> str:
    """Leftmost-longest alternation: the longest first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(set(tokens) - {""}, key=lambda t: (-len(t), t)))


def added_count(text: Column, tokens: list[str]) -> Column:
    """Number of matches alone: one regular expression in the JVM."""
    return F.regexp_count(text, F.lit(added_pattern(tokens) or r"(?!)"))


def added_matches(text: Column, tokens: list[str], single_word: bool = False, letters: str = r"\w") -> Column:
    """The added tokens that a text gives up before pre-tokenization, in code points, and whether each starts after, or ends before, a
    character of the class letters (a token that brings its own space starts no word inside).

    Matches do not overlap. With single_word a match next to a word character is passed over, and its characters are not searched
    again. One pass over a text, whatever its number of matches; null gives none.
    """
    pattern = added_pattern(tokens) or r"(?!)"

    @F.arrow_udf("array<struct<token:string,start:int,end:int,starts_inside:boolean,ends_inside:boolean>>")
    def found(texts: pa.Array) -> pa.Array:
        from array import array

        import numpy as np
        import regex

        search, near, word = regex.compile(pattern).finditer, regex.compile(letters).match, regex.compile(r"\w").match
        known, which, starts, ends, flags, upto = {}, array("i"), array("i"), array("i"), array("b"), array("i", [0])  # some bytes a match
        for part in by_bytes(pa.record_batch([texts], ["t"]), "t"):
            for t in part.column(0).to_pylist():
                for m in search(t or ""):
                    a, b = m.span()
                    if not single_word or not (a and word(t, a - 1) or word(t, b)):
                        which.append(known.setdefault(m[0], len(known)))
                        starts.append(a)
                        ends.append(b)
                        flags.append(2 * bool(a and near(t, a - 1) and t[a] != " ") + bool(near(t, b)))
                upto.append(len(which))
        ints = lambda x, kind=np.int32: np.array(x, kind)
        token = pa.array(list(known), pa.string()).take(pa.array(ints(which)))
        kinds = ints(flags, np.int8)
        fields = [token, pa.array(ints(starts)), pa.array(ints(ends)), pa.array((kinds & 2) > 0), pa.array((kinds & 1) > 0)]
        rows = pa.StructArray.from_arrays(fields, ["token", "start", "end", "starts_inside", "ends_inside"])
        return pa.ListArray.from_arrays(pa.array(ints(upto)), rows)

    return found(text)


# ---- script fragments --------------------------------------------------------------------------------------------------------------


def _begins(part: bytes, ranges) -> bool:
    """Some character of the ranges has part as a proper beginning: the code points that begin so are one interval."""
    size = 2 if 0xC2 <= part[0] < 0xE0 else 3 if 0xE0 <= part[0] < 0xF0 else 4 if 0xF0 <= part[0] < 0xF5 else 0
    if len(part) >= size or any(not 0x80 <= x < 0xC0 for x in part[1:]):
        return False
    low = part[0] & (0x7F >> size)
    for x in part[1:]:
        low = low << 6 | x & 0x3F
    open_bits = 6 * (size - len(part))
    low, high = max(low << open_bits, (0, 0, 0x80, 0x800, 0x10000)[size]), ((low + 1) << open_bits) - 1
    return any(a <= high and low <= b for a, b in ranges)


def _ends(part: bytes, ranges) -> bool:
    """Some character of the ranges has the continuation bytes part as a proper ending: its low bits are fixed."""
    if len(part) > 3:
        return False
    step, low = 1 << 6 * len(part), 0
    for x in part:
        low = low << 6 | x & 0x3F
    least = (0, 0x80, 0x800, 0x10000)[len(part)]
    return any((first := max(a, least)) + (low - first) % step <= b for a, b in ranges)


RUN = re.compile(rb"[\x80-\xff]+")
CHARS = re.compile(rb"([\x80-\xbf]*)((?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*)(.*)", re.S)


def keeps_script(token: bytes, ranges, fragments: bool = True) -> bool:
    """A token with a whole character of the script; with fragments also one whose every non-ASCII run is an ending (only at the
    token's start), whole characters of the script, and a beginning (only at its end)."""
    within = lambda c: any(a <= ord(c) <= b for a, b in ranges)
    if any(map(within, token.decode(errors="replace"))):
        return True
    runs = list(RUN.finditer(token)) if fragments else []
    for r in runs:
        tail, whole, head = CHARS.fullmatch(r[0]).groups()
        if tail and (r.start() or not _ends(tail, ranges)) or head and (r.end() < len(token) or not _begins(head, ranges)):
            return False
        if not all(map(within, whole.decode(errors="replace"))):
            return False
    return bool(runs)


def keep_fragment(token: Column, script: str, fragments: bool = True) -> Column:
    """keeps_script of a column of bytes; null is kept out."""
    ranges = SCRIPTS[script]

    @F.udf(T.BooleanType(), useArrow=True)
    def keep(b):
        return b is not None and keeps_script(bytes(b), ranges, fragments)

    return keep(token)


def script_tokens(tokens: DataFrame, script: str, fragments: bool = True, col: str = "bytes") -> DataFrame:
    """The rows of a vocabulary table whose bytes pass keeps_script."""
    return tokens.where(keep_fragment(F.col(col), script, fragments))


# ---- configs -----------------------------------------------------------------------------------------------------------------------


def config_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of one tokenizer config: vocabulary (token, id), merges (rank, merge) and added tokens (token, id, special)."""
    merges = [(k, m if isinstance(m, str) else " ".join(m)) for k, m in enumerate(config["model"].get("merges", []))]
    added = [(t["content"], t["id"], bool(t.get("special"))) for t in config.get("added_tokens", [])]
    vocab = list(config["model"]["vocab"].items())
    return spark.createDataFrame(vocab, "token string, id int"), spark.createDataFrame(merges, "rank int, merge string"), spark.createDataFrame(added, "token string, id int, special boolean")


def config_diff(spark: SparkSession, base: dict, other: dict) -> DataFrame:
    """One row: sizes, what of base the other config keeps (strings, ids, merges), and what it adds."""
    (bv, bm, ba), (ov, om, oa) = config_tables(spark, base), config_tables(spark, other)
    both = bv.select("token", F.col("id").alias("b")).join(ov.select("token", F.col("id").alias("o")), "token", "full")
    vocab = both.agg(F.count("b").alias("base_vocab"), F.count("o").alias("other_vocab"), F.count_if(F.col("b").isNotNull() & F.col("o").isNotNull()).alias("strings_kept"), F.count_if(F.col("b") == F.col("o")).alias("ids_kept"), F.count_if(F.col("b").isNull()).alias("new_strings"))
    merges = bm.agg(F.count("*").alias("base_merges")).crossJoin(om.agg(F.count("*").alias("other_merges"))).crossJoin(bm.join(om.select("merge"), "merge", "left_semi").agg(F.count("*").alias("merges_kept")))
    added = oa.join(ba.select("token"), "token", "left_anti").agg(F.count("*").alias("new_added"), F.count_if(~F.col("special")).alias("new_added_ordinary"))
    return vocab.crossJoin(merges).crossJoin(added)


def fingerprint(config: dict) -> str:
    """sha256 of the config as canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


# ---- alignment ---------------------------------------------------------------------------------------------------------------------

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))


@F.udf(OPS, useArrow=True)
def alignment(a, b):
    """Edit operations that turn the first sequence into the second; equal stretches are left out. Null counts as empty."""
    return [dict(zip(("op", "i1", "i2", "j1", "j2"), x)) for x in edits(list(a if a is not None else ()), list(b if b is not None else ()))]


def edits(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """difflib's operations but the equal ones (without its heuristics for long sequences). Only places of a whose element b has are gone over, so
    stretches that share nothing cost nothing, however often the rest is cut."""
    from bisect import bisect_left

    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    rows = [(i, where[x]) for i, x in enumerate(a) if x in where]
    places = [i for i, _ in rows]
    blocks, todo = [(len(a), len(b), 0)], [(0, len(a), 0, len(b))] if rows else []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best, bi, bj, last, runs = 0, alo, blo, -2, {}
        for i, js in rows[bisect_left(places, alo) : bisect_left(places, ahi)]:
            before, runs = runs if i == last + 1 else {}, {}
            last = i
            for j in js[bisect_left(js, blo) :]:
                if j >= bhi:
                    break
                runs[j] = k = before.get(j - 1, 0) + 1
                if k > best:
                    best, bi, bj = k, i - k + 1, j - k + 1
        if best:
            blocks.append((bi, bj, best))
            todo += [(alo, bi, blo, bj), (bi + best, ahi, bj + best, bhi)]
    out, i, j = [], 0, 0
    for x, y, k in sorted(blocks):
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + k, y + k
    return out


def edit_counts(rows: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """(op, a_len, b_len, n): the edits of all rows by kind and lengths, a row counting n times. Each task hands on its sums, not its edits."""
    schema = "op string, a_len int, b_len int, n bigint"

    def run(batches):
        found: dict = {}
        for whole in batches:
            for part in by_bytes(whole, 1, 1 << 14):
                for times, x, y in zip(*(part.column(k).to_pylist() for k in range(3))):
                    for op, i1, i2, j1, j2 in edits(x or [], y or []):
                        at = op, i2 - i1, j2 - j1
                        found[at] = found.get(at, 0) + times
        keys = [list(k) for k in zip(*found)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array(list(found.values()), pa.int64())], ["op", "a_len", "b_len", "n"])

    return rows.select(n, a, b).mapInArrow(run, schema).groupBy("op", "a_len", "b_len").agg(F.sum("n").alias("n"))
