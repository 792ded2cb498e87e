"""Secret scan in DataFrame operations only: fixed patterns, and a battery of randomness tests on long tokens.

The patterns (assigned values, access keys, long hex runs) give the base spans. Beside them, every maximal token of 20 or more characters
of [A-Za-z0-9+/_-] that mixes digits with letters is a candidate. Its encoding is inferred (the smallest alphabet that has all
its characters: hex, base32, base36, base62, base64), and three tests ask if it could be uniform noise over that alphabet:
chi-squared of the symbol counts, runs above and below the middle, and lag-1 serial correlation. The candidate's p value is three
times the smallest of the three. Within each stratum of length, over all distinct candidates, the Benjamini-Hochberg procedure
at rate `rate` picks those that are not noise; the others are kept as secrets. Longer tokens have more power, hence strata. What the
procedure controls is the share of true noise among the tokens declared plain, that is, of missed secrets; it says nothing of the
share of plain tokens among those kept, for which corpora offer no null. Spans of equal start are ordered by kind.

Positions come from splitting a text at a pattern and adding up lengths, so they are exact for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import read

#: Fixed patterns. Hex runs and access keys below their least length never match; short assigned values are dropped after matching,
#: for a short match still uses up its text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<s:bigint,o:int,e:bigint,v:string>>"
ALPHABETS = {
    "^[0-9a-f]+$": "0123456789abcdef",
    "^[0-9A-F]+$": "0123456789ABCDEF",
    "^[A-Z2-7]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "^[0-9a-z]+$": "0123456789abcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Z]+$": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "^[0-9A-Za-z]+$": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Za-z+/]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/",
}
STRATA = (20, 24, 32, 40, 64)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _blocked(arr: Column, block: int = 128) -> Column:
    """An array cut into arrays of `block` elements; an empty one gives none."""

    def cut(arr: Column) -> Column:
        starts = F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(arr, i * block + 1, block))

    return _let(arr, cut)


def before(values: Column, start: Column, join) -> Column:
    """For each element of values (an array of bigint) what join makes of start and all elements before it; join is associative.

    A fold that appends copies its array at every step, so folds run over blocks and over the blocks' totals: for n elements about
    n * 64 + (n / 128) ** 2 / 2 copies, which keeps one text with very many matches cheap.
    """

    def running(arr: Column, first: Column) -> Column:
        state = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(arr, state, step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        # a block's total is folded from its own first element on, so join needs no neutral one
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(b, 2, F.size(b)), b[0], join))
        return _let(running(totals, start), lambda firsts: F.flatten(F.zip_with(blocks, firsts, running)))

    return _let(_blocked(values), of_blocks)


def _larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (s, o, e, v): code points, kind's number, value of the group."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(between.alias("b"), whole.alias("m"), values.alias("v"))

    def spans(parts: Column) -> Column:
        steps = F.transform(parts, lambda x: (F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("bigint"))
        placed = F.zip_with(parts, before(steps, F.lit(0), lambda x, y: x + y), lambda x, at: F.struct((at + F.length(x["b"])).alias("s"), F.lit(kind).alias("o"), (at + F.length(x["b"]) + F.length(x["m"])).alias("e"), x["v"].alias("v")))
        return F.slice(placed, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # the last part has no match

    return F.when(text.rlike(pattern), _let(zipped, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    assigns = F.filter(matches(text, ASSIGN, 0, 1), lambda x: F.length(x["v"]) >= 6)
    assigns = F.when(text.contains("=") | text.contains(":"), assigns).otherwise(F.array().cast(SPAN))
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(F.array().cast(SPAN))
    return F.array_sort(F.concat(assigns, access, matches(text, HEX, 2)))


def _upper_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by a fixed rational approximation of the normal integral (error under 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly


def _p_above(z: Column) -> Column:
    return F.when(z >= 0, _upper_tail(z)).otherwise(F.lit(1.0) - _upper_tail(-z))


def p_value(token: Column) -> Column:
    """Combined p value of a token of two or more characters being uniform noise over its inferred alphabet."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    alphabet = F.lit(ALPHABETS[""])
    for pattern, letters in reversed([x for x in ALPHABETS.items() if x[0]]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(letters: Column, x: Column) -> Column:
        a, n = F.length(letters).cast("double"), F.size(x).cast("double")
        counts = F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi2, k = total(counts) * a / n - n, a - 1
        z_chi = (F.pow(chi2 / k, F.lit(1.0 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        return F.least(_let(z_chi, _p_above), 2 * _let(_z_runs(F.transform(x, lambda v: v * 2 >= a), n), _upper_tail), 2 * _let(_let(total(x) / n, lambda mean: _z_lag(F.transform(x, lambda v: v - mean), n)), _upper_tail))

    numbers = lambda letters: F.transform(F.split(token, ""), lambda c: F.instr(letters, c).cast("double") - 1)
    return F.least(F.lit(1.0), 3 * _let(alphabet, lambda letters: _let(numbers(letters), lambda x: tests(letters, x))))


def _neighbours(arr: Column, of) -> Column:
    return F.zip_with(F.slice(arr, 1, F.size(arr) - 1), F.slice(arr, 2, F.size(arr) - 1), of)


def _z_runs(high: Column, n: Column) -> Column:
    """Standard score of the number of runs of values in the upper and the lower half of the alphabet."""
    runs = F.lit(1.0) + F.size(F.filter(_neighbours(high, lambda p, q: p != q), lambda z: z))
    n1 = F.size(F.filter(high, lambda v: v)).cast("double")

    def score(n1: Column) -> Column:
        prod = 2 * n1 * (n - n1)
        spread = prod * (prod - n) / (n * n * (n - 1))
        return F.when(spread > 0, F.abs(runs - prod / n - 1) / F.sqrt(spread)).otherwise(9.0)

    return _let(n1, score)


def _z_lag(centred: Column, n: Column) -> Column:
    """Standard score of the serial correlation at lag one."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    var = total(F.transform(centred, lambda v: v * v))
    return F.when(var > 0, F.abs(total(_neighbours(centred, lambda p, q: p * q)) / var + 1 / n) * F.sqrt(n)).otherwise(9.0)


def _stratum(length: Column) -> Column:
    out = F.lit(len(STRATA))
    for i, top in reversed(list(enumerate(STRATA))):
        out = F.when(length <= top, F.lit(i)).otherwise(out)
    return out


def thresholds(tokens: DataFrame, rate: float = 0.2, bins: int = 400) -> list[float]:
    """Benjamini-Hochberg cut of each length stratum over distinct tokens: p values at or below it are declared not noise.

    p values are counted in bins of 0.05 in -log10, and the procedure is applied at the bins' upper ends; so what is gathered is at
    most strata times bins rows, whatever the corpus.
    """
    level = F.least(F.lit(bins - 1), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-30))) / 0.05)).cast("int")
    rows = tokens.withColumn("p", p_value(F.col("token"))).groupBy(_stratum(F.length("token")).alias("stratum"), level.alias("level")).count().collect()
    cuts = []
    for i in range(len(STRATA) + 1):
        mine = sorted(((r.level, r["count"]) for r in rows if r.stratum == i), reverse=True)
        total, seen, cut = sum(n for _, n in mine), 0, -1.0
        for lv, n in mine:
            seen += n
            top = 10 ** (-0.05 * lv)
            if top <= rate * seen / total:
                cut = top
        cuts.append(cut)
    return cuts


def apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap none of base; both in order of start. Two running extremes over both together decide."""
    far = 1 << 62

    def clear(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["o"] < 3, x["e"]).otherwise(F.lit(-1)).cast("bigint"))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["o"] < 3, -x["s"]).otherwise(F.lit(-far)).cast("bigint"))
        last = before(ends, F.lit(-1), _larger)  # end of the base spans that start before
        following = F.reverse(before(starts, F.lit(-far), _larger))  # start, negated, of the next base span
        placed = F.arrays_zip(both.alias("x"), last.alias("a"), following.alias("b"))
        return F.transform(F.filter(placed, lambda z: (z["x"]["o"] == 3) & (z["a"] <= z["x"]["s"]) & (-z["b"] >= z["x"]["e"])), lambda z: z["x"])

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(F.array_sort(F.concat(spans, base)), clear))


def scan(docs: DataFrame, rate: float = 0.2, into: str = "found") -> DataFrame:
    """docs with a column `into`: base spans and the spans of tokens that pass for noise, by start, then kind.

    Null and empty texts have no spans. A column of that name is replaced, other columns stay. Tokens that touch a base span add
    nothing. The cuts come from the distinct candidate tokens of all of docs; a table without candidates has none to judge.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    candidates = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token")).where("token <> ''").distinct()
    cuts = thresholds(candidates, rate)
    cut = lambda v: F.element_at(F.array(*map(F.lit, cuts)), _stratum(F.length(v)) + 1)

    def noise(found: Column) -> Column:
        return F.filter(apart(matches(text, TOKEN, 3), found), lambda x: p_value(x["v"]) > cut(x["v"]))

    return docs.withColumn(into, _let(base_spans(text), lambda found: F.array_sort(F.concat(found, noise(found)))))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with every span, or run of overlapping spans, replaced by mask; spans in order of start.

    Pieces are cut from stretches of the text that hold a block of spans each, for finding a code point means reading from the start.
    """

    def masked(spans: Column) -> Column:
        reached = before(F.transform(spans, lambda x: x["e"]), F.lit(0), _larger)
        gaps = F.filter(F.zip_with(spans, reached, lambda x, at: F.struct(at.alias("a"), x["s"].alias("b"))), lambda g: g["b"] >= g["a"])
        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        cut = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

        def pieces(block: Column) -> Column:
            first, last = block[0]["a"], F.element_at(block, -1)["b"]
            return _let(cut(text, first, last), lambda part: F.array_join(F.transform(block, lambda g: F.concat(cut(part, g["a"] - first, g["b"] - first), F.lit(mask))), ""))

        return F.concat(F.array_join(F.transform(_blocked(gaps), pieces), ""), cut(text, end, F.length(text).cast("bigint")))

    return F.when(F.size(spans) > 0, _let(spans, masked)).otherwise(text)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["o"] == k)).cast("bigint")
    base = F.filter("found", lambda x: x["o"] < 3)
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
    )
