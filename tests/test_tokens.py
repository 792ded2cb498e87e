"""Token operators against plain versions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphstream.functions import text as X
from glyphstream.operators import bpe, tokens
from glyphstream.plans.catalog import byte_config


def test_cuts_and_integrity(spark):
    import public_tokenizers

    random.seed(21)
    size = tokens.id_bytes(byte_config())
    texts = [None, "", "plain words", "नेपालको सरकार", "က္က ၵ"] + ["".join(random.choices("aé ्ाकख𝄞\n", k=random.randint(1, 40))) for _ in range(80)]
    e = bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    cut = tokens.cuts(e, {i: len(b) for i, b in size.items()})
    rows, sums = cut.collect(), [0, 0, 0, 0]
    for r in rows:
        t, at, starts, intra, marks, breaks = r.text or "", 0, [], 0, 0, 0
        assert b"".join(size[i] for i in r.ids) == t.encode()
        place = {len(t[:k].encode()): k for k in range(len(t))}
        for i in r.ids[:-1]:
            at += len(size[i])
            if at not in place:
                intra += 1
                continue
            k = place[at]
            starts.append(k)
            mark = unicodedata.category(t[k])[0] == "M"
            marks += mark
            breaks += mark or (ord(t[k - 1]) in tokens.VIRAMAS and unicodedata.category(t[k])[0] == "L")
        assert (r.starts, r.intra, r.marks, r.breaks) == (starts, intra, marks, breaks)
        sums = [x + y for x, y in zip(sums, (len(r.ids), marks, breaks, len(starts) + intra))]
    got = tokens.integrity(cut).first()
    assert got.tokens == sums[0] and abs(got.mark_initial - sums[1] / sums[0]) < 1e-6 and abs(got.break_rate - sums[2] / sums[3]) < 1e-6
    assert tokens.integrity(cut.limit(0)).first().break_rate in (None, 0)


def test_added_tokens(spark):
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.models import BPE

    random.seed(22)
    added = ["ab", "abc", "b.", "c", " a", "é"]
    texts = ["", None] + ["".join(random.choices("abcé. ", k=random.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for rule in (False, True):
        coder = Tokenizer(BPE({"a": 0}, []))
        coder.add_tokens([AddedToken(t, single_word=rule, normalized=False) for t in added])
        for r in df.select("t", tokens.added_matches(F.col("t"), added, rule).alias("m"), tokens.added_count(F.col("t"), added).alias("n")).collect():
            enc = coder.encode(r.t or "")
            want = [(coder.id_to_token(i), *o) for i, o in zip(enc.ids, enc.offsets) if i > 0]
            assert [(m.token, m.start, m.end) for m in r.m] == want, r.t
            if not rule and r.t is not None:
                assert r.n == len(want)
    m = df.select(tokens.added_matches(F.lit("xab ab aby"), ["ab"]).alias("m")).first().m
    assert [(x.starts_inside, x.ends_inside) for x in m] == [(True, False), (False, False), (False, True)]
    assert df.select(tokens.added_matches(F.col("t"), []).alias("m")).where("size(m) > 0").count() == 0


@pytest.mark.parametrize("script", ["Deva", "Taml", "Hang"])
def test_fragments_equal_enumeration(script):
    random.seed(23)
    chars = [chr(c).encode() for a, b in tokens.SCRIPTS[script] for c in range(a, b + 1)]
    begin, end, whole = {c[:k] for c in chars for k in range(1, len(c))}, {c[k:] for c in chars for k in range(1, len(c))}, set(chars)
    for _ in range(4000):
        part = bytes(random.choices([*random.choice(chars), 0x80, 0xA4, 0xBF, 0xE0, 0xEA, 0xF0, 0x91], k=random.randint(1, 3)))
        assert tokens._begins(part, tokens.SCRIPTS[script]) == (part in begin) if part[0] >= 0xC0 else True
        if all(0x80 <= x < 0xC0 for x in part):
            assert tokens._ends(part, tokens.SCRIPTS[script]) == (part in end)
    one = random.choice(chars)
    assert tokens.keeps_script(b" " + one, tokens.SCRIPTS[script], False) and one in whole
    assert tokens.keeps_script(one[1:], tokens.SCRIPTS[script]) and not tokens.keeps_script(one[1:], tokens.SCRIPTS[script], False)
    assert tokens.keeps_script(b" " + one[:1], tokens.SCRIPTS[script]) and not tokens.keeps_script(one[:1] + b" ", tokens.SCRIPTS[script])
    assert not tokens.keeps_script(b"abc", tokens.SCRIPTS[script]) and not tokens.keeps_script("é".encode(), tokens.SCRIPTS[script])


def test_config_diff(spark):
    base = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"id": 3, "content": "<s>", "special": True}]}
    other = {"model": {"vocab": {"a": 0, "ab": 5, "q": 6, "b": 1}, "merges": [["a", "b"], ["ab", "q"]]}, "added_tokens": [*base["added_tokens"], {"id": 7, "content": "x"}, {"id": 8, "content": "y", "special": True}]}
    got = tokens.config_diff(spark, base, other).first().asDict()
    assert got == dict(base_vocab=3, other_vocab=4, strings_kept=3, ids_kept=2, new_strings=1, base_merges=1, other_merges=2, merges_kept=1, new_added=2, new_added_ordinary=1)
    assert tokens.fingerprint(base) != tokens.fingerprint(other) == tokens.fingerprint(dict(reversed(other.items())))


def test_alignment_turns_one_into_the_other(spark):
    random.seed(24)
    pairs = [(None, []), (["a"], None)] + [(random.choices("abc", k=random.randint(0, 9)), random.choices("abc", k=random.randint(0, 9))) for _ in range(100)]
    for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").withColumn("o", tokens.alignment("a", "b")).collect():
        a, b, out, at = r.a or [], r.b or [], [], 0
        for o in r.o:
            out += a[at : o.i1] + b[o.j1 : o.j2]
            at = o.i2
        assert out + a[at:] == b


def test_u32_round_trip(spark, tmp_path):
    from glyphstream.sources.u32 import U32Source, in_order

    spark.dataSource.register(U32Source)
    path, ids = f"{tmp_path}/s", [random.randrange(1 << 32) for _ in range(5000)]
    spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "pos long, id long").coalesce(1).write.format("u32").mode("append").save(path)
    got = spark.read.format("u32").option("ids_per_partition", 700).option("ids_per_batch", 64).load(path)
    assert [r.id for r in got.orderBy("pos").collect()] == ids and got.rdd.getNumPartitions() == 8
    spark.range(10).select(F.col("id").alias("pos"), "id").write.format("u32").mode("overwrite").save(path)
    assert sorted(r.id for r in spark.read.format("u32").load(path).collect()) == list(range(10))
    in_order(spark.range(20, 40).select((40 - F.col("id")).alias("pos"), "id").repartition(3)).write.format("u32").mode("append").save(path)
    assert [r.id for r in spark.read.format("u32").load(path).orderBy("pos").collect()][10:] == list(range(39, 19, -1))
    with pytest.raises(Exception, match="ascend by pos"):
        spark.sql("select 0L as pos, id from range(5)").coalesce(1).write.format("u32").mode("append").save(path)
    with pytest.raises(Exception, match="mounted paths"):
        spark.read.format("u32").load("hdfs://nowhere/x").count()
    with pytest.raises(Exception, match="below 2"):
        spark.sql("select 0L as pos, -1L as id").write.format("u32").mode("append").save(path)
    assert spark.read.format("u32").load(path).count() == 30


def test_extended_config_keeps_ids():
    import json

    from tokenizers import Tokenizer

    base, word = byte_config(), "qzxqzjv"
    a = Tokenizer.from_str(json.dumps(base))
    parts = a.encode(word, add_special_tokens=False).tokens
    merges = [("".join(parts[:k]), parts[k]) for k in range(1, len(parts))]
    other = bpe.extended(base, [*merges, ("t", "h")])
    assert other["model"]["vocab"]["<|endoftext|>"] == 50256
    new = [t for t, i in other["model"]["vocab"].items() if i > 50256]
    assert len(merges) > 2 and new == ["".join(m) for m in merges] and [other["model"]["vocab"][t] for t in new] == list(range(50257, 50257 + len(new)))
    b = Tokenizer.from_str(json.dumps(other))
    assert b.encode(word, add_special_tokens=False).tokens == [word] and b.decode(b.encode(word).ids) == word
    assert a.encode("the plain text <|endoftext|>").ids == b.encode("the plain text <|endoftext|>").ids
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.extended(base, [("q", "no such part")])


def test_slices_do_not_change_cuts_matches_or_composition(spark):
    """Texts beyond one slice of bytes, and none at all: the same as one by one, in Arrow arrays of some bytes a match."""
    import re
    import unicodedata

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["नेपालको सरकार e\u0301 ingén " * n for n in (1, 9000, 3, 7000, 0, 20000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    found = df.select("k", tokens.added_matches(F.col("t"), ["in", "ing"]).alias("m"), X.nfc(F.col("t")).alias("c")).collect()
    for r in found:
        t = texts[r.k] or ""
        assert [(m.token, m.start, m.end) for m in r.m] == [(m[0], *m.span()) for m in re.finditer("ing|in", t)]
        assert r.c == (None if texts[r.k] is None else unicodedata.normalize("NFC", t))
    lengths = {i: len(b) for i, b in tokens.id_bytes(byte_config()).items()}
    apart = tokens.cuts(bpe.encode(df, path, "t"), lengths, "t").collect()
    assert sorted(map(str, tokens.cuts(df, lengths, "t", vocabulary=path).collect())) == sorted(map(str, apart))
    schema = df.select(tokens.added_matches(F.col("t"), ["in"]).alias("m"))
    assert "ArrowEvalPython" in schema._jdf.queryExecution().optimizedPlan().toString() and len(apart) == len(texts)


def test_edits_are_difflibs_and_summed_by_task(spark):
    import difflib
    from collections import Counter

    random.seed(8)
    pairs = [("".join(random.choices("abcdxyz"[: random.randint(1, 7)], k=random.randint(0, 30))), "".join(random.choices("abcdefg"[: random.randint(1, 7)], k=random.randint(0, 30)))) for _ in range(1500)]
    want = Counter()
    for a, b in pairs:
        ops = [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
        assert tokens.edits(list(a), list(b)) == ops
        want.update((op, i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in ops for _ in range(3))
    df = spark.createDataFrame([(3, list(a), list(b)) for a, b in pairs], "n long, a array<string>, b array<string>")
    assert {(r.op, r.a_len, r.b_len): r.n for r in tokens.edit_counts(df, "a", "b", "n").collect()} == want


def test_counts_of_pretokens_equal_their_number(spark):
    from glyphstream.functions import patterns as P

    texts = ["it's WE'LL 'x ' '' 'ſ 12345  a\n\n b 　", "", None, "नेपाल's को", "   ", "\n"] + ["".join(random.choices("ab'sSlL 1\n.é्", k=12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (P.PAT_A, P.PAT_B):
        old = F.regexp_extract_all("t", F.lit("(?U)" + p), F.lit(0))
        for r in df.select(X.pretoken_count(F.col("t"), p).alias("n"), X.pretokens(F.col("t"), p).alias("p"), old.alias("o")).collect():
            assert r.p == r.o and r.n == (None if r.o is None else len(r.o))
