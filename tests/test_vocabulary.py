"""Merge training, sweeps and id comparison against plain Python."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from glyphstream.operators import bpe


def plain_training(types, merges, least=2):
    """Count all pairs anew for every merge."""
    types, out = [(list(s), n) for s, n in types], []
    for _ in range(merges):
        count = Counter()
        for s, n in types:
            for pair in zip(s, s[1:]):
                count[pair] += n
        if not count:
            break
        (left, right), n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        out.append((left, right, n))
        new = []
        for s, k in types:
            t, i = [], 0
            while i < len(s):
                hit = s[i : i + 2] == [left, right]
                t.append(left + right if hit else s[i])
                i += 2 if hit else 1
            new.append((t, k))
        types = new
    return out


def some_types(seed, n=300):
    random.seed(seed)
    words = Counter("".join(random.choices("aabbcde", k=random.randint(1, 9))) for _ in range(n))
    return [(list(w), c) for w, c in sorted(words.items())] + [(list("aaaa"), 5), ([], 3)]


def test_training_equals_counting_anew(spark):
    for seed in range(25):
        types = some_types(seed)
        want = plain_training(types, 60)
        assert bpe.train_plain(pa.array([s for s, _ in types], pa.list_(pa.string())), pa.array([n for _, n in types], pa.int64()), 60) == want
    df = spark.createDataFrame(types, "symbols array<string>, n bigint")
    assert bpe.train(spark, df, 60) == want
    assert bpe.train(spark, df, 14, one_task=0) == want[:14]
    assert bpe.train(spark, df.limit(0), 5) == bpe.train(spark, df.limit(0), 5, one_task=-1) == []


def test_tasks_that_train_together_equal_one(spark):
    for seed in range(3):
        types = some_types(seed, 900)
        df = spark.createDataFrame(types, "symbols array<string>, n bigint")
        want = plain_training(types, 80)
        before = spark.sparkContext.statusTracker().getJobIdsForGroup()
        assert bpe.train(spark, df, 80, one_task=10) == want
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before)
        assert jobs < 12  # a job or more for each round of merges before
    assert bpe.train_rounds(spark, df, 6) == want[:6]


def test_two_encodings_side_by_side(spark):
    import public_tokenizers

    from glyphstream.plans.vocabulary import repaired

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t) for k, t in enumerate(["plain words", "नेपालको सरकार", "", None, "x नेपाल " * 20])]
    df = spark.createDataFrame(rows, "k int, text string")
    other = bpe.extended(repaired(), [("à¤", "¨")])
    a, b = bpe.encode(df, path), bpe.encode(df, other)
    want = {r.k: (r.same, r.first_diff) for r in bpe.same_ids(a, b, "k").collect()}
    n = lambda e: {r.k: (len(r.ids), r.lossless) for r in e.collect()}
    got = bpe.compared(df, path, other).collect()
    assert {r.k: (r.same, r.first_diff) for r in got} == want
    assert {r.k: (r.n_two, r.lossless) for r in got} == n(b) and {r.k: r.n_one for r in got} == {k: x for k, (x, _) in n(a).items()}


def test_slices_are_bounded_by_bytes():
    from glyphstream.functions.batches import by_bytes

    texts = ["x" * k for k in (3, 0, 900, 5, 5, 2000)] + [None] + ["y" * 40] * 200
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    parts = [p.column(0).to_pylist() for p in by_bytes(batch, "t", 1000)]
    assert sum(parts, []) == texts and len(parts) > 5
    assert all(sum(len(t or "") for t in p) < 2000 + max(len(t or "") for t in p) for p in parts)


def test_sweep_prefixes(spark):
    types = some_types(9)
    merges = [m[:2] for m in plain_training(types, 40)]

    def length(s, k):
        s = list(s)
        for left, right in merges[:k]:
            t, i = [], 0
            while i < len(s):
                hit = s[i : i + 2] == [left, right]
                t.append(left + right if hit else s[i])
                i += 2 if hit else 1
            s = t
        return len(s)

    sizes = [0, 3, 10, 40]
    got = bpe.sweep(spark.createDataFrame(types, "symbols array<string>, n bigint"), merges, sizes).collect()
    assert sorted((r.symbols, r.lengths) for r in got) == sorted((s, [length(s, k) for k in sizes]) for s, _ in types)


def test_ids_that_differ(spark):
    a = [(1, [1, 2, 3]), (2, [1, 2]), (3, []), (None, [5]), (4, [9])]
    b = [(1, [1, 2, 3]), (2, [1, 2, 7]), (3, [4]), (None, [6]), (4, [8, 1])]
    make = lambda rows: spark.createDataFrame(rows, "k long, ids array<int>")
    got = {r.k: (r.same, r.first_diff) for r in bpe.same_ids(make(a), make(b), "k").collect()}
    assert got == {1: (True, None), 2: (False, 2), 3: (False, 0), None: (False, 0), 4: (False, 0)}


def test_extended_vocabulary_encodes_as_its_merges_say(spark, tmp_path):
    import public_tokenizers

    from glyphstream.functions import patterns as P
    from glyphstream.plans.catalog import byte_config
    from glyphstream.plans.vocabulary import repaired

    path = public_tokenizers.path("byte_bpe_50k.json")
    spelled = bpe.split_by(byte_config(), public_tokenizers.PATTERN)
    plain = spark.createDataFrame([("it's 1234 o'clock,  नेपालको\n\n x<|endoftext|>",), ("",)], "text string")
    assert [r.ids for r in bpe.encode(plain, path).collect()] == [r.ids for r in bpe.encode(plain, spelled).collect()]
    back = bpe.decoded(bpe.encode(plain, path).select("ids").union(spark.createDataFrame([([50256],), (None,)], "ids array<int>")), byte_config()).collect()
    assert [r.text for r in back] == [r.text for r in plain.collect()] + ["<|endoftext|>", None]
    assert P.split_patterns(repaired()) == [P.repair(public_tokenizers.PATTERN)] != [public_tokenizers.PATTERN]
    words = [f"नेपाल{x}" for x in ("", "को", "ी", "लाई")] * 3
    types = spark.createDataFrame(list(Counter(words).items()), "ptok string, n bigint")
    cut = bpe.base_symbols(types, repaired())
    merges = [m[:2] for m in bpe.train(spark, cut, 30)]
    other = bpe.extended(repaired(), merges)
    bpe.write_config(spark, other, f"{tmp_path}/config")
    assert bpe.read_config(spark, f"{tmp_path}/config") == other
    texts = types.select(F.col("ptok").alias("text"))
    lengths = {r.ptok: r.lengths for r in bpe.sweep(cut, merges, [0, len(merges)]).collect()}
    for vocabulary, at in ((repaired(), 0), (other, 1)):
        for r in bpe.encode(texts, vocabulary).collect():
            assert r.lossless and len(r.ids) == lengths[r.text][at]
    assert all(b < a for a, b in lengths.values())


def test_extension_from_documents_to_stream(spark, tmp_path):
    from glyphstream.functions import patterns as P
    from glyphstream.plans.extension import extend
    from glyphstream.plans.vocabulary import repaired

    random.seed(5)
    words = ["".join(random.choices("कखगघनमरलिीेा्", k=random.randint(2, 6))) for _ in range(60)]
    rows = [(i, " ".join(random.choices(words, k=80))) for i in range(30)]
    rows += [(100, rows[3][1]), (101, "short"), (102, None), (103, " " + rows[4][1] + "\n")]
    out = f"{tmp_path}/x"
    r = extend(spark, spark.createDataFrame(rows, "doc_id long, text string"), repaired(), "Deva", 40, out, held=3000).first()
    clean = {x.doc_id: x for x in spark.read.parquet(f"{out}/clean").collect()}
    assert set(clean) == set(range(30)) and r.held_docs + r.train_docs == 30 and r.lossless and r.merges == 40
    held, size = set(), 0
    for i in range(30):
        if size < 3000:
            held.add(i)
        size += len(clean[i].text.encode())
    assert {i for i, x in clean.items() if x.split == "held"} == held
    from tokenizers import Tokenizer

    import json

    config = bpe.read_config(spark, f"{out}/tokenizer")
    assert P.split_patterns(config) == P.split_patterns(repaired()) and len(config["model"]["vocab"]) > len(repaired()["model"]["vocab"])
    coder = Tokenizer.from_str(json.dumps(config))
    import hashlib

    place = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16)
    want = [x for i in sorted(set(clean) - held, key=place) for x in [*coder.encode(clean[i].text).ids, 50256]]
    got = spark.read.format("u32").load(f"{out}/stream").orderBy("pos").collect()
    assert [x.id for x in got] == want and r.ids == len(want)


def test_span_functions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from glyphstream.functions import spans

    spans.register(spark)
    texts = ["it's नेपाल 12", "", None, "é😀é"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").createOrReplaceTempView("span_texts")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = spark.sql(f"SELECT k, s.* FROM span_texts, LATERAL token_spans(t, '{path}') s ORDER BY k, idx").collect()
    coder = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        mine = [r for r in got if r.k == k]
        assert [r.id for r in mine] == (coder.encode(t).ids if t else [])
        raw, at = (t or "").encode(), 0
        for r in mine:
            assert r.byte_start == at and r.intra == (raw[at] & 0xC0 == 0x80)
            assert r.char_start == sum(x & 0xC0 != 0x80 for x in raw[: at + 1]) - 1
            at = r.byte_end
        assert at == len(raw)
    found = spark.sql(r"SELECT k, s.start, s.end, s.piece FROM span_texts, LATERAL regex_spans(t, '\\w+') s ORDER BY k, start").collect()
    assert [(r.k, r.start, r.end, r.piece) for r in found][:2] == [(0, 0, 2, "it"), (0, 3, 4, "s")]
