"""The pipeline as a whole against a brute-force version, with null and shared ids, copies, benchmark passages and secrets."""

import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, base_spans

NARROW = 0.5


def fixture():
    random.seed(11)
    stems = {"xx": "bcdfgh", "yy": "klmnpr"}
    words = {k: ["".join(random.choice(v) + random.choice("aeiou") for _ in range(random.randint(2, 4))) for _ in range(400)] for k, v in stems.items()}
    text = lambda k, n: " ".join(random.choices(words[k], k=n))
    items = [text("xx", 40), text("yy", 25), None]
    rows = [(i, text(k, 700), k) for i, k in zip(range(40), ["xx", "yy"] * 20)]
    copy = lambda t: " ".join([*t.split()[:-1], "end"])
    rows += [(100 + i, copy(rows[i][1]), rows[i][2]) for i in range(0, 12, 3)]  # near copies
    rows += [(rows[5][0], rows[5][1], "yy")] * 3 + [(7, text("xx", 300), "xx")]  # repeated rows, and an id of two texts
    rows += [(None, text("xx", 300), "xx"), (None, text("yy", 300), "yy"), (None, rows[2][1].upper(), None)]  # rows without an id
    rows += [(200 + i, f"{text('xx', 90)} {items[i % 2].upper()} {text('xx', 90)}", "xx") for i in range(4)] + [(None, f"{text('yy', 60)} {items[1]}", "yy")]
    rows += [(300, f'{text("yy", 80)} password = "abc12345" {text("yy", 80)} AKIA{"Q" * 20}', "yy"), (301, "token: qwerty7", None), (302, f"token: qwerty7 {text('xx', 90)}", None)]  # 301 is of no language
    rows += [(400, None, "xx"), (401, "", None), (402, "12 34 ...", "yy"), (403, text("yy", 4000), None)]
    return rows, items


def brute(rows, items):
    """(doc_id, redacted text) that the first four stages keep, stated plainly."""
    from glyphstream.llm.langid import Compressor, letters_of

    learn = [r for r in rows if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 != 1 and r[2] and r[1]]
    count = {k: sum(r[2] == k for r in learn) for k in ("xx", "yy")}
    assert max(count.values()) <= 64  # the sample is then all of them

    def order(i):  # a null id leaves the seed as it is
        h = xxhash.xxh64_intdigest(str(i).encode(), 42) if i is not None else 42
        h = xxhash.xxh64_intdigest(b"order", h)
        return h - (1 << 64) if h >> 63 else h

    dicts = {}
    for k in sorted(count, key=lambda k: (-count[k], k)):
        mine = []
        for _, t in sorted({(order(i), t) for i, t, x in learn if x == k}):
            mine += [letters_of(t)] if sum(map(len, mine)) < 65_536 else []
        dicts[k] = b"\n".join(mine)
    coder, kept = Compressor(dicts), []
    for i, t, _ in rows:
        lang, _, margin = coder.classify(t)
        if lang != "und" and margin >= NARROW:
            kept.append((i, t))

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        hs = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps, comp = [fp(t) for _, t in kept], list(range(len(kept)))
    for _ in kept:
        comp = [min(comp[j] for j in range(len(kept)) if (fps[a] ^ fps[j]).bit_count() <= 3) for a in range(len(kept))]
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    groups = {}
    for c, (i, t) in zip(comp, kept):
        groups.setdefault(c, []).append((i is None, i or 0, signed(t), i, t))
    first = [min(g)[3:] for g in groups.values()]

    from collections import Counter

    bag = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))

    def contaminated(t):
        x = re.findall(r"\w+", t.lower())
        for y in (re.findall(r"\w+", y.lower()) for y in items if y):
            b, m = bag(y), min(len(x), len(y))
            for s in range(len(x) - m + 1):
                a = bag(x[s : s + m])
                if 5 * sum((a & b).values()) >= 4 * sum((a | b).values()) > 0:
                    return True
        return False

    out = []
    for i, t in first:
        if not contaminated(t):
            at, masked = 0, ""
            for s, _, e in base_spans(t):
                masked += (t[at:s] + "[SECRET]") if s >= at else ""
                at = max(at, e)
            out.append((i, masked + t[at:]))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from glyphstream.llm.packing import lower_bound

    rows, items = fixture()
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], DOC).withColumn("extra", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = brute(rows, items)
    assert 301 not in {i for i, _ in kept}
    assert len(kept) < len(rows) - 10 and sum("[SECRET]" in t for _, t in kept) == 2 and sum(i is None for i, _ in kept) == 2
    coder, want, counts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], {}
    for i, t in kept:
        ids = coder.encode(t, add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((-1 if i is None else i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            counts[len(part)] = counts.get(len(part), 0) + 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(seqs) <= lower_bound(counts, 2048) + 1


def test_stages_keep_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    rows, items = fixture()
    names = ["score", "margin", "found", "rejected", "lang_pred", "fp", "h", "id", "hash"]
    held = spark.createDataFrame([(i, t, k, *(f"{n} {j}" for n in names)) for j, (i, t, k) in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = held
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == held.columns, name
    got = now.collect()
    assert len(got) == len(brute(rows, items))
    for r in got:
        (j,) = {r[n].split()[1] for n in names}  # all from one row
        assert r.doc_id == rows[int(j)][0] and [r[n] for n in names] == [f"{n} {j}" for n in names]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
