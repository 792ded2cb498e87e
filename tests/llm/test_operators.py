"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({x: F.lit("clash") for x in ("score", "key", "word", "fp", "u", "v", "found", "rank", "lang_pred", "margin")}) if extra else df


EDGE = [None, "", "   ", "...", "x", "the cat sat on the mat " * 3, "the cat sat on the mat " * 3, "é ß " * 4000, "The " * 9]


def test_lattice_sums_every_segmentation():
    import public_tokenizers

    from glyphstream.llm.lm_scoring import Vocabulary, lattice

    v = Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    with np.errstate(divide="ignore"):
        logp = np.log(v.prior)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=v.model)
    piece = {sp.id_to_piece(i): i for i in range(v.size)}

    def brute(s):
        if not s:
            return 1.0
        p = sum(math.exp(logp[piece[s[:k]]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in piece and "▁" not in s[1:k])
        if s[0] not in piece:
            p += math.exp(sum(logp[v.bytes[b]] for b in s[0].encode())) * brute(s[1:])
        return p

    words = ["the", "thwhanin", "a", "ß€☃x", "zzzzqq", "élan"]
    got, counts = lattice(v, logp, words, np.ones(len(words)))
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])
    assert counts.sum() > len(words)


def plain_lattice(model, words, texts, rounds):
    """Piece weights after rounds of expected counts, by listing every segmentation of every word: (log probability of a word, of the end)."""
    from glyphstream.llm.lm_scoring import Vocabulary

    v = Vocabulary(model)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    piece = {sp.id_to_piece(i): i for i in range(v.size) if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}

    def cuts(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in piece:
                for rest in cuts(s[k:]):
                    yield (piece[s[:k]], *rest)
        if s and s[0] not in piece:
            for rest in cuts(s[1:]):
                yield (*(int(v.bytes[b]) for b in s[0].encode()), *rest)

    ways = {w: list(cuts("▁" + w)) for w in words}
    p = v.prior
    for _ in range(rounds):
        counts = 0.01 * v.size * v.prior
        for w, n in words.items():
            share = [math.prod(p[i] for i in way) for way in ways[w]]
            for x, way in zip(share, ways[w]):
                for i in way:
                    counts[i] += n * x / sum(share)
        counts[v.end] += texts
        p = counts / counts.sum()
    return lambda w: math.log10(sum(math.prod(p[i] for i in way) for way in (ways.get(w) or cuts("▁" + w)))), math.log10(p[v.end])


def test_lm_scoring_equals_brute_force(spark):
    import public_tokenizers

    from glyphstream.llm.lm_scoring import score_corpus

    texts = EDGE + ["the dog sat", "A cat\x0bran", "unseen wörds here", "the the cat mat"]
    model = public_tokenizers.path("piece_bpe_32k.model")
    toks = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for t in texts]
    count = {}
    for i, t in enumerate(toks):
        if i % 3 != 2:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    lp, end = plain_lattice(model, {w: c for w, c in count.items() if w}, count[None], 4)
    df = docs(spark, texts, True).withColumn("h", F.col("doc_id") % 3 == 2)
    for head in (3, 1000):
        out = {r.doc_id: r for r in score_corpus(spark, df, model, "h", head=head).collect()}
        assert len(out) == len(texts)
        for i, t in enumerate(toks):
            r = out[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in count for w in t), n, i % 3 == 2)
            assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert math.isclose(r.score, sum(lp(w) if w else end for w in t), rel_tol=1e-9)
    assert score_corpus(spark, df.limit(0), model, "h").count() == 0
    alone = score_corpus(spark, df.where("h"), model, "h").collect()  # nothing to learn from: the prior's weights
    assert all(r.train_tokens == r.n_known == 0 and math.isfinite(r.score) for r in alone)


def test_simhash_equals_brute_force(spark):
    import xxhash

    from glyphstream.llm.simhash import COVERS, anchor_bits, anchors, cover_for, near_duplicates

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    random.seed(1)
    texts = EDGE + [" ".join(random.choices("ab cd ef gh ij kl mn op".split(), k=40)) for _ in range(60)]
    for k in range(40):  # long texts with one word changed link by few bits
        w = random.choices([f"w{j}" for j in range(900)], k=400)
        texts += [" ".join(w), " ".join([*w[:7], "zz", *w[8:]]), " ".join([*w[:-1], "end"])]
    want = [fp(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        new = [min(comp[j] for j in range(len(texts)) if (want[i] ^ want[j]).bit_count() <= 3) for i in range(len(texts))]
        if new == comp:
            break
        comp = new
    got = {r.doc_id: r for r in near_duplicates(spark, docs(spark, texts, True)).collect()}
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == want
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert near_duplicates(spark, docs(spark, texts).limit(0)).count() == 0
    # the covering misses no pair at three bits
    x = np.array([random.getrandbits(64) for _ in range(500)], np.uint64)
    y = np.array([int(a) ^ sum(1 << b for b in random.sample(range(64), 3)) for a in x], np.uint64)
    pairs = {}
    for cover in COVERS:
        (ra, ka, ha), (rb, kb, _) = anchors(x.view(np.int64), cover), anchors(y.view(np.int64), cover)
        home = {(i, k) for i, k, h in zip(ra.tolist(), ka.tolist(), ha.tolist()) if h}
        met = {i for i, k in zip(rb.tolist(), kb.tolist()) if (i, k) in home}
        assert met == set(range(500)) and len(home) == 1000
        assert len(ra) <= 66 * 500
    assert [anchor_bits(cover_for(n)) for n in (0, 1 << 18, 1 << 19, 1 << 22, 1 << 28, 1 << 40)] == [18, 18, 21, 27, 32, 32]
    for n in (1 << 17, 1 << 19, 1 << 20):  # comparisons a fingerprint stay level where the code follows the table's size
        fp = np.random.default_rng(n).integers(0, 1 << 63, n, np.int64) * 2 + 1
        _, key, home = anchors(fp, cover_for(n))
        names, count = np.unique(key[home], return_counts=True)
        at = np.searchsorted(names, key)
        at[at == len(names)] = 0
        pairs[n] = int(count[at][names[at] == key].sum()) / n
    assert max(pairs.values()) < 40, pairs


def test_components(spark):
    from glyphstream.llm.components import connected_components

    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)]
    got = dict(connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}


def test_language_id(spark):
    from glyphstream.llm.langid import dictionaries, identify

    random.seed(2)
    words = {"en": "the and of house water with street".split(), "de": "der und von haus wasser mit strasse".split()}
    make = lambda x: " ".join(random.choices(words[x], k=60))
    train = spark.createDataFrame([(i, make(x), x) for i, x in enumerate(["en", "de"] * 30)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    dicts = dictionaries(train)
    assert set(dicts) == {"en", "de"}
    held = spark.createDataFrame([(i, make(x), x) for i, x in enumerate(["en", "de"] * 20)] + [(100 + i, t, "und") for i, t in enumerate([None, "", "123 ..."])], "doc_id long, text string, lang string").withColumn("margin", F.lit("clash"))
    got = identify(spark, held, dicts).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) == 3
    assert identify(spark, held, {}).where("lang_pred <> 'und'").count() == 0
    assert identify(spark, held.limit(0), dicts).count() == 0
    whole = identify(spark, held, dicts, into="told").select("margin", "told.*").collect()
    assert all(tuple(r)[0] == "clash" for r in whole) and sorted(tuple(r)[1:] for r in whole) == sorted((r.lang_pred, r.score, r.margin, r.rejected) for r in got)
    letters = "".join(map(chr, range(97, 123)))
    junk = [" ".join("".join(random.choices(letters, k=random.randint(2, 9))) for _ in range(n)) for n in (10, 100, 1000) for _ in range(30)]
    odd = identify(spark, docs(spark, [*junk, "½ ² Ⅷ ①", "the water", "the the haus haus"]), dicts).orderBy("doc_id").collect()
    assert sum(r.rejected for r in odd[: len(junk)]) >= 0.9 * len(junk)
    assert (odd[-3].lang_pred, odd[-3].score) == ("und", 0.0) and all(r.rejected == (r.lang_pred == "und" or r.margin < 0.5) for r in odd)


def test_samples_stay_bounded(spark):
    from glyphstream.llm.langid import sample_by_class

    rows = [(None, f"a {i}", "x") for i in range(4000)] + [(7, f"b {i}", "y") for i in range(4000)] + [(8, "same", "z")] * 3000
    rows += [(i, "t", f"rare {i}") for i in range(600)]
    drawn, classes = sample_by_class(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "lang", 100)
    got = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert len(classes) == 603 and 50 < got["x"] < 160 and 50 < got["y"] < 160 and got.get("z", 0) <= 1 and all(got[f"rare {i}"] == 1 for i in range(600))


def test_toxicity_held_out(spark):
    from glyphstream.llm.toxicity import fit, score

    random.seed(3)
    rows, labels = [], []
    for i in range(600):
        w = random.choices([f"word{j}" for j in range(200)], k=50)
        if i % 6 == 0:
            w[random.randrange(50)] = random.choice(["vileness", "vilely", "grotty"])
        rows.append((i, " ".join(w)))
        if i // 6 % 2 == 0:
            labels.append((i, int(i % 6 == 0)))
    rows += [(900, None), (901, "")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score(spark, d, fit(d.where("doc_id % 5 <> 0"), lab.where("doc_id % 5 <> 0"))).collect()}
    held = [i for i in range(0, 600, 5)]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert got[900].predicted == 0 and 0 < got[901].score < 0.5
    assert score(spark, d, fit(d, lab.limit(0))).count() == len(rows)
    clash = d.withColumns({x: F.lit("clash") for x in ("score", "predicted", "toxic", "p", "words", "w")})
    model = fit(clash, lab.withColumn("text", F.lit("clash")))
    assert model == fit(d, lab) and {(r.doc_id, r.score) for r in score(spark, clash.union(clash), model).collect()} == {(r.doc_id, r.score) for r in score(spark, d, model).collect()}
    assert score(spark, d.limit(0), fit(d.limit(0), lab)).count() == 0


def test_toxicity_risk_equals_plain_gradient():
    """One step of the non-negative risk, its gradient taken numerically."""
    from glyphstream.llm.toxicity import train_pu

    pos, unl, prior = [[0], [0, 1], [0]], [[1], [], [0, 1], [1], []], 0.3

    def risk(w):
        out = lambda xs: np.array([w[2] + sum(w[i] for i in x) for x in xs])
        sp, su = out(pos), out(unl)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        return prior * np.logaddexp(0, -sp).mean() + negative if negative >= 0 else -negative

    w = np.array([0, 0, math.log(prior / (1 - prior))])
    slope = np.array([(risk(w + h) - risk(w - h)) / 2e-6 for h in 1e-6 * np.eye(3)])
    weights, bias = train_pu(pos, unl, ["a", "b"], prior, steps=1, rate=0.1)  # the first step of Adam goes by the slope's sign
    got = np.array([weights["a"], weights["b"], bias]) - w
    assert np.allclose(got, -0.1 * np.sign(slope), atol=1e-4)


def test_decontamination_equals_brute_force(spark):
    from collections import Counter

    from glyphstream.llm.decontam import contaminated, similarity

    random.seed(4)
    w = [f"t{j}" for j in range(300)]
    items = [" ".join(random.choices(w, k=n)) for n in (3, 5, 12, 30, 41, 30)] + [None, ""] + ["t1", "t2 t3", "t4 t5 t6 t7"]
    texts = list(EDGE)
    for k in range(30):
        t = random.choices(w, k=200)
        item = (items[k % 6]).upper().split()
        if k % 3 == 0 and len(item) > 8:
            item = item[:-1] + ["ZZ"]
        texts.append(" ".join([*t[:80], *item, *t[80:]]) if k % 5 else " ".join(item))
    bag = lambda x: Counter(tuple(x[i : i + min(5, len(x))]) for i in range(len(x) - min(5, len(x)) + 1))
    want = set()
    for i, t in enumerate(texts):
        x = re.findall(r"\w+", (t or "").lower())
        for k, y in enumerate(items):
            y = re.findall(r"\w+", (y or "").lower())
            if x and y:
                m = min(len(x), len(y))
                if max(similarity(bag(x[s : s + m]), bag(y)) for s in range(len(x) - m + 1)) >= 0.8:
                    want.add((i, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (16 << 20, 64):
        got = contaminated(spark, docs(spark, texts, True), bench, block_bytes=size)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert want and contaminated(spark, docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_long_items_with_replaced_runs():
    from glyphstream.llm.decontam import Index

    random.seed(12)
    w = [f"t{j}" for j in range(5000)]
    for n, share in ((60, 0.05), (200, 0.1), (300, 0.08), (500, 0.1)):
        for k in range(12):
            item, r = random.choices(w, k=n), int(n * share)
            new = [f"u{j}" if k % 2 else "same" for j in range(r)]  # words that the item lacks, each once or one throughout
            text = " ".join([*random.choices(w, k=50), *item[: n - r], *new, "x", "y"])
            same = n - r - 4
            assert [(i, round(s, 9)) for i, s, *_ in Index([(7, " ".join(item))], 5, 14, 0.8).matches(text)] == [(7, round(same / (2 * (n - 4) - same), 9))]


def test_decontamination_index_prunes_and_misses_nothing():
    """Every pair within the radius is found by the blocks; few others are looked at; most pairs at the threshold are within it."""
    from glyphstream.llm.decontam import Index

    random.seed(15)
    w = [f"t{j}" for j in range(3000)]
    index = Index([(k, " ".join(random.choices(w, k=40))) for k in range(400)], 5, 14, 0.8)
    fps = np.array([random.getrandbits(64) ^ 0 for _ in range(3000)], np.uint64)
    fps[:800] = [int(index.fps[k % 400]) ^ sum(1 << b for b in random.sample(range(64), 1 + k % 18)) for k in range(800)]
    row, item = index._near(40, fps)
    want = {(i, k) for i, f in enumerate(fps.tolist()) for k, g in enumerate(index.fps.tolist()) if (f ^ g).bit_count() <= 14}
    assert set(zip(row.tolist(), item.tolist())) == want and len(want) > 500
    assert index.candidates / index.windows < 0.08 * 400, index.candidates / index.windows
    within = {}
    for changed in (1, 2):  # of 96 shingles 5 or 10 differ: similarity 0.90 and 0.81
        found = 0
        for _ in range(200):
            item = random.choices(w, k=100)
            text = list(item)
            for j in range(changed):
                text[10 + 20 * j] = "zz"
            one = Index([(0, " ".join(item)), (1, " ".join(text))], 5, 14, 0.8)
            found += (int(one.fps[0]) ^ int(one.fps[1])).bit_count() <= 14
        within[changed] = found / 200
    assert within[1] > 0.99 and within[2] > 0.94, within


def test_html():
    from glyphstream.llm.html_extract import extract

    page = '<html><head><title>no</title></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br><p>Two  words\n here</p><script>var x="</p>";</script></article><div id="comments"><p>Nice!</p></div><footer>&copy;</footer>'
    assert extract(page) == "A & B\nOne\nTwo words here"
    plain = "<body><div class=menu><ul>" + '<li><a href="/x">Link</a></li>' * 9 + "</ul></div><div><p>" + "Long text here. " * 20 + "</p><p>" + "More of it. " * 20 + '</p></div><div><a href="/1">a</a> <a href="/2">b</a></div></body>'
    assert extract(plain) == ("Long text here. " * 20).strip() + "\n" + ("More of it. " * 20).strip()
    assert [extract(x) for x in (None, "", "<p", "<!-- x", "<html></html>")] == [""] * 5


def test_html_keeps_articles_in_named_wrappers():
    from glyphstream.llm.html_extract import extract

    paras = ["Long text here. " * 20, "More of it. " * 20, "And an end. " * 20]
    want = "\n".join(p.strip() for p in paras)
    text = "".join(f"<p>{p}</p>" for p in paras)
    menu = '<div class="site-menu"><ul>' + '<li><a href="/x">Link</a></li>' * 9 + "</ul></div>"
    rest = '<div class="comments"><p>' + "Nice! " * 9 + '</p></div><div id="sidebar-left"><p>Buy this now, it is cheap.</p></div>'
    states = ["container has-sidebar", "layout with-sidebar", "post no-comments", "content menu-open", "elementor-widget-text", "sticky-header page"]
    for name in [*states, "sidebar", "widget", "page share"]:
        assert extract(f'<body>{menu}<div class="{name}">{text}</div>{rest}</body>') == want, name
        assert extract(f'<body>{menu}<section id="{name}"><div>{text}</div>{rest}</section></body>') == want, name
        assert extract(f'<body>{menu}<div>' + "".join(f'<div><div class="{name}"><p>{p}</p></div></div>' for p in paras) + "</div></body>") == want, name
    assert extract(f'<body><div class="banner"><main>{text}</main>{rest}</div></body>') == want
    assert extract('<body><div class="menu">all there is</div></body>') == "all there is"
    assert extract(f"<body><div>{text}<div class=comments>{text * 2}</div></div></body>") == want  # a name still lowers


def plain_main_text(page):
    """Composite text density stated plainly, for well-formed pages of div, section, p, h2, a and nav: every quantity anew for every node."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.now = {"tag": "#", "kids": [], "up": None}

        def handle_starttag(self, tag, attrs):
            self.now["kids"].append({"tag": tag, "kids": [], "up": self.now})
            self.now = self.now["kids"][-1]

        def handle_endtag(self, tag):
            self.now = self.now["up"]

        def handle_data(self, data):
            self.now["kids"].append(" ".join(data.split()))

    tree = Tree()
    tree.feed(page)
    (body,) = tree.root["kids"]
    parts = lambda n: [k for k in n["kids"] if isinstance(k, dict)]
    under = lambda n: [n, *(x for k in parts(n) for x in under(k))]
    chars = lambda n: sum(chars(k) if isinstance(k, dict) else len(k) for k in n["kids"])
    links = lambda n: chars(n) if n["tag"] == "a" else sum(map(links, parts(n)))

    def density(n):
        c, t, lc = chars(n), max(1, len(under(n)) - 1), links(n)
        lt = max(1, sum(x["tag"] == "a" for x in under(n)[1:]))
        base = math.log(c / max(1, c - lc) * lc + links(body) / max(1, chars(body)) * c + math.e)
        return c / t * math.log(c * t / (max(1, lc) * lt) + 1) / math.log(base + 1) if c else 0.0

    def above(n):
        return [] if n is body or n["up"] is body else [n["up"], *above(n["up"])]

    def blocks(n):
        out, held = [], []
        for k in [*n["kids"], None]:
            if isinstance(k, dict) and k["tag"] == "a":
                held += [x for x in k["kids"]]
            elif isinstance(k, str):
                held.append(k)
            else:
                out += ["".join(held)] if "".join(held).strip() else []
                held = []
                out += blocks(k) if k else []
        return out

    full = {id(n): density(n) for n in under(body)}
    for n in under(body):
        n["kids"] = [k for k in n["kids"] if not (isinstance(k, dict) and k["tag"] == "nav")]
    core = max(under(body), key=lambda n: sum(map(density, parts(n))))
    if core is body:
        return "\n".join(b for k in parts(body) if full[id(k)] > full[id(body)] for b in blocks(k))
    path = above(core)
    least = min(full[id(n)] for n in [core, *path, body])
    top = ([n for n in path if full[id(n)] >= 1.25 * full[id(body)]] or [core])[-1]

    def taken(n):
        if n is top:
            return blocks(n)
        if top in under(n):
            return [b for k in parts(n) for b in taken(k)]
        return blocks(n) if density(n) >= least and chars(n) else [b for k in parts(n) for b in taken(k)]

    return "\n".join(taken(body))


def test_html_density_equals_plain_version(spark):
    from glyphstream.llm.html_extract import extract, extract_pages

    random.seed(21)
    words = lambda n: " ".join(random.choices("alpha beta gamma delta epsilon".split(), k=n))

    def part(depth):
        kind = random.random()
        if depth > 3 or kind < 0.45:
            return f"<p>{words(random.choice((3, 20, 60)))}</p>"
        if kind < 0.6:
            return "<div>" + "".join(f"<a>{words(1)}</a>" for _ in range(random.randint(1, 6))) + "</div>"
        if kind < 0.7:
            return f"<h2>{words(2)}</h2>"
        if kind < 0.78:
            return f"<nav><p>{words(4)}</p></nav>"
        tag = random.choice(("div", "section"))
        return f"<{tag}>" + "".join(part(depth + 1) for _ in range(random.randint(1, 6))) + f"</{tag}>"

    pages = ["<body>" + "".join(f"<div>{part(0)}{part(1)}</div>" for _ in range(random.randint(1, 4))) + f"<div><p>{words(30)}</p></div></body>" for _ in range(250)]
    want = [plain_main_text(p) for p in pages]
    assert [extract(p) for p in pages] == want
    assert sum(len(w) < len(re.sub("<[^>]*>", "", p)) for p, w in zip(pages, want)) > 100  # it does choose
    rows = [(i, None if i % 9 == 0 else p, "clash") for i, p in enumerate(pages[:30])]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in extract_pages(spark, df).collect())
    assert got == sorted((i, "" if p is None else want[i]) for i, p, _ in rows + rows[:3])
    assert extract_pages(spark, df.limit(0)).count() == 0


def test_html_odd_markup():
    from glyphstream.llm.html_extract import extract

    assert extract("<div>" * 10_000 + "<p>deep text</p>") == "deep text"
    assert extract("<body><span>" * 5_000 + "x</p>" * 5_000).replace("\n", "") == "x" * 5_000
    kept = '<article><p title=5" wide>Hello there, this is a text.</p><h2 class="related-work">Related work</h2><p class="notice">Notice this.</p><div class=notice>Cookies!</div></article>'
    assert extract(f"<body>{kept}</body>") == "Hello there, this is a text.\nRelated work\nNotice this."
    assert extract("<p>a < b <a href='x>y'>c</a>") == "a < b c"


def base_spans(x):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets(spark):
    from glyphstream.llm.secrets import KINDS, redact, scan, spelled

    random.seed(6)
    noise = ["".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(8)]
    dull = ["ab1" * 12, "1111111111111111111111a", "aaaaaaaaaaaaaaaaaaaaaaaaa9", "abcdefghijklmnopqrstuvwxyz0123456789"]
    texts = EDGE + ['é𝄞 Token = "abc123" x', "token=token:abcdefgh", "api_key:'AKIA" + "Z" * 20, "deadbeef" * 3 + " password: short", "secret==aaaaaa," * 3] + [f"ü {t} end" for t in noise + dull]
    rows = scan(docs(spark, texts, True)).select("doc_id", spelled(F.col("found")).alias("spans"), redact(F.col("text"), F.col("found")).alias("r")).collect()
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if not s.startswith("random")] == [f"{KINDS[k]}:{a}:{e}" for a, k, e in base_spans(t or "")]
        extra = [s for s in spans if s.startswith("random")]
        if any(x in (t or "") for x in dull):
            assert not extra
    found = [i for i, t in enumerate(texts) if any(x in (t or "") for x in noise) and "random" in got[i].spans]
    assert len(found) >= 6 and all(got[i].r == "ü [SECRET] end" for i in found)
    assert got[0].r is None and scan(docs(spark, texts).limit(0)).count() == 0


def test_secrets_in_one_long_text(spark):
    """Thousands of matches in one text, base spans and tokens mixed, against the plain spans and a plain redaction."""
    from glyphstream.llm.secrets import scan, spelled, redact, KINDS

    random.seed(22)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    part = lambda: random.choice(["token=" + "".join(random.choices(letters, k=12)), "AKIA" + "Q7" * 8 + "é", "deadbeef" * 3 + "01", "".join(random.choices(letters, k=40)), "𝄞 word", "key-" + "".join(random.choices(letters, k=30)) + " password=abcdef1/", "xx" + "ab12" * 8 + "Z"])
    text = " ".join(part() for _ in range(6_000))
    began = __import__("time").time()
    got = scan(docs(spark, [text, "none", None])).select("doc_id", spelled(F.col("found")).alias("spans"), redact(F.col("text"), F.col("found")).alias("r")).collect()
    took = __import__("time").time() - began
    row = next(r for r in got if r.doc_id == 0)
    spans = [(int(a), KINDS.index(k), int(e)) for k, a, e in (x.split(":") for x in row.spans.split(","))]
    base = base_spans(text)
    assert spans == sorted(spans) and [x for x in spans if x[1] < 3] == base
    covered = np.zeros(len(text) + 1, bool)
    for a, _, e in base:
        covered[a:e] = True
    free = {(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", text) if not covered[m.start() : m.end()].any()}
    extra = [(a, e) for a, k, e in spans if k == 3]
    assert len(extra) > 500 and set(extra) <= free
    for a, e in extra:
        covered[a:e] = True
    plain = "".join("\0" if c else x for x, c in zip(text, covered))
    want, at = "", 0
    for a, _, e in spans:
        want += text[at:a] + "[SECRET]" if a >= at else ""
        at = max(at, e)
    assert row.r == want + text[at:] and plain.count("\0") == covered.sum()
    assert took < 60


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from glyphstream.llm.packing import lower_bound, pack, pack_documents

    random.seed(7)
    for _ in range(30):
        counts = {}
        for _ in range(random.randint(1, 60)):
            s = random.randint(1, 100)
            counts[s] = counts.get(s, 0) + random.randint(1, 5)
        plan = pack(counts, 100)
        held = {}
        for items, times in plan:
            assert sum(s * n for s, n in items) <= 100
            for s, n in items:
                held[s] = held.get(s, 0) + n * times
        assert held == counts
        assert sum(t for _, t in plan) <= lower_bound(counts, 100) + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = EDGE + ["word, " * 700 + "it's İ <|endoftext|> don't", "a b c"] * 3
    rows = pack_documents(spark, docs(spark, texts, True), path).collect()
    coder, seqs = Tokenizer.from_file(path), {}
    for i, t in enumerate(texts):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert want == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert pack_documents(spark, docs(spark, texts).limit(0), path).count() == 0


def test_plain_chunks_take_the_merge_model():
    import public_tokenizers

    from glyphstream.llm.packing import ChunkCodec

    class Counted(ChunkCodec):
        def _whole(self, chunks):
            seen.extend(chunks)
            return super()._whole(chunks)

    random.seed(5)
    seen, coder = [], Counted(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x21, 0x7F)] + [chr(c) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))] + list("'''stremdlvSTDL019")
    plain = ["it's", "don'T", "'llama", "''s", "</w>", "a</w>b", "abc123,", '"Été";', "x" * 3000] + ["".join(random.choices(letters, k=random.randint(1, 9))) for _ in range(5000)]
    plain = [w for w in dict.fromkeys(plain) if "<|" not in w]
    got = coder.encode([w.encode() for w in plain])
    assert not seen  # not the whole tokenizer
    assert got == coder._whole([w.encode() for w in plain])
    odd = ["<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "½", "e\u0301", "İ", "a\x1cb", "×"]
    del seen[:]
    assert coder.encode([w.encode() for w in odd]) == ChunkCodec(public_tokenizers.path("word_bpe_49k.json"))._whole([w.encode() for w in odd])
    assert sorted(seen) == sorted(w.encode() for w in odd)


def test_packing_search_backtracks():
    from glyphstream.llm.packing import pack

    def fewest(sizes, cap):  # plain search: every item into every open bin, or a new one
        best = len(sizes)

        def place(k, rooms):
            nonlocal best
            if k == len(sizes):
                best = min(best, len(rooms))
            elif len(rooms) < best:
                for room in {r for r in rooms if r >= sizes[k]}:
                    i = rooms.index(room)
                    place(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
                place(k + 1, [*rooms, cap - sizes[k]])

        place(0, [])
        return best

    def count(sizes):
        return {s: sizes.count(s) for s in sizes}

    random.seed(13)
    for _ in range(150):
        sizes = sorted(random.choices(range(random.choice((3, 15, 20)), random.choice((35, 50, 70))), k=random.randint(1, 11)), reverse=True)
        assert sum(t for _, t in pack(count(sizes), 100)) == fewest(sizes, 100) == sum(t for _, t in pack(count(sizes), 100, nodes=None))
    for seed in range(6):  # triples that fill 20 sequences exactly
        random.seed(seed)
        sizes = []
        while len(sizes) < 60:
            a, b = random.randint(520, 1008), random.randint(520, 1008)
            if 520 <= 2048 - a - b <= 1008:
                sizes += [a, b, 2048 - a - b]
        plan = pack(count(sizes), 2048)
        assert sum(t for _, t in plan) == 20
        assert sorted(s for items, t in plan for s, n in items for _ in range(n * t)) == sorted(sizes)


def test_warc_round_trip(spark, tmp_path):
    from glyphstream.llm import warc

    random.seed(8)
    big = "".join(chr(random.randint(32, 0x2FFF)) for _ in range(40_000))
    pages = [(1, "http://a/", big), (2, "u", None), (3, None, ""), (4, "u", "z" * 99), (5, "u", "z" * 99), (6, "u", "y" * 100), (7, "u", "y" * 100), (8, "u", big), (9, "u\r\nX: y", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r.page_id: r for r in warc.round_trip(spark, df).collect()}
    assert len(got) == len(pages)
    for i, _, t in pages:
        raw = (t or "").encode()
        first = min(j for j, _, x in pages if (x or "").encode() == raw)
        refers = first if len(raw) >= 100 and first != i else None
        assert tuple(got[i])[1:] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers)
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    parts = warc.page_records(1, "u", b"p" * 5000, "", None, 1000)
    (tmp_path / "a.warc").write_bytes(b"".join(reversed(parts)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(warc.zipped, warc.page_records(2, "u", b"hi", "", None, 1000))))
    rows = warc.payloads(warc.reassemble(warc.read_records(warc.read_files(spark, str(tmp_path / "*.warc*"))))).collect()
    assert sorted((r.record_id, r.payload_bytes) for r in rows) == [("<urn:page:1>", 5000), ("<urn:page:2>", 2)]
    path = warc.fresh_path(spark, "warc-test")
    warc.write_archives(spark, warc.with_revisits(df, small=0), path)
    archives = spark.read.parquet(path)
    assert warc.write_files(archives, str(tmp_path / "out")) == archives.count() == len(list((tmp_path / "out").iterdir()))
    again = warc.payloads(warc.reassemble(warc.read_records(warc.read_files(spark, str(tmp_path / "out"))))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in again) == sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got.values())
    revisits = warc.read_records(archives).where("record_type = 'revisit'")
    assert [r.payload_bytes for r in warc.payloads(revisits).collect()] == [None] * 2
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(warc.read_records(warc.read_files(spark, str(tmp_path / "*.warc*")))).collect()
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab", b"zz\r\n", b"3"):
        with pytest.raises(warc.WarcError):
            warc.dechunk(bad)


def test_warc_repeated_and_null_ids(spark):
    from collections import Counter

    from glyphstream.llm import warc

    long, other = "x" * 40_000, "y" * 50_000
    pages = [(1, "u", long), (1, "u", long), (1, "v", other), (2, "u", long), (2, "u", long), (None, "u", long), (None, "u", other * 2), (None, None, None), (None, None, None), (3, "u", "z" * 200), (3, "u", "z" * 200), (4, "u", "z" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = Counter()
    for i, _, t in pages:
        raw = (t or "").encode()
        first = min((j for j, _, x in pages if x == t and j is not None), default=None)
        refers = first if len(raw) >= 100 and i is not None and first < i else None
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter(tuple(r) for r in warc.round_trip(spark, df).collect()) == want
    path = warc.fresh_path(spark, "warc-test")
    warc.write_archives(spark, warc.with_revisits(spark.createDataFrame(pages, "page_id long, url string, html string")), path)
    found = warc.reassemble(warc.read_records(spark.read.parquet(path))).collect()
    ids = {r.record_id: r for r in found}
    assert len(ids) == len(found) == len(pages)
    assert all(ids[r.refers_to].record_type == "response" and ids[r.refers_to].payload_digest == r.payload_digest for r in found if r.record_type == "revisit")


def test_nearest_equals_brute_force(spark):
    from glyphstream.llm.ann import nearest

    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 8)).round(1)
    v[100:300] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None, 1.0]), (904, [float("inf")] + [0.0] * 7), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, v[0].tolist())]
    rows += [rows[50], rows[50], (350, v[51].tolist()), (351, v[350].tolist()), (351, v[3].tolist())]  # repeated rows, ids with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    fine = [(i, np.array(x)) for i, x in rows if i is not None and i < 900]

    def brute(at):
        i, q = fine[at]
        c = [(-float((x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for n, (j, x) in enumerate(fine) if n != at]
        return [(r + 1, j) for r, (_, j) in enumerate(sorted(c)[:5])]

    want = sorted((i, *x) for at, (i, _) in enumerate(fine) if i % 50 == 0 for x in brute(at))
    for args in ({}, {"shard_rows": 60, "block_rows": 4}, {"shard_rows": 100, "sample_rows": 40}):
        got = nearest(spark, df, df.where("vec_id % 50 = 0 or vec_id > 900"), 5, **args).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id < 900) == want
        assert {(r.query_id, r.vec_id) for r in got if r.query_id > 900} == {(905, 906), (906, 905)}
    assert nearest(spark, df.limit(0), df, 5).count() == 0 and nearest(spark, df, df.limit(0), 5).count() == 0


def test_nearest_prunes():
    from glyphstream.llm.ann import Router, VPTree, unit

    rng = np.random.default_rng(10)
    taken, visits = {}, {}
    for n in (2_000, 16_000):  # clusters of about 50 points: what a query touches must not grow with the table
        centres = rng.normal(size=(n // 50, 24))
        u = unit(centres[rng.integers(len(centres), size=n)] + 0.05 * rng.normal(size=(n, 24)))
        tree, q = VPTree(u), u[:100]
        row, at = tree.near(q, 6)
        exact = np.argsort(-(q @ u.T), axis=1, kind="stable")[:, :6]
        assert all(set(exact[r]) <= set(at[row == r].tolist()) for r in range(100))
        taken[n] = tree.compared / 100
        far = np.sqrt(np.maximum(0, 2 - 2 * np.sort(q @ u.T, axis=1)[:, -6]))
        router = Router(u[:2_000], n // 500)
        visits[n] = len(router.within(q, far)[0]) / 100
        assert (router.home(u) >= 0).all() and len(set(router.home(u).tolist())) == router.shards
        tree.compared = 0
        tree.near(q, 6, factor=4.0)
        assert tree.compared / 100 < taken[n]
    assert taken[16_000] < 3 * taken[2_000] and visits[16_000] < 32 / 2, (taken, visits)
