"""The other corpus operators: brute force, held-out accuracy, and rows of every odd kind."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, imatch, language, mixing, near_copies, queries, site_tree, substring_dedup, toxicity, url_reputation

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, source string, lang string, d string, v string, bucket string, fp string, k1 string, score string, size string, target string"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", "d", "v", "b", "f", "k", "s", "z", "t") for d, t, s in rows], CLASH)


ODD = [(1, None, "a"), (2, "", None), (3, " \n ", "a"), (None, "one two three", "b"), (4, "same text here", None), (4, "same text here", None), (5, "word " * 40000, "é"), (6, "!!! ...", "b")]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_substrings(data):
    seen, out = {}, {}
    for d, t in sorted(data):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone[i : i + 20] = [True] * 20
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substrings_against_brute_force(spark):
    data = [(r.doc_id, r.text) for r in documents(spark).collect()]
    shared = " ".join(f"s{i}" for i in range(60))
    data += [(9000 + i, f"a{i} {shared} b{i} {shared}") for i in range(5)] + [(9100, "x " * 50), (9101, None), (9102, "y " * 19)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_substrings(data)


def test_substring_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_run_hash", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    w = [f"w{i}".encode() for i in range(45)]
    packed = [b" ".join(w[:20]), b" ".join(w[20:40]), b" ".join(w[:20])]
    one, at = np.ones(3, np.int64), np.zeros(3, np.int64)
    d, _, a, b = substring_dedup._repeats(packed, np.arange(3), at, at, one)
    assert (d.tolist(), a.tolist(), b.tolist()) == ([2], [0], [1])


def test_substring_odd_rows(spark):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(clashing(spark, ODD)).collect())
    assert got == sorted([("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("None", 3, 0), ("4", 3, 0), ("4", 3, 0), ("5", 40000, 39999), ("6", 2, 0)])
    assert substring_dedup.dedup_substrings(clashing(spark, ODD).limit(0)).count() == 0


def test_mixing_meets_its_targets(spark):
    out = mixing.mix(documents(spark)).toPandas()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert ((by.taken - by.target).abs() <= 1).all()
    assert (out.taken <= 2 * out["size"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3
    again = mixing.mix(documents(spark).repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    split = mixing.mix(documents(spark), per_bucket=3).toPandas()
    assert split[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mixing_by_hand(spark):
    """One source of 100 words: 9 of 10 words and one of 10 words more, target 150, so every one is taken once and the rest
    by rank, the last in part."""
    df = spark.createDataFrame([(i, "x " * 10, "a") for i in range(10)], "doc_id long, text string, source string")
    out = sorted((r.taken for r in mixing.mix(df).collect()), reverse=True)
    assert out == [20] * 5 + [10] * 5


def test_mixing_buckets_are_even(spark):
    """Whatever the fraction, buckets hold about as many documents."""
    for share in (1.02, 1.5, 1.97):
        df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x x x").alias("text"), F.lit("a").alias("source"))
        sizes = mixing._drawn(df, (1,), share, 2, "mix", 500)[2].groupBy("bucket").count().toPandas()["count"].tolist()
        assert len(sizes) == 40 and max(sizes) < 650


def test_mixing_fills_up_by_weight(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got["a"] == 200
    assert got[None] == 20
    assert got["b"] + got["c"] == 1.5 * 2110 - 220
    assert got["b"] == pytest.approx(2 * got["c"])


def test_mixing_odd_rows(spark):
    out = mixing.mix(clashing(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix(clashing(spark, ODD).limit(0)).count() == 0


def test_fingerprints(spark):
    df = documents(spark)
    data = sorted((r.doc_id, r.text) for r in df.collect())
    out = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    for (d, t), (_, nxt) in zip(data, data[1:] + data[:1], strict=True):
        q = len(t) // 4
        assert out[d].edited == t[: len(t) - q] + nxt[:q]
        assert out[d].n_chars == len(t)
    by_text = {}
    for d, t in data:
        assert by_text.setdefault(t, out[d].fingerprint) == out[d].fingerprint
    near = np.array([[r.near_edited, r.near_next] for r in out.values()])
    assert (near[:, 0] > near[:, 1]).mean() > 0.95


def test_fingerprint_odd_rows(spark):
    out = imatch.fingerprints(clashing(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id: r.n_chars for r in out}[None] == 13
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    (one,) = imatch.fingerprints(clashing(spark, ODD[3:4])).collect()
    assert one.near_next == 1.0
    assert imatch.fingerprints(clashing(spark, ODD).limit(0)).count() == 0


def test_fingerprint_hashes_the_sorted_terms_of_each_subset():
    band = np.sort(imatch.coded([b"x", b"y", b"z", b"w"], 7)[1])
    a, b, c, none = imatch.fingerprint_all(["x y z " * 9, "z, Y. x", "x y w", ""], band)
    assert (a == b).all()
    assert not none.any()
    assert 0 < imatch.likeness(a[None], c[None])[0] < 1


def brute_fingerprint(text, band):
    """I-Match by its definition: of each lexicon subset, the hash of the text's distinct terms in it, in order."""
    import string

    import xxhash

    mask, mix = (1 << 64) - 1, lambda h: int(imatch.mixed(np.array([h], np.uint64))[0])
    terms = {t for w in (text or "").lower().split() if (t := w.translate(str.maketrans("", "", string.punctuation)))}
    terms = (terms & band) or terms
    out = []
    for k in range(imatch.SUBSETS):
        drawn = sorted(d for t in terms if (d := mix(xxhash.xxh64_intdigest(t.encode(), 7) + (k + 1) * 0x9E3779B97F4A7C15 & mask)) >> 32 < 1 << (30 - k % 8))
        whole = sum(mix(d ^ 0xA5A5A5A5A5A5A5A5) | 1 for d in drawn) & mask | 1 << 63
        out.append(mix(whole) % 65535 + 1 if drawn else 0)
    return out


def test_fingerprints_against_brute_force(spark):
    """Document frequencies, band, fingerprints and likeness, all counted anew."""
    from collections import Counter
    import string

    clean = str.maketrans("", "", string.punctuation)
    data = sorted((r.doc_id, r.text) for r in documents(spark).where("length(text) < 2000").limit(60).collect())
    df = Counter(t for _, text in data for t in {w.translate(clean) for w in text.lower().split()} if t)
    band = {t for t, n in df.items() if 0.05 * len(data) <= n <= 0.4 * len(data)}
    got = imatch.lexicon(spark.createDataFrame(data, "doc_id long, text string"), len(data), 0.05, 0.4)
    assert got.tolist() == sorted(int(imatch.coded([t.encode()], 7)[1][0]) for t in band)
    out = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(data, "doc_id long, text string"), 0.05, 0.4).collect()}
    for (d, t), (_, nxt) in zip(data, data[1:] + data[:1], strict=True):
        q = len(t) // 4
        own, edited, other = (brute_fingerprint(x, band) for x in (t, t[: len(t) - q] + nxt[:q], nxt))
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True) if x or y) / max(1, sum(bool(x or y) for x, y in zip(a, b, strict=True)))
        assert out[d].fingerprint == "".join(f"{x:04x}" for x in own)
        assert out[d].edited_fingerprint == "".join(f"{x:04x}" for x in edited)
        assert (out[d].near_edited, out[d].near_next) == pytest.approx((like(own, edited), like(own, other)))


TOXIC = [("all is well here. the day is fine", 0), ("you are scum. the day is fine", 1), ("such a loser\nall is well", 1), ("the day is fine here", 0)]


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, *TOXIC[i % 4]) for i in range(80)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(1, "a fine day. LOSER! well"), (2, "a fine day. well")], "doc_id long, text string"), model).collect()}
    assert out[1].score >= 0.3 > out[2].score
    assert [x.sentence for x in out[1].offending] == [1]


def test_toxicity_is_fitted_on_16000_documents(spark):
    """A word of six documents among so many is a feature only if none of them is left out."""
    toxic = F.col("doc_id") % 2500 == 7
    rows = spark.range(16_000).toDF("doc_id").select("doc_id", F.when(toxic, "you rarest").otherwise("a fine day").alias("text"), toxic.cast("int").alias("label"))
    assert rows.where("doc_id < 14000 and label = 1").count() == 6
    model = toxicity.train(rows.withColumn("text", F.when(F.col("doc_id") < 14000, F.col("text")).otherwise("a fine day")))
    assert model.word_scores([b"rarest", b"day"]).tolist()[0] > 3


def test_toxicity_is_a_noisy_or():
    model = toxicity.Model.of({b"bad": 2.0, b"ill": 1.0}, -1.0)
    s = lambda z: 1 / (1 + np.exp(-z))
    assert model.scores(["Bad! so ill. ok"])[0] == pytest.approx(1 - (1 - s(1)) * (1 - s(0)) * (1 - s(-1)))
    assert model.scores(["bad bad"])[0] == pytest.approx(s(1))


def test_toxicity_features_are_a_words_runs():
    """Equal runs of bytes have one slot, wherever they are; others have their own."""
    words = ["idiotic", "idiots", "mür", "other", "of"]
    slot, owner = next(toxicity.word_slots([w.encode() for w in words]))
    runs = [{("", w), *((n, f"<{w}>".encode()[i : i + n]) for n in toxicity.RUNS for i in range(len(w.encode()) + 3 - n))} for w in words[:4]] + [set()]
    for i in range(len(words)):
        assert len(set(slot[owner == i].tolist())) == len(runs[i])
        for j in range(len(words)):
            assert len(set(slot[owner == i].tolist()) & set(slot[owner == j].tolist())) == len(runs[i] & runs[j])


def test_toxicity_gradient_by_differences():
    rng = np.random.default_rng(4)
    sentence, word, text = np.array([0, 0, 1, 2, 3, 3, 4]), np.array([0, 1, 1, 2, 0, 2, 3]), np.array([0, 0, 1, 2, 2, 3])
    slot, owner, y = np.array([0, 1, 1, 2, 0]), np.array([0, 0, 1, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    w = rng.normal(size=4)
    at = lambda x: toxicity.loss(x, sentence, word, text, slot, owner, y, 4, 0.3, 2.0)
    for i in range(4):
        d = np.eye(4)[i] * 1e-5
        assert at(w)[1][i] == pytest.approx((at(w + d)[0] - at(w - d)[0]) / 2e-5, abs=1e-6)
    # the likelihood itself, by its definition
    score = [w[0] + w[1], w[1], w[2], w[0]]
    p = [1 / (1 + np.exp(-(w[3] + sum(score[b] for a, b in zip(sentence, word, strict=True) if a == s)))) for s in range(6)]
    docs = [1 - np.prod([1 - p[s] for s in range(6) if text[s] == d]) for d in range(4)]
    assert at(w)[0] == pytest.approx(np.mean([2 * np.log(docs[d]) if y[d] else np.log(1 - docs[d]) for d in range(4)]) - 0.3 * (w[:3] ** 2).sum() / 8)


def test_toxicity_knows_new_forms_of_a_stem(spark):
    rows = [(i, f"all is well. so gromfel{i % 13}x it is" if i % 4 == 0 else f"all is well. so gentle{i % 13}x it is", int(i % 4 == 0)) for i in range(200)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert model.scores(["so gromfelig it is"])[0] >= 0.3 > model.scores(["so gentleig it is"])[0]


def test_toxicity_held_out(spark):
    """By language, at the threshold: 69 toxic documents in English, 20 in German, 20 in French, 11 in Spanish."""
    sf = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    for lang, least in (("en", 0.85), ("de", 0.8), ("fr", 0.85), ("es", 0.7)):
        own = out[out.lang == lang]
        assert own[own.toxic == 1].predicted.mean() >= least
        assert own[own.toxic == 0].predicted.mean() <= 0.04
    assert (out[out.predicted == 1].offending.map(len) > 0).mean() > 0.8


def test_scores_of_odd_rows(spark):
    model = toxicity.Model.of({b"bad": 2.0}, -3.0)
    out = toxicity.score(clashing(spark, ODD), model).collect()
    assert len(out) == len(ODD)
    assert all(0 <= r.score <= 1 for r in out)
    assert toxicity.accept(clashing(spark, ODD), model).columns == clashing(spark, ODD).columns
    empty = clashing(spark, ODD).limit(0)
    assert toxicity.score(empty, toxicity.train(empty.select("doc_id", "text", F.lit(1).alias("label")))).count() == 0


@pytest.fixture(scope="module")
def speaker(spark):
    return language.train(documents(spark).where(queries.fold(3) != 1))


def test_language_held_out(spark, speaker):
    df = documents(spark)
    out = language.identify(df, speaker).join(df.select("doc_id", "lang"), "doc_id").where(queries.fold(3) == 1).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95


def test_language_of_mixed_text(spark, speaker):
    texts = {lang: " ".join(df_text.split()[:12]) for lang, df_text in documents(spark).where("n_chars > 500").groupBy("lang").agg(F.max("text")).collect()}
    words = language.label_words(texts["en"] + " " + texts["fr"], speaker)
    first = len(language.words_of(texts["en"]))
    assert sum(lang == "en" for _, lang, _ in words[:first]) >= 0.8 * first
    assert sum(lang == "fr" for _, lang, _ in words[first:]) >= 0.8 * (len(words) - first)


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], {}, rng.normal(size=(language.SLOTS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    words = [b"ab", b"cd", b"ab", b"xyz"]
    e = np.log(model.emissions(words))
    post = np.zeros((4, 3))
    for tags in itertools.product(range(3), repeat=4):
        p = np.exp(model.start[tags[0]] + sum(e[i][t] for i, t in enumerate(tags)) + sum(model.move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        for i, t in enumerate(tags):
            post[i, t] += p
    (got,) = model.posteriors(["ab cd ab xyz"], summed=False)
    assert np.allclose(got, post / post.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_gradient_by_differences():
    rng = np.random.default_rng(7)
    data = language.Sequences(rng.integers(0, 3, (4, 5)), rng.integers(0, 2, (4, 5)), np.array([1, 2, 3, 1, 4, 0]), np.array([2, 3, 1]))
    params = [rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]
    _, grads = language.gradient(params, data, 0.01)
    for i, p in enumerate(params):
        for at in np.ndindex(p.shape):
            ends = []
            for d in (1e-5, -1e-5):
                moved = [q.copy() for q in params]
                moved[i][at] += d
                ends.append(language.gradient(moved, data, 0.01)[0])
            assert grads[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_language_reads_words_to_their_end(monkeypatch):
    a, b = "x" * 60 + "ung", "x" * 60 + "tion"
    assert set(language.features(a.encode(), {})) != set(language.features(b.encode(), {}))
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], {}, rng.normal(size=(language.SLOTS, 2)), np.zeros((2, 2)), np.zeros(2))
    word = ("zß" * 700).encode()
    want = model.weight[language.features(word, {})].sum(axis=0)
    monkeypatch.setattr(language, "LONG", 50)
    assert np.allclose(model._long(word), want)


def test_language_spans(spark, speaker):
    texts = {lang: " ".join(t.split()[:12]) for lang, t in documents(spark).where("n_chars > 500").groupBy("lang").agg(F.max("text")).collect()}
    df = spark.createDataFrame([(1, texts["en"] + " " + texts["de"]), (2, None), (3, "...")], "doc_id long, text string")
    out = {r.doc_id: r for r in language.identify(df, speaker, spans=True).collect()}
    assert [out[2].spans, out[3].spans, out[2].lang_pred] == [[], [], "und"]
    runs = out[1].spans
    assert runs[0].first == 0 and all(x.end == y.first for x, y in zip(runs, runs[1:], strict=False))
    first = len(language.words_of(texts["en"]))
    assert sum(max(0, min(r.end, first) - r.first) for r in runs if r.lang == "en") >= 0.8 * first


def test_language_odd_rows(spark, speaker):
    out = {(r.doc_id, r.lang_pred) for r in language.identify(clashing(spark, ODD), speaker).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und")} <= out
    assert language.identify(clashing(spark, ODD).limit(0), language.fit([], [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header class="site-header">Shop</header><nav><ul><li><a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><article><header><h1>Title {n}</h1></header><p>First &amp; <b>bo</b>ld<i>er</i> {n}.<p>Second&nbsp;line<br>here {n}
<script>var x = "<p>no</p>";</script><form><input value=1><button>Go</button></form><ul><li>one {n}<li>two {n}</ul></article></div>
<aside>Side</aside><section id="comments"><p>Nice {n}!</p></section><div class="sidebar"><p>More</p></div><!-- <p>hidden</p> --><footer>Foot &copy;</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(12)]
    out = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Title {i} First & bolder {i}. Second line here {i} one {i} two {i}" for i in range(12)}


def test_importance_cuts_what_repeats(spark):
    """Nothing but the statistics tells these blocks apart."""
    rows = [(i, "http://a.example.com/", f"<body><div class=x1>Always the same</div><div class=y{i % 1}>Own text number {i} of {i * 7}</div></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for held in (site_tree.HELD, 0):
        out = {r.page_id: r.text for r in site_tree.extract(df, held=held).collect()}
        assert out == {i: f"Own text number {i} of {i * 7}" for i in range(40)}


def brute_cut(rows):
    """Hosts, nodes and importance by the definition, over the distinct bodies of each host (no article, so one body)."""
    import math
    from collections import Counter, defaultdict

    bodies = defaultdict(set)
    for _, url, page in rows:
        blocks, children = site_tree.parse(page)
        seen = {(n, 0, 0) for n in [*children, *(b[0] for b in blocks)]} | {(n, 1, "/".join(c)) for n, (c, _) in children.items()} | {(n, 2, t) for n, t, _, _ in blocks}
        bodies[url.split("/")[2]].add((tuple(sorted(seen, key=repr)), tuple(t for _, t, _, _ in blocks)))

    def importance(some):
        count = defaultdict(Counter)
        for features, _ in some:
            for n, kind, value in features:
                count[n, kind][value] += 1
        out = {}
        for n in {n for n, _ in count}:
            m, styles, texts = count[n, 0][0], count[n, 1], count[n, 2]
            style = -sum(x / styles.total() * math.log(x / styles.total(), m) for x in styles.values()) if styles and m > 1 else 0
            leaf = 1 - sum(x / texts.total() * math.log(x, m) for x in texts.values()) if texts and m > 1 else 0
            out[n] = (max(style, leaf) if m > 1 else 1, m, bool(texts))
        return out

    every = importance(set().union(*bodies.values()))
    cut = set()
    for host, some in bodies.items():
        for n, (value, m, texts) in importance(some).items():
            all_value, all_m, _ = every[n]
            if texts and all_m > 2 and (value * m + all_value * site_tree.PRIOR_PAGES) / (m + site_tree.PRIOR_PAGES) < site_tree.LEAST:
                cut.add((site_tree._hash(host), n))
    return cut


def test_importance_against_brute_force(spark):
    """Several hosts with layouts of their own, names without meaning, no article: the tree alone finds the text."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(160):
        h = int(rng.integers(4))
        own = [f"text {i} of {rng.integers(10**6)} x" for _ in range(1 + i % 3)]
        bars = [f"<div class=q{h}><span>all of host {h}</span></div>", f"<div class=z><p>{'odd' if i % 3 else 'even'} bar</p></div>", "<div class=w>one for all</div>"]
        page = "<body>" + "".join(bars[: 1 + h % 3]) + f"<div class=t{h}>" + "".join(f"<p>{t}</p>" for t in own) + f"</div>{bars[2]}</body>"
        rows.append((i, f"http://h{h}.example.org/{i}", page))
        want[i] = " ".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.host, r.path) for r in site_tree.cut_nodes(df).collect()} == brute_cut(rows)
    assert {r.page_id: r.text for r in site_tree.extract(df).collect()} == want


@pytest.mark.parametrize("part", ["<a '", "<div>", "<li>", "<p><x>", "<ul><div>", '<a "b', "</p>", "<!", "<script>", "<td><div>", "<article><p>a<div></p>"])
def test_long_pages_take_time_in_proportion(part):
    import time

    began = time.perf_counter()
    site_tree.parse(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("page", ["<article><p>{a}</p></article><div>{n} read this</div>", "<div><p>{a}</p></div>"])
def test_copies_of_an_article_are_no_boilerplate(spark, page):
    """A host of copies only, one where four of five pages are copies, and a mirror of one page on each of many hosts."""
    same, own = "The one article", "Own text number {} of {}"
    texts = {i: same for i in range(400)} | {i: own.format(i, i * 7) for i in range(400) if 100 <= i < 300 and i % 5 == 0}
    host = lambda i: "copies" if i < 100 else "mixed" if i < 300 else f"mirror{i}"
    rows = [(i, f"http://{host(i)}.example.com/?q={i}", "<body>" + page.format(a=t, n=i) + "</body>") for i, t in texts.items()]
    out = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == texts


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert out[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())


def test_pages_of_odd_kinds(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (3, "nohost", "plain < text &lt;b&gt;", "x"), (None, "http://X/", "<p>a" + "<div>" * 500 + "deep", "x"), (4, "http://x/", "<nav>only</nav>", "x"), (4, "http://x/", "<nav>only</nav>", "x"), (5, "http://x/", "<p>" + "w " * 100000, "x")]
    out = sorted((str(r.page_id), r.text[:20]) for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect())
    assert out == [("1", ""), ("2", ""), ("3", "plain < text <b>"), ("4", ""), ("4", ""), ("5", "w " * 10), ("None", "a deep")]
    assert site_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_parts(spark):
    cases = {"http://A.B.c/d/E?x#y": ("a.b.c", "/d/E"), "x://h": ("h", ""), "//h/p": ("", ""), None: ("", ""), "http://É.com?q=://z/": ("É.com", ""), "a://b#/c": ("b", "")}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", url_reputation.host_of(F.col("url")).alias("h"), url_reputation.path_of(F.col("url")).alias("p")).collect()}
    assert got == cases


def test_registered_domains(spark):
    cases = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.github.io:80": ("x.github.io", "github.io"), "a.b.c": ("b.c", "c"), "localhost:8080": ("localhost", "localhost"), "": ("", ""), "xco.uk": ("xco.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    domain, suffix = url_reputation.site_of(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == cases


def test_posteriors_by_hand(spark):
    """Two hosts of one domain, 8 of 10 and 1 of 10 pages bad, and one of another, 2 of 4, all under one suffix."""
    rows = [(i, f"http://{'a.x' if i < 10 else 'b.x' if i < 20 else 'c.y'}.org/{i}") for i in range(24)]
    bad = {*range(8), 10, 20, 21}
    out = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, int(i in bad)) for i in range(24)], "page_id long, bad int")).collect()}

    def strength(groups):  # moments of the rates around the mean rate
        x, m, k = sum(b for _, b in groups), sum(n for n, _ in groups), len(groups)
        mean, free = x / m, m - sum(n * n for n, _ in groups) / m - (k - 1)
        rho = (sum(n * (b / n - mean) ** 2 for n, b in groups) / (mean * (1 - mean)) - (k - 1)) / free if free > 0 else 0
        return min(max((1 - rho) / rho, 1), 1000) if rho > 0.000999 else 1000

    k1, k2, k3 = strength([(24, 11)]), strength([(20, 9), (4, 2)]), strength([(10, 8), (10, 1), (4, 2)])
    suffix = (11 + k1 * 12 / 26) / (24 + k1)
    x = (9 + k2 * suffix) / (20 + k2)
    assert 1 <= k3 < 1000
    assert out["a.x.org"].posterior == pytest.approx((8 + k3 * x) / (10 + k3))
    assert out["b.x.org"].posterior == pytest.approx((1 + k3 * x) / (10 + k3))


def test_url_verdicts(spark):
    rows = [(i, "http://bad.x.com/", "h") for i in range(30)] + [(100 + i, "http://good.x.com/", "h") for i in range(30)] + [(200, "http://bad.x.com/en/7", "h"), (201, None, "h"), (202, "http://new.y.org/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    marks = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(3, 1), (None, 1), (5, None)], "page_id long, bad int")
    out = {r.page_id: (r.verdict, r.rule) for r in url_reputation.judge_urls(pages, marks, [("allow", "x.com/en/"), ("block", "org/")]).collect()}
    assert len(out) == len(rows)
    assert out[0] == ("block", None)
    assert out[100] == ("allow", None)
    assert out[200] == ("allow", "x.com/en/")
    assert out[201] == ("allow", None)
    assert out[202] == ("block", "org/")
    assert url_reputation.judge_urls(pages.limit(0), marks.limit(0), []).count() == 0


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion"


def test_leaks(spark):
    words = ITEM.split()
    edited = " ".join(["QUICK," if w == "quick" else "cats" if w == "dog" else w for w in words if w != "while"])
    docs = clashing(spark, [(1, "noise " * 30 + ITEM.title() + ". more noise", "a"), (2, "x " + edited + " y", "a"), (3, "the quick brown cat sat with seven wizards in the lazy sun " * 3, "a"), *ODD[:4], (None, ITEM, "b"), (9, ITEM, "c"), (9, ITEM, "c")])
    bench = spark.createDataFrame([(7, ITEM, "x"), (8, "a b", "x"), (9, None, "x")], "item_id long, text string, doc_id string")
    out = sorted((str(r.doc_id), r.item_id, round(r.score, 2)) for r in decontaminate.leaks(docs, bench).collect())
    assert [x[:2] for x in out] == [("1", 7), ("2", 7), ("9", 7), ("9", 7), ("None", 7)]
    assert out[0][2] == 1.0 > out[1][2] >= 0.5
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["1", "2", "3", "3", "None"]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(d, b.item_id) for b in bench.collect() for d, t in texts.items() if b.text in t}
    assert exact <= {(r[0], r[1]) for r in whole}


def brute_align(a, b):
    score = np.zeros((len(b) + 1, len(a) + 1), int)
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            m = 1 if a[j - 1] == b[i - 1] > 0 else -1
            score[i, j] = max(0, score[i - 1, j - 1] + m, score[i - 1, j] - 1, score[i, j - 1] - 1)
    return int(score.max())


def test_alignment_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(0, 30))
        best, first, end = decontaminate.align(a, b)
        assert best == brute_align(a, b)
        if best:  # the span holds the alignment: it scores as much, and needs its first and last word
            assert brute_align(a, b[first:end]) == best > max(brute_align(a, b[first + 1 : end]), brute_align(a, b[first : end - 1]))


def test_recall_of_edited_copies(spark):
    """Items with up to a fifth of the words replaced, left out and added: what brute-force alignment finds at 0.5 is found.
    Copies of very short items may keep no three words together, and have no seed."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [list(rng.choice(vocab, n)) for n in [4, 5, 6, 8, 9, 12, 16, 25, 40, 60] * 6]
    docs = []
    for i in range(300):
        w = list(items[i % len(items)])
        for _ in range(int(rng.integers(0, 1 + len(w) // 5))):
            at, how = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (how < 2)] = [] if how == 0 and len(w) > 3 else [str(rng.choice(vocab))]
        docs.append([*rng.choice(vocab, int(rng.integers(0, 20))), *w, *rng.choice(vocab, int(rng.integers(0, 20)))])
    number = {v: i + 1 for i, v in enumerate(vocab)}
    code = lambda ws: np.array([number[w] for w in ws])
    want = {(d, i) for d, ws in enumerate(docs) for i in [d % len(items)] if 2 * decontaminate.align(code(items[i]), code(ws))[0] >= len(items[i])}
    out = decontaminate.leaks(spark.createDataFrame([(d, " ".join(ws)) for d, ws in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    long = {(d, i) for d, i in want if len(items[i]) >= 8}
    assert len(long) > 150 and len(long & found) >= 0.98 * len(long)
    assert len(want) > 250 and len(want & found) >= 0.9 * len(want)
    print("recall", len(long & found) / len(long), len(want & found) / len(want), sorted(len(items[i]) for _, i in want - found))
    for r in out:
        assert 2 * decontaminate.align(code(items[r.item_id]), code(docs[r.doc_id]))[0] >= len(items[r.item_id])


def test_imatch_holds_little(spark):
    """Counts are summed in the task, whatever the pieces; texts reach Python once, in one worker a task."""
    texts = [f"common w{i % 50} v{i} " + "pad " * 2000 for i in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 200])], names=["text"]) for i in range(0, 600, 200)]
    got = [x for b in imatch._frequencies(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len({t for t, _ in got}) == 652
    assert sorted(n for _, n in got) == [1] * 600 + [12] * 50 + [600] * 2
    plan = imatch.fingerprints(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" :+-").split(" ")[0] for x in plan.splitlines()]
    assert "MapInArrow" in lines and ("MapInArrow", "MapInArrow") not in [(a, b) for a, b in zip([x for x in lines if x != "Project"], [x for x in lines if x != "Project"][1:])]


def test_pipeline(spark):
    import corpus_pipeline

    docs, steps = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        steps[name] = docs.toPandas()
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert len(steps["line_dedup"]) == len(steps["toxicity"])
    kept = steps["line_dedup"]
    near = {r.doc_id for r in near_copies.near_copies(spark.createDataFrame(kept)).where("doc_id = component_id").collect()}
    assert set(steps["simhash_dedup"].doc_id) == near
    assert set(steps["decontamination"].doc_id) <= near
    assert sorted(steps["mixing"].doc_id) == sorted(steps["decontamination"].doc_id)


def test_pipeline_of_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, further columns with clashing names; and none."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, t long, score double, `row` string, d string"
    rows = [(*r, None, 1, 0.5, None, "d") for r in [(1, None, None, "a"), (2, "", "en", None), (None, None, None, None), (3, "one two\nthree four five six", "en", "a"), (3, "one two\nthree four five six", "en", "a"), (3, "seven eight nine ten eleven", None, "b"), (None, "once upon a time in the west", "en", "b"), (None, "once upon a time in the west", "en", "b"), (4, "z " * 30_000, "de", "c"), (5, "x" * 50_000, "fr", "c")]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "mixing":
                assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name == "line_dedup":
                assert docs.count() == len(data)
            if name == "simhash_dedup":
                assert sorted(str((r.doc_id, (r.text or "")[:10])) for r in docs.collect()) == sorted(["(1, '')", "(3, 'one two\\nth')", "(3, 'seven eigh')", "(None, 'once upon ')", "(4, 'z z z z z ')", "(5, 'xxxxxxxxxx')"] if data else [])
        assert docs.count() == (6 if data else 0)
