"""Language, toxicity and page models: held-out accuracy, brute-force parts, odd rows."""

import random
import zlib

import pytest

from raresight.llm import html_crf, langid, toxicity

SF = "/root/testdata/sf0.01"


def longest_match_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, n = max(at + 1, end - 1), n + 1
    return n


@pytest.mark.parametrize("step", [4, 32, 512])
def test_phrases_match_plain_search(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    monkeypatch.setattr(langid, "SLICE", 2 * step)
    monkeypatch.setattr(langid, "LANES", 2)
    samples = {"a": "abracadabra banana ", "b": "the cat sat on the mat ", "c": "zzz"}
    parser = langid.Parser(samples)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdzthe nmt?é", k=rng.randint(0, 90))) for _ in range(60)] + ["", "banana" * 300, "ab" * step, "z" * (6 * step)]
    texts += ["the cat sat " * step, "at the mat nabc" * step, "zz?" * step]
    got = parser.phrases(texts)
    for text, row in zip(texts, got):
        assert row.tolist() == [longest_match_phrases(text, samples[lang]) for lang in parser.langs]


def test_phrases_of_long_texts_in_many_scripts():
    rng = random.Random(7)

    def words(first, last, n):
        stock = ["".join(chr(rng.randint(first, last)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
        return lambda k: " ".join(rng.choice(stock) for _ in range(k)), n

    makers = {"el": words(0x3B1, 0x3C9, 300), "ru": words(0x430, 0x44F, 300), "zh": words(0x4E00, 0x4F20, 400), "en": words(97, 122, 300), "hi": words(0x905, 0x939, 300), "x": words(0x1F600, 0x1F640, 200)}
    samples = {name: make(n) for name, (make, n) in makers.items()}
    parser = langid.Parser(samples)
    assert len(parser.known) > 3 * langid.DENSE
    texts = [make(4_000) for make, _ in makers.values()]
    texts.append(" ".join(make(400) for make, _ in makers.values()) + "".join(chr(rng.randint(0x4E00, 0x5200)) for _ in range(3_000)))
    texts.append("".join(map(chr, range(0x4E00, 0x4E0B))) * 1_000)  # never in step
    assert min(map(len, texts)) > 10_000
    for text, row in zip(texts, parser.phrases(texts)):
        assert row.tolist() == [longest_match_phrases(text, samples[lang]) for lang in parser.langs]
    # no letter in the last
    assert parser.predict(texts[:6])[0] == ["el", "ru", "zh", "en", "hi", langid.UNKNOWN]


def test_language_held_out(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parser = langid.fit(docs.where(~langid.held_out(langid.F.col("doc_id"))))
    held = docs.where(langid.held_out(langid.F.col("doc_id")))
    out = held.select("doc_id", "lang", langid.identify(spark, parser, langid.F.col("text")).alias("x")).select("doc_id", "lang", "x.*").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    odd = docs_of([(1, None, None, None), (2, "", None, None), (3, "12 ?!\n", None, None), (4, "the and of " * 100_000, None, None), (5, "é", None, None)])
    found = {r["doc_id"]: r for r in odd.select("doc_id", langid.identify(spark, parser, langid.F.col("text")).alias("x")).select("doc_id", "x.*").collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    assert found[4]["lang_pred"] == "en" and found[5]["lang_pred"] in parser.langs


def test_language_without_training(spark, docs_of):
    docs = docs_of([(1, "hello", None, None), (2, None, "en", None), (3, "", "en", None)])
    parser = langid.fit(docs)
    assert {r["x"]["lang_pred"] for r in docs.select(langid.identify(spark, parser, langid.F.col("text")).alias("x")).collect()} == {"und"}
    assert langid.fit(docs.limit(0)).langs == []


def test_toxicity_held_out(spark, docs_of):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert list(model.cuts) == sorted(model.cuts)
    out = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", toxicity.severity(spark, model, toxicity.F.col("text")).alias("x")).select("toxic", "x.*").collect()
    caught = [r["p_toxic"] >= toxicity.REJECT for r in out if r["toxic"]]
    wrong = [r["p_toxic"] >= toxicity.REJECT for r in out if not r["toxic"]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.01 * len(wrong)
    assert all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in out)
    odd = docs_of([(1, None, None, None), (2, "", None, None), (3, "nice " * 200_000, None, None)])
    assert [r["x"]["grade"] for r in odd.select(toxicity.severity(spark, model, toxicity.F.col("text")).alias("x")).collect()] == [0, 0, 0]
    assert toxicity.fit(docs_of([]), labels).weights == {} == toxicity.fit(docs, labels.limit(0)).weights
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs_of([(1, "x", None, None), (2, None, None, None)]), nulls).weights == {}


def test_ordinal_fit_against_a_plain_likelihood():
    import math

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    true = dict(zip(vocabulary, (2.0, 1.5, 1.0, 0.5, 0.0, -1.0)))
    rows = [{w: rng.randint(1, 4) for w in vocabulary if rng.random() < 0.4} for _ in range(400)]
    noisy = [sum(true[w] * math.log1p(n) for w, n in r.items()) + rng.gauss(0, 1) for r in rows]
    grades = [sum(x > c for c in (1.5, 3.0)) for x in noisy]
    model = toxicity.train(rows, grades, vocabulary)

    def loss(w, cuts):
        total = 0.0
        for row, y in zip(rows, grades):
            x = sum(w.get(t, 0.0) * math.log1p(n) for t, n in row.items())
            for g, cut in enumerate(cuts, start=1):
                p = 1 / (1 + math.exp(cut - x))
                total -= math.log(p if y >= g else 1 - p)
        return total / len(rows)

    # the smallest penalised loss: no slope but the penalty's
    w, cuts, d = dict(model.weights), model.cuts.tolist(), 1e-5
    assert cuts == sorted(cuts)
    for word in vocabulary:
        up, down = dict(w), dict(w)
        up[word], down[word] = w.get(word, 0.0) + d, w.get(word, 0.0) - d
        slope = (loss(up, cuts) - loss(down, cuts)) / (2 * d)
        if word in w:
            assert slope == pytest.approx(-math.copysign(toxicity.L1, w[word]), abs=1e-4)
        else:
            assert abs(slope) <= toxicity.L1 + 1e-4
    for g in range(2):
        up, down = list(cuts), list(cuts)
        up[g], down[g] = cuts[g] + d, cuts[g] - d
        assert (loss(w, up) - loss(w, down)) / (2 * d) == pytest.approx(0, abs=1e-4)


def test_severity_is_the_expected_grade(spark, docs_of):
    import math

    model = toxicity.Model({"bad": 1.5, "awfu*": 0.75}, [0.5, 2.0])
    texts = ["bad bad awful", "awfully BAD", "fine words", "", None, "awful " * 50]
    out = docs_of([(i, t, None, None) for i, t in enumerate(texts)]).select("doc_id", toxicity.severity(spark, model, toxicity.F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    for r in out:
        words = (texts[r["doc_id"]] or "").lower().split()
        bad, awful = words.count("bad"), sum(w.startswith("awfu") for w in words)
        x = 1.5 * math.log1p(bad) + 0.75 * math.log1p(awful)
        above = [1 / (1 + math.exp(c - x)) if words else 0.0 for c in (0.5, 2.0)]
        chance = [1 - above[0], above[0] - above[1], above[1]]
        assert r["severity"] == pytest.approx(sum(g * p for g, p in enumerate(chance)))
        assert r["p_toxic"] == pytest.approx(above[0]) and r["grade"] == max(range(3), key=chance.__getitem__)


@pytest.fixture(scope="module")
def page_model(spark):
    return html_crf.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def test_pages(spark, page_model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = pages.select("html", html_crf.main_text(spark, page_model, html_crf.F.col("html")).alias("t")).collect()
    for r in got:
        article = html_crf.leaf_blocks(r["html"][r["html"].index("<article>") : r["html"].index("</article>")])
        assert r["t"] == "\n".join(b.text for b in article)


def test_made_up_layouts(page_model):
    rng, wrong, n = random.Random(77), 0, 0
    texts = [["Some heading of it", *(f"Paragraph {i} has a number of words, and then it ends after a while. So it goes." for i in range(5))] for _ in range(60)]
    for paragraphs in texts:
        blocks = [b for b in html_crf.labelled_blocks(html_crf.layout(paragraphs, rng)) if b.gold is not None]
        wrong += sum(int(b.gold != y) for b, y in zip(blocks, page_model.decode(blocks)))
        n += len(blocks)
    assert wrong <= 0.03 * n


def test_viterbi_is_the_best_path(page_model):
    import itertools

    blocks = html_crf.leaf_blocks("<div class=menu>a</div><p>Some words here.</p><div>b</div><footer>c</footer><p>d e f.</p>")
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda y: page_model.start[y[0]] + sum(page_model.evidence(b) * t for b, t in zip(blocks, y)) + sum(page_model.steps[a, b] for a, b in zip(y, y[1:])))
    assert page_model.decode(blocks) == list(best)


@pytest.mark.parametrize("start", ["<body>", "<p>", "<div><p>", "<img src=x>", "", "<body><header>Menu</header><p>", "<span>"])
def test_head_without_an_end(start):
    head = '<!doctype html><html><head>\n<meta charset=x><title>Not <p>this</title><!-- nor this -->\n<script>"<p>"</script><link rel=y>\n'
    plain, whole = head + start + "The article.</p><p>Its end.", head + "</head>" + start + "The article.</p><p>Its end."
    texts = [b.text for b in html_crf.leaf_blocks(plain)]
    assert texts[-2:] == ["The article.", "Its end."] and not any("this" in t for t in texts)
    assert texts == [b.text for b in html_crf.leaf_blocks(whole)]


def test_a_late_digit_counts():
    for text, found in (("word " * 100 + "7", True), ("word " * 100 + "²", True), ("word " * 100, False)):
        assert f"d:{found}" in html_crf.text_features(html_crf.Block((), text))


def test_odd_pages(spark, page_model):
    cut_off = '<article><p>One &amp; two&nbsp;&lt;b&gt;  x<br>y</p><p>open <b>bold<script>var a="</p>";</script><style>p{}</style><!-- no --> end'
    long = "<article>" + "<p>Many words stand in this one, they do.</p>" * 20_000
    rows = [(1, None), (2, ""), (3, cut_off), (4, long), (5, "<<>< <a <b"), (6, "plain words only"), (7, "<div>" * 3_000 + "deep")]
    frame = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    out = {r["page_id"]: r["t"] for r in frame.select("page_id", html_crf.main_text(spark, page_model, html_crf.F.col("html")).alias("t")).collect()}
    assert out[1] == out[2] == ""
    assert out[3] == "One & two <b> x y\nopen bold end"
    assert out[4].count("\n") == 19_999
    assert html_crf.fit(frame.limit(0)).weights


def test_page_gold_and_closed_tags():
    texts = lambda page: [(b.text, b.linked) for b in html_crf.leaf_blocks(page)]
    assert texts('<p data-gold="x">y</p>') == [("y", 0)] and html_crf.leaf_blocks('<p data-gold="1">y</p>')[0].gold is None
    assert texts("<script src=/a.js/>var x=1;</script><p>t</p>") == [("t", 0)]
    assert texts("<a href=http://x.com/>link</a> more") == [("link more", 4)]
    assert texts('<svg><path d="m"/><g/></svg><svg/><p>after</p>') == [("after", 0)]
    assert texts("<div/>inside") == [("inside", 0)]


def test_page_depth_costs_no_square():
    import time
    import tracemalloc

    tracemalloc.start()
    blocks = html_crf.leaf_blocks("<div class=a>a" * 50_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 50_000 and most < 200e6
    assert sorted(html_crf.path_features(blocks[-1].node)) == ["a:div", "c:a", "n:div/div", "t:div"]
    began = time.time()
    html_crf.leaf_blocks("<b>" + "<div>a" * 20_000 + "</b>" * 20_000 + "</i>" * 20_000 + "<p>" * 20_000)
    field = html_crf.Field({"a:div": 1.0}, html_crf.np.zeros((2, 2)), html_crf.np.zeros(2))
    assert field.decode(blocks) == [1] * 50_000 and time.time() - began < 20
