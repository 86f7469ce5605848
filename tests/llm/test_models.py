"""Language identification, quality, HTML extraction and the pipeline."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathlib import Path

from gramweave.llm import html_extract, language_id, weak_quality

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

SYLLABLES = {"en": ["the", "ing", "and", "was", "her"], "de": ["ung", "sch", "ein", "lich", "der"], "fr": ["eau", "eux", "que", "le", "tion"]}


def _documents(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(4, 60))]
        rows.append((k, " ".join(words).capitalize() + ".", lang))
    return rows


def test_language_on_held_out_rows(spark):
    rows = _documents(400)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "de"), (1003, "the and", None), (None, "the ing", "en"), (1004, "der ung " * 5000, "de"), (5, "Ein lich.", "de")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, lang string, score int, lang_pred string").repartition(3)
    model = language_id.train(docs, per_language=60, landmarks=8)
    found = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0 and r[0] != 5]
    assert held and np.mean([found[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert [found[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and found[1002].score == 0
    assert found[1004].lang_pred == "de" and all(0 <= r.score <= 1 for r in found.values())


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.train(docs) is None
    assert [tuple(r) for r in language_id.identify(docs, None).collect()] == [(1, "und", 0.0)]
    assert language_id.identify(docs.limit(0), None).collect() == []


def test_presence_kernel():
    grams = language_id.Grams()
    a, b = grams.cells("The same text"), grams.cells("the SAME text")
    assert (a == b).all() and grams.cells(" 12 !") is None and grams.cells(None) is None
    rows = [("x", grams.cells("abcabc")), ("y", grams.cells("zzyyxx"))]
    model = language_id.fit(rows, landmarks=2)
    scores = model.scores([c for _, c in rows])
    assert scores.argmax(1).tolist() == [0, 1]
    kernel = model.presence([rows[0][1]]) @ model.landmarks
    assert kernel.max() == pytest.approx(1.0, abs=1e-5)


def test_expectation_maximisation():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.75
    votes = np.full((4000, 5), weak_quality.NONE)
    for k in range(5):
        cast = rng.random(4000) < 0.6
        wrong = rng.random(4000) < (0.03 if k < 4 else 0.3)
        votes[cast, k] = np.where(truth ^ wrong, weak_quality.GOOD, weak_quality.BAD)[cast]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.expect_maximise(patterns, counts.astype(float))
    assert abs(model.good - truth.mean()) < 0.05
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.93
    rate = model.votes[:, weak_quality.BAD, weak_quality.BAD] / model.votes[:, weak_quality.BAD, :2].sum(1)
    assert rate[:4].min() > rate[4]  # the careless labeller is found


ODD = [
    ("three rows", [(k % 3, ["The cat sat on the mat and then it slept.", "Und der Hund lief in den Wald ein.", "xq## !! @@ $$ zz ## !! && %% ~~ == xq ## !!"][k % 3], ["en", "de", "en"][k % 3]) for k in range(6000)]),
    ("one doc_id", [(9155, f"The cat {k} sat on the mat number {k}." if k % 2 else f"Und der Hund {k} lief in den Wald.", "en" if k % 2 else "de") for k in range(6000)]),
    ("no doc_id", [(None, f"The cat {k} sat.", "en") for k in range(600)]),
]


@pytest.mark.parametrize("name, rows", ODD)
def test_samples_of_repeated_rows(spark, monkeypatch, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sizes = []
    fit = weak_quality.fit_scorer
    monkeypatch.setattr(weak_quality, "fit_scorer", lambda found, target, **more: (sizes.append(len(found)), fit(found, target, **more))[1])
    quality = weak_quality.train(docs, sample=50)
    assert quality is not None and sizes == [3 if name == "three rows" else 50]
    if name == "three rows":
        kept = {r.doc_id: r._score for r in weak_quality.classify(docs, quality).collect()}
        assert kept[2] < weak_quality.LEAST < min(kept[0], kept[1])
    learnt = []
    learn = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda found, *more: (learnt.append(Counter(lang for lang, _ in found)), learn(found, *more))[1])
    model = language_id.train(docs, per_language=10)
    if name == "no doc_id":
        assert model is None  # they are held out
    else:
        assert model.languages == ["de", "en"] and max(learnt[0].values()) <= 10
        assert sum(learnt[0].values()) <= 3 if name == "three rows" else learnt[0] == {"de": 10, "en": 10}


def test_kept_columns_of_any_name(spark):
    names = ["doc_id", "text", "_score", "score", "lang_pred", "_text", "found0", "_0", "h", "Text"]
    docs = spark.createDataFrame([(1, "The cat.", *"abcdefgh")]).toDF(*names)
    scored = weak_quality.classify(docs, None, tuple(names[:9]))
    assert scored.columns == [*names[:9], "_score"] and [tuple(r) for r in scored.collect()] == [(1, "The cat.", *"abcdefg", 1.0)]
    found = language_id.identify(docs, None, tuple(names[:9]))
    assert [tuple(r) for r in found.collect()] == [(1, "The cat.", *"abcdefg", "und", 0.0)]


def test_expectation_maximisation_by_rows():
    """One step on patterns with counts is the step on single rows."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (300, 4))
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    for rounds in (1, 7):
        a = weak_quality.expect_maximise(patterns, counts.astype(float), rounds)
        good, rate = 0.8, np.zeros((4, 2, 3))
        rate[:, 0], rate[:, 1] = [0.4, 0.2, 0.4], [0.02, 0.58, 0.4]
        for _ in range(rounds):
            weight = []
            for row in rows:
                p = [(1 - good), good]
                for k, v in enumerate(row):
                    p = [p[c] * rate[k, c, v] for c in (0, 1)]
                weight.append([x / sum(p) for x in p])
            rate = np.full((4, 2, 3), 0.5)
            for row, w in zip(rows, weight):
                for k, v in enumerate(row):
                    rate[k, :, v] += w
            rate /= rate.sum(2, keepdims=True)
            for k in range(4):
                over = max(0, rate[k, 1, 0] - rate[k, 0, 0] / 10)
                rate[k, 1, 0] -= over
                rate[k, 1, 2] += over
            good = min(0.98, max(0.02, sum(w[1] for w in weight) / len(rows)))
        assert abs(a.good - good) < 1e-9 and np.allclose(a.votes, rate)


def test_kernel_and_ridge_by_the_definition():
    """Kernel values from sets of n-grams, and the ridge solution in the landmarks' span by least squares."""
    rows = [(lang, text) for _, text, lang in _documents(40, 3)]
    grams = language_id.Grams()
    cells = [(lang, grams.cells(text)) for lang, text in rows]
    model = language_id.fit(sorted(cells, key=lambda r: (r[0], r[1].tobytes())), landmarks=4)
    ordered = sorted(cells, key=lambda r: (r[0], r[1].tobytes()))
    marks = []
    for lang in model.languages:
        own = sorted((c for name, c in ordered if name == lang), key=len)
        marks += [own[k] for k in np.unique(np.linspace(len(own) // 3, len(own) - 1, 4).astype(int))]
    kernel = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(c, m) for m in marks] for _, c in ordered])
    inner = np.array([[kernel(a, m) for m in marks] for a in marks])
    want = np.array([[1.0 if name == lang else -1.0 for lang in model.languages] for name, _ in ordered])
    # min |K a - y|^2 + ridge a' W a, as stacked least squares
    root = np.linalg.cholesky(1e-2 * inner + 1e-6 * np.eye(len(marks))).T
    solved = np.linalg.lstsq(np.vstack([k, root]), np.vstack([want, np.zeros_like(root[:, : want.shape[1]])]), rcond=None)[0]
    assert np.allclose(model.scores([c for _, c in ordered]), k @ solved, atol=1e-3)


@needs_data
def test_quality_against_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = weak_quality.classify(docs, weak_quality.train(docs)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    kept = {q: np.mean([r._score >= weak_quality.LEAST for r in found if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.05


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t", 3), (4, "Plain words make a text.", 4), (4, "Plain words make a text.", 4), (None, "word " * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern int")
    found = sorted(weak_quality.classify(docs, weak_quality.train(docs)).collect(), key=str)
    assert [r._score for r in found if r.doc_id in (1, 2, 3)] == [0, 0, 0] and len(found) == 6
    assert all(0 <= r._score <= 1 for r in found)
    assert weak_quality.train(docs.limit(0)) is None and weak_quality.classify(docs.limit(0), None).collect() == []


CASES = [
    ("<p>a<p>b &lt; c &amp d<br>e<div class='sidebar x'>no</div>f", "a\nb < c & d\ne\nf"),
    ("<nav>n</nav><article><header><h1>T</h1></header><p>x <b>y</b>z</p><div class=comments><p>c</p></div></article><p>out</p>", "T\nx yz"),
    ("plain < text & more", "plain < text & more"),
    ("<main>m<script>if(a<b){'</p>'}</script>n<!-- c --> o</main><p", "mn o"),
    ("<body><p>one</p><form>f</form><p hidden>h</p>two&nbsp;&nbsp;x", "one\ntwo x"),
    ("<article><p><b>Bold.<br><p>Next <i>one", "Bold.\nNext one"),
    ("<article><p>1</p></div></p><p>2</article>", "1\n2"),
    (None, ""),
    ("", ""),
    ("<article><p>" + "long " * 40_000 + "</p></article>", ("long " * 40_000).strip()),
]


def test_extraction(spark):
    rows = [(k // 2, None if k % 2 else f"http://h{k}.example/", h, "x") for k, (h, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = html_extract.extract(pages).collect()
    assert sorted(r.text for r in found) == sorted(t for _, t in CASES)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract(pages.limit(0)).collect() == []


ARTICLE = "<article><h1>T</h1><p>whole text</p></article>"


@pytest.mark.parametrize("page, text", [
    (f"<body class='has-sidebar no-comments'><nav>n</nav>{ARTICLE}<p>out</p>", "T\nwhole text"),
    (f"<html class=nav><body id=comments style='display:none'>{ARTICLE}", "T\nwhole text"),
    (f"<div id=main-with-nav>{ARTICLE}</div>", "T\nwhole text"),
    (f"<div class=banner><div class=sidebar>{ARTICLE}</div></div><p>out</p>", "T\nwhole text"),
    (f"<header>{ARTICLE}</header>", "T\nwhole text"),
    (f"<form><nav>n</nav>{ARTICLE}<input></form>", "T\nwhole text"),
    ("<body class=page-nav><form id=aspnetForm><nav>n</nav><p>whole</p><div class=ad>a</div></form><p>end</p>", "whole\nend"),
    ("<form><p>all</p></form>", "all"),
    ("<article><form><p>all</p></form></article><p>out</p>", "all"),
    ("<article><p>x</p><form><p>f</p></form></article>", "x"),
    ("<div class='post no-share'><p>kept</p></div><div id=share>s</div>", "kept"),
    ("<main>m<div class=comments><article>c</article></div></main>", "m"),
    ("<div class=sidebar><article>teaser</article></div><main>m</main>", "m"),
    ("<p>text</p><aside><article>teaser</article></aside>", "text"),
    ("<aside><article>only</article></aside>", "only"),
])
def test_marks_around_the_article_take_nothing_from_it(page, text):
    assert html_extract.Page(page).text() == text


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_style_tree_removes_what_a_site_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit)
    pages = [(k, "https://user@Site.example:80/p", f"<div class=top><p>Welcome to the site</p></div><div class=body><p>Story {k} begins</p><p>and ends {k * k}</p></div>") for k in range(30)]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Story {k} begins\nand ends {k * k}" for k in range(30)}
    few = html_extract.extract(spark.createDataFrame(pages[:3], "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Welcome") for r in few)  # too few pages to tell


@pytest.mark.parametrize("texts, copies", [(1, 4), (2, 5), (3, 10), (6, 40)])
def test_copies_of_a_page_are_no_boilerplate(spark, texts, copies):
    # scripts are no text, so they don't tell copies apart
    pages = [(k, "http://s.example/", f"<script>{k}</script><div class=top>Menu</div><div class=body><p>Story {k % texts} begins</p></div>") for k in range(texts * copies)]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    menu = "Menu\n" if texts < html_extract.LEAST_PAGES else ""
    assert {r.page_id: r.text for r in found} == {k: f"{menu}Story {k % texts} begins" for k in range(texts * copies)}


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_small_share_of_a_large_host(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit)
    pages = [(k, f"http://{'small' if k >= 300 else 'hot'}.example/", ("<div class=word>Bell rings</div>" if k % 50 == 0 or k >= 300 else "") + f"<p>Story {k}</p>") for k in range(306)]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Story {k}" for k in range(306)}


def test_no_page_loses_all_its_text(spark):
    pages = [(k, None, f"<div class=top>Menu</div><p>Story {k}</p>") for k in range(9)] + [(9, None, "<div class=top>Menu</div>")]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Story {k}" if k < 9 else "Menu" for k in range(10)}


def test_style_tree_removes_repeated_notices_within_articles(spark):
    # copies of a page and the article's own branch are no notices
    pages = [(k, "http://s.example/", f"<div class=x><article><h1>Title {k // 2}</h1><p>Story {k // 2}<p>ends<div class=cta>Get our app</div></article></div><p>out</p>") for k in range(12)]
    pages += [(k, "http://t.example/", "<main><h1>Same</h1><p>text</p></main>") for k in range(12, 20)]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Title {k // 2}\nStory {k // 2}\nends" if k < 12 else "Same\ntext" for k in range(20)}


def test_names_of_nodes():
    page = html_extract.Page("<div id=x class='w-1/2'><main class=a><p>t<p>u</main></div><div id=comments>c</div><div>d</div>")
    (node, *_), (again, *_), (marked, *_), (plain, *_) = page.blocks
    assert node == again and len({node, marked, plain}) == 3 and marked in page.marked and plain not in page.marked
    top = html_extract.child(html_extract.ROOT, "div.w-1/2")
    main = html_extract.child(top, "main.a")
    assert node == html_extract.child(main, "p") and page.roots == {main}
    assert page.removed(frozenset([top, main, node]), True) == {node} and page.removed(frozenset([top]), False) == {top, main, node}


def _importance(sources):
    """Importance of each node of one host by the definition, from the tree of distinct pages."""
    pages = list({str(sorted(f for f in html_extract.features_of(p) if f[0] not in p.marked)): html_extract.features_of(p) for p in map(html_extract.Page, sources)}.values())
    kinds = defaultdict(lambda: defaultdict(Counter))
    for page in pages:
        for node, kind, digest in page:
            kinds[node][kind][digest] += 1
    out, parent = {}, {node: max(k[html_extract.PRESENCE]) for node, k in kinds.items()}
    chain = {}
    for node in kinds:
        chain[node] = [node]
        while chain[node][-1] != html_extract.ROOT:
            chain[node].append(parent[chain[node][-1]])
    for node, own in kinds.items():
        m = sum(own[html_extract.PRESENCE].values())
        entropies = []
        for below, k in kinds.items():
            if node in chain[below]:
                pages_of = sum(k[html_extract.PRESENCE].values())
                # a content of n pages has entropy log n over them, of log m at most
                entropies += [math.log(n) / math.log(pages_of) if pages_of > 1 else 0.0 for n in k[html_extract.CONTENTS].values()]
        looks = own[html_extract.PRESENTATION]
        total = sum(looks.values())
        style = -sum(n / total * math.log(n / total) for n in looks.values()) / math.log(m) if m > 1 and total > 1 else 0.0
        content = 1 - (sum(entropies) / len(entropies) if entropies else 1.0)
        out[node] = m, html_extract.DAMPING * content + (1 - html_extract.DAMPING) * min(1.0, style)
    return out


def test_importance_by_the_definition(spark):
    draw = random.Random(5)
    sources = []
    for k in range(24):
        parts = "".join(f"<p>{draw.choice(['same', 'other', f'own {k}'])}</p>" + draw.choice(["", "<ul><li>x<li>y</ul>", f"<div><div class=q>{k % 3}</div></div>"]) for _ in range(draw.randint(1, 4)))
        sources.append(f"<nav><a>Home</a></nav><div class=w>{parts}<div class=cta>Get it</div></div><footer>{k % 2}</footer>")
    sources += sources[:9]
    found = html_extract.importance(spark.createDataFrame([("h", s) for s in sources], "host string, html string").repartition(3)).collect()
    want = _importance(sources)
    assert {r.node for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert r.m == want[r.node][0] and abs(r.importance - want[r.node][1]) < 1e-9


def test_deep_nesting_takes_memory_in_proportion(spark):
    tracemalloc.start()
    page = html_extract.Page("<div>" * 100_000 + "deep" + "</div></p>" * 100_000)
    features = html_extract.features_of(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert page.text() == "deep" and len(features) > 100_000 and peak < 500 << 20
    pages = [(k, "<div>" * 300 + f"<p>Story {k}</p><p class=x>all</p>") for k in range(6)]
    found = html_extract.extract(spark.createDataFrame([(k, None, h) for k, h in pages], "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {f"Story {k}" for k in range(6)}


def test_importance_rates_menus_and_footers_too(spark):
    """The tree sees what the marks name: a repeated footer has no importance, comments of readers have much."""
    pages = [f"<nav><a>Home</a></nav><article><p>Story {k}</p></article><div class=comments><p>I say {k}</p></div><footer>Same</footer>" for k in range(8)]
    page = html_extract.Page(pages[0])
    rated = {r.node: r.importance for r in html_extract.importance(spark.createDataFrame([("h", s) for s in pages], "host string, html string")).collect()}
    menu, story, comment, footer = (rated[b.node] for b in page.blocks)
    assert menu < 0.01 and footer < 0.01 and story > 0.85 and comment > 0.85 and page.text() == "Story 0"


@needs_data
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] and sizes[5] >= sizes[4]
    clean = spark.read.parquet(str(tmp_path / "3"))
    assert clean.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0 and clean.where("n_chars <> char_length(text)").count() == 0
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first = spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id")
    assert first.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert corpus_pipeline.run(spark, str(DATA)).count() == sizes[5]


def test_pipeline_language_without_labels(spark):
    import corpus_pipeline

    rows = [(1, "Clean text.", None), (2, "12 !", None), (3, None, None), (4, "été", None), (None, "held out", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.text for r in corpus_pipeline.language(spark, docs, "").collect()) == ["Clean text.", "held out", "été"]


def test_pipeline_language_with_many_languages(spark, monkeypatch):
    import corpus_pipeline

    assert corpus_pipeline.least_language(4) == corpus_pipeline.LEAST_LANGUAGE
    rnd, grams, rows = random.Random(1), language_id.Grams(), []
    for lang in range(60):
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)]
        rows += [(f"l{lang:02}", grams.cells(" ".join(rnd.choices(words, k=60)))) for _ in range(6)]
        short = words[0]
    model = language_id.fit(rows, landmarks=3)
    monkeypatch.setattr(language_id, "train", lambda docs: model)
    docs = spark.createDataFrame([(1, short)], "doc_id long, text string")
    score = language_id.identify(docs, model).first()
    assert score.lang_pred == "l59" and score.score < corpus_pipeline.LEAST_LANGUAGE
    assert corpus_pipeline.language(spark, docs, "").count() == 1


def test_pipeline_with_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _0 int, score string, root int, _row int, chunk string, text2 string"
    rows = [(k, "The thing was and her anding.", "en", "s", 29, 1, "x", None, 2, None, "t") for k in (3, 3, 4)] + [(None, None, None, None, None, 1, "x", None, 2, None, "t"), (7, "", "de", "s", 0, 1, "x", None, 2, None, "t")]
    for name, table in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            assert k == 4 or docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert docs.count() == (1 if table else 0)
