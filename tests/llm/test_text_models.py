"""Language ID, toxicity and HTML extraction."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import awkward, documents
from surgelane.llm import langid, pagediff, toxicity

SMALL = "/root/testdata/sf0.01"


# --- language ID --------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language_of_pages_follows_the_text(spark, corpus):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = langid.identify_pages(pages, corpus.select("doc_id", "text", "lang")).collect()
    assert len(got) == pages.count()
    assert sum(r.language == r.declared for r in got) >= 0.97 * len(got)
    assert all(r.accepted for r in got if r.text_language)


def test_declaration_and_host_decide_where_text_is_thin(spark, corpus):
    rows = [(i, f"http://haus.example.de/{i}", f'<html lang="de"><p>{t}</p>') for i, t in enumerate(
        [r.text for r in corpus.where("lang = 'de'").select("text").limit(40).collect()])]
    rows += [(1000, "http://haus.example.de/x", '<html lang="de-AT"><p>in</p>'), (1001, None, "<p>der die und nicht mit von den das ist</p>"),
             (1002, "http://haus.example.de/y", "<p>12 345 !</p>"), (1003, "not an address", None), (1003, "not an address", None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = {}
    result = langid.identify_pages(pages, corpus.select("doc_id", "text", "lang")).collect()
    assert len(result) == len(rows)
    for r in result:
        got[r.page_id] = r
    assert got[1000].language == "de" and got[1000].host == "haus.example.de" and got[1000].declared == "de"
    assert got[1001].language == "de" and got[1001].accepted
    assert got[1002].language == "de" and not got[1002].accepted and not got[1003].accepted


def test_documents_keep_clean_rows(spark, corpus):
    got = langid.identify_documents(corpus)
    assert got.count() == corpus.count()
    assert got.where("accepted and language = lang").count() >= 0.98 * corpus.count()
    odd = langid.identify_documents(documents(spark, awkward(), extra=True)).collect()
    assert len(odd) == len(awkward())
    assert not any(r.accepted for r in odd if not (r.text or "").strip())
    assert langid.identify_documents(documents(spark, [])).count() == 0


def test_trigram_blocks_do_not_change_counts(monkeypatch):
    text = "ab cd " * 60_000
    whole = np.bincount(np.concatenate(list(langid._trigrams(text))), minlength=langid.TRIGRAMS)
    assert len(list(langid._trigrams(text))) > 1
    padded = f" {text} "
    assert whole.sum() == sum(1 for i in range(len(padded) - 2) if padded[i + 1] != " " or padded[i] != " " != padded[i + 2])


RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме. "
POLISH = "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą. "


def test_texts_of_no_known_language_are_rejected(spark, corpus):
    rng = random.Random(6)
    odd = [RUSSIAN * 3, POLISH * 3, "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300)),
           " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(60))]
    known = corpus.limit(400).select("doc_id", "text", "lang", "source", "n_chars")
    docs = known.union(documents(spark, [(10**6 + i, t, None, "src0") for i, t in enumerate(odd)]))
    got = {r.doc_id: r.accepted for r in langid.identify_documents(docs).collect()}
    assert not any(got[10**6 + i] for i in range(len(odd)))
    assert sum(got.values()) == len(got) - len(odd)


def test_classes_are_bounded_whatever_the_codes(spark, corpus):
    """Tens of thousands of distinct codes: the common ones and one class for the rest."""
    texts = [r.text for r in corpus.where("lang = 'en'").select("text").limit(60).collect()]
    rows = [(i, texts[i % 60][:300], f"x{i}", "s") for i in range(20_000)] + [(30_000 + i, texts[i % 60][:300], "en", "s") for i in range(20_000)]
    rows += [(60_000, texts[0], "en", "s")] * 300  # a repeated id teaches once
    docs = documents(spark, rows)
    sample = langid.chosen_rows(docs.select("doc_id", "text", "lang"), 100).collect()
    assert {r.lang for r in sample} == {"en", langid.OTHER} and len(sample) == 100
    assert langid.fit(docs.select("doc_id", "text", "lang"), 100).languages == ["en", langid.OTHER]


def test_fusion_by_plain_python(spark):
    """Likelihoods, declarations and smoothed priors fused row by row without Spark."""
    rng = random.Random(7)
    names, spreads, floors = ["aa", "bb", "cc"], [2.0, 1.5, 1.8], [-6.0, -6.5, -6.2]
    rows = []
    for i in range(60):
        n = rng.choice([0, 3, 40, 200])
        ll = [langid.TEMPER * n * rng.uniform(-7.5, -5.5) if n else 0.0 for _ in names]
        host = rng.choice([None, "h1.x", "h2.x", "h3.y"])
        rows.append((i, host, host and host[-1], rng.choice([None, "aa", "bb", "zz"]), n, ll))
    evidence = spark.createDataFrame(rows, "id long, host string, suffix string, declared string, grams long, ll array<double>")
    got = {r.id: r for r in langid.fuse(evidence, langid.Model(names, np.zeros((1, 3)), floors, spreads)).collect()}

    def normal(logs):
        raised = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(raised) for x in raised]

    p = {r[0]: normal(r[5]) if r[4] else [0.0] * 3 for r in rows}
    overall = [sum(p[i][k] for i in p) for k in range(3)]
    n, smooth = sum(overall), langid.SMOOTH
    base = [(x + 1) / (n + 3) for x in overall]
    for i, host, suffix, declared, grams, ll in rows:
        rest = lambda same: [sum(p[r[0]][k] for r in rows if same(r) and r[0] != i) for k in range(3)]
        level = lambda sums, above: [(s + smooth * q) / (sum(sums) + smooth) for s, q in zip(sums, above)]
        prior = level(rest(lambda r: r[2] == suffix and r[1] == host), level(rest(lambda r: r[2] == suffix), base))
        said = rest(lambda r: r[3] == declared)
        others = [o - x for o, x in zip(overall, p[i])]
        share = (sum(said) + 1) / (n + 1)
        says = [(s + smooth * share) / (o + smooth) for s, o in zip(said, others)]
        q = normal([x + math.log(a * b) for x, a, b in zip(ll, prior, says)])
        best = max(range(3), key=lambda k: (q[k], -k))
        assert got[i].language == names[best] and got[i].posterior == pytest.approx(q[best], abs=2e-6)
        known = grams and max(x / (langid.TEMPER * grams) + s * langid.KNOWN_ERRORS / math.sqrt(grams) - f for x, s, f in zip(ll, spreads, floors)) >= 0
        assert got[i].accepted == bool(known and q[best] >= langid.MIN_POSTERIOR)
        assert got[i].text_language == (names[p[i].index(max(p[i]))] if grams else None)


def test_rare_languages_are_classes(spark, corpus):
    known = corpus.where("lang = 'en'").limit(300).select("doc_id", "text", "lang", "source", "n_chars")
    docs = known.union(documents(spark, [(10**6 + i, RUSSIAN * 2, "RU", "src0") for i in range(2)]))
    model = langid.fit(docs, sample=20)
    assert model.languages == ["en", "ru"]
    taught = langid.chosen_rows(docs, 20).groupBy("lang").count().collect()
    assert {r[0]: r[1] for r in taught} == {"en": 10, "ru": 2}


# --- toxicity -------------------------------------------------------------------

def slow_nearest(vectors, query, k):
    scores = [(sum(w * query.get(t, 0.0) for t, w in v.items()), i) for i, v in enumerate(vectors)]
    return sorted(((-s, i) for s, i in scores if s > 0))[:k]


def test_block_max_search_is_exact():
    rng = random.Random(1)

    def vector():
        v = {t: rng.random() for t in rng.sample(range(40), rng.randrange(1, 6))}
        n = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / n for t, w in v.items()}

    index = toxicity.Index([vector() for _ in range(700)], [(1.0, 0.0)] * 700, list(range(700)), 40)
    for _ in range(200):
        q = vector()
        entries, cosines = index.nearest(q, 15)
        want = slow_nearest(index.vectors, q, 15)
        assert np.allclose(cosines, [-s for s, _ in want])
        assert {e for e, c in zip(entries.tolist(), cosines) if c > cosines[-1] + 1e-9} <= {i for _, i in want}


def test_isotonic_pools_violators():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def labelled(spark, n=1500):
    rng = random.Random(3)
    bad, rows, labels = ["vile", "vileness", "crook"], [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}x" for _ in range(40)]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_documents(documents(spark, rows), table).collect()}
    assert set(got) == {i for i, _ in rows}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == set(held)
    truth = dict((i, t) for i, t, _ in labels)
    of = [(truth[i], got[i].predicted) for i in held if i in truth]
    assert sum(a == b for a, b in of) >= 0.97 * len(of)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    # Labels that are held out teach nothing.
    other = spark.createDataFrame([(i, 1 - t if i in held else t, q) for i, t, q in labels], "doc_id long, toxic int, quality int")
    again = {r.doc_id: r.score for r in toxicity.score_documents(documents(spark, rows), other).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_awkward_documents(spark):
    rows, labels = labelled(spark, 300)
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    docs = documents(spark, [(i + 1000, t) for i, t in rows] + awkward(), extra=True)
    got = toxicity.score_documents(docs, table.withColumn("doc_id", F.col("doc_id") + 1000)).collect()
    assert len(got) == 300 + len(awkward())
    empty = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.7
    none = toxicity.score_documents(documents(spark, awkward()), table.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_documents(documents(spark, []), table).count() == 0


def test_toxicity_of_repeated_ids_does_not_depend_on_their_order(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["nice", "plain", "table", "river", "vile", "scum", "filth", "stone"])
    rows = [(i % 150, " ".join(word() for _ in range(30))) for i in range(450)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    score = lambda docs: sorted((r.doc_id, r.score, tuple(r.nearest_ids)) for r in toxicity.score_documents(docs, labels).collect())
    first = score(documents(spark, rows).repartition(3))
    rng.shuffle(rows)
    assert score(documents(spark, rows).repartition(5)) == first


def test_toxic_words_of_no_clean_example_count(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(300)}x" for _ in range(20)]
        toxic = i % 2
        if toxic:
            words[rng.randrange(20)] = f"{rng.choice('qzjvk')}{rng.choice('qzjvk')}grr"  # each in about 24 documents
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, 1))
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(documents(spark, rows), table).collect()
    held = [(r.predicted, r.doc_id % 2) for r in got if r.held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


# --- HTML extraction --------------------------------------------------------------

def text_of(page):
    return [t for _, t, _ in pagediff.candidates(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a &amp; b&nbsp;c &#233;&lt;</p>", ["a & b c é<"]),
    ("<p>x <b>bold</b>ly <i>it</i></p>", ["x boldly it"]), ("<p>1<br>2</p>", ["1 2"]), ("<ul><li>a<li>b</ul>", ["a", "b"]),
    ("<script>var t='<p>no</p>';</script><p>yes", ["yes"]), ("<style>p{}</style><!-- <p>no --><p>yes", ["yes"]),
    ("<nav><a>Home</a></nav><header><h1>Site</h1></header><p>yes</p><footer>&copy;</footer>", ["yes"]),
    ('<div class="cookie-notice">ok</div><div id="comments"><p>c</p></div><p>yes</p><form>q</form>', ["yes"]),
    ('<p>a <span class="ad">buy</span>b</p>', ["a b"]), ('<p style="display:none">no</p><p>yes</p>', ["yes"]),
    ("<article><header><h1>T</h1></header><p>a</p></article><p>outside</p>", ["T", "a"]),
    ("<main><h1>T</h1><aside>no</aside><p>a</main>", ["T", "a"]), ("<p>a < b</p>", ["a < b"]), ("<p title='a>b'>x</p>", ["x"]),
    ("<script>never closed <p>no", []), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
])
def test_lines_of_a_page(page, want):
    assert text_of(page) == want


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_is_a_longest_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 15))] for _ in range(2))
        at = pagediff.common(a, b)
        assert at == sorted(set(at)) and len(at) == slow_lcs(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in at))


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit("clash")})
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in pagediff.main_texts(df).collect()}


def test_shared_lines_of_neighbours_go(spark):
    page = "<body><div>Welcome to the site</div><p>{}</p><div>Contact us today</div></body>"
    rows = [(i, f"http://h.example/a/{i:03d}", page.format(f"body {i} with its own words, some of them")) for i in range(60)]
    rows += [(100, "http://other.example/1", page.format("alone"))]
    rows += [(200, "http://third.example/1", page.format("copy of one page")), (201, "http://third.example/1?x", page.format("copy of one page"))]
    got = extract(spark, rows)
    for i in range(60):
        assert got[(i, f"http://h.example/a/{i:03d}")][0] == f"body {i} with its own words, some of them"
    assert got[(100, "http://other.example/1")][0] == "Welcome to the site\n\nalone\n\nContact us today"
    assert "copy of one page" in got[(200, "http://third.example/1")][0] and "copy of one page" in got[(201, "http://third.example/1?x")][0]


def test_passages_of_articles_stay(spark):
    page = "<body><div>menu</div><article><h1>{}</h1><p>the same quoted passage</p><div>share this now</div></article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"a long enough title of page {i}")) for i in range(5)]
    assert {t for t, _ in extract(spark, rows).values()} == {f"a long enough title of page {i}\n\nthe same quoted passage" for i in range(5)}


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://h.example/", "<p>x"), (3, "http://h.example/p", "<article>" + "<p>word é</p>" * 30_000),
            (4, "//no.scheme/p", "<p>x</p>"), (4, "//no.scheme/p", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pagediff.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[1].n_chars == 0 and by[4].text == "x"
    assert by[3].n_chars == len(by[3].text) == 30_000 * 6 + 2 * 29_999
    assert pagediff.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<article class="post comments-open"><p>a</p></article>', ["a"]), ('<div class="layout has-sidebar"><p>a</p></div>', ["a"]),
    ('<main class="content share-enabled"><p>a</p></main>', ["a"]), ('<div class="comments"><article><p>a</p></article></div>', ["a"]),
    ('<article class="share"><p>a</p></article>', ["a"]),
    ('<h1 class="post-title">T</h1><div class="body"><p>the text</p></div>', ["T", "the text"]),
    ('<div class="post-meta">m</div><div><p>the text</p></div>', ["m", "the text"]),
    ('<div class="entry-content"><p>the text</p></div><div>site</div>', ["the text"]),
    ('<p title="the hidden truth">a</p><p data-x="display:none" data-class="ad">b</p>', ["a", "b"]),
    ("<p hidden>a</p><p hidden='until-found'>b</p><p aria-hidden=true>c</p><p style='color:red;display: none'>d</p><p>e</p>", ["e"]),
    ('<article><p>the text</p></article><div class="comments"><article class="comment"><p>a longer answer to it</p></article></div>', ["the text"]),
    ('<div class="site-footer">f</div><div id="comments-list"><p>c</p></div><div class="ad-box">x</div><p>yes</p>', ["yes"]),
])
def test_words_of_attributes_lose_no_article(page, want):
    assert text_of(page) == want


def own(rng, n=30):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_site_text_goes_from_inside_articles(spark):
    rng = random.Random(4)
    page = "<body><article><h1>{}</h1><p>{}</p><p>Subscribe to our letter today</p></article></body>"
    rows = [(i, f"http://h.example/{i:02d}", page.format(own(rng, 4), own(rng))) for i in range(20)]
    got = extract(spark, rows)
    assert all("Subscribe" not in text and text.count("w") == 34 for text, _ in got.values())
    # A passage that a few articles quote stays, however many others the host has.
    rows = [(i, f"http://h.example/{i:02d}", page.format(own(rng, 4), own(rng)).replace("Subscribe", "Subscribe" if i in (8, 9, 10) else f"Own{i}")) for i in range(20)]
    got = extract(spark, rows)
    assert sum("Subscribe to our letter today" in text for text, _ in got.values()) == 3


def test_long_runs_of_near_copies_lose_only_the_site(spark):
    rng = random.Random(5)
    page = "<body><div>Welcome to the site</div>{}<div>Contact us today</div></body>"
    paragraphs = [own(rng) for _ in range(6)]
    rows = [(i, f"http://h.example/a/{i:03d}", page.format("".join(f"<p>{x}</p>" for x in [*paragraphs, f"edit {i} {own(rng, 3)}"]))) for i in range(40)]
    rows.append((100, "http://h.example/b", page.format(f"<p>{own(rng)}</p>")))
    got = extract(spark, rows)
    assert all("Welcome" not in text and "Contact" not in text for text, _ in got.values())
    assert all(all(x in got[(i, f"http://h.example/a/{i:03d}")][0] for x in paragraphs) for i in range(40))


def test_short_pages_in_much_site_text(spark):
    rng = random.Random(6)
    page = "<body><div>Welcome to the site, which has a long greeting for all who come to it, and then some more</div><p>{}</p></body>"
    rows = [(i, f"http://h.example/{i:02d}", page.format(own(rng, 5))) for i in range(9)]
    assert all("Welcome" not in text for text, _ in extract(spark, rows).values())
