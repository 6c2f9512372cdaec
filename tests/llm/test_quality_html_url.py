import math
import re

import numpy as np
import pytest

from claimscan.llm import html_text as ht
from claimscan.llm import quality_crf as qc
from claimscan.llm import url_filter as uf

from . import brute

DATA = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = qc.op4_quality_crf(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (brute.remainder(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in held]
    assert np.mean(right) >= 0.95
    bad = [r.predicted == 0 for r in held if labels[r.doc_id] == 0]
    assert np.mean(bad) >= 0.85


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    chain = qc.Chain(rng.normal(size=len(qc.Chain().weights)))
    first = np.array([0, 4, 5, 8])
    levels = rng.integers(0, qc.LEVELS, (8, len(qc.FEATURES))).astype(np.uint8)
    places = qc.Chain.places(levels, first)
    good, joint, log_z = chain.marginals(places, first)
    score = chain.weights[places].sum(axis=1) + chain.weights[-5]
    trans = chain.weights[-4:].reshape(2, 2)
    want, pairs = [], np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(first, first[1:])):
        total, own, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            p = np.exp(sum(score[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += p
            own += p * np.array(y)
            for i in range(b - a - 1):
                two[y[i], y[i + 1]] += p
        want.extend(own / total)
        pairs += two / total
        assert log_z[d] == pytest.approx(np.log(total))
    assert good == pytest.approx(want)
    assert joint == pytest.approx(pairs)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_messages_from_block_to_block(monkeypatch, block):
    """Blocks that end inside a text, at its end, and with texts of one line."""
    monkeypatch.setattr(qc, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(10):
        first = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 6)))])
        levels = rng.integers(0, qc.LEVELS, (first[-1], len(qc.FEATURES))).astype(np.uint8)
        chain = qc.Chain(rng.normal(size=len(qc.Chain().weights)))
        assert chain.good_lines(levels, first) == pytest.approx(chain.marginals(qc.Chain.places(levels, first), first)[0])


def test_quality_edges(spark):
    docs = brute.edge_docs(spark)
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1), (6, None), (5, 1)], "doc_id long, quality int")
    chain = qc.fit(docs, labels)
    rows = qc.score(docs, chain, with_lines=True).collect()
    assert len(rows) == len(brute.EDGE_TEXTS) + 3 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5].score > 0.5 > by[9].score and len(by[2].lines) == 2
    assert qc.score(brute.empty_docs(spark), chain).collect() == []
    assert qc.fit(docs, labels.limit(0)) is None
    assert {r.score for r in qc.score(docs, None).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header><h2>Site</h2></header><div class="ad">Buy  now</div><div class="cookie-notice">We use cookies</div>
<article><h1>The  title</h1><p>First &amp; <b>bold</b>
text with some words in it<br>and more.<p>Second paragraph &eacute;t&#233; is here.<aside>Related</aside><p>End.</p>
<form><input name=x><button>Send</button></form><div id="comments"><p>nice post</p></div></article>
<aside><p>Sidebar text</p></aside><footer>&copy; example &middot; all rights</footer></body></html>"""


def test_main_text():
    assert ht.main_text(PAGE) == "The title\nFirst & bold text with some words in it and more.\nSecond paragraph été is here.\nEnd."


def test_page_without_article():
    para = "<p>This is a long paragraph of running text that says something about a subject, number %d.</p>"
    html = "<body><div class=nav><a href=1>a</a><a href=2>b</a></div><div class=x>" + "".join(para % i for i in range(6)) + "</div><div class=footer>foot</div></body>"
    got = ht.main_text(html).split("\n")
    assert len(got) == 6 and all("running text" in x for x in got)


def test_class_names_beside_the_content():
    para = "<p>A paragraph of running text that goes on for a while, number %d.</p>"
    body = "".join(para % i for i in range(3))
    for html in (f'<body><div class="layout with-sidebar">{body}</div></body>', f'<body><article class="post sidebar-left">{body}</article></body>', f'<body><div class="widget">{body}</div></body>'):
        assert ht.main_text(html).count("\n") == 2
    assert ht.main_text(f'<main>{body}<article class="comment"><p>me too</p></article></main>').count("\n") == 2


PARA = "<p>A paragraph of running text that goes on for a while and says a thing or two, number %d.</p>"
BODY = "".join(PARA % i for i in range(5))


def test_names_count_as_a_whole():
    assert [ht.furniture(x) for x in ("share-price", "side-effects", "search-theory", "header-file", "commentary", "adsorption")] == [0] * 6
    assert [ht.furniture(x) for x in ("ad-slot", "cookie-notice", "comment-list", "site-header", "x ad_300x250", "post-comments")] == [2] * 6
    assert [ht.furniture(x) for x in ("share", "related-posts", "widget", "social_links")] == [1] * 4
    assert [ht.furniture(x) for x in ("entry-header", "layout with-sidebar", "main-content", "")] == [0] * 4


def test_hints_weigh_and_do_not_delete():
    """A hinted block is text or not by its ratio; a word inside another name is no hint."""
    text = "<p>The price of a share rose by two parts in a hundred this week, as papers of the firm were sold well.</p>"
    links = "<ul>" + "".join(f"<li><a href='/{i}'>More {i}</a></li>" for i in range(8)) + "</ul>"
    for name in ("share-price", "widget"):
        assert "rose by two" in ht.main_text(f"<article>{BODY}<div class='{name}'>{text}</div>{BODY}</article>")
    got = ht.main_text(f"<article>{BODY}<div class='related'>{links}</div>{BODY}</article>")
    assert "More 3" not in got and got.count("\n") == 9


def test_ratio_chooses_lines_and_regions():
    """Link lists without a name beside the text, several articles, and pages without any."""
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(9)) + "</ul>"
    teaser = "<article><h2>Other</h2><p><a href=/o>Read on</a></p></article>"
    for html in (f"<article>{BODY}</article>{links}", f"<article>{BODY}</article>{teaser * 3}", f"<div>{links}</div><div>{BODY}</div><div>{links}</div>", f"<body>{links}{BODY}{links}</body>", f"<main>{BODY}</main><div>{links}</div>"):
        assert ht.main_text(html).split("\n") == [x for x in ht.main_text(BODY).split("\n")], html
        assert ht.main_text(html, use_ratio=False) != ht.main_text(html)
    both = ht.main_text(f"<article>{BODY}</article><article>{BODY}</article>")
    assert both.count("\n") == 9
    one = ht.main_text(f"<article>{BODY}<p>See <a href=/x>this page</a> for more.</p><p><a href=/y>The whole report of the year in full length</a></p>{BODY}</article>")
    assert one.count("\n") == 11


@pytest.mark.parametrize("n", [6, 12])
def test_references_inside_an_article_stay(n):
    links = "<h2>References</h2><ul>" + "".join(f"<li><a href='/{i}'>Report {i} on a subject</a></li>" for i in range(n)) + "</ul>"
    assert ht.main_text(f"<article>{BODY}{links}</article>").split("\n")[5:] == ["References", *(f"Report {i} on a subject" for i in range(n))]


NAMED_TEXT = ["blockquote class='comment'", "blockquote class='reply'", "p class='alert'", "div id='notice'", "div class='promo-text'", "section class='header'", "section id='sponsors'"]


@pytest.mark.parametrize("tag", NAMED_TEXT)
def test_named_blocks_inside_an_article_stay_where_they_have_a_sentence(tag):
    block = f"<{tag}>The firm said on the day after that nothing of it was true.</{tag.split()[0]}>"
    assert "nothing of it was true" in ht.main_text(f"<article>{BODY}{block}{BODY}</article>")
    assert "nothing of it was true" not in ht.main_text(f"<article>{BODY}{BODY}</article>{block}")


@pytest.mark.parametrize("block", ["<div class='ad'>Buy all of these fine new things from us today.</div>", "<div class='comments'><p>I have read this and I do not agree at all.</p></div>", "<div class='comment'>I have read this and I do not agree at all.</div>", "<div class='notice'>Read on</div>", "<aside>More of the same kind of thing can be read here.</aside>"])
def test_adverts_and_comments_inside_an_article_go(block):
    assert ht.main_text(f"<article>{BODY}{block}{BODY}</article>").count("\n") == 9


def test_long_page(spark):
    """A page above four megabytes, and paragraphs deep in inline elements."""
    html = "<article>" + "".join(f"<p>{'<b><i>' * 9}Line {i} of a long page with words in it.</p>" for i in range(60_000)) + "</article><footer>no</footer>"
    assert len(html) > 4 << 20
    got = ht.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert got.text == "\n".join(f"Line {i} of a long page with words in it." for i in range(60_000))


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "<div>x</div>" * n, lambda n: "<div>x" * n + "</i>" * n, lambda n: "<p><i>" * n + "</p>" * n + "x", lambda n: "<div>" * n + "x" + "</div>" * n])
def test_time_of_open_and_stray_tags_is_linear(make):
    import time

    took = []
    for n in (20_000, 80_000):
        t = time.process_time()
        ht.main_text(make(n))
        took.append(time.process_time() - t)
    assert took[1] < 20 and took[1] < 8 * max(took[0], 0.2)


def test_pages(spark):
    rows = ht.op6_html_text(spark, DATA).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import html as h
    import re

    for r in rows:  # these pages have one article, whose blocks start at p or h1
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_html_edges(spark):
    rows = [(0, "u", None, "x"), (1, None, "", "x"), (2, "u", "plain words only", "x"), (3, "u", "<p>a</b><p>b &am", "x"), (3, "u", "<p>a</b><p>b &am", "x"), (None, None, "<div>" * 3000 + "deep", "x"), (5, "u", "<!-- open", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in ht.extract(df).collect()]
    assert got[:5] == [(0, ""), (1, ""), (2, "plain words only"), (3, "a\nb &am"), (3, "a\nb &am")]
    assert got[5] == (None, "deep") and got[6] == (5, "")
    assert ht.extract(df.limit(0)).collect() == []


ENTRIES = [
    ("l", "blocked", "host", "a.com", "add", 10),
    ("l", "blocked", "host", "a.com", "add", 12),
    ("l", "blocked", "host", "a.com", "remove", 20),
    ("l", "blocked", "host", "a.com", "add", 30),
    ("l", "blocked", "host", "a.com", "remove", 30),
    ("m", "allowed", "prefix", "a.com/ok", "add", 15),
    ("l", "blocked", "domain", "com", "add", 40),
    ("n", "blocked", "url", "b.org/x?q=1", "add", 0),
    ("n", "blocked", "url", None, "add", 0),
    ("l", "blocked", "host", "c.net", "remove", 5),
]
CAPTURES = [
    (1, "http://a.com/z", 9, "allowed"),
    (2, "http://A.com:80/z", 10, "blocked"),
    (3, "http://u@a.com/z", 19, "blocked"),
    (4, "http://a.com/z", 20, "allowed"),
    (5, "http://a.com/ok/z", 16, "allowed"),
    (6, "http://a.com/okay", 16, "blocked"),
    (7, "http://a.com/z", 30, "allowed"),
    (8, "http://w.z.com/", 41, "blocked"),
    (9, "https://b.org/x?q=1#f", 3, "blocked"),
    (10, "https://b.org/x?q=2", 3, "allowed"),
    (11, None, 3, "allowed"),
    (12, "no url", 3, "allowed"),
    (13, "http://a.com/z", None, "allowed"),
    (14, "http://c.net", 9, "allowed"),
    (2, "http://A.com:80/z", 10, "blocked"),
]


@pytest.mark.parametrize("limit", [uf.BROADCAST_ENTRIES, -1])
def test_url_filter_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(uf, "BROADCAST_ENTRIES", limit)
    entries = spark.createDataFrame(ENTRIES, "list string, verdict string, kind string, value string, change string, at long")
    captures = spark.createDataFrame(CAPTURES, "id long, url string, fetched_at long, want string").withColumnRenamed("want", "verdict")
    captures = captures.withColumn("want", captures.verdict)
    rows = uf.evaluate(captures, entries).collect()
    assert len(rows) == len(CAPTURES)
    assert {(r.id, r.verdict) for r in rows} == {(r.id, r.want) for r in rows}
    assert uf.evaluate(captures.limit(0), entries).collect() == []
    assert {r.verdict for r in uf.evaluate(captures, entries.limit(0)).collect()} == {"allowed"}


def test_long_text_displaces_no_other(spark):
    """Every labelled document teaches, whatever its place and length; labels without a document take no place."""
    assert qc.equal_share({2: 3, 10: 1}, 100) == 10 and qc.equal_share({2: 3, 100: 2}, 26) == 10 and qc.equal_share({}, 5) == 1
    good, bad = "This is a good line of text.\nAnd here is one more of them.", "### $$$ ||| %%%\n*** &&& <<< >>>"
    docs = [(k, (good if k % 2 else bad)) for k in range(20)]
    docs = [(k, "\n".join([t] * 200) if k < 2 else t) for k, t in docs]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    chain = qc.fit(frame, labels, max_docs=20, max_lines=60)
    got = {r.doc_id: r.score for r in qc.score(frame, chain).collect()}
    assert all((got[k] > 0.7) == bool(k % 2) for k in got)
    assert chain is not None and qc.fit(frame.filter("doc_id < 1"), labels, max_lines=60) is not None


def plain_levels(text):
    """The levels of each line's features and the lines' sizes, one line at a time."""
    lines = (text or "").encode().split(b"\n")
    out = []
    for k, line in enumerate(lines):
        words = re.findall(rb"[^\x20\x09-\x0D]+", line)
        n = max(1, len(words))
        shares = [sum(b in members for b in line) / max(1, len(line)) for members in qc.CLASSES.values()]
        shares += [sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, len(line) / n / 20, math.log1p(len(line)) / 9, float(line in lines[:k])]
        shares.append(0.2 * line[:1].isupper() * line[:1].isascii() + 0.6 * (line[-1:] in (b".", b"!", b"?")) if line else 1.0)
        out.append([sum(c < x for c in qc.CUTS) for x in shares])
    return out, [len(x) for x in lines]


def plain_score(text, weights):
    """Length-weighted marginals by the forward and backward recursions over lines."""
    levels, sizes = plain_levels(text)
    width, depth = len(qc.FEATURES), qc.LEVELS + 1
    w = weights[:-5].reshape(3, width, depth)
    trans = weights[-4:].reshape(2, 2)
    none = [qc.NONE] * width
    good = [sum(w[k, j, x[j]] for k, x in enumerate((levels[i - 1] if i else none, levels[i], levels[i + 1] if i + 1 < len(levels) else none)) for j in range(width)) + weights[-5] for i in range(len(levels))]
    node = [(0.0, g) for g in good]
    forward = [node[0]]
    for x in node[1:]:
        forward.append(tuple(x[b] + np.logaddexp(forward[-1][0] + trans[0, b], forward[-1][1] + trans[1, b]) for b in (0, 1)))
    backward = [(0.0, 0.0)]
    for x in node[:0:-1]:
        backward.insert(0, tuple(np.logaddexp(trans[a, 0] + x[0] + backward[0][0], trans[a, 1] + x[1] + backward[0][1]) for a in (0, 1)))
    p = [1 / (1 + math.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(forward, backward)]
    return sum(x * (n + 1) for x, n in zip(p, sizes)) / sum(n + 1 for n in sizes)


def test_quality_scores_equal_plain_recursion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    chain = qc.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1 - i: t for i, t in enumerate(brute.EDGE_TEXTS)} | {-100: "same\nsame\n\n\nSame.\n\u00c9!"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    mild = qc.Chain(np.random.default_rng(2).normal(scale=0.2, size=len(chain.weights)))
    for model in (chain, mild):
        got = {r.doc_id: r.score for r in qc.score(frame, model).collect()}
        for d, t in texts.items():
            assert got[d] == pytest.approx(plain_score(t, model.weights), abs=1e-6), d
    assert len({round(x, 3) for x in got.values()}) > 20


def test_url_of_very_many_parts(spark):
    """As many prefixes are made of a URL as the deepest listed prefix has parts."""
    long = "http://a.b.example.com" + "/x" * 10_000
    captures = spark.createDataFrame([(1, long, 5), (2, "http://example.com/x/x/y", 5), (3, "http://example.com/x", 5)], "id int, url string, fetched_at long")
    entries = [("l", "blocked", "prefix", "a.b.example.com/x/x", "add", 1), ("l", "allowed", "domain", "example.com", "add", 1), ("l", "blocked", "prefix", "example.com/x/x", "add", 1)]
    rows = {r.id: r for r in uf.evaluate(captures, spark.createDataFrame(entries, "list string, verdict string, kind string, value string, change string, at long")).collect()}
    assert [(rows[i].verdict, rows[i].rule_value, rows[i].n_active) for i in (1, 2, 3)] == [("blocked", "a.b.example.com/x/x", 2), ("blocked", "example.com/x/x", 2), ("allowed", "example.com", 1)]
