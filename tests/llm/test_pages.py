"""Main text of pages: zones, suffix arrays, boilerplate of hosts."""

import html as entities
import random
import re

import numpy as np
import pytest

from assayframe.llm import page_blocks as B, page_boilerplate as P

SF = "/root/testdata/sf0.01"


def kept(page):
    return P.main_text(page, None)


def test_suffix_arrays_and_common_prefixes_equal_sorting():
    r = random.Random(1)
    for _ in range(200):
        tokens = np.array([r.randrange(4) for _ in range(r.randrange(0, 40))] + [99])
        order = P.suffix_array(tokens)
        suffixes = [tokens[i:].tolist() for i in order]
        assert suffixes == sorted(suffixes)
        shared = P.common_prefixes(tokens, order)
        for i in range(1, len(order)):
            a, b = suffixes[i - 1], suffixes[i]
            assert shared[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style></head><body class="no-js with-sidebar">
      <header><a href=/>Site</a><form action=s><input value="q"><label>Find</label></form></header>
      <nav><ul><li>Home<li>News</ul></nav><div id="cookie-notice">We use cookies</div>
      <main><article class="post"><header><h1>Caf&eacute; &amp; <i>bar</i></h1></header><p>One <b>two</b>&nbsp;three
      <br>four<p>A &lt;tag&gt; &#8212; un<em>broken</em><script>var t = "</p>";</script>
      <aside>Side</aside><div class="share-buttons">Share</div><div class='ad'>Buy</div>
      <ul><li>first</li><li>second</ul><table><tr><td>x<td>y</table><blockquote>said</blockquote>
      <section class="comments"><h2>Comments</h2><p>Nice</section></article>
      <div class="related-posts"><article>More</article></div></main>
      <div class="sidebar"><p>Links</div><footer>&copy; 2024<p>Imprint</footer><p>after"""
    assert kept(page) == "\n\n".join(["Café & bar", "One two three four", "A <tag> — unbroken", "first", "second", "x", "y", "said"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<p>open <!-- never closed", "open"), ("<p>cut <a hre", "cut"),
    ("<p>5 < 6 &amp", "5 < 6 &"), ("<p>x &am", "x &am"), ("<nav>menu<article><p>body</article>", "body"), ("<script>only", ""), ("<div hidden>no</div><p>yes", "yes"),
    ("</div></p></nav><p>stray", "stray"), ("<main><p>in main</main><p>beside", "in main"), ("<p>   \n", ""), ("<div role='navigation'>a</div>b", "b"),
    ("<ul><li><a href=1>only links</a></ul><p>words", "words"),
])
def test_odd_pages(page, text):
    assert kept(page) == text


def test_very_long_and_deep_pages():
    assert kept("<div>" * 50_000 + "deep" + "</section>" * 50_000) == "deep"
    long = "word " * 400_000
    assert kept(f"<article><p>{long}</article>") == long.strip()
    assert len(kept("<p>a" * 100_000).split("\n\n")) == 100_000
    assert kept('<a href="x' * 20_000) is not None  # in linear time


def test_a_teaser_article_does_not_mark_the_page():
    text = "The main text of this page stands beside its teaser card"
    for page in (f"<main><p>{text}</p><section><article>Related</article></section></main>", f"<div><p>{text}</p></div><article>Related</article>"):
        assert B.blocks(page) == [(text, B.NEUTRAL), ("Related", B.NEUTRAL)]
    assert B.blocks(f"<p>beside<article><p>{text}</article>") == [("beside", B.BESIDE), (text, B.ARTICLE)]


def pages_of(n, host, notice="Subscribe to our weekly letter and never miss a story again"):
    menu = "".join(f"<li>{w}" for w in ("Home", "World news", "Politics", "Economy and markets", "Sports"))
    return [(f"https://{host}/{i}", f"<ul>{menu}</ul><p>Story number {i} of {host} tells what has happened there</p><p>Short {i}</p><p>{notice}</p>") for i in range(n)]


@pytest.mark.parametrize("size", [512, 3])
def test_boilerplate_of_a_host_without_marked_articles(spark, monkeypatch, size):
    monkeypatch.setattr(P, "PAGES", size)
    rows = [(i, u, h) for i, (u, h) in enumerate(pages_of(11, "a.example") + pages_of(1, "b.example") + pages_of(5, "c.example"))]
    copy = "<p>The very same story stands on two pages of this host, word for word</p><p>and it goes on for a while</p>"
    rows += [(50, "https://d.example/1", copy), (51, "https://d.example/2", copy), (52, "https://d.example/3", "<p>Something else entirely, which no other page has</p>")]
    rows += [(60, None, None), (61, "", "<p>no host</p>"), (62, "https://a.example/x", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    found = {}
    for r in P.extract(df).collect():
        found.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert sorted(i for i, t in found.items() for _ in t) == sorted(r[0] for r in rows)
    for i, url, _ in rows[:11] + rows[12:17]:
        assert found[i][0] == f"Story number {url.rsplit('/')[-1]} of {url.split('/')[2]} tells what has happened there\n\nShort {url.rsplit('/')[-1]}"
    assert "Subscribe" in found[11][0] and found[0][0] == found[0][1]  # a single page shares nothing; repeated rows are one page
    assert found[50] == found[51] == [kept(copy)] and found[52] == ["Something else entirely, which no other page has"]
    assert found[60] == found[62] == [""] and found[61] == ["no host"]


def test_marked_articles_keep_what_they_repeat(spark):
    licence, footer = "Licensed under the Apache License, Version 2.0, see the notice.", "Example Media Group, 12 Long Street, Springfield, all rights reserved"
    rows = [(i, "http://e.example/", f"<article><p>Text {i} of this page</p><p>{licence}</p></article><footer>{footer}</footer>") for i in range(4)]
    rows += [(9, "http://e.example/9", f"<p>No article is marked here, but this text is its own</p><p>{licence}</p><div>{footer}</div>")]
    found = {r["page_id"]: r["text"] for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == f"Text 2 of this page\n\n{licence}" and found[9] == "No article is marked here, but this text is its own"


def test_shuffled_removal_equals_broadcast(spark, monkeypatch):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages_of(6, "a.example"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = sorted(map(tuple, P.extract(df).collect()))
    monkeypatch.setattr("assayframe.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, P.extract(df).collect())) == before
    assert P.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_articles_of_the_given_pages(spark, folder):
    from assayframe.llm.queries import QUERIES

    found = {r["page_id"]: r["text"] for r in QUERIES["op2_page_boilerplate"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        plain = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[row["page_id"]] == "\n\n".join(b for b in plain if b)


def test_names():
    assert all(map(B.names_furniture, ["ad", "ad-slot", "post-comments", "cookieNotice", "main_nav", "relatedPosts", "site-footer", "widget-2"]))
    topics = ["social-science", "share-price", "search-results", "story-banner", "related-work", "alert-level", "notice-of-motion", "shared-story", "with-sidebar", "has-comments"]
    assert not any(map(B.names_furniture, [*topics, "article-body", "header", "lead", "adventure"]))
    assert B.names_furniture("comment-list") == "reader"


@pytest.mark.parametrize("name", ["social-science", "share-price", "search-results", "story-banner", "related-work", "notice-of-motion", "notice", "share", "comments", "ad"])
def test_no_page_loses_its_only_text_to_a_name(name):
    assert kept(f"<main><div class='{name}'><p>The only text of this page</p></div></main>") == "The only text of this page"
    assert kept(f"<form><div id='{name}'><p>The only text of this page</p><input value=x></div></form>") == "The only text of this page"


def test_suspect_elements_beside_longer_text():
    text = "This text is long enough to be the main text of the page, and has no suspect name around it"
    for suspect in ("<div class=notice>We use cookies</div>", "<form>Search <button>Go</button></form>", f"<div class=comments>{text * 9}</div>", "<div class='feedback'>I like it</div>"):
        assert kept(f"<div><p>{text}</p>{suspect}</div>") == text
        assert kept(f"<article><p>{text}</p>{suspect}</article>") == text
    assert kept(f"<p>{text}</p><div class=related>{text + text}</div>") == f"{text}\n\n{text + text}"  # longer than all other text
    assert kept(f"<div class=ad>{text}</div><article><p>A short one.</p></article>") == "A short one."
    assert kept(f"<form class=search><article><p>{text}</p></article></form>") == text
    assert kept("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>") == "Let x=1 hold"


def test_a_short_article_under_long_boilerplate_comes_back_alone(spark):
    notice = [f"<p>Paragraph {i} of the terms that every page of this host repeats</p>" for i in range(40)]
    own = "Own text of page {} that stands under all of the repeated terms"
    rows = [(i, f"http://t.example/{i}", "".join(notice) + f"<p>{own.format(i)}</p>") for i in range(5)]
    rows += [(9, "http://t.example/9", rows[0][2])]  # a copy with another address keeps the own text as well
    found = {r["page_id"]: r["text"] for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**{i: own.format(i) for i in range(5)}, 9: own.format(0)}


def naive_cover(streams, least):
    """Of every stream the tokens inside a substring of at least ``least`` characters that more streams hold than it has copies."""
    pages = {k: [(t, len(t)) for t in ts] for k, ts in streams.items()}
    holders = {}
    for k, ts in streams.items():
        for a in range(len(ts)):
            for b in range(a + 1, len(ts) + 1):
                holders.setdefault(tuple(ts[a:b]), set()).add(k)
    found = {}
    for k, ts in streams.items():
        copies = sum(other == ts for other in streams.values())
        hit = [False] * len(ts)
        for a in range(len(ts)):
            for b in range(a + 1, len(ts) + 1):
                if sum(n for _, n in pages[k][a:b]) >= least and len(holders[tuple(ts[a:b])]) > copies:
                    hit[a:b] = [True] * (b - a)
        found[k] = hit
    return found


@pytest.mark.parametrize("size", [512, 4])
def test_covered_blocks_equal_a_search_of_all_substrings(spark, monkeypatch, size):
    monkeypatch.setattr(P, "PAGES", size)
    r = random.Random(7)
    rows, want = [], {}
    for host in range(6):
        streams = {}
        for i in range(r.randrange(2, 12)):
            words = ["alpha " * 2, "be", "gamma delta epsilon " * 2, "zeta " * 4, "eta theta"]
            streams[host * 100 + i] = [f"{r.choice(words).strip()} {r.randrange(3)}" for _ in range(r.randrange(0, 9))]
            if r.random() < 0.3 and i:
                streams[host * 100 + i] = list(streams[host * 100 + r.randrange(i)])
        for k, hit in naive_cover(streams, P.LEAST_CHARS).items():
            want[k] = "\n\n".join(t for t, h in zip(streams[k], hit) if not h)
            rows.append((k, f"http://h{host}.example/{k}", "".join(f"<p>{t}" for t in streams[k])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in P.extract(df).collect()} == want
    assert any(len(t) < len(h) / 2 for (_, _, h), t in zip(rows, (want[k] for k, _, _ in rows)))
