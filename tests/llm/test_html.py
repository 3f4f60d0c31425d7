"""Extraction: names, evidence over a host, time on odd markup, and a brute-force vote over the pages table."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from concord.llm import html, queries

SF = "/root/testdata/sf0.001"


def test_names_are_judged_whole():
    kept = "".join(f"<div class='{c}'><p>text of {c} here</p></div>" for c in ("share-price", "search-results", "text-ads-free", "notice", "related", "popup", "alert"))
    assert all(f"text of {c} here" in html.Page(f"<article><p>start</p>{kept}</article>").taken([]) for c in ("share-price", "search-results", "text-ads-free", "notice", "related", "popup", "alert"))
    gone = "".join(f"<div class='{c}'><p>gone</p></div>" for c in ("ad", "ad-slot", "cookie-notice", "comments", "comment-list", "sidebar-left", "site-footer", "newsletter")) + "<div class='related'><a href=x>gone gone</a> x</div>"
    assert html.Page(f"<article><p>start</p>{gone}<p>end</p></article>").taken([]) == "start end"
    assert html.Page("<div class='notice'>gone</div><article><p>start</p></article>").taken([]) == "start"


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-thread", "commentlist", "commentList", "userComments", "adsbygoogle", "google-ads", "cookie-policy", "privacy-notice"])
@pytest.mark.parametrize("frame", ["<div id=content><p>start</p>{}<p>end</p></div>", "<div class='post has-sidebar'><p>start</p>{}<p>end</p></div>"])
def test_compound_names(name, frame):
    assert html.Page(frame.format(f"<div class='{name}'><p>gone gone</p></div>")).taken([]) == "start end"


def test_wrappers_named_after_what_they_lack():
    for c in ("has-sidebar", "no-comments-yet", "layout-with-menu", "commentary"):
        assert html.Page(f"<div class='{c}'><p>the text of it</p></div>").taken([]) == "the text of it"


def test_evidence_for_mixed_names(spark):
    """A block whose token holds such a name goes where the host repeats it, but never with half of the page's text."""
    page = "<div class='{w}'><p>own text {i} of this page in words enough</p><div class='ads-free-offer'>{n}</div></div>"
    rows = [(i, "http://h/x", page.format(w="has-sidebar", i=i, n="buy it now" if i % 2 else f"my offer {i}")) for i in range(12)]
    rows += [(100 + i, "http://k/x", "<div class='has-sidebar'><p>copied text of the page</p></div>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own text {i} of this page in words enough" + ("" if i % 2 else f" my offer {i}") for i in range(12))
    assert all(got[100 + i] == "copied text of the page" for i in range(6))


def test_containers_at_any_depth():
    """Nesting beyond the steps of a path keeps deep paths apart and parents known."""
    deep = lambda top, text: f"<div class='{top}'>" + "<div>" * 30 + f"<div class=x><p>{text}</p></div>" + "</div>" * 31
    page = html.Page(deep("a", "one " * 9) + deep("b", "two " * 9))
    ends = [n[0] for n in page.nodes if n[0].endswith("div.x")]
    assert len(ends) == len(set(ends)) == 2 and max(len(n[0]) for n in page.nodes) < 120
    assert page.taken(ends[1:]) == ("two " * 9).strip()
    assert html.Page(f"<div class=post>{'word ' * 40}<ul>{'<li><dl><dd>' * 15}<div class=story>{'more ' * 50}</div></ul></div>").taken([]) == ("word " * 40 + "more " * 50).strip()


def test_siblings_of_the_best_stay():
    long, short = "word " * 60, "more " * 30
    assert html.Page(f"<body><div class='a'><p>{long}</p></div><div class='b'><p>{short}</p></div></body>").taken([]) == (long + short).strip()


def test_repeated_blocks_of_a_host(spark):
    page = "<article><p>own text {i} of this page</p><div class='notice'>{n}</div></article>"
    rows = [(i, "http://h/x", page.format(i=i, n="we all move to a new address" if i % 2 else f"own notice {i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own text {i} of this page" + ("" if i % 2 else f" own notice {i}") for i in range(12))


@pytest.mark.parametrize("page", ['<a b="' * 20_000, "<span>" * 20_000 + "<p>x</p>" * 5000, "<div>" * 20_000 + "</x>" * 20_000, "<p>" * 20_000, "<ul><li>" * 20_000, "<a <" * 20_000 + ">", "<div class='notice'>x" * 3000])
def test_time_grows_with_the_page(page):
    began = time.perf_counter()
    html.Page(page).taken([])
    assert time.perf_counter() - began < 5


class Plain(HTMLParser):
    """Text of the article element without adverts, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside = self.ad = 0
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.ad += tag == "div" and (self.ad or dict(attrs).get("class") == "ad")
        if tag not in html.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.ad -= tag == "div" and self.ad > 0
        if tag not in html.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside and not self.ad:
            self.out.append(data)


def test_pages_by_another_parser(spark):
    got = {r["page_id"]: r["text"] for r in queries.op9_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert any("<article>" in r["html"] for r in pages)
    for r in pages:
        if "<article>" in r["html"]:
            plain = Plain()
            plain.feed(r["html"])
            assert got[r["page_id"]] == " ".join("".join(plain.out).split())


def test_votes_by_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    votes = {}
    for r in pages.collect():
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r["url"] or "") or [None, ""])[1].lower()
        best = html.Page(r["html"] or "").best()
        if best and best[4] > 0:
            votes.setdefault(host, Counter())[best[0]] += 1
    want = {h: [p for p, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]] for h, c in votes.items()}
    assert {r["__host"]: r["paths"] for r in html.consensus(pages).collect()} == want
