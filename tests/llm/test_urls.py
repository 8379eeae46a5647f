from __future__ import annotations

import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pytest
from palaver.llm import urls
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"


def page(i, url, canonical=None, refresh=None):
    html = "<html><head>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "") + (f"<META http-equiv='refresh' content='0; url={refresh}'>" if refresh else "") + "</head></html>"
    return (i, url, html)


def verdicts(spark, rows):
    return {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}


def test_parts_and_rules(spark):
    got = verdicts(
        spark,
        [
            (1, "http://A.Example.ORG/es/x?q=1#f", None), (2, "https://example.org/en/12", None), (3, "https://other.org/en/12", None), (4, "http://x.com/fr/1", None),
            (5, "http://x.com/de/1", None), (6, "http://x.net/de/1", None), (7, None, None), (8, "no scheme", ""), (9, "http://badexample.org/es/", ""), (10, "http://example.org", ""), (11, "x://h?y/z", ""),
        ],
    )
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 7, 8, 11)] == [("a.example.org", "/es/x"), ("", ""), ("", ""), ("h", "")]
    assert [got[i]["rule"] for i in range(1, 12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, "org/", None, None]
    assert [got[i]["verdict"] for i in range(1, 12)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow"]


def test_blocks_reach_aliases_and_allows_come_first(spark):
    got = verdicts(
        spark,
        [
            page(1, "http://a.net/1", canonical="http://a.com/de/1"),  # an alias that is blocked, without a page
            page(2, "http://b.net/2", refresh="http://a.net/1"),  # a chain
            page(3, "https://b.net/2#top"),  # the same address
            page(4, "http://c.net/3", canonical="http://c.com/de/1"), page(5, "http://c.org/x", canonical="http://c.net/3"),  # blocked and allowed
            page(6, "http://d.com/de/1", canonical="http://d.com/fr/1"),  # its own rule decides
            page(7, "http://e.net/1", canonical="/2"), page(8, "http://e.net/2"), page(9, None, canonical="http://a.com/de/1"), page(10, "http://f.net/?a=1"), page(1, "http://a.net/1", canonical="http://a.com/de/1"),
        ],
    )
    assert [got[i]["verdict"] for i in range(1, 11)] == ["block", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[7]["alias"] == got[8]["alias"] is not None and got[10]["alias"] is None


def test_no_pages_and_clashing_columns(spark):
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    df = spark.createDataFrame([(1, "http://x.com/de/1", "", "mine", "mine")], PAGES + ", verdict string, component string")
    r = urls.filter_urls(df).first()
    assert r["verdict"] == "block" and r["component"] == "mine"


def test_query_against_rules_by_hand(spark):
    """The registered query over the stored pages, each rule tried in turn."""
    d = "/root/testdata/sf0.001"
    for r in urls.op9_urls(spark, d).collect():
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, "allow"))


class Links(HTMLParser):
    """An independent reader of what a page declares to be itself."""

    def __init__(self, url):
        super().__init__()
        self.base, self.based, self.found = url, False, []

    def handle_starttag(self, tag, attributes):
        a = {k: v or "" for k, v in reversed(attributes)}
        if tag == "base" and a.get("href", "").strip() and not self.based:
            self.base, self.based = urljoin(self.base, a["href"].strip()), True
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", "").strip())
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", "").lower():
            self.found.append(a["content"].split("=", 1)[1].strip())


def node(url):
    p = urlsplit(url)
    host = p.netloc.lower().removesuffix({"http": ":80", "https": ":443"}[p.scheme.lower()]) if p.scheme.lower() in ("http", "https") else p.netloc.lower()
    return host + (p.path or "/") + (f"?{p.query}" if p.query else "")


def brute(rows):
    """Verdicts by union-find over links that HTMLParser and urljoin give."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def rule(url):
        host, path = urlsplit(url).netloc.lower(), urlsplit(url).path
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    said = []
    for _, url, html in rows:
        reader = Links(url)
        reader.feed(html)
        for t in reader.found:
            to = urljoin(reader.base, t)
            if t and "://" in to:
                up[top(node(url))] = top(node(to))
                said += [(node(url), rule(url)), (node(to), rule(to))]
    verdict = {}
    for i, url, _ in rows:
        told = {v for n, v in said if top(n) == top(node(url))}
        verdict[i] = rule(url) or ("block" if "block" in told and "allow" not in told else "allow")
    return verdict


HEADS = [
    '<link rel="canonical" href="{}">', '<link rel="alternate canonical" href="{}">', "<LINK href='{}' REL=Canonical>", '<meta http-equiv="refresh" content="0; url={}">', '<link rel="stylesheet" href="{}">', '<base href="/de/sub/"><link rel="canonical" href="{}">',
    '<base href="http://b.com/de/"><link rel=canonical href="{}">', '<!-- <link rel="canonical" href="{}"> -->', '<link rel="canonical" title="a > b" href="{}">',
]
TARGETS = ["https://a.net/x?p=1&amp;q=2", "https://a.net/x?p=1&#38;q=2", "http://b.com/de/z", "https:&#x2F;&#47;b.com/de/z", "other", "../up", "./here", "?x=1", "/root", "//c.com/fr/y", "http://h.net", "http://h.net/", "https://h.net:443/", "http://h.net:80", "", "mailto:a@b.co", "#top", "../../../far", "a/../b", "."]


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_against_an_independent_resolver(spark, seed):
    rng = random.Random(seed)
    own = ["https://a.net/x?p=1&q=2", "http://a.net/de/sub/page", "http://h.net", "https://h.net/#f", "http://b.com/de/z", "http://b.com/x/", "https://e.net/a/b/c", "http://c.com/fr/y", "http://g.net/de/", "http://g.net/other", "http://g.net/up", "http://a.net/root", "http://h.net:8080/"]
    rows = [(i, rng.choice(own), "<html><head>" + rng.choice([*HEADS, ""]).format(rng.choice(TARGETS)) + "</head>") for i in range(60)]
    want = brute(rows)
    assert {i: r["verdict"] for i, r in verdicts(spark, rows).items()} == want and set(want.values()) == {"allow", "block"}


def test_references_are_resolved_as_elsewhere(spark):
    base = ["http://a.b/c/d/e?q", "http://a.b", "http://a.b/c/", "https://a.b/c?x#y"]
    pairs = [(b, t) for b in base for t in ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://z/y"]]
    got = spark.createDataFrame(pairs, "b string, t string").select("b", "t", urls.address(urls.resolved(F.col("b"), F.col("t"))).alias("r")).collect()
    assert [r for r in got if r["r"] != node(urljoin(r["b"], r["t"]))] == []


def test_character_references(spark):
    cases = {"a&amp;b": "a&b", "&#38;#38;": "&#38;", "&#x1F600;é": "\U0001f600é", "&#0;&#xD800;&#99999999;": "&#0;&#xD800;&#99999999;", "&amp;lt;": "&lt;", "&": "&", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", urls.unescaped(F.col("t")).alias("u")).collect()} == cases
