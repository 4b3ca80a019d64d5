"""Operators on small hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions.url import netloc
from pagewright.operators import delta, duplicates, graph, parse, rank, sites
from pagewright.plans.rules import PAGE_RULES, SPEED_RULES, evaluate, rule_input
from pagewright.plans.site_rules import LINK_RULES, link_input
from pagewright.storage import staged

HTML = """<html lang="de"><head><title>Beispiel &amp; Co</title><meta name="description" content="Eine Seite."><meta property="og:title" content="X">
<link rel="canonical" href="https://ex.com/a"><script type="application/ld+json">{"@type": "Organization", "name": "Ex"}</script></head>
<body><h1>Erste <b>Zeile</b></h1><h2>Was ist das?</h2><h2>Zwei</h2><a href="/b#x">b</a><a href="https://other.org/">o</a><a href="#top">t</a>
<img src="a.png" alt="a"><img src="b.png"></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return parse.parse_pages(spark.createDataFrame([("https://ex.com/a", HTML, 0), ("https://ex.com/e", "<html><body>hi</body></html>", 1)], "url string, html string, ord int"))


def test_parse(page):
    full, empty = page.orderBy("ord").collect()
    assert (full.title, full.lang, full.h1, len(full.h2)) == ("Beispiel & Co", "de", ["Erste Zeile"], 2)
    assert (full.meta_description, full.canonical, full.og_tags) == ("Eine Seite.", "https://ex.com/a", {"og:title": "X"})
    assert (full.internal_links, full.external_links, full.images_total, full.images_without_alt) == (1, 1, 2, 1)
    assert full.schema_types == ["Organization"] and full.internal_link_urls == ["https://ex.com/b"]
    assert (empty.title, empty.h1, empty.schema_types, empty.word_count) == (None, [], [], 1)


def test_page_rules(page):
    found = {r.type for r in evaluate(rule_input(page), PAGE_RULES, "url").filter("url like '%/a'").collect()}
    assert {"short_title", "short_meta_description", "images_without_alt", "missing_og_image"} <= found
    assert not {"missing_title", "missing_h1", "no_https", "missing_canonical", "no_jsonld"} & found


def test_speed_rules(spark):
    row = spark.createDataFrame([("u", 40.0, 5000.0, 0.2, None, 100.0, 900.0, 95.0, 70.0)], "url string, performance double, lcp_ms double, cls double, crux_inp_ms double, tbt_ms double, crux_ttfb_ms double, seo double, accessibility double")
    row = row.withColumns({"crux_lcp_ms": F.lit(None).cast("double"), "crux_cls": F.lit(None).cast("double")})
    assert {(r.type, r.severity) for r in evaluate(row, SPEED_RULES, "url").collect()} == {("poor_lighthouse_performance", "high"), ("poor_lcp", "high"), ("poor_cls", "medium"), ("poor_ttfb", "medium"), ("low_accessibility", "medium")}


def test_score_and_rank(spark):
    i = spark.createDataFrame([("s", "high")] * 2 + [("s", "medium")] * 3 + [("s", "low")] * 3, "site string, severity string")
    assert rank.score(["site"], i).first().score == 90.1
    r = rank.ranked(spark.createDataFrame([("missing_title", "high"), ("poor_cls", "low")], "type string, severity string")).collect()
    assert (r[0].priority, r[0].bucket, r[0].roi) == ("high", "quick_win", 480.0)


def test_graph(spark):
    pages = [("https://x/", ["https://x/blog", "https://x/about"]), ("https://x/blog", ["https://x/p1", "https://x/"]), ("https://x/about", ["https://x/blog"]), ("https://x/p1", ["https://x/blog"]), ("https://x/lost", ["https://x/"])]
    p = spark.createDataFrame([(u, 200, links, i) for i, (u, links) in enumerate(pages)], "url string, status_code int, internal_link_urls array<string>, ord int")
    v, e = graph.vertices(p), graph.edges(p)
    assert [r.url for r in graph.orphans(v, e, "https://x/").collect()] == ["https://x/lost"]
    ranks = {r.url: r.rank for r in graph.pagerank(v, e).collect()}
    assert ranks["https://x/blog"] > ranks["https://x/lost"] and 0.5 < sum(ranks.values()) < 1.5
    assert {r.url: r.depth for r in graph.click_depth(e, "https://x/").collect()} == {"https://x/": 0, "https://x/blog": 1, "https://x/about": 1, "https://x/p1": 2}


def test_click_depth_of_a_long_chain(spark):
    """A chain of 53 clicks ends only where no URL is new, and its far pages are deep, not unreachable."""
    pages = [(f"https://x/{i or ''}", 200, [f"https://x/{i + 1}"] if i < 53 else ["https://x/"], i) for i in range(54)]
    p = spark.createDataFrame(pages, "url string, status_code int, internal_link_urls array<string>, ord int")
    v, e = staged(graph.vertices(p), "chain"), staged(graph.edges(p), "chain")
    depth = graph.click_depth(e, "https://x/")
    assert {r.url: r.depth for r in depth.collect()} == {u: i for i, (u, *_) in enumerate(pages)}
    found = evaluate(link_input(graph.degrees(v, e), depth, "https://x/"), LINK_RULES, "url").collect()
    assert {r.type for r in found} == {"deep_page"} and len(found) == 50


def test_graph_of_hosts(spark):
    """Each host has its own home page and ranks; a host without a crawled root starts at its first page."""
    pages = [("https://a/x", ["https://a/", "https://a/y"]), ("https://a/", ["https://a/x"]), ("https://a/y", []), ("https://b/p", ["https://b/q"]), ("https://b/q", ["https://b/r"]), ("https://b/lost", ["https://b/p"])]
    p = spark.createDataFrame([(u, 200, links, i) for i, (u, links) in enumerate(pages)], "url string, status_code int, internal_link_urls array<string>, ord int")
    v, e, site = graph.vertices(p), graph.edges(p), netloc(F.col("url"))
    assert {r.url for r in graph.homes(p).collect()} == {"https://a/", "https://b/p"}
    depth = graph.click_depth(e, graph.homes(p))
    assert {r.url: r.depth for r in depth.collect()} == {"https://a/": 0, "https://a/x": 1, "https://a/y": 2, "https://b/p": 0, "https://b/q": 1, "https://b/r": 2}
    found = {(r.url, r.type) for r in evaluate(link_input(graph.degrees(v, e), depth), LINK_RULES, "url").collect()}
    assert found == {("https://b/lost", "unreachable_page"), ("https://b/lost", "orphan_page")}
    ranks = {r.url: r.rank for r in graph.pagerank(v, e, site=site).collect()}
    for host in ("a", "b"):
        mine = v.filter(site == host), e.filter(F.col("src").startswith(f"https://{host}/"))
        alone = {r.url: r.rank for r in graph.pagerank(*mine).collect()}
        assert all(abs(ranks[u] - r) < 1e-12 for u, r in alone.items()) and len(alone) == 3


def test_simhash_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 5, 9, 10, 11)]
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = {(r.a, r.b) for r in duplicates.near_pairs(spark.createDataFrame(rows, "id long, hash long"), "id").collect()}
    assert got == {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= 10}


def test_delta(spark):
    schema = "type string, affected_url string, severity string, ord int"
    d = {r.fingerprint: r for r in delta.issue_delta(spark.createDataFrame([("a", "u", "high", 1), ("b", "u", "low", 2)], schema), spark.createDataFrame([("a", "u", "low", 1), ("c", None, "low", 2)], schema)).collect()}
    assert (d["a::u"].status, d["a::u"].regressed, d["b::u"].status, d["c::"].status) == ("persistent", True, "new", "resolved")


def test_sitemap(spark):
    x = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/</loc><lastmod>2020-01-01</lastmod></url></urlset>'
    good, bad = sites.parse_sitemap(spark.createDataFrame([("a", x), ("b", "<urlset><url>")], "domain string, body string")).orderBy("domain").collect()
    assert good.urls[0].loc == "https://a/" and not good.parse_error and bad.parse_error
