"""Clusters, feeds, repairs, alerts and stored rows on small hand-written or random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import audits, clusters, delta, feed, fixes, suggest
from pagewright.plans import site_rules


def test_merged_equals_one_after_another(spark):
    rng = random.Random(7)
    members = [(s, f"c{c}", c, f"u{u}") for s in ("a", "b") for c in range(14) for u in rng.sample(range(18), rng.randint(2, 5))]
    taken = [("a", "u0"), ("a", "u1"), ("b", "u17")]
    want, gone = set(), set(taken)
    for s in ("a", "b"):
        for c in range(14):
            own = {(s, u) for s2, _, c2, u in members if (s2, c2) == (s, c)} - gone
            if len(own) >= 2:
                want |= {(s, f"c{c}", u) for _, u in own}
                gone |= own
    got = clusters.merged(spark.createDataFrame(taken, "site string, url string"), spark.createDataFrame(members, "site string, cluster_id string, first int, url string"))
    assert {tuple(r) for r in got.select("site", "cluster_id", "url").collect()} == want
    none = clusters.merged(spark.createDataFrame([], "site string, url string"), spark.createDataFrame([], "site string, cluster_id string, first int, url string"))
    assert none.count() == 0


def test_title_clusters_equal_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"word{c}" for c in "abcdefghij"]
    rows = [("s", f"u{i}", i, " ".join(rng.sample(vocabulary, rng.randint(1, 4))), []) for i in range(40)] + [("s", "copy1", 40, "alpha common words", ["x"]), ("s", "copy2", 41, "alpha common words", None), ("t", "only", 0, None, None)]
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            shared = sorted(set((a[3] or "").split()) & set((b[3] or "").split()))
            if a[0] == b[0] and len(shared) >= 2:
                want |= {(a[0], "keyword_" + "_".join(shared[:3]), x[1]) for x in (a, b)}
    got = clusters.keyword_members(spark.createDataFrame(rows, "site string, url string, ord int, title string, h1 array<string>"), ("the",))
    assert {(r.site, r.cluster_id, r.url) for r in got.collect()} == want


def test_rss(spark):
    x = "<rss><channel><title>T</title>" + "".join(f"<item><title>Core Update {i}</title><link>https://x/{i}</link><description>d</description><pubDate>Mon, 02 Jan 2023 10:0{i}:00 GMT</pubDate></item>" for i in range(4)) + "</channel></rss>"
    items = feed.parse_rss(spark.createDataFrame([("a", x), ("bad", "<rss><ch"), ("none", None)], "source string, body string"), 3)
    got = feed.prioritized(feed.classified(items, F.concat_ws(" ", "title", "summary"))).collect()
    assert [(r.source, r.url, r.priority, r.matched) for r in got] == [("a", f"https://x/{i}", "critical", ["core update"]) for i in (2, 1, 0)]
    assert got[0].published.isoformat().startswith("2023-01-02T10:02")


@pytest.mark.parametrize("html,want", [
    ("<head><TITLE>a\nb</TITLE><title>c</title></head>", "<head><title>N &lt;$1&gt; \\</title><title>c</title></head>"),
    ("<html><HEAD></HEAD>", "<html><HEAD>  <title>N &lt;$1&gt; \\</title>\n  </head>"), ("no head", "no head"), ("", ""), (None, None),
])
def test_title_repair(spark, html, want):
    assert spark.createDataFrame([(html,)], "html string").select(fixes.with_title(F.col("html"), F.lit("N <$1> \\"))).first()[0] == want


def test_schema_repair_and_files(spark):
    block, page = '{"@type":"FAQPage","a":1}', "<head></head>"
    d = spark.createDataFrame([(page,), ('<head>{"@type": "FAQPage"}</head>',)], "html string").select(fixes.with_schema(F.col("html"), F.lit(block)).alias("h")).collect()
    assert d[0].h == f'<head>  <script type="application/ld+json">\n{block}\n</script>\n  </head>' and d[1].h == '<head>{"@type": "FAQPage"}</head>'
    old = spark.createDataFrame([("d", "/robots.txt", "A\n\n"), ("d", "/x", "1")], "domain string, path string, body string")
    new = spark.createDataFrame([("d", "/robots.txt", " A"), ("d", "/x", "2"), ("d", "/y", "3\n")], "domain string, path string, body string")
    assert sorted(tuple(r) for r in fixes.changed_files(old, new).collect()) == [("d", "/x", "2\n"), ("d", "/y", "3\n")]


def test_alert(spark):
    schema = "type string, affected_url string, severity string, ord int"
    d = delta.issue_delta(spark.createDataFrame([("a", "u", "high", 1), ("b", "u", "critical", 2)], schema), spark.createDataFrame([("c", "u", "low", 1)], schema))
    assert audits.alert(d, 80.0, 81.5).first().text.split("\n") == ["REGRESSION ALERT", "", "Score: 81.5 -> 80.0 (-1.5)", "", "New issues: 2", "  [critical] b::u", "  [high  ] a::u"]
    assert audits.alert(d.filter("status <> 'new'"), 80.0, 81.5).count() == 0


def test_store_and_latest(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", 1), ("t", "q", 2)], "tenant_id string, project_id string, score int")
    for _ in range(2):
        audits.store(rows, str(tmp_path / "audits"))
    assert spark.read.parquet(str(tmp_path / "audits")).filter("project_id = 'p'").count() == 2
    assert {(r.project_id, r.score) for r in audits.latest(rows, rows.filter("project_id = 'p'").withColumn("score", F.lit(9))).collect()} == {("p", 9), ("q", 2)}
    assert [(r.metric, r.delta) for r in audits.metric_changes(rows.filter("score = 2"), rows.filter("score = 1"), ("score",)).collect()] == [("score", 1.0)]


def test_redirect_relations(spark):
    hops = spark.createDataFrame([("/a", 302), ("/b", 301)], "url string, status_code int")
    chains = spark.createDataFrame([("/a", ["/a", "/b", "/c"], 2), ("/c", ["/c"], 0)], "start_url string, path array<string>, hops int")
    assert [tuple(r) for r in site_rules.temporary_hops(hops, chains).collect()] == [("/a", "/a")]
    pages = spark.createDataFrame([("/p", ["/a", "/c"], 503, i) for i in range(3)], "url string, internal_link_urls array<string>, status_code int, ord int").withColumn("site", F.lit("s"))
    assert {tuple(r) for r in site_rules.links_to_redirects(pages, chains).collect()} == {("/p", "/a")}
    assert [(r.n, r.urls) for r in site_rules.server_errors(pages, "site").collect()] == [(3, ["/p"] * 3)]


def test_suggestions(spark):
    rows = [("short_title", "https://x/a/new-shoes/", "low"), ("long_title", None, "high"), ("missing_canonical", "https://x/a?b#c", None), ("no_jsonld", "https://x/", "high"), ("missing_h1", "", "high")]
    i = spark.createDataFrame(rows, "type string, affected_url string, severity string").withColumns({"name": F.lit("Ex"), "domain": F.lit("https://x/"), "priority": F.lit(None).cast("string")})
    s = suggest.suggestions(i)
    assert {(r.type, r.suggestion) for r in s.collect()} == {("short_title", "Ex | New Shoes"), ("long_title", "Shorten to: Ex | x"), ("missing_canonical", "https://x/a"), ("missing_h1", "Ex")}
    assert [r.type for r in suggest.applicable(s, ("missing_canonical", "short_title"), ("missing_h1",)).collect()] == ["missing_h1"]
    assert suggest.suggestions(i, {}).count() == 0


def test_competing_headings(spark):
    rows = [("u1", ["Running Shoes"]), ("u2", [" running shoes "]), ("u3", ["Running shoes"]), ("u4", ["hats"]), ("u5", ["hats"]), ("u6", ["Winter coats"]), ("u7", ["winter coats"]), ("u8", None)]
    members = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u6", "b"), ("u7", "b")], "url string, cluster_id string")
    got = clusters.competing_headings(spark.createDataFrame(rows, "url string, h1 array<string>"), members, F.lit("s"))
    assert [tuple(r) for r in got.collect()] == [("s", "running shoes", 3, 2)]
