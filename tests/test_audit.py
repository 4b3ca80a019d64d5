"""Stored audits, projects, content scorers, impacts, messages, reports, services, stages and the event bus."""

import http.server
import json
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pagewright import stages
from pagewright.functions import text as tx
from pagewright.operators import audits, checks, clusters, content, delta, duplicates, enrich, feed, graph, impact, messages, parse, projects, rank, report, search, sites, structured, suggest, trends
from pagewright.plans.rules import CONTENT_RULES, PAGE_RULES, evaluate
from pagewright.plans.site_rules import LINK_RULES, link_input, server_errors
from pagewright.sources import services
from pagewright.streaming import bus, events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_title_case_and_tokens(spark):
    d = spark.createDataFrame([("core-web VITALS e-e-a-t 3d",), ("",), (None,)], "t string").select(tx.title_case(F.col("t")), tx.tokens(F.col("t")))
    assert rows(d) == sorted([("Core-Web Vitals E-E-A-T 3D", 4), ("", 0), (None, 0)], key=str)


def test_severity_counts_are_filled_with_zeros(spark):
    i = spark.createDataFrame([("HIGH",), (None,), ("info",)], "severity string")
    assert rows(audits.severity_counts(i)) == sorted([("high", 1), ("medium", 0), ("low", 1), ("info", 1)], key=str)
    assert rows(audits.category_counts(spark.createDataFrame([("meta",), (None,), ("",)], "category string"))) == sorted([("meta", 1), ("other", 2)], key=str)


def test_score_of_the_known_audit(spark):
    """Two high, three medium and three low issues make 90.1."""
    i = spark.createDataFrame([("x", s) for s in ["high"] * 2 + ["medium"] * 3 + ["low"] * 3], "site string, severity string")
    assert rank.score(["site"], i).first()["score"] == 90.1


def test_ranking(spark):
    i = spark.createDataFrame([("missing_title", "high", "u"), ("no_jsonld", "low", "u"), ("slow_response", "medium", "u")], "type string, severity string, affected_url string")
    top = rank.top_actions(rank.ranked(i), 10, "type").collect()
    assert top[0]["type"] == "missing_title" and top[0]["priority"] == "high" and top[0]["bucket"] == "quick_win" and len(top) == 3


def test_strategy_replaces_issues(spark):
    i, none = spark.createDataFrame([("a", "high")], "type string, severity string"), spark.createDataFrame([], "type string, severity string")
    assert audits.merged_issues(i, none) is i and audits.merged_issues(i, i.withColumn("roi", F.lit(1))).columns[-1] == "roi"


# chains, depths, links: beyond their bounds


def test_chains_of_over_ten_hops_end_with_status_0(spark):
    hops = spark.createDataFrame([(f"/{i}", 301 if i < 15 else 200, f"/{i + 1}" if i < 15 else None) for i in range(16)], "url string, status_code int, location string")
    got = {r.start_url: (r.final_url, r.final_status, r.is_loop, r.hops) for r in sites.redirect_chains(hops).collect()}
    assert len(got) == 16 and got["/15"] == ("/15", 200, False, 0) and got["/6"] == ("/15", 200, False, 9) and got["/5"] == ("/15", 0, False, 10) and got["/0"] == ("/10", 0, False, 10)


def test_deep_pages_are_reached(spark):
    e = spark.createDataFrame([(f"https://a.example/{i}", f"https://a.example/{i + 1}") for i in range(60)], "src string, dst string")
    depth = graph.click_depth(e, "https://a.example/0")
    assert depth.count() == 61 and depth.agg(F.max("depth")).first()[0] == 60
    v = e.select(F.col("dst").alias("url"), F.lit(200).alias("status_code"))
    assert not evaluate(link_input(graph.degrees(v, e), depth), LINK_RULES, "url").filter("type = 'unreachable_page'").count()


def test_sitemap_indexes_are_followed(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>/{x}.xml</loc></sitemap>" for x in ("a", "b", "gone")) + "</sitemapindex>"
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    files = [("d", "/sitemap.xml", 200, "text/xml", index), ("d", "/a.xml", 200, "application/xml", urls("1", "2")), ("d", "/b.xml", 200, "text/html", urls("3")), ("d", "/c.xml", 200, "text/xml", urls("4")), ("d", "/bad.xml", 200, "text/xml", "<urlset><url>")]
    f = spark.createDataFrame(files, "domain string, url string, status_code int, content_type string, body string")
    assert rows(sites.sitemap_tree(f, spark.createDataFrame([("d", "/sitemap.xml"), ("d", "/bad.xml")], "domain string, url string")).select("loc", "level")) == [("1", 1), ("2", 1)]
    assert sites.parse_sitemap(f.select("domain", "body")).filter("bytes > 0").count() == 5


def test_answer_bots_are_another_list(spark):
    f = spark.createDataFrame([("a", "User-agent: FacebookBot\nDisallow: /"), ("b", "User-agent: GPTBot # x\nDisallow: /"), ("c", "Disallow: /\nUser-agent: ccbot\nDisallow: /")], "domain string, body string")
    assert {r.domain: (r.blocked, r.answer_blocked, r.all_blocked) for r in sites.robots_findings(f).collect()} == {"a": (["facebookbot"], [], False), "b": (["gptbot"], [], False), "c": (["ccbot"], ["ccbot"], True)}


def test_server_error_clusters(spark):
    p = spark.createDataFrame([("a", f"/{i}", i, 500 + i % 4) for i in range(7)] + [("b", "/x", 0, 503), ("b", "/y", 1, 404)], "site string, url string, ord int, status_code int")
    assert [(r.site, r.n, r.urls) for r in server_errors(p, "site").collect()] == [("a", 7, [f"/{i}" for i in range(5)])]


def test_near_duplicate_pages(spark):
    text = " ".join(f"word{i}" for i in range(40))
    p = [("s", f"/{i}", i, "t", ["h"], "m", t) for i, t in enumerate([text, text, text + " more", "few words", text, text, " ".join(f"other{i}" for i in range(40)), ""])]
    d = spark.createDataFrame(p, "site string, url string, ord int, title string, h1 array<string>, meta_description string, text_content string")
    assert {(r.a, r.b) for r in duplicates.near_duplicate_pages(d, "site").collect()} >= {("/0", "/1"), ("/0", "/4"), ("/0", "/5"), ("/0", "/2")}
    members = spark.createDataFrame([("/0", "c"), ("/4", "c"), ("/5", "z")], "url string, cluster_id string")
    pairs = spark.createDataFrame([("/1", "/0")], "a string, b string")
    assert {(r.a, r.b) for r in duplicates.near_duplicate_pages(d, "site", members, pairs).filter("distance = 0").collect()} == {("/0", "/5")}


def test_pairs_of_copies_do_not_grow_with_their_square(spark):
    h = spark.range(300).select(F.col("id").alias("k"), F.lit(7).cast("bigint").alias("hash"))
    assert duplicates.near_pairs(h, "k").count() == 299


# content scorers


KEYWORDS = "keyword string, url string, position double, impressions long, clicks long"


def test_content_scores(spark):
    k = spark.createDataFrame([(f"k{i}", f"/{i}", 5.0, 1000 - i, 1) for i in range(12)], KEYWORDS)
    pages = spark.createDataFrame([("/0", 1, "T", "D", ["H"], [f"x{i}" for i in range(20)], 300)], "url string, ord int, title string, meta_description string, h1 array<string>, h2 array<string>, word_count int")
    prompt = {r.keyword: r.prompt for r in content.prompts(k, pages).collect()}
    assert "Title: T\nDescription: D\nH1: H\nH2: x0" in prompt["k0"] and "x9" in prompt["k0"] and "x10" not in prompt["k0"] and "(no content available)" in prompt["k1"]

    def scorer(prompts):
        out = []
        for p in prompts:
            n = int(p.split("\n")[0].split("k")[-1])
            if n == 3:
                raise RuntimeError("busy")
            answer = json.dumps({"intent_match": 10 * n, "geo_readiness": 39 + n, "intent_type": "x", "content_gaps": ["g"] if n == 2 else []})
            out.append("oops" if n == 4 else "{}" if n == 6 else f"```json\n{answer}\n```" if n == 5 else answer)
        return out

    got = content.scored(k, pages, scorer)
    by = {r.keyword: r for r in got.collect()}
    assert len(by) == 10 and by["k3"].error == "busy" and by["k4"].error == by["k6"].error == "the answer is no JSON object" and by["k5"].intent_match == 50 and by["k4"].intent_match is None
    issues = {(r.keyword, r.type) for r in content.content_issues(got).collect()}
    assert {("k0", "poor_intent_match"), ("k0", "poor_geo_readiness"), ("k2", "content_gaps_detected"), ("k5", "moderate_intent_match")} <= issues and ("k7", "moderate_intent_match") not in issues
    assert {t for _, t in issues} == {r.type for r in CONTENT_RULES}
    assert content.averages(got).first().scored == 7 and content.averages(got.limit(0)).first().avg_intent_match == 0


def test_keywords_to_score(spark):
    f = spark.createDataFrame([("a", 10, 200, 5.0), ("b", 1, 99, 5.0), ("c", 1, 900, 31.0), ("d", 1, 300, 4.0)], "query string, clicks long, impressions long, position double")
    assert [r.query for r in search.scored_keywords(f).collect()] == ["d", "a"]


def test_risk_answers(spark):
    a = spark.createDataFrame([("RISK: high\nACTION: a\nRISK: odd\nACTION2: b: c\nACTION",), ("nothing",), (None,)], "answer string")
    assert [(r.risk_level, r.actions) for r in content.risk_answers(a).collect()] == [("HIGH", ["a", "b: c"]), ("LOW", []), ("LOW", [])]


def test_impacts_and_alerts(spark):
    e = spark.createDataFrame([("e1", "critical", "core update", ["a", "b"]), ("e2", "high", "inp", ["a", "c"])], "event_id string, priority string, title string, sources array<string>")
    p = spark.createDataFrame([(f"p{i}", f"{i}.example", i, i != 1) for i in range(8)], "project_id string, domain string, ord int, enabled boolean")
    assert [r.event_id for r in impact.critical(e).collect()] == ["e1"]
    answers = spark.createDataFrame([("e1", "p3", "RISK: HIGH\nACTION: x")], "event_id string, project_id string, answer string")
    found = impact.impacts(e, p, answers)
    assert {r.project_id for r in found.collect()} == {"p0", "p2", "p3", "p4", "p5"} and found.count() == 10
    assert rows(impact.worst(found).select("event_id", "project_id", "risk_level")) == [("e1", "p3", "HIGH"), ("e2", "p0", "LOW")]
    text = {r.event_id: r.text for r in impact.alerts(e, found).collect()}
    assert "- 3.example: HIGH" in text["e1"] and text["e1"].endswith("What to do for 3.example:\n1. x") and "3. Monitor" in text["e2"]
    reports = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "a")], "project_id string, analyzed_at int, event_id string")
    assert rows(impact.latest_reports(reports)) == [("p", 2, "b"), ("q", 1, "a")]
    assert [r[0] for r in e.select(feed.heuristic_risk(F.col("priority"))).collect()] == ["MEDIUM", "LOW"]


def test_messages(spark):
    a = spark.createDataFrame([("s", "N", "d", 61.0), ("t", "M", "e", None)], "site string, name string, domain string, score double")
    sev = spark.createDataFrame([("s", "high", 2), ("s", "critical", 1)], "site string, severity string, n int")
    act = spark.createDataFrame([("s", i, f"a{i}") for i in range(1, 6)], "site string, place int, title string")
    fix = spark.createDataFrame([("s", 1, "x", "/u", None, True), ("s", 2, "y", "/v", "c", False)], "site string, place int, type string, url string, commit string, success boolean")
    seen = spark.createDataFrame([("s", 10, 200, 5.0)], "site string, clicks int, impressions int, avg_ctr double")
    text = {r.site: r.text for r in messages.summaries(a, sev, act, seen, fix).collect()}
    assert text["s"] == "Audit of N\nScore: 61.0/100 (fair)\nDomain: d\n\nIssues: 3\n  high: 2\n  medium: 0\n  low: 0\n\nSearch, 28 days: 10 clicks, 200 impressions, CTR 5.0%\n\nTop actions:\n- a1\n- a2\n- a3\n\nFixes applied:\n- x on /u (commit ?)\n1 fixes failed"
    assert text["t"].startswith("Audit of M\nScore: -/100 (poor)") and len(messages.summaries(a, sev, limit=10).first().text) == 10


# projects, fixes, stored audits


def test_projects_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("a", "A: one", "https://a.example", "t1", True, "daily", 0), ("b", "B", "b.example", "t2", False, None, 1)], projects.PROJECT)
    for kind in ("json", "yaml"):
        f = tmp_path / f"projects.{kind}"
        f.write_text(projects.exported(p, kind))
        assert rows(projects.read_projects(spark, str(f))) == rows(p)
    assert [r.project_id for r in projects.listed(p, "t2").collect()] == ["b"] and projects.listed(p, "t2", True).count() == 0 and projects.listed(p, enabled_only=True).count() == 1


def test_due_projects(spark):
    p = spark.createDataFrame([("a", True, 3600), ("b", True, 86400), ("c", False, 1), ("d", True, 60)], "project_id string, enabled boolean, every int")
    last = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0)), ("b", datetime(2024, 1, 1, 0, 0))], "project_id string, last_run timestamp")
    assert {r.project_id: (r.due, r.misfired) for r in projects.due(p, last, "2024-01-01 02:00:00").collect()} == {"a": (True, True), "b": (False, False), "d": (True, False)}


def test_fixes(spark):
    i = spark.createDataFrame([("missing_title", "https://a.example/core-web?x", "high"), ("missing_canonical", "https://a.example/p?x#y", "low"), ("org_schema_no_sameas", None, "medium"), ("missing_og_image", "u", None), ("low_ctr_opportunity", "u", "high"), ("http_error", "u", "high")], "type string, affected_url string, severity string")
    i = i.withColumns({"name": F.lit("N"), "domain": F.lit("https://a.example/"), "title": F.lit("t"), "keyword": F.lit("core web")})
    fixes = suggest.template_fixes(i)
    by = {(r.type, r.priority): r for r in fixes.collect()}
    assert by["missing_title", "high"].suggestion == "N | Core Web?X" and by["canonical_missing", "low"].url == by["canonical_missing", "low"].suggestion == "https://a.example/p"
    block = json.loads(by["missing_organization_schema", "medium"].suggestion)
    assert block["sameAs"] == ["https://a.example/impressum"] and by["missing_og_image", "medium"].url == "https://a.example/og-image.webp" and by["low_ctr_opportunity", "high"].suggestion.startswith("Title: Core Web | N\n")
    general = {r.type: r for r in suggest.general_fixes(i.select("name", "domain").distinct()).collect()}
    assert json.loads(general["missing_organization_schema"].suggestion)["logo"] == "https://a.example/logo.png" and "nosniff" in general["missing_security_headers"].suggestion
    plan = {(r.type, r.priority): (r.eligible, r.applier) for r in projects.fix_plan(fixes, ("low_ctr_opportunity",)).collect()}
    assert plan["missing_title", "high"] == (True, "title") and plan["canonical_missing", "low"] == (False, "canonical") and plan["low_ctr_opportunity", "high"] == (True, None)
    assert suggest.applicable(fixes.withColumn("severity", F.lit("x")), projects.ALLOWED).filter("priority = 'low'").count() == 0
    assert [r.type for r in projects.fixable(i, 2, "type").collect()] == ["low_ctr_opportunity", "missing_canonical"]
    counts = projects.fix_sources(fixes.withColumn("source", F.when(F.col("type") == "missing_title", "model").otherwise("template"))).first()
    assert tuple(counts) == (5, 1, 4)
    asked = {r.type: r.prompt for r in suggest.questions(i).collect()}
    assert "'N'" in asked["missing_title"] and "http_error" in asked["http_error"]


def test_stored_audits(spark, tmp_path):
    path = str(tmp_path / "audits")
    a = spark.createDataFrame([("t", "p", "a1", 50.0, 1), ("t", "p", "a2", 70.0, 2), ("t", "q", "a3", 10.0, 1)], "tenant_id string, project_id string, audit_id string, score double, completed_at int")
    audits.store(a, path)
    stored = spark.read.parquet(path)
    assert audits.audit_by_id(stored, "a2").first().score == 70.0
    assert {r.project_id: (r.score, r.audits) for r in audits.project_states(stored).collect()} == {"p": (70.0, 2), "q": (10.0, 1)}
    assert {r.audit_id: (r.previous_id, r.previous_score) for r in audits.with_previous(stored).collect()} == {"a1": (None, None), "a2": ("a1", 50.0), "a3": (None, None)}
    fixes = spark.createDataFrame([(1, "p", 5, "c1", "fixed"), (2, "p", 9, "c2", "fixed"), (3, "q", 7, None, "open"), (4, "q", None, "c1", "open")], "issue_id int, project_id string, fix_applied_at int, commit string, status string")
    assert [r.issue_id for r in audits.applied_fixes(fixes).collect()] == [2, 3, 1] and [r.issue_id for r in audits.applied_fixes(fixes, "p", 1).collect()] == [2]
    assert {r.issue_id: r.status for r in audits.reverted(fixes, "c1").collect()} == {1: "reverted", 2: "fixed", 3: "open", 4: "reverted"}
    d = audits.as_json(spark.createDataFrame([([1, 2], {"a": "b"})], "x array<int>, y map<string,string>"), "x", "y").first()
    assert (d.x, d.y) == ("[1,2]", '{"a":"b"}')
    m = audits.audit_rows(stored.withColumnRenamed("project_id", "site"), spark.createDataFrame([("p", 5)], "site string, pages_ok int"))
    assert {r.audit_id: r.pages_ok for r in m.collect()} == {"a1": 5, "a2": 5, "a3": None}


def test_report(spark, tmp_path):
    i = spark.createDataFrame([("missing_title", "high", "https://a.example/<b>"), ("no_jsonld", "low", "u")], "type string, severity string, affected_url string")
    actions = report.action_rows(rank.ranked(i), i)
    parts = report.sections(spark.createDataFrame([(61.0, report.grade(61.0))], "score double, grade string"), audits.severity_counts(i), i.groupBy("type").count(), actions, answer_scores=i.limit(0))
    page = report.page("Audit of <A & B>", parts)
    assert "<h1>Audit of &lt;A &amp; B&gt;</h1>" in page and "https://a.example/&lt;b&gt;" in page and page.count("<section>") == 5 and "Nothing found." in page and "<b>" not in page
    at = report.write(spark, page, str(tmp_path / "out"), "a1")
    assert open(at, encoding="utf-8").read() == page == open(tmp_path / "out" / "latest.html", encoding="utf-8").read()
    assert report.action_rows(None, i).count() == 2 and report.grade(None) == "unknown"


# the parts of a page that a browser renders, and page summaries


def test_rendered_pages(spark):
    raw = parse.parse_pages(spark.createDataFrame([("https://a.example/", '<html><head><title>Raw</title><meta name="description" content="d"></head><body><div id="root"></div></body></html>', 0), ("https://a.example/b", "<title>B</title>" + "word " * 60, 1)], "url string, html string, ord int"))
    assert [r[0] for r in raw.orderBy("ord").select(parse.spa_likely(F.col("html"), F.col("word_count"))).collect()] == [True, False]
    rendered = parse.parse_pages(spark.createDataFrame([("https://a.example/", "<html><body><h1>Now</h1><a href='/x'>x</a>" + "text " * 70 + "</body></html>", 0)], "url string, html string, ord int"))
    by = {r.url: r for r in parse.rendered_over_raw(raw, rendered).collect()}
    a, b = by["https://a.example/"], by["https://a.example/b"]
    assert (a.title, a.meta_description, a.h1, a.rendered_via) == ("Raw", "d", ["Now"], "browser") and a.word_count > 70 and (b.title, b.rendered_via) == ("B", None)
    h = spark.createDataFrame([({"Strict-Transport-Security": "1", "Server": "x"},)], "h map<string,string>").select(parse.security_headers(F.col("h"))).first()[0]
    assert h == {"strict-transport-security": "1"}
    s = enrich.page_summaries(parse.rendered_over_raw(raw, rendered)).orderBy("url").first()
    assert (s.rendered_via, s.title_length, s.has_canonical, s.robots_meta) == ("browser", 3, False, "")


def test_structured_fields(spark):
    d = spark.createDataFrame([("u", ['{"@type":"Organization","name":"A","logo":"l"}', '{"@type":"Event","name":"E"}'])], "url string, schema_data array<string>")
    got = {r.schema_type: (r.missing_required, sorted(r.missing_recommended)) for r in structured.validate(d).collect()}
    assert got == {"Organization": ([], ["sameAs", "url"]), "Event": (["startDate", "location"], ["description", "image", "offers"])}
    assert {r.type for r in structured.block_issues(d).collect()} == {"schema_missing_required_field"}


def test_checks_name_issues_that_rules_emit():
    from pagewright.operators.structured import BLOCK_RULES
    from pagewright.operators.trust import FILE_RULES, SITE_RULES
    from pagewright.plans.site_rules import CLUSTER_RULES, REDIRECT_RULES, ROBOTS_RULES, SITEMAP_RULES

    emitted = {r.type for rules in (PAGE_RULES, BLOCK_RULES, FILE_RULES, SITE_RULES, CLUSTER_RULES, REDIRECT_RULES, ROBOTS_RULES, SITEMAP_RULES, LINK_RULES) for r in rules}
    emitted |= {"canonical_missing", "canonical_chain", "canonical_conflicts_sitemap", "canonical_points_to_error", "broken_internal_link", "5xx_cluster", "near_duplicate_content", "keyword_cannibalization", "no_topic_clusters_detected"}
    assert {c.blocked_by for c in checks.CHECKS if c.blocked_by} <= emitted


def test_clusters(spark):
    p = spark.createDataFrame([("s", f"/{i}", i, 150 + 60 * i) for i in range(6)] + [("t", f"/t{i}", i, 900) for i in range(5)], "site string, url string, ord int, word_count int")
    m = spark.createDataFrame([("/0", "s/a"), ("/5", "s/a")], "url string, cluster_id string")
    assert rows(clusters.lonely_pages(p, m)) == [("s", f"/{i}") for i in (1, 2, 3, 4)] and rows(clusters.unclustered_sites(p, m)) == [("t", "/t0")]
    assert p.limit(1).select(clusters.label(F.lit("s.example/core-web"))).first()[0] == "Core Web"


# services


@pytest.fixture(scope="module")
def service():
    class Answers(http.server.BaseHTTPRequestHandler):
        def answer(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            if "busy" in self.path:
                return self.answer(429, "")
            if "feed" in self.path:
                return self.answer(200, "<rss><channel>" + "".join(f"<item><title>Core update {i}</title><link>l{i}</link><pubDate>Mon, 01 Jan 2024 0{i}:00:00 GMT</pubDate></item>" for i in range(3)) + "</channel></rss>")
            return self.answer(200, json.dumps({"lighthouseResult": {"categories": {"performance": {"score": 0.57}}}, "asked": self.path}))

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = self.headers["Authorization"] == "Bearer t"
            self.answer(200 if good else 401, json.dumps({"rows": [{"keys": [d, "p", "MOBILE", "deu"], "clicks": 2, "impressions": 40, "position": 3.5} for d in (asked["startDate"], asked["endDate"])]}) if good else "no")

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_speed_service(spark, service):
    from pagewright.operators.speed import parse_speed

    asked = services.speed_requests(["https://a.example/x y", "https://busy.example/"], "k", service=service)
    got = parse_speed(services.speed_payloads(services.asked(spark, asked, batch=2)))
    assert {(r.url, r.strategy): (r.performance, r.error) for r in got.collect()} == {(u, s): v for s in ("mobile", "desktop") for u, v in (("https://a.example/x y", (56, None)), ("https://busy.example/", (None, "Rate limited (429)")))}
    dead = services.asked(spark, [{"url": "http://127.0.0.1:9/"}, {"url": f"{service}/ok"}], timeout=2).orderBy("ord").collect()
    assert dead[0].status_code == 0 and dead[0].error and dead[1].status_code == 200 and services.asked(spark, []).count() == 0


def test_search_service(spark, service):
    ask = [services.search_request("sc-domain:a.example", t, date(2024, 3, 1), service=service + "/{site}") for t in ("t", "wrong")]
    answers = services.asked(spark, ask).cache()
    f = services.search_facts(answers)
    assert rows(f.select("query", "clicks", "impressions", "device")) == [("2024-02-02", 2, 40, "MOBILE"), ("2024-03-01", 2, 40, "MOBILE")]
    assert [r.ctr for r in services.keyword_facts(f).collect()] == [5.0, 5.0] and sorted((r.connected, r.denied) for r in services.reachable(answers).collect()) == [(False, True), (True, False)]
    w = services.search_window(f.withColumn("date", F.col("query").cast("date")), "2024-03-02", 10)
    assert [r.query for r in w.collect()] == ["2024-03-01"] and services.backlinks("a") is None


def test_feeds(spark, service):
    answers = services.asked(spark, services.feed_requests({"a": f"{service}/feed", "b": f"{service}/busy", "c": f"{service}/feed"}))
    items = feed.parse_rss(services.feed_bodies(answers), 2).withColumn("item_id", feed.item_id(F.col("source"), F.col("url")))
    assert items.count() == 4 and items.filter("published = '2024-01-01 01:00:00'").count() == 2
    seen = items.filter("source = 'a'")
    assert services.unseen(items.unionByName(items), seen).count() == 2 and len(services.FEEDS) == 12
    c = feed.classified(items, F.col("title"))
    assert feed.confirmed_events(c, "item_id", "published").first().n_sources == 2 and feed.prioritized(c, 3).count() == 3


def test_trend_cache(spark, tmp_path):
    p = spark.createDataFrame([("p", list("fedcba"), "DE", "3m"), ("q", [], "DE", "3m")], "project_id string, keywords array<string>, geo string, timeframe string")
    wanted = services.trend_questions(p)
    assert {r.project_id: (r.key, len(r.keywords), r.error) for r in wanted.collect()} == {"p": ("p::a,b,c,d,e,f::DE::3m", 5, None), "q": ("q::::DE::3m", 0, "no keywords")}
    asked = []

    def ask(missing):
        asked.append(sorted(r.project_id for r in missing.collect()))
        return missing.select("key", F.lit("answer").alias("answer"), F.when(F.col("project_id") == "q", "429 busy").alias("error"))

    path = str(tmp_path / "trends")
    for now in ("2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-03 00:00:00"):
        assert services.cached(wanted, path, ask, now).count() == 2
    assert asked == [["p", "q"], ["q"], ["p", "q"]]
    assert trends.fresh(spark.read.parquet(path), "2024-01-03 01:00:00").count() == 1


# stages


def test_stages(spark):
    i = spark.createDataFrame([("a", "high")], "type string, severity string")

    @stages.analyzer("good")
    def good(frames):
        return i

    @stages.analyzer("bad")
    def bad(frames):
        return i.select("no_such_column")

    @stages.analyzer("idle")
    def idle(frames):
        raise stages.Skip("no credentials")

    frames = stages.analyze(stages.Frames(), ["good", "bad", "idle"])
    assert [x[:2] for x in frames.log] == [("good", "completed"), ("bad", "failed"), ("idle", "skipped")] and frames.all_issues().count() == 1
    more = stages.run([("keyword", lambda f: {"issues": i, "metrics": i}), ("strategy", lambda f: {"issues": f.all_issues().withColumn("roi", F.lit(1.0))}), ("content", lambda f: {"fixes": i}), ("apply", lambda f: (_ for _ in ()).throw(stages.Skip("not enabled")))], frames)
    assert more.all_issues().count() == 2 and "roi" in more.all_issues().columns and set(more.fixes) == {"content"} and "metrics" in more.tables and more.log[-1] == ("apply", "skipped", "not enabled")
    stages.applier("static")(lambda f: f)
    assert stages.applier_of("static") and stages.APPLIERS
    with pytest.raises(ValueError):
        stages.applier_of("cms")
    for name in ("good", "bad", "idle"):
        del stages.ANALYZERS[name]


# the bus, on tables and streams

EVENT = "event_id long, ts timestamp, type string, project_id string, user_id long, value double, event_type string"


def some_events(n=40):
    return [(i, datetime(2024, 1, 1, i // 10, i % 10), ("started", "completed", "failed")[i % 3], f"p{i % 2}", i % 4, 1.0, "view") for i in range(n)]


def test_bus_on_tables(spark):
    e = spark.createDataFrame(some_events(), EVENT)
    assert [r.event_id for r in bus.history(e, limit=3).collect()] == [39, 38, 37] and [r.event_id for r in bus.history(e, "started", "p1", 2).collect()] == [39, 33]
    assert bus.history(e, kept=5, limit=100).count() == 5 and bus.alive(e, "2024-01-01 04:00:00", 3600, "ts").count() == 10
    life = bus.lifecycle(e.filter("event_id < 4").withColumn("audit_id", F.col("event_id") % 2).withColumn("stage", F.lit("s")))
    assert {r.audit_id: (r.status, r.seconds) for r in life.collect()} == {0: ("failed", 120), 1: ("completed", -120)}


def stream_of(spark, tmp_path, rows_, schema=EVENT, name="in"):
    path = str(tmp_path / name)
    for i in range(0, len(rows_), 10):
        spark.createDataFrame(rows_[i : i + 10], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams_equal_tables(spark, tmp_path):
    data = some_events()
    table = spark.createDataFrame(data, EVENT)
    s = stream_of(spark, tmp_path, data + data[:10])
    assert rows(drained(events.deduplicated(s), "once").select("event_id")) == [(i,) for i in sorted(range(40), key=str)] or drained(events.deduplicated(s), "once2").count() == 40
    got = drained(events.tumbling(stream_of(spark, tmp_path, data, name="t"), "1 hour"), "hours", "complete")
    assert rows(got) == rows(events.tumbling(table, "1 hour"))
    assert drained(bus.subscribed(stream_of(spark, tmp_path, data, name="f"), "failed", "p0"), "failed").count() == bus.subscribed(table, "failed", "p0").count() == 7
    c = bus.confirmed(stream_of(spark, tmp_path, data, name="c").select("ts", F.col("type").alias("keyword"), F.col("project_id").alias("source")))
    assert rows(drained(c, "confirmed", "complete")) == rows(bus.confirmed(table.select("ts", F.col("type").alias("keyword"), F.col("project_id").alias("source"))))
    assert bus.schedule(None, "6 hours") == {"processingTime": "6 hours"} and bus.schedule(None, None) == {"availableNow": True} and bus.active(spark) == []


def test_fan_out_isolates_failures(spark, tmp_path):
    got, errors = [], []

    def fails(batch):
        raise RuntimeError("no")

    q = bus.fan_out(stream_of(spark, tmp_path, some_events()), {"failed": [fails, lambda b: got.extend(r.event_id for r in b.collect())], "started": [lambda b: got.extend(r.event_id for r in b.collect())]}, str(tmp_path / "cp"), errors)
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [i for i in range(40) if i % 3 != 1] and {e[1] for e in errors} == {"failed"}


def test_bounded_history(spark, tmp_path):
    got = drained(bus.bounded_history(stream_of(spark, tmp_path, some_events()), kept=7), "kept", "update").groupBy("project_id").agg(F.max("n").alias("n"), F.max("newest").alias("newest"), F.max("oldest").alias("oldest"))
    assert rows(got) == [("p0", 7, 38, 26), ("p1", 7, 39, 27)]


def test_expiring_state(spark, tmp_path):
    data = [(i, datetime(2024, 1, 1, 0, i), "x", "p", 1 if i < 10 else 2, 1.0, "v") for i in range(10)] + [(100 + i, datetime(2024, 1, 1, 5, i), "x", "p", 2, 1.0, "v") for i in range(10)] + [(200, datetime(2024, 1, 1, 9, 0), "x", "p", 3, 1.0, "v")]
    got = drained(bus.expiring(stream_of(spark, tmp_path, data), seconds=3600), "expiry", "update")
    assert (1, 10, True) in rows(got) and (2, 10, False) in rows(got)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_accepted_requests_only_count(spark, kind):
    """On a dense table, request by request."""
    import random

    rng = random.Random(3)
    data = [(i, f"u{rng.randint(0, 3)}", datetime.fromtimestamp(1_700_000_000 + int(rng.expovariate(1 / 4000)) * 10 + rng.randint(0, 90_000))) for i in range(300)]
    d = spark.createDataFrame(data, "event_id long, user_id string, ts timestamp").withColumn("event_id", F.col("event_id").cast(kind))
    kept, want = {}, {}
    for i, u, t in sorted(data, key=lambda x: (x[1], x[2], str(x[0]) if kind == "string" else x[0])):
        at = int(t.timestamp())
        kept[u] = [x for x in kept.get(u, []) if at - x < 86400]
        want[i] = sum(at - x < 3600 for x in kept[u]) < 3 and len(kept[u]) < 10
        if want[i]:
            kept[u].append(at)
    got = {int(r.event_id): r.allowed for r in events.rate_accepted(d).collect()}
    assert got == want and 20 < sum(want.values()) < 280


def test_rounding_by_exact_values(spark):
    import random

    from pagewright.functions.numbers import rounded

    rng = random.Random(7)
    values = [2.675, 0.125, 0.375, -2.5, 2.5, 1.005, 0.5, 1.5, -0.15, 62.35, 62.25, 1e300, 0.0, 99.95, 4503599627370497.5] + [rng.randint(-10**6, 10**6) / rng.choice([8, 20, 40, 200, 2000, 3]) for _ in range(3000)]
    for places in (0, 1, 2, 3):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), places)).collect()]
        assert got == [round(v, places) + 0.0 for v in values]
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 1)).first()[0] is None
