"""A whole audit by stages, the command line, and functions for SQL users."""

import json

from pyspark.sql import functions as F

from pagewright import __main__ as cli
from pagewright import audit
from pagewright.functions import udfs
from pagewright.operators import duplicates, parse, sites
from pagewright.plans import corpus, corpus_queries, queries

SF = "/root/testdata/sf0.001"


def test_whole_audit(spark):
    facts = queries.facts(spark, SF)
    news = spark.createDataFrame([(f"i{i}", s, "Core update rolls out", "", f"2024-01-0{i + 1}") for i, s in enumerate("ab")], "item_id string, source string, title string, summary string, published string")
    owned = spark.createDataFrame([("p", "s0.example", 0, True)], "project_id string, domain string, ord int, enabled boolean")
    tables = {"pages": corpus.pages(spark, SF).drop("html"), "hops": corpus.hops(spark, SF), "sitemap": corpus.sitemap(spark, SF), "sitemap_states": corpus_queries._states(spark, SF), "robots": corpus_queries._robots(spark, SF), "files": corpus_queries._files(spark, SF), "facts": facts, "items": news, "projects": owned}
    frames = audit.run_audit(tables, lambda prompts: [json.dumps({"intent_match": 30, "geo_readiness": 50})] * len(prompts), apply=True)
    status = {n: s for n, s, _ in frames.log}
    assert status["analyzer"] == status["keyword"] == status["intent"] == status["strategy"] == status["content"] == status["apply"] == status["intelligence"] == "completed"
    assert status["trends"] == status["analyzer/speed"] == "skipped" and "failed" not in status.values()
    found = audit.summary(frames, {"name": "P"})
    per_source = {r.source: r["count"] for r in corpus_queries.all_issues(spark, SF).groupBy("source").count().collect()}
    assert found["issues_total"] == sum(n for k, n in per_source.items() if k != "gaps") + frames.issues["keyword"].count() + frames.issues["intent"].count()
    assert set(found["issues_by_severity"]) >= {"high", "medium", "low"} and found["fixes_total"] >= 2 and set(found["scores"]) == {"s0.example"}
    assert frames.tables["alerts"].count() == 1 and frames.tables["apply_counts"].first().fixes_eligible > 0
    assert audit.run_audit({}).log[0][1] == "skipped" and audit.response({"a": 1})["success"] and not audit.response(error="x")["success"]
    assert json.loads(audit.event_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json) == {"a": 1}
    assert audit.filled_values(spark.createDataFrame([(None, 2.5)], "lcp double, cls double")).first().json == '{"cls":2.5}'


def test_command_line(spark, tmp_path, capsys):
    f = str(tmp_path / "p.json")
    assert cli.main(["config", f, "add", "a", "A", "https://a.example"]) == 0 and cli.main(["config", f, "add", "b"]) == 0 and cli.main(["config", f, "remove", "b"]) == 0
    cli.main(["config", f, "list"])
    assert capsys.readouterr().out == "a\tA\thttps://a.example\tenabled\n" and cli.main(["version"]) == 0
    capsys.readouterr()
    pages = str(tmp_path / "pages.parquet")
    corpus.raw(spark, SF).select("url", "html").limit(12).write.parquet(pages)
    assert cli.main(["run", "--pages", pages, "--out", str(tmp_path / "out"), "--master", "local[4]"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert json.loads(lines[0])["issues_total"] > 12 and "<h2>Top actions</h2>" in open(lines[1], encoding="utf-8").read()


def test_functions_for_sql(spark):
    udfs.register(spark)
    files = spark.createDataFrame([("a", "Disallow: /x\nUser-agent: B # c\nDisallow:\n disallow: /y # z")], "domain string, body string")
    files.createOrReplaceTempView("files")
    got = spark.sql("SELECT r.* FROM files, LATERAL parse_robots(body) r").collect()
    assert [tuple(r) for r in got] == [tuple(r)[1:] for r in sites.robots_rules(files).orderBy("line").collect()] == [(0, "*", "/x"), (3, "B", "/y")]
    page = spark.createDataFrame([("https://a.example/", '<html lang="de"><head><title> T &amp; U </title><script>var x = "no";</script></head><body><h1>One <b>two</b></h1><h1>three</h1><a href="/x">four</a><a href="#y">five</a></body></html>', 0)], "url string, html string, ord int")
    page.createOrReplaceTempView("raw_pages")
    r = spark.sql("SELECT r.* FROM raw_pages, LATERAL parse_html(html) r").first()
    p = parse.parse_pages(page).first()
    assert (r.title, r.lang, r.h1, r.links) == (p.title, p.lang, p.h1[0], p.internal_links) == ("T & U", "de", "One two", 1) and abs(r.words - p.word_count) <= 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("w")).createOrReplaceTempView("doc_words")
    own = {r.doc_id: r.h for r in spark.sql("SELECT doc_id, simhash64(w) AS h FROM doc_words GROUP BY doc_id").collect()}
    want = {r.doc_id: r.hash for r in duplicates.simhash(docs, "doc_id", F.col("text")).collect()}
    assert {k: v for k, v in own.items()} == {k: want[k] for k in own}
