"""Queries over stored audits, projects, fixes, addresses, event history and reports, each with the SQL that must give the same rows.

Orders stand for audits (a customer is a project, the price a score), events for the events of stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, enrich, impact, messages, projects, rank, speed, suggest, trends
from ..sources import services
from ..streaming import bus
from . import corpus
from . import corpus_queries as cq
from . import queries as q
from .queries import _values
from .rules import SPEED_RULES, evaluate

ADDRESSES = [(1, " example.org "), (2, "HTTP://User@Example.org:8080/x?y"), (3, ""), (4, "localhost:3000"), (5, "https://10.1.2.3/"), (6, "http://172.16.0.1"), (7, "intranet"), (8, "https:///x"), (9, "ftp.example.org/a b"), (10, "https://[::1]/"), (11, "192.168.0.1"), (12, "https://a.b.example/#x")]
CATEGORIES = [("meta", "Head"), ("geo", "Answers"), ("schema", "Data")]
TEXTS = [("long_title", "Title is cut", "Shorten it"), ("thin_content", "Little text", None)]


def _audits(spark, sf) -> DataFrame:
    return q.read(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("project_id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("completed_at"))


def _fixed(spark, sf) -> DataFrame:
    """Line items as issues, of which those sent before 1996 have a fix."""
    l = q.read(spark, sf, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("issue_id"), F.col("l_suppkey").cast("string").alias("project_id"), F.when(F.year("l_shipdate") < 1996, F.col("l_shipdate")).alias("fix_applied_at"),
                    F.concat(F.lit("c"), F.col("l_partkey") % 7).alias("commit"), F.lit("fixed").alias("status"))


def _bus(spark, sf) -> DataFrame:
    return q.read(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("project_id"))


def _named(spark, sf) -> DataFrame:
    """The issues of pages of the made corpus, with site name and address."""
    i = cq.page_issues(corpus.pages(spark, sf))
    return i.withColumns({"name": F.col("site"), "domain": F.concat(F.lit("https://"), "site", F.lit("/"))})


def _titled(spark, sf) -> DataFrame:
    p = corpus.pages(spark, sf).select("ord", F.length("title").alias("length"), F.col("word_count").alias("words"), F.replace("title", F.lit("'"), F.lit("")).alias("value"))
    i = cq.page_issues(corpus.pages(spark, sf)).filter("type IN ('long_title', 'short_title', 'thin_content', 'missing_viewport', 'geo_answer_first', 'slow_response')")
    return enrich.issue_titles(i.join(p, "ord").withColumn("value", F.when(F.col("type").isin("long_title", "short_title"), F.col("value"))))


#: A page-speed answer for each page: SQL that both engines run. One page in ten was refused, one in ten got no JSON.
SPEED_BODY = (
    "CASE WHEN page_id % 10 = 7 THEN 'oops' ELSE concat('{\"lighthouseResult\":{\"categories\":{\"performance\":{\"score\":0.', CAST(10 + page_id * 7 % 90 AS STRING), '},\"seo\":{\"score\":0.', CAST(10 + page_id * 11 % 90 AS STRING), '},\"accessibility\":{\"score\":0.', CAST(10 + page_id * 13 % 90 AS STRING), '}},"
    "\"audits\":{\"largest-contentful-paint\":{\"numericValue\":', CAST(1000 + page_id * 97 % 5000 AS STRING), '.5},\"cumulative-layout-shift\":{\"numericValue\":0.', CAST(10 + page_id * 3 % 40 AS STRING), '},\"total-blocking-time\":{\"numericValue\":', CAST(page_id * 31 % 900 AS STRING), '}}}',"
    " CASE WHEN page_id % 3 = 0 THEN concat(',\"loadingExperience\":{\"metrics\":{\"LARGEST_CONTENTFUL_PAINT_MS\":{\"percentile\":', CAST(1500 + page_id * 53 % 4000 AS STRING), ',\"category\":\"AVERAGE\"},\"INTERACTION_TO_NEXT_PAINT\":{\"percentile\":', CAST(page_id * 17 % 700 AS STRING), ',\"category\":\"SLOW\"}}}') ELSE '' END, '}') END"
)


def _speed(spark, sf) -> DataFrame:
    p = q.read(spark, sf, "pages").selectExpr("page_id", "url", "'mobile' AS strategy", "CAST(CASE WHEN page_id % 10 = 3 THEN 429 ELSE 200 END AS INT) AS status_code", f"{SPEED_BODY} AS body")
    return speed.parse_speed(p)


def q_corpus_speed(spark, sf):
    m = _speed(spark, sf)
    return m.select("url", "error", *[F.coalesce(F.col(c), F.lit(-1)).cast("double").alias(c) for c in ("performance", "seo", "accessibility", "lcp_ms", "cls", "tbt_ms", "crux_lcp_ms", "crux_inp_ms")], "crux_inp_rating")


def q_corpus_speed_rules(spark, sf):
    return evaluate(_speed(spark, sf).filter("error IS NULL"), SPEED_RULES, "url")


def q_corpus_vitals(spark, sf):
    return speed.vitals(_speed(spark, sf)).select("url", "metric", "value", "rating", "source")


def _points(spark, sf) -> DataFrame:
    """Events a day of sixty groups of users; every fourth group's count for more each day."""
    e = q.read(spark, sf, "events").select((F.col("user_id") % 60).alias("k"), F.dayofyear("ts").alias("seq"))
    n = F.count(F.lit(1)) * F.when(F.col("k") % 4 == 0, F.col("seq")).otherwise(1)
    return e.groupBy("k", "seq").agg(n.cast("int").alias("value")).select(F.concat(F.lit("user "), "k").alias("keyword"), "seq", "value")


def _related(spark, sf) -> DataFrame:
    p = q.read(spark, sf, "part").filter("p_size < 12")
    return p.select(F.concat(F.lit("user "), F.col("p_partkey") % 60).alias("keyword"), F.col("p_partkey").cast("int").alias("seq"), F.concat(F.lit(" "), "p_type").alias("query"), F.when(F.col("p_size") == 11, "Breakout").otherwise((F.col("p_size") * 60).cast("string")).alias("value"))


def q_event_growth(spark, sf):
    return trends.growth(_points(spark, sf))


def q_event_rising(spark, sf):
    return trends.rising(_points(spark, sf), _related(spark, sf))


def q_event_insights(spark, sf):
    return trends.insights(q_event_rising(spark, sf))


def q_intel_rows(spark, sf):
    top = q.read(spark, sf, "part").groupBy(F.col("p_brand").alias("query")).agg(F.count(F.lit(1)).alias("value"))
    return audits.intel_rows(q_event_growth(spark, sf), top)


def q_project_states(spark, sf):
    return audits.project_states(_audits(spark, sf))


def q_audit_previous(spark, sf):
    return audits.with_previous(_audits(spark, sf)).select("audit_id", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), F.coalesce("previous_score", F.lit(0.0)).alias("previous_score"))


def q_applied_fixes(spark, sf):
    return audits.applied_fixes(_fixed(spark, sf)).select("issue_id", "project_id", "fix_applied_at")


def q_reverted_fixes(spark, sf):
    return audits.reverted(_fixed(spark, sf), "c3").groupBy("status", "fix_reverted").agg(F.count(F.lit(1)).alias("n"))


def q_public_addresses(spark, sf):
    a, why = enrich.public_address(F.col("address"))
    made = spark.createDataFrame(ADDRESSES, "n int, address string").withColumn("n", F.col("n").cast("bigint"))
    every = made.unionByName(q.read(spark, sf, "pages").select((F.col("page_id") + 1000).alias("n"), F.col("url").alias("address")))
    return every.select("n", a.alias("public"), why.alias("why"))


def q_page_summaries(spark, sf):
    return enrich.page_summaries(corpus.pages(spark, sf)).select("url", "status_code", "fetch_ms", "rendered_via", "title", F.col("title_length").cast("bigint").alias("title_length"), F.col("meta_description_length").cast("bigint").alias("meta_description_length"), "has_canonical", "has_viewport", "has_lang", "https", "robots_meta", "error")


def q_issue_texts(spark, sf):
    t = spark.createDataFrame(TEXTS, "type string, headline string, advice string")
    d = enrich.explained(_titled(spark, sf), t, spark.createDataFrame(CATEGORIES, "category string, label string"))
    return d.select("ord", "type", "title", "headline", "advice", "category_label", F.coalesce("current_length", F.lit(0)).alias("current_length"), "current_value")


def q_fix_plan(spark, sf):
    plan = projects.fix_plan(suggest.template_fixes(_named(spark, sf)).unionByName(suggest.general_fixes(_named(spark, sf).select("name", "domain").distinct())))
    return plan.groupBy("type", "priority", "eligible", "applier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("suggestion")).alias("letters"), F.min("url").alias("first_url"))


def q_fix_counts(spark, sf):
    plan = projects.fix_plan(suggest.template_fixes(_named(spark, sf)))
    return projects.apply_counts(plan.withColumn("success", F.col("applier").isNotNull() & (F.length("suggestion") % 3 != 0))).crossJoin(projects.fix_sources(plan))  # one row each


def q_search_keywords(spark, sf):
    return services.keyword_facts(q.facts(spark, sf)).select("query", "page", "clicks", "impressions", "ctr")


def q_event_history(spark, sf):
    return bus.history(_bus(spark, sf), "error", limit=20).select("event_id", "project_id")


def q_event_lifecycle(spark, sf):
    names = {"signup": "started", "purchase": "completed", "error": "failed"}
    e = _bus(spark, sf).withColumn("type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("type")), F.lit("other")))
    return bus.lifecycle(e.withColumn("stage", F.date_format("ts", "yyyy-MM-dd")), ("project_id", "stage")).select("project_id", "stage", "status", F.coalesce("seconds", F.lit(-1)).cast("bigint").alias("seconds"))


def q_event_alive(spark, sf):
    return bus.alive(_bus(spark, sf), "2024-01-15 00:00:00", 7 * 86400, "ts").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def q_event_confirmed(spark, sf):
    e = q.read(spark, sf, "events").select(F.col("event_type").alias("keyword"), (F.col("user_id") % 3).alias("source"), "ts").filter("event_id % 50 = 0")
    return bus.confirmed(e, 2, "1 day").select("keyword", F.col("start").cast("timestamp_ntz").alias("start"), F.col("n_sources").cast("bigint").alias("n_sources"), "items")


def _impacts(spark, sf):
    from .report_queries import _items
    from ..operators import feed

    e = feed.confirmed_events(_items(spark, sf), "doc_id", "doc_id")
    n = q.read(spark, sf, "nation").select(F.col("n_name").alias("project_id"), F.lower("n_name").alias("domain"), F.col("n_nationkey").alias("ord"), (F.col("n_regionkey") != 0).alias("enabled"))
    answers = e.select("event_id").withColumn("project_id", F.lit("BRAZIL")).withColumn("answer", F.lit("Well.\nRISK: high\nRISK: none\nACTION1: look\nACTION2:\nACTION 3: wait"))
    return e, impact.impacts(e, n, answers)


def q_event_impacts(spark, sf):
    return _impacts(spark, sf)[1].select("event_id", "project_id", "risk_level", F.array_join("actions", ";").alias("actions"))


def q_event_worst(spark, sf):
    return impact.worst(_impacts(spark, sf)[1]).select("event_id", "project_id", "risk_level")


def q_audit_messages(spark, sf):
    """What a message counts are all issues, one for each pair of near pages."""
    every = cq.issues_of(spark, sf, cq._staged_pages(spark, sf), every=True)
    scores = rank.score(["site"], every).select("site", F.col("site").alias("name"), F.concat(F.lit("https://"), "site").alias("domain"), "score")
    return messages.summaries(scores, audits.severity_counts(every, "site"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_P = cq.PAGE_ISSUES
_FIX = """f0 AS (SELECT site, 'https://' || site || '/' AS dom, 'https://' || site AS bare, affected_url AS u, type, severity, regexp_replace(affected_url, '[#?].*$', '') AS clean, regexp_extract(regexp_replace(affected_url, '/+$', ''), '[^/]*$', 0) AS slug FROM page_issues),
f1 AS (SELECT *, coalesce(nullif(array_to_string(list_transform(regexp_extract_all(lower(replace(slug, '-', ' ')), '\\p{L}+|[^\\p{L}]+'), lambda w: upper(w[1]) || w[2:]), ''), ''), 'Home') AS label FROM f0),
f2 AS (SELECT CASE type WHEN 'missing_canonical' THEN 'canonical_missing' ELSE type END AS type, severity AS priority,
  CASE type WHEN 'missing_title' THEN site || ' | ' || label WHEN 'short_title' THEN site || ' | ' || label WHEN 'long_title' THEN 'Shorten to: ' || site || ' | ' || slug WHEN 'missing_h1' THEN site WHEN 'missing_canonical' THEN clean WHEN 'missing_og_image' THEN bare || '/og-image.webp'
    WHEN 'missing_meta_description' THEN left(site || ' — entdecke unser Angebot. Persoenlich, transparent, DSGVO-konform. Jetzt mehr erfahren auf ' || dom || '.', 160) WHEN 'short_meta_description' THEN left(site || ' — entdecke unser Angebot. Persoenlich, transparent, DSGVO-konform. Jetzt mehr erfahren auf ' || dom || '.', 160)
    WHEN 'long_meta_description' THEN 'Shorten current description to 140-160 characters.' WHEN 'missing_organization_schema' THEN repeat('x', 147 + length(site) + length(dom) + 2 * length(bare)) WHEN 'missing_security_headers' THEN repeat('x', 386) END AS suggestion,
  CASE type WHEN 'missing_og_image' THEN bare || '/og-image.webp' WHEN 'missing_organization_schema' THEN dom WHEN 'missing_security_headers' THEN 'nginx config' WHEN 'missing_canonical' THEN clean ELSE u END AS url FROM f1),
fx AS (SELECT * FROM f2 WHERE suggestion IS NOT NULL),
fy AS (SELECT DISTINCT 'https://' || site || '/' AS dom, site, 'https://' || site AS bare FROM page_issues),
fz AS (SELECT * FROM fx UNION ALL SELECT 'missing_organization_schema', 'medium', repeat('x', 147 + length(site) + length(dom) + 2 * length(bare)), dom FROM fy UNION ALL SELECT 'missing_security_headers', 'medium', repeat('x', 386), 'nginx config' FROM fy),
fp AS (SELECT *, priority <> 'low' AND type IN ('missing_title', 'short_title', 'long_title', 'missing_meta_description', 'short_meta_description', 'long_meta_description', 'canonical_missing', 'missing_og_image', 'missing_organization_schema') AS eligible,
  CASE WHEN type LIKE '%title' THEN 'title' WHEN type LIKE '%description' THEN 'description' WHEN type = 'canonical_missing' THEN 'canonical' WHEN type = 'missing_og_image' THEN 'image' WHEN type = 'missing_organization_schema' THEN 'schema' END AS applier FROM {rows})"""
_EVENTS = "i AS (SELECT event_id, priority, n_name AS project_id, r FROM e JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_regionkey <> 0) ON r <= 5)"


def _events() -> str:
    from .report_queries import ORACLE_SQL as reports

    return f"e AS ({reports['feed_events']}), {_EVENTS}"


_SP = """sp AS (SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN 'Rate limited (429)' WHEN page_id % 10 = 7 THEN 'invalid JSON' END AS error, page_id % 10 IN (3, 7) AS bad, page_id % 3 = 0 AS field, trunc((10 + page_id * 7 % 90) / 100 * 100)::DOUBLE AS performance, trunc((10 + page_id * 11 % 90) / 100 * 100)::DOUBLE AS seo, trunc((10 + page_id * 13 % 90) / 100 * 100)::DOUBLE AS accessibility,
  1000 + page_id * 97 % 5000 + 0.5 AS lcp, round((10 + page_id * 3 % 40) / 100, 2) AS cls, (page_id * 31 % 900)::DOUBLE AS tbt, (1500 + page_id * 53 % 4000)::DOUBLE AS flcp, (page_id * 17 % 700)::DOUBLE AS finp FROM pages)"""
_GROW = """pt AS (SELECT 'user ' || (user_id % 60) AS keyword, dayofyear(ts) AS seq, count(*) * CASE WHEN user_id % 60 % 4 = 0 THEN dayofyear(ts) ELSE 1 END AS value FROM events GROUP BY user_id % 60, dayofyear(ts)), pn AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY seq) AS i, count(*) OVER (PARTITION BY keyword) AS n FROM pt),
gr AS (SELECT keyword, avg(value) FILTER (i <= n // 4) AS a, avg(value) FILTER (i > n - n // 4) AS z FROM pn WHERE n >= 8 GROUP BY keyword), gw AS (SELECT keyword AS query, least(9999, trunc((z - a) / a * 100)::BIGINT) AS growth_pct, trunc((z - a) / a * 100) >= 500 AS is_breakout FROM gr WHERE a >= 0.3 AND z > a * 1.5)"""
_RISE = _GROW + """, rl AS (SELECT 'user ' || (p_partkey % 60) AS keyword, p_partkey AS seq, p_type AS query, p_size, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_partkey) AS k FROM part WHERE p_size < 12),
rr AS (SELECT query, growth_pct, is_breakout, 0 AS part, query AS keyword, 0 AS seq FROM gw UNION ALL SELECT query, CASE WHEN p_size = 11 THEN 9999 ELSE p_size * 60 END, p_size = 11, 1, keyword, seq FROM rl WHERE k <= 5),
ri AS (SELECT query, growth_pct, is_breakout FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY part, keyword, seq) AS d FROM rr) WHERE d = 1 ORDER BY is_breakout DESC, growth_pct DESC, query LIMIT 10)"""

ORACLE_SQL = {
    "corpus_speed": f"WITH {_SP} SELECT url, error, CASE WHEN bad THEN -1 ELSE performance END AS performance, CASE WHEN bad THEN -1 ELSE seo END AS seo, CASE WHEN bad THEN -1 ELSE accessibility END AS accessibility, CASE WHEN bad THEN -1 ELSE lcp END::DOUBLE AS lcp_ms, CASE WHEN bad THEN -1 ELSE cls END AS cls, CASE WHEN bad THEN -1 ELSE tbt END AS tbt_ms, CASE WHEN bad OR NOT field THEN -1 ELSE flcp END AS crux_lcp_ms, CASE WHEN bad OR NOT field THEN -1 ELSE finp END AS crux_inp_ms, CASE WHEN field AND NOT bad THEN 'poor' END AS crux_inp_rating FROM sp",
    "corpus_speed_rules": f"""WITH {_SP}, g AS (SELECT *, CASE WHEN field THEN flcp ELSE lcp END AS l FROM sp WHERE NOT bad) SELECT url, 'poor_lighthouse_performance' AS type, 'performance' AS category, 'high' AS severity FROM g WHERE performance < 50 UNION ALL SELECT url, 'moderate_lighthouse_performance', 'performance', 'medium' FROM g WHERE performance BETWEEN 50 AND 89
      UNION ALL SELECT url, 'poor_lcp', 'performance', CASE WHEN l > 4000 THEN 'high' ELSE 'medium' END FROM g WHERE l > 2500 UNION ALL SELECT url, 'poor_cls', 'performance', CASE WHEN cls > 0.25 THEN 'high' ELSE 'medium' END FROM g WHERE cls > 0.1 UNION ALL SELECT url, 'poor_inp', 'performance', CASE WHEN finp > 500 THEN 'high' ELSE 'medium' END FROM g WHERE field AND finp > 200
      UNION ALL SELECT url, 'poor_tbt', 'performance', CASE WHEN tbt > 600 THEN 'high' ELSE 'medium' END FROM g WHERE NOT field AND tbt > 200 UNION ALL SELECT url, 'low_lighthouse_seo', 'meta', 'medium' FROM g WHERE seo < 90 UNION ALL SELECT url, 'low_accessibility', 'accessibility', 'medium' FROM g WHERE accessibility < 80""",
    "corpus_vitals": f"""WITH {_SP}, g AS (SELECT * FROM sp WHERE NOT bad) SELECT url, 'lcp' AS metric, CASE WHEN field THEN flcp ELSE lcp END AS value, CASE WHEN field THEN 'needs-improvement' WHEN lcp <= 2500 THEN 'good' WHEN lcp < 4000 THEN 'needs-improvement' ELSE 'poor' END AS rating, CASE WHEN field THEN 'field' ELSE 'lab' END AS source FROM g
      UNION ALL SELECT url, 'cls', cls, CASE WHEN cls <= 0.1 THEN 'good' WHEN cls < 0.25 THEN 'needs-improvement' ELSE 'poor' END, 'lab' FROM g UNION ALL SELECT url, 'inp', finp, 'poor', 'field' FROM g WHERE field""",
    "event_growth": f"WITH {_GROW} SELECT * FROM gw",
    "event_rising": f"WITH {_RISE} SELECT * FROM ri",
    "event_insights": f"WITH {_RISE} SELECT * FROM (SELECT query, CASE WHEN is_breakout THEN 'BREAKOUT: ''' || query || '''' WHEN growth_pct >= 50 THEN '''' || query || ''' +' || growth_pct || '%' END AS text FROM (SELECT * FROM ri ORDER BY is_breakout DESC, growth_pct DESC, query LIMIT 5)) WHERE text IS NOT NULL",
    "intel_rows": f"WITH {_GROW} SELECT * FROM (SELECT 'rising' AS kind, query, growth_pct::DOUBLE AS score FROM gw ORDER BY growth_pct DESC, query LIMIT 10) UNION ALL SELECT * FROM (SELECT 'top', p_brand, count(*)::DOUBLE FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)",
    "project_states": "SELECT o_custkey AS project_id, max(o_orderdate) AS last_run, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score, count(*) AS audits, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS audit_id FROM orders GROUP BY 1",
    "audit_previous": "SELECT o_orderkey AS audit_id, lag(o_orderkey, 1, -1) OVER w AS previous_id, lag(o_totalprice, 1, 0) OVER w AS previous_score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "applied_fixes": "SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_suppkey::VARCHAR AS project_id, l_shipdate AS fix_applied_at FROM lineitem WHERE year(l_shipdate) < 1996 ORDER BY l_shipdate DESC, 1 LIMIT 50",
    "reverted_fixes": "SELECT CASE WHEN l_partkey % 7 = 3 THEN 'reverted' ELSE 'fixed' END AS status, l_partkey % 7 = 3 AS fix_reverted, count(*) AS n FROM lineitem GROUP BY ALL",
    "public_addresses": f"""WITH a AS (SELECT n::BIGINT AS n, trim(address) AS u FROM {_values(ADDRESSES, "n int, address string")} UNION ALL SELECT page_id + 1000, url FROM pages), b AS (SELECT *, CASE WHEN u ILIKE 'http://%' OR u ILIKE 'https://%' THEN u ELSE 'https://' || u END AS f FROM a),
      c AS (SELECT *, regexp_extract(f, '^[a-zA-Z]+://([^/?#]*)', 1) AS raw FROM b), d AS (SELECT *, lower(raw) AS net, CASE WHEN contains(raw, '[') THEN lower(regexp_extract(raw, '\\[([^\\]]*)', 1)) ELSE lower(regexp_extract(raw, '^(?:[^@]*@)?([^:]*)', 1)) END AS hst FROM c),
      e AS (SELECT *, CASE WHEN u = '' THEN 'empty' WHEN hst = '' THEN 'invalid' WHEN regexp_matches(hst, '^(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|::1|10\\.|192\\.168\\.|172\\.)') THEN 'private' WHEN NOT contains(hst, '.') THEN 'incomplete' END AS why FROM d)
      SELECT n, CASE WHEN why IS NULL THEN lower(split_part(f, ':', 1)) || '://' || raw END AS public, why FROM e""",
    "page_summaries": f"WITH {cq.P} SELECT url, status_code, fetch_ms, 'plain' AS rendered_via, coalesce(title, '') AS title, length(coalesce(title, ''))::BIGINT AS title_length, length(coalesce(meta_description, ''))::BIGINT AS meta_description_length, canonical IS NOT NULL AS has_canonical, r % 4 <> 1 AS has_viewport, lang IS NOT NULL AS has_lang, url LIKE 'https%' AS https, coalesce(robots_meta, '') AS robots_meta, error FROM p",
    "issue_texts": f"""WITH {_P}, i AS (SELECT i.ord, i.type, i.category, length(g.title) AS len, g.word_count AS w, replace(g.title, chr(39), '') AS v FROM page_issues i JOIN g ON g.ord = i.ord WHERE i.type IN ('long_title', 'short_title', 'thin_content', 'missing_viewport', 'geo_answer_first', 'slow_response'))
      SELECT ord, type, CASE type WHEN 'long_title' THEN 'Title too long (' || len || ' chars)' WHEN 'short_title' THEN 'Title too short (' || len || ' chars)' WHEN 'thin_content' THEN 'Thin content: ' || w || ' words' ELSE replace(type, '_', ' ') END AS title,
      CASE type WHEN 'long_title' THEN 'Title is cut' WHEN 'thin_content' THEN 'Little text' END AS headline, CASE type WHEN 'long_title' THEN 'Shorten it' END AS advice, CASE category WHEN 'meta' THEN 'Head' WHEN 'geo' THEN 'Answers' WHEN 'schema' THEN 'Data' WHEN 'duplicate_content' THEN 'Duplicate_content' WHEN 'performance' THEN 'Performance' END AS category_label,
      CASE WHEN type LIKE '%_title' THEN len ELSE 0 END::INT AS current_length, CASE WHEN type LIKE '%_title' THEN v WHEN type = 'thin_content' THEN w || ' words' END AS current_value FROM i""",
    "fix_plan": f"WITH {_P}, {_FIX.replace('{rows}', 'fz')} SELECT type, priority, eligible, applier, count(*) AS n, sum(length(suggestion))::BIGINT AS letters, min(url) AS first_url FROM fp GROUP BY ALL",
    "fix_counts": f"WITH {_P}, {_FIX.replace('{rows}', 'fx')}, fk AS (SELECT eligible, applier IS NOT NULL AND length(suggestion) % 3 <> 0 AS ok FROM fp) SELECT count(*) FILTER (eligible) AS fixes_eligible, count(*) FILTER (eligible AND ok) AS fixes_applied, count(*) FILTER (eligible AND NOT ok) AS fixes_failed, count(*) AS fixes_generated, 0::BIGINT AS fixes_from_model, count(*) AS fixes_from_template FROM fk",
    "search_keywords": f"WITH {q.FACTS} SELECT query, page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(sum(clicks)::DOUBLE / greatest(sum(impressions), 1) * 100, 2) AS ctr FROM f GROUP BY query, page",
    "event_history": "SELECT event_id, user_id % 20 AS project_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "event_lifecycle": """WITH e AS (SELECT user_id % 20 AS project_id, strftime(ts, '%Y-%m-%d') AS stage, ts, event_type AS t FROM events), g AS (SELECT project_id, stage, min(ts) FILTER (t = 'signup') AS a, min(ts) FILTER (t IN ('purchase', 'error')) AS z, coalesce(bool_or(t = 'error'), false) AS bad FROM e GROUP BY ALL)
      SELECT project_id, stage, CASE WHEN bad THEN 'failed' WHEN z IS NOT NULL THEN 'completed' ELSE 'running' END AS status, coalesce(epoch(date_trunc('second', z)) - epoch(date_trunc('second', a)), -1)::BIGINT AS seconds FROM g""",
    "event_alive": "SELECT event_type AS type, count(*) AS n FROM events WHERE epoch(TIMESTAMP '2024-01-15') - epoch(date_trunc('second', ts)) <= 7 * 86400 GROUP BY 1",
    "event_confirmed": "SELECT event_type AS keyword, date_trunc('day', ts)::TIMESTAMP AS start, count(DISTINCT user_id % 3) AS n_sources, count(*) AS items FROM events WHERE event_id % 50 = 0 GROUP BY 1, 2 HAVING count(DISTINCT user_id % 3) >= 2",
    "event_impacts": f"WITH {_events()} SELECT event_id, project_id, CASE WHEN project_id = 'BRAZIL' THEN 'HIGH' WHEN priority = 'critical' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN project_id = 'BRAZIL' THEN 'look;wait' ELSE 'Check Google Search Console for ranking changes;Review Core Web Vitals scores;Monitor organic traffic for anomalies' END AS actions FROM i",
    "event_worst": f"WITH {_events()} SELECT event_id, arg_min(project_id, (CASE WHEN project_id = 'BRAZIL' THEN 0 ELSE 1 END, r)) AS project_id, CASE WHEN bool_or(project_id = 'BRAZIL') THEN 'HIGH' WHEN any_value(priority) = 'critical' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM i GROUP BY event_id",
    "audit_messages": f"""WITH RECURSIVE {cq.EVERY_ISSUE}, n AS (SELECT site, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l, count(*) AS every FROM all_issues GROUP BY site), s AS (SELECT *, greatest(0, 100 - least(50, 3 * h) - least(30, m) - least(20, 0.3 * l))::DECIMAL(18,1)::DOUBLE AS score FROM n)
      SELECT site, 'Audit of ' || site || chr(10) || 'Score: ' || score || '/100 (' || CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END || ')' || chr(10) || 'Domain: https://' || site || chr(10) || chr(10) || 'Issues: ' || every || chr(10) || '  high: ' || h || chr(10) || '  medium: ' || m || chr(10) || '  low: ' || l AS text FROM s""".replace("s AS (SELECT *, greatest", "sc AS (SELECT *, greatest").replace("AS text FROM s", "AS text FROM sc"),
}
