"""Queries over the made corpus of sites (``corpus``): every source of issues, their union, and what is worked out from it.

The SQL states thresholds, lists and weights a second time, in its own words, and reads the values that went into the pages
instead of the HTML wherever it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as ur
from ..operators import audits, checks, clusters, duplicates, fixes, graph, parse, rank, sites, structured, trust
from ..storage import staged
from . import corpus
from .queries import _CANON, _GRAPH, _NET, _PARTS, _STRIP
from .rules import PAGE_RULES, evaluate, rule_input
from .site_rules import CLUSTER_RULES, LINK_RULES, REDIRECT_RULES, ROBOTS_RULES, SITEMAP_RULES, broken_entries, link_input, links_to_redirects, missing_entries, redirect_input, server_errors, temporary_hops

AS_OF = "2025-12-31"


def _issue(df: DataFrame, type_: str, category: str, severity: str, url: str = "url") -> DataFrame:
    return df.select("site", F.col(url).alias("affected_url"), F.lit(type_).alias("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))


def page_issues(p: DataFrame) -> DataFrame:
    return evaluate(rule_input(p), PAGE_RULES, "site", "url", "ord").withColumnRenamed("url", "affected_url")


def canonical_issues(p: DataFrame, entries: DataFrame) -> DataFrame:
    c = sites.canonical_conflicts(p, entries)
    return c.select(ur.netloc(F.col("url")).alias("site"), F.col("url").alias("affected_url"), "type", F.lit("canonical").alias("category"), "severity")


def redirect_issues(p: DataFrame, hops: DataFrame) -> DataFrame:
    chains = staged(sites.redirect_chains(hops, starts=hops.filter("status_code BETWEEN 300 AND 399").select("url")), "chains")
    site = lambda c: ur.netloc(F.col(c)).alias("site")
    out = evaluate(redirect_input(chains), REDIRECT_RULES, "start_url").select(site("start_url"), F.col("start_url").alias("affected_url"), "type", "category", "severity")
    out = out.unionByName(_issue(temporary_hops(hops, chains).withColumn("site", ur.netloc(F.col("url"))), "redirect_302_should_be_301", "redirect", "medium"))
    out = out.unionByName(_issue(links_to_redirects(p, chains).withColumn("site", ur.netloc(F.col("affected_url"))), "internal_link_to_redirect", "redirect", "low", "affected_url"))
    return out.unionByName(_issue(server_errors(p, "site").withColumn("url", F.get("urls", F.lit(0))), "5xx_cluster", "redirect", "critical"))


def link_issues(p: DataFrame) -> DataFrame:
    e, v = graph.edges(p), graph.vertices(p)
    out = evaluate(link_input(graph.degrees(v, e), graph.click_depth(e, graph.homes(p))), LINK_RULES, "url")
    bad = graph.broken_links(p, v).select("affected_url", F.lit("broken_internal_link").alias("type"), F.lit("link_graph").alias("category"), "severity")
    out = out.withColumnRenamed("url", "affected_url").unionByName(bad)
    return out.withColumn("site", ur.netloc(F.col("affected_url"))).select("site", "affected_url", "type", "category", "severity")


def robots_input(files: DataFrame) -> DataFrame:
    """What the robots rules look at, one row for each of ``files(domain, status_code, body)``."""
    r = sites.robots_findings(files.select("domain", F.when(F.col("status_code") == 200, F.coalesce("body", F.lit(""))).otherwise("").alias("body")))
    return r.join(files.select("domain", "status_code"), "domain").withColumns({c: F.array_join(c, ",") for c in ("blocked", "answer_blocked")})


def robots_issues(files: DataFrame) -> DataFrame:
    return evaluate(robots_input(files), ROBOTS_RULES, "domain").withColumnRenamed("domain", "site")


def _robots(spark, sf) -> DataFrame:
    return corpus.sites(spark, sf).select(F.col("site").alias("domain"), F.col("robots_status").alias("status_code"), F.col("robots").alias("body"))


def sitemap_input(p: DataFrame, entries: DataFrame, states: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One row for each of ``states(domain, found, parse_error, is_index, children, bytes)`` with all that the sitemap rules look at."""
    crawl = p.select("url", "status_code")
    canon = sites.canonical_resolutions(p).select(F.col("canonical").alias("url"))
    a = sites.sitemap_audit(entries.withColumn("loc", ur.canonical_form(F.col("loc"))), crawl.withColumn("url", ur.canonical_form(F.col("url"))), as_of, canon)
    missing = missing_entries(entries, crawl).groupBy(ur.netloc(F.col("loc")).alias("domain")).agg(F.count(F.lit(1)).alias("missing"))
    counts = ("urls", "broken", "stale", "undated", "non_canonical", "missing")
    return states.join(a, "domain", "left").join(missing, "domain", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})


def sitemap_issues(p: DataFrame, entries: DataFrame, states: DataFrame, as_of: str = AS_OF) -> DataFrame:
    out = evaluate(sitemap_input(p, entries, states, as_of), SITEMAP_RULES, "domain").withColumnRenamed("domain", "site")
    return out.withColumn("affected_url", F.lit(None).cast("string")).unionByName(_issue(broken_entries(entries, p.select("url", "status_code")).withColumnRenamed("domain", "site"), "sitemap_broken_url", "sitemap", "high", "loc"))


def _states(spark, sf) -> DataFrame:
    state = F.col("sitemap_state")
    return corpus.sites(spark, sf).select(F.col("site").alias("domain"), (state != "none").alias("found"), (state == "broken").alias("parse_error"), (F.col("h") % 7 == 6).alias("is_index"), F.lit(0).alias("children"), F.lit(1000).alias("bytes"))


def schema_issues(p: DataFrame) -> DataFrame:
    out = structured.block_issues(p).drop("pos").unionByName(structured.opportunities(p))
    return out.withColumn("site", ur.netloc(F.col("url"))).withColumnRenamed("url", "affected_url")


def _files(spark, sf) -> DataFrame:
    s = corpus.sites(spark, sf)
    rows = lambda path, body, when: s.select(F.col("site").alias("domain"), F.lit(path).alias("path"), F.when(F.expr(when), 200).otherwise(404).alias("status_code"), F.expr(body).alias("body"))
    return rows("/llms.txt", "llms", "llms IS NOT NULL").unionByName(rows("/llms-full.txt", "'x'", "h % 2 = 0")).unionByName(rows("/ai.txt", "'x'", "h % 3 = 0")).unionByName(rows("/.well-known/indexnow", "CASE WHEN h % 4 = 1 THEN '  ' ELSE 'key' END", "h % 2 = 1"))


def file_issues(files: DataFrame) -> DataFrame:
    return trust.model_file_issues(files).withColumnRenamed("domain", "site")


def cluster_members(p: DataFrame) -> DataFrame:
    return sites.path_clusters(p.filter("status_code = 200"))


def cluster_issues(p: DataFrame, members: DataFrame) -> DataFrame:
    good = p.filter("status_code = 200")
    s = sites.cluster_summary(members)
    rules = evaluate(s, CLUSTER_RULES, "pillar").withColumnRenamed("pillar", "affected_url").withColumn("site", ur.netloc(F.col("affected_url")))
    lonely = _issue(clusters.lonely_pages(good, members), "orphan_cluster_page", "topical_authority", "low")
    none = _issue(clusters.unclustered_sites(good, members), "no_topic_clusters_detected", "topical_authority", "high")
    no_pillar = _issue(s.filter("pillar IS NULL").select(F.substring_index("cluster_id", "/", 1).alias("site"), F.lit(None).cast("string").alias("url")), "missing_pillar_page", "topical_authority", "high")
    return rules.unionByName(lonely).unionByName(none).unionByName(no_pillar)


def keywords(p: DataFrame) -> DataFrame:
    """Search terms of the corpus: some name a cluster's topic and rank on one of its pages or elsewhere. Queries are literals here; written
    before use, they are data: ``lower`` of a literal is worked out by the driver, whose first call makes over 3 GB of garbage."""
    r = p.select("site", "ord", "url").filter("ord % 50 IN (6, 16, 27, 31, 35)")
    k = F.col("ord") % 50
    query = F.when(k == 6, "blog basics").when(k == 16, "SHOP guide").when(k == 27, "blog tools").when(k == 31, "shop sale").otherwise("hats")
    return r.select("site", F.col("ord"), query.alias("query"), F.col("url").alias("page"), F.when(F.col("ord") % 100 < 50, 80).otherwise(20).alias("impressions"))


def gap_issues(members: DataFrame, k: DataFrame) -> DataFrame:
    """One issue for each cluster that leaves search terms (``k(site, ord, query, page, impressions)``) of its topic without a page."""
    labels = sites.cluster_summary(members).select("cluster_id", clusters.label(F.col("cluster_id")).alias("label"), "pillar")
    site = F.substring_index("cluster_id", "/", 1)
    gaps = clusters.coverage_gaps(labels.withColumn("site", site), members, k.withColumn("site", F.lower("site")), within=("site",))
    return _issue(gaps.select("cluster_id").distinct().join(labels, "cluster_id").withColumn("site", site), "cluster_coverage_gap", "topical_authority", "medium", "pillar")


def duplicate_issues(p: DataFrame, members: DataFrame, every: bool = False) -> DataFrame:
    """With ``every``, an issue for each pair of near pages; else those of one SimHash are a class, as in ``near_pairs``."""
    good = p.filter("status_code = 200")
    near = duplicates.near_duplicate_pages(good, "site", members, sites.canonical_pairs(good), every=every)
    out = _issue(near, "near_duplicate_content", "duplicate_content", "high", "a")
    same = clusters.competing_headings(good, members, F.col("site"), first=True)
    return out.unionByName(_issue(same, "keyword_cannibalization", "duplicate_content", "high", "first_url"))


def _staged_pages(spark, sf) -> DataFrame:
    """The parsed pages, parsed once: what reads them more than once reads the columns it needs from Parquet."""
    return staged(corpus.pages(spark, sf).drop("html"), "pages")


def all_issues(spark, sf) -> DataFrame:
    """The issues of every source, as one bag."""
    return issues_of(spark, sf, _staged_pages(spark, sf))


def issues_of(spark, sf, p: DataFrame, every: bool = False) -> DataFrame:
    """The issues of every source on the staged pages ``p``; ``every`` as in ``duplicate_issues``. Each source's are written before the
    next source is looked at: in one plan the driver held the joins, broadcast tables and compiled stages of all of them at once."""
    members, entries = staged(cluster_members(p), "members"), staged(corpus.sitemap(spark, sf), "entries")
    sources = {
        "pages": lambda: page_issues(p), "canonical": lambda: canonical_issues(p, entries), "redirects": lambda: redirect_issues(p, staged(corpus.hops(spark, sf), "hops")), "links": lambda: link_issues(p),
        "robots": lambda: robots_issues(_robots(spark, sf)), "sitemap": lambda: sitemap_issues(p, entries, _states(spark, sf)), "schema": lambda: schema_issues(p), "trust": lambda: trust.trust_issues(p), "files": lambda: file_issues(_files(spark, sf)),
        "clusters": lambda: cluster_issues(p, members), "gaps": lambda: gap_issues(members, staged(keywords(p), "keywords")), "duplicates": lambda: duplicate_issues(p, members, every),
    }
    return audits.combined({k: staged(found(), f"issues-{k}") for k, found in sources.items()})


def q_corpus_pages(spark, sf):
    p = corpus.pages(spark, sf)
    n = lambda c: F.col(c).cast("bigint").alias(c)
    return p.select("ord", "site", "url", "title", "meta_description", "viewport", "robots_meta", "canonical", F.col("og_tags")["og:title"].alias("og_title"), F.col("og_tags")["og:image"].alias("og_image"), F.col("twitter_tags")["twitter:card"].alias("twitter_card"),
                    n("images_total"), n("images_without_alt"), F.size("h2").cast("bigint").alias("n_h2"), F.get("h2", F.lit(0)).alias("first_h2"), F.array_join("schema_types", ",").alias("types"), F.size("schema_data").cast("bigint").alias("blocks"),
                    F.size("hreflang").cast("bigint").alias("languages"), F.size("security_headers").cast("bigint").alias("security"), n("word_count"), n("internal_links"), n("external_links"), F.md5("html").alias("html"))


def q_corpus_page_rules(spark, sf):
    return page_issues(corpus.pages(spark, sf)).select("ord", "type", "category", "severity")


def _answers(spark, sf):
    p = rule_input(corpus.pages(spark, sf)).withColumn("host", F.col("site"))
    return audits.answer_scores(p, robots_input(_robots(spark, sf)).filter("answer_blocked <> ''").select(F.col("domain").alias("host")))


def q_corpus_answer_scores(spark, sf):
    return _answers(spark, sf).select("ord", F.col("score").cast("bigint").alias("score"))


def q_corpus_answer_averages(spark, sf):
    return audits.answer_averages(_answers(spark, sf))


def q_corpus_canonical_rules(spark, sf):
    return canonical_issues(corpus.pages(spark, sf), corpus.sitemap(spark, sf)).select("affected_url", "type", "severity")


def q_corpus_canonical_signals(spark, sf):
    return sites.canonical_resolutions(corpus.pages(spark, sf), corpus.sitemap(spark, sf)).select("url", "canonical", "signal", "listed")


def q_corpus_redirect_rules(spark, sf):
    return redirect_issues(_staged_pages(spark, sf), staged(corpus.hops(spark, sf), "hops"))


def q_corpus_link_rules(spark, sf):
    return link_issues(_staged_pages(spark, sf))


def q_corpus_robots(spark, sf):
    return robots_input(_robots(spark, sf))


def q_corpus_robots_rules(spark, sf):
    return robots_issues(_robots(spark, sf))


def q_corpus_sitemap_rules(spark, sf):
    return sitemap_issues(_staged_pages(spark, sf), corpus.sitemap(spark, sf), _states(spark, sf))


def q_corpus_schema_rules(spark, sf):
    return schema_issues(corpus.pages(spark, sf))


def q_corpus_trust_rules(spark, sf):
    return trust.trust_issues(corpus.pages(spark, sf))


def q_corpus_file_rules(spark, sf):
    return file_issues(_files(spark, sf))


def q_corpus_cluster_rules(spark, sf):
    p = _staged_pages(spark, sf)
    return cluster_issues(p, cluster_members(p))


def q_corpus_gap_rules(spark, sf):
    p = _staged_pages(spark, sf)
    return gap_issues(cluster_members(p), staged(keywords(p), "keywords"))


def q_corpus_duplicate_rules(spark, sf):
    p = _staged_pages(spark, sf)
    return duplicate_issues(p, cluster_members(p))


def q_corpus_issues(spark, sf):
    """How many issues of each kind every source finds on every site."""
    return all_issues(spark, sf).groupBy("site", "source", "type", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_corpus_severities(spark, sf):
    return audits.severity_counts(all_issues(spark, sf), "site")


def q_corpus_categories(spark, sf):
    return audits.category_counts(all_issues(spark, sf))


def q_corpus_scores(spark, sf):
    return rank.score(["site"], all_issues(spark, sf))


def q_corpus_actions(spark, sf):
    """The first ten actions, best first: each kind of issue of each site counts once."""
    one = all_issues(spark, sf).select("site", "type", "severity").distinct()
    return rank.top_actions(rank.ranked(one), 10, "site", "type", "severity").select("site", "type", "severity", "priority", "roi")


def q_corpus_metrics(spark, sf):
    return audits.crawl_metrics(corpus.pages(spark, sf), "site", corpus.sitemap(spark, sf).withColumnRenamed("domain", "site"))


def q_corpus_passed(spark, sf):
    p = _staged_pages(spark, sf)
    return checks.passed(p, issues_of(spark, sf, p), "site").select("site", "group", "check", "value")


def q_corpus_schema_blocks(spark, sf):
    v = structured.validate(corpus.pages(spark, sf))
    return v.select("url", "schema_type", "is_valid", F.array_join(F.array_sort("missing_required"), ",").alias("missing"), F.array_join(F.array_sort("missing_recommended"), ",").alias("helpful"), F.size("errors").cast("bigint").alias("n_errors"))


def q_corpus_snapshots(spark, sf):
    """One number a page over all that a snapshot keeps of it."""
    s = parse.snapshots(corpus.pages(spark, sf))
    return s.select("url", "rendered_via", F.array_join(F.array_sort("security_headers"), ",").alias("headers"), F.size("internal_link_urls").cast("bigint").alias("links"), F.array_join("h2", "|").alias("h2"), F.size(F.map_keys("og_tags")).cast("bigint").alias("og"))


def q_corpus_cluster_metrics(spark, sf):
    c = sites.cluster_summary(cluster_members(_staged_pages(spark, sf)))
    return c.select("cluster_id", clusters.label(F.col("cluster_id")).alias("topic"), "pillar", "pages", F.col("authority").cast("bigint").alias("authority"), "cannibalised")


def q_corpus_heads(spark, sf):
    """Repaired heads: each element in place of the one that is there, or before the head's end."""
    new = F.concat(F.lit("D & <"), "r", F.lit('> "new" '), F.repeat(F.lit("long "), 40))
    d = corpus.raw(spark, sf)
    digest = lambda c, n: F.md5(c).alias(n)
    block = F.lit('{"@type": "Organization", "name": "N"}')
    return d.select("ord" if "ord" in d.columns else F.col("page_id").alias("ord"), digest(fixes.with_description(F.col("html"), new), "description"), digest(fixes.with_canonical(F.col("html"), F.col("far_url")), "canonical"),
                    digest(fixes.with_image(F.col("html"), F.concat("origin", F.lit("/og.webp"))), "image"), digest(fixes.with_schema(F.col("html"), block), "block"))


def q_corpus_simple_scores(spark, sf):
    n = rank.score(["site"], all_issues(spark, sf))
    return n.select("site", rank.simple_score(F.col("high"), F.col("medium")).cast("bigint").alias("score"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_TEXT = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>|&[A-Za-z0-9#]+;', ' ', 'g')"
_DECODED = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
#: p: the made pages with what only the HTML tells (title, headings, words, links); the rest are the values that went in.
P = (
    corpus.with_sql()
    + f""",
p0 AS (SELECT *, regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g') AS bare FROM c),
p1 AS (SELECT *, list_filter(list_transform(regexp_extract_all(bare, '(?is)<a\\b[^>]*>', 0), lambda t: nullif(regexp_extract(t, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1), '')), lambda x: x IS NOT NULL AND NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)')) AS hrefs FROM p0),
p2 AS (SELECT *, list_transform(hrefs, lambda x: CASE WHEN regexp_matches(x, '^https?:') THEN x ELSE concat(origin, x) END) AS targets FROM p1),
p AS (SELECT * EXCLUDE (headings), nullif({_STRIP(_DECODED("regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
  list_transform(regexp_extract_all(bare, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), lambda x: {_STRIP(_DECODED("regexp_replace(x, '(?s)<[^>]*>', '', 'g')"))}) AS h1, headings AS n_h2,
  nullif(regexp_extract(bare, '(?is)<html\\b[^>]*\\slang="([^"]*)"', 1), '') AS lang, {_TEXT} AS txt, len(regexp_extract_all({_TEXT}, '[\\p{{L}}\\p{{N}}_]+')) AS word_count,
  list_filter(targets, lambda u: {_NET('u')} = site) AS internal, json_extract_string(block, '$."@type"') AS kind,
  [0, 1, 2, 3][r % 4 + 1] AS security, [0, 1, 2, 3][r % 4 + 1] AS n_security FROM p2)"""
)
_HIT = lambda t, c, s, w: f"SELECT site, url AS affected_url, ord, '{t}' AS type, '{c}' AS category, {s} AS severity FROM g WHERE {w}"
#: The page rules again, written out by hand.
PAGE_ISSUES = (
    P
    + """,
g AS (SELECT *, len(h1) AS n_h1, r = 0 AS is_home, status_code = 200 AS ok, row_number() OVER (PARTITION BY origin, status_code = 200 ORDER BY ord) = 1 AS opens,
  regexp_matches(lower(url), 'impressum|datenschutz|privacy|terms|agb') AS legal, regexp_matches(concat_ws(' ', title, meta_description, array_to_string(h1, ' ')), '[0-9]') AS digits FROM p),
page_issues AS ("""
    + " UNION ALL ".join(
        _HIT(t, c, s if " " in s else f"'{s}'", w)
        for t, c, s, w in [
            ("fetch_error", "crawl", "high", "error = 'timeout'"),
            ("http_error", "crawl", "CASE WHEN status_code > 499 THEN 'high' ELSE 'medium' END", "error IS NULL AND status_code > 399"),
            ("missing_title", "meta", "high", "ok AND title IS NULL"), ("short_title", "meta", "medium", "ok AND length(title) BETWEEN 1 AND 19"), ("long_title", "meta", "low", "ok AND length(title) >= 66"),
            ("missing_meta_description", "meta", "high", "ok AND r % 5 = 0"), ("short_meta_description", "meta", "low", "ok AND length(meta_description) BETWEEN 1 AND 79"), ("long_meta_description", "meta", "low", "ok AND length(meta_description) >= 166"),
            ("missing_viewport", "meta", "medium", "ok AND r % 4 = 1"), ("missing_html_lang", "meta", "low", "ok AND lang IS NULL"),
            ("noindex_detected", "meta", "CASE WHEN legal THEN 'low' ELSE 'high' END", "ok AND robots_meta LIKE '%noindex%'"), ("missing_h1", "content", "medium", "ok AND len(h1) = 0"), ("multiple_h1", "content", "low", "ok AND len(h1) >= 2"),
            ("missing_og_title", "social", "low", "ok AND r % 3 <> 0"), ("missing_og_image", "social", "medium", "ok AND r % 4 <> 0"), ("missing_twitter_card", "social", "low", "ok AND r % 5 <> 2"),
            ("images_without_alt", "accessibility", "CASE WHEN bare_images >= 4 THEN 'medium' ELSE 'low' END", "ok AND bare_images >= 1"),
            ("missing_organization_schema", "schema", "medium", "ok AND is_home AND coalesce(kind, '') NOT IN ('Organization', 'WebSite')"), ("no_jsonld", "schema", "low", "ok AND kind IS NULL"),
            ("no_https", "security", "high", "ok AND url LIKE 'http:%'"), ("missing_security_headers", "security", "medium", "ok AND opens AND security < 3"), ("slow_response", "performance", "medium", "ok AND fetch_ms >= 2501"),
            ("missing_canonical", "meta", "low", "ok AND canonical IS NULL"),
            ("soft_404", "redirect", "medium", "ok AND (word_count < 50)::INT + regexp_matches(lower(coalesce(title, '')), 'not found|404|keine seite|nicht gefunden|page not found|seite nicht gefunden|does not exist')::INT + (len(h1) = 0 AND word_count < 100)::INT > 1"),
            ("geo_answer_first", "geo", "high", "ok AND (len(h1) = 0 OR word_count < 100)"), ("geo_structured_format", "geo", "medium", "ok AND n_h2 < 2 AND NOT (asks AND n_h2 > 0)"), ("geo_fact_density", "geo", "medium", "ok AND NOT digits AND word_count <= 499"),
            ("geo_paragraph_length", "geo", "low", "ok AND CASE WHEN n_h2 = 0 OR word_count = 0 THEN word_count >= 500 ELSE word_count / (n_h2 + 1) >= 300 END"),
            ("geo_entity_clarity", "geo", "medium", "ok AND coalesce(kind, '') NOT IN ('Organization', 'Person', 'LocalBusiness', 'WebSite')"), ("geo_freshness_signals", "geo", "medium", "ok AND r % 9 <> 3"),
            ("thin_content", "duplicate_content", "medium", "ok AND word_count BETWEEN 1 AND 299 AND NOT legal"),
        ]
    )
    + ")"
)
ROBOTS = f"""rl AS (SELECT site, line, t, regexp_replace(regexp_extract(t, '^[^:]*:(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS v FROM (SELECT site, unnest(range(1, len(string_split(robots, chr(10))) + 1)) AS line, regexp_replace(split_part(unnest(string_split(robots, chr(10))), '#', 1), '^\\s+|\\s+$', '', 'g') AS t FROM s WHERE robots_status = 200)),
ra AS (SELECT *, coalesce(last_value(CASE WHEN lower(t) LIKE 'user-agent:%' THEN lower(v) END IGNORE NULLS) OVER (PARTITION BY site ORDER BY line ROWS UNBOUNDED PRECEDING), '*') AS agent FROM rl),
rd AS (SELECT site, agent, v FROM ra WHERE lower(t) LIKE 'disallow:%' AND v <> ''),
rf AS (SELECT s.site AS domain, robots_status AS status_code, coalesce(regexp_matches(lower(robots), '(^|\\n)\\s*sitemap:'), false) AND robots_status = 200 AS sitemap_named,
  coalesce((SELECT string_agg(DISTINCT agent, ',' ORDER BY agent) FROM rd WHERE rd.site = s.site AND v = '/' AND agent IN ('gptbot', 'chatgpt-user', 'claudebot', 'perplexitybot', 'google-extended', 'anthropic-ai', 'cohere-ai', 'ccbot', 'bytespider', 'facebookbot')), '') AS blocked,
  CASE WHEN robots_status <> 200 THEN '' WHEN h % 6 = 0 THEN 'gptbot' WHEN h % 6 = 1 THEN 'claudebot' ELSE '' END AS answer_blocked,
  EXISTS (SELECT 1 FROM rd WHERE rd.site = s.site AND (contains(v, '/static/') OR contains(v, '/assets/') OR contains(v, '/.css') OR contains(v, '/.js'))) AS assets_blocked, EXISTS (SELECT 1 FROM rd WHERE rd.site = s.site AND agent = '*' AND v = '/') AS all_blocked FROM s),
robots_issues AS (SELECT domain AS site, 'missing_robots_txt' AS type, 'robots' AS category, 'medium' AS severity FROM rf WHERE status_code <> 200 UNION ALL SELECT domain, 'ai_crawler_blocked', 'robots', 'high' FROM rf WHERE blocked <> '' UNION ALL SELECT domain, 'css_js_blocked', 'robots', 'high' FROM rf WHERE assets_blocked
  UNION ALL SELECT domain, 'missing_sitemap_directive', 'robots', 'medium' FROM rf WHERE status_code = 200 AND NOT sitemap_named UNION ALL SELECT domain, 'wildcard_disallow', 'robots', 'critical' FROM rf WHERE all_blocked UNION ALL SELECT domain, 'geo_ai_crawler_blocked', 'geo', 'critical' FROM rf WHERE answer_blocked <> '')"""
_W = {"geo_answer_first": 20, "geo_structured_format": 15, "geo_fact_density": 15, "geo_paragraph_length": 10, "geo_entity_clarity": 10, "geo_freshness_signals": 5}
ANSWERS = f"answers AS (SELECT p.ord, p.site, (100 - coalesce(lost, 0) - CASE WHEN answer_blocked <> '' THEN 25 ELSE 0 END)::BIGINT AS score FROM p JOIN rf ON rf.domain = p.site LEFT JOIN (SELECT ord, sum(CASE type {' '.join(f'WHEN {t!r} THEN {w}' for t, w in _W.items())} ELSE 0 END) AS lost FROM page_issues GROUP BY ord) USING (ord) WHERE status_code_ = 200)".replace("p.ord, p.site", "p.ord, p.site").replace("WHERE status_code_ = 200", "WHERE p.status_code = 200")
CANON = f"""cr AS (SELECT {_CANON('url')} AS url, {_CANON('coalesce(canonical, url)')} AS canonical, canonical IS NULL AS own, status_code, robots_meta, r % 7 = 0 AS cluster, {_CANON('far_url')} AS far FROM p),
ml AS (SELECT DISTINCT {_CANON('loc')} AS url FROM m), cs AS (SELECT cr.*, ml.url IS NOT NULL AS listed FROM cr LEFT JOIN ml USING (url)),
cj AS (SELECT a.*, t.status_code AS ts, t.robots_meta AS tr, t.canonical AS tc, t.url AS tu, EXISTS (SELECT 1 FROM ml WHERE ml.url = a.canonical) AS tl FROM cs a LEFT JOIN cr t ON a.canonical = t.url),
canonical_issues AS (SELECT url AS affected_url, 'canonical_missing' AS type, 'medium' AS severity FROM cj WHERE own UNION ALL SELECT url, 'canonical_points_to_redirect', 'high' FROM cj WHERE url <> canonical AND ts >= 300 AND ts < 400
  UNION ALL SELECT url, 'canonical_points_to_error', CASE WHEN ts = 404 THEN 'critical' ELSE 'high' END FROM cj WHERE url <> canonical AND ts >= 400 UNION ALL SELECT url, 'canonical_conflicts_sitemap', 'medium' FROM cj WHERE url <> canonical AND listed AND NOT tl
  UNION ALL SELECT url, 'canonical_points_to_noindex', 'high' FROM cj WHERE url <> canonical AND tr LIKE '%noindex%' UNION ALL SELECT url, 'canonical_conflicts_hreflang', 'high' FROM cj WHERE url <> canonical AND cluster AND canonical <> far
  UNION ALL SELECT url, 'canonical_chain', 'medium' FROM cj WHERE url <> canonical AND tc <> tu)"""
REDIRECTS = f"""rw AS (SELECT url AS start_url, url AS cur, [url] AS path, false AS lp, 0 AS n, status_code, location FROM c WHERE status_code BETWEEN 300 AND 399
  UNION ALL SELECT start_url, rw.location, list_append(path, rw.location), list_contains(path, rw.location), n + 1, c.status_code, c.location FROM rw LEFT JOIN c ON c.url = rw.location WHERE NOT lp AND rw.status_code BETWEEN 300 AND 399 AND rw.location IS NOT NULL),
re AS (SELECT * FROM rw WHERE lp OR NOT coalesce(status_code BETWEEN 300 AND 399 AND location IS NOT NULL, false)),
redirect_issues AS (SELECT {_NET('start_url')} AS site, start_url AS affected_url, 'redirect_loop' AS type, 'redirect' AS category, 'critical' AS severity FROM re WHERE lp UNION ALL SELECT {_NET('start_url')}, start_url, 'redirect_chain', 'redirect', 'medium' FROM re WHERE NOT lp AND n > 1
  UNION ALL SELECT {_NET('start_url')}, start_url, 'redirect_to_different_domain', 'redirect', 'high' FROM re WHERE {_NET('start_url')} <> {_NET("cur")}
  UNION ALL SELECT {_NET('u')}, u, 'redirect_302_should_be_301', 'redirect', 'medium' FROM (SELECT start_url, unnest(path) AS u FROM re) JOIN c ON c.url = u AND c.status_code = 302
  UNION ALL SELECT DISTINCT ON (p.url, t) p.site, p.url, 'internal_link_to_redirect', 'redirect', 'low' FROM (SELECT site, url, regexp_replace(unnest(internal), '#.*$', '') AS t FROM p) p JOIN c ON c.url = t AND c.status_code BETWEEN 300 AND 399
  UNION ALL SELECT site, arg_min(url, ord), '5xx_cluster', 'redirect', 'critical' FROM c WHERE status_code >= 500 GROUP BY site HAVING count(*) >= 3)"""
LINKS = f"""lv AS (SELECT DISTINCT {_GRAPH('url')} AS url, site, status_code, r = 0 AS is_home FROM p),
lt AS (SELECT DISTINCT url AS page, site, regexp_replace(t, '#.*$', '') AS t FROM (SELECT url, site, unnest(internal) AS t FROM p)),
le AS (SELECT DISTINCT {_GRAPH('page')} AS src, {_GRAPH('t')} AS dst FROM lt WHERE {_GRAPH('page')} <> {_GRAPH('t')}),
ld AS (SELECT url, 0 AS depth FROM lv WHERE is_home UNION SELECT dst, depth + 1 FROM ld JOIN le ON src = url WHERE depth < 60),
lm AS (SELECT url, min(depth) AS depth FROM ld GROUP BY url), lin AS (SELECT dst AS url, count(*) AS i FROM le GROUP BY dst), lout AS (SELECT src AS url, count(*) AS o FROM le GROUP BY src),
lx AS (SELECT v.*, coalesce(i, 0) AS i, coalesce(o, 0) AS o, depth FROM lv v LEFT JOIN lin USING (url) LEFT JOIN lout USING (url) LEFT JOIN lm USING (url)),
link_issues AS (SELECT site, url AS affected_url, 'orphan_page' AS type, 'link_graph' AS category, 'medium' AS severity FROM lx WHERE i = 0 AND NOT is_home AND status_code < 400 UNION ALL SELECT {_NET('url')}, url, 'deep_page', 'link_graph', 'low' FROM lm WHERE depth >= 4
  UNION ALL SELECT site, url, 'unreachable_page', 'link_graph', 'high' FROM lx WHERE depth IS NULL AND status_code < 400 UNION ALL SELECT site, url, 'link_equity_sink', 'link_graph', 'low' FROM lx WHERE i >= 5 AND o = 0 AND status_code < 400
  UNION ALL SELECT lt.site, page, 'broken_internal_link', 'link_graph', CASE WHEN status_code = 404 THEN 'high' ELSE 'medium' END FROM lt JOIN lv ON lv.url = {_GRAPH('t')} WHERE status_code >= 400)"""
SITEMAPS = f"""mc AS (SELECT {_CANON('url')} AS url, max(status_code) AS st FROM c GROUP BY 1), mx AS (SELECT DISTINCT canonical AS url FROM cr),
mj AS (SELECT m.domain, m.loc, m.lastmod, m.pos, mc.st, mx.url IS NULL AS off FROM m LEFT JOIN mc ON mc.url = {_CANON('loc')} LEFT JOIN mx ON mx.url = {_CANON('loc')}),
ma AS (SELECT domain, count(*) AS urls, count(*) FILTER (st >= 300) AS broken, count(*) FILTER (lastmod LIKE '2020%') AS stale, count(*) FILTER (lastmod = '') AS undated, count(*) FILTER (off) AS non_canonical FROM mj GROUP BY domain),
mm AS (SELECT site AS domain, count(DISTINCT url) AS missing FROM c WHERE status_code = 200 AND NOT EXISTS (SELECT 1 FROM m WHERE m.loc = c.url) GROUP BY site),
mr AS (SELECT s.site, h % 7 = 6 AS is_index, sitemap_state AS state, coalesce(urls, 0) AS urls, coalesce(broken, 0) AS broken, coalesce(stale, 0) AS stale, coalesce(undated, 0) AS undated, coalesce(non_canonical, 0) AS non_canonical, coalesce(missing, 0) AS missing FROM s LEFT JOIN ma ON ma.domain = s.site LEFT JOIN mm ON mm.domain = s.site),
mu AS (SELECT * FROM mr WHERE state = 'read' AND NOT is_index AND urls > 0),
sitemap_issues AS (SELECT site, NULL::VARCHAR AS affected_url, 'missing_sitemap' AS type, 'sitemap' AS category, 'high' AS severity FROM mr WHERE state = 'none' UNION ALL SELECT site, NULL, 'sitemap_parse_error', 'sitemap', 'critical' FROM mr WHERE state = 'broken'
  UNION ALL SELECT site, NULL, 'empty_sitemap_index', 'sitemap', 'high' FROM mr WHERE state = 'read' AND is_index UNION ALL SELECT site, NULL, 'empty_sitemap', 'sitemap', 'high' FROM mr WHERE state = 'read' AND NOT is_index AND urls = 0
  UNION ALL SELECT site, NULL, 'sitemap_missing_pages', 'sitemap', 'medium' FROM mu WHERE missing > 0 UNION ALL SELECT site, NULL, 'sitemap_stale_lastmod', 'sitemap', 'low' FROM mu WHERE stale > 0 UNION ALL SELECT site, NULL, 'sitemap_no_lastmod', 'sitemap', 'medium' FROM mu WHERE undated = urls
  UNION ALL SELECT site, NULL, 'sitemap_non_canonical_urls', 'sitemap', 'high' FROM mu WHERE non_canonical > 0 UNION ALL SELECT site, NULL, 'sitemap_many_broken_urls', 'sitemap', 'critical' FROM mu WHERE broken >= 6
  UNION ALL SELECT domain, loc, 'sitemap_broken_url', 'sitemap', 'high' FROM (SELECT m.domain, m.loc, row_number() OVER (PARTITION BY m.domain ORDER BY pos) AS n FROM m JOIN c ON c.url = m.loc AND c.status_code >= 300) WHERE n <= 5)"""
#: What each kind of block lacks, by its number: 2 has no price, 4 an answer without question, 5 an item without position, 6 no type, 7 neither author nor date.
SCHEMAS = """schema_issues AS (SELECT site, url AS affected_url, 'schema_syntax_error' AS type, 'schema' AS category, 'high' AS severity FROM c WHERE r % 9 IN (2, 4, 5, 6) UNION ALL SELECT site, url, 'schema_missing_required_field', 'schema', 'medium' FROM c WHERE r % 9 = 7
  UNION ALL SELECT site, url, 'schema_rich_result_opportunity', 'schema', 'info' FROM c WHERE r % 9 NOT IN (0, 5) AND r > 0)"""
TRUST = """ts AS (SELECT site, bool_or(url LIKE '%/impressum') AS a, bool_or(url LIKE '%/privacy') AS b, bool_or(url LIKE '%/kontakt') AS c, bool_or(url LIKE '%/about-us') AS d, bool_or(r % 9 = 1) AS org, bool_or(r % 9 IN (3, 7)) AS art, bool_or(r % 9 = 3) AS full_art, bool_and(url LIKE 'https%') AS safe FROM c GROUP BY site),
tt AS (SELECT *, 15 * a::INT + 15 * b::INT + 10 * c::INT + 5 * d::INT + 10 * org::INT + 15 * (full_art OR NOT art)::INT + 10 * (full_art OR NOT art)::INT + 5 * (NOT art)::INT + 5 * safe::INT + CASE WHEN org THEN 6 ELSE 0 END AS score FROM ts),
trust_issues AS (SELECT site, 'missing_impressum' AS type, 'eeat' AS category, 'high' AS severity FROM tt WHERE NOT a UNION ALL SELECT site, 'missing_datenschutz', 'eeat', 'high' FROM tt WHERE NOT b UNION ALL SELECT site, 'missing_contact_page', 'eeat', 'medium' FROM tt WHERE NOT c UNION ALL SELECT site, 'missing_about_page', 'eeat', 'low' FROM tt WHERE NOT d
  UNION ALL SELECT site, 'missing_org_schema', 'eeat', 'high' FROM tt WHERE NOT org UNION ALL SELECT site, 'articles_missing_author', 'eeat', 'high' FROM tt WHERE art AND NOT full_art UNION ALL SELECT site, 'articles_missing_date_published', 'eeat', 'medium' FROM tt WHERE art AND NOT full_art
  UNION ALL SELECT site, 'articles_missing_date_modified', 'eeat', 'low' FROM tt WHERE art UNION ALL SELECT site, 'eeat_score_critical', 'eeat', 'critical' FROM tt WHERE score <= 29 UNION ALL SELECT site, 'eeat_score_low', 'eeat', 'high' FROM tt WHERE score BETWEEN 30 AND 59)"""
FILES = """file_issues AS (SELECT site, 'missing_llms_txt' AS type, 'llms_ai' AS category, 'medium' AS severity FROM s WHERE h % 4 = 3 UNION ALL SELECT site, 'invalid_llms_syntax', 'llms_ai', 'high' FROM s WHERE h % 4 = 1 UNION ALL SELECT site, 'llms_no_links', 'llms_ai', 'medium' FROM s WHERE h % 4 = 2
  UNION ALL SELECT site, 'missing_llms_full_txt', 'llms_ai', 'low' FROM s WHERE h % 2 = 1 UNION ALL SELECT site, 'missing_ai_txt', 'llms_ai', 'low' FROM s WHERE h % 3 <> 0 UNION ALL SELECT site, 'missing_indexnow', 'llms_ai', 'low' FROM s WHERE h % 2 = 0 OR h % 4 = 1)"""
CLUSTERS = f"""ks AS (SELECT *, list_filter(string_split(regexp_extract(url, '{_PARTS}', 3), '/'), lambda x: x <> '') AS seg, len(internal) AS il FROM p WHERE status_code = 200),
km AS (SELECT *, site || '/' || seg[1] AS cluster_id, nullif(lower(array_to_string(regexp_split_to_array({_STRIP("coalesce(title, '')")}, '\\s+')[1:3], ' ')), '') AS opening FROM ks WHERE len(seg) >= 2 AND site || '/' || seg[1] IN (SELECT site || '/' || seg[1] FROM ks WHERE len(seg) >= 2 GROUP BY 1 HAVING count(*) >= 2)),
kc AS (SELECT site, cluster_id, arg_max(url, (1000 - 100 * len(seg) + word_count + 50 * il) * 1000000000 - ord) AS pillar, count(*) FILTER (il > 0) / count(*) AS linked, count(opening) >= 2 AND count(opening) > count(DISTINCT opening) AS twice FROM km GROUP BY 1, 2),
cluster_issues AS (SELECT site, pillar AS affected_url, 'weak_cluster_linking' AS type, 'topical_authority' AS category, 'medium' AS severity FROM kc WHERE linked < 0.5 UNION ALL SELECT site, pillar, 'cluster_cannibalization', 'topical_authority', 'high' FROM kc WHERE twice
  UNION ALL SELECT site, url, 'orphan_cluster_page', 'topical_authority', 'low' FROM ks WHERE word_count > 200 AND url NOT IN (SELECT url FROM km) AND site IN (SELECT site FROM km)
  UNION ALL SELECT site, arg_min(url, ord), 'no_topic_clusters_detected', 'topical_authority', 'high' FROM ks WHERE site NOT IN (SELECT site FROM km) GROUP BY site HAVING count(*) >= 5),
kk AS (SELECT site, url, ord % 50 AS k, ord % 100 < 50 AS seen FROM c WHERE r IN (6, 16, 27, 31, 35)),
gap_issues AS (SELECT DISTINCT kc.site, pillar AS affected_url, 'cluster_coverage_gap' AS type, 'topical_authority' AS category, 'medium' AS severity FROM kc JOIN kk ON kk.site = kc.site AND seen AND ((cluster_id LIKE '%/blog' AND k IN (6, 27)) OR (cluster_id LIKE '%/shop' AND k IN (16, 31))) WHERE NOT EXISTS (SELECT 1 FROM km WHERE km.cluster_id = kc.cluster_id AND km.url = kk.url))"""
_BIT = ", ".join(f"CASE WHEN sum(CASE WHEN (x >> {i}) & 1 = 1 THEN n ELSE -n END) >= 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END AS b{i}" for i in range(64))
_CLASS_PAIRS = """df AS (SELECT site, u, min(ord) AS first FROM dh GROUP BY site, u),
dp AS (SELECT least(a.first, b.first) AS a, greatest(a.first, b.first) AS b FROM df a JOIN df b ON a.site = b.site AND a.u < b.u WHERE bit_count(xor(a.u, b.u)) <= 10 UNION ALL SELECT first, ord FROM dh JOIN df USING (site, u) WHERE ord <> first)"""
_PAGE_PAIRS = "dp AS (SELECT a.ord AS a, b.ord AS b FROM dh a JOIN dh b ON a.site = b.site AND a.ord < b.ord WHERE bit_count(xor(a.u, b.u)) <= 10)"
_DUPLICATES = lambda pairs: f"""dt AS (SELECT ord, t, count(*) AS n, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS x FROM (SELECT ord, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM ks WHERE len(regexp_extract_all(txt, '\\S+')) >= 20) GROUP BY ord, t),
db AS (SELECT ord, {_BIT} FROM dt GROUP BY ord), dh AS (SELECT site, ord, url, ({' | '.join(f'b{i}' for i in range(64))}) AS u FROM db JOIN ks USING (ord)),
{pairs},
dk AS (SELECT url, max(cluster_id) AS c FROM km GROUP BY url),
du AS (SELECT x.site, x.url AS a, y.url AS b FROM dp JOIN dh x ON x.ord = dp.a JOIN dh y ON y.ord = dp.b),
dx AS (SELECT du.* FROM du LEFT JOIN dk ca ON ca.url = a LEFT JOIN dk cb ON cb.url = b WHERE NOT coalesce(ca.c = cb.c, false)
  AND NOT EXISTS (SELECT 1 FROM cr JOIN ks ON {_CANON('ks.url')} = cr.url WHERE ks.url = a AND cr.canonical = {_CANON('b')}) AND NOT EXISTS (SELECT 1 FROM cr JOIN ks ON {_CANON('ks.url')} = cr.url WHERE ks.url = b AND cr.canonical = {_CANON('a')})),
dhh AS (SELECT site, {_STRIP('lower(h1[1])')} AS h1, ks.url, ord, coalesce(dk.c, '_none_' || ks.url) AS c FROM ks LEFT JOIN dk ON dk.url = ks.url),
duplicate_issues AS (SELECT site, a AS affected_url, 'near_duplicate_content' AS type, 'duplicate_content' AS category, 'high' AS severity FROM dx UNION ALL SELECT site, arg_min(url, ord), 'keyword_cannibalization', 'duplicate_content', 'high' FROM dhh WHERE length(h1) > 5 GROUP BY site, h1 HAVING count(*) >= 2 AND count(DISTINCT c) >= 2)"""  # noqa: E731
DUPLICATES, EVERY_DUPLICATE = _DUPLICATES(_CLASS_PAIRS), _DUPLICATES(_PAGE_PAIRS)
_ALL = [PAGE_ISSUES, ROBOTS, CANON, REDIRECTS, LINKS, SITEMAPS, SCHEMAS, TRUST, FILES, CLUSTERS]
_SOURCES = {
    "pages": "SELECT site, affected_url, type, category, severity FROM page_issues", "canonical": f"SELECT {_NET('affected_url')} AS site, affected_url, type, 'canonical' AS category, severity FROM canonical_issues",
    "redirects": "SELECT * FROM redirect_issues", "links": "SELECT * FROM link_issues", "robots": "SELECT site, NULL AS affected_url, type, category, severity FROM robots_issues", "sitemap": "SELECT * FROM sitemap_issues", "schema": "SELECT * FROM schema_issues",
    "trust": "SELECT site, NULL AS affected_url, type, category, severity FROM trust_issues", "files": "SELECT site, NULL AS affected_url, type, category, severity FROM file_issues", "clusters": "SELECT * FROM cluster_issues", "gaps": "SELECT * FROM gap_issues", "duplicates": "SELECT * FROM duplicate_issues",
}
_BAG = "all_issues AS (" + " UNION ALL ".join(f"SELECT site, affected_url, type, category, severity, '{k}' AS source FROM ({v})" for k, v in _SOURCES.items()) + ")"
#: The bag of all issues; in the second each pair of near pages is one.
ALL_ISSUES, EVERY_ISSUE = ",\n".join([*_ALL, DUPLICATES, _BAG]), ",\n".join([*_ALL, EVERY_DUPLICATE, _BAG])
_R = "WITH RECURSIVE "
#: Checks that only an issue speaks against: group, check, issue.
_BY_ISSUE = """technical|robots.txt present|missing_robots_txt
technical|sitemap present|missing_sitemap
technical|no redirect chains|redirect_chain
technical|no redirect loops|redirect_loop
technical|no soft 404|soft_404
technical|styles and scripts may be crawled|css_js_blocked
technical|crawling is not shut off|wildcard_disallow
content|no duplicates|near_duplicate_content
content|no competing headings|keyword_cannibalization
content|topic clusters|no_topic_clusters_detected
content|legal notice|missing_impressum
content|privacy page|missing_datenschutz
content|contact page|missing_contact_page
content|about page|missing_about_page
content|organisation described|missing_org_schema
content|trust score|eeat_score_low
structure|no canonical chains|canonical_chain
structure|canonicals agree with the sitemap|canonical_conflicts_sitemap
structure|no orphans|orphan_page
structure|three clicks at most|deep_page
structure|no broken links|broken_internal_link
structure|links are spread|link_equity_sink
models|llms.txt present|missing_llms_txt
models|llms-full.txt present|missing_llms_full_txt
models|ai.txt present|missing_ai_txt
models|IndexNow|missing_indexnow
models|crawlers of models allowed|ai_crawler_blocked
answers|answer first|geo_answer_first
answers|questions as headings|geo_structured_format
answers|facts|geo_fact_density
answers|short passages|geo_paragraph_length
answers|the brand is an entity|geo_entity_clarity
answers|dates|geo_freshness_signals"""
_BY_TOTAL = [
    ("basics", "title present", "missing_title", "bool_or(title IS NOT NULL)", "arg_min(length(title), ord) FILTER (title IS NOT NULL) || ' characters'"), ("basics", "titles of good length", "long_title", "bool_or(title IS NOT NULL) AND bool_and(title IS NULL OR length(title) BETWEEN 20 AND 65)", "count(title) || ' pages'"),
    ("basics", "description present", "missing_meta_description", "bool_or(meta_description IS NOT NULL)", "arg_min(length(meta_description), ord) FILTER (meta_description IS NOT NULL) || ' characters'"), ("basics", "descriptions of good length", "long_meta_description", "bool_or(meta_description IS NOT NULL) AND bool_and(meta_description IS NULL OR length(meta_description) BETWEEN 80 AND 165)", "count(meta_description) || ' pages'"),
    ("basics", "main heading present", "missing_h1", "bool_or(len(h1) > 0)", "''"), ("basics", "one main heading a page", "multiple_h1", "bool_or(len(h1) > 0) AND bool_and(len(h1) <= 1)", "''"), ("basics", "viewport set", "missing_viewport", "bool_or(r % 4 <> 1)", "''"), ("basics", "language set", "missing_html_lang", "count(lang) > 0", "arg_min(lang, ord) FILTER (lang IS NOT NULL)"),
    ("basics", "pages may be indexed", "noindex_detected", "bool_or(r % 11 <> 2)", "count(*) FILTER (r % 11 <> 2) || ' of ' || count(*) || ' pages'"), ("technical", "https everywhere", "no_https", "bool_and(url LIKE 'https%')", "''"), ("technical", "strict transport security", "", "arg_min(r % 4, ord) > 0", "''"), ("technical", "security headers", "missing_security_headers", "arg_min(r % 4, ord) = 3", "''"),
    ("technical", "canonicals set", "canonical_missing", "count(canonical) > 0", "count(canonical) || ' of ' || count(*) || ' pages'"), ("technical", "fast responses", "slow_response", "max(fetch_ms) <= 3000", "sum(fetch_ms) // count(*) || ' ms'"), ("technical", "no server errors", "5xx_cluster", "site NOT IN (SELECT site FROM p WHERE status_code >= 500)", "''"),
    ("content", "enough text", "thin_content", "max(word_count) >= 300", "count(*) FILTER (word_count >= 300) || ' pages'"), ("content", "no thin pages", "", "bool_and(word_count = 0 OR word_count >= 300)", "''"), ("structure", "structured data", "", "count(kind) > 0", "count(kind) || ' pages'"), ("structure", "structured data is well formed", "schema_syntax_error", "count(kind) > 0", "''"),
    ("structure", "breadcrumbs", "", "bool_or(r % 9 = 5)", "''"), ("structure", "canonicals lead to good pages", "canonical_points_to_error", "count(canonical) > 0", "''"), ("social", "open graph title", "missing_og_title", "arg_min(r % 3, ord) = 0", "''"), ("social", "open graph image", "missing_og_image", "arg_min(r % 4, ord) = 0", "''"), ("social", "twitter card", "missing_twitter_card", "arg_min(r % 5, ord) = 2", "''"),
    ("performance", "excellent load time", "", "avg(fetch_ms) < 1000", "sum(fetch_ms) // count(*) || ' ms'"), ("performance", "good load time", "", "avg(fetch_ms) >= 1000 AND avg(fetch_ms) < 2000", "sum(fetch_ms) // count(*) || ' ms'"), ("performance", "all images have a text", "images_without_alt", "sum(images) > 0 AND sum(bare_images) = 0", "''"), ("performance", "images with a text", "", "sum(bare_images) > 0", "sum(images - bare_images) || ' of ' || sum(images)"),
    ("performance", "images", "", "sum(images) > 0", "sum(images) || ' images on ' || count(*) || ' pages'"),
]
_PASSED = (
    "found AS (SELECT DISTINCT site, type FROM all_issues), ok_sites AS (SELECT DISTINCT site FROM p WHERE status_code = 200), "
    + "by_issue AS (SELECT * FROM (VALUES "
    + ", ".join("({})".format(", ".join(f"'{x}'" for x in line.split("|"))) for line in _BY_ISSUE.split("\n"))
    + ") AS v(grp, chk, type)), done AS (SELECT site, grp, chk, '' AS value FROM ok_sites, by_issue WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.site = ok_sites.site AND f.type = by_issue.type)"
    + " UNION ALL SELECT site, 'models', 'llms.txt well formed', '' FROM ok_sites WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.site = ok_sites.site AND f.type IN ('missing_llms_txt', 'invalid_llms_syntax')) UNION ALL SELECT site, 'models', 'llms.txt has links', '' FROM ok_sites WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.site = ok_sites.site AND f.type IN ('missing_llms_txt', 'llms_no_links'))"
    + "".join(f" UNION ALL SELECT site, '{g}', '{c}', {v} FROM p WHERE status_code = 200 AND site NOT IN (SELECT site FROM found WHERE type = '{t}') GROUP BY site HAVING {w}" for g, c, t, w, v in _BY_TOTAL)
    + ")"
)
_HOURS = "CASE WHEN type IN ('missing_title', 'short_title', 'long_title', 'missing_meta_description', 'short_meta_description', 'long_meta_description', 'missing_viewport', 'missing_html_lang', 'noindex_detected', 'missing_og_title', 'missing_twitter_card') THEN 0.25 WHEN type IN ('missing_h1', 'multiple_h1', 'missing_canonical', 'images_without_alt') THEN 0.5 WHEN type IN ('missing_og_image', 'missing_security_headers') THEN 1 WHEN type IN ('missing_organization_schema', 'no_jsonld') THEN 1.5 WHEN type = 'no_https' THEN 4 WHEN type = 'slow_response' THEN 8 ELSE 2 END::DOUBLE"
_POINTS = "CASE type WHEN 'noindex_detected' THEN 100 WHEN 'no_https' THEN 90 WHEN 'missing_title' THEN 80 WHEN 'missing_meta_description' THEN 70 WHEN 'slow_response' THEN 70 WHEN 'missing_organization_schema' THEN 50 WHEN 'missing_h1' THEN 40 WHEN 'missing_og_image' THEN 40 WHEN 'missing_security_headers' THEN 35 WHEN 'images_without_alt' THEN 25 ELSE 30 END"

_PATCH = lambda pattern, tag: f"CASE WHEN regexp_matches(html, '(?is){pattern}') THEN regexp_replace(html, '(?is){pattern}', {tag}) ELSE regexp_replace(html, '(?i)</head>', '  ' || {tag} || chr(10) || '  </head>') END"

ORACLE_SQL = {
    "corpus_schema_blocks": f"WITH {P} SELECT url, kind AS schema_type, r % 9 NOT IN (6, 7) AS is_valid, CASE r % 9 WHEN 7 THEN 'author,datePublished' ELSE '' END AS missing, CASE r % 9 WHEN 1 THEN 'logo,url' WHEN 2 THEN 'brand,description,image,sku' WHEN 3 THEN 'dateModified,image,publisher' WHEN 7 THEN 'dateModified,image,publisher' ELSE '' END AS helpful, CASE r % 9 WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END::BIGINT AS n_errors FROM p WHERE block IS NOT NULL",
    "corpus_snapshots": f"WITH {P} SELECT url, 'plain' AS rendered_via, CASE r % 4 WHEN 0 THEN '' WHEN 1 THEN 'strict-transport-security' WHEN 2 THEN 'strict-transport-security,x-content-type-options' ELSE 'strict-transport-security,x-content-type-options,x-frame-options' END AS headers, len(list_distinct(list_transform(internal, lambda u: regexp_replace(u, '#.*$', ''))))::BIGINT AS links, CASE WHEN n_h2 > 0 THEN CASE WHEN asks THEN 'What is it' ELSE 'Part 1' END ELSE '' END || CASE WHEN n_h2 > 1 THEN '|Part 2' ELSE '' END || CASE WHEN n_h2 > 2 THEN '|Part 3' ELSE '' END AS h2, ((og_title IS NOT NULL)::INT + (og_image IS NOT NULL)::INT)::BIGINT AS og FROM p",
    "corpus_cluster_metrics": f"WITH {P}, {CLUSTERS} SELECT cluster_id, CASE WHEN cluster_id LIKE '%/blog' THEN 'Blog' WHEN cluster_id LIKE '%/shop' THEN 'Shop' ELSE 'De' END AS topic, pillar, (SELECT count(*) FROM km WHERE km.cluster_id = kc.cluster_id) AS pages, (SELECT least(100, 5 * sum(il)) FROM km WHERE km.cluster_id = kc.cluster_id)::BIGINT AS authority, twice AS cannibalised FROM kc",
    "corpus_heads": f"""WITH {P}, t AS (SELECT ord, html, block, '<meta name="description" content="' || replace(replace(replace(replace(left('D & <' || r || '> "new" ' || repeat('long ', 40), 160), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') || '" />' AS d, '<link rel="canonical" href="' || far_url || '" />' AS c, '<meta property="og:image" content="' || origin || '/og.webp" />' AS i,
      '<script type="application/ld+json">' || chr(10) || '{{"@type": "Organization", "name": "N"}}' || chr(10) || '</script>' AS b FROM p)
      SELECT ord, md5({_PATCH('<meta\\s+name="description"[^>]*/?>', 'd')}) AS description, md5({_PATCH('<link\\s+rel="canonical"[^>]*/?>', 'c')}) AS canonical, md5({_PATCH('<meta\\s+property="og:image"[^>]*/?>', 'i')}) AS image, md5(CASE WHEN block LIKE '%"@type":"Organization"%' THEN html ELSE regexp_replace(html, '(?i)</head>', '  ' || b || chr(10) || '  </head>') END) AS block FROM t""",
    "corpus_simple_scores": f"{_R}{ALL_ISSUES} SELECT site, greatest(0, 100 - 10 * count(*) FILTER (severity = 'high') - 3 * count(*) FILTER (severity = 'medium'))::BIGINT AS score FROM all_issues GROUP BY site",
    "corpus_pages": f"WITH {P} SELECT ord, site, url, title, meta_description, viewport, robots_meta, canonical, og_title, og_image, twitter_card, images::BIGINT AS images_total, bare_images::BIGINT AS images_without_alt, n_h2::BIGINT AS n_h2, CASE WHEN n_h2 > 0 THEN CASE WHEN asks THEN 'What is it' ELSE 'Part 1' END END AS first_h2, coalesce(kind, '') AS types, (block IS NOT NULL)::BIGINT AS blocks, CASE WHEN r % 7 = 0 THEN 2 ELSE 0 END::BIGINT AS languages, security::BIGINT AS security, word_count::BIGINT AS word_count, len(internal)::BIGINT AS internal_links, (r % 3)::BIGINT AS external_links, md5(html) AS html FROM p",
    "corpus_page_rules": f"WITH {PAGE_ISSUES} SELECT ord, type, category, severity FROM page_issues",
    "corpus_answer_scores": f"WITH {PAGE_ISSUES}, {ROBOTS}, {ANSWERS} SELECT ord, score FROM answers",
    "corpus_answer_averages": f"WITH {PAGE_ISSUES}, {ROBOTS}, {ANSWERS} SELECT site AS host, count(*) AS pages, printf('%.1f', avg(score))::DOUBLE AS average FROM answers GROUP BY site",
    "corpus_canonical_rules": f"WITH {P}, {CANON} SELECT * FROM canonical_issues",
    "corpus_canonical_signals": f"WITH {P}, {CANON} SELECT url, canonical, CASE WHEN NOT own THEN 'html' WHEN listed THEN 'sitemap' ELSE 'self' END AS signal, listed FROM cs",
    "corpus_redirect_rules": f"{_R}{P}, {REDIRECTS} SELECT * FROM redirect_issues",
    "corpus_link_rules": f"{_R}{P}, {LINKS} SELECT * FROM link_issues",
    "corpus_robots": f"WITH {P}, {ROBOTS} SELECT * FROM rf",
    "corpus_robots_rules": f"WITH {P}, {ROBOTS} SELECT * FROM robots_issues",
    "corpus_sitemap_rules": f"WITH {P}, {CANON}, {SITEMAPS} SELECT * FROM sitemap_issues",
    "corpus_schema_rules": f"WITH {P}, {SCHEMAS} SELECT * FROM schema_issues",
    "corpus_trust_rules": f"WITH {P}, {TRUST} SELECT * FROM trust_issues",
    "corpus_file_rules": f"WITH {P}, {FILES} SELECT * FROM file_issues",
    "corpus_cluster_rules": f"WITH {P}, {CLUSTERS} SELECT * FROM cluster_issues",
    "corpus_gap_rules": f"WITH {P}, {CLUSTERS} SELECT * FROM gap_issues",
    "corpus_duplicate_rules": f"WITH {P}, {CANON}, {CLUSTERS}, {DUPLICATES} SELECT * FROM duplicate_issues",
    "corpus_issues": f"{_R}{ALL_ISSUES} SELECT site, source, type, category, severity, count(*) AS n FROM all_issues GROUP BY ALL",
    "corpus_severities": f"{_R}{ALL_ISSUES} SELECT site, severity, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT site, unnest(['high', 'medium', 'low']) AS severity FROM all_issues) FULL JOIN (SELECT site, severity, count(*) AS n FROM all_issues GROUP BY ALL) USING (site, severity)",
    "corpus_categories": f"{_R}{ALL_ISSUES} SELECT category, count(*) AS n FROM all_issues GROUP BY ALL",
    "corpus_scores": f"{_R}{ALL_ISSUES}, n AS (SELECT site, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM all_issues GROUP BY site) SELECT *, greatest(0, 100 - least(50, 3 * high) - least(30, medium) - least(20, 0.3 * low))::DECIMAL(18,1)::DOUBLE AS score FROM n",
    "corpus_passed": f"{_R}{ALL_ISSUES}, {_PASSED} SELECT site, grp AS \"group\", chk AS \"check\", value FROM done",
    "corpus_actions": f"{_R}{ALL_ISSUES}, a AS (SELECT DISTINCT site, type, severity, {_HOURS} AS hours, {_POINTS} * CASE severity WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.6 ELSE 1 END::DOUBLE AS points FROM all_issues), b AS (SELECT *, CASE WHEN severity = 'high' OR (severity <> 'low' AND points >= 60) THEN 'high' WHEN (severity = 'low' AND points < 35) OR (severity <> 'low' AND hours > 1 AND points < 35) THEN 'low' ELSE 'medium' END AS priority, round(points / hours, 1) AS roi FROM a) SELECT site, type, severity, priority, roi FROM b ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, roi DESC, site, type, severity LIMIT 10",
    "corpus_metrics": f"WITH {P} SELECT site, count(*) AS pages_crawled, count(*) FILTER (status_code = 200) AS pages_ok, count(*) FILTER (status_code <> 200) AS pages_failed, sum(images) FILTER (status_code = 200)::BIGINT AS total_images, sum(bare_images) FILTER (status_code = 200)::BIGINT AS images_without_alt, (sum(fetch_ms) FILTER (status_code = 200) // count(*) FILTER (status_code = 200))::BIGINT AS avg_response_ms, (SELECT count(*) FROM m WHERE m.domain = p.site) AS pages_discovered FROM p GROUP BY site",
}
