"""Checks that a site has passed: a table of checks over one row of totals a site, less those whose issues were found."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Check(NamedTuple):
    group: str
    check: str
    blocked_by: str  # an issue type that speaks against it, or nothing
    when: str  # on a site's totals
    value: str = "''"


ALWAYS = "true"
#: What is checked, by which issue it fails, what must hold, what is shown. Names of issues are those that rules emit.
CHECKS = [
    Check("basics", "title present", "missing_title", "titles > 0", "concat(first_title_length, ' characters')"),
    Check("basics", "titles of good length", "long_title", "titles > 0 AND long_titles = 0 AND short_titles = 0", "concat(titles, ' pages')"),
    Check("basics", "description present", "missing_meta_description", "descriptions > 0", "concat(first_description_length, ' characters')"),
    Check("basics", "descriptions of good length", "long_meta_description", "descriptions > 0 AND long_descriptions = 0 AND short_descriptions = 0", "concat(descriptions, ' pages')"),
    Check("basics", "main heading present", "missing_h1", "headings > 0"), Check("basics", "one main heading a page", "multiple_h1", "headings > 0 AND many_headings = 0"),
    Check("basics", "viewport set", "missing_viewport", "viewports > 0"), Check("basics", "language set", "missing_html_lang", "langs > 0", "first_lang"),
    Check("basics", "pages may be indexed", "noindex_detected", "indexable > 0", "concat(indexable, ' of ', ok_pages, ' pages')"),
    Check("technical", "https everywhere", "no_https", "https_pages = ok_pages"), Check("technical", "strict transport security", "", "hsts"),
    Check("technical", "security headers", "missing_security_headers", "frame_and_type"), Check("technical", "canonicals set", "canonical_missing", "canonicals > 0", "concat(canonicals, ' of ', ok_pages, ' pages')"),
    Check("technical", "robots.txt present", "missing_robots_txt", ALWAYS), Check("technical", "sitemap present", "missing_sitemap", ALWAYS), Check("technical", "no redirect chains", "redirect_chain", ALWAYS),
    Check("technical", "no redirect loops", "redirect_loop", ALWAYS), Check("technical", "fast responses", "slow_response", "slow_pages = 0", "concat(avg_ms, ' ms')"), Check("technical", "no soft 404", "soft_404", ALWAYS),
    Check("technical", "no server errors", "5xx_cluster", "server_errors = 0"), Check("technical", "styles and scripts may be crawled", "css_js_blocked", ALWAYS), Check("technical", "crawling is not shut off", "wildcard_disallow", ALWAYS),
    Check("content", "enough text", "thin_content", "long_texts > 0", "concat(long_texts, ' pages')"), Check("content", "no thin pages", "", "thin_pages = 0"),
    Check("content", "no duplicates", "near_duplicate_content", ALWAYS), Check("content", "no competing headings", "keyword_cannibalization", ALWAYS), Check("content", "topic clusters", "no_topic_clusters_detected", ALWAYS),
    Check("content", "legal notice", "missing_impressum", ALWAYS), Check("content", "privacy page", "missing_datenschutz", ALWAYS), Check("content", "contact page", "missing_contact_page", ALWAYS),
    Check("content", "about page", "missing_about_page", ALWAYS), Check("content", "organisation described", "missing_org_schema", ALWAYS), Check("content", "trust score", "eeat_score_low", ALWAYS),
    Check("structure", "structured data", "", "schema_pages > 0", "concat(schema_pages, ' pages')"), Check("structure", "structured data is well formed", "schema_syntax_error", "schema_pages > 0"),
    Check("structure", "breadcrumbs", "", "breadcrumbs > 0"), Check("structure", "no canonical chains", "canonical_chain", ALWAYS), Check("structure", "canonicals agree with the sitemap", "canonical_conflicts_sitemap", ALWAYS),
    Check("structure", "canonicals lead to good pages", "canonical_points_to_error", "canonicals > 0"), Check("structure", "no orphans", "orphan_page", ALWAYS), Check("structure", "three clicks at most", "deep_page", ALWAYS),
    Check("structure", "no broken links", "broken_internal_link", ALWAYS), Check("structure", "links are spread", "link_equity_sink", ALWAYS),
    Check("social", "open graph title", "missing_og_title", "og_title"), Check("social", "open graph description", "", "og_description"), Check("social", "open graph image", "missing_og_image", "og_image"),
    Check("social", "open graph address", "", "og_url"), Check("social", "twitter card", "missing_twitter_card", "twitter_card"), Check("social", "twitter image", "", "twitter_image"),
    Check("performance", "excellent load time", "", "avg_ms < 1000", "concat(avg_ms, ' ms')"), Check("performance", "good load time", "", "avg_ms >= 1000 AND avg_ms < 2000", "concat(avg_ms, ' ms')"),
    Check("performance", "all images have a text", "images_without_alt", "images > 0 AND bare_images = 0"), Check("performance", "images with a text", "", "images > 0 AND bare_images > 0", "concat(images - bare_images, ' of ', images)"),
    Check("performance", "images", "", "images > 0", "concat(images, ' images on ', ok_pages, ' pages')"),
    Check("models", "llms.txt present", "missing_llms_txt", ALWAYS), Check("models", "llms.txt well formed", "invalid_llms_syntax", "NOT array_contains(found, 'missing_llms_txt')"), Check("models", "llms.txt has links", "llms_no_links", "NOT array_contains(found, 'missing_llms_txt')"),
    Check("models", "llms-full.txt present", "missing_llms_full_txt", ALWAYS), Check("models", "ai.txt present", "missing_ai_txt", ALWAYS), Check("models", "IndexNow", "missing_indexnow", ALWAYS), Check("models", "crawlers of models allowed", "ai_crawler_blocked", ALWAYS),
    Check("answers", "answer first", "geo_answer_first", ALWAYS), Check("answers", "questions as headings", "geo_structured_format", ALWAYS), Check("answers", "facts", "geo_fact_density", ALWAYS),
    Check("answers", "short passages", "geo_paragraph_length", ALWAYS), Check("answers", "the brand is an entity", "geo_entity_clarity", ALWAYS), Check("answers", "dates", "geo_freshness_signals", ALWAYS),
]
SLOW_MS, THIN_WORDS = 3000, 300


def totals(pages: DataFrame, site: str) -> DataFrame:
    """One row for each site that has a good page: what the checks look at. ``first`` values are those of its first good page."""
    good = F.col("status_code") == 200
    n = lambda c: F.count_if(good & F.coalesce(c, F.lit(False)))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    first = lambda c, when: F.min_by(c, F.when(good & when, F.col("ord")))
    title, text = F.col("title"), F.col("meta_description")
    tag = lambda tags, name: F.coalesce(first(F.coalesce(F.col(tags)[name], F.lit("")) != "", F.lit(True)), F.lit(False))
    header = lambda *names: F.coalesce(first(F.size(F.array_intersect(F.map_keys("security_headers"), F.array(*map(F.lit, names)))) == len(names), F.lit(True)), F.lit(False))
    words = F.col("word_count")
    return pages.groupBy(F.col(site).alias("site")).agg(
        n(F.lit(True)).alias("ok_pages"), n(length(title) > 0).alias("titles"), n(length(title) > 65).alias("long_titles"), n(length(title).between(1, 19)).alias("short_titles"), first(F.length(title), title != "").alias("first_title_length"),
        n(length(text) > 0).alias("descriptions"), n(length(text) > 165).alias("long_descriptions"), n(length(text).between(1, 79)).alias("short_descriptions"), first(F.length(text), text != "").alias("first_description_length"),
        n(F.size("h1") > 0).alias("headings"), n(F.size("h1") > 1).alias("many_headings"), n(length(F.col("viewport")) > 0).alias("viewports"), n(length(F.col("lang")) > 0).alias("langs"), first(F.col("lang"), F.col("lang") != "").alias("first_lang"),
        n(~F.contains(F.lower(F.coalesce("robots_meta", F.lit(""))), F.lit("noindex"))).alias("indexable"), n(F.col("https")).alias("https_pages"), header("strict-transport-security").alias("hsts"), header("x-frame-options", "x-content-type-options").alias("frame_and_type"),
        n(length(F.col("canonical")) > 0).alias("canonicals"), n(F.col("fetch_ms") > SLOW_MS).alias("slow_pages"), F.floor(F.sum(F.when(good, F.col("fetch_ms"))) / F.greatest(n(F.lit(True)), F.lit(1))).alias("avg_ms"),
        F.count_if(F.col("status_code").between(500, 599)).alias("server_errors"), n(words >= THIN_WORDS).alias("long_texts"), n((words > 0) & (words < THIN_WORDS)).alias("thin_pages"),
        n(F.size("schema_types") > 0).alias("schema_pages"), n(F.array_contains("schema_types", "BreadcrumbList")).alias("breadcrumbs"),
        tag("og_tags", "og:title").alias("og_title"), tag("og_tags", "og:description").alias("og_description"), tag("og_tags", "og:image").alias("og_image"), tag("og_tags", "og:url").alias("og_url"),
        tag("twitter_tags", "twitter:card").alias("twitter_card"), tag("twitter_tags", "twitter:image").alias("twitter_image"),
        F.coalesce(F.sum(F.when(good, F.col("images_total"))), F.lit(0)).alias("images"), F.coalesce(F.sum(F.when(good, F.col("images_without_alt"))), F.lit(0)).alias("bare_images"),
    ).filter("ok_pages > 0")


def passed(pages: DataFrame, issues: DataFrame, site: str = "site") -> DataFrame:
    """site, group, check and value of all checks passed: one aggregation of pages, one of issue types, one explode."""
    types = issues.groupBy(F.col("site")).agg(F.collect_set("type").alias("found"))  # as many as there are types
    t = totals(pages, site).join(types, "site", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    made = [
        F.when(F.expr(c.when) & (~F.array_contains("found", c.blocked_by) if c.blocked_by else F.lit(True)), F.struct(F.lit(c.group).alias("group"), F.lit(c.check).alias("check"), F.expr(c.value).cast("string").alias("value")))
        for c in CHECKS
    ]
    return t.select("site", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c")).select("site", "c.*")
