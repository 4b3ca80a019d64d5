"""Rules on sites, redirects, links and clusters: the same catalogue form as rules on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as ur
from .rules import Rule

# Names, severities and thresholds.
ROBOTS_RULES = [
    Rule("missing_robots_txt", "robots", "medium", "status_code <> 200"),
    Rule("ai_crawler_blocked", "robots", "high", "status_code = 200 AND blocked <> ''"),
    Rule("css_js_blocked", "robots", "high", "status_code = 200 AND assets_blocked"),
    Rule("missing_sitemap_directive", "robots", "medium", "status_code = 200 AND NOT sitemap_named"),
    Rule("wildcard_disallow", "robots", "critical", "status_code = 200 AND all_blocked"),
    Rule("geo_ai_crawler_blocked", "geo", "critical", "status_code = 200 AND answer_blocked <> ''"),
]
_READ = "found AND NOT parse_error AND NOT is_index AND urls > 0 AND "
SITEMAP_RULES = [
    Rule("missing_sitemap", "sitemap", "high", "NOT found"),
    Rule("sitemap_parse_error", "sitemap", "critical", "found AND parse_error"),
    Rule("empty_sitemap_index", "sitemap", "high", "found AND NOT parse_error AND is_index AND children = 0"),
    Rule("empty_sitemap", "sitemap", "high", "found AND NOT parse_error AND NOT is_index AND urls = 0"),
    Rule("sitemap_too_large", "sitemap", "medium", _READ + "urls > 50000"),
    Rule("sitemap_file_too_large", "sitemap", "medium", _READ + "bytes > 52428800"),
    Rule("sitemap_missing_pages", "sitemap", "medium", _READ + "missing > 0"),
    Rule("sitemap_stale_lastmod", "sitemap", "low", _READ + "stale > 0"),
    Rule("sitemap_no_lastmod", "sitemap", "medium", _READ + "undated = urls"),
    Rule("sitemap_non_canonical_urls", "sitemap", "high", _READ + "non_canonical > 0"),
    Rule("sitemap_many_broken_urls", "sitemap", "critical", _READ + "broken > 5"),
]
REDIRECT_RULES = [
    Rule("redirect_loop", "redirect", "critical", "is_loop"),
    Rule("redirect_chain", "redirect", "medium", "NOT is_loop AND hops > 1"),
    Rule("redirect_to_different_domain", "redirect", "high", "hops > 0 AND start_host <> final_host"),
]
LINK_RULES = [
    Rule("orphan_page", "link_graph", "medium", "in_degree = 0 AND NOT is_home AND status_code < 400"),
    Rule("deep_page", "link_graph", "low", "depth > 3"),
    Rule("unreachable_page", "link_graph", "high", "depth IS NULL AND status_code < 400"),
    Rule("link_equity_sink", "link_graph", "low", "in_degree >= 5 AND out_degree = 0 AND status_code < 400"),
]
CLUSTER_RULES = [
    Rule("weak_cluster_linking", "topical_authority", "medium", "linked < 0.5"),
    Rule("cluster_cannibalization", "topical_authority", "high", "cannibalised"),
]


def link_input(degrees: DataFrame, depth: DataFrame, homepage: str | None = None) -> DataFrame:
    """url, status_code, degrees, depth and is_home of crawled URLs and of all that can be reached. No homepage: URLs of depth 0 are home."""
    d = degrees.join(depth, "url", "full_outer")
    is_home = F.coalesce(F.col("depth") == 0, F.lit(False)) if homepage is None else F.col("url") == ur.graph_form(F.lit(homepage))
    return d.select("url", "status_code", "in_degree", "out_degree", "depth", is_home.alias("is_home"))


def redirect_input(chains: DataFrame) -> DataFrame:
    return chains.withColumns({"start_host": ur.netloc(F.col("start_url")), "final_host": ur.netloc(F.col("final_url"))})


def temporary_hops(hops: DataFrame, chains: DataFrame) -> DataFrame:
    """start_url and url of each hop with status 302 in a chain."""
    on_way = chains.select("start_url", F.explode("path").alias("url"))
    return on_way.join(hops.filter("status_code = 302").select("url").distinct(), "url").select("start_url", "url")


def links_to_redirects(pages: DataFrame, chains: DataFrame) -> DataFrame:
    """affected_url and target of links that go to a redirecting URL, compared as they are written."""
    links = pages.select(F.col("url").alias("affected_url"), F.explode("internal_link_urls").alias("target"))
    return links.join(chains.filter("hops > 0").select(F.col("start_url").alias("target")).distinct(), "target", "left_semi").select("affected_url", "target")


def server_errors(pages: DataFrame, site: str, least: int = 3, sample: int = 5) -> DataFrame:
    """site, n and the first URLs of sites with at least ``least`` server errors."""
    bad = pages.filter("status_code >= 500")
    first = bad.withColumn("_r", F.row_number().over(Window.partitionBy(site).orderBy("ord"))).filter(F.col("_r") <= sample)
    first = first.groupBy(site).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "url"))), lambda x: x["url"]).alias("urls"))
    return bad.groupBy(site).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(first, site)


def broken_entries(urls: DataFrame, crawl: DataFrame, k: int = 5, key: str | None = None) -> DataFrame:
    """domain, loc and status of the first k entries of each sitemap (by ``pos``) whose crawl ended above 299; entries meet crawls by
    URL, or by the column ``key`` of both, where each crawl of a URL has an entry of its own."""
    on = key or "loc"
    c = crawl.filter("status_code >= 300").groupBy(F.col(key or "url").alias(on)).agg(F.max("status_code").alias("status"))
    d = urls.join(c, on).withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy("pos")))
    return d.filter(F.col("_r") <= k).select("domain", "loc", "status")


def missing_entries(urls: DataFrame, crawl: DataFrame) -> DataFrame:
    """Good crawled URLs that no sitemap has."""
    return crawl.filter("status_code = 200").select(F.col("url").alias("loc")).distinct().join(urls.select("loc"), "loc", "left_anti")
