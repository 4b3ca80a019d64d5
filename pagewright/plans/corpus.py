"""A corpus of sites made of the table ``pages``: every fifty pages are a site, with paths, heads, links, statuses, site files and
redirects that vary by page, so that every rule meets pages on which it fires and pages on which it does not.

The making is input, not result: it is SQL text that both engines run. What the engine finds in the made HTML is held against
the values that went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

PER_SITE = 50
_SITE = "CAST(floor(page_id / 50) AS BIGINT)"


def path_sql(r: str) -> str:
    return (
        f"CASE WHEN {r} = 0 THEN '/' WHEN {r} = 1 AND h % 2 = 0 THEN '/impressum' WHEN {r} = 2 AND h % 3 <> 1 THEN '/privacy' WHEN {r} = 3 AND h % 2 = 0 THEN '/kontakt' WHEN {r} = 4 AND h % 5 <> 2 THEN '/about-us'"
        f" WHEN {r} BETWEEN 5 AND 14 THEN concat('/blog/post-', {r}) WHEN {r} BETWEEN 15 AND 24 THEN concat('/shop/items/', {r}) WHEN {r} BETWEEN 25 AND 29 THEN concat('/', {r}) ELSE concat('/de/', {r}, '?x=1') END"
    )


def url_sql(r: str) -> str:
    return f"concat(origin, {path_sql(r)})"


#: Columns of the made pages, in order of need; each is SQL that Spark and DuckDB share.
STEPS = [
    {"h": _SITE, "r": "page_id % 50"},
    {"site": "concat('s', h, '.example')", "origin": "concat(CASE WHEN h % 4 = 3 THEN 'http://s' ELSE 'https://s' END, h, '.example')"},
    {"url": url_sql("r"), "next_url": url_sql("(r + 1) % 50"), "far_url": url_sql("(r * 7 + 3) % 50"), "next_path": path_sql("(r + 1) % 50"), "far_path": path_sql("(r * 7 + 3) % 50"), "onward_url": url_sql("(r + 2) % 50")},
    {
        "status_code": "CAST(CASE WHEN r BETWEEN 40 AND 43 THEN 301 WHEN r = 20 THEN 302 WHEN r = 30 THEN 301 WHEN r = 33 AND h % 2 = 0 THEN 404 WHEN r IN (26, 36, 46) AND h % 2 = 1 THEN 503 ELSE 200 END AS INT)",
        "error": "CASE WHEN r = 47 THEN 'timeout' END",
        "fetch_ms": "CAST((page_id * 37) % 4000 AS INT)",
        "location": "CASE WHEN r = 40 THEN next_url WHEN r = 41 THEN " + url_sql("40") + " WHEN r IN (42, 43) THEN next_url WHEN r = 20 THEN 'https://other.example/' WHEN r = 30 THEN '/relative' END",
        "meta_description": "CASE r % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Short one' WHEN 2 THEN concat(repeat('long words ', 19), 'end') WHEN 3 THEN concat(repeat('fitting ', 13), '2024') ELSE concat(repeat('fitting ', 13), 'end') END",
        "viewport": "CASE WHEN r % 4 <> 1 THEN 'width=device-width' END",
        "robots_meta": "CASE WHEN r % 11 = 2 THEN 'noindex, follow' WHEN r % 11 = 3 THEN 'index' END",
        "canonical": "CASE WHEN r % 5 = 0 THEN url WHEN r % 5 = 2 THEN next_url WHEN r % 10 = 3 THEN onward_url WHEN r % 5 = 3 THEN url WHEN r % 10 = 4 THEN far_url END",
        "og_title": "CASE WHEN r % 3 = 0 THEN 'Open title' END", "og_image": "CASE WHEN r % 4 = 0 THEN 'https://img.example/i.png' END", "twitter_card": "CASE WHEN r % 5 = 2 THEN 'summary' END",
        "images": "CAST(r % 6 AS INT)", "bare_images": "CAST(CASE WHEN r % 6 < r % 5 THEN r % 6 ELSE r % 5 END AS INT)",
        "headings": "CAST(r % 4 AS INT)", "asks": "r % 8 = 1",
        "block": "CASE r % 9 WHEN 1 THEN '{\"@type\":\"Organization\",\"name\":\"A\",\"sameAs\":[\"https://www.linkedin.com/a\",\"https://x.com/a\"]}' WHEN 2 THEN '{\"@type\":\"Product\",\"name\":\"P\",\"offers\":{\"priceCurrency\":\"EUR\"}}'"
        " WHEN 3 THEN '{\"@type\":\"Article\",\"headline\":\"H\",\"author\":\"A\",\"datePublished\":\"2024-01-01\"}' WHEN 4 THEN '{\"@type\":\"FAQPage\",\"mainEntity\":[{\"@type\":\"Question\",\"name\":\"Q\",\"acceptedAnswer\":{\"text\":\"T\"}},{\"@type\":\"Answer\"}]}'"
        " WHEN 5 THEN '{\"@type\":\"BreadcrumbList\",\"itemListElement\":[{\"position\":1},{\"name\":\"x\"}]}' WHEN 6 THEN '{\"name\":\"untyped\"}' WHEN 7 THEN '{\"@type\":\"Article\",\"headline\":\"H\"}' WHEN 8 THEN '{\"@type\":\"WebSite\",\"url\":\"u\"}' END",
        "filler": "CAST(CASE r % 3 WHEN 0 THEN 0 WHEN 1 THEN 120 ELSE 600 END AS INT)",
        "header_names": "CASE r % 4 WHEN 0 THEN '' WHEN 1 THEN 'Strict-Transport-Security' WHEN 2 THEN 'Strict-Transport-Security,X-Content-Type-Options,Server' ELSE 'strict-transport-security,x-content-type-options,X-Frame-Options' END",
    },
    {
        "head": "concat(CASE WHEN meta_description IS NULL THEN '' ELSE concat('<meta name=\"description\" content=\"', meta_description, '\">') END, CASE WHEN viewport IS NULL THEN '' ELSE concat('<meta content=\"', viewport, '\" name=\"viewport\">') END,"
        " CASE WHEN robots_meta IS NULL THEN '' ELSE concat('<META NAME=\"robots\" CONTENT=\"', robots_meta, '\">') END, CASE WHEN canonical IS NULL THEN '' ELSE concat('<link rel=\"canonical\" href=\"', canonical, '\">') END,"
        " CASE WHEN og_title IS NULL THEN '' ELSE concat('<meta property=\"og:title\" content=\"', og_title, '\">') END, CASE WHEN og_image IS NULL THEN '' ELSE concat('<meta property=\"og:image\" content=\"', og_image, '\">') END,"
        " CASE WHEN twitter_card IS NULL THEN '' ELSE concat('<meta name=\"twitter:card\" content=\"', twitter_card, '\">') END, CASE WHEN r % 7 <> 0 THEN '' ELSE concat('<link rel=\"alternate\" hreflang=\"de\" href=\"', url, '\"><link rel=\"alternate\" hreflang=\"en\" href=\"', far_url, '\">') END,"
        " CASE WHEN block IS NULL THEN '' ELSE concat('<script type=\"application/ld+json\">', block, '</script>') END)",
        "body": "concat(CASE WHEN headings > 0 THEN CASE WHEN asks THEN '<h2>What is it</h2>' ELSE '<h2>Part 1</h2>' END ELSE '' END, CASE WHEN headings > 1 THEN '<h2>Part 2</h2>' ELSE '' END, CASE WHEN headings > 2 THEN '<h2>Part 3</h2>' ELSE '' END,"
        " CASE WHEN r % 10 <> 9 THEN concat('<a href=\"', next_path, '\">on</a>') ELSE '' END, CASE WHEN r % 4 = 0 THEN concat('<a href=\"', far_path, '#part\">far</a>') ELSE '' END, repeat('<a href=\"https://other.example/x\">out</a>', CAST(r % 3 AS INT)), '<a href=\"#top\">top</a><a href=\"mailto:a@b.example\">post</a>',"
        " repeat('<img src=\"/i.png\">', bare_images), repeat('<img src=\"/j.png\" alt=\"J\">', images - bare_images), '<p>', repeat('filler ', filler), '</p>')",
    },
    {"html": "replace(replace(html, '</head>', concat(head, '</head>')), '<article>', concat('<article>', body))"},
]

#: One row a site: its files. Fixed values of this corpus.
SITE_FILES = {
    "robots_status": "CAST(CASE WHEN h % 6 = 5 THEN 404 ELSE 200 END AS INT)",
    "robots": "CASE h % 6 WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /private # keep out', chr(10), 'User-agent: GPTBot', chr(10), 'Disallow: /', chr(10), 'Disallow: /static/', chr(10), 'Sitemap: https://x.example/sitemap.xml')"
    " WHEN 1 THEN concat('Disallow: /', chr(10), 'User-agent: CCBot', chr(10), 'Disallow:', chr(10), '# Disallow: /', chr(10), 'User-agent: claudebot', chr(10), ' disallow: / ') WHEN 2 THEN concat('User-agent: FacebookBot', chr(10), 'Disallow: /')"
    " WHEN 3 THEN concat('User-Agent: *', chr(10), 'Allow: /', chr(10), 'SITEMAP: x') WHEN 4 THEN concat('User-agent: Bytespider # x', chr(10), 'Disallow: /', chr(10), 'Disallow: /assets/') END",
    "llms": "CASE h % 4 WHEN 0 THEN concat('# Site', chr(10), 'About it', chr(10), '- [Start](https://x.example/)') WHEN 1 THEN concat('no heading', chr(10), '- [A](u)') WHEN 2 THEN concat('# Bare', chr(10), 'text') END",
    "sitemap_state": "CASE h % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'broken' ELSE 'read' END",
}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made pages before parsing, with every value that went in."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    for step in STEPS:
        d = d.selectExpr("*" if "html" not in step else "* EXCEPT (html)", *[f"{v} AS {k}" for k, v in step.items()])
    return d


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed pages of the made corpus: only url, html and what a crawl knows go in."""
    names = F.filter(F.split("header_names", ","), lambda x: x != "")
    headers = F.map_from_arrays(names, F.transform(names, lambda x: F.lit("1")))
    d = raw(spark, sf_dir).select(F.col("page_id").alias("ord"), "site", "url", "html", "status_code", "error", "fetch_ms", parse.security_headers(headers).alias("security_headers"))
    return parse.parse_pages(d)


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client sees at each URL of the corpus: url, status_code and location."""
    return raw(spark, sf_dir).select("url", "status_code", "location")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a site with its files."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(f"{_SITE} AS h").distinct()
    return d.selectExpr("h", "concat('s', h, '.example') AS site", *[f"{v} AS {k}" for k, v in SITE_FILES.items()])


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, loc, lastmod and pos of the entries of the sites' sitemaps."""
    d = raw(spark, sf_dir).filter("r % 5 <> 4 AND h % 5 NOT IN (1, 2)")
    return d.select(F.col("site").alias("domain"), F.when(F.col("r") == 45, F.concat("origin", F.lit("/gone"))).otherwise(F.col("url")).alias("loc"), F.expr(LASTMOD).alias("lastmod"), F.col("page_id").alias("pos"))


LASTMOD = "CASE WHEN h % 5 = 4 THEN '' WHEN r % 3 = 0 THEN '2020-01-01T00:00' WHEN r % 3 = 1 THEN '2025-06-01' ELSE '' END"


def with_sql() -> str:
    """The made pages as common table expressions for DuckDB: c holds them, s one row a site, m the sitemaps' entries."""
    ctes, last = [], "pages"
    for i, step in enumerate(STEPS):
        own = ", ".join(f"{v} AS {k}" for k, v in step.items())
        have = "page_id, html" if i == 0 else "* EXCLUDE (html)" if "html" in step else "*"
        ctes.append(f"c{i} AS (SELECT {have}, {own} FROM {last})")
        last = f"c{i}"
    files = ", ".join(f"{v} AS {k}" for k, v in SITE_FILES.items())
    return ",\n".join([
        *ctes, f"c AS (SELECT *, page_id AS ord FROM {last})",
        f"s AS (SELECT h, concat('s', h, '.example') AS site, {files} FROM (SELECT DISTINCT {_SITE} AS h FROM pages))",
        f"m AS (SELECT site AS domain, CASE WHEN r = 45 THEN concat(origin, '/gone') ELSE url END AS loc, {LASTMOD} AS lastmod, page_id AS pos FROM c WHERE r % 5 <> 4 AND h % 5 NOT IN (1, 2))",
    ])
