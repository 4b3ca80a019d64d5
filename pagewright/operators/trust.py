"""A site's trust signals and score, and its text files for language models. Expressions and one partial aggregation by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule, evaluate
from .structured import as_list, block_type, field, filled

#: What the URL of a legal, contact or about page contains, article types, profile hosts, weights.
PAGE_WORDS = {
    "impressum": ("impressum", "imprint", "legal-notice", "legal_notice"),
    "datenschutz": ("datenschutz", "privacy", "privacy-policy", "data-protection", "datenschutzerklaerung", "datenschutzerklärung"),
    "contact_page": ("kontakt", "contact", "contact-us", "kontaktformular", "get-in-touch", "anfrage"),
    "about_page": ("about", "ueber-uns", "über-uns", "about-us", "team"),
}
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "Report")
PROFILES = {
    "linkedin": ("linkedin.com",), "wikidata": ("wikidata.org",), "wikipedia": ("wikipedia.org",), "github": ("github.com",),
    "crunchbase": ("crunchbase.com",), "x": ("twitter.com", "x.com"), "facebook": ("facebook.com",), "youtube": ("youtube.com",),
}
WEIGHTS = {"impressum": 15, "datenschutz": 15, "contact_page": 10, "org_schema": 10, "author_schema": 15, "date_published": 10, "date_modified": 5, "about_page": 5, "https": 5}
PROFILE_WEIGHT = 10

#: On a site's signals.
SITE_RULES = [
    Rule("missing_impressum", "eeat", "high", "NOT impressum"),
    Rule("missing_datenschutz", "eeat", "high", "NOT datenschutz"),
    Rule("missing_contact_page", "eeat", "medium", "NOT contact_page"),
    Rule("missing_about_page", "eeat", "low", "NOT about_page"),
    Rule("missing_org_schema", "eeat", "high", "NOT org_schema"),
    Rule("org_schema_no_sameas", "eeat", "medium", "org_schema AND n_profiles = 0"),
    Rule("articles_missing_author", "eeat", "high", "NOT author_schema"),
    Rule("articles_missing_date_published", "eeat", "medium", "NOT date_published"),
    Rule("articles_missing_date_modified", "eeat", "low", "NOT date_modified"),
    Rule("eeat_score_critical", "eeat", "critical", "score < 30"),
    Rule("eeat_score_low", "eeat", "high", "score >= 30 AND score < 60"),
]


def _contains(c: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return F.coalesce(out, F.lit(False))


def trust_signals(pages: DataFrame, site: str = "site") -> DataFrame:
    """A row of signals and the score (0 to 100) for each site of ``pages(site, url, https, schema_types, schema_data)``.

    A site without articles has their three signals; null lists count as empty, a null https as false.
    """
    none = F.array().cast("array<string>")
    blocks, types = F.coalesce("schema_data", none), F.coalesce("schema_types", none)
    path = F.substring_index(F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), "/+$", ""), "?", 1)
    of = lambda b, *names: F.coalesce(block_type(b).isin(*names), F.lit(False))
    orgs = F.filter(blocks, lambda b: of(b, "Organization", "Corporation"))
    links = F.lower(F.array_join(F.flatten(F.transform(orgs, lambda b: as_list(field(b, "sameAs")))), "\n"))
    is_article = F.arrays_overlap(types, F.array(*map(F.lit, ARTICLES)))
    with_field = lambda name: is_article & F.exists(blocks, lambda b: of(b, *ARTICLES) & filled(field(b, name)))
    page = pages.select(
        site, F.coalesce("https", F.lit(False)).alias("https"), (F.size(orgs) > 0).alias("org_schema"), is_article.alias("_article"),
        with_field("author").alias("_author"), with_field("datePublished").alias("_published"), with_field("dateModified").alias("_modified"),
        *[_contains(path, words).alias(name) for name, words in PAGE_WORDS.items()], *[_contains(links, hosts).alias("_at_" + name) for name, hosts in PROFILES.items()],
    )
    some = lambda c: F.bool_or(c)
    article = lambda c: (F.count_if("_article") == 0) | some(c)
    out = page.groupBy(site).agg(
        *[some(name).alias(name) for name in (*PAGE_WORDS, "org_schema")], F.bool_and("https").alias("https"), F.count_if("_article").alias("n_articles"),
        article("_author").alias("author_schema"), article("_published").alias("date_published"), article("_modified").alias("date_modified"),
        sum((some("_at_" + name).cast("int") for name in PROFILES), F.lit(0)).alias("n_profiles"),
    )
    partial = F.least(F.lit(PROFILE_WEIGHT), F.floor(F.col("n_profiles") * PROFILE_WEIGHT / 3).cast("int"))
    return out.withColumn("score", sum((F.col(name).cast("int") * w for name, w in WEIGHTS.items()), partial))


def trust_issues(pages: DataFrame, site: str = "site") -> DataFrame:
    return evaluate(trust_signals(pages, site), SITE_RULES, site)


#: On a site's files for language models.
FILE_RULES = [
    Rule("missing_llms_txt", "llms_ai", "medium", "NOT has_llms"),
    Rule("invalid_llms_syntax", "llms_ai", "high", "has_llms AND title IS NULL"),
    Rule("llms_no_links", "llms_ai", "medium", "has_llms AND title IS NOT NULL AND n_links = 0"),
    Rule("missing_llms_full_txt", "llms_ai", "low", "NOT has_llms_full"),
    Rule("missing_ai_txt", "llms_ai", "low", "NOT has_ai"),
    Rule("missing_indexnow", "llms_ai", "low", "NOT has_indexnow"),
]
SECTION, LINK = r"^##\s+(.+)$", r"^-\s*\[([^\]]+)\]\(([^)]+)\)"


def model_files(files: DataFrame) -> DataFrame:
    """A row for each domain of ``files(domain, path, status_code, body)``: which files it has, and its llms.txt taken apart.

    title is null if the text does not begin with a heading; the description is the first paragraph before a section or link.
    """
    there = lambda path: (F.col("path") == path) & (F.col("status_code") == 200)
    sites = files.groupBy("domain").agg(
        F.max(F.when(there("/llms.txt"), F.coalesce("body", F.lit("")))).alias("body"), F.coalesce(F.bool_or(there("/llms-full.txt")), F.lit(False)).alias("has_llms_full"),
        F.coalesce(F.bool_or(there("/ai.txt")), F.lit(False)).alias("has_ai"),
        F.coalesce(F.bool_or(there("/.well-known/indexnow") & F.col("body").rlike(r"\S")), F.lit(False)).alias("has_indexnow"),
    )
    lines = F.transform(F.split(F.regexp_replace("body", r"^\s+|\s+$", ""), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    sites = sites.withColumn("_lines", lines).withColumn("_rest", F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))))
    stop = F.array_position(F.transform("_rest", lambda x: x.rlike(SECTION) | x.rlike(LINK)), True)
    head = F.array_join(F.when(stop > 0, F.slice("_rest", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("_rest")), "\n")
    paragraph = F.replace(F.regexp_extract(head, r"^\n*([^\n]+(?:\n[^\n]+)*)", 1), F.lit("\n"), F.lit(" "))
    links = F.transform(F.filter("_lines", lambda x: x.rlike(LINK)), lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("label"), F.regexp_extract(x, LINK, 2).alias("url")))
    sections = F.transform(F.filter("_lines", lambda x: x.rlike(SECTION)), lambda x: F.regexp_extract(x, SECTION, 1))
    return sites.select(
        "domain", F.col("body").isNotNull().alias("has_llms"), "has_llms_full", "has_ai", "has_indexnow",
        F.nullif(F.regexp_extract(F.element_at("_lines", 1), r"^#\s+(.+)$", 1), F.lit("")).alias("title"), paragraph.alias("description"),
        sections.alias("sections"), links.alias("links"), F.coalesce(F.nullif(F.size(links), F.lit(-1)), F.lit(0)).alias("n_links"),
    )


def model_file_issues(files: DataFrame) -> DataFrame:
    return evaluate(model_files(files), FILE_RULES, "domain")
