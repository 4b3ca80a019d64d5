"""The rule catalogue: each rule is a row of data, all rules over one relation are evaluated in one scan.

Predicates and severities are SQL expressions in the common subset of Spark and DuckDB, so the catalogue can also be written out as
plain SQL (``union_sql``) and held against another engine.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    type: str
    category: str
    severity: str  # a word, or an SQL expression
    when: str


OK = "status_code = 200"
LEGAL = "regexp_like(lower(url), '(impressum|datenschutz|privacy|terms|agb)')"
GOOD = lambda s: f"{OK} AND ({s})"
EMPTY = lambda c: f"trim(coalesce({c}, '')) = ''"

#: On a page alone. The catalogue's names, severities and thresholds.
PAGE_RULES = [
    Rule("fetch_error", "crawl", "high", "coalesce(error, '') <> ''"),
    Rule("http_error", "crawl", "CASE WHEN status_code >= 500 THEN 'high' ELSE 'medium' END", "coalesce(error, '') = '' AND status_code >= 400"),
    Rule("missing_title", "meta", "high", GOOD(EMPTY("title"))),
    Rule("short_title", "meta", "medium", GOOD("length(title) > 0 AND length(title) < 20")),
    Rule("long_title", "meta", "low", GOOD("length(title) > 65")),
    Rule("missing_meta_description", "meta", "high", GOOD(EMPTY("meta_description"))),
    Rule("short_meta_description", "meta", "low", GOOD("length(meta_description) > 0 AND length(meta_description) < 80")),
    Rule("long_meta_description", "meta", "low", GOOD("length(meta_description) > 165")),
    Rule("missing_viewport", "meta", "medium", GOOD("coalesce(viewport, '') = ''")),
    Rule("missing_html_lang", "meta", "low", GOOD("coalesce(lang, '') = ''")),
    Rule("noindex_detected", "meta", f"CASE WHEN {LEGAL} THEN 'low' ELSE 'high' END", GOOD("contains(lower(coalesce(robots_meta, '')), 'noindex')")),
    Rule("missing_h1", "content", "medium", GOOD("n_h1 = 0")),
    Rule("multiple_h1", "content", "low", GOOD("n_h1 > 1")),
    Rule("missing_og_title", "social", "low", GOOD("coalesce(og_title, '') = ''")),
    Rule("missing_og_image", "social", "medium", GOOD("coalesce(og_image, '') = ''")),
    Rule("missing_twitter_card", "social", "low", GOOD("coalesce(twitter_card, '') = ''")),
    Rule("images_without_alt", "accessibility", "CASE WHEN images_without_alt > 3 THEN 'medium' ELSE 'low' END", GOOD("images_without_alt > 0")),
    Rule("missing_organization_schema", "schema", "medium", GOOD("is_home AND NOT has_org_schema")),
    Rule("no_jsonld", "schema", "low", GOOD("n_schema = 0")),
    Rule("no_https", "security", "high", GOOD("NOT https")),
    Rule("missing_security_headers", "security", "medium", GOOD("first_of_origin AND n_security < 3")),
    Rule("slow_response", "performance", "medium", GOOD("fetch_ms > 2500")),
    Rule("missing_canonical", "meta", "low", GOOD("coalesce(canonical, '') = ''")),
    Rule("soft_404", "redirect", "medium", GOOD(
        "CAST(word_count < 50 AS INT) + CAST(regexp_like(lower(coalesce(title, '')), '(not found|404|keine seite|nicht gefunden|page not found|seite nicht gefunden|does not exist)') AS INT)"
        " + CAST(n_h1 = 0 AND word_count < 100 AS INT) >= 2")),
    Rule("geo_answer_first", "geo", "high", GOOD("NOT (n_h1 > 0 AND word_count >= 100)")),
    Rule("geo_structured_format", "geo", "medium", GOOD("NOT has_question_h2 AND n_h2 < 2")),
    Rule("geo_fact_density", "geo", "medium", GOOD("NOT has_number AND word_count < 500")),
    Rule("geo_paragraph_length", "geo", "low", GOOD("CASE WHEN n_h2 > 0 AND word_count > 0 THEN word_count >= 300 * (n_h2 + 1) ELSE word_count >= 500 END")),
    Rule("geo_entity_clarity", "geo", "medium", GOOD("NOT has_entity_schema")),
    Rule("geo_freshness_signals", "geo", "medium", GOOD("NOT has_date_schema")),
    Rule("thin_content", "duplicate_content", "medium", GOOD(f"word_count > 0 AND word_count < 300 AND NOT {LEGAL}")),
]

#: On a page-speed measurement without error.
SPEED_RULES = [
    Rule("poor_lighthouse_performance", "performance", "high", "performance < 50"),
    Rule("moderate_lighthouse_performance", "performance", "medium", "performance >= 50 AND performance < 90"),
    Rule("poor_lcp", "performance", "CASE WHEN coalesce(crux_lcp_ms, lcp_ms) > 4000 THEN 'high' ELSE 'medium' END", "coalesce(crux_lcp_ms, lcp_ms) > 2500"),
    Rule("poor_cls", "performance", "CASE WHEN coalesce(crux_cls, cls) > 0.25 THEN 'high' ELSE 'medium' END", "coalesce(crux_cls, cls) > 0.1"),
    Rule("poor_inp", "performance", "CASE WHEN crux_inp_ms > 500 THEN 'high' ELSE 'medium' END", "crux_inp_ms > 200"),
    Rule("poor_tbt", "performance", "CASE WHEN tbt_ms > 600 THEN 'high' ELSE 'medium' END", "crux_inp_ms IS NULL AND tbt_ms > 200"),
    Rule("poor_ttfb", "performance", "CASE WHEN crux_ttfb_ms > 1800 THEN 'high' ELSE 'medium' END", "crux_ttfb_ms > 800"),
    Rule("low_lighthouse_seo", "meta", "medium", "seo < 90"),
    Rule("low_accessibility", "accessibility", "medium", "accessibility < 80"),
]

#: On a search query's totals, and on a keyword's content scores.
QUERY_RULES = [
    Rule("low_ctr_opportunity", "keyword", "high", "impressions >= 30 AND position <= 10 AND clicks < 0.03 * impressions"),
    Rule("striking_distance", "keyword", "medium", "impressions >= 30 AND position >= 11 AND position <= 20"),
]
CONTENT_RULES = [
    Rule("poor_intent_match", "content", "high", "intent_match < 40"),
    Rule("moderate_intent_match", "content", "medium", "intent_match >= 40 AND intent_match < 70"),
    Rule("poor_geo_readiness", "geo", "high", "geo_readiness < 40"),
    Rule("content_gaps_detected", "content", "medium", "n_gaps > 0"),
]


def _severity(r: Rule) -> str:
    return r.severity if " " in r.severity else f"'{r.severity}'"


def evaluate(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """The key columns with type, category and severity of every rule that fires: one scan, one explode."""
    made = F.array(*[F.when(F.expr(r.when), F.struct(F.lit(r.type).alias("type"), F.lit(r.category).alias("category"), F.expr(_severity(r)).alias("severity"))) for r in rules])
    return df.select(*keys, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select(*keys, "i.*")


def union_sql(relation: str, rules: list[Rule], *keys: str) -> str:
    """The same as SQL text: a union of selections."""
    text = "\nUNION ALL ".join(f"SELECT {', '.join(keys)}, '{r.type}' AS type, '{r.category}' AS category, {_severity(r)} AS severity FROM {relation} WHERE {r.when}" for r in rules)
    return text.replace("regexp_like(", "regexp_matches(")


def rule_input(pages: DataFrame) -> DataFrame:
    """The page relation with what the rules look at beside plain columns. Needs ``ord`` for the first page of each origin."""
    from pyspark.sql import Window

    from ..functions import url as ur

    has = lambda *types: F.arrays_overlap("schema_types", F.array(*map(F.lit, types)))
    origin = Window.partitionBy(ur.scheme(F.col("url")), ur.netloc(F.col("url")), F.col("status_code") == 200).orderBy("ord")
    question = lambda h: h.endswith("?") | F.lower(h).rlike("^(was|wie|warum|wann|wo|what|how|why|when|where) ")
    return pages.withColumns({
        "n_h1": F.size("h1"), "n_h2": F.size("h2"), "n_schema": F.size("schema_types"),
        "og_title": F.col("og_tags")["og:title"], "og_image": F.col("og_tags")["og:image"], "twitter_card": F.col("twitter_tags")["twitter:card"],
        "is_home": F.length(F.regexp_replace(ur.path(F.col("url")), "/", "")) == 0, "has_org_schema": has("Organization", "WebSite"),
        "has_entity_schema": has("Organization", "Person", "LocalBusiness", "WebSite"),
        "has_date_schema": F.exists("schema_data", lambda s: s.rlike('"date(Published|Modified)"')),
        "n_security": F.size(F.array_intersect(F.map_keys("security_headers"), F.array(F.lit("strict-transport-security"), F.lit("x-content-type-options"), F.lit("x-frame-options")))),
        "has_question_h2": F.exists("h2", question), "first_of_origin": F.row_number().over(origin) == 1,
        "has_number": F.concat_ws(" ", "title", "meta_description", F.array_join("h1", " ")).rlike("[0-9]"),
    })
