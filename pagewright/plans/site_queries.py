"""Queries over structured data, trust signals and model files, on small fixed relations, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structured, trust
from .queries import _values
from .rules import union_sql

BLOCKS = [
    ("https://a.example/", 0, '{"@type":"Organization","name":"A","sameAs":["https://www.linkedin.com/a","https://x.com/a"]}'),
    ("https://a.example/p/1", 0, '{"@type":"Product","name":"P","offers":{"priceCurrency":"EUR"}}'),
    ("https://a.example/p/2", 0, '{"@type":["Product","Thing"],"name":" ","offers":[{"price":"9.90"}]}'),
    ("https://a.example/blog/1", 0, '{"@type":"Article","headline":"H","author":[],"datePublished":"2024-01-01"}'),
    ("https://a.example/blog/1", 1, '{"@type":"BreadcrumbList","itemListElement":[{"position":1},{"name":"x"}]}'),
    ("https://b.example/faq", 0, '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q","acceptedAnswer":{"text":"A"}},{"@type":"Answer"}]}'),
    ("https://b.example/x", 0, '{"name":"no type"}'),
    ("https://b.example/privacy?x=1", 0, '{"@type":"BreadcrumbList","itemListElement":"none"}'),
]
FILES = [
    ("one.example", "/llms.txt", 200, "# One\n\nAbout one\nin two lines\n\nmore\n## Docs\n- [Start](https://one.example/start)\n- [API](https://one.example/api)"),
    ("one.example", "/ai.txt", 200, "x"), ("one.example", "/.well-known/indexnow", 200, "  "),
    ("two.example", "/llms.txt", 200, "no heading\n- [A](u)"), ("two.example", "/llms-full.txt", 200, "x"), ("two.example", "/.well-known/indexnow", 200, "key"),
    ("three.example", "/llms.txt", 404, None), ("four.example", "/llms.txt", 200, "# Four\ntext"),
]


def _pages(spark):
    """The blocks gathered by page, with the types and the host of each."""
    b = spark.createDataFrame(BLOCKS, "url string, pos int, block string")
    p = b.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("schema_data"))
    types = F.array_compact(F.transform("schema_data", structured.block_type))
    return p.select(F.split("url", "/")[2].alias("site"), "url", F.startswith("url", F.lit("https")).alias("https"), types.alias("schema_types"), "schema_data")


def q_schema_validate(spark, sf):
    v = structured.validate(_pages(spark))
    return v.select("url", F.col("pos").cast("bigint").alias("pos"), "schema_type", F.array_join("missing_required", ",").alias("missing"), F.size("errors").cast("bigint").alias("n_errors"))


def q_schema_opportunities(spark, sf):
    return structured.opportunities(_pages(spark))


def q_trust_score(spark, sf):
    t = trust.trust_signals(_pages(spark))
    return t.select("site", "impressum", "datenschutz", "contact_page", "about_page", "org_schema", F.col("n_articles").cast("bigint").alias("n_articles"), F.col("n_profiles").cast("bigint").alias("n_profiles"), "author_schema", "date_modified", F.col("score").cast("bigint").alias("score"))


def q_model_file_rules(spark, sf):
    return trust.model_file_issues(spark.createDataFrame(FILES, "domain string, path string, status_code int, body string"))


QUERIES = {"schema_validate": q_schema_validate, "schema_opportunities": q_schema_opportunities, "trust_score": q_trust_score, "model_file_rules": q_model_file_rules}

_TYPED = f"""b AS (SELECT *, CASE WHEN block->>'$."@type"' LIKE '[%' THEN block->>'$."@type"[0]' ELSE block->>'$."@type"' END AS t FROM {_values(BLOCKS, "url string, pos int, block string")})"""
_MISSING = ", ".join(
    "CASE WHEN t IN ({}) AND coalesce(trim(block->>'$.{}'), '') IN ('', '[]') THEN '{}' END".format(", ".join(f"'{t}'" for t, own in structured.REQUIRED.items() if f in own), f, f)
    for f in dict.fromkeys(f for own in structured.REQUIRED.values() for f in own)
)
_LIKE = lambda words: " OR ".join(f"contains(p, '{w}')" for w in words)
_FLAGS = ", ".join(f"bool_or({_LIKE(words)}) AS {name}" for name, words in trust.PAGE_WORDS.items())
_PROFILES = " + ".join("coalesce(bool_or(org AND ({}))::INT, 0)".format(" OR ".join(f"contains(lower(coalesce(block->>'$.sameAs', '')), '{h}')" for h in hosts)) for hosts in trust.PROFILES.values())
_SCORE = " + ".join(f"{name}::INT * {w}" for name, w in trust.WEIGHTS.items())

ORACLE_SQL = {
    "schema_validate": f"""WITH {_TYPED} SELECT url, pos::BIGINT AS pos, t AS schema_type, concat_ws(',', {_MISSING}) AS missing,
      CASE WHEN t IS NULL THEN 1
           WHEN t = 'FAQPage' THEN (SELECT sum(CASE WHEN coalesce(q->>'$."@type"', '') <> 'Question' THEN 1 ELSE 0 END + CASE WHEN coalesce(q->>'$.name', q->>'$.text', '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(q->>'$.acceptedAnswer.text', '') = '' THEN 1 ELSE 0 END) FROM (SELECT unnest(json_extract(block, '$.mainEntity[*]')) AS q))
           WHEN t = 'Product' THEN CASE WHEN coalesce(block->>'$.offers.price', block->>'$.offers.priceRange', block->>'$.offers[0].price', block->>'$.offers[0].priceRange', '') = '' THEN 1 ELSE 0 END
           WHEN t = 'BreadcrumbList' AND block->>'$.itemListElement' NOT LIKE '[%' THEN 1
           WHEN t = 'BreadcrumbList' THEN len(json_extract(block, '$.itemListElement[*]')) - len(json_extract(block, '$.itemListElement[*].position'))
           ELSE 0 END::BIGINT AS n_errors FROM b""",
    "schema_opportunities": f"""WITH {_TYPED} SELECT url, 'schema_rich_result_opportunity' AS type, 'schema' AS category, 'info' AS severity FROM b GROUP BY url
      HAVING NOT bool_or(coalesce(t = 'BreadcrumbList', false)) AND length(rtrim(url, '/')) - length(replace(rtrim(url, '/'), '/', '')) > 2""",
    "trust_score": f"""WITH {_TYPED}, p AS (SELECT *, split_part(url, '/', 3) AS site, split_part(rtrim(lower(url), '/'), '?', 1) AS p, coalesce(t IN ('Organization', 'Corporation'), false) AS org,
        coalesce(t IN {trust.ARTICLES}, false) AS art FROM b),
      s AS (SELECT site, {_FLAGS}, bool_or(org) AS org_schema, bool_and(starts_with(url, 'https')) AS https, count(DISTINCT CASE WHEN art THEN url END) AS n_articles, {_PROFILES} AS n_profiles,
        NOT bool_or(art) OR bool_or(art AND coalesce(block->>'$.author', '[]') NOT IN ('', '[]')) AS author_schema, NOT bool_or(art) OR bool_or(art AND coalesce(block->>'$.datePublished', '') <> '') AS date_published,
        NOT bool_or(art) OR bool_or(art AND coalesce(block->>'$.dateModified', '') <> '') AS date_modified FROM p GROUP BY site)
      SELECT site, impressum, datenschutz, contact_page, about_page, org_schema, n_articles, n_profiles::BIGINT AS n_profiles, author_schema, date_modified, ({_SCORE} + least(10, floor(n_profiles * 10 / 3)))::BIGINT AS score FROM s""",
    "model_file_rules": f"""WITH f AS (SELECT domain, path, status_code, replace(body, '\\n', chr(10)) AS body FROM {_values(FILES, "domain string, path string, status_code int, body string")}),
      s AS (SELECT domain, max(CASE WHEN path = '/llms.txt' AND status_code = 200 THEN body END) AS body, bool_or(path = '/llms-full.txt' AND status_code = 200) AS has_llms_full, bool_or(path = '/ai.txt' AND status_code = 200) AS has_ai,
        bool_or(path = '/.well-known/indexnow' AND status_code = 200 AND trim(body) <> '') AS has_indexnow FROM f GROUP BY domain),
      m AS (SELECT domain, body IS NOT NULL AS has_llms, has_llms_full, has_ai, has_indexnow, nullif(regexp_extract(body, '^#\\s+([^\\n]+)', 1), '') AS title,
        coalesce(len(regexp_extract_all(body, '(?m)^-\\s*\\[[^\\]]+\\]\\([^)]+\\)')), 0) AS n_links FROM s)
      {union_sql("m", trust.FILE_RULES, "domain")}""",
}
