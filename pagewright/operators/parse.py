"""HTML to page relation. Expressions only, in the common subset of the Java and RE2 dialects.

Comments, scripts and styles go before text is taken; entities part words unless they are of the five that XML knows, which are
decoded first in titles and headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ur

HTML_LIMIT = 2_000_000
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy")
SPA_MARKERS = ('id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', 'script type="module"', "script type='module'", "__next_data__", "__nuxt__")


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value in a tag, null if there is none."""
    got = F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1))
    return F.nullif(tx.strip(got), F.lit(""))


def decoded(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), 0)


def inner(html: Column, name: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), 1)
    return F.transform(found, lambda x: tx.strip(decoded(F.regexp_replace(x, r"(?s)<[^>]*>", ""))))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[A-Za-z0-9#]+;", " ")


def parse_pages(raw: DataFrame, limit: int | None = HTML_LIMIT) -> DataFrame:
    """The page relation from ``raw(url, html)``; status_code, fetch_ms, response_bytes, final_url, security_headers, error and
    ord are taken from ``raw`` if it has them. Other columns are kept. Pages are read up to ``limit`` characters, or whole (None)."""
    have = set(raw.columns)
    given = {"status_code": F.lit(200), "fetch_ms": F.lit(0), "final_url": F.col("url"), "error": F.lit(None).cast("string"), "http_link_canonical": F.lit(None).cast("string"),
             "response_bytes": F.octet_length("html"), "security_headers": F.create_map().cast("map<string,string>")}
    p = raw.withColumns({k: v for k, v in given.items() if k not in have})
    if limit is not None:
        p = p.withColumn("html", F.substring("html", 1, limit))
    html = F.regexp_replace("html", r"(?is)<!--.*?-->", " ")
    p = p.withColumn("_m", tags(html, "meta")).withColumn("_l", tags(html, "link")).withColumn("_a", tags(html, "a")).withColumn("_i", tags(html, "img"))

    def meta(name: str) -> Column:
        own = F.filter("_m", lambda t: (F.lower(attribute(t, "name")) == name) & attribute(t, "content").isNotNull())
        return attribute(F.try_element_at(own, F.lit(-1)), "content")

    def prefixed(kind: str, prefix: str) -> Column:
        own = F.filter("_m", lambda t: F.coalesce(attribute(t, kind).startswith(prefix), F.lit(False)) & attribute(t, "content").isNotNull())
        keys, values = F.transform(own, lambda t: attribute(t, kind)), F.transform(own, lambda t: attribute(t, "content"))
        # the last of a name counts: its place from the end is its first place in the reversed list
        last = F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.try_element_at(F.reverse(values), F.array_position(F.reverse(keys), k).cast("int"))))
        return F.map_from_entries(last)

    rel = lambda t, v: F.coalesce(F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), v), F.lit(False))
    canonical = F.filter("_l", lambda t: rel(t, "canonical") & attribute(t, "href").isNotNull())
    alternate = F.filter("_l", lambda t: rel(t, "alternate") & attribute(t, "hreflang").isNotNull())
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    as_lists = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    objects = F.filter(F.flatten(as_lists), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    hrefs = F.filter(F.transform("_a", lambda t: attribute(t, "href")), lambda h: h.isNotNull() & ~h.rlike("^(#|mailto:|tel:|javascript:)"))
    targets = F.transform("_h", lambda h: ur.joined(F.col("final_url"), h))
    internal = lambda u: ur.netloc(u) == ur.netloc(F.col("final_url"))
    p = p.withColumns({
        "title": F.nullif(tx.strip(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("")),
        "lang": attribute(F.try_element_at(tags(html, "html"), F.lit(1)), "lang"),
        "meta_description": meta("description"), "viewport": meta("viewport"), "robots_meta": meta("robots"),
        "og_tags": prefixed("property", "og:"), "twitter_tags": prefixed("name", "twitter:"),
        "canonical": attribute(F.try_element_at(canonical, F.lit(-1)), "href"),
        "hreflang": F.transform(alternate, lambda t: F.struct(attribute(t, "hreflang").alias("hreflang"), attribute(t, "href").alias("href"))),
        "h1": inner(html, "h1"), "h2": inner(html, "h2"),
        "schema_data": F.transform(objects, lambda v: F.to_json(v)),
        "schema_types": F.flatten(F.transform(objects, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.filter(F.array(F.try_variant_get(v, "$['@type']", "string")), lambda x: x.isNotNull())))),
        "_h": hrefs, "text_content": visible_text(F.col("html")), "https": F.lower("final_url").startswith("https://"),
        "images_total": F.size("_i"), "images_without_alt": F.size(F.filter("_i", lambda t: attribute(t, "alt").isNull())),
    })
    p = p.withColumn("_t", targets)
    p = p.withColumns({
        "internal_links": F.size(F.filter("_t", internal)), "external_links": F.size(F.filter("_t", lambda u: ~internal(u))),
        "internal_link_urls": F.array_distinct(F.transform(F.filter("_t", internal), ur.without_fragment)),
        "word_count": F.size(tx.words(F.col("text_content"))),
    })
    return p.drop("_m", "_l", "_a", "_i", "_h", "_t")


SNAPSHOT = ("url final_url status_code fetch_ms title meta_description h1 h2 word_count internal_links external_links schema_types schema_data images_total images_without_alt"
            " og_tags canonical hreflang robots_meta lang https internal_link_urls security_headers twitter_tags viewport error").split()  # fmt: skip


def snapshots(pages: DataFrame) -> DataFrame:
    """What later stages and reports keep of a page: no text, no HTML; security headers by name."""
    via = F.col("rendered_via") if "rendered_via" in pages.columns else F.lit("plain")
    return pages.select(*SNAPSHOT, via.alias("rendered_via")).withColumn("security_headers", F.map_keys("security_headers"))


def security_headers(headers: Column) -> Column:
    """The security headers among a response's headers, names in lower case."""
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*SECURITY_HEADERS))


def spa_likely(html: Column, word_count: Column) -> Column:
    low = F.lower(html)
    return (word_count < 50) & F.exists(F.array(*map(F.lit, SPA_MARKERS)), lambda m: F.contains(low, m))


def rendered_over_raw(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages with a rendered twin take its body, and its head where it has one; lists are replaced, not appended."""
    head = ("title", "meta_description", "canonical", "robots_meta", "lang", "viewport")
    whole = ("og_tags", "twitter_tags", "hreflang", "schema_data", "schema_types")
    body = ("h1", "h2", "word_count", "internal_links", "external_links", "images_total", "images_without_alt", "internal_link_urls", "text_content")
    r = rendered.select(F.col("url").alias("_u"), *[F.col(c).alias(f"_r_{c}") for c in (*head, *whole, *body)])
    j = raw.join(r, F.col("url") == F.col("_u"), "left")
    out = {c: F.coalesce(F.nullif(F.col(f"_r_{c}"), F.lit("")), c) for c in head}
    out |= {c: F.when(F.col("_u").isNotNull() & (F.size(f"_r_{c}") > 0), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in whole}
    out |= {c: F.when(F.col("_u").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in body}
    out["rendered_via"] = F.when(F.col("_u").isNotNull(), "browser")
    return j.withColumns(out).select(*dict.fromkeys([*raw.columns, "rendered_via"]))
