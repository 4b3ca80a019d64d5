"""What is shown of pages and issues: page summaries, texts of issues by type, values read out of titles, checked addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as ur

#: Starts of host names that are not public.
PRIVATE = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "10.", "192.168.", "172.")
SHOWN_LISTS = ("h1", "h2", "schema_types", "og_tags", "twitter_tags")


def page_summaries(pages: DataFrame) -> DataFrame:
    """One row a page for display: texts never null, their lengths, and whether each tag is there."""
    have = set(pages.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    there = lambda c: text(c) != ""
    via = F.coalesce("rendered_via", F.lit("plain")) if "rendered_via" in have else F.lit("plain")
    return pages.select(
        "url", F.coalesce("status_code", F.lit(0)).alias("status_code"), F.coalesce("fetch_ms", F.lit(0)).alias("fetch_ms"), via.alias("rendered_via"),
        text("title").alias("title"), F.length(text("title")).alias("title_length"), text("meta_description").alias("meta_description"), F.length(text("meta_description")).alias("meta_description_length"),
        *SHOWN_LISTS, "word_count", "images_total", "images_without_alt", "internal_links", "external_links",
        there("canonical").alias("has_canonical"), there("viewport").alias("has_viewport"), there("lang").alias("has_lang"), text("lang").alias("lang"), F.coalesce("https", F.lit(False)).alias("https"), text("robots_meta").alias("robots_meta"), "error",
    )


def explained(issues: DataFrame, texts: DataFrame, categories: DataFrame) -> DataFrame:
    """``issues(type, category, title, description, ...)`` with the texts of their type and the name of their category in another
    language, from ``texts(type, ...)`` and ``categories(category, label)``, which have a row a type; types without texts get nulls,
    unknown categories their own name with a capital. Values are read out of titles: a length in characters, a current value."""
    t = texts.select(F.col("type").alias("_t"), *[c for c in texts.columns if c != "type"])
    d = issues.join(t, F.col("type") == F.col("_t"), "left").drop("_t")
    c = categories.select(F.col("category").alias("_c"), F.col("label").alias("_label"))
    shown = F.coalesce("category", F.lit("other"))
    d = d.join(c, shown == F.col("_c"), "left")
    title, about = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    words = F.regexp_extract(title, r"(\d+)\s*words?", 1)
    named = F.nullif(F.regexp_extract(about, r"Current (?:title|description): '([^']*)'", 1), F.lit(""))
    return d.withColumns({
        "category_label": F.coalesce("_label", F.concat(F.upper(F.substring(shown, 1, 1)), F.lower(F.substr(shown, F.lit(2))))),
        "current_length": F.nullif(F.regexp_extract(title, r"\((\d+)\s*chars?\)", 1), F.lit("")).cast("int"),
        "current_value": F.when((words != "") & F.contains(F.lower(title), F.lit("thin")), F.concat(words, F.lit(" words"))).otherwise(named),
    }).drop("_c", "_label")


def issue_titles(issues: DataFrame) -> DataFrame:
    """Titles and descriptions of issues of titles, descriptions and thin pages, from ``issues(type, title_length, words, value)``."""
    n = lambda c: F.col(c).cast("string")
    long = F.when(F.startswith("type", F.lit("long")), "too long").otherwise("too short")
    what = F.when(F.endswith("type", F.lit("title")), "Title").otherwise("Description")
    title = F.when(F.col("type").isin("long_title", "short_title", "long_meta_description", "short_meta_description"), F.concat(what, F.lit(" "), long, F.lit(" ("), n("length"), F.lit(" chars)")))
    title = title.when(F.col("type") == "thin_content", F.concat(F.lit("Thin content: "), n("words"), F.lit(" words"))).otherwise(F.replace("type", F.lit("_"), F.lit(" ")))
    return issues.withColumn("title", title).withColumn("description", F.when(F.col("value").isNotNull(), F.concat(F.lit("Current "), F.lower(what), F.lit(": '"), "value", F.lit("'"))))


def public_address(url: Column) -> tuple[Column, Column]:
    """(scheme and host of an address that may be scanned, or null; why it may not). https is taken where no scheme is given."""
    u = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    net = F.regexp_extract(full, ur.PARTS, 2)
    host = F.lower(F.regexp_extract(net, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    private = F.lit(False)
    for start in PRIVATE:
        private = private | F.startswith(bare, F.lit(start))
    why = F.when(u == "", "empty").when(bare == "", "invalid").when(private, "private").when(~F.contains(bare, F.lit(".")), "incomplete")
    return F.when(why.isNull(), F.concat(ur.scheme(full), F.lit("://"), net)), why


def scan_id(url: Column, at: Column) -> Column:
    """A name for a scan of an address at a time: the same on every run."""
    return F.concat(F.lit("ps_"), F.unix_timestamp(at), F.lit("_"), F.pmod(F.xxhash64(url), F.lit(10_000)))
