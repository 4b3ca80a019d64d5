"""Repairs of page heads as expressions: an element is replaced where it stands, or else put before the head's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Where each element stands now.
TITLE = "<title>.*?</title>"
DESCRIPTION = r'<meta\s+name="description"[^>]*/?>'
CANONICAL = r'<link\s+rel="canonical"[^>]*/?>'
IMAGE = r'<meta\s+property="og:image"[^>]*/?>'


def escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def first_replaced(text: Column, pattern: str, new: Column) -> Column:
    """The first match replaced by literal text; null if there is none."""
    found = F.regexp_extract(text, f"(?is){pattern}", 0)
    at = F.position(found, text)
    return F.when(found != "", F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(found), F.length(text))))


def head_patched(html: Column, snippet: Column, pattern: str | None = None) -> Column:
    """``html`` with the snippet in place of the first match of ``pattern``, or before ``</head>``; unchanged if it has neither."""
    before_end = first_replaced(html, "</head>", F.concat(F.lit("  "), snippet, F.lit("\n  </head>")))
    return F.coalesce(first_replaced(html, pattern, snippet), before_end, html) if pattern else F.coalesce(before_end, html)


def with_title(html: Column, title: Column) -> Column:
    return head_patched(html, F.concat(F.lit("<title>"), escaped(F.substring(title, 1, 65)), F.lit("</title>")), TITLE)


def with_description(html: Column, text: Column) -> Column:
    return head_patched(html, F.concat(F.lit('<meta name="description" content="'), escaped(F.substring(text, 1, 160)), F.lit('" />')), DESCRIPTION)


def with_canonical(html: Column, url: Column) -> Column:
    return head_patched(html, F.concat(F.lit('<link rel="canonical" href="'), escaped(url), F.lit('" />')), CANONICAL)


def with_image(html: Column, url: Column) -> Column:
    return head_patched(html, F.concat(F.lit('<meta property="og:image" content="'), escaped(url), F.lit('" />')), IMAGE)


def with_schema(html: Column, block: Column) -> Column:
    """A JSON-LD block before the head's end, unless the page has one of the same type."""
    body = tx.strip(block)
    kind = F.try_variant_get(F.try_parse_json(body), "$['@type']", "string")
    there = F.contains(html, F.concat(F.lit('"@type": "'), kind, F.lit('"'))) | F.contains(html, F.concat(F.lit('"@type":"'), kind, F.lit('"')))
    added = head_patched(html, F.concat(F.lit('<script type="application/ld+json">\n'), body, F.lit("\n</script>")))
    return F.when(F.coalesce((kind != "") & there, F.lit(False)), html).otherwise(added)


def changed_files(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """domain, path and body of the ``wanted`` text files that differ from the existing ones by more than outer white space."""
    old = existing.groupBy("domain", "path").agg(F.max("body").alias("_old"))
    d = wanted.join(old, ["domain", "path"], "left").filter(tx.strip(F.coalesce("_old", F.lit(""))) != tx.strip(F.col("body")))
    return d.select("domain", "path", F.when(F.col("body").endswith("\n"), F.col("body")).otherwise(F.concat("body", F.lit("\n"))).alias("body"))
