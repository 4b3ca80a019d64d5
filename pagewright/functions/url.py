"""URL functions, as Column expressions over regular expressions (no parse_url: it rejects unencoded spaces)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 1))


def netloc(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 2))


def path(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 3)


def canonical_form(u: Column) -> Column:
    """Lower-case scheme and host, path as it is without a trailing slash (but the root's), no query or fragment."""
    p = path(u)
    return F.concat(scheme(u), F.lit("://"), netloc(u), F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))


def graph_form(u: Column, root_slash: str = "keep") -> Column:
    """Lower case, no query or fragment, no trailing slash; the root's slash is kept unless root_slash is ``strip``."""
    bare = F.lower(F.split(u, "[#?]")[0])
    cut = F.regexp_replace(bare, "/+$", "")
    if root_slash == "strip":
        return cut
    return F.when(path(bare) == "/", bare).otherwise(cut)


def without_fragment(u: Column) -> Column:
    return F.split(u, "#")[0]


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda x: x != "")


def joined(base: Column, href: Column) -> Column:
    """href against base: absolute, //host, /path, ?query, #fragment or relative to the base's folder, dot segments removed."""
    root = F.concat(F.regexp_extract(base, r"^([^:/?#]+):", 1), F.lit(":"))
    origin = F.concat(root, F.lit("//"), F.regexp_extract(base, PARTS, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    relative = F.concat(origin, F.when(folder == "", "/").otherwise(folder), href)
    plain = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(root, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .when(href.startswith("#") | (href == ""), F.concat(F.split(base, "#")[0], href))
        .otherwise(relative)
    )
    step = F.regexp_replace(plain, r"/\./", "/")
    for _ in range(3):
        step = F.regexp_replace(step, r"([^/:])/(?!\.\.(?:/|$))[^/?#]+/\.\./", "$1/")
    return step
