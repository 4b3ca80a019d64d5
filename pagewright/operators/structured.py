"""Structured data: validation of JSON-LD blocks, one row a block. Expressions only.

A field counts as present unless it is missing, null, a blank string or an empty list. Blocks that are not JSON have no type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule, evaluate

#: The fields that each type needs, and those that help it.
REQUIRED = {
    "Product": ("name", "offers"), "Article": ("headline", "author", "datePublished"), "NewsArticle": ("headline", "author", "datePublished"),
    "BlogPosting": ("headline", "author", "datePublished"), "FAQPage": ("mainEntity",), "HowTo": ("step",), "BreadcrumbList": ("itemListElement",),
    "LocalBusiness": ("name", "address", "telephone"), "Organization": ("name",), "Event": ("name", "startDate", "location"),
    "Recipe": ("name", "recipeIngredient", "recipeInstructions"), "VideoObject": ("name", "uploadDate", "thumbnailUrl"),
    "JobPosting": ("title", "datePosted", "description", "hiringOrganization"),
}
RECOMMENDED = {
    "Product": ("image", "description", "brand", "sku"), "Article": ("image", "dateModified", "publisher"), "Organization": ("url", "logo", "sameAs"),
    "LocalBusiness": ("openingHoursSpecification", "geo", "url"), "Event": ("description", "image", "offers"),
}

BLOCK_RULES = [
    Rule("schema_syntax_error", "schema", "high", "size(errors) > 0"),
    Rule("schema_missing_required_field", "schema", "medium", "size(missing_required) > 0"),
]


def field(block: Column, name: str) -> Column:
    return F.get_json_object(block, f"$['{name}']")


def filled(c: Column) -> Column:
    """Whether a JSON value's text is more than a null, an empty string, list or object, false or zero."""
    return ~F.coalesce(c, F.lit("")).isin("", "[]", "{}", "false", "0", "0.0")


def block_type(block: Column) -> Column:
    """The block's type, the first if it has a list of them."""
    t = field(block, "@type")
    return F.nullif(F.when(F.startswith(t, F.lit("[")), F.get_json_object(block, "$['@type'][0]")).otherwise(t), F.lit(""))


def as_list(c: Column) -> Column:
    """A JSON value's elements as texts; a single value is a list of one, null an empty list."""
    whole = F.when(filled(c), F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(c, F.lit("[")), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(whole)


def _absent(fields: dict[str, tuple], kind: Column, block: Column) -> Column:
    names = list(dict.fromkeys(f for own in fields.values() for f in own))
    blank = lambda f: F.coalesce(F.trim(field(block, f)), F.lit("")).isin("", "[]")
    return F.array_compact(F.array(*[F.when(kind.isin([t for t, own in fields.items() if f in own]) & blank(f), F.lit(f)) for f in names]))


def _errors(kind: Column, block: Column) -> Column:
    none = F.array().cast("array<string>")
    is_object = lambda x: F.startswith(x, F.lit("{"))
    at = lambda list_, i, text: F.concat(F.lit(list_ + "["), i.cast("string"), F.lit("] " + text))

    def question(x: Column, i: Column) -> Column:
        answer = F.get_json_object(x, "$.acceptedAnswer.text")
        return F.when(~is_object(x), F.array(at("mainEntity", i, "is no object"))).otherwise(F.array_compact(F.array(
            F.when(~F.coalesce(field(x, "@type") == "Question", F.lit(False)), at("mainEntity", i, "is no Question")),
            F.when(~(filled(field(x, "name")) | filled(field(x, "text"))), at("mainEntity", i, "asks nothing")),
            F.when(~filled(answer), at("mainEntity", i, "has no answer text")),
        )))

    offers = as_list(field(block, "offers"))
    first = F.try_element_at(offers, F.lit(1))
    unpriced = is_object(first) & ~(filled(field(first, "price")) | filled(field(first, "priceRange")))
    items = field(block, "itemListElement")
    position = lambda x, i: F.when(is_object(x) & ~F.array_contains(F.json_object_keys(x), "position"), at("itemListElement", i, "has no position"))
    return (
        F.when(kind.isNull(), F.array(F.lit("no @type")))
        .when(kind == "FAQPage", F.flatten(F.transform(as_list(field(block, "mainEntity")), question)))
        .when((kind == "Product") & unpriced, F.array(F.lit("offers have no price")))
        .when((kind == "BreadcrumbList") & items.isNotNull() & ~F.startswith(items, F.lit("[")), F.array(F.lit("itemListElement is no list")))
        .when(kind == "BreadcrumbList", F.array_compact(F.transform(as_list(items), position)))
        .otherwise(none)
    )


def validate(pages: DataFrame) -> DataFrame:
    """url, pos, schema_type, missing_required, missing_recommended, errors and is_valid for each block of ``pages(url, schema_data)``."""
    blocks = pages.select("url", F.posexplode("schema_data").alias("pos", "block")).withColumn("schema_type", block_type(F.col("block")))
    kind, block = F.col("schema_type"), F.col("block")
    d = blocks.select("url", "pos", "schema_type", _absent(REQUIRED, kind, block).alias("missing_required"), _absent(RECOMMENDED, kind, block).alias("missing_recommended"), _errors(kind, block).alias("errors"))
    return d.withColumn("is_valid", F.col("schema_type").isNotNull() & (F.size("missing_required") == 0))


def block_issues(pages: DataFrame) -> DataFrame:
    return evaluate(validate(pages), BLOCK_RULES, "url", "pos")


def opportunities(pages: DataFrame) -> DataFrame:
    """Pages below the root that have structured data but no breadcrumbs."""
    bare = F.regexp_replace("url", "/+$", "")
    depth = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) - 2
    own = F.transform("schema_data", block_type)
    return pages.filter((F.size("schema_data") > 0) & (depth > 0) & ~F.exists(own, lambda t: F.coalesce(t == "BreadcrumbList", F.lit(False)))).select("url", F.lit("schema_rich_result_opportunity").alias("type"), F.lit("schema").alias("category"), F.lit("info").alias("severity"))
