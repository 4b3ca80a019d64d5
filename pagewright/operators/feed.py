"""News feeds: items from RSS documents, priorities by key phrases, events that several sources confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phrases of each priority.
PHRASES = {
    "critical": ("core update", "broad core update", "spam update", "algorithm update", "ranking change", "search update"),
    "high": ("core web vitals", "inp", "ai overview", "ai mode", "indexing", "crawling", "structured data", "rich results"),
    "medium": ("e-e-a-t", "schema", "geo", "ai search", "chatgpt search", "gemini", "perplexity", "helpful content", "link spam", "review update"),
}


def parse_rss(feeds: DataFrame, per_feed: int = 20) -> DataFrame:
    """source, pos, title, url, summary and published of the first ``per_feed`` items of each row of ``feeds(source, body)``; a
    document that is no XML has none."""
    schema = "channel struct<item array<struct<title:string,link:string,description:string,pubDate:string>>>"
    items = F.slice(F.from_xml("body", schema, {"mode": "PERMISSIVE"})["channel"]["item"], 1, per_feed)
    d = feeds.select("source", F.posexplode(items).alias("pos", "i"))
    day = F.expr("try_to_timestamp(regexp_replace(regexp_replace(i.pubDate, '^[A-Za-z]{3}, ', ''), ' (GMT|UTC|Z)$', ' +0000'), 'd MMM yyyy HH:mm:ss Z')")
    text = lambda c: F.coalesce(c, F.lit(""))
    return d.select("source", "pos", text(F.col("i.title")).alias("title"), text(F.col("i.link")).alias("url"), F.substring(text(F.col("i.description")), 1, 500).alias("summary"), day.alias("published"))


def item_id(source: Column, url: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", source, url)), 1, 12)


def classified(items: DataFrame, text: Column) -> DataFrame:
    """``items`` with priority and matched: the first critical phrase alone, or else all high and medium ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda p: F.filter(F.array(*map(F.lit, PHRASES[p])), lambda w: F.contains(F.col("_t"), w))
    d = items.withColumn("_t", low).withColumns({"_c": hits("critical"), "_h": hits("high"), "_m": hits("medium")})
    priority = F.when(F.size("_c") > 0, "critical").when(F.size("_h") > 0, "high").when(F.size("_m") > 0, "medium").otherwise("low")
    return d.withColumns({"priority": priority, "matched": F.when(F.size("_c") > 0, F.slice("_c", 1, 1)).otherwise(F.concat("_h", "_m"))}).drop("_t", "_c", "_h", "_m")


def confirmed_events(items: DataFrame, key: str, order: str, sources: int = 2, sample: int = 5) -> DataFrame:
    """keyword, event_id, priority, n_sources, first_seen and the keys of the first items, for keywords of critical and high items that
    at least ``sources`` sources have. Samples are ranked before they are gathered, so a frequent keyword gathers nothing large."""
    k = items.filter(F.col("priority").isin("critical", "high")).select(F.explode("matched").alias("keyword"), "source", "priority", F.col(key).alias("_k"), F.col(order).alias("_o"))
    first = k.withColumn("_r", F.row_number().over(Window.partitionBy("keyword").orderBy("_o", "_k"))).filter(F.col("_r") <= sample)
    first = first.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_k"))), lambda x: x["_k"]).alias("items"))
    g = k.groupBy("keyword").agg(F.min_by("priority", F.struct("_o", "_k")).alias("priority"), F.countDistinct("source").alias("n_sources"), F.min("_o").alias("first_seen")).filter(F.col("n_sources") >= sources)
    return g.join(first, "keyword").select("keyword", F.substring(F.md5("keyword"), 1, 10).alias("event_id"), "priority", "n_sources", "first_seen", "items")


def prioritized(items: DataFrame, k: int = 50) -> DataFrame:
    """The k items of highest priority, newest first, undated last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "medium"))), F.col("priority")), F.lit(0))
    return items.orderBy(F.when(rank == 0, 4).otherwise(rank), F.col("published").desc_nulls_last(), "source", "url").limit(k)


def heuristic_risk(priority: Column) -> Column:
    """The risk that is taken where nobody was asked."""
    return F.when(priority == "critical", "MEDIUM").otherwise("LOW")
