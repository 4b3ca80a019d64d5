"""Search trends: keywords that grow, merged with related queries, and their text insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def growth(points: DataFrame) -> DataFrame:
    """query, growth_pct and is_breakout of the keywords of ``points(keyword, seq, value)`` whose last quarter is over 1.5 times the
    first one (8 points at least, a first mean of 0.3 at least)."""
    w = Window.partitionBy("keyword")
    p = points.select("keyword", "value", F.row_number().over(w.orderBy("seq")).alias("i"), F.count(F.lit(1)).over(w).alias("n")).withColumn("q", F.expr("n div 4")).filter("n >= 8")
    g = p.groupBy("keyword").agg(F.avg(F.when(F.col("i") <= F.col("q"), F.col("value"))).alias("first"), F.avg(F.when(F.col("i") > F.col("n") - F.col("q"), F.col("value"))).alias("last"))
    g = g.filter("first >= 0.3 AND last > first * 1.5").withColumn("g", ((F.col("last") - F.col("first")) / F.col("first") * 100).cast("bigint"))
    return g.select(F.col("keyword").alias("query"), F.least("g", F.lit(9999)).alias("growth_pct"), (F.col("g") >= 500).alias("is_breakout"))


def rising(points: DataFrame, related: DataFrame, per_keyword: int = 5, k: int = 10) -> DataFrame:
    """The k fastest queries: grown keywords first, then the head of each keyword's ``related(keyword, seq, query, value)``; of equal
    queries the earlier one counts. Breakouts come first, then growth; ties go by query."""
    head = related.withColumn("_r", F.row_number().over(Window.partitionBy("keyword").orderBy("seq"))).filter(F.col("_r") <= per_keyword)
    value = F.expr("try_cast(value AS bigint)")
    burst = F.contains(F.lower("value"), F.lit("breakout"))
    own = head.select(F.trim("query").alias("query"), F.when(burst, 9999).otherwise(F.coalesce(value, F.lit(0))).cast("bigint").alias("growth_pct"), (burst | value.isNull()).alias("is_breakout"), F.struct(F.lit(1).alias("part"), "keyword", "seq").alias("_o"))
    grown = growth(points).withColumn("_o", F.struct(F.lit(0).alias("part"), F.col("query").alias("keyword"), F.lit(0).cast(related.schema["seq"].dataType).alias("seq")))
    one = grown.unionByName(own.filter("query <> ''")).groupBy("query").agg(F.min_by(F.struct("growth_pct", "is_breakout"), "_o").alias("x")).select("query", "x.*")
    return one.orderBy(F.col("is_breakout").desc(), F.col("growth_pct").desc(), "query").limit(k)


def insights(rising_queries: DataFrame, k: int = 5) -> DataFrame:
    """query and text of the first k rising queries that are worth a line."""
    top = rising_queries.orderBy(F.col("is_breakout").desc(), F.col("growth_pct").desc(), "query").limit(k)
    grown = F.concat(F.lit("'"), F.col("query"), F.lit("' +"), F.col("growth_pct"), F.lit("%"))
    text = F.when(F.col("is_breakout"), F.concat(F.lit("BREAKOUT: '"), F.col("query"), F.lit("'"))).when(F.col("growth_pct") >= 50, grown)
    return top.select("query", text.alias("text")).filter("text IS NOT NULL")


def fresh(cache: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Cached answers that still hold; those that were rate limited are asked again."""
    return cache.filter((F.col("fetched_at") > F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))) & ~F.contains(F.coalesce("error", F.lit("")), F.lit("429")))
