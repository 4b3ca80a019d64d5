"""Search analytics: one-pass roll-ups of a fact table (query, page, device, country, clicks, impressions, position), and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded

DIMENSIONS = ("query", "page", "device", "country")


def _measures():
    return [F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), rounded(F.avg("position"), 2).alias("position")]


def rollup(facts: DataFrame) -> DataFrame:
    """The four single-dimension groupings in one scan: dimension, value and measures."""
    d = facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in DIMENSIONS])).alias("g"), "clicks", "impressions", "position")
    return d.groupBy("g.dimension", "g.value").agg(*_measures())


def totals(facts: DataFrame) -> DataFrame:
    t = facts.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), rounded(F.avg("position"), 2).alias("avg_position"))
    return t.withColumn("avg_ctr", rounded(F.col("clicks") / F.greatest("impressions", F.lit(1)) * 100, 2))


def by_query(facts: DataFrame) -> DataFrame:
    return facts.groupBy("query").agg(*_measures())


def top(facts: DataFrame, dimension: str, k: int = 10) -> DataFrame:
    return facts.groupBy(dimension).agg(*_measures()).orderBy(F.col("clicks").desc(), dimension).limit(k)


def scored_keywords(facts: DataFrame, k: int = 10) -> DataFrame:
    """The keywords worth a content check: position 4 to 30, 100 impressions or more, the k with most impressions."""
    return by_query(facts).filter("position BETWEEN 4 AND 30 AND impressions >= 100").orderBy(F.col("impressions").desc(), "query").limit(k)
