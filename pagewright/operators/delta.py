"""The difference between two audits' issues (type, affected_url, severity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")


def _keyed(issues: DataFrame, name: str) -> DataFrame:
    key = F.concat("type", F.lit("::"), F.coalesce("affected_url", F.lit("")))
    return issues.groupBy(key.alias("fingerprint")).agg(F.max_by("severity", "ord").alias(name))


def issue_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """fingerprint, status (new, resolved, persistent), both severities, and whether it grew worse. The last of equal ones counts."""
    j = _keyed(current, "now").join(_keyed(previous, "before"), "fingerprint", "full_outer")
    rank = lambda c: F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(c)) - 1)
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("persistent")
    return j.select("fingerprint", status.alias("status"), "now", "before", ((status == "persistent") & (rank(F.col("now")) > rank(F.col("before")))).alias("regressed"))


def page_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    count = lambda d, n: d.groupBy("affected_url").agg(F.count(F.lit(1)).alias(n))
    j = count(current, "now").join(count(previous, "before"), "affected_url", "full_outer")
    return j.select("affected_url", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before")).withColumn("change", F.col("now") - F.col("before"))


def summary(delta: DataFrame, score_now: float, score_before: float) -> DataFrame:
    """Counts, and whether the audit regressed: score down by over 5, or two new critical or high issues."""
    d = delta.agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "persistent").alias("persistent"),
                  F.count_if((F.col("status") == "new") & F.lower("now").isin("critical", "high")).alias("new_severe"))
    return d.withColumn("score_change", F.round(F.lit(score_now - score_before), 1)).withColumn("is_regression", (F.lit(score_now - score_before) < -5) | (F.col("new_severe") >= 2))
