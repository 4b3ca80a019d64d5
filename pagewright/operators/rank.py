"""Strategy: effort, impact, return, priority and bucket of issues; scores of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours of effort and impact points by issue type.
EFFORT = {
    0.25: "missing_title short_title long_title missing_meta_description short_meta_description long_meta_description missing_viewport missing_html_lang noindex_detected missing_og_title missing_twitter_card",
    0.5: "missing_h1 multiple_h1 missing_canonical images_without_alt", 1.0: "missing_og_image missing_security_headers",
    1.5: "missing_organization_schema no_jsonld low_ctr_opportunity", 2.0: "fetch_error poor_cls low_lighthouse_seo", 3.0: "striking_distance",
    4.0: "no_https moderate_lighthouse_performance poor_lcp low_accessibility", 6.0: "poor_tbt", 8.0: "slow_response poor_lighthouse_performance",
}
IMPACT = {
    100: "noindex_detected", 90: "no_https poor_lighthouse_performance", 85: "low_ctr_opportunity", 80: "missing_title poor_lcp", 75: "striking_distance",
    70: "missing_meta_description slow_response poor_tbt", 60: "moderate_lighthouse_performance poor_cls", 50: "missing_organization_schema low_lighthouse_seo",
    40: "missing_h1 missing_og_image low_accessibility", 35: "missing_security_headers", 30: "missing_canonical", 25: "images_without_alt",
}
DEFAULT_EFFORT, DEFAULT_IMPACT = 2.0, 30


def case_sql(values: dict, default) -> str:
    """A CASE over the issue type, in SQL that Spark and DuckDB share."""
    whens = " ".join(f"WHEN type IN ({', '.join(repr(t) for t in types.split())}) THEN CAST({v} AS DOUBLE)" for v, types in values.items())
    return f"CASE {whens} ELSE CAST({default} AS DOUBLE) END"


def ranked(issues: DataFrame) -> DataFrame:
    """Issues with effort_hours, impact_score, roi, priority and bucket."""
    boost = F.when(F.col("severity") == "high", 1.5).when(F.col("severity") == "low", 0.6).otherwise(1.0)
    d = issues.withColumn("effort_hours", F.expr(case_sql(EFFORT, DEFAULT_EFFORT))).withColumn("impact_score", F.expr(case_sql(IMPACT, DEFAULT_IMPACT)))
    adj, e = F.col("impact_score") * boost, F.col("effort_hours")
    d = d.withColumn("roi", F.round(adj / F.greatest(e, F.lit(0.1)), 1))
    ladder = F.when(adj >= 60, "high").when((e <= 1) | (adj >= 35), "medium").otherwise("low")
    d = d.withColumn("priority", F.when(F.col("severity") == "high", "high").when(F.col("severity") == "low", F.when(adj < 35, "low").otherwise("medium")).otherwise(ladder))
    return d.withColumn("bucket", F.when((e <= 0.5) & (F.col("impact_score") >= 40), "quick_win").when(e <= 4, "this_week").otherwise("backlog"))


def order_columns() -> list[Column]:
    return [F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), F.col("roi").desc()]


def top_actions(ranked_issues: DataFrame, k: int = 10, *ties: str) -> DataFrame:
    """The first k issues: by priority, then return, then ``ties``."""
    return ranked_issues.orderBy(*order_columns(), *ties).limit(k)


def score(by: list[str], issues: DataFrame) -> DataFrame:
    """The audit score per group: only high, medium and low severities weigh; exact decimals, one place."""
    n = lambda s: F.count_if(F.col("severity") == s)
    d = issues.groupBy(*by).agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    dec = lambda c, f: F.col(c).cast("decimal(18,0)") * F.expr(f)
    loss = F.least(F.lit(50).cast("decimal(20,1)"), dec("high", "3.0")) + F.least(F.lit(30).cast("decimal(20,1)"), dec("medium", "1.0")) + F.least(F.lit(20).cast("decimal(20,1)"), dec("low", "0.3"))
    return d.withColumn("score", F.round(F.greatest(F.lit(0).cast("decimal(20,1)"), F.lit(100).cast("decimal(20,1)") - loss), 1).cast("double"))


def simple_score(high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 10 * high - 3 * medium)
