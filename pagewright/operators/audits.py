"""What an audit leaves behind: rows to store, changed metrics, regression alerts, and content scores for answer engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..plans.rules import PAGE_RULES, evaluate

# Points of each check.
ANSWER_WEIGHTS = {"geo_answer_first": 20, "geo_structured_format": 15, "geo_fact_density": 15, "geo_paragraph_length": 10, "geo_entity_clarity": 10, "geo_freshness_signals": 5}
CRAWLER_WEIGHT = 25


def answer_scores(pages: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """host, url, ord and score (0 to 100) of the good pages of a rule input; ``blocked(host)`` names hosts that shut AI crawlers out."""
    p = pages.filter("status_code = 200")
    fired = evaluate(p, [r for r in PAGE_RULES if r.type in ANSWER_WEIGHTS], "ord")
    lost = F.create_map(*[F.lit(x) for kv in ANSWER_WEIGHTS.items() for x in kv])
    lost = fired.groupBy("ord").agg(F.sum(F.element_at(lost, F.col("type"))).alias("lost"))
    d = p.select("host", "url", "ord").join(lost, "ord", "left").withColumn("score", 100 - F.coalesce("lost", F.lit(0)))
    if blocked is not None:
        d = d.join(blocked.select("host", F.lit(CRAWLER_WEIGHT).alias("_b")).distinct(), "host", "left").withColumn("score", F.col("score") - F.coalesce("_b", F.lit(0)))
    return d.select("host", "url", "ord", "score")


def answer_averages(scores: DataFrame) -> DataFrame:
    """host, its pages, and the average of their content scores, to one place."""
    return scores.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), rounded(F.avg("score"), 1).alias("average"))


COMMON = ("site", "affected_url", "type", "category", "severity", "source")


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """All issues of an audit as one bag: every source's rows with its name. A source may lack columns; they are null."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("source", F.lit(name))
        d = d.select(*[F.col(c).cast("string").alias(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in COMMON])
        out = d if out is None else out.unionByName(d)
    return out


def merged_issues(issues: DataFrame, ranked: DataFrame | None) -> DataFrame:
    """The ranked issues in place of all, if there are any."""
    return issues if ranked is None or ranked.isEmpty() else ranked


def severity_counts(issues: DataFrame, by: str | None = None) -> DataFrame:
    """How many issues each severity has (null counts as low), with a zero for high, medium and low where there is none."""
    own = issues.select(*([by] if by else []), F.lower(F.coalesce("severity", F.lit("low"))).alias("severity"))
    keys = [by, "severity"] if by else ["severity"]
    have = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    three = F.explode(F.array(*map(F.lit, ("high", "medium", "low")))).alias("severity")
    every = own.select(by).distinct().select(by, three) if by else own.sparkSession.range(1).select(three)
    return every.withColumn("zero", F.lit(0)).join(have, keys, "full_outer").select(*keys, F.coalesce("n", "zero").cast("bigint").alias("n"))


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def crawl_metrics(pages: DataFrame, by: str, discovered: DataFrame | None = None) -> DataFrame:
    """A row of totals for each site of ``pages``: discovered, crawled, good and failed pages, images, images without text, and the
    average response time of good pages in whole milliseconds."""
    good = F.col("status_code") == 200
    of = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0))
    d = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.count_if(good).alias("pages_ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("pages_failed"),
        of("images_total").alias("total_images"), of("images_without_alt").alias("images_without_alt"), (of("fetch_ms") / F.greatest(F.count_if(good), F.lit(1))).cast("bigint").alias("avg_response_ms"),
    )
    if discovered is None:
        return d.withColumn("pages_discovered", F.col("pages_crawled"))
    n = discovered.groupBy(by).agg(F.count(F.lit(1)).alias("pages_discovered"))
    return d.join(n, by, "left").withColumn("pages_discovered", F.coalesce("pages_discovered", F.lit(0).cast("bigint")))


def audit_rows(audits: DataFrame, metrics: DataFrame, key: str = "site") -> DataFrame:
    """Audits with their metrics beside them, as rows to store."""
    return audits.join(metrics, key, "left")


def project_states(audits: DataFrame, key: str = "project_id") -> DataFrame:
    """Each project's last run and its score, number of audits, and the audit before the last."""
    order = F.struct("completed_at", "audit_id")
    d = audits.groupBy(key).agg(F.max("completed_at").alias("last_run"), F.max_by("score", order).alias("score"), F.count(F.lit(1)).alias("audits"), F.max_by("audit_id", order).alias("audit_id"))
    return d


def with_previous(audits: DataFrame, key: str = "project_id") -> DataFrame:
    """Audits with the id and score of the one before, of the same project."""
    w = Window.partitionBy(key).orderBy("completed_at", "audit_id")
    return audits.withColumn("previous_id", F.lag("audit_id").over(w)).withColumn("previous_score", F.lag("score").over(w))


def applied_fixes(issues: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    """The last fixes that were applied, newest first."""
    d = issues.filter("fix_applied_at IS NOT NULL")
    return (d if project is None else d.filter(F.col("project_id") == project)).orderBy(F.col("fix_applied_at").desc(), "issue_id").limit(limit)


def reverted(issues: DataFrame, commit: str) -> DataFrame:
    """Issues with the fix of one commit taken back."""
    hit = F.coalesce(F.col("commit") == commit, F.lit(False))
    return issues.withColumn("status", F.when(hit, "reverted").otherwise(F.col("status"))).withColumn("fix_reverted", hit)


def audit_by_id(audits: DataFrame, audit_id: str) -> DataFrame:
    return audits.filter(F.col("audit_id") == audit_id)


def intel_rows(rising: DataFrame, top: DataFrame, k: int = 10, most: int = 9999) -> DataFrame:
    """What is stored of trends: the first k rising queries, their growth held at ``most``, and the first k top ones."""
    a = rising.orderBy(F.col("growth_pct").desc(), "query").limit(k).select(F.lit("rising").alias("kind"), "query", F.least(F.lit(most), F.col("growth_pct")).cast("double").alias("score"))
    b = top.orderBy(F.col("value").desc(), "query").limit(k).select(F.lit("top").alias("kind"), "query", F.col("value").cast("double").alias("score"))
    return a.unionByName(b)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text, for sinks that know none."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


def issue_rows(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """``issues(ord, type, affected_url, ...)`` as rows to store, with the outcome of ``fixes(ord, type, url, success, commit, diff, error,
    applied_by)``: fixed or open; of several fixes of an issue the last counts."""
    one = fixes.groupBy(F.col("type"), F.coalesce("url", F.lit("")).alias("_u")).agg(F.max_by(F.struct("success", "commit", "diff", "error", "applied_by"), "ord").alias("f"))
    d = issues.withColumn("_u", F.coalesce("affected_url", F.lit(""))).join(one, ["type", "_u"], "left")
    good = F.coalesce("f.success", F.lit(False))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return d.select(*issues.columns, F.when(good, "fixed").otherwise("open").alias("status"), F.when(good, F.coalesce("f.applied_by", F.lit("auto"))).alias("applied_by"), F.when(good, cut("f.commit", 64)).alias("commit"),
                    F.when(good, cut("f.diff", 8000)).alias("fix_diff"), F.when(F.col("f").isNotNull() & ~good, cut("f.error", 2000)).alias("fix_error"))


def keyword_rows(top_queries: DataFrame, k: int = 50) -> DataFrame:
    """The first k queries with their click rate, as a share."""
    return top_queries.orderBy(F.col("clicks").desc(), "query").limit(k).select(F.substring("query", 1, 255).alias("query"), "clicks", "impressions", "position", (F.coalesce("clicks", F.lit(0)) / F.greatest(F.coalesce("impressions", F.lit(1)), F.lit(1))).alias("ctr"))


def store(rows: DataFrame, path: str, *partitions: str) -> None:
    """Append to a Parquet table that is partitioned by tenant and project, or as told."""
    rows.write.mode("append").partitionBy(*(partitions or ("tenant_id", "project_id"))).parquet(path)


def latest(projects: DataFrame, new: DataFrame, key: str = "project_id") -> DataFrame:
    """An upsert as a relation: new rows replace stored ones of the same key."""
    return projects.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def metric_changes(current: DataFrame, previous: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """metric, current, previous and delta (one place) of the metrics that both audits have."""
    rows = lambda d, n: d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias(n)) for k in keys])).alias("x")).select("x.*").filter(F.col(n).isNotNull())
    return rows(current, "current").join(rows(previous, "previous"), "metric").withColumn("delta", F.round(F.col("current") - F.col("previous"), 1))


def alert(delta: DataFrame, score_now: float, score_before: float, lines: int = 5) -> DataFrame:
    """One row with the text of a regression alert, none where nothing regressed. Only its ``lines`` examples are gathered."""
    from .delta import summary

    s = summary(delta, score_now, score_before).filter("is_regression")
    new = delta.filter("status = 'new'").orderBy("fingerprint").limit(lines).agg(F.array_sort(F.collect_list(F.concat(F.lit("  ["), F.rpad("now", F.greatest(F.lit(6), F.length("now")), F.lit(" ")), F.lit("] "), F.substring("fingerprint", 1, 60)))).alias("examples"))
    head = F.format_string("REGRESSION ALERT\n\nScore: %s -> %s (%+.1f)\n\nNew issues: %d", F.lit(str(score_before)), F.lit(str(score_now)), F.lit(float(score_now - score_before)), F.col("new"))
    return s.withColumn("_k", F.lit(1)).join(new.withColumn("_k", F.lit(1)), "_k").select(F.array_join(F.concat(F.array(head), "examples"), "\n").alias("text"))  # one row each
