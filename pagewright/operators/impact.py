"""What confirmed events of search engines mean for projects: event by project, risk, reports, alert texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .content import risk_answers
from .feed import heuristic_risk

#: Order of risks, and what to do where no answer was given.
RISKS = ("HIGH", "MEDIUM", "LOW")
ACTIONS = ("Check Google Search Console for ranking changes", "Review Core Web Vitals scores", "Monitor organic traffic for anomalies")


def risk_rank(risk: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, RISKS)), risk)
    return F.when(at == 0, len(RISKS) + 1).otherwise(at)


def critical(events: DataFrame) -> DataFrame:
    """The events that are worth an alert."""
    return events.filter("priority = 'critical'")


def impacts(events: DataFrame, projects: DataFrame, answers: DataFrame | None = None, most: int = 5) -> DataFrame:
    """event_id, priority, project_id, domain, ord, risk_level and actions of every event on the first ``most`` enabled projects (by
    ``ord``): as ``answers(event_id, project_id, answer)`` say, or by rule of thumb where there is no answer."""
    few = projects.filter("enabled").orderBy("ord").limit(most).select("project_id", "domain", "ord")  # at most ``most`` rows
    d = events.select("event_id", "priority").withColumn("_k", F.lit(1)).join(F.broadcast(few.withColumn("_k", F.lit(1))), "_k").drop("_k")
    actions = F.array(*map(F.lit, ACTIONS))
    if answers is None:
        return d.withColumn("risk_level", heuristic_risk(F.col("priority"))).withColumn("actions", actions)
    a = risk_answers(answers.filter("answer IS NOT NULL")).select("event_id", "project_id", F.col("risk_level").alias("_r"), F.col("actions").alias("_a"))
    d = d.join(a, ["event_id", "project_id"], "left")
    return d.withColumn("risk_level", F.coalesce("_r", heuristic_risk(F.col("priority")))).withColumn("actions", F.when(F.col("_r").isNotNull(), F.col("_a")).otherwise(actions)).drop("_r", "_a")


def worst(found: DataFrame) -> DataFrame:
    """The impact of highest risk of each event, the first project's on a tie."""
    return found.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "event_id"]), F.struct(risk_rank(F.col("risk_level")).alias("r"), F.col("ord"))).alias("w")).select("event_id", "w.*")


def latest_reports(reports: DataFrame) -> DataFrame:
    """Each project's last report of ``reports(project_id, analyzed_at, event_id, ...)``."""
    w = Window.partitionBy("project_id").orderBy(F.col("analyzed_at").desc(), "event_id")
    return reports.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def alerts(events: DataFrame, found: DataFrame, actions: int = 3, limit: int = 4096) -> DataFrame:
    """event_id and text: title, sources, a line for each project, the first actions for the one at most risk. At most five projects
    an event, so the lines are few."""
    lines = found.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "domain", "risk_level"))), lambda x: F.concat(F.lit("- "), x["domain"], F.lit(": "), x["risk_level"])).alias("lines"))
    d = events.join(lines, "event_id").join(worst(found).select("event_id", F.col("domain").alias("_d"), F.slice("actions", 1, actions).alias("_a")), "event_id")
    todo = F.concat(F.array(F.lit(""), F.concat(F.lit("What to do for "), "_d", F.lit(":"))), F.transform("_a", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))
    none = F.array().cast("array<string>")
    head = F.array(F.lit("ALGORITHM ALERT"), F.concat(F.col("title"), F.lit(" detected")), F.concat(F.lit("Confirmed by: "), F.array_join("sources", " + ")), F.lit(""), F.lit("Risk by project:"))
    text = F.array_join(F.concat(head, "lines", F.when(F.size("_a") > 0, todo).otherwise(none)), "\n")
    return d.select("event_id", F.substring(text, 1, limit).alias("text"))
