"""An audit's report: its sections as relations, and the page that shows them.

Every section is a small relation, cut to what is shown before it leaves the executors.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 15
STYLE = "body{font:15px/1.5 sans-serif;max-width:70em;margin:2em auto;padding:0 1em}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ddd;padding:.3em .6em;text-align:left}.high,.critical{color:#b00020}.medium{color:#8a5a00}.low{color:#555}"


def action_rows(ranked: DataFrame | None, issues: DataFrame, k: int = SHOWN) -> DataFrame:
    """The first actions: ranked issues, or plain ones where none were ranked."""
    if ranked is not None and not ranked.isEmpty():
        from .rank import order_columns

        return ranked.orderBy(*order_columns(), "type", "affected_url").limit(k).select("priority", "severity", "type", "affected_url", "effort_hours", "roi")
    return issues.orderBy("type", "affected_url").limit(k).select(F.lit(None).cast("string").alias("priority"), "severity", "type", "affected_url", F.lit(None).cast("double").alias("effort_hours"), F.lit(None).cast("double").alias("roi"))


def grade(score: float | None) -> str:
    return "unknown" if score is None else "good" if score >= 85 else "fair" if score >= 60 else "poor"


def sections(scores: DataFrame, severities: DataFrame, categories: DataFrame, actions: DataFrame, **more: DataFrame) -> dict[str, DataFrame]:
    """The sections in the order in which they are shown."""
    return {"Score": scores, "Issues by severity": severities, "Issues by category": categories, "Top actions": actions} | {k.replace("_", " ").capitalize(): v for k, v in more.items()}


def table(df: DataFrame, k: int) -> str:
    """At most k rows as an HTML table; every value is escaped."""
    rows = df.limit(k).collect()  # k rows
    if not rows:
        return "<p>Nothing found.</p>"
    show = lambda v: "" if v is None else escape(", ".join(map(str, v)) if isinstance(v, list) else str(v))
    mark = lambda c, v: f' class="{escape(str(v))}"' if c == "severity" and v else ""
    body = "".join("<tr>" + "".join(f"<td{mark(c, r[c])}>{show(r[c])}</td>" for c in df.columns) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(c.replace('_', ' '))}</th>" for c in df.columns) + f"</tr>{body}</table>"


def page(title: str, parts: dict[str, DataFrame], k: int = 50) -> str:
    """The report as one HTML document."""
    body = "".join(f"<section><h2>{escape(name)}</h2>{table(df, k)}</section>" for name, df in parts.items())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def write(spark, html: str, directory: str, name: str) -> str:
    """Write a report, and the same as ``latest.html``, into a folder of any file system that Spark knows; returns its path."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for n in (f"{name}.html", "latest.html"):
        p = fs_path(f"{directory.rstrip('/')}/{n}")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(html.encode()))
        out.close()
    return f"{directory.rstrip('/')}/{name}.html"
