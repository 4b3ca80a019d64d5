"""Page-speed payloads: scores, lab and field metrics, ratings and the vitals summary, by variant paths only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A payload's keys, and what is good and poor.
CATEGORIES = {"performance": "performance", "seo": "seo", "accessibility": "accessibility", "best_practices": "best-practices"}
LAB = {"lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift", "tbt": "total-blocking-time", "fcp": "first-contentful-paint", "si": "speed-index", "tti": "interactive"}
FIELD = {
    "lcp": "LARGEST_CONTENTFUL_PAINT_MS", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE", "inp": "INTERACTION_TO_NEXT_PAINT",
    "fcp": "FIRST_CONTENTFUL_PAINT_MS", "ttfb": "EXPERIMENTAL_TIME_TO_FIRST_BYTE",
}
THRESHOLDS = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "inp": (200, 500), "fcp": (1800, 3000), "ttfb": (800, 1800)}
FIELD_RATINGS = {"fast": "good", "average": "needs-improvement", "slow": "poor"}


def column(metric: str) -> str:
    return metric if metric == "cls" else f"{metric}_ms"


def rating(metric: str, value: Column) -> Column:
    """good up to the first threshold, poor from the second one on; null for no value, unknown for other metrics."""
    if metric not in THRESHOLDS:
        return F.lit("unknown")
    good, poor = THRESHOLDS[metric]
    return F.when(value <= good, "good").when(value < poor, "needs-improvement").when(value.isNotNull(), "poor")


def parse_speed(payloads: DataFrame) -> DataFrame:
    """The measurement of each row of ``payloads(url, strategy, status_code, body)``; ``error`` is set, and all else null, where the
    answer was not 200 or no JSON."""
    p = payloads.withColumn("_v", F.when(F.col("status_code") == 200, F.try_parse_json("body")))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    error = (
        F.when(F.col("status_code") == 429, "Rate limited (429)")
        .when(F.coalesce("status_code", F.lit(0)) != 200, F.concat(F.lit("HTTP "), F.coalesce("status_code", F.lit(0)), F.lit(": "), F.substring(F.coalesce("body", F.lit("")), 1, 200)))
        .when(F.col("_v").isNull(), "invalid JSON")
    )
    out = [F.col("url"), F.col("strategy"), error.alias("error")]
    out += [(get(f"$.lighthouseResult.categories['{key}'].score", "double") * 100).cast("int").alias(name) for name, key in CATEGORIES.items()]
    for name, key in LAB.items():
        out += [F.round(get(f"$.lighthouseResult.audits['{key}'].numericValue", "double"), 2).alias(column(name)), get(f"$.lighthouseResult.audits['{key}'].displayValue", "string").alias(f"{name}_display")]
    for name, key in FIELD.items():
        value = get(f"$.loadingExperience.metrics['{key}'].percentile", "double")
        word = F.replace(F.lower(get(f"$.loadingExperience.metrics['{key}'].category", "string")), F.lit("_"), F.lit("-"))
        known = F.create_map(*[F.lit(x) for kv in FIELD_RATINGS.items() for x in kv])
        out += [(F.round(value / 100, 3) if name == "cls" else value).alias(f"crux_{column(name)}"), F.coalesce(F.try_element_at(known, word), F.nullif(word, F.lit(""))).alias(f"crux_{name}_rating")]
    d = p.select(*out)
    return d.withColumn("has_field_data", F.coalesce(*[F.col(f"crux_{column(n)}") for n in FIELD]).isNotNull())


def vitals(measurements: DataFrame) -> DataFrame:
    """url, strategy, metric, value, rating and source of the core vitals: field data first, then lab data (interaction delay has none)."""
    rows = []
    for m in ("lcp", "cls", "inp"):
        field = F.col(f"crux_{column(m)}")
        lab = F.col(column(m)) if m != "inp" else F.lit(None).cast("double")
        value = F.coalesce(field, lab)
        rows.append(F.when(value.isNotNull(), F.struct(F.lit(m).alias("metric"), value.alias("value"), F.when(field.isNotNull(), F.col(f"crux_{m}_rating")).otherwise(rating(m, lab)).alias("rating"), F.when(field.isNotNull(), "field").otherwise("lab").alias("source"))))
    return measurements.select("url", "strategy", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("url", "strategy", "x.*")
