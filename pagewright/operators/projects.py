"""Projects: read from and written to a settings file, filtered, scheduled; what an applier does with fixes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "project_id string, name string, domain string, tenant_id string, enabled boolean, schedule string, ord int"
#: Issue types that fixes are made for, that may be applied unasked, and what applies them.
FIXABLE = tuple("missing_title short_title long_title missing_meta_description short_meta_description long_meta_description missing_h1 missing_canonical canonical_missing missing_og_image missing_organization_schema low_ctr_opportunity striking_distance org_schema_no_sameas missing_robots_txt missing_sitemap_xml sitemap_no_lastmod missing_contact_page missing_about_page missing_security_headers".split())
ALLOWED = tuple("missing_title short_title long_title missing_meta_description short_meta_description long_meta_description missing_canonical canonical_missing missing_og_image missing_organization_schema missing_robots_txt missing_sitemap_xml org_schema_no_sameas".split())
APPLIERS = {"title": "missing_title short_title long_title", "description": "missing_meta_description short_meta_description long_meta_description", "canonical": "missing_canonical canonical_missing", "image": "missing_og_image", "schema": "missing_organization_schema", "robots": "missing_robots_txt", "sitemap": "missing_sitemap_xml"}
APPLIER_OF = {t: k for k, types in APPLIERS.items() for t in types.split()}


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a settings file: a JSON object {project id: settings}, or the plain mappings of YAML (two levels)."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a settings file
    found = json.loads(text) if text.lstrip().startswith("{") else _mappings(text)
    rows = [(k, str(v.get("name", k)), str(v.get("domain", "")), str(v.get("tenant_id", "default")), str(v.get("enabled", True)).lower() not in ("false", "no", "0"), v.get("schedule"), i) for i, (k, v) in enumerate(found.get("projects", found).items())]
    return spark.createDataFrame(rows, PROJECT)


def _mappings(text: str) -> dict:
    """Nested ``key: value`` lines by indentation, comments and quotes removed."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip().strip("\"'")
        stack[-1][1][key.strip("\"'")] = value if value else {}
        if not value:
            stack.append((depth, stack[-1][1][key.strip("\"'")]))
    return root


def exported(projects: DataFrame, kind: str = "json") -> str:
    """The projects as a settings file's text, JSON or YAML."""
    rows = {r["project_id"]: {c: r[c] for c in projects.columns if c not in ("project_id", "ord") and r[c] is not None} for r in projects.orderBy("ord").collect()}  # settings are few
    if kind == "json":
        return json.dumps({"projects": rows}, indent=2, ensure_ascii=False)
    show = lambda v: str(v).lower() if isinstance(v, bool) else json.dumps(v, ensure_ascii=False)
    return "projects:\n" + "".join(f"  {k}:\n" + "".join(f"    {n}: {show(v)}\n" for n, v in own.items()) for k, own in rows.items())


def listed(projects: DataFrame, tenant_id: str | None = None, enabled_only: bool = False) -> DataFrame:
    d = projects if tenant_id is None else projects.filter(F.col("tenant_id") == tenant_id)
    return d.filter("enabled") if enabled_only else d


def due(projects: DataFrame, last_runs: DataFrame, now: str, grace: int = 300) -> DataFrame:
    """Projects whose ``every`` seconds have passed since their last run, by ``now``: next_run, and whether it was missed by over ``grace`` seconds."""
    at = F.lit(now).cast("timestamp")
    d = projects.filter("enabled").join(last_runs, "project_id", "left")
    nxt = F.coalesce(F.timestamp_seconds(F.unix_timestamp("last_run") + F.col("every")), at)
    return d.withColumn("next_run", nxt).withColumn("due", nxt <= at).withColumn("misfired", F.unix_timestamp(at) - F.unix_timestamp(nxt) > grace)


def fixable(issues: DataFrame, k: int = 8, *order: str) -> DataFrame:
    """The first k issues that a fix is made for."""
    d = issues.filter(F.col("type").isin(*FIXABLE))
    return d.orderBy(*order).limit(k) if order else d.limit(k)


def fix_sources(fixes: DataFrame) -> DataFrame:
    """How many fixes there are, and how many come from a model and from templates."""
    return fixes.agg(F.count(F.lit(1)).alias("fixes_generated"), F.count_if(F.col("source") == "model").alias("fixes_from_model"), F.count_if(F.col("source") == "template").alias("fixes_from_template"))


def fix_plan(fixes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """What an applier would do: whether each fix is eligible (an allowed type, not of low priority), who applies it, or why not."""
    severity = F.lower(F.coalesce(F.nullif(F.col("priority"), F.lit("")), F.lit("low")))
    applier = F.try_element_at(F.create_map(*[F.lit(x) for kv in APPLIER_OF.items() for x in kv]), F.col("type"))
    d = fixes.withColumn("eligible", F.col("type").isin(*dict.fromkeys([*ALLOWED, *also])) & (severity != "low")).withColumn("applier", applier)
    return d.withColumn("fix_error", F.when(F.col("eligible") & applier.isNull(), "adapter cannot apply this type"))


def apply_counts(applied: DataFrame) -> DataFrame:
    """eligible, applied and failed fixes of ``applied(eligible, success)``."""
    good = F.col("eligible") & F.coalesce("success", F.lit(False))
    return applied.agg(F.count_if(F.col("eligible")).alias("fixes_eligible"), F.count_if(good).alias("fixes_applied"), F.count_if(F.col("eligible") & ~F.coalesce("success", F.lit(False))).alias("fixes_failed"))
