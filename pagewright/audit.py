"""A whole audit: the built-in stages, run over the frames that a caller has.

    frames = run_audit({"pages": parsed, "robots": robots, "facts": search_facts}, project)
    frames.all_issues(); frames.tables["scores"]; summary(frames, project)

Frames that a stage needs and that are not there make it be skipped, as a missing key or credential does:
pages(site, url, ord, ...): the parsed crawl; hops(url, status_code, location); sitemap(domain, loc, lastmod, pos) and sitemap_states;
robots(domain, status_code, body); files(domain, path, status_code, body); facts(query, page, device, country, clicks, impressions,
position); speed: payloads; points and related: trends; items: news; projects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages
from .operators import audits, content, feed, fixes, impact, projects, rank, search, speed, suggest, trends, trust
from .plans import corpus_queries as issues_of
from .plans.rules import QUERY_RULES, SPEED_RULES, evaluate
from .stages import Frames, Skip, analyzer
from .storage import staged


def need(frames: Frames, *names: str) -> list[DataFrame]:
    for n in names:
        if n not in frames.tables:
            raise Skip(f"no {n}")
    return [frames.tables[n] for n in names]


@analyzer("pages")
def _pages(f: Frames) -> DataFrame:
    return issues_of.page_issues(*need(f, "pages"))


@analyzer("canonical")
def _canonical(f: Frames) -> DataFrame:
    return issues_of.canonical_issues(need(f, "pages")[0], f.tables.get("sitemap"))


@analyzer("redirects")
def _redirects(f: Frames) -> DataFrame:
    return issues_of.redirect_issues(*need(f, "pages", "hops"))


@analyzer("links")
def _links(f: Frames) -> DataFrame:
    return issues_of.link_issues(*need(f, "pages"))


@analyzer("robots")
def _robots(f: Frames) -> DataFrame:
    return issues_of.robots_issues(*need(f, "robots"))


@analyzer("sitemap")
def _sitemap(f: Frames) -> DataFrame:
    return issues_of.sitemap_issues(*need(f, "pages", "sitemap", "sitemap_states"))


@analyzer("schema")
def _schema(f: Frames) -> DataFrame:
    return issues_of.schema_issues(*need(f, "pages"))


@analyzer("trust")
def _trust(f: Frames) -> DataFrame:
    return trust.trust_issues(*need(f, "pages"))


@analyzer("files")
def _files(f: Frames) -> DataFrame:
    return issues_of.file_issues(*need(f, "files"))


@analyzer("clusters")
def _clusters(f: Frames) -> DataFrame:
    return issues_of.cluster_issues(need(f, "pages")[0], f.tables["members"])


@analyzer("duplicates")
def _duplicates(f: Frames) -> DataFrame:
    return issues_of.duplicate_issues(need(f, "pages")[0], f.tables["members"])


@analyzer("speed")
def _speed(f: Frames) -> DataFrame:
    m = speed.parse_speed(*need(f, "speed"))
    return evaluate(m.filter("error IS NULL"), SPEED_RULES, "url").withColumnRenamed("url", "affected_url")


#: Those of the analyzer stage, in order.
BUILT_IN = list(stages.ANALYZERS)


def analyzing(f: Frames) -> dict[str, DataFrame]:
    """Every source of issues over the crawl, and the crawl's totals."""
    p = staged(need(f, "pages")[0], "pages")
    f.tables |= {"pages": p, "members": staged(issues_of.cluster_members(p), "members")}
    inner = stages.analyze(Frames(tables=f.tables), [n for n in stages.ANALYZERS])
    f.log += [(f"analyzer/{n}", s, m) for n, s, m in inner.log]
    if not inner.issues:
        raise Skip("no analyzer had its frames")
    return {"issues": audits.combined(inner.issues).drop("source"), "crawl_metrics": audits.crawl_metrics(p, "site")}


def keyword(f: Frames) -> dict[str, DataFrame]:
    """Issues of search queries and the totals of all."""
    (facts,) = need(f, "facts")
    found = evaluate(search.by_query(facts), QUERY_RULES, "query", "clicks", "impressions", "position")
    found = found.withColumn("estimated_clicks", F.floor(F.col("impressions") * 0.05).cast("bigint"))
    return {"issues": found.withColumn("title", opportunity(F.col("query"), F.col("position"), F.col("clicks"), F.col("impressions"))), "search_totals": search.totals(facts), "top_queries": search.top(facts, "query")}


def opportunity(query, position, clicks, impressions):
    """A line about a search term: position to one place, click rate to two."""
    return F.format_string("'%s' at position %.1f, CTR %.2f%%", query, position.cast("double"), (100 * clicks / F.greatest(impressions, F.lit(1))).cast("double"))


def trending(f: Frames) -> dict[str, DataFrame]:
    r = trends.rising(*need(f, "points", "related"))
    return {"rising": r, "insights": trends.insights(r)}


def scoring(scorer: Callable[[list[str]], list[str]] | None) -> stages.Stage:
    """The stage that has keywords scored by a model behind a function."""

    def stage(f: Frames) -> dict[str, DataFrame]:
        if scorer is None:
            raise Skip("no scorer")
        facts, pages = need(f, "facts", "pages")
        k = search.scored_keywords(facts).select(F.col("query").alias("keyword"), "position", "impressions", "clicks")
        k = k.join(facts.groupBy(F.col("query").alias("keyword")).agg(F.max_by("page", "clicks").alias("url")), "keyword")
        got = staged(content.scored(k, pages, scorer), "scores")  # asked once
        return {"issues": content.content_issues(got), "content_scores": got, "content_averages": content.averages(got)}

    return stage


def strategy(f: Frames) -> dict[str, DataFrame]:
    """The issues with effort, return and priority, in place of all."""
    every = f.all_issues()
    if every is None:
        raise Skip("no issues")
    every = staged(every, "issues")
    ranked = rank.ranked(every)
    return {"issues": ranked, "scores": rank.score(["site"], every.filter("site IS NOT NULL")), "severities": audits.severity_counts(every), "categories": audits.category_counts(every), "actions": rank.top_actions(ranked, 10, "type", "affected_url")}


def contents(f: Frames) -> dict[str, DataFrame]:
    """Fixes by template for the first fixable issues of every site, and the two that every site gets."""
    every = f.all_issues()
    if every is None:
        raise Skip("no issues")
    named = every.filter("site IS NOT NULL").withColumns({"name": F.col("site"), "domain": F.concat(F.lit("https://"), "site", F.lit("/"))})
    first = projects.fixable(named, 8, *rank.order_columns(), "type", "affected_url") if "roi" in named.columns else projects.fixable(named, 8, "type", "affected_url")
    made = suggest.template_fixes(first).unionByName(suggest.general_fixes(named.select("name", "domain").distinct()))
    return {"fixes": made, "fix_counts": projects.fix_sources(made)}


def applying(enabled: bool, also: tuple[str, ...] = ()) -> stages.Stage:
    """The stage that plans which fixes are applied and patches the heads of the pages that have one; files are the caller's to write."""

    def stage(f: Frames) -> dict[str, DataFrame]:
        if not enabled:
            raise Skip("not enabled")
        if "content" not in f.fixes:
            raise Skip("no fixes")
        plan = projects.fix_plan(f.fixes["content"], also)
        done = plan.withColumn("success", F.col("eligible") & F.col("applier").isNotNull())
        out = {"fix_plan": plan, "apply_counts": projects.apply_counts(done)}
        if "html" in f.tables:  # url, html
            titles = plan.filter("eligible AND applier = 'title'").groupBy("url").agg(F.min("suggestion").alias("title"))
            out["patched"] = f.tables["html"].join(titles, "url").select("url", fixes.with_title(F.col("html"), F.col("title")).alias("html"))
        return out

    return stage


def intelligence(f: Frames) -> dict[str, DataFrame]:
    """Confirmed events of the news, their impacts on projects, and alerts for critical ones."""
    items, owned = need(f, "items", "projects")
    k = feed.classified(items, F.concat_ws(" ", "title", "summary"))
    events = staged(feed.confirmed_events(k, "item_id", "published"), "events")
    found = impact.impacts(events, owned)
    bare = events.select("event_id", F.col("keyword").alias("title"), "priority", F.array(F.concat(F.col("n_sources").cast("string"), F.lit(" sources"))).alias("sources"))
    return {"events": events, "impacts": found, "alerts": impact.alerts(impact.critical(bare), found)}


def run_audit(tables: dict[str, DataFrame], scorer: Callable[[list[str]], list[str]] | None = None, apply: bool = False) -> Frames:
    """All stages in order over the tables given."""
    order = [("analyzer", analyzing), ("keyword", keyword), ("intent", scoring(scorer)), ("trends", trending), ("strategy", strategy), ("content", contents), ("apply", applying(apply)), ("intelligence", intelligence)]
    return stages.run(order, Frames(tables=dict(tables)))


def summary(frames: Frames, project: dict | None = None) -> dict:
    """What an audit comes to, as plain values: score by site, issues by severity and category, stages."""
    t = frames.tables
    pairs = lambda name: {r[0]: r[1] for r in t[name].collect()} if name in t else {}  # noqa: E731  # a row a kind
    scores = {r["site"]: r["score"] for r in t["scores"].orderBy("score", "site").limit(1000).collect()} if "scores" in t else {}
    by = pairs("severities")
    return {"project": project or {}, "scores": scores, "issues_total": sum(by.values()), "issues_by_severity": by, "issues_by_category": pairs("categories"), "fixes_total": sum(d.count() for d in frames.fixes.values()), "stages": {n: {"status": s, "message": m} for n, s, m in frames.log}}


def event_json(events: DataFrame) -> DataFrame:
    """Events as JSON texts, without their nulls."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("json"))


def filled_values(measurements: DataFrame) -> DataFrame:
    """Measurements as JSON texts of what was measured."""
    return event_json(measurements)


def response(data: object = None, error: str | None = None) -> dict:
    """The envelope that answers to callers come in."""
    return {"success": error is None, "data": data, "error": error}
