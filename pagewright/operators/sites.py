"""Site files and URL relations: robots rules, sitemaps, redirects, canonicals, topic clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ur
from ..storage import staged

# Crawlers of AI services; asset paths.
AI_BOTS = ("GPTBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "Google-Extended", "anthropic-ai", "cohere-ai", "CCBot", "Bytespider", "FacebookBot")
#: Those that answer engines are checked for; another list than the one above.
ANSWER_BOTS = AI_BOTS[:-1]
ASSETS = r"(?i)/\.css|/\.js|/static/|/assets/|/_next/|/dist/|/bundle|/webpack"
PILLAR = "(1000 - 100 * depth) + word_count + 50 * internal_links"


def robots_rules(files: DataFrame, default: str = "*") -> DataFrame:
    """domain, line, agent, path of every non-empty disallow; an agent line holds until the next one, comments are cut.
    Lines before the first agent belong to ``default``."""
    lines = files.select("domain", F.posexplode(F.split("body", "\n")).alias("line", "t")).withColumn("t", tx.strip(F.split("t", "#")[0]))
    low = F.lower("t")
    value = tx.strip(F.regexp_extract("t", "^[^:]*:(.*)$", 1))
    d = lines.withColumn("own", F.when(low.startswith("user-agent:"), value)).withColumn("path", F.when(low.startswith("disallow:"), value))
    far = Window.partitionBy("domain").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("agent", F.coalesce(F.last("own", True).over(far), F.lit(default)))
    return d.filter("path <> ''").select("domain", "line", "agent", "path")


def robots_findings(files: DataFrame) -> DataFrame:
    """Per domain: blocked AI crawlers in order, those that answer engines are checked for (``answer_blocked``: comments are not
    cut there, and no agent holds at first), whether assets or everything are blocked, whether a sitemap is named."""
    r = robots_rules(files)
    among = lambda bots: F.array_contains(F.array(*[F.lit(b.lower()) for b in bots]), F.lower("agent"))
    whole = F.col("path") == "/"
    g = r.groupBy("domain").agg(
        F.array_sort(F.collect_set(F.when(whole & among(AI_BOTS), F.lower("agent")))).alias("blocked"),
        F.bool_or(F.col("path").rlike(ASSETS)).alias("assets_blocked"), F.bool_or((F.col("agent") == "*") & whole).alias("all_blocked"),
    )
    uncut = robots_rules(files.withColumn("body", F.replace("body", F.lit("#"), F.lit("%23"))), "")
    a = uncut.groupBy("domain").agg(F.array_sort(F.collect_set(F.when(whole & among(ANSWER_BOTS), F.lower("agent")))).alias("answer_blocked"))
    named = files.select("domain", F.col("body").rlike(r"(?im)^\s*sitemap:").alias("sitemap_named"))
    no, none = F.lit(False), F.array().cast("array<string>")
    return named.join(g, "domain", "left").join(a, "domain", "left").select("domain", "sitemap_named", F.coalesce("blocked", none).alias("blocked"), F.coalesce("assets_blocked", no).alias("assets_blocked"),
                                                                            F.coalesce("all_blocked", no).alias("all_blocked"), F.coalesce("answer_blocked", none).alias("answer_blocked"))


def parse_sitemap(files: DataFrame) -> DataFrame:
    """domain with urls (loc, lastmod, changefreq, priority), children, bytes and parse_error of sitemap documents."""
    entry = "array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
    schema = f"url {entry}, sitemap array<struct<loc:string>>, _corrupt_record string"
    x = files.withColumn("x", F.from_xml("body", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return x.select("domain", F.coalesce("x.url", F.array().cast(entry)).alias("urls"), F.coalesce(F.transform("x.sitemap", lambda s: s["loc"]), F.array().cast("array<string>")).alias("children"), F.coalesce(F.octet_length("body"), F.lit(0)).alias("bytes"), F.col("x._corrupt_record").isNotNull().alias("parse_error"))


def sitemap_tree(files: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """domain, loc, lastmod and level of the entries reached from ``roots(domain, url)`` through sitemap indexes, ``depth`` levels deep.

    ``files(domain, url, status_code, content_type, body)``; one that failed, is no XML or cannot be read has no entries. A level
    is a join of children with files."""
    good = files.filter("status_code = 200 AND contains(lower(coalesce(content_type, 'xml')), 'xml')")
    parsed = parse_sitemap(good.select(F.struct("domain", "url").alias("domain"), "body")).filter("NOT parse_error")
    parsed = staged(parsed.select(F.col("domain.domain").alias("domain"), F.col("domain.url").alias("url"), "urls", "children"), "sitemaps")
    level, out = roots.select("domain", "url").distinct(), None
    for i in range(depth + 1):
        here = level.join(parsed, ["domain", "url"])
        entries = here.select("domain", F.explode("urls").alias("u")).select("domain", "u.loc", "u.lastmod", F.lit(i).alias("level"))
        out = entries if out is None else out.unionByName(entries)
        level = here.select("domain", F.explode("children").alias("url")).distinct()
    return out


def sitemap_audit(urls: DataFrame, crawled: DataFrame, as_of: str, canonicals: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Per domain of ``urls(domain, loc, lastmod)``: counts of all, broken, stale, undated and non-canonical entries, in one pass.
    Entries meet crawls and canonicals by URL, or by the column ``key`` of all three, where each crawl of a URL has an entry of its own."""
    on = key or "loc"
    c = crawled.groupBy(F.col(key or "url").alias(on)).agg(F.max("status_code").alias("status"))
    d = urls.join(c, on, "left")
    d = d.join(canonicals.select(F.col(key or "url").alias(on), F.lit(True).alias("canon")).distinct(), on, "left") if canonicals is not None else d.withColumn("canon", F.lit(True))
    day = F.expr("try_to_date(substr(lastmod, 1, 10), 'yyyy-MM-dd')")
    return d.groupBy("domain").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(F.col("status") >= 300).alias("broken"), F.count_if(day < F.date_sub(F.to_date(F.lit(as_of)), 365)).alias("stale"),
        F.count_if(F.coalesce("lastmod", F.lit("")) == "").alias("undated"), F.count_if(F.col("canon").isNull()).alias("non_canonical"),
    )


def redirect_chains(hops: DataFrame, most: int = 10, starts: DataFrame | None = None) -> DataFrame:
    """start_url, path, final_url, final_status, hops and is_loop, from ``hops(url, status_code, location)``; a frontier that moves
    one hop a round, so hot targets are joined, never collected. A chain that has not ended after ``most`` hops ends where it is,
    with status 0. ``starts(url)``: where to start, else at every URL of ``hops``."""
    step = hops.select(F.col("url").alias("at"), "status_code", "location")
    live = (hops if starts is None else starts).select(F.col("url").alias("start_url"), F.col("url").alias("at"), F.array("url").alias("path"))
    done = None
    redirect = F.coalesce(F.col("status_code").between(300, 399), F.lit(False)) & (F.coalesce("location", F.lit("")) != "")
    onward = redirect & ~F.array_contains("path", F.col("location"))
    for i in range(most):
        j = staged(live.join(step, "at", "left"), "redirects")
        end = j.filter(~onward).select("start_url", "path", F.when(redirect, F.col("location")).otherwise(F.col("at")).alias("final_url"), F.coalesce("status_code", F.lit(0)).alias("final_status"), redirect.alias("is_loop"))
        done = end if done is None else done.unionByName(end)
        live = j.filter(onward).select("start_url", F.col("location").alias("at"), F.concat("path", F.array("location")).alias("path"))
        if live.isEmpty():
            break
    done = done.unionByName(live.select("start_url", "path", F.col("at").alias("final_url"), F.lit(0).alias("final_status"), F.lit(False).alias("is_loop")))
    return done.withColumn("hops", F.when(F.col("is_loop"), F.size("path")).otherwise(F.size("path") - 1))


def canonical_resolutions(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """url, canonical (both in canonical form), the signal it comes from (header, html, sitemap or the page itself), whether the
    page is listed in ``sitemap(loc)``, and the URLs of its language cluster."""
    header, html = F.nullif("http_link_canonical", F.lit("")), F.nullif("canonical", F.lit(""))
    url = ur.canonical_form(F.col("url"))
    cluster = F.transform(F.filter("hreflang", lambda x: F.coalesce(x["href"], F.lit("")) != ""), lambda x: ur.canonical_form(x["href"])) if "hreflang" in pages.columns else F.array().cast("array<string>")
    p = pages.select(url.alias("url"), ur.canonical_form(F.coalesce(header, html, F.col("url"))).alias("canonical"), F.when(header.isNotNull(), "header").when(html.isNotNull(), "html").alias("given"), cluster.alias("cluster"), "ord")
    if sitemap is None:
        p = p.withColumn("listed", F.lit(False))
    else:
        listed = sitemap.select(ur.canonical_form(F.col("loc")).alias("url"), F.lit(True).alias("listed")).distinct()
        p = p.join(listed, "url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    p = p.select("url", "canonical", F.coalesce("given", F.when(F.col("listed"), "sitemap").otherwise("self")).alias("signal"), "listed", "cluster", "ord")
    return p.groupBy("url").agg(F.max_by(F.struct("canonical", "signal", "listed", "cluster", "ord"), "ord").alias("r")).select("url", "r.*")  # the last page of a URL counts


def canonical_conflicts(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """url, type and severity of pages whose canonical is missing, redirects, fails, is not indexed, points on to another, is left
    out of the sitemap that has the page, or stands outside the page's language cluster."""
    res = canonical_resolutions(pages, sitemap)
    target = pages.groupBy(ur.canonical_form(F.col("url")).alias("canonical")).agg(F.max_by(F.struct("status_code", "robots_meta"), "ord").alias("t"))
    nxt = res.filter("url <> canonical").select(F.col("url").alias("canonical"), F.col("canonical").alias("onward"))
    j = res.join(target, "canonical", "left").join(nxt, "canonical", "left")
    if sitemap is None:
        j = j.withColumn("target_listed", F.lit(False))
    else:
        there = sitemap.select(ur.canonical_form(F.col("loc")).alias("canonical"), F.lit(True).alias("target_listed")).distinct()
        j = j.join(there, "canonical", "left").withColumn("target_listed", F.coalesce("target_listed", F.lit(False)))
    other = F.col("url") != F.col("canonical")
    s = F.col("t.status_code")
    made = [
        (F.col("signal").isin("self", "sitemap"), "canonical_missing", F.lit("medium")),
        (other & s.between(300, 399), "canonical_points_to_redirect", F.lit("high")),
        (other & (s >= 400), "canonical_points_to_error", F.when(s == 404, "critical").otherwise("high")),
        (other & F.col("listed") & ~F.col("target_listed"), "canonical_conflicts_sitemap", F.lit("medium")),
        (other & F.contains(F.lower(F.coalesce("t.robots_meta", F.lit(""))), F.lit("noindex")), "canonical_points_to_noindex", F.lit("high")),
        (other & F.array_contains("cluster", F.col("url")) & ~F.array_contains("cluster", F.col("canonical")), "canonical_conflicts_hreflang", F.lit("high")),
        (other & F.col("onward").isNotNull(), "canonical_chain", F.lit("medium")),
    ]
    return j.select("url", F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), sev.alias("severity"))) for c, t, sev in made]), lambda x: x.isNotNull())).alias("i")).select("url", "i.*")


def canonical_pairs(pages: DataFrame) -> DataFrame:
    """a and b (a before b) of pages of which one names the other as its canonical, by their URLs as crawled."""
    res = canonical_resolutions(pages).filter("url <> canonical").select("url", "canonical").distinct()
    as_crawled = pages.select(F.col("url").alias("crawled"), ur.canonical_form(F.col("url")).alias("form")).distinct()
    j = res.join(as_crawled.select(F.col("form").alias("url"), F.col("crawled").alias("x")), "url").join(as_crawled.select(F.col("form").alias("canonical"), F.col("crawled").alias("y")), "canonical")
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def path_clusters(pages: DataFrame) -> DataFrame:
    """url, cluster_id and what pillars are chosen by: pages of two path segments or more by their first one, two pages at least."""
    seg = ur.segments(F.col("url"))
    p = pages.select("url", "ord", "word_count", "internal_links", "title", F.size(seg).alias("depth"), F.concat(ur.netloc(F.col("url")), F.lit("/"), F.try_element_at(seg, F.lit(1))).alias("cluster_id")).filter("depth >= 2")
    return p.join(p.groupBy("cluster_id").agg(F.countDistinct("url").alias("size")).filter("size >= 2"), "cluster_id")


def cluster_summary(members: DataFrame) -> DataFrame:
    """Per cluster: size, pillar (highest score, ties to the first page), authority, share of linked pages, repeated title openings."""
    opening = F.nullif(F.lower(F.array_join(F.slice(F.split(tx.strip(F.coalesce("title", F.lit(""))), r"\s+"), 1, 3), " ")), F.lit(""))
    return members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("pages"), F.max_by("url", F.struct(F.expr(PILLAR).alias("s"), (-F.col("ord")).alias("o"))).alias("pillar"),
        F.least(F.lit(100), F.sum("internal_links") * 5).alias("authority"), F.round(F.count_if(F.col("internal_links") > 0) / F.count(F.lit(1)), 4).alias("linked"),
        ((F.count(opening) != F.countDistinct(opening)) & (F.count(opening) >= 2)).alias("cannibalised"),
    )
