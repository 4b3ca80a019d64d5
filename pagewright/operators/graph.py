"""Link graph: edges, degrees, orphans, click depth and PageRank over DataFrames."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import graph_form, netloc, path
from ..storage import staged, written

DAMPING, ITERATIONS = 0.85, 20


def vertices(pages: DataFrame) -> DataFrame:
    """url and status_code, one row per crawled URL (the last page of a URL counts)."""
    return pages.groupBy(graph_form(F.col("url")).alias("url")).agg(F.max_by("status_code", "ord").alias("status_code"))


def edges(pages: DataFrame) -> DataFrame:
    """Distinct links without loops; targets may be uncrawled."""
    e = pages.select(graph_form(F.col("url")).alias("src"), F.explode("internal_link_urls").alias("t")).select("src", graph_form(F.col("t")).alias("dst"))
    return e.filter("dst <> '' AND dst <> src").distinct()


def homes(pages: DataFrame) -> DataFrame:
    """url of each host's home page: the first crawled page with an empty path, or the first crawled one where there is none."""
    inner = F.replace(path(F.col("url")), F.lit("/"), F.lit("")) != ""
    return pages.groupBy(netloc(F.col("url")).alias("host")).agg(F.min_by(graph_form(F.col("url")), F.struct(inner, F.col("ord"))).alias("url")).select("url")


def degrees(v: DataFrame, e: DataFrame) -> DataFrame:
    """in_degree and out_degree of every crawled URL, in one pass over the edges."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    n = ends.groupBy("url").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return v.join(n, "url", "left").select("url", "status_code", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def orphans(v: DataFrame, e: DataFrame, homepage: str) -> DataFrame:
    home = graph_form(F.lit(homepage))
    return v.filter((F.col("status_code") < 400) & (F.col("url") != home)).join(e.select(F.col("dst").alias("url")), "url", "left_anti").select("url")


def broken_links(pages: DataFrame, v: DataFrame) -> DataFrame:
    """Links to crawled error pages, each as often as it stands."""
    links = pages.select("url", F.explode("internal_link_urls").alias("t")).select("url", graph_form(F.col("t")).alias("dst"))
    bad = v.filter("status_code >= 400").select(F.col("url").alias("dst"), "status_code")
    return links.join(bad, "dst").select(F.col("url").alias("affected_url"), "dst", F.when(F.col("status_code") == 404, "high").otherwise("medium").alias("severity"))


def click_depth(e: DataFrame, homepage: str | DataFrame) -> DataFrame:
    """Least number of clicks from the homepage (or from the nearest of ``homes``); unreachable URLs are absent. One anti join a
    level, until a level has no new URL. The levels so far are one scan of their folders, so a level's plan doesn't grow with their number."""
    spark = e.sparkSession
    home = spark.range(1).select(graph_form(F.lit(homepage)).alias("url")) if isinstance(homepage, str) else homepage.select("url").distinct()
    e = staged(e, "links")  # read once a level
    read = spark.read.schema("url string, depth int").parquet
    levels = [written(home.withColumn("depth", F.lit(0)), "depth")]
    for level in count(1):
        seen, frontier = read(*levels), read(levels[-1]).filter(F.col("depth") == level - 1)
        new = e.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        at = written(new.select("url", F.lit(level).alias("depth")), "depth")
        if read(at).isEmpty():
            return seen
        levels.append(at)
        if level % 16 == 0:
            levels = [written(read(*levels), "depth")]  # so that long chains are not read from hundreds of folders


def pagerank(v: DataFrame, e: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, site: Column | None = None) -> DataFrame:
    """url and rank of crawled URLs. Links to uncrawled targets count in a page's out-degree; the mass of dead ends is lost.
    With ``site``, a column of ``v``, each site's ranks are those of its own graph; links don't lead from site to site."""
    if site is None:
        sized = v.select("url", F.lit(max(v.count(), 1)).alias("n"))
    else:
        s = v.select("url", site.alias("site"))
        sized = s.join(F.broadcast(s.groupBy("site").agg(F.count(F.lit(1)).alias("n"))), "site").select("url", "n")  # one row a site
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = staged(e.join(v.select(F.col("url").alias("dst")), "dst", "left_semi").join(out, "src").join(v.select(F.col("url").alias("src")), "src", "left_semi"), "rank-links")
    rank = staged(sized.select("url", "n", (1.0 / F.col("n")).alias("rank")), "rank")
    for i in range(iterations):
        sent = links.join(rank.select(F.col("url").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("url")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = rank.select("url", "n").join(sent, "url", "left").select("url", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = staged(rank, "rank")  # cuts the lineage
    return rank.select("url", "rank")
