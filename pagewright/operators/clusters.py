"""Topic clusters by title keywords, their merge with path clusters, coverage gaps, and headings that compete across clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import staged


def keyword_members(pages: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """site, cluster_id, first (place of the cluster's first pair), url and ord for ``pages(site, url, ord, title, h1)``.

    Two pages that share 2 keywords or more meet in the cluster named after the first 3 shared ones. Pages with equal keywords are
    one class, so copies make no pairs; and each class leaves out its most frequent keyword when classes look for each other, as
    two classes that share two words share another one as well.
    """
    words = F.array_sort(tx.keywords(F.concat_ws(" ", "title", F.try_element_at("h1", F.lit(1))), stop))
    p = pages.groupBy("site", "url").agg(F.max_by(words, "ord").alias("kw"), F.min("ord").alias("ord")).filter("size(kw) >= 2")
    p = staged(p.withColumn("key", F.array_join("kw", " ")), "cluster-keywords")
    place = F.row_number().over(Window.partitionBy("site", "key").orderBy("ord", "url"))
    heads = p.withColumn("r", place).filter("r <= 2").groupBy("site", "key").agg(F.first("kw").alias("kw"), F.min("ord").alias("o1"), F.max(F.when(F.col("r") == 2, F.col("ord"))).alias("o2"))
    heads = staged(heads, "cluster-classes")
    w = heads.select("site", "key", F.explode("kw").alias("word"))
    w = w.join(w.groupBy("site", "word").agg(F.count(F.lit(1)).alias("n")), ["site", "word"])
    w = w.withColumn("r", F.row_number().over(Window.partitionBy("site", "key").orderBy(F.col("n").desc(), F.col("word").desc()))).filter("r > 1 AND n > 1").select("site", "word", "key")
    pairs = w.withColumnRenamed("key", "a").join(w.withColumnRenamed("key", "b"), ["site", "word"]).filter("a < b").select("site", "a", "b").distinct()
    side = lambda s: heads.select("site", F.col("key").alias(s), F.col("kw").alias("k" + s), F.col("o1").alias("o" + s))
    both = pairs.join(side("a"), ["site", "a"]).join(side("b"), ["site", "b"]).withColumn("shared", F.array_sort(F.array_intersect("ka", "kb"))).filter("size(shared) >= 2")
    name = lambda c: F.concat(F.lit("keyword_"), F.array_join(F.slice(c, 1, 3), "_"))
    met = both.select("site", name("shared").alias("cluster_id"), F.struct(F.least("oa", "ob").alias("i"), F.greatest("oa", "ob").alias("j")).alias("first"), F.explode(F.array("a", "b")).alias("key"))
    met = met.unionByName(heads.filter("o2 IS NOT NULL").select("site", name("kw").alias("cluster_id"), F.struct(F.col("o1").alias("i"), F.col("o2").alias("j")).alias("first"), "key"))
    met = staged(met.groupBy("site", "cluster_id", "key").agg(F.min("first").alias("first")), "cluster-met")
    first = met.groupBy("site", "cluster_id").agg(F.min("first").alias("first"))
    return met.select("site", "cluster_id", "key").join(first, ["site", "cluster_id"]).join(p.select("site", "key", "url", "ord"), ["site", "key"]).drop("key")


def merged(taken: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """site, cluster_id and url left to the clusters of ``members(site, cluster_id, first, url)``, in the order of ``first``: each gets its
    URLs that no path cluster (``taken(site, url)``) and no earlier cluster has, and falls away below ``least`` of them.

    In a round every cluster is settled that comes first for all of its URLs, so clusters that do not touch go side by side.
    """
    left = staged(members.join(taken.select("site", "url").distinct(), ["site", "url"], "left_anti").select("site", "cluster_id", F.struct("first", "cluster_id").alias("o"), "url").distinct(), "cluster-left")
    out = None
    while not left.isEmpty():
        lead = left.groupBy("site", "url").agg(F.min("o").alias("lead"))
        c = left.join(lead, ["site", "url"]).groupBy("site", "cluster_id").agg(F.bool_and(F.col("o") == F.col("lead")).alias("settled"), F.count(F.lit(1)).alias("n")).filter("settled")
        kept = staged(left.join(c.filter(F.col("n") >= least), ["site", "cluster_id"], "left_semi").select("site", "cluster_id", "url"), "cluster-kept")
        out = kept if out is None else out.unionByName(kept)
        rest = left.join(c, ["site", "cluster_id"], "left_anti").join(kept, ["site", "url"], "left_anti")
        left = staged(rest, "cluster-left")
    return left.select("site", "cluster_id", "url") if out is None else out


def coverage_gaps(labels: DataFrame, members: DataFrame, keywords: DataFrame, k: int = 10, within: tuple[str, ...] = ()) -> DataFrame:
    """cluster_id and the first k queries (by ``ord``) of ``keywords(query, page, impressions, ord)`` that share a word with the cluster's
    label, have 30 impressions, and rank on none of its pages. Labels and keywords meet only where the columns ``within`` of both are equal."""
    query = F.lower("query")
    parts = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    asked = keywords.filter("impressions >= 30").select(*within, query.alias("query"), "ord", F.explode(parts("query")).alias("w"))
    near = labels.select(*within, "cluster_id", F.explode(parts("label")).alias("w")).join(asked, [*within, "w"]).groupBy("cluster_id", "ord").agg(F.first("query").alias("query"))
    ranks = keywords.select(query.alias("query"), F.col("page").alias("url")).join(members.select("cluster_id", "url"), "url").select("cluster_id", "query").distinct()
    open_ = near.join(ranks, ["cluster_id", "query"], "left_anti")
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("ord"))).filter(F.col("rank") <= k).select("cluster_id", "query", "rank")


def competing_headings(pages: DataFrame, members: DataFrame, site: Column, first: bool = False) -> DataFrame:
    """site, h1, pages and groups (with ``first`` also first_url, by ``ord``) of first headings (over 5 letters, in lower case) on pages of two clusters or more; a page in no cluster is one of its own."""
    p = pages.select(site.alias("site"), "url", *(["ord"] if first else []), tx.strip(F.lower(F.try_element_at("h1", F.lit(1)))).alias("h1")).filter("length(h1) > 5")
    m = members.groupBy("url").agg(F.max("cluster_id").alias("cluster_id"))
    g = p.join(m, "url", "left").groupBy("site", "h1").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(F.coalesce("cluster_id", F.concat(F.lit("_none_"), "url"))).alias("groups"), *([F.min_by("url", "ord").alias("first_url")] if first else []))
    return g.filter("pages >= 2 AND groups >= 2")


def lonely_pages(pages: DataFrame, members: DataFrame, site: str = "site", floor: int = 200) -> DataFrame:
    """site and url of pages of over ``floor`` words in no cluster, of sites that have clusters."""
    clustered = members.select("url").distinct()
    having = pages.select(site, "url").join(clustered, "url", "left_semi").select(site).distinct()
    return pages.filter(F.col("word_count") > floor).join(clustered, "url", "left_anti").join(having, site, "left_semi").select(site, "url")


def unclustered_sites(pages: DataFrame, members: DataFrame, site: str = "site", least: int = 5) -> DataFrame:
    """site and the URL of the first page of sites with at least ``least`` pages and no cluster."""
    having = pages.select(site, "url").join(members.select("url").distinct(), "url", "left_semi").select(site).distinct()
    return pages.groupBy(site).agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "ord").alias("url")).filter(F.col("n") >= least).join(having, site, "left_anti").select(site, "url")


def label(cluster_id: Column) -> Column:
    """A cluster's name in words: what follows its site and kind, with capitals."""
    return tx.title_case(F.regexp_replace(F.regexp_replace(cluster_id, "^(.*/|keyword_|path_)", ""), "[-_]", " "))
