"""Web services as a Spark data source: each row of the result is one request's answer, parsed afterwards by expressions.

    spark.dataSource.register(Requests)
    answers = spark.read.format("requests").option("requests", as_option(speed_requests(urls, key))).load()

Options: ``requests`` (a JSON list of {url, method, body, headers, name}), ``batch`` (requests a partition, 20), ``threads`` (at a time in a
partition, 2), ``timeout`` (seconds, 60). One row a request, in its order: a request that fails has status 0 and its error, and does
not end the others. Secrets belong into headers given by the caller; nothing is read from the environment.
"""

from __future__ import annotations

import json
from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import exists, staged

SCHEMA = "ord int, name string, url string, status_code int, fetch_ms int, body string, error string"
#: services' addresses, feeds, limits.
SPEED_SERVICE = "https://www.googleapis.com/pagespeedonline/v5/runPagespeed"
SPEED_CATEGORIES = ("performance", "seo", "accessibility", "best-practices")
SEARCH_SERVICE = "https://www.googleapis.com/webmasters/v3/sites/{site}/searchAnalytics/query"
SEARCH_DIMENSIONS = ("query", "page", "device", "country")
SEARCH_ROWS, SEARCH_DAYS = 25_000, 28
FEEDS = {
    "google_search_central": "https://developers.google.com/search/blog/rss.xml",
    "google_status": "https://status.search.google.com/en/summary.rss",
    "search_engine_journal": "https://www.searchenginejournal.com/feed/",
    "search_engine_land": "https://searchengineland.com/feed",
    "moz_blog": "https://feedpress.me/mozblog",
    "ahrefs_blog": "https://ahrefs.com/blog/rss.xml",
    "web_dev_blog": "https://web.dev/feed.xml",
    "chrome_developers": "https://developer.chrome.com/static/blog/rss.xml",
    "google_news_algo": "https://news.google.com/rss/search?q=google+algorithm+update&hl=en-US&gl=US&ceid=US:en",
    "google_news_cwv": "https://news.google.com/rss/search?q=core+web+vitals+INP&hl=en-US&gl=US&ceid=US:en",
    "google_news_geo": "https://news.google.com/rss/search?q=google+AI+overviews+SEO&hl=en-US&gl=US&ceid=US:en",
    "google_news_ai_crawlers": "https://news.google.com/rss/search?q=GPTBot+ClaudeBot+SEO&hl=en-US&gl=US&ceid=US:en",
}
TREND_KEYWORDS = 5


def send(request: dict, place: int, timeout: float) -> tuple:
    """One row of SCHEMA."""
    import time
    import urllib.error
    import urllib.request

    began, body = time.time(), request.get("body")
    ms = lambda: int(1000 * (time.time() - began))
    try:
        data = None if body is None else (body if isinstance(body, str) else json.dumps(body)).encode()
        headers = {"User-Agent": "pagewright"} | ({"Content-Type": "application/json"} if data else {}) | (request.get("headers") or {})
        asked = urllib.request.Request(request["url"], data, headers, method=request.get("method"))
        try:
            answer = urllib.request.urlopen(asked, timeout=timeout)
        except urllib.error.HTTPError as e:  # an answer, too
            answer = e
        with answer:
            text = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            return (place, request.get("name"), request["url"], answer.status, ms(), text, None)
    except Exception as e:  # a row of its own, as one request must not end the batch
        return (place, request.get("name"), request["url"], 0, ms(), None, f"{type(e).__name__}: {e}"[:500])


class Batch(InputPartition):
    def __init__(self, requests: list):
        self.requests = requests


class Reader(DataSourceReader):
    def __init__(self, options):
        self.requests = list(enumerate(json.loads(options.get("requests") or "[]")))
        self.batch, self.threads, self.timeout = int(options.get("batch", 20)), int(options.get("threads", 2)), float(options.get("timeout", 60))

    def partitions(self):
        return [Batch(self.requests[i : i + self.batch]) for i in range(0, len(self.requests), self.batch)] or [Batch([])]

    def read(self, partition):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.threads) as pool:
            yield from pool.map(lambda x: send(x[1], x[0], self.timeout), partition.requests)


class Requests(DataSource):
    @classmethod
    def name(cls):
        return "requests"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def as_option(requests: list[dict]) -> str:
    return json.dumps(requests)


def asked(spark: SparkSession, requests: list[dict], **options) -> DataFrame:
    """The answers to some requests."""
    spark.dataSource.register(Requests)
    r = spark.read.format("requests").option("requests", as_option(requests))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def speed_requests(urls: list[str], key: str | None = None, strategies: tuple[str, ...] = ("mobile", "desktop"), service: str = SPEED_SERVICE) -> list[dict]:
    """One request for each URL and strategy; the name holds both."""
    more = [("key", key)] if key else []
    return [{"name": json.dumps([u, s]), "url": f"{service}?{urlencode([('url', u), ('strategy', s), *[('category', c) for c in SPEED_CATEGORIES], *more])}"} for u in urls for s in strategies]


def speed_payloads(answers: DataFrame) -> DataFrame:
    """url, strategy, status_code and body, as the payload parser takes them; a failed request is an answer of status 0 with its error."""
    pair = F.from_json("name", "array<string>")
    return answers.select(F.get(pair, F.lit(0)).alias("url"), F.get(pair, F.lit(1)).alias("strategy"), "status_code", F.coalesce("body", "error").alias("body"))


def search_request(site: str, token: str, until: date, days: int = SEARCH_DAYS, rows: int = SEARCH_ROWS, service: str = SEARCH_SERVICE) -> dict:
    """The search-analytics request for the last ``days`` days."""
    from urllib.parse import quote

    body = {"startDate": (until - timedelta(days=days)).isoformat(), "endDate": until.isoformat(), "dimensions": list(SEARCH_DIMENSIONS), "rowLimit": rows}
    return {"name": site, "url": service.format(site=quote(site, safe="")), "method": "POST", "body": body, "headers": {"Authorization": f"Bearer {token}"}}


def search_facts(answers: DataFrame) -> DataFrame:
    """site, query, page, device, country, clicks, impressions and position from search-analytics answers; failed ones have no rows."""
    rows = "rows array<struct<keys:array<string>,clicks:double,impressions:double,position:double>>"
    r = answers.filter("status_code = 200").select(F.col("name").alias("site"), F.explode(F.from_json("body", rows)["rows"]).alias("r"))
    key = lambda i: F.get("r.keys", F.lit(i))
    return r.select("site", *[key(i).alias(n) for i, n in enumerate(SEARCH_DIMENSIONS)], F.col("r.clicks").cast("bigint").alias("clicks"), F.col("r.impressions").cast("bigint").alias("impressions"), F.coalesce("r.position", F.lit(0.0)).alias("position"))


def search_window(facts: DataFrame, until: str, days: int = SEARCH_DAYS, rows: int = SEARCH_ROWS) -> DataFrame:
    """Stored facts of the last ``days`` days, at most ``rows`` of them, those with most clicks first."""
    day = F.to_date(F.lit(until))
    d = facts.filter(F.col("date").between(F.date_sub(day, days), day))
    return d.orderBy(F.col("clicks").desc(), *SEARCH_DIMENSIONS).limit(rows)


def keyword_facts(facts: DataFrame) -> DataFrame:
    """query and page with clicks, impressions, position and the click rate in per cent, to two places."""
    d = facts.groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("position").alias("position"))
    return d.withColumn("ctr", F.round(F.col("clicks") / F.greatest(F.col("impressions"), F.lit(1)) * 100, 2))


def backlinks(site: str) -> None:
    """The search service tells no backlinks."""
    return None


def reachable(answers: DataFrame) -> DataFrame:
    """Whether each service that was asked let us in."""
    return answers.select("name", F.col("status_code").between(200, 299).alias("connected"), F.col("status_code").isin(401, 403).alias("denied"), "error")


def feed_requests(feeds: dict[str, str] = FEEDS) -> list[dict]:
    return [{"name": k, "url": u} for k, u in feeds.items()]


def feed_bodies(answers: DataFrame) -> DataFrame:
    """source and body of the feeds that answered."""
    return answers.filter("status_code = 200").select(F.col("name").alias("source"), "body")


def unseen(items: DataFrame, seen: DataFrame, key: str = "item_id") -> DataFrame:
    """New items, once each."""
    return items.dropDuplicates([key]).join(seen.select(key).distinct(), key, "left_anti")


def trend_key(project: Column, keywords: Column, geo: Column, timeframe: Column) -> Column:
    return F.concat_ws("::", project, F.substring(F.array_join(F.array_sort(keywords), ","), 1, 200), geo, timeframe)


def trend_questions(projects: DataFrame) -> DataFrame:
    """project_id, key and keywords (the first TREND_KEYWORDS) to ask for, or why not, from ``projects(project_id, keywords, geo, timeframe)``."""
    none = F.size(F.coalesce("keywords", F.array().cast("array<string>"))) == 0
    return projects.select("project_id", trend_key(F.col("project_id"), F.col("keywords"), F.col("geo"), F.col("timeframe")).alias("key"), F.slice("keywords", 1, TREND_KEYWORDS).alias("keywords"), F.when(none, "no keywords").alias("error"))


def cached(wanted: DataFrame, path: str, ask, now: str, hours: int = 24) -> DataFrame:
    """key, answer, error and fetched_at of ``wanted(key, ...)``: from the Parquet folder ``path`` where a stored answer still holds, else
    from ``ask`` (a function from the rows to ask for to (key, answer, error)), whose answers are appended. The last one of a key counts;
    an answer that was rate limited (429) is asked for again."""
    from ..operators.trends import fresh

    spark = wanted.sparkSession
    kind = "key string, answer string, error string, fetched_at timestamp"
    stored = spark.read.schema(kind).parquet(path) if exists(spark, path) else spark.createDataFrame([], kind)
    last = stored.groupBy("key").agg(F.max_by(F.struct("answer", "error", "fetched_at"), "fetched_at").alias("a")).select("key", "a.*")
    good = staged(fresh(last, now, hours).join(wanted.select("key").distinct(), "key", "left_semi"), "cached")
    new = staged(ask(wanted.join(good, "key", "left_anti")).select("key", "answer", "error", F.lit(now).cast("timestamp").alias("fetched_at")), "asked")
    new.write.mode("append").parquet(path)
    return good.unionByName(new)
