"""Web pages as a Spark data source: each partition fetches a batch of URLs, so a lost executor's batch is fetched again.

    spark.dataSource.register(WebPages)
    raw = spark.read.format("web_pages").option("urls", "https://a.example/ https://a.example/b").load()

Options: ``urls`` (separated by white space), ``batch`` (URLs a partition, 50), ``threads`` (requests at a time in a partition, 4),
``timeout`` (seconds, 15), ``agent``. One row a URL: a request that fails has status 0 and its error; html is kept for answers with
status 200 and an HTML type only, up to 2,000,000 characters. An empty ``urls`` gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import url as ur

LIMIT = 2_000_000
SCHEMA = "url string, ord int, status_code int, fetch_ms int, final_url string, content_type string, response_bytes int, security_headers map<string,string>, http_link_canonical string, html string, error string"
# The headers that rules look at.
HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy")


def fetch(url: str, place: int, timeout: float, agent: str) -> tuple:
    """One row of SCHEMA."""
    import re
    import time
    import urllib.error
    import urllib.request

    began = time.time()
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        try:
            answer = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:  # an answer, too
            answer = e
        with answer:
            body, head, status, final = answer.read(), {k.lower(): v for k, v in answer.headers.items()}, answer.status, answer.url or url
            charset = answer.headers.get_content_charset() or "utf-8"
    except Exception as e:  # a row of its own, as one URL must not end the batch
        return (url, place, 0, int(1000 * (time.time() - began)), url, "", 0, {}, None, None, f"{type(e).__name__}: {e}"[:500])
    kind = head.get("content-type", "")
    html = None
    if status == 200 and "html" in kind:
        try:
            html = body.decode(charset, "replace")[:LIMIT]
        except LookupError:
            html = body.decode("utf-8", "replace")[:LIMIT]
    link = re.search(r'<([^>]+)>\s*;[^,]*\brel="?canonical"?', head.get("link", ""))
    return (url, place, status, int(1000 * (time.time() - began)), final, kind, len(body), {h: head[h] for h in HEADERS if h in head}, link and link.group(1), html, None)


class Batch(InputPartition):
    def __init__(self, urls: list[tuple[str, int]]):
        self.urls = urls


class Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [(u, i) for i, u in enumerate((options.get("urls") or "").split())]
        self.batch, self.threads = int(options.get("batch", 50)), int(options.get("threads", 4))
        self.timeout, self.agent = float(options.get("timeout", 15)), options.get("agent", "pagewright")

    def partitions(self):
        return [Batch(self.urls[i : i + self.batch]) for i in range(0, len(self.urls), self.batch)] or [Batch([])]

    def read(self, partition):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.threads) as pool:
            yield from pool.map(lambda x: fetch(*x, self.timeout, self.agent), partition.urls)


class WebPages(DataSource):
    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def discovered(roots: DataFrame, entries: DataFrame, home_links: DataFrame, limit: int = 20) -> DataFrame:
    """domain, url and place of the first ``limit`` URLs of each of ``roots(domain)``: the entries of its sitemap
    (``entries(domain, url, ord)``), or the links of its homepage where there are none; the root comes first unless it is among them."""
    root = roots.select(F.regexp_replace("domain", "/+$", "").alias("domain")).distinct()
    has_map = entries.select("domain").distinct()
    host = ur.netloc(F.col("domain"))
    links = home_links.join(has_map, "domain", "left_anti").filter((ur.netloc(F.col("url")) == host) & ur.scheme(F.col("url")).isin("http", "https"))
    found = entries.select("domain", "url", "ord").unionByName(links.select("domain", ur.without_fragment(F.col("url")).alias("url"), "ord")).join(root, "domain", "left_semi")
    rooted = found.filter((F.col("url") == F.col("domain")) | (F.col("url") == F.concat("domain", F.lit("/")))).select("domain").distinct()
    added = root.join(rooted, "domain", "left_anti").select("domain", F.col("domain").alias("url"), F.lit(-1).alias("ord"))
    one = found.unionByName(added).groupBy("domain", "url").agg(F.min("ord").alias("ord"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("ord", "url"))).filter(F.col("place") <= limit).select("domain", "url", "place")
