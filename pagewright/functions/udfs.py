"""User-defined table and aggregate functions for SQL users: the same results as the engine's expressions.

Expressions are faster and are what the engine itself uses; these are for queries written in SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

ROBOTS = T.StructType().add("line", T.IntegerType()).add("agent", T.StringType()).add("path", T.StringType())
PAGE = T.StructType().add("title", T.StringType()).add("lang", T.StringType()).add("h1", T.StringType()).add("words", T.IntegerType()).add("links", T.IntegerType())


@udtf(returnType=ROBOTS)
class ParseRobots:
    """The non-empty disallows of a robots.txt with the agent that they are for."""

    def eval(self, body: str):
        agent = "*"
        for i, line in enumerate((body or "").split("\n")):
            name, _, value = line.split("#")[0].strip().partition(":")
            if name.lower() == "user-agent":
                agent = value.strip()
            elif name.lower() == "disallow" and value.strip():
                yield i, agent, value.strip()


@udtf(returnType=PAGE)
class ParseHtml:
    """One row for a page: title, language, first heading, words and links."""

    def eval(self, html: str):
        import re
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__()
                self.title, self.lang, self.h1, self.links, self.words = [], None, [], 0, 0
                self.inside, self.silent, self.headings = None, 0, 0

            def handle_starttag(self, tag, attrs):
                a = dict(attrs)
                if tag == "html":
                    self.lang = self.lang or a.get("lang")
                if tag == "a" and a.get("href") and not re.match("#|mailto:|tel:|javascript:", a["href"]):
                    self.links += 1
                if tag in ("script", "style", "noscript"):
                    self.silent += 1
                if tag == "h1":
                    self.headings += 1
                if tag == "title" or (tag == "h1" and self.headings == 1):
                    self.inside = tag

            def handle_endtag(self, tag):
                if tag in ("script", "style", "noscript"):
                    self.silent -= 1
                if tag == self.inside:
                    self.inside = None

            def handle_data(self, data):
                if self.silent:
                    return
                self.words += len(re.findall(r"\w+", data))
                if self.inside:
                    (self.title if self.inside == "title" else self.h1).append(data)

        r = Reader()
        r.feed(html or "")
        r.close()
        yield "".join(r.title).strip() or None, r.lang, "".join(r.h1).strip() or None, r.words, r.links


@pandas_udf(T.LongType())
def simhash64(words: pd.Series) -> int:
    """The 64-bit SimHash of a group of words; 0 for none."""
    import hashlib

    import numpy as np

    known = words.dropna()
    if not len(known):
        return 0
    x = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big") for w in known], np.uint64)
    ones = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return int(np.bitwise_or.reduce(np.where(2 * ones >= len(x), np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))).astype(np.int64))


def register(spark: SparkSession) -> None:
    """Make them known to SQL, as parse_robots, parse_html and simhash64."""
    spark.udtf.register("parse_robots", ParseRobots)
    spark.udtf.register("parse_html", ParseHtml)
    spark.udf.register("simhash64", simhash64)
