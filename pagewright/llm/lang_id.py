"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters) in order; a document's own most frequent n-grams are
compared with each profile by out-of-place distance, and the nearest profile names the language. Profiles are learned from a
bounded sample of labelled documents: about ``per_lang`` of each language, drawn by a hash of the id; counting is distributed
and merges by aggregation. Prediction reads every whole text.

The profiles are the model: ``k`` numbers for each language that occurs, however many those are. The table of sample shares, one
row a language, is broadcast if it has at most BROADCAST_LANGS rows, and joined by shuffle beyond.

Edge cases: a null text, or one without a letter, gets ``und`` with score 0, as does every text when nothing could be learned;
equal distances go to the language first in order; repeated rows are predicted alike; an empty table gives an empty result;
other columns are ignored, whatever their names; texts may be of any length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, split_remainder, staged, table

PROFILE = 300
PER_LANG = 2_000
BROADCAST_LANGS = 100_000
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 letters of a text's words, each word with an edge mark on either side, as numbers (21 bits a
    letter), and their counts."""
    t = "_" + NOT_LETTERS.sub("_", text.lower()).strip("_") + "_"
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    keys = np.concatenate([c, two, (two[:-1] << 21) | c[2:]])
    keys.sort()
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]]))
    keys, counts = keys[ends], np.diff(ends, prepend=-1)
    letters = keys != 95
    return keys[letters], counts[letters]


def ranked(keys: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams in order, ties by the n-gram."""
    if len(keys) > k:
        often = counts >= np.partition(counts, len(counts) - k)[len(counts) - k]
        keys, counts = keys[often], counts[often]
    return keys[np.argsort(-counts, kind="stable")][:k]


class Profile:
    def __init__(self, keys: list[int]):
        a = np.array(keys, np.int64)
        self.places = np.argsort(a).astype(np.int64)
        self.keys = a[self.places]

    def distance(self, own: np.ndarray, k: int) -> int:
        """How far the n-grams stand from their places here; k for each that is missing."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return int(np.where(self.keys[at] == own, np.abs(self.places[at] - np.arange(len(own))), k).sum())


def learn_profiles(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, k: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages among the rows where ``learn`` holds, as {lang: n-grams in order}."""
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", unit.alias("unit"))
    share = staged(labelled.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share")), "language-shares")
    # broadcast, so that texts are not dealt out by language
    few = share.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    sample = labelled.join(F.broadcast(share) if few else share, "lang").filter("unit < share")

    def rows(c: dict[str, list]) -> dict[str, list]:
        flat = [[], [], []]
        by: dict[str, list] = {}
        for lang, text in zip(c["lang"], c["text"], strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, found in by.items():
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
            for column, values in zip(flat, ([lang] * len(keys), keys.tolist(), n.tolist()), strict=True):
                column += values
        return dict(zip(("lang", "gram", "n"), flat, strict=True))

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    counts = arrow_map(sample.select("lang", "text"), rows, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    found: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda x: (x["lang"], x["r"])):  # languages x profile length
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def predict(text: str | None, profiles: list[tuple[str, Profile]], k: int = PROFILE) -> tuple[str, float]:
    if text is None or not profiles or not LETTER.search(text):
        return "und", 0.0
    own = ranked(*grams(text), k)
    best, lang = min(((p.distance(own, k), lang) for lang, p in profiles), key=lambda x: x[0])
    return lang, max(0.0, 1.0 - best / (k * len(own)))


def language_id(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, k: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs(doc_id, text, lang)``; learns where ``learn`` holds."""
    profiles = learn_profiles(docs, learn, per_lang, k)
    places = [(name, Profile(p)) for name, p in sorted(profiles.items())]  # the model
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def rows(c: dict[str, list]) -> dict[str, list]:
        got = [predict(t, sent.value, k) for t in c["text"]]
        return {"doc_id": c["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs.select("doc_id", "text"), rows, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    r = split_remainder("doc_id", 5)
    return language_id(docs, r != 0).select("doc_id", (r == 0).alias("held_out"), "lang_pred", "score")
