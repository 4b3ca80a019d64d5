"""Quality rules with adaptive thresholds.

Per document, four plain measures are taken over the whole text. For each language and source, mergeable quantile sketches
of three ratios give the quartiles that ordinary documents of that kind have; a document far above them (``fence`` spreads
over the upper quartile, and by at least ``margin``) is rejected. Groups of fewer than ``min_group`` documents use the sketch
of their language, and then the one of the whole corpus. Thresholds are joined to documents for the filter. Sketches merge by
partial aggregation, so a source with a third of all rows costs no task more than the others.

Edge cases: null and empty texts have no words and fail the base rule; null languages and sources are groups of their own;
repeated rows count and come back as often as they stand; an empty table gives an empty result; other columns are ignored,
whatever their names; ids, languages and sources may be of any type; texts may be of any length; a ratio equal to its threshold
is kept.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, staged, table

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FENCE, MIN_GROUP, ACCURACY = 4.0, 40, 10_000
#: Ratio: (numerator, denominator, least distance over the upper quartile).
RATIOS = {"symbols": ("n_symbols", "word_chars", 0.05), "duplicates": ("n_dup_lines", "n_words", 0.05), "repeats": ("n_repeat_words", "n_words", 0.10)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside any WINDOW-word window that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW)), strict=True))
    if len(set(windows)) == n:
        return 0
    count, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + WINDOW - max(end, i)
            end = i + WINDOW
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()  # bytes.split() parts at exactly the six ASCII spaces
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (of whatever types) and the MEASURES of each text."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        got = [measure(t) for t in c["text"]]
        return {k: c[k] for k in ("doc_id", "lang", "source")} | dict(zip(MEASURES, ([*x] for x in zip(*got, strict=True)), strict=True))

    own = docs.select("doc_id", "lang", "source", "text")
    return arrow_map(own, rows, T.StructType([*own.schema.fields[:3], *[T.StructField(n, T.LongType()) for n in MEASURES]]))


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE) -> DataFrame:
    """One row per (lang, source): the most that each ratio may be. All levels come from one pass of merged sketches."""
    for name, (a, b, _) in RATIOS.items():
        measured = measured.withColumn(f"r_{name}", F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    sketch = [F.percentile_approx(f"r_{n}", [0.25, 0.75], ACCURACY).alias(f"q_{n}") for n in RATIOS]
    levels = measured.rollup("lang", "source").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"), *sketch)
    limits = [F.when(F.col("_n") >= min_group, q[1] + F.greatest(F.lit(margin), (q[1] - q[0]) * fence)).alias(f"max_{n}") for n, (_, _, margin) in RATIOS.items() for q in [F.col(f"q_{n}")]]
    levels = levels.select("lang", "source", "_g", *limits)
    kind = levels.filter("_g = 0").drop("_g")
    language = levels.filter("_g = 1").select(F.col("lang").alias("_l"), *[F.col(f"max_{n}").alias(f"l_{n}") for n in RATIOS])
    corpus = levels.filter("_g = 3").select(*[F.col(f"max_{n}").alias(f"c_{n}") for n in RATIOS])
    both = kind.join(language, F.col("lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(corpus), F.lit(True), "left")  # corpus: one row
    return both.select("lang", "source", *[F.coalesce(f"max_{n}", f"l_{n}", f"c_{n}").alias(f"max_{n}") for n in RATIOS])


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the joined thresholds for each row of ``docs(doc_id, text, lang, source)``."""
    m = staged(measures(docs), "rule-measures")
    limits = thresholds(m, min_group, fence).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"max_{n}" for n in RATIOS])
    d = m.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for n, (a, b, _) in RATIOS.items():
        within &= F.coalesce(F.col(a) <= F.col(f"max_{n}") * F.col(b), F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & within).alias("kept"), *[f"max_{n}" for n in RATIOS])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop(*[f"max_{n}" for n in RATIOS])
