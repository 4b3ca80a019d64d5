"""Mixing sources to target weights: a time-varying curriculum in DataFrame operations only.

Each source gets a target number of words by weight, held at ``max_repeats`` times its own size; what is cut off is shared
again by weight (water filling, in closed form over the sources sorted by where they are cut). A source's weight follows a
linear schedule 1 + slope * (2t - 1) over the training time t in 0..1. Its integral F(t) = t + slope * (t^2 - t) says which
share of the source's target is demanded by time t; inverting F at a document's cumulative share of the target gives the
time at which the document is trained on. Each of its passes has its own share, one source size further on, and so its own
time. Documents are then range-sorted by their first position, or their passes each by its own (``training_order``).

Cumulative sums are taken in two levels (source and a hash bucket, then inside the bucket), so a source that holds a third of
all rows is spread over ``16 ** bucket_digits`` groups and no group grows to the size of its source. Words are counted once and
stored without the text. Sources are few (corpora, not hosts): their targets are worked out in one small task.

Edge cases: a null or wordless text has size 0 and takes nothing; a null source is a source of its own, last in order;
repeated rows are separate documents; an empty table gives an empty result; other columns are kept by ``curriculum`` unless
their names clash with its outputs, in which case the output wins; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, staged, table

WEIGHTS = (5, 2, 1)
#: Schedule slopes, repeating over the sources in order: early sources fade, later ones grow.
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
BUCKET_DIGITS = 3
OUTPUTS = ("size", "source_size", "target", "taken", "passes", "position")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sizes(source, source_size)``: weight, slope and target. Sources are few; sums over them are small."""
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("_i") % len(values) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_i", F.row_number().over(order) - 1)
    s = s.withColumn("weight", pick(weights, "double")).withColumn("slope", pick(slopes, "double"))
    s = s.withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    by_cut = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_i").asc())
    upto = by_cut.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(every).cast("double")).withColumn("_weights", F.sum("weight").over(every))
    s = s.withColumn("_cap_before", F.sum("_cap").over(upto) - F.col("_cap")).withColumn("_w_before", F.sum("weight").over(upto) - F.col("weight"))
    s = s.withColumn("_level", (F.col("_total") - F.col("_cap_before")) / (F.col("_weights") - F.col("_w_before")))
    # the water level: at the first source, in order of where sources are cut, that is not cut
    s = s.withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    s = s.withColumn("_n", F.row_number().over(by_cut)).withColumn("_at", F.min(F.when(F.col("_free"), F.col("_n"))).over(every))
    s = s.withColumn("_water", F.max(F.when(F.col("_n") == F.col("_at"), F.col("_level"))).over(every))
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap"))))
    return s.select("source", "source_size", "weight", "slope", "target")


def _placed(docs: DataFrame, weights: tuple[int, ...], slopes: tuple[float, ...], max_repeats: int, bucket_digits: int) -> DataFrame:
    """Documents with OUTPUTS and positions, in no order."""
    keep = [c for c in docs.columns if c.lower() not in (*OUTPUTS, "positions", "text")]
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), word_count(F.col("text")).alias("size"), h.alias("_h"))
    d = staged(d, "mix-sizes").withColumn("doc_id", F.col("row.doc_id")).withColumn("_source", F.col("row.source")).withColumn("_b", F.substring("_h", 1, bucket_digits))
    buckets = d.groupBy(F.col("_source").alias("source"), "_b").agg(F.sum("size").alias("_b_size"))
    prefix = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = buckets.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), (F.sum("_b_size").over(prefix) - F.col("_b_size")).alias("_b_start"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_b_size").alias("source_size")), weights, slopes, max_repeats)
    plan = before.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("_source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
    d = d.join(plan, d["_source"].eqNullSafe(plan["_s"]) & (d["_b"] == plan["_bb"]))
    start = F.col("_b_start") + F.col("_in")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    d = d.withColumn("_start", start).withColumn("_whole", whole)
    more = (F.col("size") > 0) & (2 * F.col("_start") + F.col("size") <= 2 * rest)
    d = d.withColumn("passes", F.when(F.col("size") > 0, F.col("_whole") + more.cast("bigint")).otherwise(0).cast("bigint"))
    a = F.col("slope")

    def position(n: Column) -> Column:
        """When a document's n-th pass comes: F inverted at the share of the target that the source has used up by then."""
        share = F.least(F.lit(1.0), ((n - 1) * F.col("source_size") + F.col("_start") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1e-9)))
        return F.when(F.abs(a) < 1e-9, share).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / F.when(F.abs(a) < 1e-9, 1.0).otherwise(2 * a))

    numbers = F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("passes"))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("positions", F.transform(numbers, position)).withColumn("position", F.get("positions", F.lit(0)))
    d = d.withColumn("taken", F.col("passes") * F.col("size"))
    return d.select(*[F.col(f"row.`{c}`") for c in keep], *OUTPUTS, "positions")


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """Documents with size, source_size, target, taken (words, repeats counted), passes, position (of the first pass, null if
    none) and positions (of each pass), range-sorted by position. ``docs`` needs doc_id, source and text; the text is read, not carried along."""
    return _placed(docs, weights, slopes, max_repeats, bucket_digits).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """The schedule itself: one row for each pass of each document that is taken, with size, pass and position, range-sorted by position."""
    d = _placed(docs, weights, slopes, max_repeats, bucket_digits)
    keep = [c for c in d.columns if c.lower() not in (*OUTPUTS, "positions", "pass")]
    d = d.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "size", F.posexplode("positions").alias("_n", "position"))
    return d.select(*[F.col(f"row.`{c}`") for c in keep], "size", (F.col("_n") + 1).cast("bigint").alias("pass"), "position").orderBy("position", "doc_id", "pass")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", *OUTPUTS)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "pass", "position")


#: A FROM clause's documents, weighed and mixed; also the last stage of the pipeline.
MIX_SQL = r"""
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s0),
s2 AS (SELECT *, ([5.0, 2.0, 1.0])[i % 3 + 1]::DOUBLE AS weight, ([-0.5, 0.0, 0.5])[i % 3 + 1]::DOUBLE AS slope, (source_size * 3)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER w AS n, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
       sum(cap) OVER (w ROWS UNBOUNDED PRECEDING) - cap AS cap_before, sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) - weight AS w_before
       FROM s2 WINDOW w AS (ORDER BY cap / weight, i)),
s4 AS (SELECT *, (total - cap_before) / (weights - w_before) AS level FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 AS x WHERE x.level * x.weight <= x.cap ORDER BY x.n LIMIT 1) AS water FROM s4),
s6 AS (SELECT source, source_size, slope, least(cap, coalesce(water * weight, cap)) AS target FROM s5),
c AS (SELECT doc_id, size, source_size, target, slope,
      sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start,
      CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
p AS (SELECT *, CASE WHEN size > 0 THEN whole + (2 * start + size <= 2 * (target - whole * source_size))::BIGINT ELSE 0 END AS passes,
      least(1.0, (start + size / 2) / greatest(target, 1e-9)) AS share FROM c)
SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken, passes::BIGINT AS passes,
       CASE WHEN passes > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN share
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END::DOUBLE AS position
FROM p"""

OP9_SQL = "WITH " + MIX_SQL.format(documents="documents").lstrip()
