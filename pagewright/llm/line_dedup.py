"""Line dedup by distinct-site spread.

A line (trimmed, of at least ``min_words`` words) that stands on ``min_sites`` or more distinct sites is boilerplate. Each line
hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation. Where the estimate is far below the threshold the
line stays, far above it goes, and lines near the threshold get an exact distinct count. Boilerplate is removed from every
document but the one with the smallest id that has it, so its content is not lost.

Lines travel as 128-bit hashes (64 bits collide some ten thousand times among 1e12 lines); a line that a third of all documents
share is pre-aggregated before each shuffle, and the joins back to documents hold such keys on the side that adaptive execution
splits. All is done in DataFrame functions; texts are shuffled once, to meet the places of their boilerplate.

Edge cases: a null text has no lines and stays null; a null site is a site of its own; a null id is never the keeper; repeated
rows of a keeper both keep their lines; an empty table gives an empty result; blank and short lines always stay; other columns
are kept as they are, whatever their names, but for n_lines and n_removed, which are replaced; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, staged, table

MIN_SITES = 5
MIN_WORDS = 4
SKETCH_ERROR = 0.1


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, h2 and keeper (least doc_id) of the lines in ``lines(h, h2, site, doc_id)`` that stand on at least ``min_sites`` sites."""
    key = ["h", "h2"]
    spread = staged(lines.groupBy(*key).agg(F.approx_count_distinct("site", SKETCH_ERROR).alias("est"), F.min("doc_id").alias("keeper")).filter(F.col("est") * 2 >= min_sites), "line-spread")
    near = spread.filter(F.col("est") < 2 * min_sites).select(*key)
    exact = lines.join(near, key, "left_semi").groupBy(*key).agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("est") >= 2 * min_sites).select(*key, "keeper")
    return sure.unionByName(spread.join(exact.select(*key), key, "left_semi").select(*key, "keeper"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed added (they replace such columns)."""
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(site).cast("string").alias("site"))
    own = own.withColumn("k", F.xxhash64("row.doc_id", "row.text")).withColumn("k2", F.xxhash64("row.text", "row.doc_id"))
    trimmed = F.btrim(F.col("line"), F.lit(" \t\x0b\f\r"))
    lines = own.select(F.col("row.doc_id").alias("doc_id"), "k", "k2", F.coalesce("site", F.lit("\x00")).alias("site"), F.posexplode(F.split("row.text", "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.regexp_count("line", F.lit(SPACED_WORD)) >= min_words)
    lines = staged(lines.select("doc_id", "k", "k2", "pos", "site", F.xxhash64(trimmed).alias("h"), F.xxhash64(F.lit(1), trimmed).alias("h2")), "lines")
    found = boilerplate(lines, min_sites)
    gone = lines.join(found, ["h", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("k", "k2").agg(F.collect_set("pos").alias("gone"))
    marked = own.join(gone, ["k", "k2"], "left")
    text = F.col("row.text")
    # only texts that lose lines are cut, each once: as the argument of filter, not inside its lambda
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns_out = [left.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns]
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return marked.select(*columns_out, F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left (null: of the empty text)."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: {documents}: a table with doc_id, text and source. Ends with ld: its rows with kept (the text that is left), n_lines and n_removed.
LINES_SQL = r"""
dl AS (SELECT row_number() OVER () AS rid4, * FROM {documents}),
ll AS (SELECT rid4, doc_id, coalesce(source, chr(1)) AS site, i, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t
       FROM (SELECT rid4, doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM dl WHERE text IS NOT NULL)),
le AS (SELECT * FROM ll WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 4),
lb AS (SELECT t, min(doc_id) AS keeper FROM le GROUP BY t HAVING count(DISTINCT site) >= 5),
lg AS (SELECT rid4, list(i) AS gone FROM le JOIN lb USING (t) WHERE doc_id IS DISTINCT FROM keeper GROUP BY rid4),
ld AS (SELECT dl.*, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS kept,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
       FROM dl LEFT JOIN lg USING (rid4))"""

OP4_SQL = "WITH " + LINES_SQL.format(documents="documents").lstrip() + "\nSELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM ld"
