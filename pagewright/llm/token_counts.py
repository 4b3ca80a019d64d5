"""Token counts by a digest cache.

Normalised contents (null as empty, line ends as one sign, no white space at the ends, all of which this word tokenizer drops
anyway) are keyed by SHA-256 together with a digest of the tokenizer file. The distinct digests are looked up in the stored
counts by one join; only misses are encoded, each once, and their counts are appended to the cache, so a later run over the same
or a grown corpus encodes only what is new. The texts of misses meet their digests through a join on (digest, id) with unique
keys, so a content that a third of the corpus repeats is encoded once and loads no task.

Edge cases: null and empty texts have 0 tokens; repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored, whatever their names; very long texts are encoded whole; a null id is an id like others. Counts that two
runs at once have both appended are equal and count once.
"""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, shared_dir, staged, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])
_loaded: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def _encoder(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    t, out = _encoder(path), []
    for at in range(0, len(texts), 64):
        out += [len(x) for x in t.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
    return out


def normalised(text):
    """Byte operations only: no pattern is searched for in whole texts."""
    return F.btrim(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(" \t\n\r"))


def token_counts(docs: DataFrame, cache_path: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and digest per row of ``docs(doc_id, text)``. ``cache_path``: a Parquet folder of
    stored counts on storage that all executors see; read if it exists and appended to."""
    spark, path = docs.sparkSession, public_tokenizers.path(tokenizer)
    version = tokenizer_version(path)
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    keys = staged(text.select("doc_id", "n_bytes", F.sha2(F.col("text"), 256).alias("digest")), "token-keys")
    stored = _stored(spark, cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    looked = keys.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(stored, "digest", "left")
    looked = staged(looked, "token-lookup")
    misses = looked.filter("n_tokens IS NULL").select(F.col("digest").alias("miss"), "rep")
    found = text.withColumn("digest", F.sha2(F.col("text"), 256)).join(misses, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())])
    encoded = arrow_map(found.select("digest", "text"), lambda c: {"digest": c["digest"], "n_tokens": count_texts(c["text"], path)}, schema)
    fresh = staged(encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")  # rows may share id and text
    if cache_path:
        fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    out = keys.join(looked.filter("n_tokens IS NOT NULL").select("digest", "n_tokens").unionByName(fresh), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")


def _stored(spark: SparkSession, cache_path: str | None) -> DataFrame:
    if cache_path:
        p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(CACHE).parquet(cache_path)  # the files of now: what is appended later is not seen
    return spark.createDataFrame([], CACHE)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache in the shared folder. Each call begins a cache of its own, so that equal calls do equal work; pass
    ``token_counts`` a lasting ``cache_path`` to have later runs encode only what is new."""
    return token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
