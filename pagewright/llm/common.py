"""Shared helpers of the training-data operators: word rules, splits, staging tables, Arrow maps."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where that is unset and all
    runs on this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        at = getattr(spark.sparkContext, "_pagewright_dir", None)
        if not at:
            at = tempfile.mkdtemp(prefix="pagewright-")
            spark.sparkContext._pagewright_dir = at
            atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made of them has been staged itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if not getattr(sc, "_pagewright_shipped", False):
        sc._pagewright_shipped = True
        top = Path(__file__).resolve().parents[1]
        at = tempfile.mkdtemp(prefix="pagewright-code-")
        atexit.register(shutil.rmtree, at, True)
        with zipfile.ZipFile(f"{at}/{top.name}.zip", "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(f"{at}/{top.name}.zip")


def spare(name: str, *frames: DataFrame) -> str:
    """A column name that none of ``frames`` has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """mapInArrow over column lists: ``rows`` gets {column: python list} of a batch and returns the output columns.

    Strings arrive as str and binary as bytes. Batches are cut so that at most about 8 MB of variable-length data is
    unpacked at a time, however long the texts are.
    """
    ship(df.sparkSession)
    names = df.columns
    out = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            step = max(1, int(batch.num_rows * 8e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = rows({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def fixed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the least hashes of ``key``: the same ones on every run and any partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and label of at most ``max_rows`` labelled documents where ``learn`` holds, in one partition in order.

    Labels of no document teach nothing. Of rows that share an id the least text is taken, so the sample is the same on every run.
    """
    known = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    sample = fixed_sample(known, F.struct("doc_id", "label"), max_rows)  # max_rows bounds what is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id", "label")
