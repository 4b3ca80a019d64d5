"""Tables between steps, in the folder that the cluster names in spark.checkpoint.dir (a temporary one where it is unset)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def folder(spark) -> str:
    """Where steps are written: a folder that the driver and all executors see, or a temporary one where all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pagewright-"))
            atexit.register(shutil.rmtree, _own[0], True)
        at = _own[0]
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> str:
    """Write as Parquet; where it is."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write as Parquet and read back: lineage ends here, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
