"""Cutting lineage and reading tables for the corpus operators.

Intermediate tables are Parquet files below the folder that the session names in
`spark.checkpoint.dir`, which driver and executors share; a lost executor costs no
result.  In a local session without the setting (tests), a folder of this process is used;
on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    d = tempfile.mkdtemp(prefix="narrata-")
    atexit.register(shutil.rmtree, d, True)
    return d


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = _own_dir()
    return d.rstrip("/") + "/narrata-" + spark.sparkContext.applicationId


def keep(df: DataFrame) -> DataFrame:
    """Write `df` below the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._narrata_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*dfs: DataFrame) -> None:
    """Delete tables made by `keep` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_narrata_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application keeps; results that were not written yet cannot be read afterwards."""
    _delete(spark, shared_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (null ids: null)."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5).cast("int")
