"""Cutting lineage through tables written to the shared folder of the cluster.

Iterative jobs write each round as Parquet and go on from the file, so that a lost executor
costs one read, never the rounds before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_local_dirs: dict[str, str] = {}
_written: set[str] = set()  # paths of the tables that `cut` made in this process


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/netloom/{label}-{uuid.uuid4().hex}"


def _plain(spark: SparkSession, path: str) -> str:
    """A path without its scheme and host."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` once and continue from the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    _written.add(_plain(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """Like `cut`, with aggregate metrics observed while writing (no second pass)."""
    seen = Observation()
    out = cut(df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), label)
    return out, seen.get


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table made by `cut` which nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if _plain(spark, str(parent)) in _written:
        parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


def count_all() -> "F.Column":
    return F.count(F.lit(1))
