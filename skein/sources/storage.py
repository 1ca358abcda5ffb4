"""Scratch tables in the shared folder, for loops that must cut their lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder path inside the folder of spark.checkpoint.dir, which all executors share.

    Where the session names none, a local session (tests) gets a temporary one; on a cluster,
    whose machines don't share one, it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again; a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a key (a corpus version, perhaps with a k), built and stored if it isn't there.

    It is complete when its success mark is, so a build that was cut off is done again.
    """
    path = f"{folder.rstrip('/')}/{quote(key, safe='')}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = hadoop.Path(path + "/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


TINY_BYTES = 4 << 20  # per core


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is so small that its files leave most of them idle; else as it is.

    The size is the planner's estimate, so nothing is read for it; a table of more than
    TINY_BYTES a core is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * TINY_BYTES else df
