"""Folders that driver and executors both reach."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` names.

    A path without scheme is one of the default file system. Where the setting is absent
    and Spark runs in one process (tests), a temporary folder takes its place; a cluster
    must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def spread(df: DataFrame, *keys: str, mb: int = 4) -> DataFrame:
    """``df``, a scan, dealt by ``keys`` before it is grouped: a task for each ``mb`` MB that Spark expects of it, and as many as are set at least.

    A scan's own groups take the memory of a whole split, and adaptive execution puts
    partitions together by compressed sizes, in which keys and tokens are small. A stated
    number grows with the input instead, and no task does.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (mb << 20))), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
