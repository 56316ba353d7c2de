"""Shared folders, file access and small helpers for the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names.

    Driver and executors both reach it. A path without scheme is one of the default file
    system. Where the setting is absent and Spark runs in one process (tests), a temporary
    folder takes its place; a cluster must name one.
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


def open_fs(uri: str):
    """(filesystem, path) for a folder of the shared store."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri[5:].replace("//", "/", 1) if uri.startswith("file://") else uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a retried task leaves no torn file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more, and let their shuffle files go."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of data frames that are no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20, rows: int = 4096):
    """Consecutive slices of a batch, without copies: at most ``rows`` rows and ``most`` bytes in a column, but one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(max(int(np.searchsorted(ends, before + most, "right")), at + 1), at + rows)
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = min(end, batch.num_rows)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
