"""Rows of an embedding table that take part in searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (doubles) of rows with an id and finite components; all-zero ones only if ``zero``."""
    x = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(~odd)
    return rows if zero else rows.filter(F.exists("embedding", lambda c: c != 0))


def is_query(every: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(every)) == 0


def matrix(lists: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; shorter vectors end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    length = np.diff(lists.offsets.to_numpy())
    if n and (length == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims), flat.dtype if len(flat) else np.float64)
    row = np.repeat(np.arange(n), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query's (query_id, vec_id, score) rows."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
