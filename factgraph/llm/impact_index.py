"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers. A block of vectors is held as postings (dimension, vector,
impact) in segments of one impact level each, a power of two, without what is zero.
Queries take the segments from the highest level down, posting by posting; after each,
what is left of any vector is bounded by Cauchy-Schwarz and by the segments' largest
impact. A vector is left out of a query's answer only on proof: when its sum so far plus
that bound stays below the k-th best score already certain. A query stops when few
possible members remain, and those are scored exactly, in integers, from the vectors
themselves. Every block starts with the k-th best score of each query among ``LEAD`` rows
that all tasks know, and takes what it has reached to the next.

Queries are a stated set, written to the shared folder and read block by block;
candidates are dealt evenly in blocks, so no task depends on a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import open_fs, shared_dir
from factgraph.llm.vectors import is_query, matrix, ranked, usable

BLOCK = 8192
QUERY_BLOCK = 256
FEW = 0.02
LEAD = 512


def quantise(rows: DataFrame, scale: int) -> DataFrame:
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("impacts"))


class ImpactBlock:
    """Postings of one block of vectors, in segments by descending impact."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        self.ids, self.impacts = ids, impacts
        vector, dim = np.nonzero(impacts)
        value = impacts[vector, dim].astype(np.float64)
        level = np.frexp(value)[1]
        order = np.lexsort((vector, dim, -level))
        vector, dim, value, level = vector[order], dim[order], value[order], level[order]
        ends = np.append(np.flatnonzero(np.diff(level)) + 1, len(level)) if len(level) else []
        left = (impacts.astype(np.float64) ** 2).sum(1)
        self.size = np.sqrt(left.max(initial=0.0))
        self.segments = []
        start = 0
        for end in ends:
            own = slice(start, end)
            rest = value[end:]
            # Not a running difference, whose rounding could end below the truth.
            left = np.bincount(vector[end:], rest * rest, minlength=len(ids))
            self.segments.append((vector[own], dim[own], value[own], np.sqrt(left), np.abs(rest).max(initial=0.0)))
            start = end

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """(query row, vector row, score) of all possible members of the top ``k``; ``floor``: scores known to be reached."""
        n, dims = len(self.ids), self.impacts.shape[1]
        own = q_ids[:, None] == self.ids[None, :]
        norm, ones = np.sqrt((q * q).sum(1)), np.abs(q).sum(1)
        # Bounds and sums above 2**53 are rounded; scores are integers.
        slack = 0.5 + dims * 2.0**-50 * norm * self.size
        total, floor = np.zeros((len(q), n)), floor.copy()
        possible, going = ~own, np.arange(len(q))
        for vector, dim, value, rest, most in self.segments:
            for i in going:
                total[i] += np.bincount(vector, value * q[i, dim], minlength=n)
            bound = np.minimum(norm[going, None] * rest, ones[going, None] * most)
            if n > k:
                low = np.where(own[going], -np.inf, total[going] - bound)
                floor[going] = np.maximum(floor[going], np.partition(low, n - k, axis=1)[:, n - k])
            possible[going] = ~own[going] & (total[going] + bound >= (floor[going] - slack[going])[:, None])
            going = going[possible[going].sum(1) > FEW * n]
            if not len(going):
                break
        row, col = np.nonzero(possible)
        score = np.empty(len(row), np.int64)
        qi = q.astype(np.int64)
        for a in range(0, len(row), 1 << 16):
            score[a : a + (1 << 16)] = np.einsum("ij,ij->i", qi[row[a : a + (1 << 16)]], self.impacts[col[a : a + (1 << 16)]])
        return row, col, score


def reached(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, impacts: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some rows, as far as doubles prove it; -inf where there are fewer."""
    if len(ids) < k:
        return np.full(len(q), -np.inf)
    s = np.where(q_ids[:, None] == ids, -np.inf, q @ impacts.T)
    slack = 0.5 + impacts.shape[1] * 2.0**-50 * np.sqrt((q * q).sum(1) * (impacts * impacts).sum(1).max())
    return np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - slack


def search(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` highest integer inner products.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id. Rows with a null id, a null vector or null or
    non-finite components take no part. Vectors of different lengths are filled up
    with zeros. Repeated rows are searched and found as often as they stand there.
    Where dimensions times the largest squared impact reach 2**63, scores may leave the
    range of a long: an OverflowError.
    """
    spark = table.sparkSession
    rows = quantise(usable(table, zero=True), scale)
    large = F.array_max(F.transform("impacts", lambda x: F.abs(x.cast("double"))))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("impacts")).alias("dims"), F.max(large).alias("large")).first()
    dims = size.dims or 0
    if dims * (size.large or 0.0) ** 2 >= 2.0**63:
        raise OverflowError(f"scores of {dims} components up to {size.large:.4g} do not fit a long")
    lead = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(LEAD).collect()  # at most LEAD rows
    lead = spark.sparkContext.broadcast((np.array([r.vec_id for r in lead], np.int64), matrix(pa.array([r.impacts for r in lead], pa.list_(pa.int64())), dims).astype(np.float64)))
    folder = shared_dir(spark, "top-k-queries")
    rows.filter(is_query(every)).write.parquet(folder)

    def scan(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids = t["vec_id"].to_numpy()
        impacts = matrix(t["impacts"], dims).astype(np.int64)
        blocks = [ImpactBlock(ids[a : a + BLOCK], impacts[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
        fs, path = open_fs(folder)
        for qb in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if not qb.num_rows:
                continue
            q_ids = qb.column(0).to_numpy()
            q = matrix(qb.column(1), dims).astype(np.float64)
            floor = reached(q_ids, q, *lead.value, k)
            row, vec, score = [], [], []
            for block in blocks:
                r, c, s = block.top(q_ids, q, k, floor)
                row.append(r)
                vec.append(block.ids[c])
                score.append(s)
                order = np.lexsort((-s, r))
                first = np.searchsorted(r[order], np.arange(len(q_ids)))
                there = np.flatnonzero(np.bincount(r, minlength=len(q_ids)) >= k)
                floor[there] = np.maximum(floor[there], s[order][first[there] + k - 1])
            row, vec, score = map(np.concatenate, (row, vec, score))
            order = np.lexsort((vec, -score, row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = order[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[place < k]]), pa.array(vec[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    dealt = rows.repartition(max(1, -(-size.n // BLOCK)))
    return ranked(dealt.mapInArrow(scan, "query_id long, vec_id long, score long"), k)
