"""Approximate nearest neighbours by cosine: balanced posting lists.

Fitting: a bounded sample of vectors is clustered on the driver, with a price on
full clusters so that lists come out even. Indexing covers every vector: it goes to
the list of its nearest centroid, and, if it lies near a boundary, also to others
whose distance is within ``closure`` of the nearest, unless a list already taken is
nearer to that centroid than the vector is. Lists lie in at most ``GROUPS`` groups;
a group of more than ``GROUP_ROWS`` rows is split into chunks by a hash of the id.

Searching: a graph of neighbouring centroids is walked best-first in memory until the
distance ends the walk: all lists whose distance is within ``ratio`` of the nearest
one's are scanned, however many they are, every row of them, with exact
double-precision scores. Where neighbours are no nearer than chance has them (random
directions) that is two thirds of all lists. A query goes to each group of its
lists once. A chunk meets its queries, at most about ``QUERY_ROWS``, in one task;
nothing but centroids and lengths of groups (bounded by ``MAX_LISTS``) goes through
the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.vectors import is_query, matrix, ranked, usable

SAMPLE = 16_000
MAX_LISTS = 2048
PER_LIST = 100
GROUPS = 128
GROUP_ROWS = 16_384
QUERY_ROWS = 65_536


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components leave the doubles' range.
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of unit rows."""
    return np.maximum(2 - 2 * (x @ c.T), 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of ``x``; each round a cluster above its share pays for its surplus."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)] if len(x) else np.zeros((0, x.shape[1]))
    price = np.zeros(lists)
    for _ in range(rounds if len(x) else 0):
        d = np.concatenate([distances(x[a : a + 2048], c) for a in range(0, len(x), 2048)])
        near = (d + price).argmin(1)
        size = np.bincount(near, minlength=lists)
        price += 0.02 * (size / (len(x) / lists) - 1) * d.min(1).mean()
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c = np.where(full[:, None], total, x[rng.choice(len(x), lists)])
        c = unit(c)
    return c


class CentroidGraph:
    """Neighbour lists over the centroids, walked best-first."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        n = len(c)
        degree = min(degree, max(0, n - 1))
        self.links = np.zeros((n, degree), np.int64)
        for a in range(0, n, 1024):
            d = distances(c[a : a + 1024], c)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            if degree:
                self.links[a : a + len(d)] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        self.back: list[set[int]] = [set(own) for own in self.links.tolist()]
        for a, own in enumerate(self.links.tolist()):
            for b in own:
                self.back[b].add(a)
        # Entries: one centroid of every connected part of the graph, and a spread of others.
        seen, self.entries = np.zeros(n, bool), list(range(0, n, max(1, n // 16)))
        for start in [*self.entries, *range(n)]:
            if seen[start]:
                continue
            if start not in self.entries:
                self.entries.append(start)
            stack = [start]
            seen[start] = True
            while stack:
                for b in self.back[stack.pop()]:
                    if not seen[b]:
                        seen[b] = True
                        stack.append(b)

    def nearest(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """About the ``beam`` nearest (distance, centroid) of a unit vector, nearest first."""
        if not len(self.c):
            return []
        d = distances(q[None], self.c[self.entries])[0]
        seen = set(self.entries)
        todo = [(float(x), k) for x, k in zip(d, self.entries)]
        heapq.heapify(todo)
        found = [(-x, k) for x, k in heapq.nsmallest(beam, todo)]
        heapq.heapify(found)
        while todo:
            x, k = heapq.heappop(todo)
            if len(found) >= beam and x > -found[0][0]:
                break
            new = [b for b in self.back[k] if b not in seen]
            if not new:
                continue
            seen.update(new)
            for y, b in zip(distances(q[None], self.c[new])[0].tolist(), new):
                if len(found) < beam or y < -found[0][0]:
                    heapq.heappush(todo, (y, b))
                    heapq.heappush(found, (-y, b))
                    if len(found) > beam:
                        heapq.heappop(found)
        return sorted((-y, b) for y, b in found)

    def within(self, q: np.ndarray, beam: int, ratio: float, least: int = 12) -> np.ndarray:
        """Centroids within ``1 + ratio`` times the nearest one's distance, ``least`` at least, nearest first.

        The walk goes on until both ``beam`` and the distance end it; once it has seen a
        quarter of the centroids, the others are compared at once.
        """
        if not len(self.c):
            return np.zeros(0, np.int64)
        seen = list(self.entries)
        known, d = set(seen), distances(q[None], self.c[seen])[0].tolist()
        todo = list(zip(d, seen))
        heapq.heapify(todo)
        nearest = [-x for x in heapq.nsmallest(beam, d)]
        heapq.heapify(nearest)
        limit = (1 + ratio) ** 2 * min(d) + 1e-12
        while todo:
            x, k = heapq.heappop(todo)
            if x > limit and len(nearest) >= beam and x > -nearest[0]:
                break
            new = [b for b in self.back[k] if b not in known]
            if not new:
                continue
            if 4 * (len(seen) + len(new)) > len(self.c):
                seen, d = range(len(self.c)), distances(q[None], self.c)[0].tolist()
                break
            known.update(new)
            own = distances(q[None], self.c[new])[0].tolist()
            seen += new
            d += own
            for y, b in zip(own, new):
                heapq.heappush(todo, (y, b))
                (heapq.heappush if len(nearest) < beam else heapq.heappushpop)(nearest, -y)
            limit = min(limit, (1 + ratio) ** 2 * min(own) + 1e-12)
        far = np.array(d)
        order = np.argsort(far, kind="stable")
        limit = (1 + ratio) ** 2 * far[order[0]] + 1e-12
        return np.array(seen)[order[: max(least, int((far <= limit).sum()))]]


def assign(x: np.ndarray, c: np.ndarray, closure: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs of unit rows: the nearest list and those of boundary copies."""
    d = distances(x, c)
    m = min(copies, c.shape[0])
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1)
    dist = np.take_along_axis(d, near, 1)
    take = np.zeros(near.shape, bool)
    take[:, 0] = True
    for j in range(1, m):
        ok = dist[:, j] <= (1 + closure) ** 2 * dist[:, 0]
        for i in range(j):
            between = np.maximum(2 - 2 * np.einsum("ij,ij->i", c[near[:, i]], c[near[:, j]]), 0)
            ok &= ~(take[:, i] & (between < dist[:, j]))
        take[:, j] = ok
    row, j = np.nonzero(take)
    return row, near[row, j]


def search(table: DataFrame, k: int = 5, every: int = 50, closure: float = 0.15, copies: int = 4, beam: int = 48, ratio: float = 0.35) -> DataFrame:
    """query_id, rank, vec_id, score of about the ``k`` nearest rows by cosine.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all
    rows with another vec_id. Null, zero and non-finite vectors and rows without an id
    take no part. Shorter vectors are filled up with zeros. Repeated rows are indexed
    as often as they stand there; of those with one id a query finds the nearest.
    """
    rows = usable(table, zero=False)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"), F.count_if(is_query(every)).alias("asked")).first()
    dims = size.dims or 0
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).collect()  # at most SAMPLE rows
    sample = unit(matrix(pa.array([r.embedding for r in picked], pa.list_(pa.float64())), dims))
    centroids = balanced_centroids(sample, min(MAX_LISTS, max(1, size.n // PER_LIST)))
    held = table.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_LISTS rows
    groups = max(1, min(GROUPS, len(centroids)))

    def index(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                row, lists = assign(unit(matrix(part.column(1), dims)), held.value, closure, copies)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(lists)], ["vec_id", "embedding", "list"])

    def route(batches):
        graph = CentroidGraph(held.value)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                row, group, lists = [], [], []
                for i, q in enumerate(unit(matrix(part.column(1), dims))):
                    own = graph.within(q, beam, ratio)
                    for g in np.unique(own % groups).tolist():
                        row.append(i)
                        group.append(g)
                        lists.append(own[own % groups == g])
                at = pa.array(row, pa.int64())
                cols = [part.column(0).take(at), part.column(1).take(at), pa.array(group, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "query", "group", "lists"])

    def scan(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, x, of = left["vec_id"].to_numpy(), unit(matrix(left["embedding"], dims)), left["list"].to_numpy()
            q_ids, q, lists = right["query_id"].to_numpy(), unit(matrix(right["query"], dims)), right["lists"].combine_chunks()
            asked = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            lists = lists.flatten().to_numpy()
            for own in np.unique(of):
                col, row = np.flatnonzero(of == own), asked[lists == own]
                block = max(1, (1 << 22) // len(col))
                for a in range(0, len(row), block):
                    r = row[a : a + block]
                    n, c = _near(ids[col], x[col], q_ids[r], q[r], k)
                    out.append(_kept(r[n], *_exact(ids, x, q, r[n], col[c]), k))
        row, found, score = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        row, found, score = _kept(row, found, score, k)
        return pa.table({"query_id": q_ids[row] if out else row, "vec_id": found, "score": score})

    def pieces(counts, most):
        """For each group the number of pieces of at most about ``most`` rows."""
        own = {r.group: -(-r.n // most) for r in counts.filter(F.col("n") > most).collect()}  # at most GROUPS rows
        return F.coalesce(F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col("group")], F.lit(1)) if own else None

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))

    lists = rows.mapInArrow(index, "vec_id long, embedding array<double>, list long").withColumn("group", F.col("list") % groups)
    queries = rows.filter(is_query(every)).mapInArrow(route, "query_id long, query array<double>, group long, lists array<long>")
    chunks = pieces(lists.groupBy("group").agg(F.count("*").alias("n")), GROUP_ROWS)
    parts = pieces(queries.groupBy("group").agg(F.count("*").alias("n")), QUERY_ROWS) if size.asked > QUERY_ROWS else None
    none = F.lit(0).cast("long")
    lists = lists.withColumn("chunk", none if chunks is None else F.pmod(F.xxhash64("vec_id"), chunks)).withColumn("part", none if parts is None else each(parts))
    queries = queries.withColumn("part", none if parts is None else F.pmod(F.xxhash64("query_id"), parts)).withColumn("chunk", none if chunks is None else each(chunks))
    on = ("group", "chunk", "part")
    found = lists.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(scan, "query_id long, vec_id long, score double")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def _near(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that hold the ``k`` best other ids of each query with all their ties; ``ids`` ascend."""
    s = q @ x.T
    s[q_ids[:, None] == ids] = -np.inf
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    if len(first) <= k:
        return np.nonzero(s > -np.inf)
    by_id = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
    limit = np.partition(by_id, len(first) - k, axis=1)[:, len(first) - k, None]
    return np.nonzero((s >= limit - 1e-12) & (s > -np.inf))  # the product's last bits depend on the place


def _exact(ids: np.ndarray, x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of (query, row) pairs; equal vectors have equal scores."""
    score = [(q[row[a : a + 16_384]] * x[col[a : a + 16_384]]).sum(1) for a in range(0, len(row), 16_384)]
    return ids[col], np.concatenate([np.zeros(0), *score])


def _kept(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of each row, every id once, ties to the smaller id."""
    at = np.lexsort((-score, ids, row))
    at = at[np.append(True, (row[at][1:] != row[at][:-1]) | (ids[at][1:] != ids[at][:-1]))[: len(at)]]
    at = at[np.lexsort((ids[at], -score[at], row[at]))]
    at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < k]
    return row[at], ids[at], score[at]
