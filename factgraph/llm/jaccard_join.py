"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document's set are its runs of five words (white space apart, lower case). Rows
with equal sets form one class and are compared once. A class has a signature of
``DEPTH`` min-hash labels for each tree.

The forest is one table of paths (tree, labels), sorted over all tasks, so that what
stands together is a node of the tree's prefix trie, at every depth. A join has no
single query whose best matches could end the search: it needs all pairs above the
threshold. So matched prefixes are shortened, level by level from ``DEPTH`` on, until a
pair at the threshold shares a prefix of some tree with the target recall; there are as
many trees as that takes at a depth of ``LEAST_DEPTH``, so that no prefix gets too short
to tell texts apart. Nodes of longer prefixes lie within those of shorter ones and are
not visited apart. One pass over the sorted paths links each class to the first of its
node; where a node runs on in the next task, the ends are linked.

Connected classes form a candidate cluster; a cluster is compared whole, in square tiles
of ``TILE`` x ``TILE`` classes, with the sets themselves. So no pair of a node is ever
written out, and a cluster of any size is dealt over many tasks. Tiles return counts
of links and a spanning forest of their links, of which groups are made.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import discard, partitions, release, stored
from factgraph.llm.components import components

DEPTH, LEAST_DEPTH, MOST_TREES = 6, 4, 255
LABEL = 2  # bytes of a label
TILE = 64
WORDS_KEPT = 400_000


def forest_shape(threshold: float, recall: float) -> tuple[int, int]:
    """(trees, depth): the trees that a pair at ``threshold`` takes to share ``LEAST_DEPTH`` labels of one with
    probability ``recall``, at least 20, and the longest prefix that still does so with these."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold and recall lie between 0 and 1")
    chance = threshold**LEAST_DEPTH
    trees = 20 if chance == 1 else max(20, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
    if trees > MOST_TREES:
        raise ValueError(f"a recall of {recall} at {threshold} takes {trees} trees, more than {MOST_TREES}")
    depth = DEPTH
    while 1 - (1 - threshold**depth) ** trees < recall and depth > LEAST_DEPTH:
        depth -= 1
    return trees, depth


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Words numbered in order of meeting, with their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return k


class Shingler:
    """Hashed word runs of texts; word hashes are kept between batches up to a bound."""

    def __init__(self, words: int):
        self.words, self.at = words, _Numbers()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the sorted distinct 64-bit hashes; a text of fewer words is one run, one without words has none."""
        if len(self.at) > WORDS_KEPT:
            self.at = _Numbers()
        ids = []
        for text in texts:
            own = text.lower().split()
            ids.append(np.fromiter(map(self.at.__getitem__, own), np.int64, len(own)))
        table = np.array(self.at.hashes, np.uint64)
        return [self._runs(table[x]) for x in ids]

    def _runs(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        return np.unique(out)


class Signer:
    """Min-hash labels of sets."""

    def __init__(self, trees: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.mul = rng.integers(1, 2**63, trees * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, trees * DEPTH, dtype=np.uint64)

    def paths(self, shingles: np.ndarray) -> np.ndarray:
        """A row of bytes for each tree: its number, then its labels."""
        least = np.full(len(self.mul), 2**32 - 1, np.uint64)
        for a in range(0, len(shingles), 512):
            h = (shingles[a : a + 512, None] * self.mul + self.add) >> np.uint64(32)
            least = np.minimum(least, h.min(0))
        labels = mix64(least).astype(f">u{LABEL}").reshape(self.trees, DEPTH)
        return np.concatenate([np.arange(self.trees, dtype=np.uint8)[:, None], labels.view(np.uint8)], axis=1)


def _slices(batches, rows: int = 500):
    """Batches of a bounded number of rows: texts become Python strings a few at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def sketches(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, h (hash of the text), cls (128-bit digest of the set) and paths (one for each tree; none without words) of each row."""

    def run(batches):
        shingler, signer = Shingler(words), Signer(trees)
        for b in _slices(batches):
            digests, paths = [], []
            for s in shingler.sets(b.column(1).to_pylist()):
                digests.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()))
                paths.append([bytes(x) for x in signer.paths(s)] if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(paths, pa.list_(pa.binary()))], ["doc_id", "h", "cls", "paths"])

    return _keyed(docs).select("doc_id", "text", "h").mapInArrow(run, "doc_id long, h long, cls binary, paths array<binary>")


def linked_in_forest(paths: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """a, b: a link of every class to the first one of each of its nodes, from rows of path and cls; and the table it reads."""
    width, spark = 1 + LABEL * depth, paths.sparkSession

    def run(batches):
        part, start, head, last = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            path = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)[:, :width]
            cls = b.column(1).to_pylist()
            new = np.append(True, (path[1:] != path[:-1]).any(1))
            own = path[0].tobytes(), cls[0]
            start = start or own
            if last and last[0] == own[0]:
                new[0] = False
            heads = np.flatnonzero(new)
            at = np.cumsum(new) - 1
            first = [cls[heads[k]] if k >= 0 else head for k in at.tolist()]
            inner = np.flatnonzero(~new).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in inner], pa.binary()), pa.array([first[k] for k in inner], pa.binary()), *(pa.nulls(len(inner), t) for t in (pa.int64(), pa.binary(), pa.binary()))], names)
            head, last = first[-1], (path[-1].tobytes(), cls[-1])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([start[1]], pa.binary()), pa.array([last[1]], pa.binary()), pa.array([part]), pa.array([start[0]], pa.binary()), pa.array([last[0]], pa.binary())], names)

    names = ["a", "b", "part", "start", "last"]
    dealt = paths.repartitionByRange(partitions(spark), "path", "cls").sortWithinPartitions("path", "cls")
    found = stored(dealt.select("path", "cls").mapInArrow(run, "a binary, b binary, part long, start binary, last binary"), "forest")
    ends = found.filter("part IS NOT NULL").orderBy("part").collect()  # a row for each task
    across = [(y.a, x.b) for x, y in zip(ends, ends[1:]) if x["last"] == y["start"]]
    return found.filter("part IS NULL").select("a", "b").unionByName(spark.createDataFrame(across, "a binary, b binary")), found


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that are not null and h, a hash of them; doc_id and h stand for a row."""
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit(""))}).withColumn("h", F.xxhash64("text"))


def compare(a: list[np.ndarray], b: list[np.ndarray], same: bool, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets at or above ``threshold``; above the diagonal only if ``same``."""
    sets = a if same else a + b
    size = np.array([len(x) for x in sets], np.int64)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = df[inverse] > 1
    col = (np.cumsum(df > 1) - 1)[inverse[shared]]
    row, width = row[shared], int((df > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n, m = len(a), len(sets) - len(a)
    common = np.zeros((n, n if same else m), np.float32)
    for c in range(0, width, 8192):
        lo, hi = np.searchsorted(col, (c, c + 8192))
        dense = np.zeros((len(sets), min(8192, width - c)), np.float32)
        dense[row[lo:hi], col[lo:hi] - c] = 1
        common += dense[:n] @ (dense[:n] if same else dense[n:]).T
    union = size[:n, None] + (size[None, :n] if same else size[None, n:]) - common
    near = common.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9
    return np.triu(near, 1) if same else near


def forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join what earlier ones left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(k)
    return pairs[keep]


def _verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """cls, other (null in rows that count) and links from rows of comp, i, j, block, cls, text, dealt by tile."""
    schema = "cls binary, other binary, links long"

    def tile(block: list[int], cls: list[bytes], sets: list[np.ndarray], i: int, j: int):
        first = [k for k, x in enumerate(block) if x == i]
        second = first if i == j else [k for k, x in enumerate(block) if x == j]
        if not first or not second:
            return
        near = compare([sets[k] for k in first], [sets[k] for k in second], i == j, threshold)
        x, y = np.nonzero(near)
        x, y = np.array(first)[x], np.array(second)[y]
        links = np.bincount(x, minlength=len(cls)) + np.bincount(y, minlength=len(cls))
        edges = forest(np.stack([x, y], 1))
        some = np.flatnonzero(links).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([cls[k] for k in some] + [cls[k] for k in edges[:, 0]], pa.binary()),
                pa.array([None] * len(some) + [cls[k] for k in edges[:, 1]], pa.binary()),
                pa.array(links[some].tolist() + [0] * len(edges), pa.int64()),
            ],
            ["cls", "other", "links"],
        )

    def run(batches):
        shingler, key, block, cls, sets = Shingler(words), None, [], [], []
        for b in _slices(batches):
            for comp, i, j, own, c, s in zip(*(b.column(k).to_pylist() for k in range(5)), shingler.sets(b.column(5).to_pylist())):
                if (comp, i, j) != key:
                    if key is not None:
                        yield from tile(block, cls, sets, *key[1:])
                    key, block, cls, sets = (comp, i, j), [], [], []
                if xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) == c and not (cls and cls[-1] == c):
                    block.append(own)
                    cls.append(c)
                    sets.append(s)
        if key is not None:
            yield from tile(block, cls, sets, *key[1:])

    return members.mapInArrow(run, schema)


def _row_key(doc_id: Column, h: Column) -> list[Column]:
    """What stands for a row, without nulls."""
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("_k0"), doc_id.isNull().alias("_k1"), h.alias("_k2")]


def _groups(docs: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, cls), and about each cls: least (its first row), keep (the first row of its group), n_copies, n_links."""
    trees, depth = forest_shape(threshold, recall)
    rows = stored(sketches(docs, words, trees), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stored(rows.groupBy("cls").agg(F.min(first).alias("least"), F.count("*").alias("n_copies"), F.first("paths").alias("paths")), "classes")
    star, forest = linked_in_forest(classes.select(F.explode("paths").alias("path"), "cls"), depth)
    nodes = components(star)
    clusters = nodes.withColumnRenamed("node", "cls")

    # Tables on the smaller side of a join are written first: both sides are then plain
    # shuffles, and Spark splits those of a cluster or class that holds many rows.
    size = stored(clusters.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "cluster-sizes")
    member = clusters.join(size, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    member = stored(member.join(classes.select("cls", *_row_key(F.col("least.doc_id"), F.col("least.h"))), "cls"), "cluster-members")
    # One text of each class in a cluster, sent to the tiles of its row and column.
    texts = _keyed(docs).select("text", *_row_key(F.col("doc_id"), F.col("h")))
    # A shuffle at every size: whether members could be broadcast changes with the corpus.
    held = member.join(texts.hint("merge"), ["_k0", "_k1", "_k2"])
    tiles = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "text")
    tiles = tiles.repartition(partitions(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "cls")
    found = stored(_verified(tiles, words, threshold), "verified")
    del held, tiles, texts
    release(docs.sparkSession)

    links = found.filter("other IS NULL").groupBy("cls").agg(F.sum("links").alias("n_links"))
    linked = components(found.filter("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    groups = stored(linked.withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls"), "groups")
    keep = stored(groups.groupBy("component").agg(F.min("least").alias("keep")), "group-heads")
    about = classes.select("cls", "least", "n_copies").join(groups.join(keep, "component").select("cls", "keep"), "cls", "left").join(links, "cls", "left")
    about = about.select("cls", "least", F.coalesce("keep", "least").alias("keep"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    about = stored(about, "about-classes")
    discard(classes, forest, nodes, size, member, found, linked, groups, keep)
    return rows.select("doc_id", "h", "cls"), about


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """doc_id, copy_id, class_id, n_copies, n_links of every row of ``docs``; other columns take no part.

    ``copy_id`` is the smallest doc_id among rows with the same set of word runs,
    ``n_copies`` their number. ``n_links`` counts the other such classes whose Jaccard
    similarity with this one is at least ``threshold``; ``class_id`` is the smallest
    doc_id among all classes that links connect. Texts without words (null, empty)
    are copies of each other and have no links. Rows without doc_id are rows like
    any other; ids are null where all rows meant have none. Repeated rows are copies.
    Texts are compared whole, however long; empty tables give no rows.
    """
    rows, about = _groups(docs, words, threshold, recall)
    known = about.select("cls", F.col("least.doc_id").alias("copy_id"), F.col("keep.doc_id").alias("class_id"), "n_copies", "n_links")
    return rows.join(known, "cls").select("doc_id", "copy_id", "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that come first in their group: smallest doc_id, then by a hash of the text.

    Of repeated rows with one doc_id and text a single one stays. All is decided on keys;
    texts are shuffled once, to meet what was decided.
    """
    rows, about = _groups(docs, words, threshold, recall)
    heads = about.select(*_row_key(F.col("keep.doc_id"), F.col("keep.h"))).distinct()
    key = ["_k0", "_k1", "_k2"]
    named = _keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    kept = named.select("_row", *_row_key(F.col("doc_id"), F.col("h"))).join(heads.hint("merge"), key, "left_semi")
    release(docs.sparkSession)
    if rows.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(key)
    return kept.select("_row.*")
