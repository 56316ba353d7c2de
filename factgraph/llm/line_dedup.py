"""Line dedup: a sharded minimal perfect hash with fingerprint and count arrays.

Lines that recur are found by one aggregation over 128-bit line hashes. The
recurring hashes are cut into shards; each shard becomes one file in the shared
folder that holds a minimal perfect hash, and arrays of fingerprints, document
counts and last holders. Documents then probe the arrays of one shard after
another: no line is ever joined, and nothing passes through the driver.

A task holds one batch of documents and a bounded cache of shards. A line found
in every document meets in the aggregation only after partial counts.
"""

from __future__ import annotations

import io
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import read_file, shared_dir, stored, texts, write_file

KEYS_PER_SHARD = 1 << 18
CACHE_BYTES = 64 << 20
_NONE = np.iinfo(np.int64).min


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer ASCII white space and with A-Z lowered; None if it is short."""
    key = line.strip().lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Levels of bit arrays: a key settles at the first level where it is alone in its slot."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        words = bits.view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.words = words

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        sizes, levels = [], []
        while len(h1):
            m = -(-max(64, 2 * len(h1)) // 64) * 64
            slot = _mix(h1, h2, len(sizes)) % np.uint64(m)
            alone = np.bincount(slot.astype(np.int64), minlength=m) == 1
            settled = alone[slot]
            sizes.append(m)
            levels.append(alone)
            h1, h2 = h1[~settled], h2[~settled]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(bits, bitorder="little"))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """0..n-1 for the keys it was built from, all different; -1 or any index for others."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return out


class Shard:
    """Arrays of one shard, in the order of its perfect hash."""

    def __init__(self, raw: bytes):
        with np.load(io.BytesIO(raw)) as z:
            self.mph = PerfectHash(z["sizes"], z["bits"])
            self.prints, self.counts, self.last = z["prints"], z["counts"], z["last"]
        self.nbytes = len(raw)

    @staticmethod
    def dump(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
        mph = PerfectHash.build(h1, h2)
        order = np.argsort(mph.index(h1, h2))
        out = io.BytesIO()
        np.savez(out, sizes=mph.sizes, bits=mph.bits, prints=h2[order], counts=counts[order].astype(np.uint32), last=last[order])
        return out.getvalue()

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, or 0; its last holder)."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.mph.index(h1, h2)
        known = (at >= 0) & (self.prints[at] == h2)
        return np.where(known, self.counts[at], 0), self.last[at]


class ShardCache:
    def __init__(self, folder: str):
        self.folder, self.held, self.size = folder, OrderedDict(), 0

    def get(self, k: int) -> Shard:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        shard = Shard(read_file(f"{self.folder}/{k}.npz"))
        self.held[k] = shard
        self.size += shard.nbytes
        while self.size > CACHE_BYTES and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return shard


def _hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])


def recurring_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """h1, h2, n_docs, last: the line keys held by at least ``min_docs`` documents.

    Rows with the same doc_id are one document, as are all rows without one. ``last`` is
    the largest doc_id that holds a key.
    """

    def hashed(batches):
        for b in batches:
            digests, owner = [], []
            for i, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                own = {xxhash.xxh3_128_digest(k) for line in raw.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                digests += own
                owner += [i] * len(own)
            h1, h2 = _hashes(digests)
            ids = b.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids], ["h1", "h2", "doc_id"])

    rows = texts(docs).mapInArrow(hashed, "h1 long, h2 long, doc_id long")
    # By document first: rows of one document count once, and a line that very many hold is spread.
    return rows.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).filter(F.col("n_docs") >= min_docs)


def write_shards(keys: DataFrame, folder: str) -> int:
    """Write the shards of ``keys`` below ``folder``; the number of shards."""
    keys = stored(keys, "line-keys")
    shards = max(1, -(-keys.count() // KEYS_PER_SHARD))

    def build(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            last = t["last"].fill_null(int(_NONE)).to_numpy()
            counts, shard = t["n_docs"].to_numpy(), (h1 % np.uint64(shards)).astype(np.int64)
            for k in np.unique(shard):
                own = shard == k
                write_file(f"{folder}/{k}.npz", Shard.dump(h1[own], h2[own], counts[own], last[own]))
                yield pa.RecordBatch.from_arrays([pa.array([int(k)])], ["shard"])

    # The same number from the unsigned hash as in Python, so that a shard has one writer.
    by = F.pmod(F.col("h1").cast("decimal(20,0)") + F.when(F.col("h1") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0)), F.lit(shards)).cast("long")
    spread = keys.withColumn("_shard", by).repartition(shards, "_shard").drop("_shard")
    written = {r.shard for r in spread.mapInArrow(build, "shard long").collect()}
    empty = Shard.dump(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)))
    for k in set(range(shards)) - written:
        write_file(f"{folder}/{k}.npz", empty)
    return shards


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_dropped for each row of ``docs``.

    Keys of at least ``min_chars`` code points held by at least ``min_docs`` documents
    keep their lines only in the one with the largest doc_id that holds them. Null and
    empty texts are one empty line. Rows with the same doc_id are one document: together
    they count once, and all of them keep a line whose last holder they are. So are rows
    without doc_id, whose id is smaller than any other. Empty input gives no rows.
    """
    return _probe(texts(docs), min_chars, min_docs, "doc_id long, text string, n_lines long, n_dropped long")


def _probe(rows: DataFrame, min_chars: int, min_docs: int, counted: str | None) -> DataFrame:
    """``rows`` with new texts; ``counted`` is the schema with both counts, where they are asked for."""
    folder = shared_dir(rows.sparkSession, "line-shards")
    shards = write_shards(recurring_lines(rows, min_chars, min_docs), folder)
    names = rows.columns

    def probe(batches):
        cache = ShardCache(folder)
        for b in batches:
            held = b.column(names.index("doc_id")).cast(pa.int64())
            ids = held.fill_null(int(_NONE)).to_numpy(zero_copy_only=False)
            split = [raw.split(b"\n") for raw in b.column(names.index("text")).cast(pa.binary()).to_pylist()]
            digests, at, owner = [], [], []
            for i, lines in enumerate(split):
                for j, line in enumerate(lines):
                    if (k := line_key(line, min_chars)) is not None:
                        digests.append(xxhash.xxh3_128_digest(k))
                        at.append(j)
                        owner.append(i)
            h1, h2 = _hashes(digests)
            own = np.array(owner, np.int64)
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            drop = np.zeros(len(h1), bool)
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                count, last = cache.get(int(k)).probe(h1[mine], h2[mine])
                drop[mine] = (count > 0) & (last != ids[own[mine]])
            n = [len(x) for x in split]
            dropped = np.bincount(own[drop], minlength=len(split))
            for x in np.flatnonzero(drop):
                split[owner[x]][at[x]] = None
            kept = [b"\n".join(x) if not dropped[i] else b"\n".join(y for y in x if y is not None) for i, x in enumerate(split)]
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string())}
            out = [new.get(c, b.column(i)) for i, c in enumerate(names)]
            extra = [pa.array(n, pa.int64()), pa.array(dropped)] if counted else []
            yield pa.RecordBatch.from_arrays(out + extra, names + ["n_lines", "n_dropped"] * bool(counted))

    return rows.mapInArrow(probe, counted or rows.schema)


def dedup_frame(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with all its columns, the text replaced by what dedup_lines leaves of it."""
    return _probe(docs.withColumn("text", F.coalesce("text", F.lit(""))), min_chars, min_docs, None)
