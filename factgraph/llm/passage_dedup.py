"""Passage dedup by prefix-free parsing: bytes covered by long strings that an earlier document holds.

A rolling hash over grams of the text sets triggers: of all grams in a ``length``-byte
window, the leftmost with the smallest hash is the window's trigger. Equal windows have
equal triggers at equal places, so a window is repeated only if its trigger is. The
phrase of a trigger is the stretch that its windows cover.

1. Documents are packed into chunks, a row each, in a table that every later pass reads.
2. Each chunk parses its text and sends its distinct trigger hashes, as sorted and packed
   arrays, to the tasks of their hash ranges. These send back for each whether two
   documents hold it. Text around other triggers is settled.
3. What is left is the repetitive text. Each chunk sends its distinct phrases (the bytes),
   each with the first document of the chunk that has it, to the same ranges. (A trigger
   at the end of a very common passage has as many phrases as the passage has sequels. Of
   one met more often than a share of a range allows, each window is sent on its own and
   dealt by a hash of its whole text.) There equal
   phrases of all chunks become one entry of the dictionary with its first document.
   No suffix array over all positions of dictionary or parse is made: two orders of the
   entries, a fixed-width row each, take their place. One sorts what stands before a
   trigger, read backwards from it, the other what follows from the trigger on, as far as
   a window reaches. Their common prefixes combine: two windows are equal if
   their texts before the trigger and their texts after it agree as far as the window
   reaches. So a window's class is a pair of ranges, one in either order, and the first
   document of a class is a minimum over its entries. Nothing is decided by a digest.
4. Chunks get a bit back for each window of each phrase they sent: does a document before
   all of their own have it? They remove what those and their own earlier documents cover.

Text is stored once and never shuffled or joined. A phrase in very many documents reaches
its range at most once for each chunk. Arrays of a parse are bounded by ``PIECE``, those
of a chunk by its triggers, those of a range by its distinct phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import partitions, read_file, release, shared_dir, stored, write_file
from factgraph.llm.jaccard_join import mix64

CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 200_000
RANGE_BYTES = 8 << 20
ENTRIES = 1 << 15
PIECE = 1 << 18
LEAST_HEAVY = 256
HEAVY = 1 / 112  # times a trigger is met for each byte of a range: an eighth of its triggers
MOST = 64  # windows of a phrase: their bits fill one number
NONE = -(2**63)
HASH_BITS = 44
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def gram_bytes(length: int) -> int:
    """Bytes of a gram, such that a phrase has ``MOST`` windows at most."""
    return max(length - MOST + 1, min(24, length // 2))


def span_windows(length: int) -> int:
    """The most windows of a phrase."""
    return length - gram_bytes(length) + 1


def _power(n: int) -> list[np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, PIECE + 4096), b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return [x[:n] for x in _powers]


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at every place that has so many."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of x[i : i + n] for every i."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Parse:
    """Triggers of documents laid one after another: for each its hash, place, document and first and last window.

    A trigger at the border of two pieces appears in both, with the windows of either.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        gram = gram_bytes(length)
        found = []
        for s in range(0, len(data) - length + 1, PIECE):
            e = min(s + PIECE, len(data) - length + 1)
            keys = rolling(data[s : e + length - 1], gram)
            # Hash above, place below: the smallest key is the leftmost of the smallest hashes.
            keys = (keys >> np.uint64(64 - HASH_BITS) << np.uint64(64 - HASH_BITS)) | np.arange(len(keys), dtype=np.uint64)
            keys = _least(keys, length - gram + 1)
            a, b = np.searchsorted(ends, (s, e - 1), side="right")
            bounds = ends[a : b + 1]
            until = np.repeat(bounds, np.diff(np.clip(bounds, s, e), prepend=s))
            at = np.flatnonzero(np.arange(s + length, e + length) <= until)
            if not len(at):
                continue
            k = keys[at]
            new = np.flatnonzero((k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            first = np.append(0, new)
            last = np.append(new, len(at)) - 1
            k = k[first]
            place = (k & np.uint64((1 << (64 - HASH_BITS)) - 1)).astype(np.int64) + s
            found.append((k >> np.uint64(64 - HASH_BITS), place, at[first] + s, at[last] + s))
        none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        self.hash, self.place, self.first, self.last = (np.concatenate(x) for x in zip(*(found or [none])))
        # Triggers have small hashes: mixed again, they fill all ranges alike.
        self.hash = mix64(self.hash + np.uint64(1)) >> np.uint64(64 - HASH_BITS)
        self.doc = np.searchsorted(ends, self.place, side="right")
        self.data, self.length = data, length

    def pick(self, keep: np.ndarray) -> "Parse":
        """The triggers at ``keep`` alone."""
        out = object.__new__(Parse)
        out.data, out.length = self.data, self.length
        out.hash, out.place, out.first, out.last, out.doc = (x[keep] for x in (self.hash, self.place, self.first, self.last, self.doc))
        return out

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, for each how often it is met, times two, and one more if by several documents, and the place of each trigger's hash among them."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.doc[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        start = np.flatnonzero(new)
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        end = np.append(start[1:], len(h))[: len(start)]
        return h[start], (2 * (end - start) + (d[end - 1] != d[start])).astype("<u4"), at

    def phrases(self) -> np.ndarray:
        """A key for each trigger, as bytes: hash, windows before the trigger's own place, windows, then the text they cover."""
        size = self.last - self.first + self.length
        width = self.length + span_windows(self.length) - 1
        out = np.zeros((len(size), HEAD + width), np.uint8)
        out[:, :8] = self.hash.astype(">u8")[:, None].view(np.uint8)
        out[:, 8] = self.place - self.first
        out[:, 9] = self.last - self.first
        for a in range(0, len(size), 1 << 14):
            p = slice(a, a + (1 << 14))
            at = self.first[p, None] + np.arange(width)
            np.copyto(out[p, HEAD:], self.data[np.minimum(at, len(self.data) - 1)], where=np.arange(width) < size[p, None])
        return out


HEAD = 10


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a byte matrix in order, and the place of each row among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    flat = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()
    order = np.argsort(flat, kind="stable")
    rows = keys[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(1))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return rows[new], at


def _minimum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``values`` at each of ``n`` places, all of which are met."""
    order = np.argsort(at, kind="stable")
    return np.minimum.reduceat(values[order], np.searchsorted(at[order], np.arange(n))) if n else values[:0]


class Entries:
    """What a chunk sends of its repetitive text: distinct phrases, and of heavy triggers each window on its own."""

    def __init__(self, p: Parse, heavy: np.ndarray, ids: np.ndarray):
        phrases, self.at = _distinct(p.phrases())
        self.first = _minimum(self.at, ids[p.doc], len(phrases))
        split = np.zeros(len(phrases), bool)
        split[self.at] = heavy
        self.light, split = np.flatnonzero(~split), np.flatnonzero(split)
        n = phrases[split, 9].astype(np.int64) + 1
        self.row, self.bit = np.repeat(split, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        single = np.zeros((len(self.row), phrases.shape[1]), np.uint8)
        single[:, 8] = phrases[self.row, 8] - self.bit
        cols = HEAD + np.arange(p.length)
        for a in range(0, len(self.row), 1 << 14):
            part = slice(a, a + (1 << 14))
            single[part, HEAD : HEAD + p.length] = phrases[self.row[part, None], self.bit[part, None] + cols]
        words = np.pad(single[:, HEAD:], ((0, 0), (0, -(phrases.shape[1] - HEAD) % 8))).view(np.uint64)
        h = np.zeros(len(single), np.uint64)
        for k in range(words.shape[1]):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
        single[:, :8] = (h >> np.uint64(64 - HASH_BITS)).astype(">u8")[:, None].view(np.uint8)
        self.keys, self.where = _distinct(np.concatenate([phrases[self.light], single]))
        self.docs = _minimum(self.where, np.concatenate([self.first[self.light], self.first[self.row]]), len(self.keys))

    def hashes(self) -> np.ndarray:
        return self.keys[:, :8].copy().view(">u8").ravel().astype(np.uint64)

    def masks(self, got: np.ndarray) -> np.ndarray:
        """Bits of each phrase's windows that a document before the phrase's first one has, given those of the keys."""
        out = np.zeros(len(self.first), np.uint64)
        n = len(self.light)
        out[self.light] = got[self.where[:n]]
        at = self.where[n:]
        gone = (got[at] & np.uint64(1) == 1) | (self.docs[at] < self.first[self.row])
        np.bitwise_or.at(out, self.row[gone], np.uint64(1) << self.bit[gone].astype(np.uint64))
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed width as bytes; those of numbers by place of the byte, which packs better."""
    out = []
    for a in arrays:
        raw = a.reshape(len(a), -1).view(np.uint8).T.tobytes() if a.dtype != np.uint8 else a.tobytes()
        out.append(pa.compress(raw, "zstd", asbytes=True))
    return b"".join([np.array([len(arrays[0]), *map(len, out)], "<u4").tobytes(), *out])


def _unpack(raw: bytes, *widths: tuple) -> list[np.ndarray]:
    """What _pack made, given (type, items in a row) of each array."""
    n, *sizes = np.frombuffer(raw, "<u4", 1 + len(widths)).tolist()
    at, out = 4 * (1 + len(widths)), []
    for (kind, items), size in zip(widths, sizes):
        width = np.dtype(kind).itemsize * items
        got = np.frombuffer(pa.decompress(raw[at : at + size], n * width, "zstd", asbytes=True), np.uint8)
        out.append(got.reshape(n, width) if kind == "u1" else np.ascontiguousarray(got.reshape(-1, n).T).view(kind).reshape(n))
        at += size
    return out


class Dictionary:
    """Distinct phrases with their first documents; classes of their windows by two suffix arrays."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, length: int):
        self.keys, self.first, self.length = keys, first, length

    def _order(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows in order by hash and text, and how many bytes of text each shares with the one before (-1: another hash)."""
        full = np.concatenate([self.keys[:, :8], texts], axis=1)
        order = np.argsort(full.view(f"S{full.shape[1]}").ravel(), kind="stable")
        same = full[order[1:]] == full[order[:-1]]
        common = np.where(same.all(1), full.shape[1], same.argmin(1)) - 8
        return order, np.append(-1, np.maximum(common, -1))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase, which windows it has and the first document that holds each."""
        n, span = len(self.keys), span_windows(self.length)
        first = np.zeros((n, span), np.int64)
        before, windows = self.keys[:, 8].astype(np.int64), self.keys[:, 9].astype(np.int64)  # bytes, last window
        text = self.keys[:, HEAD:]
        # The dictionary's array: text before the trigger, backwards from it.
        col = before[:, None] - 1 - np.arange(span)
        back = np.where(col >= 0, np.take_along_axis(text, np.maximum(col, 0), 1), 0).astype(np.uint8)
        # The parse's array: text from the trigger on, which runs over the next phrases as far as a window reaches.
        col = before[:, None] + np.arange(self.length)
        ahead = np.where(col < text.shape[1], np.take_along_axis(text, np.minimum(col, text.shape[1] - 1), 1), 0).astype(np.uint8)
        left, left_common = self._order(back)
        right, right_common = self._order(ahead)
        cls = np.empty((2, n), np.int64)
        for x in range(span):  # windows that begin x bytes before their trigger
            own = np.flatnonzero((before >= x) & (before - windows <= x))
            if not len(own):
                continue
            cls[0, left] = np.cumsum(left_common < x)
            cls[1, right] = np.cumsum(right_common < self.length - x)
            pair = cls[0, own] * (n + 1) + cls[1, own]
            order = np.argsort(pair, kind="stable")
            start = np.append(True, np.diff(pair[order]) != 0)
            least = np.minimum.reduceat(self.first[own[order]], np.flatnonzero(start))
            first[own[order], before[own[order]] - x] = least[np.cumsum(start) - 1]
        return np.arange(span) <= windows[:, None], first


def repeated_windows(keys: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each phrase (key, document), as bits, which of its windows are held by a document before its own."""
    entries, at = _distinct(keys)
    first = _minimum(at, docs, len(entries))
    order = np.argsort(at, kind="stable")
    out = np.zeros(len(keys), "<u8")
    # Triggers are independent of each other, so the arrays are built for some of them at a time.
    cuts, a = np.append(np.flatnonzero((entries[1:, :8] != entries[:-1, :8]).any(1)) + 1, len(entries)), 0
    while a < len(entries):
        b = int(cuts[min(np.searchsorted(cuts, a + ENTRIES), len(cuts) - 1)])
        there, least = Dictionary(entries[a:b], first[a:b], length).classes()
        for lo in range(*np.searchsorted(at[order], (a, b)), ENTRIES):
            own = order[lo : min(lo + ENTRIES, np.searchsorted(at[order], b))]
            gone = np.zeros((len(own), MOST), bool)
            gone[:, : there.shape[1]] = there[at[own] - a] & (least[at[own] - a] < docs[own, None])
            out[own] = np.packbits(gone, axis=1, bitorder="little").view("<u8").ravel()
        a = b
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows of chunk, docs, ends (of each text in ``text``) and text: some documents each, or a single long one."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, raws, size = [], [], 0

        def row():
            ends = np.cumsum([len(x) for x in raws], dtype="<i8")
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([ends.tobytes()]), pa.array([b"".join(raws)], pa.binary())], ["chunk", "docs", "ends", "text"])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if raws and (size + len(raw) > CHUNK_BYTES or len(raws) >= CHUNK_DOCS):
                    yield row()
                    seq, ids, raws, size = seq + 1, [], [], 0
                ids.append(doc)
                raws.append(raw)
                size += len(raw)
        if raws:
            yield row()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "chunk long, docs binary, ends binary, text binary")


def _opened(batches, length: int):
    """(chunk, ids of its documents, ends of their texts, its bytes, parse) of each row."""
    for b in batches:
        for k in range(b.num_rows):
            ids, ends = (np.frombuffer(b.column(j)[k].as_py(), "<i8") for j in (1, 2))
            data = np.frombuffer(b.column(3)[k].as_buffer(), np.uint8)
            yield b.column(0)[k].as_py(), ids, ends, data, Parse(data, ends, length)


def _cut(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the ``ranges`` of hashes begins in a sorted array, and its end."""
    bounds = [(r << HASH_BITS) // ranges for r in range(ranges)]
    return np.append(np.searchsorted(hashes, np.array(bounds, np.uint64)), len(hashes))


def _answers(folder: str, chunk: int, n: int, kind: str) -> np.ndarray:
    """The ``n`` numbers that all ranges together sent back to a chunk."""
    raw, at, out = read_file(f"{folder}/{chunk}.bin") if n else b"", 0, [np.zeros(0, kind)]
    while at < len(raw):
        size = 8 + int(np.frombuffer(raw, "<u4", 1, at + 4)[0])
        out.append(_unpack(raw[at : at + size], (kind, 1))[0].ravel())
        at += size
    return np.concatenate(out)


def _exchange(sent: DataFrame, answer, folder: str, ranges: int) -> None:
    """Give the blobs of each range (chunk, r, blob) to ``answer``, and write what it returns to a file for each chunk.

    ``answer`` gets the blobs of all chunks of a range and returns one for each.
    """
    def groups(batches, key):
        now, rows = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if row[key] != now and rows:
                    yield now, rows
                    rows = []
                now = row[key]
                rows.append(row)
        if rows:
            yield now, rows

    def reply(batches):
        for r, rows in groups(batches, 1):
            out = answer([x[2] for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([r] * len(rows)), pa.array(out, pa.binary())], ["chunk", "r", "blob"])

    def write(batches):
        for chunk, rows in groups(batches, 0):
            write_file(f"{folder}/{chunk}.bin", b"".join(x[2] for x in rows))
            yield pa.RecordBatch.from_arrays([pa.array([chunk])], ["chunk"])

    schema = "chunk long, r long, blob binary"
    # A task takes a few neighbouring ranges, one after another.
    n = min(ranges, 4 * partitions(sent.sparkSession))
    part = F.floor(F.col("r") * n / ranges).cast("int")
    dealt = sent.repartitionById(n, part).sortWithinPartitions("r", "chunk").mapInArrow(reply, schema)
    files = dealt.repartition(partitions(sent.sparkSession), "chunk").sortWithinPartitions("chunk", "r").mapInArrow(write, "chunk long")
    files.agg(F.count("*")).collect()


def dedup_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of each row of ``docs``.

    Removes every byte covered by a string of ``length`` bytes (of UTF-8) that starts in
    a row with a smaller doc_id too; strings are judged on the input. A null text is
    empty. A null doc_id is smaller than any other (the smallest long counts as null).
    Rows that share a doc_id are not each other's predecessors. Texts shorter than
    ``length`` stay whole. The result reads two tables of this run in the shared folder.
    """
    if not 8 <= length < 4096:
        raise ValueError("length must be between 8 and 4095")
    spark = docs.sparkSession
    chunks = stored(_chunks(docs), "chunks", **{"parquet.block.size": str(4 * CHUNK_BYTES)})
    size = chunks.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    ranges = max(partitions(spark), -(-size // RANGE_BYTES))
    heavy = max(LEAST_HEAVY, HEAVY * size / ranges)
    shared, masks = shared_dir(spark, "shared-triggers"), shared_dir(spark, "repeated-windows")
    schema = "chunk long, r long, blob binary"
    width = HEAD + length + span_windows(length) - 1

    def batch(chunk, cut, arrays):
        rs = [r for r in range(ranges) if cut[r] < cut[r + 1]]
        blobs = [_pack(*(a[cut[r] : cut[r + 1]] for a in arrays)) for r in rs]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rs), pa.int64()), pa.array(rs, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "r", "blob"])

    def triggers(batches):
        for chunk, _, _, _, p in _opened(batches, length):
            h, met, _ = p.hashes()
            cut = _cut(h, ranges)
            step = np.diff(h, prepend=np.uint64(0))
            begin = cut[:-1][cut[:-1] < cut[1:]]
            step[begin] = h[begin]  # the first of a range stands whole
            yield batch(chunk, cut, (step, met))

    def held_twice(blobs):
        """0 for a trigger of one document, 1 for one of several, 2 for a heavy one."""
        parts = [_unpack(b, ("<u8", 1), ("<u4", 1)) for b in blobs]
        h, met = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), np.concatenate([x[1] for x in parts])
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        found = ((n > 1) | (np.bincount(at, met & 1) > 0)).astype(np.uint8)
        found[(found == 1) & (np.bincount(at, met >> 1) > heavy)] = 2
        return [_pack(x) for x in np.split(found[at], np.cumsum([len(x[0]) for x in parts])[:-1])]

    def repetitive(chunk, ids, p):
        """The triggers that several documents hold, and what is sent of them."""
        h, _, at = p.hashes()
        kind = _answers(shared, chunk, len(h), "u1")[at]
        p = p.pick(kind > 0)
        return p, Entries(p, kind[kind > 0] == 2, ids)

    def phrases(batches):
        for chunk, ids, _, _, p in _opened(batches, length):
            own = repetitive(chunk, ids, p)[1]
            yield batch(chunk, _cut(own.hashes(), ranges), (own.keys, own.docs))

    def repeated(blobs):
        parts = [_unpack(b, ("u1", width), ("<i8", 1)) for b in blobs]
        masks = repeated_windows(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), length)
        return [_pack(x) for x in np.split(masks, np.cumsum([len(x[1]) for x in parts])[:-1])]

    _exchange(chunks.mapInArrow(triggers, schema), held_twice, shared, ranges)
    release(spark)
    _exchange(chunks.mapInArrow(phrases, schema), repeated, masks, ranges)
    release(spark)

    def finish(batches):
        for chunk, ids, ends, data, p in _opened(batches, length):
            p, own = repetitive(chunk, ids, p)
            mask = own.masks(_answers(masks, chunk, len(own.keys), "<u8"))[own.at]
            gone = _covered(p, mask, ids[p.doc] > own.first[own.at])
            yield from _left(ids, ends, data, *gone)

    rows = chunks.mapInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.select(F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _covered(p: Parse, mask: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches under removed windows: all of a trigger's, or those in its mask."""
    some = np.flatnonzero(~whole & (mask != 0))
    bits = np.unpackbits(mask[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    single = p.first[some[row]] + bit
    start = np.concatenate([p.first[whole], single])
    end = np.concatenate([p.last[whole], single]) + p.length
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] > far[:-1]))
    return start[new], far[np.append(new[1:], len(start)) - 1]


def _left(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Rows of a chunk's documents, given the stretches to remove, in batches of a bounded size."""
    begin = np.append(0, ends[:-1])
    # Stretches of neighbouring documents may touch.
    cut = np.unique(begin[np.searchsorted(start, begin) > 0])
    inner = cut[end[np.searchsorted(start, cut) - 1] > cut] if len(cut) else cut
    start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
    at = np.searchsorted(start, np.append(begin, len(data)))
    size = ends - begin
    removed = np.append(0, np.cumsum(end - start))
    removed, spans = removed[at[1:]] - removed[at[:-1]], np.diff(at)
    for a in range(0, len(ids), 2000):
        kept = []
        for k in range(a, min(a + 2000, len(ids))):
            lo, hi = begin[k], ends[k]
            own = slice(at[k], at[k + 1])
            edges = zip([lo, *end[own]], [*start[own], hi])
            kept.append(b"".join(data[x:y].tobytes() for x, y in edges))
        part = slice(a, a + 2000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(size[part]), pa.array(removed[part]), pa.array(spans[part]), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])
