"""Token-id output: fixed-width bit packing with block offsets.

A shard is one file. Its ids form one stream, cut into blocks of ``BLOCK`` ids; a
block packs each id into ``width`` bits (the least that hold the vocabulary) and
starts on a byte. Any id range is read by seeking to its blocks and unpacking them
with numpy; any document by its place in the table of starts.

    magic | packed blocks | block offsets u64 | doc starts u64 | doc_ids i64 | null flags u8 | footer json | its length u32 | magic

Documents are dealt to shards by range of doc_id, so shard order is document
order. A task streams its shard to a file of its own name and returns one manifest
row; files of failed attempts are in no manifest and never read. Rows with the same
doc_id are told apart by a hash of the text, so even a doc_id that a third of all
rows share is dealt over many shards.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import open_fs, partitions, shared_dir, stored, texts

MAGIC = b"IDBITS01"
BLOCK = 1 << 16
READ_IDS = 1 << 20
CHUNKS_KEPT = 900_000
ATOMS_KEPT = 150_000
_TAILS = ".,;:!?|"
_SPACE = "\u0120"  # how byte-level vocabularies write a space (fixed value)


def id_width(vocabulary: int) -> int:
    """Bits for ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first, padded to a byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class ShardWriter:
    """Streams documents into one file; holds one block and the table of starts."""

    def __init__(self, uri: str, width: int):
        self.fs, path = open_fs(uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.at = self.fs.open_output_stream(path), width, len(MAGIC)
        self.out.write(MAGIC)
        self.open, self.held, self.n = [], 0, 0
        self.offsets, self.starts, self.ids, self.nulls = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.starts.append(self.n)
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.n += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            flat = np.concatenate(self.open)
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(flat[k : k + BLOCK])
            self.open, self.held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        raw = pack(ids, self.width)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.open))
        self.starts.append(self.n)
        for values, kind in ((self.offsets + [self.at], "<u8"), (self.starts, "<u8"), (self.ids, "<i8"), (self.nulls, "u1")):
            self.out.write(np.array(values, kind).tobytes())
        footer = json.dumps({"width": self.width, "ids": self.n, "docs": len(self.ids), "blocks": len(self.offsets), "tables": self.at}).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()


class ShardReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.src = fs.open_input_file(path)
        size = self.src.size()
        tail = self.src.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.src.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n = struct.unpack("<I", tail[:4])[0]
        meta = json.loads(self.src.read_at(n, size - 12 - n))
        self.width, self.n, docs, blocks = meta["width"], meta["ids"], meta["docs"], meta["blocks"]
        raw, at = self.src.read_at(size - 12 - n - meta["tables"], meta["tables"]), 0
        tables = []
        for count, kind in ((blocks + 1, "<u8"), (docs + 1, "<u8"), (docs, "<i8"), (docs, "u1")):
            tables.append(np.frombuffer(raw, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.offsets, self.starts, self.doc_ids, nulls = tables
        self.nulls = nulls.astype(bool)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the shard."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        raw = self.src.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            own = raw[int(self.offsets[k] - self.offsets[first]) : int(self.offsets[k + 1] - self.offsets[first])]
            out.append(unpack(own, min(BLOCK, self.n - k * BLOCK), self.width))
        return np.concatenate(out)[a - first * BLOCK : b - first * BLOCK]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.src.close()


class Generations:
    """A bounded cache: when the new half is full it becomes the old one; what is used again moves back."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new

    def missing(self, keys: set) -> set:
        """Keys that neither half holds; others are in the new half afterwards."""
        new, old = self.new, self.old
        keys = keys.difference(new)
        known = [k for k in keys if k in old]
        if known:
            new.update([(k, old[k]) for k in known])
            keys.difference_update(known)
        return keys


class Encoder:
    """A byte-level BPE of the tokenizers library, asked once for each distinct piece of text.

    The splitter of such vocabularies begins a new token at every space that a
    non-space follows, keeps letters apart from other marks, and a lone line feed
    apart from both. So a text is cut at such spaces, cut pieces are looked up, and
    only unknown ones go to the library; ids are those of the whole text. A text that
    holds one of the vocabulary's added tokens (``<|endoftext|>``) goes to the library
    whole, which gives such a token its own id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocabulary = self.tok.get_vocab_size()
        self.spaced = np.zeros(max(self.tok.get_vocab().values(), default=0) + 1, bool)
        self.spaced[[k for t, k in self.tok.get_vocab().items() if _SPACE in t]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks, self.atoms = Generations(CHUNKS_KEPT), Generations(ATOMS_KEPT)
        self.tails = dict(zip(_TAILS, self._ask(list(_TAILS))))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that begin where a token must begin; all but the first without their space."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    @staticmethod
    def split_atoms(chunk: str) -> list[str]:
        parts = chunk.split("\n")
        if len(parts) > 1:
            for k, p in enumerate(parts):
                if not p or p[-1].isspace() or (k and p[0].isspace()):
                    return [chunk]
        out = []
        for k, p in enumerate(parts):
            if k:
                out.append("\n")
            body = p.rstrip(_TAILS)
            n = len(body)
            if 0 < n < len(p) and (body[1:] if body[0] == " " else body).isalpha():
                out += (body, p[n:])
            else:
                out.append(p)
        return out

    def _ask(self, texts: list[str]) -> list[bytes]:
        """The library's ids of texts that the splitter would cut out whole."""
        out = []
        for k in range(0, len(texts), 20_000):
            out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
        return out

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """The library's ids of words behind a space, many in one text: each begins with the only token that holds a space."""
        out = []
        for k in range(0, len(words), 500 * 64):
            groups = [words[a : a + 500] for a in range(k, min(k + 500 * 64, len(words)), 500)]
            for own, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = (np.flatnonzero(self.spaced[ids]) * 4).tolist()
                if len(at) != len(own):
                    out += self._ask([" " + w for w in own])
                    continue
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Look up pieces that follow a space (without it). A word with one mark behind it is made of both."""
        new = self.chunks.new
        words = {c for c in chunks if c.isalpha()}
        rest = chunks - words
        marked = [c for c in rest if c[-1] in _TAILS and c[:-1].isalpha()]
        words |= self.chunks.missing({c[:-1] for c in marked})
        words = list(words)
        new.update(zip(words, self._ask_words(words)))
        tails = self.tails
        new.update([(c, new[c[:-1]] + tails[c[-1]]) for c in marked])
        self.atoms.turn()
        cuts = {c: self.split_atoms(" " + c) for c in rest.difference(marked)}
        self.learn_atoms({a for own in cuts.values() for a in own})
        for c, own in cuts.items():
            new[c] = b"".join([self.atoms.new[a] for a in own])

    def learn_atoms(self, atoms: set[str]) -> None:
        missing = list(self.atoms.missing(atoms))
        self.atoms.new.update(zip(missing, self._ask(missing)))

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        # Of what is made here nothing refers back to itself; looking for cycles among so many objects takes time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_any(many)
        finally:
            if collecting:
                gc.enable()

    def _encode_any(self, many: list[str]) -> list[np.ndarray]:
        odd = {k for token in self.added for k, text in enumerate(many) if token in text}
        if not odd:
            return self._encode(many)
        out = self._encode(["" if k in odd else text for k, text in enumerate(many)])
        for k in odd:
            out[k] = np.array(self.tok.encode(many[k], add_special_tokens=False).ids, "<u4")
        return out

    def _encode(self, many: list[str]) -> list[np.ndarray]:
        self.chunks.turn()
        cuts = [text.split(" ") for text in many]
        first = [parts[0] for parts in cuts]
        for parts in cuts:
            del parts[0]
        seen = set().union(*cuts)
        unknown = seen.difference(self.chunks.new)
        odd = {p for p in unknown if not p or p[0].isspace()}
        if odd:  # pieces at which no token need begin
            unknown -= odd
            for k, parts in enumerate(cuts):
                if not odd.isdisjoint(parts):
                    first[k], *cuts[k] = self.cut(many[k])
                    unknown.update(cuts[k])
        self.learn(self.chunks.missing(unknown))
        heads = [self.split_atoms(x) if x else [] for x in first]
        self.learn_atoms({a for own in heads for a in own})
        ids, atoms = self.chunks.new.__getitem__, self.atoms.new.__getitem__
        return [np.frombuffer(b"".join([*map(atoms, own), *map(ids, parts)]), "<u4") for own, parts in zip(heads, cuts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, with what it has learnt from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id``, write shards below ``folder``; the manifest.

    The manifest has a row for each shard: shard (its place in document order), file,
    n_docs, n_ids. Null texts are empty ones; null doc_ids come first.
    """

    def encode(batches):
        enc, out, file = encoder(tokenizer), None, ""
        end = np.array([end_id], "<u4")
        for b in batches:
            ids, many = b.column(0).to_pylist(), b.column(1)
            for k in range(0, len(ids), 256):
                for doc_id, own in zip(ids[k : k + 256], enc.encode(many.slice(k, 256).to_pylist())):
                    if out is None:
                        file = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                        out = ShardWriter(file, id_width(max(enc.vocabulary, end_id + 1)))
                    out.add(doc_id, np.concatenate([own, end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), file, len(out.ids), out.n)], ["shard", "file", "n_docs", "n_ids"])

    order = (F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("text"))
    rows = texts(docs).withColumn("_h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    return stored(dealt.select("doc_id", "text").mapInArrow(encode, "shard long, file string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, digest: bool = True) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32, and ids if not ``digest``."""
    shards = sorted(manifest.collect(), key=lambda r: r.shard)  # a row for each task that wrote
    base, plan = 0, []
    for r in shards:
        plan.append((r.file, base))
        base += r.n_ids

    def read(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = ShardReader(file)
                k, docs = 0, len(f.doc_ids)
                while k < docs:
                    end = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + READ_IDS, side="right")) - 1)
                    end = min(end, docs)
                    own = f.starts[k : end + 1].astype(np.int64)
                    if end == k + 1:  # it may be longer than one reading
                        crc, parts = 0, []
                        for a in range(int(own[0]), int(own[1]), READ_IDS):
                            ids = f.ids(a, min(a + READ_IDS, int(own[1]))).astype("<u4")
                            crc = zlib.crc32(ids.tobytes(), crc)
                            parts += [] if digest else [ids]
                        crcs, flat = [crc], np.concatenate(parts) if parts else np.zeros(0, "<u4")
                    else:
                        flat = f.ids(int(own[0]), int(own[-1])).astype("<u4")
                        raw = memoryview(flat.tobytes())
                        at = ((own - own[0]) * 4).tolist()
                        crcs = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])]
                    cols = [pa.array(f.doc_ids[k:end], mask=f.nulls[k:end]), pa.array(own[:-1] + start), pa.array(np.diff(own)), pa.array(crcs, pa.int64())]
                    if not digest:
                        cols.append(pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    k = end
                f.close()

    todo = spark.createDataFrame(plan, "file string, base long").repartition(max(1, len(plan)))
    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest else ", ids array<int>"))


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, digest: bool = True) -> DataFrame:
    """Write ``docs`` as token files in ascending doc_id order and read them back.

    Empty input writes no file and gives no rows. Rows that share a doc_id follow each
    other in an order fixed by their texts.
    """
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or shared_dir(spark, "token-files"), tokenizer, end_id), digest)
