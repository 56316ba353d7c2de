"""SentencePiece BPE, encoded by vectorised merge rounds.

Words (a run of word marks and what follows up to the next) never merge with each
other, so distinct words are gathered and encoded together. All their symbols lie
in one flat array. In each round the best pair rank of every word is found by a
segmented minimum, the leftmost pairs of that rank are merged in all words at once,
and the array is compacted; words without a pair left are done.

Merging several pairs of a word in one round is the same as one after another as
long as no merge gives rise to a pair of the same or a better rank; where one does,
the word's later pairs wait for the next round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factgraph.llm.common import texts

MARK = "▁"
NONE = np.int32(2**31 - 1)
WORDS_KEPT = 250_000
WORDS_AT_ONCE = 40_000


def _fields(raw: bytes):
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """The tables of one model file: pieces, pair ranks, byte pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        norm = dict(_fields(next(v for k, v in top if k == 3)))
        train = dict(_fields(next(v for k, v in top if k == 2)))
        if train.get(3, 1) != 2 or not train.get(35, 0) or norm.get(1) != b"identity" or norm.get(4, 1) or not norm.get(5, 1) or norm.get(2) or train.get(24, 0):
            raise ValueError("only BPE models with byte fallback, without normalisation, are supported")
        self.prefix = bool(norm.get(3, 1))
        self.pieces, scores, kinds = [], [], []
        for k, v in top:
            if k == 1:
                own = dict(_fields(v))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(np.frombuffer(own[2], "<f4")[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = kinds.index(2)
        self.byte = np.full(256, self.unknown, np.int32)
        self.surface: list[bytes] = []
        self.is_byte = np.array(kinds) == 6
        for k, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind == 6:
                self.byte[int(p[3:5], 16)] = k
                self.surface.append(bytes([int(p[3:5], 16)]))
            else:
                self.surface.append({1: p.replace(MARK, " ").encode(), 2: b" \xe2\x81\x87 ", 3: b""}[kind])
        normal = {p: k for k, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that run across words are not supported")
        # Symbols: pieces by id, then single characters that only occur inside pieces.
        chars = sorted({c for p in normal for c in p})
        self.symbol = dict(normal)
        for c in chars:
            self.symbol.setdefault(c, len(self.pieces) + len(self.symbol) - len(normal))
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        self.char_symbol = np.array([self.symbol[c] for c in chars], np.int32)
        order = {s: r for r, s in enumerate(sorted({-scores[k] for k in normal.values()}))}
        pairs = {}
        for p, k in normal.items():
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = (order[-scores[k]], k)
        self._table(pairs)

    def _table(self, pairs: dict) -> None:
        """Open addressing; ``probes`` is the longest search."""
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full((1 << self.bits) + 64, np.uint64(2**64 - 1))
        self.rank = np.full(len(self.keys), NONE)
        self.merged = np.full(len(self.keys), -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(left):
            if self.probes >= 60:
                raise ValueError("pair table is too dense")
            at = slot[left] + self.probes
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = keys[left[put]]
            self.rank[at[put]], self.merged[at[put]] = values[left[put], 0], values[left[put], 1]
            left = left[~put]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; NONE for pairs that don't merge."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | (b.astype(np.uint64) & np.uint64(0xFFFFF))
        slot = self._slot(keys)
        at = np.full(len(keys), len(self.keys) - 1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        for p in range(self.probes):
            here = slot[todo] + p
            held = self.keys[here]
            hit = held == keys[todo]
            at[todo[hit]] = here[hit]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            if not len(todo):
                break
        return self.rank[at], self.merged[at]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words hold their marks already."""
        length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[at] == points, self.char_symbol[at], -1 - points.astype(np.int64)).astype(np.int32)
        word = np.repeat(np.arange(len(words)), length)
        done_sym, done_word = [], []
        while len(sym):
            rank, merged = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
            same = word[:-1] == word[1:]
            i = np.flatnonzero(same)
            rank[i], merged[i] = self.pair(sym[i], sym[i + 1])
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            best_at = np.repeat(best, size)
            idle = best_at == NONE
            if idle.any():
                done_sym.append(sym[idle])
                done_word.append(word[idle])
                keep = ~idle
                sym, word, rank, merged, best_at = sym[keep], word[keep], rank[keep], merged[keep], best_at[keep]
                if not len(sym):
                    break
            cand = np.flatnonzero(rank == best_at)
            # Of pairs that overlap in a row, every second one from the left.
            new_run = np.concatenate([[True], (np.diff(cand) != 1)])
            run_start = cand[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            cand = cand[(cand - run_start) % 2 == 0]
            m, w, limit = merged[cand], word[cand], best_at[cand]
            bad = np.zeros(len(cand), bool)
            left = np.maximum(cand - 1, 0)
            has = (cand > 0) & (word[left] == w)
            close = np.concatenate([[False], np.diff(cand) == 2]) & has
            before = np.where(close, np.concatenate([[0], m[:-1]]), sym[left])
            j = np.flatnonzero(has)
            bad[j] = self.pair(before[j], m[j])[0] <= limit[j]
            right = np.minimum(cand + 2, len(sym) - 1)
            j = np.flatnonzero((cand + 2 < len(sym)) & (word[right] == w))
            bad[j] |= self.pair(m[j], sym[right[j]])[0] <= limit[j]
            seen = np.cumsum(bad) - bad
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            seen -= np.repeat(seen[first], np.diff(np.append(first, len(cand))))
            use = seen == 0
            cand, m = cand[use], m[use]
            sym[cand] = m
            stay = np.ones(len(sym), bool)
            stay[cand + 1] = False
            sym, word = sym[stay], word[stay]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        odd = (sym < 0) | (sym >= len(self.pieces))
        odd_words = set(word[odd].tolist())
        out = []
        for k in range(len(words)):
            own = sym[cuts[k] : cuts[k + 1]]
            if k in odd_words:
                own = np.concatenate([self._bytes(int(s)) if s < 0 or s >= len(self.pieces) else np.array([s], np.int32) for s in own])
            out.append(own)
        return out

    def _bytes(self, symbol: int) -> np.ndarray:
        if symbol < 0:
            char = chr(-1 - symbol)
        else:
            char = chr(int(self.chars[np.flatnonzero(self.char_symbol == symbol)[0]]))
        return self.byte[np.frombuffer(char.encode(), np.uint8)]

    def split(self, text: str) -> list[str]:
        """Words, without their first mark (further marks are spaces)."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text:
            return []
        parts = text.split(" ")
        if not self.prefix:
            raise ValueError("models without a leading mark are not supported")
        if "" not in parts:
            return parts
        out, held = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * held + p)
                held = 0
            else:
                held += 1
        if parts[-1] or held == 0:
            out.append(" " * held + parts[-1])
        else:
            out.append(" " * held)
        return out

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD each."""
        out, run = [], bytearray()
        started = False
        for k in ids:
            if self.is_byte[k]:
                run += self.surface[k]
                continue
            out.append(_utf8(bytes(run)))
            run.clear()
            s = self.surface[k].decode()
            if not started and not any(out) and self.prefix and s.startswith(" ") and k != self.unknown:
                s = s[1:]
            started = True
            out.append(s)
        out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Every byte outside valid sequences becomes one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class WordCache:
    """Ids and decoded bytes of words, kept between batches up to a bound."""

    def __init__(self, model: PieceModel):
        self.model, self.at, self.ids, self.text = model, {}, [], []

    def encode(self, many: list[str]) -> tuple[list[bytes], list[bytes]]:
        """(ids as int32 bytes, decoded UTF-8) of each text."""
        if len(self.ids) > WORDS_KEPT:
            self.at, self.ids, self.text = {}, [], []
        cuts = [self.model.split(t) for t in many]
        new = list(set().union(*cuts).difference(self.at))
        for k in range(0, len(new), WORDS_AT_ONCE):
            part = new[k : k + WORDS_AT_ONCE]
            for w, ids in zip(part, self.model.encode_words([MARK + w.replace(" ", MARK) for w in part])):
                self.at[w] = len(self.ids)
                self.ids.append(ids.astype("<i4").tobytes())
                self.text.append(b"".join([self.model.surface[i] for i in ids.tolist()]))
        ids, decoded = [], []
        for own in cuts:
            at = [self.at[w] for w in own]
            ids.append(b"".join(map(self.ids.__getitem__, at)))
            decoded.append(b"".join(map(self.text.__getitem__, at))[1:])  # without the leading mark
        return ids, decoded


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded (the text that the ids stand for) of each row.

    Null texts are empty ones, and have no ids. A task holds one batch and a bounded
    cache of words; nothing is shuffled.
    """

    def run(batches):
        cache = WordCache(PieceModel(model_path))  # not kept: a reused process would hold it while other stages run
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids, decoded = cache.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary()).cast(pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
