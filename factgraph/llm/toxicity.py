"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's score is a logistic function of summed word weights. A document is
toxic unless none of its sentences is: p = 1 - prod(1 - p_sentence), the noisy-or.
The weights are fitted to document labels through that formula, so they end up on
the sentences that made a document toxic, and those can be pointed out.

The fit takes a bounded sample of labelled rows (``max_train``, chosen by a hash of
doc_id, half of it for either label while they last) and runs on the driver; the
model is a weight for each word or beginning of words that the sample singles out. Scoring reads whole texts and moves
nothing between executors.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import texts

BITS = 21
WORDS_KEPT = 300_000
PART = 1 << 20
_ENDS = (".", "!", "?")
_AROUND = ".,;:!?\"'()[]|*-"
_SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?](?=\s|\Z)|(?=\n)|\Z)")


def _features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    w = word.strip(_AROUND).lower()
    if not w:
        return []
    return ["=" + w, *(w[:n] for n in range(4, min(8, len(w)) + 1))]


def _words(text: str) -> list[str]:
    """Words in order; a line's end ends a sentence as a full stop does."""
    return text.replace("\n", " . ").split()


class _Numbers(dict):
    """Numbers for words in order of meeting, with each one's weight and whether it ends a sentence."""

    def __init__(self, lexicon: "Lexicon"):
        super().__init__()
        self.exact, self.starts, self.stems = lexicon.exact, lexicon.starts, lexicon.stems
        self.values: list[float] = []
        self.ends: list[bool] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        w = word.strip(_AROUND).lower()
        value = self.exact.get(w, 0.0)
        if w[:4] in self.stems:
            value += sum(self.starts.get(w[:n], 0.0) for n in range(4, min(8, len(w)) + 1))
        self.values.append(value)
        self.ends.append(word[-1] in _ENDS)
        return k


class Lexicon:
    """Weights of words, each worked out once and kept between batches up to a bound."""

    def __init__(self, weights: dict[str, float]):
        self.exact = {f[1:]: v for f, v in weights.items() if f[0] == "="}
        self.starts = {f: v for f, v in weights.items() if f[0] != "="}
        self.stems = {f[:4] for f in self.starts}
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbers(self)
        self.value, self.end = np.zeros(0), np.zeros(0, bool)

    def numbers(self, text: str) -> np.ndarray:
        """The number of each word; very long texts are split a part at a time."""
        out, start = [], 0
        while start < len(text):
            end = text.find(" ", start + PART) if len(text) - start > PART else -1
            words = _words(text[start : end if end >= 0 else len(text)])
            out.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
            start = end if end >= 0 else len(text)
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int64), *out])

    def scores(self, many: list[str], bias: float) -> np.ndarray:
        """Noisy-or score of each text."""
        if len(self.ids) > WORDS_KEPT:
            self.clear()
        ids = [self.numbers(text) for text in many]
        if len(self.value) < len(self.ids):
            n = len(self.value)
            self.value, self.end = np.append(self.value, self.ids.values[n:]), np.append(self.end, self.ids.ends[n:])
        flat, count = np.concatenate([np.zeros(0, np.int64), *ids]), np.array([len(x) for x in ids], np.int64)
        return doc_scores(np.where(_again(flat, count), 0, self.value[flat]), self.end[flat], count, bias)


def _starts(end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where sentences begin, given words that end one and the words of each text."""
    first = np.zeros(len(end) + 1, bool)
    first[1:] = end
    first[np.concatenate([[0], np.cumsum(count)])[:-1]] = True
    return np.flatnonzero(first[: len(end)])


def _again(flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words that repeat the one before in the same text count once."""
    out = np.zeros(len(flat), bool)
    out[1:] = flat[1:] == flat[:-1]
    first = np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.int64)
    out[first[first < len(flat)]] = False
    return out


def _softplus(s: np.ndarray) -> np.ndarray:
    return np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s)))


def doc_scores(value: np.ndarray, end: np.ndarray, count: np.ndarray, bias: float) -> np.ndarray:
    """1 - prod(1 - sigmoid(s)) over each text's sentences; 0 sentences give 0."""
    total = np.zeros(len(count))
    if len(value):
        at = _starts(end, count)
        doc = np.searchsorted(np.cumsum(count), at, side="right")
        total = np.bincount(doc, _softplus(np.add.reduceat(value, at) + bias), minlength=len(count))
    return -np.expm1(-total)


def fit(rows: list[tuple[str, int]], counts: dict[int, int] | None = None, epochs: int = 200, rate: float = 0.1, decay: float = 2e-4, min_docs: int = 3, min_odd: float = 5.0) -> tuple[dict[str, float], float]:
    """Word weights and bias from (text, label) pairs. One label alone gives a constant model.

    Weights go to features of at least ``min_docs`` texts that toxic ones hold more
    often than chance, by ``min_odd`` standard deviations: with thousands of texts and
    far more words, others would only learn the sample by heart. ``counts`` has the rows
    of each label that ``rows`` were taken from: rows are weighted back to its shares, so
    that scores do not depend on how many of a label the sample could hold.
    """
    y = np.array([t for _, t in rows], float)
    if not len(y) or y.min() == y.max():
        return {}, -8.0 if not len(y) or y.max() == 0 else 8.0
    weight = np.ones(len(y))
    if counts and counts.get(0) and counts.get(1):
        share = counts[1] / (counts[0] + counts[1])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    ids: dict[str, int] = {}
    slot, until, flat = array("i"), array("q", [0]), []
    for text, _ in rows:
        own = array("i")
        for w in _words(text):
            k = ids.setdefault(w, len(ids))
            if k == len(until) - 1:
                slot.extend(zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in _features(w))
                until.append(len(slot))
            own.append(k)
        flat.append(np.array(own, np.int64))
    count, slot, until = np.array([len(x) for x in flat], np.int64), np.array(slot, np.int64), np.array(until)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for own, (_, label) in zip(flat, rows):
        own = np.unique(own)
        n = until[own + 1] - until[own]
        held = slot[np.repeat(until[own + 1] - np.cumsum(n), n) + np.arange(n.sum())]
        seen[label, np.unique(held)] += 1
    flat = np.concatenate(flat)
    end = np.fromiter((w.endswith(_ENDS) for w in ids), bool, len(ids))[flat]
    often = np.flatnonzero(seen.sum(0) >= min_docs)
    share = (weight[y == 0][0] * seen[0, often] + weight[y == 1][0] * seen[1, often]) / len(y)
    odd = (seen[1, often] - y.sum() * share) / np.sqrt(y.sum() * share * (1 - share) + 1e-9)
    usable = np.zeros(1 << BITS, bool)
    usable[often[odd >= min_odd]] = True
    pairs = np.stack([np.repeat(np.arange(len(ids)), np.diff(until)), slot], axis=1)[usable[slot]]
    slots, col = np.unique(pairs[:, 1], return_inverse=True)
    at = _starts(end, count)
    doc = np.searchsorted(np.cumsum(count), at, side="right")
    length = np.diff(np.append(at, len(flat)))
    once = ~_again(flat, count)
    theta, bias = np.zeros(len(slots)), -5.0
    m = v = np.zeros(len(slots) + 1)
    for step in range(1, epochs + 1):
        word = np.bincount(pairs[:, 0], theta[col], minlength=len(ids))
        s = np.add.reduceat(word[flat] * once, at) + bias
        none = np.bincount(doc, _softplus(s), minlength=len(y))
        g_doc = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-3), 1.0) * weight / len(y)
        g = g_doc[doc] / (1 + np.exp(-np.maximum(s, -50)))
        by_word = np.bincount(flat, np.repeat(g, length) * once, minlength=len(ids))
        grad = np.append(np.bincount(col, by_word[pairs[:, 0]], minlength=len(slots)) + decay * theta / 10, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    at_slot = dict(zip(slots.tolist(), theta.tolist()))
    met = np.zeros(len(ids), bool)
    met[pairs[:, 0]] = True
    named = ((w, slot[until[k] : until[k + 1]].tolist()) for k, w in enumerate(ids) if met[k])
    weights = {f: at_slot[k] for w, own in named for f, k in zip(_features(w), own) if k in at_slot}
    return weights, float(bias)


def held_out(doc_id) -> F.Column:
    """True for the rows whose labels must stay unseen."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled documents outside the held-out third."""
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def label_counts(labels: DataFrame) -> dict[int, int]:
    """How many documents outside the held-out third have each label."""
    return {r.toxic: r.n for r in usable_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> list[tuple[str, int]]:
    """At most ``max_train`` (text, label) pairs outside the held-out third, the same ones each time."""
    own = usable_labels(labels)
    rank = F.xxhash64("doc_id")
    picked = own.filter("toxic = 1").orderBy(rank, "doc_id").limit(max_train // 2).unionByName(own.filter("toxic = 0").orderBy(rank, "doc_id").limit(max_train // 2))
    # At most max_train rows of two numbers.
    rows = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def score_documents(docs: DataFrame, weights: dict[str, float], bias: float, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and the offending sentences of predicted rows, for each row.

    ``offending`` holds (start, end, score) of the sentences with a score of 0.5 or
    more, in code points, or the worst one if none has; it is empty for other rows.
    Null and empty texts have no sentence and score 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        words = Lexicon(model.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                many = part.column(1).to_pylist()
                p = words.scores(many, bias)
                spans = [located(t, words, bias) if x >= threshold else [] for t, x in zip(many, p)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    ["doc_id", "score", "predicted", "offending"],
                )

    return texts(docs).mapInArrow(score, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def located(text: str, words: Lexicon, bias: float) -> list[dict]:
    """The sentences that make ``text`` toxic."""
    spans = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]
    if not spans:
        return []
    p = words.scores([text[a:b] for a, b in spans], bias)
    bad = [i for i in range(len(p)) if p[i] >= 0.5] or [int(np.argmax(p))]
    return [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in bad]


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 6000, threshold: float = 0.7) -> DataFrame:
    """Fit on ``labels`` outside the held-out third and score every row of ``docs``.

    Returns what score_documents does, and ``held_out``. Without usable labels every
    non-empty text gets a score near 0. Rows with a null doc_id are scored and never
    learnt from.
    """
    weights, bias = fit(training_rows(docs, labels, max_train), label_counts(labels))
    return score_documents(docs, weights, bias, threshold).withColumn("held_out", held_out(F.col("doc_id")))


def keep_clean(docs: DataFrame, weights: dict[str, float], bias: float, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def clean(batches):
        words = Lexicon(model.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                p = words.scores([t or "" for t in part.column(at).to_pylist()], bias)
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(clean, docs.schema)
