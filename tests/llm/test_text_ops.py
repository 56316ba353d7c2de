"""Text operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factgraph.llm import jaccard_join, line_dedup, passage_dedup, piece_bpe, preference_format, soft_mixing, token_files, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string"
VOCABULARY = [f"w{k:02d}" for k in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    shared, line = say(60), "  A line that MANY texts hold \t"
    out = [(None, None), (1, ""), (2, None), (3, "   "), (4, say(3)), (5, "é" * 70 + "漢字😀"), (6, "x" * 300)]
    for k in range(10, 40):
        parts = [say(r.randint(1, 80))]
        if k % 3 == 0:
            parts.append(shared)
        if k % 2 == 0:
            parts += [line, line.upper()]
        out.append((k, "\n".join(parts)))
    out += [(40, out[20][1]), (41, out[20][1]), (41, out[20][1]), (42, out[21][1] + " w99"), (None, out[22][1]), (7, say(20_000)), (20, "another text with id 20 " + shared)]
    return out


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def key(doc_id):
    return -(2**63) if doc_id is None else doc_id


def lines_left(rows):
    """Brute force: (doc_id, text, lines, lines dropped)."""

    def line_key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= 20 else None

    split = [((i), (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in split:
        for k in {line_key(x) for x in lines} - {None}:
            holders.setdefault(k, set()).add(i)
    want = []
    for i, lines in split:
        drop = [(k := line_key(x)) is not None and len(holders[k]) >= 3 and key(i) != max(map(key, holders[k])) for x in lines]
        want.append((i, "\n".join(x for x, d in zip(lines, drop) if not d), len(lines), sum(drop)))
    return want


def test_line_dedup(spark, rows):
    want = [(str(i), *rest) for i, *rest in lines_left(rows)]
    got = [(str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 20
    again = [(5, "a line that two documents hold in three rows")] * 2 + [(6, "a line that two documents hold in three rows"), (None, ""), (None, "")]
    assert {r.n_dropped for r in line_dedup.dedup_lines(frame(spark, again)).collect()} == {0}
    kept = line_dedup.dedup_frame(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(rows)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        h1[: n // 2] = 7  # told apart by the second half only
        m = line_dedup.PerfectHash.build(h1, h2)
        assert sorted(m.index(h1, h2).tolist()) == list(range(n))
    shard = line_dedup.Shard(line_dedup.Shard.dump(h1, h2, np.arange(n) + 1, np.arange(n)))
    count, last = shard.probe(h1, h2)
    assert count.tolist() == [k + 1 for k in range(n)] and last.tolist() == list(range(n))
    assert not shard.probe(h1, h2 ^ np.uint64(1))[0].any()


def removed(rows, length):
    """Brute force: (doc_id, bytes, bytes removed, spans, what is left)."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raws:
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, 2**63), key(i))
    want = []
    for i, b in raws:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key(i):
                gone[a : a + length] = b"\x01" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return want


@pytest.mark.parametrize("length", [50, 20])
def test_passage_dedup(spark, rows, length):
    want = removed(rows, length)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passage_dedup.dedup_passages(frame(spark, rows), length).collect()]
    assert sorted(got) == sorted(want)
    assert passage_dedup.dedup_passages(frame(spark, rows).limit(0), length).count() == 0


def test_every_window_has_one_trigger(monkeypatch):
    r = random.Random(5)
    raws = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 0, 3000)] + [b"ab" * 900, b"\0" * 300]
    data, ends = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(x) for x in raws])

    def found():
        p, out = passage_dedup.Parse(data, ends, 50), {}
        for h, t, a, b, d in zip(p.hash, p.place, p.first, p.last, p.doc):
            for w in range(a, b + 1):
                assert w not in out and ends[d] - len(raws[d]) <= w <= t <= w + 26 and w + 50 <= ends[d]
                out[w] = (int(h), int(t) - w)
        return out

    whole = found()
    assert len(whole) == sum(max(0, len(x) - 49) for x in raws)
    by_text = {}
    for w, trigger in whole.items():
        assert by_text.setdefault(data[w : w + 50].tobytes(), trigger) == trigger
    monkeypatch.setattr(passage_dedup, "PIECE", 64)
    assert found() == whole


@pytest.mark.parametrize("heavy", [0, 5, 1000])
def test_passages_of_any_shape(spark, monkeypatch, heavy):
    # Small chunks and ranges, few letters: repeats meet across chunks, pieces and documents' ends.
    monkeypatch.setattr(passage_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(passage_dedup, "RANGE_BYTES", 400)
    monkeypatch.setattr(passage_dedup, "LEAST_HEAVY", heavy)
    monkeypatch.setattr(passage_dedup, "HEAVY", 0)
    r = random.Random(11)
    some = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(30)]
    texts = [(r.choice([None, *range(40)]), "".join(r.choice(some) for _ in range(r.randint(0, 6)))) for _ in range(80)] + [(99, "x" * 5000), (98, "x" * 60), (97, "ab" * 300)]
    for length in (20, 50):
        want = removed(texts, length)
        got = [(str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in passage_dedup.dedup_passages(frame(spark, texts), length).collect()]
        assert sorted(got) == sorted(want)


def test_a_third_of_all_rows_share_a_doc_id(spark):
    r = random.Random(12)
    texts = [(7 if k % 3 == 0 else k, " ".join(r.choice(VOCABULARY) for _ in range(r.randint(5, 60))) + " the one passage that they all of them hold, from its first word to its last") for k in range(120)]
    got = [(str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in passage_dedup.dedup_passages(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(removed(texts, 50))


def jaccard(rows, words=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    distinct = list(dict.fromkeys(sets))
    near = {s: set() for s in distinct}
    for a in distinct:
        for b in distinct:
            if a != b and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                near[a].add(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out, groups = [], set()
    for (i, _), s in zip(rows, sets):
        group, todo = set(), [s]
        while todo:
            if (x := todo.pop()) not in group:
                group.add(x)
                todo += near[x]
        groups.add(frozenset(group))
        out.append((str(i), least(j for (j, _), x in zip(rows, sets) if x == s), least(j for (j, _), x in zip(rows, sets) if x in group), sets.count(s), len(near[s])))
    return out, len(groups)


def test_jaccard_join(spark, rows, monkeypatch):
    r = random.Random(9)
    base = [r.choice(VOCABULARY) for _ in range(200)]
    many = list(rows)
    for k in range(30):  # near copies of one text, more than a tile holds
        own = list(base)
        own[r.randrange(200)] = f"new{k}"
        many.append((100 + k, " ".join(own)))
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    got = [(str(x.doc_id), x.copy_id, x.class_id, x.n_copies, x.n_links) for x in jaccard_join.near_duplicates(frame(spark, many)).collect()]
    want, groups = jaccard(many)
    assert sorted(got, key=str) == sorted(want, key=str) and max(w[4] for w in want) >= 29
    kept = jaccard_join.one_of_each(frame(spark, many))
    assert kept.count() == groups
    clash = frame(spark, many[:12]).withColumns({"_row": F.lit(1), "_k0": F.lit("own"), "a.b": F.lit(2)})
    assert {(x["_row"], x["_k0"], x["a.b"]) for x in jaccard_join.one_of_each(clash).collect()} == {(1, "own", 2)}
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert jaccard_join.near_duplicates(frame(spark, many).limit(0)).count() == 0


def test_forest_meets_its_recall():
    for threshold in (0.5, 0.6, 0.8, 0.95, 1.0):
        for recall in (0.9, 0.9995):
            trees, depth = jaccard_join.forest_shape(threshold, recall)
            assert 1 - (1 - threshold**depth) ** trees >= recall and depth >= jaccard_join.LEAST_DEPTH
    with pytest.raises(ValueError):
        jaccard_join.forest_shape(0.2, 0.9995)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_recall_against_all_pairs(spark, threshold):
    r = random.Random(21)
    many = []
    for k in range(150):  # pairs of texts at all similarities around the threshold
        base = [r.choice(VOCABULARY) for _ in range(150)]
        own = list(base)
        for _ in range(r.randint(1, 12)):
            own[r.randrange(150)] = f"new{k}"
        many += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    want = sum(w[4] for w in jaccard(many, threshold=threshold)[0])
    got = jaccard_join.near_duplicates(frame(spark, many), threshold=threshold, recall=0.99).agg(F.sum("n_links")).first()[0]
    assert want > 60 and 0.97 * want <= got <= want


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    special = ["a <|endoftext|> b", "a  <|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|> \n", "<|endoftext| >"]
    texts = [*rows, (50, "<|endoftext|> a  b\n\n c\t don't 12,3"), (51, " lead"), (52, "a \n b"), (53, "x y "), *enumerate(special, 54)]
    assert tok.encode(special[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = token_files.token_output(frame(spark, texts), path, digest=False, folder=f"file://{tmp_path}/t").orderBy("start").collect()
    start, seen = 0, []
    for r in got:
        raw = np.array(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw), zlib.crc32(raw.tobytes())) and raw[-1] == 0
        start += len(raw)
        seen.append((str(r.doc_id), tuple(r.ids)))
    assert sorted(seen) == sorted((str(i), (*tok.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in texts)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=key)
    assert token_files.token_output(frame(spark, rows).limit(0), path).count() == 0


def test_packing_and_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(2)
    assert [token_files.id_width(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]
    for width in (1, 7, 8, 13, 16, 17, 32):
        docs = [rng.integers(0, 2**width, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500)]
        w = token_files.ShardWriter(f"file://{tmp_path}/{width}.ids", width)
        for k, d in enumerate(docs):
            w.add(None if k == 2 else k, d)
        w.close()
        r = token_files.ShardReader(f"file://{tmp_path}/{width}.ids")
        assert all((r.doc(k) == d).all() and len(r.doc(k)) == len(d) for k, d in enumerate(docs))
        whole = np.concatenate(docs)
        assert all((r.ids(a, b) == whole[a:b]).all() for a, b in ((0, 0), (0, 1), (60, 70), (63, 129), (5, len(whole))))
        assert r.nulls.tolist() == [False, False, True, False, False, False]


def test_sentencepiece(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(4)
    odd = ["", " ", "  a", "a  ", "▁x▁▁", "\x00é漢😀", "aaaaaaaa" * 40, "ab" * 200, "\n\t \n"]
    bits = ["a", "th", " ", "  ", "\n", "é", "漢", "1", "▁", "Aa", "́", "\x01"]
    odd += ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(300)]
    texts = [*rows, *enumerate(odd, 1000)]
    got = {(str(x.doc_id), tuple(x.ids), x.decoded) for x in piece_bpe.encode_documents(frame(spark, texts), path).collect()}
    assert got == {(str(i), tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in texts}
    model = piece_bpe.PieceModel(path)
    for _ in range(500):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 9))]
        assert model.decode(ids) == sp.decode(ids)


def toxic_rows():
    r = random.Random(6)
    out = []
    for k in range(600):
        sentences = [" ".join(r.choice(VOCABULARY) for _ in range(8)) + "." for _ in range(r.randint(1, 9))]
        bad = k % 4 == 0
        if bad:
            sentences.insert(r.randrange(len(sentences) + 1), f"you {r.choice(['vile', 'nasty', 'rotten'])} {r.choice(VOCABULARY)}!")
        out.append((k, " ".join(sentences), int(bad)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "you vile thing!"), (9000, None), (9001, "")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 603 and got[9000].score == got[9001].score == 0 and got[9000].predicted == 0
    for i, t, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == y and 0 <= got[i].score <= 1
        assert bool(got[i].offending) == bool(y)
        if y:
            assert any("vile" in t[s.start : s.end] or "nasty" in t[s.start : s.end] or "rotten" in t[s.start : s.end] for s in got[i].offending)
    assert got[None].predicted == 1 and not got[None].held_out
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.filter("predicted = 1").count() == 0
    seen = toxicity.training_rows(docs, labels, 100)
    assert len(seen) == 100 and sum(y for _, y in seen) == 50
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not held & {t for t, _ in seen}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_weighted_back(spark):
    # A word that six of ten toxic texts hold, and six of a hundred others; a tenth is toxic.
    r = random.Random(13)
    say = lambda rude: " ".join([*(r.choice(VOCABULARY) for _ in range(8)), *(["rude"] if rude else [])]) + "."
    toxic = [(say(k % 10 < 6), 1) for k in range(400)]
    clean = [(say(k % 50 < 3), 0) for k in range(3600)]
    score = lambda w, b: toxicity.Lexicon(w).scores(["so rude.", "w01 w02."], b)
    whole = score(*toxicity.fit(toxic + clean))
    part = score(*toxicity.fit(toxic + clean[:400], {0: 3600, 1: 400}))
    assert np.abs(whole - part).max() < 0.1
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(500)], "doc_id long, quality int, toxic int")
    assert toxicity.label_counts(labels) == {y: sum((k % 10 == 0) == y and zlib.crc32(str(k).encode()) % 3 != 1 for k in range(500)) for y in (0, 1)}


def noisy_or(text, weights, bias):
    """Brute force: the score of a text from the weights of its words."""
    clean, before = 1.0, None
    sentence, open_ = 0.0, False
    for w in [*text.replace("\n", " . ").split(), None]:
        if w is None:
            clean *= 1 - 1 / (1 + math.exp(-sentence - bias)) if open_ else 1
            break
        bare = w.strip(".,;:!?\"'()[]|*-").lower()
        own = weights.get("=" + bare, 0.0) + sum(weights.get(bare[:n], 0.0) for n in range(4, min(8, len(bare)) + 1))
        sentence, open_ = sentence + (0.0 if w == before else own), True
        before = w
        if w[-1] in ".!?":
            clean *= 1 - 1 / (1 + math.exp(-sentence - bias))
            sentence, open_ = 0.0, False
    return 1 - clean


def test_scores_are_noisy_or(monkeypatch):
    r = random.Random(31)
    bits = ["vile", "vile", "Vile!", "nasty.", "(nasty)", "vilest", "w01", "w02.", "\n", "...", "a", "rotten|", "é!", "x" * 300]
    weights = {"=vile": 2.5, "vile": 1.0, "=nasty": 3.0, "nast": -0.5, "rott": 1.5, "rotten": 0.7, "=a": 0.1}
    texts = ["", "  ", "\n\n", *(" ".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(300))]
    for part in (1 << 20, 20):
        monkeypatch.setattr(toxicity, "PART", part)
        got = toxicity.Lexicon(weights).scores(texts, -3.0)
        assert np.abs(got - [noisy_or(t, weights, -3.0) for t in texts]).max() < 1e-9


def test_toxicity_does_not_depend_on_neighbours():
    words = toxicity.Lexicon({"=vile": 9.0})
    one = words.scores(["vile"], -5.0)[0]
    assert one > 0.9 and words.scores(["vile", "vile", "", "vile", "a vile", "vile vile"], -5.0).round(9).tolist() == [round(x, 9) for x in (one, one, 0.0, one, one, one)]
    spans = toxicity.located("vile\nvile\nvile", words, -5.0)
    assert len(spans) == 3


def test_soft_mixing(spark):
    r = random.Random(8)
    rows = []
    for k in range(300):
        n = r.randint(5, 80)
        rows.append((k, " | ".join(VOCABULARY[:n]) if k % 5 == 0 else " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."))
    docs = frame(spark, [*rows, (None, "some words"), (900, None), (901, "")])
    labels = spark.createDataFrame([(k, "poor" if k % 5 == 0 else "fine") for k in range(0, 300, 2)] + [(None, "fine"), (3, None)], "doc_id long, domain string")
    targets = {"fine": 0.95, "poor": 0.05}
    got = soft_mixing.mix(docs, labels, targets).collect()
    assert len(got) == 303 and all(x.rate >= 0 and abs(sum(x.posteriors) - 1) < 1e-9 for x in got)
    right = sum((x.posteriors[1] > 0.5) == (x.doc_id % 5 == 0) for x in got if x.doc_id is not None and x.doc_id < 300)
    assert right >= 290
    n = np.array([x.n_tokens for x in got], float)
    p, rate = np.array([x.posteriors for x in got]), np.array([x.rate for x in got])
    # Brute force: the same least squares by plain projected gradient on all rows.
    w = np.array([0.95, 0.05])
    y = best_rates(p, n, w)
    assert np.abs(((rate * n) @ p - (y * n) @ p) / n.sum() / w).max() < 0.02
    assert np.abs((rate * n) @ p / n.sum() / w - 1).max() < 0.03
    assert all(int(x.rate) <= x.copies <= int(x.rate) + 1 for x in got)
    again = soft_mixing.resample(docs, labels, targets)
    assert again.columns == docs.columns and again.count() == sum(x.copies for x in got)
    assert soft_mixing.mix(docs.limit(0), labels, targets).count() == 0
    flat = soft_mixing.mix(docs, labels.limit(0), targets).collect()
    assert {tuple(x.posteriors) for x in flat} == {(0.5, 0.5)}


def best_rates(p, n, w):
    """Brute force: the same least squares by plain projected gradient on all rows."""
    y, step = np.ones(len(n)), 0.9 / (np.linalg.eigvalsh((p * (n / n.sum())[:, None]).T @ p / np.sqrt(np.outer(w, w))).max() + soft_mixing.PULL)
    for _ in range(20_000):
        e = ((y * n) @ p / n.sum() - w) / w
        y = np.maximum(0, y - step * (p @ e + soft_mixing.PULL * (y - 1)))
    return y


def test_mixing_converges_for_small_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.1, 0.2, 0.03], 400)
    n = rng.integers(1, 2000, 400).astype(float)
    known = spark.createDataFrame([(a.tolist(), float(c)) for a, c in zip(p, n)], "_p array<double>, _n double").coalesce(1).cache()
    for w in ([0.7, 0.1, 0.18, 0.02], [0.8, 0.02, 0.17, 0.01]):
        past, momentum, step = soft_mixing.fit_rates(known, dict(zip("abcd", w)))
        got = [r.r for r in known.select(soft_mixing._replay(F.col("_p"), past, momentum, step, ahead=False).alias("r")).collect()]
        totals = (np.array(got) * n) @ p / n.sum()
        assert np.abs(totals / np.array(w) - 1).max() < 0.01, totals
        assert np.abs(((got - best_rates(p, n, np.array(w))) * n) @ p / n.sum() / w).max() < 0.005


def test_domains_told_apart_by_words_and_met(spark):
    r = random.Random(17)
    texts, labels = [], []
    for k in range(600):
        own = [r.choice(VOCABULARY) for _ in range(r.randint(20, 90))]
        toxic, poor = k % 7 == 0, k % 5 == 0
        if toxic:
            own[r.randrange(len(own))] = "vile,"
        texts.append((k, (" | " if poor else " ").join(own)))
        labels.append((k, ("poor" if poor else "fine") + ("_toxic" if toxic else "_clean")))
    targets = {"fine_clean": 0.75, "fine_toxic": 0.05, "poor_clean": 0.17, "poor_toxic": 0.03, "unseen": 0.4}
    docs = frame(spark, texts).withColumns({"copies": F.lit("old"), "_n": F.lit(1), "a.b": F.lit(2)})
    got = soft_mixing.mix(docs, spark.createDataFrame(labels[:400], "doc_id long, domain string"), targets)
    assert got.columns == [*(c for c in docs.columns if c != "copies"), "n_tokens", "posteriors", "rate", "copies"]
    rows = got.collect()
    names = sorted(targets)
    want = dict(labels)
    assert sum(names[int(np.argmax(x.posteriors))] == want[x.doc_id] for x in rows) >= 0.95 * len(rows)
    n, p, rate = (np.array(v, float) for v in zip(*((x.n_tokens, x.posteriors, x.rate) for x in rows)))
    totals = (rate * n) @ p / n.sum()
    assert np.abs(totals[:4] / np.array([0.75, 0.05, 0.17, 0.03]) - 1).max() < 0.01 and totals[4] == 0


def test_kept_domain_stays_whole(spark):
    r = random.Random(12)
    rows = [(k, " | ".join(VOCABULARY[: r.randint(5, 60)]) if k % 10 == 0 else " ".join(r.choice(VOCABULARY) for _ in range(r.randint(5, 80))) + ".") for k in range(200)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, "poor" if k % 10 == 0 else "fine") for k in range(200)], "doc_id long, domain string")
    targets = {"fine": 0.5, "poor": 0.5}  # far below the share of fine text
    got = soft_mixing.mix(docs, labels, targets, keep="fine").collect()
    fine = [x for x in got if x.posteriors[0] >= 0.5]
    assert len(fine) >= 170 and all(x.copies >= 1 for x in fine)
    assert all(x.rate < 1.2 for x in got)  # poor text is not multiplied instead
    kept = {x.doc_id for x in soft_mixing.resample(docs, labels, targets, keep="fine").collect()}
    assert {x.doc_id for x in fine} <= kept
    import corpus_pipeline

    hot = spark.createDataFrame([(k, int(k % 10 != 0)) for k in range(200)], "doc_id long, quality int")
    import tempfile

    folder = tempfile.mkdtemp()
    hot.write.parquet(f"{folder}/labels.parquet")
    out = {x.doc_id for x in corpus_pipeline.mix_sources(spark, docs.filter("doc_id % 10 != 0 OR doc_id < 40"), folder).collect()}
    assert {x.doc_id for x in fine if x.doc_id % 10 != 0} <= out


def test_preference_format(spark):
    talk = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "good"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (1, 3, "user", "so?"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (4, 0, "user", "x"), (4, None, "user", "first"), (None, 0, "user", "lost"), (7, 0, "assistant", "alone"),
    ]
    df = spark.createDataFrame([(*t, "extra") for t in talk], "conv_id long, turn long, role string, text string, part string").repartition(3)
    segments = preference_format.preference_segments(preference_format.numbered_pairs(df))
    got = sorted((r.pair_id, r.part, -1 if r.turn is None else r.turn, r.seq, r.segment, r["mask"]) for r in segments.collect())
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == sorted([
        (0, "prompt", 0, 0, say("system", "be kind"), 0), (0, "prompt", 1, 0, say("user", "hi"), 0), (0, "chosen", 2, 0, say("assistant", "good"), 1),
        (0, "rejected", 2, 0, say("assistant", "bad"), 1), (0, "rejected", 3, 0, say("user", "so?"), 0), (1, "prompt", 0, 0, say("user", "same"), 0),
        (2, "chosen", -1, 0, say("user", "first"), 0), (2, "chosen", 0, 0, say("user", ""), 0), (2, "chosen", 0, 1, say("user", "x"), 0), (3, "rejected", 0, 0, say("assistant", "alone"), 1),
    ])
    ids = [2**60 + 2, 2**60 + 3, 2**60 + 40, 2**60 + 41, -4, -3, -2, -1, 2**63 - 2, 2**63 - 1]
    far = spark.createDataFrame([(i, 0, "user", "x", 1, 9) for i in ids], "conv_id long, turn long, role string, text string, side int, pair_id int")
    assert sorted(r.pair_id for r in preference_format.preference_segments(preference_format.numbered_pairs(far)).collect()) == sorted({i >> 1 for i in ids})
    same = [(0, 0, "user", "b"), (0, 0, "user", "a"), (0, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (0, 1, "assistant", "z"), (0, 1, "assistant", "z"), (1, 1, "assistant", "z")]
    twice = preference_format.preference_segments(preference_format.numbered_pairs(spark.createDataFrame([(*t, "x") for t in same], df.schema)))
    assert sorted((r.part, r.turn, r.seq, r.segment[9]) for r in twice.collect() if r.turn == 0) == [("chosen", 0, 0, "a"), ("chosen", 0, 1, "b"), ("chosen", 0, 2, "b"), ("rejected", 0, 0, "a"), ("rejected", 0, 1, "b")]
    one = preference_format.examples(segments).filter("pair_id = 0").first()
    assert one.prompt == say("system", "be kind") + say("user", "hi")
    assert [one.rejected[s.start : s.end] for s in one.rejected_spans] == [say("assistant", "bad")]
    assert preference_format.preference_segments(preference_format.numbered_pairs(df.limit(0))).count() == 0
    assert preference_format.examples(segments.filter(F.lit(False))).count() == 0


def test_expected_shares_hold_by_labels_not_seen(spark):
    """A third of the poor texts look like fine ones: what is expected of texts without known labels is still what their labels say, before and after mixing."""
    r = random.Random(23)
    rows, labels = [], []
    for k in range(3000):
        poor = r.random() < 0.2
        body = [r.choice(VOCABULARY) for _ in range(r.randint(30, 90))]
        if poor and r.random() < 0.67:
            body = [w for x in body for w in (x, "|")]
        rows.append((k, " ".join(body)))
        labels.append((k, "poor" if poor else "fine"))
    own = spark.createDataFrame(labels, "doc_id long, domain string")
    out = soft_mixing.mix(frame(spark, rows), own.filter("doc_id % 2 = 0"), {"fine": 0.9, "poor": 0.1}, carry=["doc_id"])
    got = [(x.n_tokens, x.posteriors[1], x.rate, dict(labels)[x.doc_id] == "poor") for x in out.collect() if x.doc_id % 2]
    share = lambda weigh, of: sum(weigh(x) * of(x) for x in got) / sum(weigh(x) for x in got)
    for weigh in (lambda x: x[0], lambda x: x[0] * x[2]):
        expected, there = share(weigh, lambda x: x[1]), share(weigh, lambda x: x[3])
        assert abs(expected - there) < 0.15 * there
    assert share(lambda x: x[0], lambda x: x[3]) > 0.2 and abs(share(lambda x: x[0] * x[2], lambda x: x[3]) - 0.1) < 0.02


def test_floors_take_part_in_the_fit(spark):
    known = spark.createDataFrame([(100.0, [0.95, 0.05]), (60.0, [0.5, 0.5]), (40.0, [0.02, 0.98])], "_n double, _p array<double>")
    past, momentum, step = soft_mixing.fit_rates(known, {"fine": 0.8, "poor": 0.2}, least=(0, 0.4))
    assert len(past) > soft_mixing.SAVE  # points are written on the way and the replay from the start agrees
    at = known.select("_n", "_p", soft_mixing._replay(F.col("_p"), past, momentum, step, False, (0, 0.4)).alias("r")).collect()
    assert at[0].r >= 1 and at[1].r >= 1 and at[2].r < 0.5
