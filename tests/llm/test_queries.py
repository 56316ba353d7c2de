"""The registered queries and the pipeline over whole small tables, with nulls, repeated rows and extra columns."""

import hashlib
import random
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_format_ops import archived, formatted, merkle_rows  # noqa: E402
from test_text_ops import VOCABULARY, jaccard, key, lines_left, noisy_or, removed  # noqa: E402

import corpus_pipeline  # noqa: E402
from factgraph.llm import registry, soft_mixing, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, cls string"


def documents():
    r = random.Random(41)
    say = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."
    line, shared = "A line that many of the documents hold", say(40)
    out = [(None, None), (None, ""), (0, None), (1, ""), (2, "   ")]
    for k in range(3, 130):
        parts = [say(r.randint(2, 60)) for _ in range(r.randint(1, 3))]
        if k % 4 == 0:
            parts[r.randrange(len(parts))] = f"you {r.choice(['vile', 'nasty', 'rotten'])} {say(5)}"
        if k % 3 == 0:
            parts.append(line)
        if k % 9 == 0:
            parts.append(shared)
        if k % 10 == 1:
            parts = [" | ".join(parts[0].split())]
        out.append((k, "\n".join(parts)))
    return out + [(200, out[40][1]), (201, out[40][1]), (201, out[40][1]), (202, out[41][1] + " w99"), (7, out[50][1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en" if k % 3 else None, "web", len(t or ""), "x", 0.5, "c") for k, (i, t) in enumerate(documents())]
    labels = [(i, int(i % 10 != 1), int(i % 4 == 0), "x") for i in range(3, 130)] + [(None, 1, 1, "x"), (5, None, None, None), (9999, 1, 0, "x")]
    r = random.Random(2)
    vectors = [(k, [r.gauss(0, 1) for _ in range(8)], "x") for k in range(300)] + [(None, [1.0] * 8, "x"), (400, None, "x"), (450, [None] * 8, "x"), (7, [0.5] * 8, None)]
    talk = [(c, t, ("user", "assistant")[t % 2], f"turn {t}" if t < 2 + c % 3 else f"own {c} {t}", 1, 2) for c in range(20) for t in range(5)] + [(None, 0, "user", "x", 1, 2), (4, None, None, None, None, None)]
    pages = [(i, f"http://p/{i}", t and f"<p>{t}</p>", "x") for i, t in documents()]
    for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, "page_id long, url string, html string, size string"), ("labels", labels, "doc_id long, quality int, toxic int, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>, score string"), ("conversations", talk, "conv_id long, turn int, role string, text string, part int, mask int")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    (path / "empty").mkdir()
    for name in ("documents", "pages", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    return str(path)


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def pieces(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i, t in texts:
        ids = sp.encode(t or "")
        out.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    return out


def test_every_query_over_its_whole_table(spark, folder):
    got = {name: f(spark, folder).collect() for name, f in registry.queries().items()}
    docs = documents()
    assert {n: len(v) for n, v in got.items() if n.split("_")[0] not in ("op6", "op8", "op10")} == {n: len(docs) for n in got if n.split("_")[0] not in ("op6", "op8", "op10")}
    links, _ = jaccard(docs)
    assert sorted(((str(x.doc_id), x.copy_id, x.class_id, x.n_copies, x.n_links) for x in got["op2_jaccard_join"]), key=str) == sorted(links, key=str)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(b"".join(n.to_bytes(4, "little") for n in [*tok.encode(t or "", add_special_tokens=False).ids, 0]))
    assert sorted((str(x.doc_id), x.ids_crc32) for x in got["op3_token_output"]) == sorted((str(i), crc(t)) for i, t in docs)
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got["op4_passage_dedup"]) == sorted((*x[:4], sha(x[4])) for x in removed(docs, 50))
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept_sha256) for x in got["op5_line_dedup"]) == sorted((str(i), n, d, sha(t)) for i, t, n, d in lines_left(docs))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got["op7_sentencepiece"]) == sorted(pieces(docs))
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and x.predicted == int(x.score >= 0.7) for x in got["op9_toxicity"])
    assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in got["op9_toxicity"] if x.doc_id is not None and 3 <= x.doc_id < 130 and x.doc_id != 7) >= 120
    for name in ("op6_posting_lists", "op10_impact_top_k"):
        assert sorted((x.query_id, x["rank"]) for x in got[name]) == [(q, k) for q in range(0, 300, 50) for k in range(1, 6)]
    cut = [formatted(i, t) for i, t in docs]
    assert sorted(repr(tuple(x)) for x in got["op11_fill_in_middle"]) == sorted(repr((*x[:5], sha(x[5]), sha(x[6]))) for x in cut)
    rows = [{"doc_id": i, "text": t, "lang": "en" if k % 3 else None, "source": "web", "n_chars": len(t or "")} for k, (i, t) in enumerate(docs)]
    assert sorted(repr(tuple(x)) for x in got["op12_merkle_manifest"]) == sorted(map(repr, merkle_rows(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0)))
    assert sorted(repr(tuple(x)) for x in got["op13_warc"]) == sorted(map(repr, archived([(i, t and f"<p>{t}</p>") for i, t in docs])))
    assert {x.part for x in got["op8_preference_format"]} == {"prompt", "chosen", "rejected"}


def test_every_query_over_empty_tables(spark, folder):
    for name, f in registry.queries().items():
        assert f(spark, f"{folder}/empty").count() == 0, name
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_pipeline_against_brute_force(spark, folder):
    docs = [(i, t or "") for i, t in documents()]
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights, bias = toxicity.fit(toxicity.training_rows(table, labels, 6000), toxicity.label_counts(labels))
    clean = [(i, t) for i, t in docs if noisy_or(t, weights, bias) < 0.7]
    assert 20 < len(docs) - len(clean) < 60
    lines = [(i, t) for i, t, _, _ in lines_left(clean)]
    groups = {}
    for i, t in lines:
        groups.setdefault(group_of(lines, i, t), []).append((i, t))
    heads = [min(g, key=lambda x: (x[0] is None, key(x[0]), spark_hash(spark, x[1]))) for g in groups.values()]
    frame = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in heads], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = soft_mixing.mix(frame, registry.label_domains(labels, toxicity=False), registry.QUALITY_TARGETS, keep="fine", doubt=0.1).collect()
    kept = [(x.doc_id, x.text) for x in mixed for _ in range(x.copies)]
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted(pieces(kept)) and len(got) > 50


def shingles(text):
    w = text.lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def group_of(rows, doc_id, text):
    """The texts that links connect with this one, as a set of shingle sets."""
    distinct = {shingles(t) for _, t in rows}
    group, todo = set(), [shingles(text)]
    while todo:
        if (x := todo.pop()) not in group:
            group.add(x)
            todo += [y for y in distinct if x and y and x != y and len(x & y) >= 0.8 * len(x | y) - 1e-9]
    return frozenset(group)


def spark_hash(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
