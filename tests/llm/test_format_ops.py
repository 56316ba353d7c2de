"""Fill-in-middle, Merkle manifest and WARC against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factgraph.llm import fill_middle, merkle, registry, warc
from factgraph.llm.common import stored

DOCS = "doc_id long, text string, output string, n string, batch double, form string"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0.5, "z") for i, t in rows], DOCS).repartition(3)


def mixed_rows():
    r = random.Random(5)
    out = [(None, None), (None, "x"), (0, ""), (1, None), (2, "a <P> b"), (3, "<P"), (-5, "\x00\n😀"), (4, "S>"), (5, " ")]
    for k in range(10, 400):
        size = r.choice((1, 2, 3, 50, 99, 100, 101, 199, 200, 201, 1000, 3000))
        out.append((k, "".join(r.choice("ab<PSM> \n\té漢😀\x00\r") for _ in range(size))))
    return out + [out[40]] * 3 + [(9999, "é😀x" * 200_000)]


def formatted(i, t):
    t = t or ""
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t, t
    if h4 % 100 < 20:
        return i, n, "spm", a, z - a, f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}", t
    return i, n, "psm", a, z - a, f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}", t


def test_fill_in_middle_against_plain_python(spark):
    rows = mixed_rows()
    got = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, rows)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(formatted(*r)) for r in rows)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_with_words_and_other_shares(spark):
    rows = mixed_rows()
    out = fill_middle.fill_in_middle(frame(spark, rows), unit="word", seed=7, formatted=100, spm=0)
    back = fill_middle.restore(out).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in back) == sorted(repr((i, t or "")) for i, t in rows)
    for r in back:
        if r.form == "plain":
            assert not r.text or any(m in r.text for m in ("<P>", "<S>", "<M>"))
        else:
            prefix = r.output[3 : r.output.index("<S>")]
            assert r.form == "psm" and len(prefix.split()) == r.prefix_units - (prefix[:1] in " \n\t\r" and prefix != "")


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.restore(fill_middle.fill_in_middle(frame(spark, []))).collect() == []


def merkle_rows(rows, changed):
    """What op12 returns, by plain recursion: rows are dicts of documents, ``changed`` says whose text loses line breaks."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(cell(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + cell(t))

    def tree(hashes):
        """The root, and for each leaf its steps (siblings before, siblings after)."""
        paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
        while len(level) > 1:
            runs = [level[k : k + 3] for k in range(0, len(level), 3)]
            for path, k in zip(paths, at):
                run = runs[k // 3]
                path.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at, level = [k // 3 for k in at], [sha("".join(x)) for x in runs]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    made = []
    for key in sorted(groups):
        own = sorted(groups[key], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        made.append((own, *tree([leaf(r, r["text"]) for r in own])))
    root, upper = tree([m[1] for m in made]) if made else (None, [])
    out = []
    for (own, subroot, paths), above in zip(made, upper):
        for r, path in zip(own, paths):
            again = leaf(r, r["text"].replace("\n", "") if r["text"] is not None and changed(r["doc_id"]) else r["text"])
            for before, after in path + above:
                again = sha(before + again + after)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(b + a for b, a in path + above)), again, again == root))
    return out


MERKLE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, i string, h string, g string, n string, path string"


def test_manifest_against_plain_recursion(spark, tmp_path):
    r = random.Random(9)
    rows = [(None, None, None, None, None), (None, "a\nb", "en", None, 3), (5, "x\ny", None, "", 1), (6, "é\n", "de", "", 2), (7, None, "en", "é", None)]
    for k in range(20, 160):
        rows.append((k, r.choice(("", "one", "two\nlines", "three\n\nlines", None)), r.choice(("en", None)), r.choice(("hot", "hot", "b", "a", "Z", None)), k))
    rows += [rows[30]] * 5 + [(30, "other", "en", "hot", 1), (31, "x\n" * 50_000, "en", "hot", 1), (1 << 60, "z\n", "en", "alone", 2)]
    spark.createDataFrame([(*x, "i", "h", "g", "n", "p") for x in rows], MERKLE_DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op12_merkle_manifest(spark, str(tmp_path)).collect()
    names = ("doc_id", "text", "lang", "source", "n_chars")
    want = merkle_rows([dict(zip(names, x)) for x in rows], lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {x.verified for x in got} == {True, False}


def test_numbers_do_not_depend_on_blocks(spark):
    rows = stored(spark.createDataFrame([("a", k // 700, "x") for k in range(2000)] + [("b", None, "x"), (None, 1, "x")], "g string, id long, n2 string").repartition(5), "test-rows")
    got = merkle.numbered(rows, "g", ["id"]).collect()
    own = sorted((x.i, x.id, x.n) for x in got if x.g == "a")
    assert [x[0] for x in own] == list(range(2000)) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {2000}
    assert [(x.i, x.n) for x in got if x.g == "b"] == [(0, 1)]


def test_manifest_of_nothing_and_of_one(spark):
    leaves = spark.createDataFrame([("s", 1, sha("x"))], "grp string, id long, leaf string")
    assert merkle.manifest(leaves.limit(0)).collect() == []
    (one,) = merkle.manifest(leaves).collect()
    assert (one.leaf, one.subroot, one.root, one.path) == (sha("x"),) * 3 + ([],)


def archived(rows):
    """(page_id, bytes, digest, type, page referred to): the first of equal long payloads answers, by page_id."""
    out, first = [], {}
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and raw in first
        out.append((page, len(raw), sha(raw), "revisit" if again else "response", first[raw] if again else None))
        first.setdefault(raw, page)
    return out


PAGES = "page_id long, url string, html string, file string, offset string, digest string, first string"


def page_frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "f", "o", "d", "1") for p, u, h in rows], PAGES).repartition(4)


def page_rows():
    r = random.Random(3)
    out = [(None, "u", "n" * 150), (1, None, None), (2, "http://a/\r\nX: y z", ""), (3, "http://é/", "é" * 50), (4, "u", "é" * 49), (5, "u", "é" * 49), (6, "u", "\r\n\r\n" * 40)]
    out += [(k, f"http://h/{k}", f"page {k % 60} " + "x" * 120) for k in range(10, 150)]
    out += [(k, "u", "hot " * 100) for k in r.sample(range(1000, 3000), 600)] + [out[20]] * 4 + [(9000, "long", "é\n" * 3_000_000), (9001, "long", "é\n" * 3_000_000)]
    return out + [(None, "u", "n" * 150)] * 2


def test_warc_against_plain_python(spark):
    rows = page_rows()
    index = warc.write_archives(page_frame(spark, rows), file_bytes=20_000)
    got = warc.resolve(warc.read_records(index)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, archived([(p, h) for p, _, h in rows])))
    assert sorted(map(repr, (x.url for x in index.collect()))) == sorted(repr(u) for _, u, _ in rows)
    files = {x.file for x in index.select("file").collect()}
    there = {f for f in os.listdir(index.archive_folder.removeprefix("file:"))}
    assert {f.rsplit("/", 1)[1] for f in files} == there


def test_warc_files_are_standard_gzip(spark):
    rows = page_rows()[:30]
    index = warc.write_archives(page_frame(spark, rows))
    for file in {x.file for x in index.select("file").collect()}:
        raw = gzip.decompress(open(file.removeprefix("file:"), "rb").read())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        own = index.filter(F.col("file") == file)
        assert raw.count(b"WARC/1.1\r\nWARC-Type: response") == own.filter("record_type = 'response'").count()
        assert raw.count(b"WARC/1.1\r\nWARC-Type: revisit") == own.filter("record_type = 'revisit'").count()


def test_warc_selected_records_and_damage(spark):
    rows = [(k, "u", f"page {k} " + "y" * 200) for k in range(50)] + [(60, "u", "page 7 " + "y" * 200)]
    index = warc.write_archives(page_frame(spark, rows))
    some = warc.read_records(index.filter("page_id in (3, 7, 49)")).collect()
    assert sorted((x.page_id, x.payload) for x in some) == [(k, f"page {k} {'y' * 200}".encode()) for k in (3, 7, 49)]
    with pytest.raises(Exception, match="another record|incorrect header|invalid"):
        warc.read_records(index.withColumn("offset", F.col("offset") + F.when(F.col("page_id") == 3, 1).otherwise(0))).collect()
    with pytest.raises(Exception, match="digest differ"):
        warc.resolve(warc.read_records(index.filter("page_id = 60"))).collect()


def test_warc_of_nothing(spark):
    index = warc.write_archives(page_frame(spark, []))
    assert index.count() == 0 and warc.resolve(warc.read_records(index)).collect() == []


def test_lookup_with_hot_and_missing_keys(spark):
    rows = stored(spark.createDataFrame([(k % 7 if k < 3000 else 7 + k, k) for k in range(8000)] + [(None, -1)], "key long, v long"), "test-rows")
    table = spark.createDataFrame([(k, str(k)) for k in range(0, 9000, 2)], "key long, name string")
    want = lambda how: sorted((x.v, x.name) for x in rows.join(table, "key", how).collect())
    for how in ("inner", "left"):
        assert sorted((x.v, x.name) for x in warc.lookup(rows, table, "key", how).collect()) == want(how)
