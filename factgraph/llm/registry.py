"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = None  # None: the public_tokenizers package says where its files are


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shares of the corpus's tokens by quality and toxicity in the labelled table: a third more of rare poor toxic text, half the fine toxic.
MIX_TARGETS = {"fine_clean": 0.80, "fine_toxic": 0.05, "poor_clean": 0.13, "poor_toxic": 0.02}
#: The same by quality alone: about half of the poor text that the labelled tables have (0.14 of the tokens).
QUALITY_TARGETS = {"fine": 0.92, "poor": 0.08}


def label_domains(labels: DataFrame, toxicity: bool = True) -> DataFrame:
    """doc_id and domain of each labelled document: its quality, and with ``toxicity`` that too."""
    own, domain = labels.filter(F.col("quality").isNotNull()), F.when(F.col("quality") == 1, "fine").otherwise("poor")
    if toxicity:
        own, domain = own.filter(F.col("toxic").isNotNull()), F.concat(domain, F.lit("_"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return own.select("doc_id", domain.alias("domain"))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.soft_mixing import mix

    return mix(_table(spark, sf_dir, "documents"), label_domains(_table(spark, sf_dir, "labels")), MIX_TARGETS, carry=["doc_id"])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZER_DIR}/{name}" if TOKENIZER_DIR else public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.token_files import token_output

    out = token_output(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.passage_dedup import dedup_passages

    out = dedup_passages(_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, rid, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS ix
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20) AS d
  GROUP BY key HAVING count(*) >= 3
), m AS (
  SELECT k.doc_id, k.rid, k.ix, k.line, c.last IS NOT NULL AND c.last IS DISTINCT FROM k.doc_id AS gone
  FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.posting_lists import search

    return search(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.piece_bpe import encode_documents

    return piece_digests(encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def piece_digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of what encode_documents returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.preference_format import numbered_pairs, preference_segments

    return preference_segments(numbered_pairs(_table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) >> 1 AS pair_id, CAST(conv_id AS BIGINT) & 1 AS side, turn,
         coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT pair_id, turn,
         string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) FILTER (WHERE side = 0) AS c,
         string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) FILTER (WHERE side = 1) AS r
  FROM t GROUP BY pair_id, turn
), f AS (
  SELECT pair_id, min(turn) AS first FROM g WHERE c IS DISTINCT FROM r GROUP BY pair_id
), s AS (
  SELECT t.pair_id, CASE WHEN f.first IS NULL OR t.turn < f.first THEN 'prompt' WHEN t.side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
         t.turn, t.role, t.text, t.side,
         row_number() OVER (PARTITION BY t.pair_id, t.side, t.turn ORDER BY t.role, t.text) - 1 AS seq
  FROM t LEFT JOIN f ON t.pair_id = f.pair_id
)
SELECT pair_id, part, turn, CAST(seq AS INTEGER) AS seq,
       '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS mask
FROM s WHERE part <> 'prompt' OR side = 0
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op10_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.impact_index import search

    return search(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.fill_middle import fill_in_middle, restore

    out = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, left(t, least(x, y)) AS pre, substr(t, least(x, y) + 1, abs(x - y)) AS mid, substr(t, greatest(x, y) + 1) AS suf FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.merkle import folded, leaf_digest, manifest, proof_digest

    docs = _table(spark, sf_dir, "documents")
    digest = lambda text: leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, digest(F.translate("text", "\n", "")))
    out = manifest(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("leaf"), F.unhex(changed).alias("changed")))
    again = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), folded(again, "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS changed, coalesce({_CRC} % 2 = 0, FALSE) AS hit FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), up AS (
  SELECT 0 AS k, g, i, n, leaf AS h FROM l
  UNION ALL SELECT k + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, g, i // 3, n
), s AS (
  SELECT g, k AS top, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), up2 AS (
  SELECT 0 AS k, i, n, h FROM s
  UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up2 WHERE n > 1 GROUP BY k, i // 3, n
), steps AS (
  SELECT l.g, l.i, up.k AS step, up.i % 3 AS c, (l.i // CAST(pow(3, up.k) AS BIGINT)) % 3 AS own, h FROM l JOIN up ON l.g = up.g AND up.n > 1 AND up.i // 3 = l.i // CAST(pow(3, up.k + 1) AS BIGINT)
  UNION ALL
  SELECT l.g, l.i, s.top + up2.k, up2.i % 3, (s.i // CAST(pow(3, up2.k) AS BIGINT)) % 3, up2.h FROM l JOIN s ON l.g = s.g JOIN up2 ON up2.n > 1 AND up2.i // 3 = s.i // CAST(pow(3, up2.k + 1) AS BIGINT)
), parts AS (
  SELECT g, i, step, coalesce(string_agg(h, '' ORDER BY c) FILTER (WHERE c < own), '') AS b, coalesce(string_agg(h, '' ORDER BY c) FILTER (WHERE c > own), '') AS a FROM steps GROUP BY g, i, step
), paths AS (
  SELECT g, i, string_agg(b || a, '' ORDER BY step) AS proof, list(b ORDER BY step) AS bs, list(a ORDER BY step) AS fs FROM parts GROUP BY g, i
), fold AS (
  SELECT l.g, l.i, 0 AS step, CASE WHEN hit THEN changed ELSE leaf END AS h, bs, fs FROM l LEFT JOIN paths ON l.g = paths.g AND l.i = paths.i
  UNION ALL SELECT g, i, step + 1, sha256(bs[step + 1] || h || fs[step + 1]), bs, fs FROM fold WHERE step < len(bs)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(paths.proof, '')) AS proof_sha256, fold.h AS folded_root, fold.h = r.h AS verified
FROM l JOIN s ON l.g = s.g JOIN up2 r ON r.n = 1 LEFT JOIN paths ON l.g = paths.g AND l.i = paths.i
JOIN fold ON l.g = fold.g AND l.i = fold.i AND fold.step = coalesce(len(fold.bs), 0)
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm.warc import read_records, resolve, write_archives

    return resolve(read_records(write_archives(_table(spark, sf_dir, "pages"), min_bytes=100)))


OP13_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS one FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN one END AS refers_to
FROM r
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op8_preference_format": OP8_SQL, "op10_impact_top_k": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc": OP13_SQL}
