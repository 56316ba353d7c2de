"""A training-corpus pipeline over ``documents``, stage by stage.

Stages take and return the columns of ``documents``; others are dropped. A null text is
an empty one, a row without doc_id a document like any other (the oldest of all where
age counts), an empty table passes through. n_chars follows the text when lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others stay as they are."""
    from factgraph.llm.toxicity import fit, keep_clean, label_counts, training_rows

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = fit(training_rows(docs, labels, max_train=6000), label_counts(labels))
    return keep_clean(docs, weights, bias, threshold=0.7).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in three documents or more stay only in the last of them."""
    from factgraph.llm.line_dedup import dedup_frame

    return dedup_frame(docs, min_chars=20, min_docs=3).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    from factgraph.llm.jaccard_join import one_of_each

    return one_of_each(docs, words=5, threshold=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as target weights of fine and poor text ask for.

    Only documents that are poor with a probability above 0.9 may go; all others stand
    there once at least, and the fit takes that into account. The weight of fine text is
    its share of this stage's input where that is above the target.
    """
    from factgraph.llm.registry import QUALITY_TARGETS, label_domains
    from factgraph.llm.soft_mixing import resample

    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity=False)
    return resample(docs, labels, QUALITY_TARGETS, keep="fine", doubt=0.1).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each document."""
    from factgraph.llm.piece_bpe import encode_documents
    from factgraph.llm.registry import piece_digests, tokenizer_path

    return piece_digests(encode_documents(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("soft_mixing", mix_sources),
    ("sentencepiece", tokenize),
]
#: SQL cannot express the models, the join by set similarity or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written as Parquet and read again."""
    from factgraph.llm.common import discard, stored

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
