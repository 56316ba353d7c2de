"""Ranked text search over documents that a plan has confirmed, for many questions at once.

The index is a table of postings (word, id, tf) with the number of documents of each word
and the length of each document. Only documents on the plan's list are counted and
scored, so what the plan excludes changes no rank. Every question's words meet their
postings in one join; scores are added map-side first, and only the best of each
question are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.sources.shared import spread

K1, B = 1.2, 0.75
DIGITS = 6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """word, id, tf, length of the documents whose ``key`` stands in ``allowed``; documents without words have none."""
    # All words of a document stay in its task, whose texts are as large as stated.
    own = spread(docs.join(allowed.select(key).distinct(), key, "left_semi").select(F.col(key).alias("id"), F.col(text).alias("_t")), "id").select("id", words(F.col("_t")).alias("_w"))
    each = own.select("id", F.size("_w").alias("length"), F.explode("_w").alias("word"))
    return each.groupBy("word", "id", "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """question, position, id, score: the best ``k`` documents of each question (question, text), ties to the smaller id.

    Scores are rounded to ``DIGITS`` places, so that ranks do not depend on the order of a
    sum. Questions without words, or with no word that a document has, have no rows.
    """
    lengths = index.select("id", "length").distinct().agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    asked = questions.select("question", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    # One row of totals beside the words that are asked for.
    df = index.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("_df"))
    idf = df.join(F.broadcast(lengths), F.lit(True)).select("word", "_avg", F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("_avg")))
    met = asked.join(idf, "word").join(index, "word").groupBy("question", "id").agg(F.round(F.sum(F.col("_idf") * tf), DIGITS).alias("score"))
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return met.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("question", "position", "id", "score")


def nearest(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question, position, id, score: the ``k`` vectors (id, v) of largest cosine for each question (question, v), ties to the smaller id.

    The stated questions are gathered in one row, whose size is theirs alone, and every
    vector is compared with it; of each part of the vectors only the best ``k`` go on.
    Vectors null, zero or with components that are no numbers take no part.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, c: a * c), F.lit(0.0), lambda s, t: s + t)
    sound = lambda df: df.withColumn("v", F.col("v").cast("array<double>")).withColumn("_l", F.sqrt(dot(F.col("v"), F.col("v")))).filter("_l > 0 AND _l < double('Infinity')")
    asked = sound(questions).agg(F.collect_list(F.struct("question", "v", "_l")).alias("_asked"))
    met = sound(vectors).join(F.broadcast(asked), F.lit(True)).select("id", F.col("v").alias("_v"), F.col("_l").alias("_own"), F.explode("_asked").alias("q"))
    met = met.select(F.col("q.question").alias("question"), "id", F.round(dot(F.col("_v"), F.col("q.v")) / (F.col("_own") * F.col("q._l")), DIGITS).alias("score"))
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return met.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("question", "position", "id", "score")


def fused(lists: list[DataFrame], k: int, damp: int = 60) -> DataFrame:
    """question, position, id, score by reciprocal ranks: the sum of 1 / (damp + position) over the lists that hold a document."""
    rows = None
    for own in lists:
        part = own.select("question", "id", (1.0 / (F.lit(damp) + F.col("position"))).alias("_s"))
        rows = part if rows is None else rows.unionByName(part)
    met = rows.groupBy("question", "id").agg(F.round(F.sum("_s"), DIGITS + 4).alias("score"))
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return met.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("question", "position", "id", "score")
