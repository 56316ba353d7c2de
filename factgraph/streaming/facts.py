"""Facts that arrive as a stream of N-Triples lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.sources.turtle import FACTS, ntriples_facts


def stream_facts(spark: SparkSession, folder: str, graph: str | None = None) -> DataFrame:
    """New files of a folder as facts; bad lines fail the batch."""
    return ntriples_facts(spark.readStream.text(folder), graph)


def append_facts(stream: DataFrame, table: str, checkpoint: str, after: Callable[[SparkSession], None] | None = None) -> StreamingQuery:
    """Append each micro-batch to a fact table by graph and predicate, then call ``after``.

    Facts are a set: those of a batch that the table has already are left out, so a
    batch that is repeated after a failure adds nothing. Of the table only the graphs and
    predicates of the batch are read.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.distinct().persist()
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            met = batch.select("g", "p").distinct().withColumnsRenamed({"g": "_g", "p": "_p"})
            old = spark.read.schema(FACTS).parquet(table)
            old = old.join(F.broadcast(met), old["g"].eqNullSafe(met["_g"]) & (old["p"] == met["_p"]), "left_semi")
            new = batch.join(old, [batch[c].eqNullSafe(old[c]) for c in batch.columns], "left_anti")
        else:
            new = batch
        new.write.mode("append").partitionBy("g", "p").parquet(table)
        batch.unpersist()
        if after:
            after(spark)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
