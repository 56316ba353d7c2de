"""Certificates kept up over micro-batches of facts.

The state is two tables in a shared folder, a folder of each for every batch: facts that
the batch brought, and certificates that it made or changed. A batch first drops the
facts that earlier batches brought. Then the plan runs once for each of its patterns, with that
pattern over the new facts alone and all others over everything: rows in which a new
fact takes part. Their certificates are made over all facts and supersede those that an
earlier batch gave the same row. So work follows the batch and what it meets, and the
certificates are those that a run from scratch gives.

A batch that is repeated after a failure rewrites its own folders from the batches before
it: nothing is added twice. Optional fields are refused, since a new fact would take back
a row with an unbound one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.engine import Engine
from factgraph.errors import UnsupportedPlan
from factgraph.operators import evidence
from factgraph.plans.compiler import compile_plan
from factgraph.sources.facts import FactsTable, Relation
from factgraph.sources.turtle import FACTS


class _Delta(FactsTable):
    """All facts, but only the new ones for the pattern that is asked for in turn ``at``."""

    def __init__(self, whole: DataFrame, new: DataFrame, graphs: tuple[str, ...], at: int):
        super().__init__(whole, graphs)
        self.new, self.at, self.asked = FactsTable(new, graphs), at, 0

    def turn(self) -> bool:
        self.asked += 1
        return self.asked - 1 == self.at

    def relation(self, predicate: str) -> Relation:
        return self.new.relation(predicate) if self.turn() else super().relation(predicate)

    def members(self, cls: str) -> tuple[DataFrame, str]:
        return self.new.members(cls) if self.turn() else super().members(cls)


class LiveCertificates:
    """Certificates of one plan over facts that arrive in batches."""

    def __init__(self, engine: Engine, raw: dict, folder: str, execution_id: str):
        self.engine, self.raw, self.folder, self.execution = engine, raw, folder, execution_id
        self.plan = engine.prepare(raw)
        if self.plan.kind != "select" or any(p.kind == "field" and not p.required for p in self.plan.projections):
            raise UnsupportedPlan("only rows without optional fields are kept up")

    def _before(self, spark: SparkSession, kind: str, schema: str, batch: int) -> DataFrame:
        """State of the batches before one."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{kind}").filter(F.col("batch") < batch)

    def apply(self, facts: DataFrame, batch: int) -> None:
        """Take one batch of facts (g, s, p, o) into the state."""
        spark = facts.sparkSession
        old = self._before(spark, "facts", FACTS, batch).select("g", "s", "p", "o")
        facts = facts.select("g", "s", "p", "o").distinct()
        new = facts.join(old, [facts[c].eqNullSafe(old[c]) for c in facts.columns], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch}")
        new = spark.read.schema(FACTS).parquet(f"{self.folder}/facts/batch={batch}")
        whole = old.unionByName(new)
        graphs = self.engine.dataset.graphs
        probe = _Delta(whole, new, graphs, -1)
        plain = compile_plan(spark, probe, self.engine.catalog, self.plan, self.engine.policy)
        names = plain.checked.columns
        # Every turn of the compiler asks for the patterns in the same order.
        turns = probe.asked
        deltas = [compile_plan(spark, _Delta(whole, new, graphs, k), self.engine.catalog, self.plan, self.engine.policy).checked.select(*names) for k in range(turns)]
        keys = [*plain.public, *plain.entities]
        met = reduce(DataFrame.unionByName, deltas).dropDuplicates(keys)
        rows = evidence.certified(met, FactsTable(whole, graphs), plain, self.engine.catalog, self.execution)
        rows.select(*keys, "row_key", "certificate", "supports").write.mode("overwrite").parquet(f"{self.folder}/certificates/batch={batch}")

    def current(self, spark: SparkSession) -> DataFrame:
        """Rows and certificates as of the last batch."""
        rows = spark.read.parquet(f"{self.folder}/certificates")
        newest = F.row_number().over(Window.partitionBy("row_key").orderBy(F.col("batch").desc()))  # as many rows as batches changed one
        return rows.withColumn("_n", newest).filter("_n = 1").drop("_n", "batch")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply every micro-batch of a stream of facts that is there now."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
