"""Helpers shared by the operators: stored tables and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwitness.session import scratch_path

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder that all executors share and read it back.

    Cuts the lineage: a lost executor costs only its running tasks.
    """
    return Steps(df.sparkSession).keep(df, name)


def reach_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the executors run on the driver's machine; a
    cluster has it installed. Long texts travel in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


#: Spark's setting that removes the shuffles of an execution at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Tables between the steps of one operator, dropped when nothing to come reads them.

    ``keep`` writes a table like ``stored``; ``drop`` deletes tables whose every reader has been
    written itself by then. With ``tidy`` Spark removes the shuffles of a step when its table is
    written, which otherwise happens when the driver collects its plans.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False) -> None:
        self.spark, self.paths, self.tidy = spark, {}, tidy

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        before = self.spark.conf.get(CLEAN_UP, "false")
        if self.tidy:
            self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(CLEAN_UP, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, ()):
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)


def whole_text(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: So many edges are left to one task; more go through star passes.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the edges and the smallest node it is connected with, inside one task."""
    parent: dict = {}

    def find(node):
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(n) for n in part], kind)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: one row ``(node, root)`` per node, root the smallest.

    Up to ``TASK_EDGES`` edges are joined up by one task. More go through alternating large-star
    and small-star passes: every pass is one aggregation (combined before its shuffle) and one
    join, whose both sides are plain tables so that a node with very many links is split by the
    adaptive skew join; the number of passes grows with the logarithm of the longest path. Both
    ways give the same. Any orderable type works; self links and null ends are left out.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    steps = Steps(edges.sparkSession)
    now = steps.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "now")
    count = now.count()
    if not count:
        return now.toDF("node", "root")
    if count <= TASK_EDGES:
        kind = now.schema["u"].dataType.simpleString()
        roots = stored(now.repartition(1).mapInArrow(_forest, f"node {kind}, root {kind}"), "cc")
        steps.drop("now")
        return roots
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = steps.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # Large star: every larger neighbour of u points to the smallest of u's star.
        large = steps.keep(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        steps.drop("now", "low")
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = steps.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = steps.keep(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "now")
        steps.drop("large", "least")
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            break
        before = sign
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
