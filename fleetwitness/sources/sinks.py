"""Evidence records, digest lines and latency rows on disk."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwitness.operators.ordered import small_side
from fleetwitness.session import written


def evidence_records(verdicts: DataFrame, slices: DataFrame, captures: DataFrame, markers: DataFrame) -> DataFrame:
    """One manifest row per run, PASS or FAIL, that names every absence.

    The manifest counts the parts; the parts themselves are written beside it as
    rows keyed by run (see ``write_evidence``), so no run is ever one huge value.
    """
    return evidence_manifest(verdicts, {"log_lines": slices, "api_reads": captures, "markers": markers})


def _places(manifest: DataFrame) -> DataFrame:
    """Scenario and night of every run, written once for all the parts that follow them."""
    # By run, as the parts are joined: distinct rows need no other exchange.
    return written(manifest.select("run_id", "scenario", "night").repartition("run_id").distinct(), "evidence-places")


def write_evidence(manifest: DataFrame, slices: DataFrame, captures: DataFrame, markers: DataFrame, folder: str) -> None:
    """Manifest and parts as tables side by side, all partitioned by scenario and night.

    What is written for a scenario and night replaces what was there, so a repeated call
    changes nothing. The parts come first and the manifest last: a manifest row never stands
    without its parts. The rebalance brings a night's rows together and splits a large night
    again.
    """
    where = _places(manifest)

    def put(rows: DataFrame, name: str) -> None:
        writer = rows.hint("rebalance", "scenario", "night").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("scenario", "night").parquet(f"{folder}/{name}")

    for name, df in (("log_lines", slices), ("api_reads", captures), ("markers", markers)):
        put(df.join(where, "run_id"), name)
    put(manifest, "manifest")


COMMITS, VERSIONS = "commits", "versions"


def resolved_values(constants: DataFrame, bindings: DataFrame, extracted: DataFrame) -> DataFrame:
    """What a run was judged with, one row per value: ``run_id, kind, name, value``.

    Each input: run_id, name, value (as text).
    """
    kinds = (("constant", constants), ("let", bindings), ("extracted", extracted))
    rows = [df.select("run_id", F.lit(kind).alias("kind"), "name", F.col("value").cast("string").alias("value")) for kind, df in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def evidence_manifest(verdicts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per run with the number of rows of every part; parts without rows are named ``absent``.

    ``verdicts``: run_id, scenario, night and more; every part has a run_id.
    """
    rows = None
    for n, df in enumerate(parts.values()):
        own = df.select("run_id", F.lit(n).alias("_part"))
        rows = own if rows is None else rows.unionByName(own)
    # One aggregation of counters for all parts, combined before its shuffle.
    wide = rows.groupBy("run_id").agg(*[F.count(F.when(F.col("_part") == n, 1)).alias(name) for n, name in enumerate(parts)])
    zero = {name: F.coalesce(F.col(name), F.lit(0)).cast("bigint") for name in parts}
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == 0, F.lit(n)) for n in parts])), ",")
    return verdicts.join(wide, "run_id", "left").withColumns(zero).withColumn("absent", absent)


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def committed(spark: SparkSession, folder: str) -> dict[int, str]:
    """Versions that readers see, by number."""
    store, path = _store(spark, f"{folder}/{COMMITS}")
    if not store.exists(path):
        return {}
    names = [status.getPath().getName() for status in store.listStatus(path)]
    return {int(n.split("-", 1)[0]): n.split("-", 1)[1] for n in names if n[:1].isdigit()}


def publish_evidence(manifest: DataFrame, parts: dict[str, DataFrame], folder: str) -> int:
    """Write manifest and parts as one version that readers see whole or not at all; gives its number.

    The tables lie below a name of their own, where nobody looks. The last step renames an empty
    file to the next free number and that name: a rename happens or does not, and of two writers who
    want one number one fails and takes the next. What was published before for a scenario and night
    is replaced for readers, not touched on disk; a writer that dies leaves nothing visible.
    """
    spark = manifest.sparkSession
    version = uuid.uuid4().hex
    at = f"{folder}/{VERSIONS}/{version}"
    where = _places(manifest)
    for name, df in parts.items():
        rows = df.join(where, "run_id").hint("rebalance", "scenario", "night")
        rows.write.partitionBy("scenario", "night").parquet(f"{at}/{name}")
    manifest.hint("rebalance", "scenario", "night").write.partitionBy("scenario", "night").parquet(f"{at}/manifest")
    where.select("scenario", "night").distinct().write.parquet(f"{at}/covers")
    store, commits = _store(spark, f"{folder}/{COMMITS}")
    store.mkdirs(commits)
    draft = _store(spark, f"{at}/draft")[1]
    store.create(draft).close()
    number = max(committed(spark, folder), default=0)
    while True:
        number += 1
        # The number alone is claimed; the name behind it is found again by every reader.
        claim = _store(spark, f"{folder}/{COMMITS}/claim-{number:09d}")[1]
        if store.createNewFile(claim) and store.rename(draft, _store(spark, f"{folder}/{COMMITS}/{number:09d}-{version}")[1]):
            return number


def read_evidence(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of one table (``manifest`` or a part) as published last for their scenario and night."""
    versions = committed(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no evidence is published below {folder}")
    covers = None
    for number, version in sorted(versions.items()):
        rows = spark.read.parquet(f"{folder}/{VERSIONS}/{version}/covers").withColumn("_commit", F.lit(number))
        covers = rows if covers is None else covers.unionByName(rows)
    newest = covers.groupBy("scenario", "night").agg(F.max("_commit").alias("_commit"))
    out = None
    for number, version in sorted(versions.items()):
        base = f"{folder}/{VERSIONS}/{version}/{name}"
        rows = spark.read.option("basePath", base).parquet(base).withColumn("_commit", F.lit(number))
        rows = rows.withColumns({c: F.col(c).cast("string") for c in ("scenario", "night")})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    newest = newest.withColumns({c: F.col(c).cast("string") for c in ("scenario", "night")})
    return out.join(small_side(newest), ["scenario", "night", "_commit"]).drop("_commit")


def append_digest(lines: DataFrame, folder: str) -> None:
    """Add the nights that have no line yet; a night is never written twice.

    ``lines``: night, line, latency. Of several lines for one night in the input the
    smallest, by its other columns, is taken.
    """
    rest = [c for c in lines.columns if c != "night"]
    lines = lines.groupBy("night").agg(F.min(F.struct(*rest)).alias("_one")).select(
        *[F.col(f"_one.{c}").alias(c) if c != "night" else F.col(c) for c in lines.columns]
    )
    fresh = lines
    try:
        done = lines.sparkSession.read.schema(lines.schema).parquet(folder).select("night").distinct()
        fresh = lines.join(done, "night", "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(folder)
