"""Fleet tables: retention, newest events, evidence time line, labeled tuples."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwitness.operators.ordered import ordered, row_index, smallest

# Event types of the command verdict stream.
COMMAND_EVENT_TYPES = (
    "command_issued", "command_dispatched", "state_confirmed", "command_result",
    "command_confirmation_timed_out",
)


def command_events(events: DataFrame, types: Sequence[str] = COMMAND_EVENT_TYPES) -> DataFrame:
    """Rows of the given event types; the filter reaches the scan."""
    return events.where(F.col("event_type").isin(*types))


def latest_events(events: DataFrame, n: int = 30, position: str = "global_position", types: Sequence[str] = COMMAND_EVENT_TYPES) -> DataFrame:
    """The newest ``n`` command events, newest first."""
    return command_events(events, types).orderBy(F.col(position).desc()).limit(n)


def prunable_logs(logs: DataFrame, citations: DataFrame, keep: int = 2) -> DataFrame:
    """Logs older than the newest ``keep`` boots, copied off, and not cited by an open row.

    ``logs``: bench_id, boot_id, boot_seq, copied; ``citations``: boot_id.
    """
    newest = smallest(logs, ["bench_id"], [F.col("boot_seq").desc()], keep).select("bench_id", "boot_id")
    older = logs.join(newest, ["bench_id", "boot_id"], "left_anti")
    return older.where("copied").join(citations.select("boot_id"), "boot_id", "left_anti")


def ordered_suite(suites: DataFrame) -> DataFrame:
    """Legs of each suite in list order. ``suites``: suite, legs ARRAY."""
    return suites.select("suite", F.posexplode("legs").alias("pos", "scenario"))


def whole_suite(scenarios: DataFrame) -> DataFrame:
    """The suite ``all``: every scenario by name, without the constants file."""
    return scenarios.where(F.col("scenario") != "constants").select("scenario").distinct().orderBy("scenario")


def evidence_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Log, API and radio evidence on one time line, labeled by kind."""
    labeled = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labeled)


def evidence_timeline(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The parts on one ordered time line per key: ``place`` from 1.

    Every part has the keys, ``at_us`` and ``seq``, its own order (line number, poll, frame). Order:
    instant, then the order in which the parts are named, then ``seq``; rows without an instant come
    first. A key with very many rows is numbered in segments.
    """
    named = {kind: df.withColumn("kind_order", F.lit(n)) for n, (kind, df) in enumerate(parts.items())}
    rows = evidence_union(named)
    return ordered(rows, keys, ["at_us", "kind_order", "seq"]).scan(place=row_index()).frame()


def labeled_tuples(verdicts: DataFrame, matches: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row per run: verdict, matched positions, latency, ready to append by scenario.

    ``matches``: run_id, idx; ``latencies``: run_id, latency_us.
    """
    spans = matches.groupBy("run_id").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("matched")
    )
    measured = latencies.groupBy("run_id").agg(F.max("latency_us").alias("latency_us"))
    out = verdicts.join(spans, "run_id", "left").join(measured, "run_id", "left")
    return out.withColumn("matched", F.coalesce("matched", F.lit(0)).cast("bigint"))
