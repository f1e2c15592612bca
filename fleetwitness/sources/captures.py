"""Nested JSON captures: radio fixtures, device diagnostics, coordinator, API reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import iso_instant, json_at
from fleetwitness.operators.liveness import parse_body

RADIO_EVENT = (
    "ts STRING, tsn INT, endpoint INT, dir STRING, cluster STRING, frame STRING, commandId INT, status STRING, "
    "args MAP<STRING,STRING>, attr STRUCT<id: STRING, name: STRING, type: STRING, value: STRING>, "
    "attrs MAP<STRING,STRING>, note STRING"
)
RADIO_FIXTURE = (
    "provenance MAP<STRING,STRING>, "
    "environment STRUCT<host: STRING, coordinator: STRING, referenceStack: STRING, network: STRING, device: MAP<STRING,STRING>>, "
    f"events ARRAY<STRUCT<{RADIO_EVENT}>>, "
    f"sequences ARRAY<STRUCT<name: STRING, events: ARRAY<STRUCT<{RADIO_EVENT}>>>>"
)


def read_radio_fixture(
    spark: SparkSession, path: str, date: str | None = None, zone: str = "UTC", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(events, notes): one row per event and attribute; rows without a time are notes.

    A stamp with only a time of day takes ``date`` and ``zone`` from the provenance.
    ``multi_line`` reads one capture per file; without it every line is a capture,
    which lets Spark split large files.
    """
    raw = spark.read.schema(RADIO_FIXTURE).option("multiLine", multi_line).json(path)
    named = F.coalesce(
        F.col("sequences"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("events").alias("events")))
    )
    rows = (
        raw.select(
            F.col("_metadata.file_path").alias("capture_id"),
            "environment",
            F.posexplode(named).alias("seq_no", "s"),
        )
        .select("capture_id", "environment", "seq_no", F.col("s.name").alias("sequence"), F.posexplode("s.events").alias("pos", "e"))
        .select("capture_id", "environment", "seq_no", "sequence", "pos", "e.*")
    )
    full = iso_instant(F.col("ts"))
    if date is not None:
        wall = F.try_to_timestamp(F.concat(F.lit(date + " "), F.col("ts")))
        full = F.when(F.col("ts").contains("T"), full).otherwise(F.to_utc_timestamp(wall, zone))
    notes = rows.where(F.col("ts").isNull()).select("capture_id", "sequence", "pos", "note")
    single = F.when(F.col("attr").isNotNull(), F.create_map(F.col("attr.name"), F.col("attr.value")))
    events = (
        rows.where(F.col("ts").isNotNull())
        .withColumns({"ts_raw": F.col("ts"), "ts": full, "_a": F.coalesce("attrs", single)})
        .select(
            "capture_id", "environment", "seq_no", "sequence", "pos", "ts", "ts_raw", "tsn", "endpoint",
            F.col("dir").alias("direction"), "cluster", "frame", F.col("commandId").alias("command_id"), "status",
            "args", "note", F.explode_outer("_a").alias("attr_name", "value"),
        )
    )
    return events, notes


def snapshot_of(multi_line: bool) -> Column:
    """A file is a snapshot; where every line is one, the line names it."""
    return F.col("_metadata.file_path") if multi_line else F.col("snapshot")


CLUSTER = (
    "STRUCT<cluster_id: STRING, endpoint_attribute: STRING, attributes: ARRAY<STRUCT<id: STRING, name: STRING, "
    "zcl_type: STRING, value: VARIANT, unsupported: BOOLEAN>>>"
)
DIAGNOSTICS = (
    "snapshot STRING, data STRUCT<nwk: STRING, manufacturer: STRING, model: STRING, manufacturer_code: INT, power_source: STRING, "
    "lqi: INT, rssi: INT, last_seen: STRING, device_type: STRING, quirk_applied: BOOLEAN, "
    f"endpoints: MAP<STRING, STRUCT<profile_id: INT, in_clusters: ARRAY<{CLUSTER}>, out_clusters: ARRAY<{CLUSTER}>>>>"
)


def read_diagnostics(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(devices, attributes) of device diagnostics files; values stay VARIANT."""
    raw = spark.read.schema(DIAGNOSTICS).option("multiLine", multi_line).json(path)
    raw = raw.select(snapshot_of(multi_line).alias("snapshot_id"), "data.*")
    devices = raw.drop("endpoints").withColumn("last_seen", iso_instant(F.col("last_seen")))
    points = raw.select("snapshot_id", F.explode("endpoints").alias("endpoint", "p"))
    sides = F.array(
        F.struct(F.lit("in").alias("direction"), F.col("p.in_clusters").alias("clusters")),
        F.struct(F.lit("out").alias("direction"), F.col("p.out_clusters").alias("clusters")),
    )
    clusters = (
        points.select("snapshot_id", "endpoint", F.explode(sides).alias("s"))
        .select("snapshot_id", "endpoint", "s.direction", F.explode("s.clusters").alias("c"))
        .select("snapshot_id", "endpoint", "direction", F.col("c.cluster_id").alias("cluster"),
                F.col("c.endpoint_attribute").alias("cluster_name"), F.explode_outer("c.attributes").alias("a"))
    )
    attributes = clusters.select(
        "snapshot_id", "endpoint", "direction", "cluster", "cluster_name",
        F.col("a.id").alias("attr_id"), F.col("a.name").alias("attr_name"), F.col("a.zcl_type").alias("zcl_type"),
        F.col("a.value").alias("value"), F.coalesce("a.unsupported", F.lit(False)).alias("unsupported"),
    )
    return devices, attributes


COORDINATOR = (
    "snapshot STRING, data STRUCT<application_state: STRUCT<counters: MAP<STRING, MAP<STRING, STRUCT<repr: STRING>>>>, "
    "energy_scan: MAP<STRING, DOUBLE>>"
)


def read_coordinator(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(counters, energy scan) of coordinator snapshots."""
    raw = spark.read.schema(COORDINATOR).option("multiLine", multi_line).json(path)
    raw = raw.select(snapshot_of(multi_line).alias("snapshot_id"), "data.*")
    named = raw.select("snapshot_id", F.explode("application_state.counters").alias("counter_group", "m")).select(
        "snapshot_id", "counter_group", F.explode("m").alias("name", "c")
    )
    counters = named.select(
        "snapshot_id",
        "counter_group",
        "name",
        F.regexp_extract("c.repr", r"_raw_value=(\d+)", 1).try_cast("bigint").alias("raw_value"),
        F.regexp_extract("c.repr", r"reset_count=(\d+)", 1).try_cast("bigint").alias("reset_count"),
    )
    scan = raw.select("snapshot_id", F.explode("energy_scan").alias("channel", "energy")).withColumn(
        "channel", F.col("channel").cast("int")
    )
    return counters, scan


CAPTURE = "ARRAY<STRUCT<when: STRING, what: STRING, status: INT, body: STRING>>"


def read_api_captures(files: DataFrame, text: str = "text", key: str = "bundle") -> DataFrame:
    """Capture lists (one JSON text per row) to ``key, idx, …, readable, doc``.

    A text that is not a list keeps one unreadable row; a cut body gives a NULL doc.
    """
    shape = F.schema_of_variant(F.try_parse_json(text))
    readable = F.coalesce(shape.startswith("ARRAY"), F.lit(False))
    rows = files.withColumn("readable", readable).select(
        key, "readable", F.posexplode_outer(F.when(readable, F.from_json(text, CAPTURE))).alias("idx", "c")
    )
    return parse_body(rows.select(key, "readable", "idx", "c.*"))


def read_runs_and_chains(reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, chains, actions) from API reads of the run list and of causal chains.

    ``reads``: scope, path, poll_seq, status, body.
    """
    docs = parse_body(reads)
    lists = docs.where((F.col("path") == "/api/v1/runs") & (F.col("status") == 200))
    runs = lists.select(
        "scope", "poll_seq", F.posexplode(F.try_variant_get("doc", "$.data", "array<variant>")).alias("list_pos", "r")
    ).select(
        "scope",
        "poll_seq",
        "list_pos",
        json_at(F.col("r"), "runId").alias("run_id"),
        json_at(F.col("r"), "triggeredAt").alias("triggered_at"),
        json_at(F.col("r"), "status").alias("status"),
    )
    run_id = F.regexp_extract("path", r"^/api/v1/runs/([^/]+)/causal-chain$", 1)
    found = docs.withColumn("run_id", run_id).where(F.col("run_id") != "")
    actions = found.select(
        "scope", "run_id", "poll_seq", "status", F.posexplode(F.try_variant_get("doc", "$.data.actions", "array<variant>")).alias("pos", "a")
    ).select(
        "scope",
        "run_id",
        "poll_seq",
        "status",
        "pos",
        json_at(F.col("a"), "command").alias("command"),
        json_at(F.col("a"), "outcome").alias("outcome"),
        json_at(F.col("a"), "reason").alias("reason"),
    )
    chains = found.select(
        "scope",
        "run_id",
        "poll_seq",
        "status",
        json_at(F.col("doc"), "data.trigger.matchedAt").alias("matched_at"),
        F.size(
            F.filter(
                F.coalesce(F.try_variant_get("doc", "$.data.actions", "array<variant>"), F.array().cast("array<variant>")),
                lambda a: F.coalesce(F.try_variant_get(a, "$.outcome", "string"), F.lit("")) != "",
            )
        ).alias("executed"),
    )
    return runs, chains, actions
