"""Source queries S1, S4–S6, S11: captures written from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.plans.registry import query
from fleetwitness.plans.standins import k_of
from fleetwitness.session import scratch_path, written
from fleetwitness.sources import captures
from fleetwitness.sources.logs import read_log_lines
from fleetwitness.sources.sinks import evidence_manifest, evidence_records, publish_evidence, read_evidence, resolved_values, write_evidence


@query(
    "s1_read_log_lines",
    """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT lang, count(*) AS lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, count(*) AS numbered,
      CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS last_byte FROM l GROUP BY lang""",
)
def log_lines(t):
    """Lines, bytes, and the same two numbers from the last index and offset of each file."""
    folder = scratch_path(t.spark, "logs")
    t.documents.select("lang", "text").write.partitionBy("lang").text(folder)
    lines = read_log_lines(t.spark, folder).withColumn("lang", F.regexp_extract("file", r"lang=([^/]+)/", 1))
    size = F.octet_length("text") + 1
    per_file = lines.groupBy("lang", "file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes"),
        (F.max("idx") + 1).alias("numbered"), F.max(F.col("byte_off") + size).alias("last_byte"),
    )
    return per_file.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("lines", "bytes", "numbered", "last_byte")])


def radio_captures(t):
    """One capture per event: purchase lines carry two attributes, signup lines are notes."""
    folder = scratch_path(t.spark, "radio")
    kind, k = F.col("event_type"), k_of(F.col("props"))
    stamp = F.when(kind != "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    attr = F.when(kind.isin("click", "view", "error"), F.struct(F.lit("0x0000").alias("id"), F.lit("level").alias("name"), k.alias("value")))
    attrs = F.when(kind == "purchase", F.struct(k.alias("level"), (k > 50).alias("on_off")))
    event = F.struct(
        stamp.alias("ts"), F.pmod("event_id", F.lit(256)).alias("tsn"), F.lit("0x0008").alias("cluster"),
        kind.alias("frame"), attr.alias("attr"), attrs.alias("attrs"), F.when(kind == "signup", "by hand").alias("note"),
    )
    environment = F.struct(F.concat(F.lit("host-"), F.col("user_id")).alias("host"))
    t.events.select(
        F.to_json(F.struct(environment.alias("environment"), F.array(event).alias("events")))
    ).write.text(folder)
    return captures.read_radio_fixture(t.spark, folder, multi_line=False)


EVENTS_K = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(
    "s4_read_radio_fixture",
    f"""{EVENTS_K} SELECT 'host-' || user_id AS host, epoch_us(ts) AS us, event_id % 256 AS tsn, event_type AS frame,
      'level' AS attr_name, CAST(k AS VARCHAR) AS value FROM e WHERE event_type <> 'signup'
    UNION ALL SELECT 'host-' || user_id, epoch_us(ts), event_id % 256, event_type, 'on_off', CASE WHEN k > 50 THEN 'true' ELSE 'false' END
    FROM e WHERE event_type = 'purchase'""",
)
def radio_fixture(t):
    events, _ = radio_captures(t)
    return events.select(
        F.col("environment.host").alias("host"), micros(F.col("ts")).alias("us"), F.col("tsn").cast("bigint"),
        "frame", "attr_name", "value",
    )


@query("s4_quarantined_notes", "SELECT 'by hand' AS note, count(*) AS n FROM events WHERE event_type = 'signup'")
def radio_notes(t):
    return radio_captures(t)[1].groupBy("note").agg(F.count(F.lit(1)).alias("n"))


def diagnostics(t):
    """A part is a device: a text, a number and an unsupported attribute on one endpoint."""
    folder = scratch_path(t.spark, "diagnostics")

    def attribute(code, name, **rest):
        return F.struct(F.lit(code).alias("id"), F.lit(name).alias("name"), *[v.alias(k) for k, v in rest.items()])

    basic = F.struct(
        F.lit("0x0000").alias("cluster_id"), F.lit("basic").alias("endpoint_attribute"),
        F.array(attribute("0x0005", "model", zcl_type=F.lit("string"), value=F.col("p_name"))).alias("attributes"),
    )
    power = F.struct(
        F.lit("0x0001").alias("cluster_id"), F.lit("power").alias("endpoint_attribute"),
        F.array(attribute("0x0021", "battery", zcl_type=F.lit("uint8"), value=F.col("p_size"))).alias("attributes"),
    )
    scenes = F.struct(
        F.lit("0x0005").alias("cluster_id"), F.lit("scenes").alias("endpoint_attribute"),
        F.array(attribute("0x0033", "count", unsupported=F.lit(True))).alias("attributes"),
    )

    def texts(*clusters):
        return F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(c) for c in clusters]), F.lit("]"))

    head = F.to_json(
        F.struct(
            F.lit("0x6B9A").alias("nwk"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"),
            F.col("p_size").alias("lqi"), (-F.col("p_size")).alias("rssi"), F.lit("2026-07-02T01:13:35.544772+00:00").alias("last_seen"),
        )
    )
    line = F.concat(
        F.lit('{"snapshot":"'), F.col("p_partkey"), F.lit('","data":'), F.regexp_replace(head, r"\}$", ""),
        F.lit(',"endpoints":{"1":{"profile_id":260,"in_clusters":'), texts(basic, power),
        F.lit(',"out_clusters":'), texts(scenes), F.lit("}}}}"),
    )
    t.part.select(line).write.text(folder)
    return captures.read_diagnostics(t.spark, folder, multi_line=False)


@query(
    "s5_read_diagnostics",
    """SELECT CAST(p_partkey AS VARCHAR) AS snapshot_id, 'in' AS direction, '0x0000' AS cluster, 'model' AS attr_name, p_name AS value, false AS unsupported FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'in', '0x0001', 'battery', CAST(p_size AS VARCHAR), false FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'out', '0x0005', 'count', NULL, true FROM part""",
)
def diagnostics_attributes(t):
    _, attributes = diagnostics(t)
    value = F.try_variant_get("value", "$", "string")
    return attributes.select("snapshot_id", "direction", "cluster", "attr_name", value.alias("value"), "unsupported")


@query(
    "s5_read_devices",
    """SELECT CAST(p_partkey AS VARCHAR) AS snapshot_id, p_brand AS manufacturer, p_name AS model, p_size AS lqi, -p_size AS rssi,
      1782954815544772 AS last_seen_us FROM part""",
)
def diagnostics_devices(t):
    devices, _ = diagnostics(t)
    return devices.select("snapshot_id", "manufacturer", "model", "lqi", "rssi", micros(F.col("last_seen")).alias("last_seen_us"))


def coordinators(t):
    """A supplier is a coordinator with two counters and a scan of three channels."""
    folder = scratch_path(t.spark, "coordinators")

    def counter(name, raw):
        text = F.format_string(f"Counter(name='{name}', _raw_value=%d, reset_count=1, _last_reset_value=0)", raw)
        return F.struct(text.alias("repr")).alias(name)

    counters = F.struct(
        F.struct(counter("RX", F.col("s_suppkey")), counter("TX", F.col("s_nationkey"))).alias("ezsp_counters")
    )
    scan = F.struct(*[(F.col("s_acctbal") / n).alias(str(c)) for n, c in ((1, 11), (2, 15), (4, 20))])
    data = F.struct(F.struct(counters.alias("counters")).alias("application_state"), scan.alias("energy_scan"))
    t.supplier.select(
        F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("snapshot"), data.alias("data")))
    ).write.text(folder)
    return captures.read_coordinator(t.spark, folder, multi_line=False)


@query(
    "s6_read_counters",
    """SELECT CAST(s_suppkey AS VARCHAR) AS snapshot_id, 'RX' AS name, s_suppkey AS raw_value FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'TX', s_nationkey FROM supplier""",
)
def counters(t):
    return coordinators(t)[0].select("snapshot_id", "name", "raw_value")


@query(
    "s6_read_energy_scan",
    """SELECT CAST(s_suppkey AS VARCHAR) AS snapshot_id, 11 AS channel, s_acctbal AS energy FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 15, s_acctbal / 2 FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 20, s_acctbal / 4 FROM supplier""",
)
def energy_scan(t):
    return coordinators(t)[1]


@query(
    "s11_write_evidence",
    """SELECT o_orderpriority AS scenario, strftime(o_orderdate, '%Y-%m-%d') AS night, count(*) AS runs,
      CAST(sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')) AS BIGINT) AS log_lines,
      CAST(sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)) AS BIGINT) AS parts
    FROM orders GROUP BY 1, 2""",
)
def evidence_written(t):
    """Write the evidence of every order, twice, and read the manifest and the parts back."""
    folder = scratch_path(t.spark, "evidence")
    verdicts = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("scenario"), F.date_format("o_orderdate", "yyyy").alias("night"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    rows = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_returnflag", "l_linestatus", "l_linenumber")
    parts = (
        rows.where(F.col("l_returnflag") != "R"),
        rows.where(F.col("l_returnflag") == "R"),
        rows.where(F.col("l_linestatus") == "F"),
    )
    records = written(evidence_records(verdicts, *parts), "evidence-records")
    for _ in range(2):
        write_evidence(records, *parts, folder)
    manifest, logs, reads = (t.spark.read.parquet(f"{folder}/{name}") for name in ("manifest", "log_lines", "api_reads"))
    counted = logs.select("run_id").unionByName(reads.select("run_id")).groupBy("run_id").agg(F.count(F.lit(1)).alias("part_rows"))
    return manifest.join(counted, "run_id", "left").groupBy("scenario", F.col("day").alias("night")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("log_lines").alias("log_lines"), F.coalesce(F.sum("part_rows"), F.lit(0)).alias("parts")
    )


@query(
    "s11_publish_evidence",
    """SELECT o_orderkey AS run_id, o_orderpriority AS scenario, strftime(o_orderdate, '%Y') AS night,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'second' ELSE 'first' END AS edition,
      count(l_orderkey) FILTER (l_returnflag <> 'R') AS log_lines, 3 AS resolved,
      CASE WHEN count(l_orderkey) FILTER (l_returnflag <> 'R') = 0 THEN 'log_lines' ELSE '' END AS absent,
      string_agg(l_linenumber || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag <> 'R') AS lines,
      'constant:state=' || o_orderstatus || ',extracted:total=' || CAST(o_totalprice AS DECIMAL(20, 2)) || ',let:customer=' || o_custkey AS named
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate, o_orderstatus, o_totalprice, o_custkey""",
)
def evidence_published(t):
    """All runs, then one scenario again: readers see the second edition of it and the first of the others."""
    folder = scratch_path(t.spark, "published")
    verdicts = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("scenario"), F.date_format("o_orderdate", "yyyy").alias("night")
    )
    runs = t.orders.withColumnRenamed("o_orderkey", "run_id")
    value = lambda name, column: runs.select("run_id", F.lit(name).alias("name"), column.cast("string").alias("value"))
    resolved = resolved_values(value("state", F.col("o_orderstatus")), value("customer", F.col("o_custkey")), value("total", F.col("o_totalprice").cast("decimal(20,2)")))
    lines = t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx"), F.col("l_linestatus").alias("text"))
    parts = {"log_lines": lines, "resolved": resolved}
    whole = written(evidence_manifest(verdicts, parts), "evidence-manifest")
    publish_evidence(whole.withColumn("edition", F.lit("first")), parts, folder)
    publish_evidence(whole.where("scenario = '1-URGENT'").withColumn("edition", F.lit("second")), parts, folder)
    manifest, log_lines, values = (read_evidence(t.spark, folder, name) for name in ("manifest", "log_lines", "resolved"))
    text = lambda entries, sep: F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), sep)
    seen = log_lines.groupBy("run_id").agg(text(F.collect_list(F.struct("idx", F.concat("idx", "text").alias("t"))), ",").alias("lines"))
    label = F.concat("kind", F.lit(":"), "name", F.lit("="), "value")
    named = values.groupBy("run_id").agg(text(F.collect_list(F.struct("kind", label.alias("t"))), ",").alias("named"))
    rows = manifest.join(seen, "run_id", "left").join(named, "run_id", "left")
    return rows.select("run_id", "scenario", "night", "edition", "log_lines", F.col("resolved").cast("int").alias("resolved"), "absent", "lines", "named")
