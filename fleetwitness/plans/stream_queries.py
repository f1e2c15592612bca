"""Streaming queries R1–R9: a file stream over the table, run until it is drained.

The stateful ones read the events in four rolled files, one per micro-batch, in which rows come up to
fifty minutes out of order; the allowed delay is an hour, so none is too late. Their SQL twins see
what the last watermark has passed; r4_stream_confirm and r8_late_reports close the stream, so that it
passes everything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.plans.command_queries import VERDICTS
from fleetwitness.plans.log_queries import DAY_RUNS, day_expectations, day_scenario
from fleetwitness.plans.registry import query
from fleetwitness.plans.sensor_queries import LAGGED, TWIN_GAP_S
from fleetwitness.plans.standins import (
    BOOT_LINES,
    COMMAND_TABLES,
    DOC_FORBIDDEN,
    DOC_LINES,
    HOUR_US,
    boot_log,
    doc_forbidden,
    k_of,
    profile,
)
from fleetwitness.plans.suite_queries import DIGEST_SQL, digests
from fleetwitness.session import scratch_path
from fleetwitness.sources.logs import split_text
from fleetwitness.streaming import live
from fleetwitness.streaming.drain import read_stream, run_to_table

KEYS = ["device_id", "attr_name"]


def table_stream(t, name):
    """The table as a file stream; a glob, since the table may be one file or a folder."""
    schema = t.spark.read.parquet(t.path(name)).schema
    return read_stream(t.spark, f"{t.sf_dir}/{name}.parque[t]", schema)


def event_stream(t):
    return table_stream(t, "events")


ROLLED = 4
DELAY = "1 hour"
#: The last watermark over all events, in microseconds; Spark keeps milliseconds.
MARK_SQL = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {HOUR_US} FROM events)"


#: Rows of a rolled file; a roll of more rows is several files, which make one micro-batch.
FILE_ROWS = 500_000


def rolled_events(t, close_after_us=None):
    """The events as a stream of rolls, one per micro-batch, out of order within the delay.

    With ``close_after_us`` the stream ends with a mark so long behind the last event: a command of no
    device, which the watermark never passes, so that it passes all else.
    """
    late = F.pmod(F.xxhash64("event_id"), F.lit(3000)) * 1_000_000
    arrival = micros(F.col("ts")) + late
    rows = t.events.withColumn("_arrival", arrival)
    first, last, n_rows, end = rows.agg(F.min("_arrival"), F.max("_arrival"), F.count(F.lit(1)), F.max(micros(F.col("ts")))).first()
    folder = scratch_path(t.spark, "rolled-events")
    width = ((last or 0) - (first or 0)) // ROLLED + 1
    files = max(1, -(-n_rows // (ROLLED * FILE_ROWS)))
    for n in range(ROLLED):
        part = F.floor((F.col("_arrival") - F.lit(first)) / width) == n
        roll = rows.where(part).drop("_arrival")
        # A file takes its place in the stream by its time of writing.
        (roll.coalesce(1) if files == 1 else roll.repartition(files, "event_id")).write.mode("append").parquet(folder)
        # Parts without rows write no file; empty ones stand in, so that a micro-batch ends with its roll.
        missing = files * (n + 1) - len(t.spark.read.schema(t.events.schema).parquet(folder).inputFiles())
        for _ in range(missing):
            t.events.limit(0).coalesce(1).write.mode("append").parquet(folder)
    if close_after_us is not None and end is not None:
        mark = {"ts": F.timestamp_micros(F.lit(end + close_after_us)), "event_type": F.lit("click")}
        columns = [mark.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.events.schema.fields]
        t.spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    return read_stream(t.spark, folder, t.events.schema, maxFilesPerTrigger=files)


def passed(sql):
    """The same question about the events that the last watermark has passed."""
    return f"WITH passed AS (SELECT * FROM events WHERE epoch_us(ts) <= {MARK_SQL}), " + sql.replace("FROM events", "FROM passed").removeprefix("WITH ")


@query(
    "r1_tail_logs",
    f"""WITH {BOOT_LINES} SELECT event_type AS token, CAST(event_id AS VARCHAR) AS pair_id,
      CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS level, tod_ms FROM boot_log""",
)
def tail_logs(t):
    folder = scratch_path(t.spark, "rolled-logs")
    boot_log(t).select("text").write.text(folder)
    lines = live.tail_logs(t.spark, folder).select(
        "token", F.col("kv")["id"].alias("pair_id"), "level", F.col("tod_ms").cast("bigint")
    )
    return run_to_table(lines, "r1")


@query(
    "r2_stream_forbidden",
    f"""WITH {DOC_LINES}, {DOC_FORBIDDEN} SELECT l.run_id, f.j, l.idx FROM lines l, forb f
    WHERE f.after_token IS NULL AND contains(l.text, f.token)""",
)
def stream_forbidden(t):
    docs = table_stream(t, "documents")
    lines = split_text(docs.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "run_id")
    runs = t.documents.select(F.col("doc_id").alias("run_id"), F.col("lang").alias("scenario"))
    hits = live.stream_forbidden(lines, runs, doc_forbidden(t))
    return run_to_table(hits.select("run_id", "j", "idx"), "r2")


def day_lines(rows):
    return rows.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        day_scenario(F.col("ts")).alias("scenario"), F.date_trunc("day", "ts").alias("t0"), "ts",
        F.col("event_id").alias("idx"), F.concat_ws(": ", "event_type", "props").alias("text"),
    )


@query(
    "r2_stream_anchored",
    passed(f"""{DAY_RUNS}
    SELECT l.run_id, 0 AS j, l.idx FROM lines l JOIN k2 USING (run_id) WHERE l.event_type = 'error' AND l.idx > k2.idx"""),
)
def stream_anchored(t):
    """Forbidden below an anchor that the same stream brings."""
    rules = t.rows(
        "scenario STRING, j INT, token STRING, after_token STRING",
        *[(s, *f) for s in ("weekday", "weekend") for f in ((0, "error:", "signup:"), (1, '"k": 13', None))],
    )
    hits = live.stream_anchored(day_lines(rolled_events(t)), day_expectations(t, (":", ["k"])), rules, DELAY, keep="2 days")
    return run_to_table(hits.select("run_id", "j", "idx"), "r2a")


TIMED = """timed AS (
      SELECT r.run_id, r.t0, k0.m AS m0, k1.m AS m1, k2.m AS m2, k2.idx AS anchor, r.t0 + w0 AS d0, greatest(r.t0, coalesce(k0.m, r.t0)) + w1 AS d1,
        greatest(r.t0, coalesce(k0.m, r.t0), coalesce(k1.m, r.t0)) + w2 AS d2
      FROM runs r LEFT JOIN k0 USING (run_id) LEFT JOIN k1 USING (run_id) LEFT JOIN k2 USING (run_id)),
    f AS (
      SELECT *, CASE WHEN NOT coalesce(m0 <= d0, false) THEN 0 WHEN NOT coalesce(m1 <= d1, false) THEN 1
                     WHEN NOT coalesce(m2 <= d2, false) THEN 2 END AS failed_i FROM timed)"""


@query(
    "r3_stream_deadlines",
    passed(f"""{DAY_RUNS}, {TIMED},
    s AS (
      SELECT run_id, failed_i, CASE WHEN failed_i IS NULL THEN 'PASS'
        WHEN CASE failed_i WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END IS NOT NULL THEN 'FAIL'
        WHEN CASE failed_i WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END < {MARK_SQL.replace("FROM events", "FROM  events")} THEN 'FAIL' END AS status FROM f)
    SELECT * FROM s WHERE status IS NOT NULL"""),
)
def stream_deadlines(t):
    rows = live.stream_verdicts(day_lines(rolled_events(t)), day_expectations(t, (":", ["k"])), DELAY, keep="3 days")
    return run_to_table(rows.select("run_id", "failed_i", "status"), "r3")


@query(
    "r3_stream_verdicts",
    passed(f"""{DAY_RUNS}, {TIMED},
    mark AS (SELECT {MARK_SQL.replace("FROM events", "FROM  events")} AS us),
    ended AS (
      SELECT *, CASE WHEN failed_i IS NULL THEN greatest(m0, m1, m2)
        WHEN CASE failed_i WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END IS NOT NULL OR CASE failed_i WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END < mark.us
        THEN CASE failed_i WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END END AS end_us FROM f, mark),
    bad AS (
      SELECT l.run_id, l.us, l.idx, 'error:' AS token FROM lines l JOIN ended b USING (run_id)
      WHERE l.event_type = 'error' AND l.idx > b.anchor AND m0 <= d0 AND m1 <= d1 AND m2 <= d2 AND l.us <= end_us
      UNION ALL
      SELECT l.run_id, l.us, l.idx, '"k": 13' FROM lines l JOIN ended b USING (run_id) JOIN events e ON e.event_id = l.idx
      WHERE contains(e.props, '"k": 13') AND l.us <= coalesce(b.end_us, l.us)),
    hit AS (SELECT run_id, min(us) AS us, min_by(idx, us) AS idx, min_by(token, us) AS token FROM bad GROUP BY run_id)
    SELECT b.run_id, CASE WHEN h.us IS NOT NULL OR failed_i IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN h.us IS NOT NULL THEN 'forbidden hit: ' || h.token WHEN failed_i IS NOT NULL THEN 'expected-not-seen: line ' || failed_i
           ELSE '3/3 positive · 0 forbidden' END AS reason,
      CASE WHEN h.us IS NULL THEN failed_i END AS failed_i, h.idx AS forbidden_idx, coalesce(h.us, end_us) - t0 AS decided_after_us
    FROM ended b LEFT JOIN hit h USING (run_id) WHERE h.us IS NOT NULL OR end_us IS NOT NULL"""),
)
def stream_verdicts(t):
    """Deadlines and forbidden lines, one with an anchor in the same stream."""
    rules = t.rows(
        "scenario STRING, j INT, token STRING, after_token STRING",
        *[(s, *f) for s in ("weekday", "weekend") for f in ((0, "error:", "signup:"), (1, '"k": 13', None))],
    )
    rows = live.stream_verdicts(day_lines(rolled_events(t)), day_expectations(t, (":", ["k"])), DELAY, rules, keep="3 days")
    written = run_to_table(rows.select("run_id", "status", "reason", "failed_i", "forbidden_idx", "decided_after_us", "revision"), "r3v")
    return live.last_revisions(written)


#: Commands and reports share one watermark, which sees the events of these two types.
COMMAND_MARK = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {HOUR_US} FROM events WHERE event_type IN ('click', 'purchase'))"


#: Behind the last event, the longest timeout of the profile and the delay.
CLOSED_US = 14 * HOUR_US


def live_commands(t, close_after_us=None):
    """Commands and reports of the event stream, with its watermark."""
    rows = rolled_events(t, close_after_us).withWatermark("ts", DELAY)
    k = k_of(F.col("props"))
    own = [F.col("user_id").alias("device_id"), F.lit("current_level").alias("attr_name"), "ts"]
    capability = F.when(k < 50, "brightness").when(k < 85, "on_off").otherwise("effect")
    level = F.floor(F.col("value") / 50).cast("double")
    cmds = rows.where("event_type = 'click'").select(F.col("event_id").alias("cmd_id"), *own, capability.alias("capability"), level.alias("target"))
    reports = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("report_id"), *own, level.alias("value"))
    return cmds, reports


@query(
    "r4_stream_confirm",
    f"""{VERDICTS.replace("WHEN a.ack_status <> 'SUCCESS' THEN 'FAILED'", "WHEN false THEN 'FAILED'")}
    SELECT cmd_id, verdict, latency_us FROM verdicts""",
)
def stream_confirm(t):
    """Every command; the stream is closed behind the last timeout."""
    out = run_to_table(live.stream_confirm(*live_commands(t, CLOSED_US), profile(t), KEYS), "r4")
    return out.select("cmd_id", "verdict", "latency_us")


@query(
    "r5_stream_drop_twins",
    f"{LAGGED} SELECT device_id, event_id, tsn, value FROM kept WHERE us <= {MARK_SQL}",
)
def stream_drop_twins(t):
    rows = rolled_events(t).select(
        F.col("user_id").alias("device_id"), F.lit("0x0406").alias("cluster"), F.lit("occupancy").alias("attr_name"),
        "ts", "event_id", F.pmod(F.col("event_id"), F.lit(256)).alias("tsn"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("value"),
    )
    out = live.stream_drop_twins(rows, ["device_id", "cluster", "attr_name"], ["ts", "event_id"], TWIN_GAP_S, DELAY)
    return run_to_table(out, "r5").select("device_id", "event_id", "tsn", "value")


@query(
    "r6_stream_sessions",
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {12 * HOUR_US} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM g),
    a AS (SELECT user_id, min(us) AS start_us, max(us) + {12 * HOUR_US} AS end_us, count(*) AS n FROM i GROUP BY user_id, s)
    SELECT * FROM a WHERE end_us <= (SELECT (max(epoch_us(ts)) - {HOUR_US}) // 1000 * 1000 FROM events)""",
)
def stream_sessions(t):
    out = run_to_table(live.stream_sessions(event_stream(t), ["user_id"], "12 hours", "1 hour"), "r6", keyed=False)
    return out.select("user_id", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "n")


@query(
    "r7_stream_tumbling",
    f"""WITH w AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start_us + {24 * HOUR_US} <= (SELECT (max(epoch_us(ts)) - {HOUR_US}) // 1000 * 1000 FROM events)""",
)
def stream_tumbling(t):
    out = run_to_table(live.stream_tumbling(event_stream(t), ["user_id"], "1 day", "1 hour"), "r7", keyed=False)
    return out.select("user_id", micros(F.col("start")).alias("start_us"), "n")


OWNED_SQL = f"""{COMMAND_TABLES},
    owned AS (SELECT c.cmd_id, c.capability, c.us, r.report_id, r.us AS report_us, r.us - c.us AS after_us
      FROM reports r ASOF JOIN cmds c ON r.device_id = c.device_id AND r.us >= c.us)"""


@query(
    "r8_late_reports",
    f"""WITH {OWNED_SQL}
    SELECT cmd_id, report_id, after_us, after_us > timeout_ms * 1000 AS late FROM owned JOIN profile USING (capability)""",
)
def late_reports(t):
    """Every report that has a command; the stream is closed behind the last event."""
    return run_to_table(live.late_reports(*live_commands(t, CLOSED_US), profile(t), KEYS), "r8")


@query(
    "r8_command_outcomes",
    f"""WITH {OWNED_SQL},
    near AS (SELECT cmd_id, count(*) AS n_reports, min(after_us) AS first_after_us FROM owned WHERE after_us <= {48 * HOUR_US} GROUP BY cmd_id)
    SELECT cmd_id, CASE WHEN n_reports IS NULL THEN 'no_edge' WHEN first_after_us > timeout_ms * 1000 THEN 'late' ELSE 'in_time' END AS outcome,
      coalesce(n_reports, 0) AS n_reports, first_after_us
    FROM cmds JOIN profile USING (capability) LEFT JOIN near USING (cmd_id) WHERE us + {48 * HOUR_US} < {COMMAND_MARK}""",
)
def command_outcomes(t):
    return run_to_table(live.command_outcomes(*live_commands(t), profile(t), KEYS, "48 hours"), "r8o")


@query("r9_stream_digest", DIGEST_SQL)
def stream_digest(t):
    """Nightly lines arrive as files and are appended once, also when the stream is replayed."""
    source, sink = scratch_path(t.spark, "nights"), scratch_path(t.spark, "digest")
    lines = digests(t)
    lines.write.parquet(source)
    for run in ("first", "replay"):
        stream = read_stream(t.spark, source, lines.schema)
        query_ = stream.writeStream.foreachBatch(live.digest_sink(sink)).option(
            "checkpointLocation", f"{sink}-state-{run}"
        )
        query_.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink)
