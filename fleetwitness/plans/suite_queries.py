"""Suite queries: S9, S10, S12, W9, A4–A6, A9, A11, A18–A20, J6, J21, J22, T1, T2, P1."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import verdict_line
from fleetwitness.operators import fleet, suites
from fleetwitness.plans.registry import query
from fleetwitness.plans.standins import TRANSCRIPT, transcript
from fleetwitness.session import scratch_path
from fleetwitness.sources.sinks import append_digest, evidence_records

NIGHTS = "nights AS (SELECT DISTINCT conv_id AS night FROM conversations)"
SKIPS = """caps AS (
  SELECT night, CASE WHEN contains(reason, '[hub]') THEN 'hub+plug' ELSE 'plug' END AS cap, count(*) AS n
  FROM verdicts WHERE status = 'SKIPPED' GROUP BY 1, 2)"""
COVERAGE = f"""WITH {TRANSCRIPT}, {SKIPS},
skips AS (SELECT night, string_agg(n || ' SKIPPED: [' || cap || ']', ' · ' ORDER BY cap) AS s FROM caps GROUP BY night),
counts AS (
  SELECT night, count(*) FILTER (status IN ('PASS', 'FAIL')) AS ran, count(*) AS total,
    count(*) FILTER (status = 'DEFERRED') AS deferred, count(*) FILTER (status = 'REFUSED') AS refused
  FROM verdicts GROUP BY night),
parts AS (
  SELECT c.*, concat_ws(' · ', s, CASE WHEN deferred > 0 THEN deferred || ' OPERATOR-deferred' END,
    CASE WHEN refused > 0 THEN refused || ' REFUSED' END) AS tail
  FROM counts c LEFT JOIN skips ON skips.night = c.night)"""
FLOOR = f"""WITH {TRANSCRIPT}, {SKIPS}, {NIGHTS},
skips AS (SELECT night, string_agg(n || ' SKIP(' || cap || ')', ' · ' ORDER BY cap) AS s FROM caps GROUP BY night),
named AS (
  SELECT night, string_agg(CASE status WHEN 'FAIL' THEN 'FAIL ' || scenario || ' · bundle ' || coalesce(bundle, 'ABSENT')
      WHEN 'DEFERRED' THEN 'DEFER ' || scenario ELSE 'REFUSED ' || scenario END, ' · '
      ORDER BY CASE status WHEN 'FAIL' THEN 0 ELSE 1 END, idx) AS names
  FROM verdicts WHERE status IN ('FAIL', 'REFUSED', 'DEFERRED') GROUP BY night),
counts AS (SELECT night, count(*) FILTER (status = 'PASS') AS passes, count(*) AS total FROM verdicts GROUP BY night),
floors AS (
  SELECT n.night, CASE WHEN total IS NULL THEN 'no verdicts (suite output unparseable — treat as red)'
    ELSE concat_ws(' · ', passes || '/' || total || CASE WHEN names IS NULL THEN ' PASS' ELSE '' END, names, s) END AS floor
  FROM nights n LEFT JOIN counts USING (night) LEFT JOIN named USING (night) LEFT JOIN skips USING (night))"""


def calendar(t):
    return t.conversations.select(F.col("conv_id").alias("night")).distinct()


def verdicts(t):
    return suites.read_transcript(transcript(t))


@query("s9_read_suite_transcript", f"WITH {TRANSCRIPT} SELECT night, idx, scenario, status, reason, bundle FROM verdicts")
def read_transcript(t):
    return verdicts(t)


@query("w9_attach_bundle", f"WITH {TRANSCRIPT} SELECT night, idx, bundle FROM verdicts WHERE bundle IS NOT NULL")
def attach_bundle(t):
    return verdicts(t).where(F.col("bundle").isNotNull()).select("night", "idx", "bundle")


@query(
    "a4_coverage",
    f"""{COVERAGE} SELECT night, ran, total, deferred, refused,
      'ran ' || ran || '/' || total || CASE WHEN tail <> '' THEN ' — ' || tail ELSE '' END AS line FROM parts""",
)
def coverage(t):
    return suites.coverage(verdicts(t))


@query("a5_floor", f"{FLOOR} SELECT * FROM floors")
def floor(t):
    return suites.floor_text(verdicts(t), calendar(t))


# Paired reads of a night: the first turn is the quiesce read, the second the restore read,
# any later one the end-of-night read; a system turn is a failed read.
PAIR = """reads AS (
  SELECT conv_id AS night, turn, CASE turn WHEN 0 THEN 'quiesce' WHEN 1 THEN 'restore' ELSE 'end' END AS phase,
    CASE WHEN role = 'system' THEN 'unread' WHEN contains(text, 'the') THEN 'present'
         WHEN length(text) > 0 THEN 'absent' ELSE 'unread' END AS state
  FROM conversations),
pairs AS (
  SELECT night, max_by(state, turn) FILTER (phase = 'quiesce') AS q, max_by(state, turn) FILTER (phase = 'restore') AS r,
    max_by(state, turn) FILTER (phase = 'end') AS e FROM reads GROUP BY night),
words AS (
  SELECT night, CASE q WHEN 'absent' THEN 'quiesced' WHEN 'present' THEN 'UNQUIESCED(QUIESCE-ASSERT-FAILED)'
      WHEN 'unread' THEN 'QUIESCE-UNVERIFIED(read-failed)' ELSE 'QUIESCE-UNVERIFIED(early-exit)' END AS evidence_class,
    CASE WHEN r = 'present' THEN 'RESTORED' WHEN r IS NOT NULL OR q IS NOT NULL THEN 'RESTORE-FAILED'
      WHEN e = 'present' THEN 'NEVER-SWAPPED-PRESENT' ELSE 'NEVER-SWAPPED-UNVERIFIED' END AS restore
  FROM pairs)"""


def presence(t):
    phase = F.when(F.col("turn") == 0, "quiesce").when(F.col("turn") == 1, "restore").otherwise("end")
    reads = t.conversations.select(
        F.col("conv_id").alias("night"), F.col("turn").alias("read_seq"), phase.alias("phase"),
        F.when(F.col("role") == "system", 500).otherwise(200).alias("status"), F.col("text").alias("body"),
    )
    return suites.presence_pair(calendar(t), reads, "the")


@query("a20_presence_pair", f"WITH {PAIR} SELECT night, evidence_class, restore FROM words")
def presence_pair(t):
    return presence(t)


# Captures of a bundle: the assistant turn's text length in ms after dispatch; long texts are
# cut in the middle, and a bundle of more than 1,500 characters is not a capture list.
CAPTURES = f"""WITH {TRANSCRIPT}, {NIGHTS},
caps AS (SELECT night, idx, '/b/' || night || '-' || idx AS bundle, n FROM transcript WHERE role = 'assistant'),
leg AS (SELECT night, min_by(status, idx) AS status, min_by(bundle, idx) AS bundle FROM verdicts WHERE scenario = 'leg-2' GROUP BY night),
lat AS (
  SELECT n.night, CASE WHEN l.status IS NULL THEN 'n/a(no-verdict)'
    WHEN l.status <> 'PASS' THEN 'n/a(' || CASE l.status WHEN 'SKIPPED' THEN 'SKIP' WHEN 'DEFERRED' THEN 'DEFER' ELSE l.status END || ')'
    WHEN l.bundle IS NULL THEN 'n/a(no-bundle)' WHEN c.n > 1500 THEN 'n/a(captures-unreadable)'
    WHEN c.n > 800 THEN 'n/a(no-lifecycle)'
    ELSE CAST(CAST(round(CAST(c.n AS DECIMAL(20,6)) * 40 / 1000, CASE WHEN c.n * 40 < 10000 THEN 2 ELSE 1 END) AS DECIMAL(20,2)) AS VARCHAR) END AS raw,
    c.n * 40000 AS us
  FROM nights n LEFT JOIN leg l USING (night) LEFT JOIN caps c ON c.bundle = l.bundle),
lats AS (
  SELECT night, CASE WHEN raw LIKE 'n/a%' THEN raw WHEN us < 10000000 THEN raw || 's' ELSE left(raw, length(raw) - 1) || 's' END AS latency,
    CASE WHEN raw NOT LIKE 'n/a%' THEN us END AS latency_us FROM lat)"""


def bundle_captures(t):
    n = F.length("text")
    base = F.lit("2026-08-01 08:31:02.1").cast("timestamp")
    stamp = F.date_format(F.timestamp_micros(F.unix_micros(base) + n * 40_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    phases = F.struct(
        F.struct(F.lit("2026-08-01T08:31:02.100Z").alias("at")).alias("DISPATCHED"),
        F.struct(stamp.alias("at")).alias("CONFIRMED"),
    )
    body = F.to_json(F.struct(F.struct(phases.alias("lifecycle")).alias("data")))
    return t.conversations.where(F.col("role") == "assistant").select(
        F.concat(F.lit("/b/"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("bundle"),
        F.lit(0).alias("idx"),
        F.when(n > 800, F.substring(body, 1, 40)).otherwise(body).alias("body"),
        (n <= 1500).alias("readable"),
    )


def night_latencies(t):
    return suites.night_latency(verdicts(t), bundle_captures(t), calendar(t), leg="leg-2")


@query("a9_night_latency", f"{CAPTURES} SELECT night, latency, latency_us FROM lats")
def night_latency(t):
    return night_latencies(t).select("night", "latency", "latency_us")


def digests(t):
    parts = suites.floor_text(verdicts(t), calendar(t)).join(presence(t), "night").join(night_latencies(t), "night")
    line = suites.digest(
        F.col("night").cast("string"), F.col("evidence_class"), F.col("floor"), F.col("restore"), F.col("latency")
    )
    return parts.select("night", line.alias("line"), "latency")


LAT_CTES = CAPTURES[CAPTURES.index("caps AS (") :].replace("caps AS (", "bundles AS (").replace("JOIN caps c", "JOIN bundles c")
DIGEST_SQL = f"""{FLOOR}, {PAIR}, {LAT_CTES}
SELECT f.night, f.night || ' ' || w.evidence_class || ' AUTO floor: ' || f.floor || ' · bench-hero ' ||
  CASE w.restore WHEN 'RESTORED' THEN 'RESTORED ✓' WHEN 'RESTORE-FAILED' THEN 'RESTORE-FAILED ⛔'
    WHEN 'NEVER-SWAPPED-PRESENT' THEN 'PRESENT ✓ (never swapped)' ELSE 'PRESENT-UNVERIFIED (never swapped)' END ||
  ' · ON-latency ' || l.latency AS line, l.latency
FROM floors f JOIN words w USING (night) JOIN lats l USING (night)"""


@query("a6_digest", DIGEST_SQL)
def digest(t):
    return digests(t)


@query("s12_append_digest", DIGEST_SQL)
def append(t):
    """Write the digest twice; the second run adds nothing."""
    folder = scratch_path(t.spark, "digest")
    append_digest(digests(t), folder)
    append_digest(digests(t), folder)
    return t.spark.read.parquet(folder)


@query(
    "a19_suite_exit",
    f"""WITH {TRANSCRIPT} SELECT night, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 1
      WHEN count(*) FILTER (status = 'REFUSED') > 0 THEN 2 ELSE 0 END AS exit_code FROM verdicts GROUP BY night""",
)
def suite_exit(t):
    return suites.suite_exit(verdicts(t))


@query(
    "a19_night_exit",
    f"""WITH {TRANSCRIPT}, {PAIR}, {NIGHTS}, x AS (SELECT night, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 1
      WHEN count(*) FILTER (status = 'REFUSED') > 0 THEN 2 ELSE 0 END AS suite_exit FROM verdicts GROUP BY night)
    SELECT n.night, CASE WHEN restore = 'RESTORE-FAILED' THEN 3 ELSE coalesce(suite_exit, 1) END AS exit_code,
      CASE WHEN restore = 'RESTORE-FAILED' THEN 'restore-failed' WHEN suite_exit IS NULL THEN 'pre-suite-crash' ELSE 'normal' END AS exit_path
    FROM nights n JOIN words USING (night) LEFT JOIN x USING (night)""",
)
def night_exit(t):
    codes = suites.suite_exit(verdicts(t)).withColumnRenamed("exit_code", "suite_exit")
    nights = presence(t).join(codes, "night", "left").withColumn("signal", F.lit(None).cast("string"))
    return suites.night_exit(nights).select("night", "exit_code", "exit_path")


@query(
    "a11_verdict_envelope",
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS click,
      count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error
    FROM events GROUP BY user_id""",
)
def verdict_envelope(t):
    return suites.verdict_envelope(t.events, ["user_id"], ["click", "purchase", "error"])


@query(
    "a18_suite_preflight",
    """SELECT c_nationkey AS suite, c_custkey AS pos, c_mktsegment AS scenario,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'OPERATOR tier in the auto suite' WHEN 'FURNITURE' THEN 'bad file'
        WHEN 'HOUSEHOLD' THEN 'unknown scenario' END AS reason,
      CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'RUN' ELSE 'REFUSED' END AS plan FROM customer""",
)
def suite_preflight(t):
    suite = t.customer.select(
        F.col("c_nationkey").alias("suite"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("scenario")
    )
    known = t.rows(
        "scenario STRING, tier STRING, load_error STRING",
        ("BUILDING", "AUTO", None), ("AUTOMOBILE", "AUTO", None), ("MACHINERY", "OPERATOR", None),
        ("FURNITURE", "AUTO", "bad file"),
    )
    return suites.suite_preflight(suite, known).select("suite", "pos", "scenario", "reason", "plan")


@query(
    "j6_capability_gate",
    """WITH need AS (
      SELECT c_custkey AS scenario, 0 AS pos, c_mktsegment AS capability FROM customer
      UNION ALL SELECT c_custkey, 1, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    caps AS (SELECT n_name AS capability, n_regionkey < 3 AS available, CASE WHEN n_regionkey = 3 THEN 'offline' END AS reason FROM nation)
    SELECT scenario, pos, need.capability, coalesce(reason, 'capability ' || need.capability || ' not declared available') AS reason
    FROM need LEFT JOIN caps ON need.capability = caps.capability WHERE NOT coalesce(available, false)""",
)
def capability_gate(t):
    nations = t.nation
    scenarios = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("scenario"), F.array("c_mktsegment", "n_name").alias("requires")
    )
    capabilities = nations.select(
        F.col("n_name").alias("capability"), (F.col("n_regionkey") < 3).alias("available"),
        F.when(F.col("n_regionkey") == 3, "offline").alias("reason"),
    )
    return suites.capability_gate(scenarios, capabilities)


@query(
    "j21_missing_nights",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
    span AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY user_id),
    cal AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT cal.user_id, strftime(cal.day, '%Y-%m-%d') AS night FROM cal
    WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = cal.user_id AND d.day = cal.day)""",
)
def missing_nights(t):
    days = t.events.select("user_id", F.to_date("ts").alias("night")).distinct()
    missing = suites.missing_nights(suites.calendar_of(days, ["user_id"], "night"), days, ["user_id", "night"])
    return missing.select("user_id", F.date_format("night", "yyyy-MM-dd").alias("night"))


@query(
    "j22_failure_evidence",
    f"""WITH {TRANSCRIPT}, e AS (SELECT conv_id AS night, count(*) AS reads, max(turn) AS last_read FROM conversations
      WHERE role = 'assistant' GROUP BY 1)
    SELECT v.night, v.scenario, v.bundle, reads, last_read FROM verdicts v JOIN e ON e.night = v.night
    WHERE v.status = 'FAIL' AND v.bundle IS NOT NULL""",
)
def failure_evidence(t):
    reads = t.conversations.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("night"), F.col("turn").alias("read_seq")
    )
    return suites.failure_evidence(verdicts(t), reads).select("night", "scenario", "bundle", "reads", "last_read")


@query(
    "s10_read_event_store",
    "SELECT event_id AS global_position, event_type, epoch_us(ts) AS ingest_us FROM events WHERE event_type IN ('click', 'purchase')",
)
def read_event_store(t):
    rows = fleet.command_events(t.events, ["click", "purchase"])
    return rows.select(F.col("event_id").alias("global_position"), "event_type", F.unix_micros("ts").alias("ingest_us"))


@query(
    "t1_latest_events",
    """SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') ORDER BY event_id DESC LIMIT 30""",
)
def latest_events(t):
    return fleet.latest_events(t.events, 30, "event_id", ["click", "purchase"]).select("event_id", "event_type")


@query(
    "t2_ordered_suite",
    """SELECT c_custkey AS suite, 0 AS pos, c_mktsegment AS scenario FROM customer
    UNION ALL SELECT c_custkey, 1, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def ordered_suite(t):
    lists = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("suite"), F.array("c_mktsegment", "n_name").alias("legs")
    )
    return fleet.ordered_suite(lists)


@query("t2_whole_suite", "SELECT DISTINCT p_name AS scenario FROM part WHERE p_type <> 'ECONOMY' ORDER BY 1")
def whole_suite(t):
    names = F.when(F.col("p_type") == "ECONOMY", "constants").otherwise(F.col("p_name"))
    return fleet.whole_suite(t.part.select(names.alias("scenario")))


@query(
    "s11_evidence_records",
    """WITH s AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    m AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    j AS (SELECT o_orderkey AS run_id, coalesce(s.n, 0) AS log_lines, coalesce(c.n, 0) AS api_reads, coalesce(m.n, 0) AS markers
      FROM orders o LEFT JOIN s ON s.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey LEFT JOIN m ON m.k = o_orderkey)
    SELECT *, concat_ws(',', CASE WHEN log_lines = 0 THEN 'log_lines' END, CASE WHEN api_reads = 0 THEN 'api_reads' END,
      CASE WHEN markers = 0 THEN 'markers' END) AS absent FROM j""",
)
def evidence(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_returnflag", "l_linestatus")
    return evidence_records(
        t.orders.select(F.col("o_orderkey").alias("run_id")),
        rows.where(F.col("l_returnflag") != "R"),
        rows.where(F.col("l_returnflag") == "R"),
        rows.where(F.col("l_linestatus") == "F"),
    )


@query(
    "x13_verdict_line",
    f"""WITH {TRANSCRIPT} SELECT night, idx, '[' || CASE status WHEN 'SKIPPED' THEN 'SKIP' WHEN 'DEFERRED' THEN 'DEFER' ELSE status END
      || '] ' || scenario || CASE WHEN reason <> '' THEN ' — ' || reason ELSE '' END AS line FROM verdicts""",
)
def verdict_lines(t):
    return verdicts(t).select(
        "night", "idx", verdict_line(F.col("status"), F.col("scenario"), F.col("reason")).alias("line")
    )


@query(
    "p1_labeled_tuples",
    """WITH m AS (SELECT l_orderkey AS k, min(l_linenumber) AS first_idx, max(l_linenumber) AS last_idx, count(*) AS matched
        FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
      x AS (SELECT l_orderkey AS k, max(CAST(round(l_tax * 100) AS BIGINT)) AS latency_us FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS run_id, o_orderpriority AS scenario, o_orderstatus AS status, first_idx, last_idx,
      coalesce(matched, 0) AS matched, latency_us
    FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN x ON x.k = o_orderkey""",
)
def labeled_tuples(t):
    verdict_rows = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("status")
    )
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx"), "l_returnflag",
        F.round(F.col("l_tax") * 100).cast("bigint").alias("latency_us"),
    )
    return fleet.labeled_tuples(verdict_rows, rows.where(F.col("l_returnflag") == "A"), rows)
