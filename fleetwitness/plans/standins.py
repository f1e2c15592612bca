"""The driver's tables in the shapes of the bench (no device data there).

Every function keeps all rows of its table; the SQL text beside it builds the same
rows for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators.ordered import Ordered, ordered, row_index, running_sum
from fleetwitness.plans.registry import Tables
from fleetwitness.sources.logs import split_text

HOUR_US = 3_600_000_000
BASE_TS = "2024-01-01 00:00:00"


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


# Sensor stream: a user is a device; click and view read as detect, the rest as clear.
RADIO = """radio AS (
  SELECT user_id AS device_id, event_id, ts, epoch_us(ts) AS us, event_id % 256 AS tsn,
         CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS value
  FROM events)"""



def radio(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("device_id"),
        F.lit("0x0406").alias("cluster"),
        F.lit("occupancy").alias("attr_name"),
        "ts",
        "event_id",
        F.pmod(F.col("event_id"), F.lit(256)).alias("tsn"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("value"),
    )


def radio_stream(t: Tables) -> Ordered:
    return ordered(radio(t), ["device_id", "cluster", "attr_name"], ["ts", "event_id"])


# Commands: click commands a level, view acknowledges, purchase reports a level.
CAPABILITY = "CASE WHEN k < 50 THEN 'brightness' WHEN k < 85 THEN 'on_off' ELSE 'effect' END"
COMMAND_TABLES = f"""ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
cmds AS (
  SELECT event_id AS cmd_id, user_id AS device_id, us, {CAPABILITY} AS capability, floor(value / 50) AS target
  FROM ev WHERE event_type = 'click'),
acks AS (
  SELECT event_id AS ack_id, user_id AS device_id, us, CASE WHEN k < 95 THEN 'SUCCESS' ELSE 'FAILURE' END AS status
  FROM ev WHERE event_type = 'view'),
reports AS (
  SELECT event_id AS report_id, user_id AS device_id, us, floor(value / 50) AS value
  FROM ev WHERE event_type = 'purchase'),
profile(capability, mode, tolerance, confirmability, timeout_ms) AS (VALUES
  ('brightness', 'TOLERANCE', 1.0, 'CONFIRMABLE', CAST(21600000 AS BIGINT)),
  ('on_off', 'EXACT_MATCH', 0.0, 'CONFIRMABLE', 43200000),
  ('effect', 'DISABLED', 0.0, 'UNCONFIRMABLE', 21600000))"""


def commands(t: Tables) -> DataFrame:
    k = k_of(F.col("props"))
    capability = F.when(k < 50, "brightness").when(k < 85, "on_off").otherwise("effect")
    return t.events.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("cmd_id"),
        F.col("user_id").alias("device_id"),
        F.lit("0x0008").alias("cluster"),
        F.lit("current_level").alias("attr_name"),
        capability.alias("capability"),
        "ts",
        F.floor(F.col("value") / 50).cast("double").alias("target"),
    )


def acks(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("ack_id"),
        F.col("user_id").alias("device_id"),
        F.lit("0x0008").alias("cluster"),
        "ts",
        F.when(k_of(F.col("props")) < 95, "SUCCESS").otherwise("FAILURE").alias("status"),
    )


def reports(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("report_id"),
        F.col("user_id").alias("device_id"),
        F.lit("0x0008").alias("cluster"),
        F.lit("current_level").alias("attr_name"),
        "ts",
        F.floor(F.col("value") / 50).cast("double").alias("value"),
    )


def profile(t: Tables) -> DataFrame:
    return t.rows(
        "capability STRING, mode STRING, tolerance DOUBLE, unit STRING, confirmability STRING, timeout_ms BIGINT",
        ("brightness", "TOLERANCE", 1.0, "raw", "CONFIRMABLE", 21_600_000),
        ("on_off", "EXACT_MATCH", 0.0, "raw", "CONFIRMABLE", 43_200_000),
        ("effect", "DISABLED", 0.0, "raw", "UNCONFIRMABLE", 21_600_000),
    )


# Text lines: a document is a run, its language the scenario, one line per second.
DOC_LINES = """pieces AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx
  FROM documents),
lines AS (
  SELECT doc_id AS run_id, lang AS scenario, idx, text,
         sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - octet_length(encode(text)) - 1 AS byte_off
  FROM pieces)"""


def doc_lines(t: Tables) -> DataFrame:
    rows = split_text(t.documents.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "run_id")
    base = F.lit(BASE_TS).cast("timestamp")
    return rows.withColumn("observed_at", F.timestamp_micros(micros(base) + F.col("idx") * 1_000_000))


def doc_runs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("run_id"), F.col("lang").alias("scenario"), F.lit(BASE_TS).cast("timestamp").alias("t0")
    )


# Three expectations per language; the last one extracts a number.
DOC_EXPECTATIONS = """langs(scenario) AS (VALUES ('en'), ('fr'), ('de'), ('es')),
exp AS (
  SELECT scenario, i, tokens, same_line, need, pattern, min_value, within_s FROM langs, (VALUES
    (0, ['the', 'le '], [], 1, NULL, NULL, 2),
    (1, ['en', 'an'], ['.'], 2, NULL, NULL, 3),
    (2, ['re', 'de'], [], 1, '([0-9]+)', 3, 20)) AS e(i, tokens, same_line, need, pattern, min_value, within_s)),
hits AS (
  SELECT l.run_id, e.i, l.idx, l.text, e.need, e.pattern, e.min_value FROM lines l JOIN exp e ON l.scenario = e.scenario
  WHERE (contains(l.text, e.tokens[1]) OR contains(l.text, e.tokens[2]))
    AND (e.i <> 1 OR contains(l.text, '.')))"""


def doc_expectations(t: Tables) -> DataFrame:
    rows = []
    for lang in ("en", "fr", "de", "es"):
        rows.append((lang, 0, ["the", "le "], [], 1, None, None, 2))
        rows.append((lang, 1, ["en", "an"], ["."], 2, None, None, 3))
        rows.append((lang, 2, ["re", "de"], [], 1, "([0-9]+)", 3, 20))
    return t.rows(
        "scenario STRING, i INT, tokens ARRAY<STRING>, same_line ARRAY<STRING>, need INT, extract STRING, "
        "min_value BIGINT, within_s INT",
        *rows,
    )


DOC_FORBIDDEN = "forb(j, token, after_token) AS (VALUES (0, '***', NULL), (1, '@', NULL), (2, 'ou', 'the'))"


def doc_forbidden(t: Tables) -> DataFrame:
    specs = [(0, "***", None), (1, "@", None), (2, "ou", "the")]
    return t.rows(
        "scenario STRING, j INT, token STRING, after_token STRING",
        *[(lang, *s) for lang in ("en", "fr", "de", "es") for s in specs],
    )


# Boot log: a user is a boot, an event one stamped line; error lines carry a four-digit
# millisecond form, which is not a stamp.
BOOT_LINES = """boot AS (
  SELECT user_id AS boot_id, event_id, ts, epoch_us(ts) AS us, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         strftime(ts, '%H:%M:%S.%g') || CASE WHEN event_type = 'error' THEN '0' ELSE '' END
           || ' [w-' || user_id || '] ' || CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END
           || ' bench.Events -- ' || event_type || ': id=' || event_id || ' k=' || json_extract_string(props, '$.k') AS text
  FROM events),
boot_log AS (
  SELECT *, CASE WHEN event_type <> 'error' THEN (us // 1000) % 86400000 END AS tod_ms,
         sum(octet_length(encode(text)) + 1) OVER (PARTITION BY boot_id ORDER BY idx) - octet_length(encode(text)) - 1 AS byte_off
  FROM boot)"""


def boot_text() -> Column:
    error = F.col("event_type") == "error"
    return F.concat(
        F.date_format("ts", "HH:mm:ss.SSS"), F.when(error, "0").otherwise(""), F.lit(" [w-"), F.col("user_id"),
        F.lit("] "), F.when(error, "WARN").otherwise("INFO"), F.lit(" bench.Events -- "), F.col("event_type"),
        F.lit(": id="), F.col("event_id"), F.lit(" k="), F.get_json_object("props", "$.k"),
    )


def boot_log(t: Tables) -> DataFrame:
    rows = t.events.withColumn("text", boot_text())
    size = F.octet_length("text") + 1
    seq = ordered(rows, ["user_id"], ["ts", "event_id"]).scan(_n=row_index(), _b=running_sum(size.cast("bigint")))
    return seq.frame().select(
        F.col("user_id").alias("boot_id"),
        "event_id",
        F.col("ts").alias("observed_at"),
        (F.col("_n") - 1).alias("idx"),
        (F.col("_b") - size).alias("byte_off"),
        "text",
        "event_type",
        "value",
        "props",
    )


# Suites: a conversation is a night; a user turn is a verdict line, an assistant turn a
# bundle line, a system turn narration.
TRANSCRIPT = """transcript AS (
  SELECT conv_id AS night, turn AS idx, role, text, length(text) AS n,
    CASE role
      WHEN 'user' THEN CASE
        WHEN length(text) < 60 THEN '[FAIL] leg-' || turn || ' — expected-not-seen: line 1'
        WHEN length(text) < 90 THEN '[SKIP] leg-' || turn || ' — SKIPPED: [plug] — down'
        WHEN length(text) < 110 THEN '[SKIP] leg-' || turn || ' — SKIPPED: [hub], [plug] — down'
        WHEN length(text) < 130 THEN '[REFUSED] leg-' || turn || ' — tier'
        WHEN length(text) < 140 THEN '[DEFER] leg-' || turn
        ELSE '[PASS] leg-' || turn END
      WHEN 'assistant' THEN '  [--] bundle: /b/' || conv_id || '-' || turn
      ELSE 'suite auto: listing' END AS line
  FROM conversations),
tags AS (
  SELECT *, regexp_extract(line, '^\\[([A-Z]+)\\] leg', 1) AS tag, regexp_extract(line, 'bundle: (.+)$', 1) AS b
  FROM transcript),
grouped AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY night ORDER BY idx) AS leg FROM tags),
verdicts AS (
  SELECT night, min(idx) FILTER (role = 'user') AS idx,
    'leg-' || min(idx) FILTER (role = 'user') AS scenario,
    CASE max(tag) WHEN 'SKIP' THEN 'SKIPPED' WHEN 'DEFER' THEN 'DEFERRED' ELSE max(tag) END AS status,
    max(CASE WHEN role = 'user' THEN CASE WHEN contains(line, ' — ') THEN substr(line, instr(line, ' — ') + 3) ELSE '' END END) AS reason,
    max_by(b, idx) FILTER (role = 'assistant') AS bundle
  FROM grouped WHERE leg > 0 AND role IN ('user', 'assistant') GROUP BY night, leg)"""


def transcript(t: Tables) -> DataFrame:
    n, leg = F.length("text"), F.concat(F.lit("leg-"), F.col("turn"))
    verdict = (
        F.when(n < 60, F.concat(F.lit("[FAIL] "), leg, F.lit(" — expected-not-seen: line 1")))
        .when(n < 90, F.concat(F.lit("[SKIP] "), leg, F.lit(" — SKIPPED: [plug] — down")))
        .when(n < 110, F.concat(F.lit("[SKIP] "), leg, F.lit(" — SKIPPED: [hub], [plug] — down")))
        .when(n < 130, F.concat(F.lit("[REFUSED] "), leg, F.lit(" — tier")))
        .when(n < 140, F.concat(F.lit("[DEFER] "), leg))
        .otherwise(F.concat(F.lit("[PASS] "), leg))
    )
    bundle = F.concat(F.lit("  [--] bundle: /b/"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    line = F.when(F.col("role") == "user", verdict).when(F.col("role") == "assistant", bundle).otherwise(
        "suite auto: listing"
    )
    return t.conversations.select(F.col("conv_id").alias("night"), F.col("turn").alias("idx"), line.alias("line"))
