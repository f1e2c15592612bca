"""Sensor queries: W1–W5, W7, A13, A15, A21, J11."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators import sensors
from fleetwitness.plans.registry import query
from fleetwitness.plans.standins import HOUR_US, RADIO, k_of, radio_stream

TWIN_GAP_S = 3600.0

LAGGED = f"""WITH {RADIO},
lagged AS (
  SELECT *, lag(value) OVER w AS pv, lag(tsn) OVER w AS pt, lag(us) OVER w AS pu
  FROM radio WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id)),
flagged AS (
  SELECT *, coalesce(pv = value AND (tsn - pt + 256) % 256 = 1 AND us - pu <= {HOUR_US}, false) AS is_twin FROM lagged),
kept AS (SELECT device_id, event_id, ts, us, tsn, value FROM flagged WHERE NOT is_twin)"""

EDGES = f"""{LAGGED},
changes AS (SELECT *, lag(value) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS before FROM kept),
edges AS (SELECT device_id, event_id, ts, us, tsn, value FROM changes WHERE before IS DISTINCT FROM value)"""

INTERVALS = f"""{EDGES},
ends AS (SELECT *, lead(us) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS end_us FROM edges),
intervals AS (SELECT device_id, event_id, us, end_us, end_us - us AS duration_us FROM ends WHERE value = 1)"""


def kept(t):
    return sensors.drop_twins(radio_stream(t), TWIN_GAP_S)


@query("w1_drop_twins", f"{LAGGED} SELECT device_id, event_id, us, tsn, value FROM kept")
def drop_twins(t):
    return kept(t).frame().select("device_id", "event_id", micros(F.col("ts")).alias("us"), "tsn", "value")


@query("w2_edges", f"{EDGES} SELECT device_id, event_id, us, value FROM edges")
def edges(t):
    return sensors.edges(kept(t)).frame().select("device_id", "event_id", micros(F.col("ts")).alias("us"), "value")


@query("w3_occupied_intervals", f"{INTERVALS} SELECT * FROM intervals")
def occupied_intervals(t):
    out = sensors.occupied_intervals(sensors.edges(kept(t)))
    return out.select(
        "device_id", "event_id", micros(F.col("ts")).alias("us"), micros(F.col("end_ts")).alias("end_us"), "duration_us"
    )


@query(
    "w4_silent_retriggers",
    f"""{INTERVALS}
    SELECT device_id, event_id, duration_us,
      CASE WHEN duration_us / {6 * HOUR_US} >= 1.8 THEN 'silent'
           WHEN duration_us / {6 * HOUR_US} > 1.02 THEN 'extended' ELSE 'clean' END AS kind,
      CAST(greatest(floor(duration_us / {6 * HOUR_US} + 0.5) - 1, 0) AS BIGINT) AS extensions
    FROM intervals WHERE duration_us IS NOT NULL""",
)
def silent_retriggers(t):
    intervals = sensors.occupied_intervals(sensors.edges(kept(t)))
    return sensors.silent_retriggers(intervals, base_s=6 * 3600.0).select(
        "device_id", "event_id", "duration_us", "kind", "extensions"
    )


@query(
    "w5_sequence_gaps",
    f"""{LAGGED} SELECT device_id, event_id, pt AS prev_tsn, tsn, CAST((tsn - pt + 256) % 256 - 1 AS BIGINT) AS missing
    FROM flagged WHERE (tsn - pt + 256) % 256 > 1""",
)
def sequence_gaps(t):
    return sensors.sequence_gaps(radio_stream(t)).select("device_id", "event_id", "prev_tsn", "tsn", "missing")


@query(
    "w7_settled_values",
    f"""WITH {RADIO},
    gaps AS (SELECT *, us - lag(us) OVER w AS gap FROM radio WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id)),
    islands AS (
      SELECT *, sum(CASE WHEN gap IS NULL OR gap > {12 * HOUR_US} THEN 1 ELSE 0 END)
        OVER (PARTITION BY device_id ORDER BY ts, event_id) AS burst FROM gaps)
    SELECT device_id, CAST(burst AS BIGINT) AS burst, max_by(value, us) AS settled, min(us) AS first_us,
      max(us) AS settled_us, count(*) AS n FROM islands GROUP BY device_id, burst""",
)
def settled_values(t):
    out = sensors.settled_values(radio_stream(t), quiet_s=12 * 3600.0)
    return out.select(
        "device_id", "burst", "settled", micros(F.col("first_ts")).alias("first_us"),
        micros(F.col("settled_ts")).alias("settled_us"), "n",
    )


@query(
    "a13_report_cadence",
    f"""WITH {RADIO},
    gaps AS (SELECT device_id, us - lag(us) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS gap_us FROM radio)
    SELECT device_id, count(gap_us) AS n, min(gap_us) AS min_gap_us, max(gap_us) AS max_gap_us,
      quantile_cont(gap_us, 0.5) AS median_gap_us FROM gaps WHERE gap_us IS NOT NULL GROUP BY device_id""",
)
def report_cadence(t):
    return sensors.report_cadence(radio_stream(t)).drop("cluster", "attr_name")


@query(
    "a15_duplicate_rate",
    f"""{LAGGED} SELECT device_id, count(*) AS n, count(*) FILTER (is_twin) AS twins,
    round(avg(CASE WHEN is_twin THEN 1.0 ELSE 0.0 END), 9) AS twin_share FROM flagged GROUP BY device_id""",
)
def duplicate_rate(t):
    return sensors.twin_rate(radio_stream(t), TWIN_GAP_S).withColumn("twin_share", F.round("twin_share", 9))


def detect_edges(t):
    return sensors.edges(kept(t)).frame().where(F.col("value") == 1)


@query(
    "j11_trigger_latency",
    f"""{EDGES},
    stimuli AS (
      SELECT user_id AS device_id, event_id AS stimulus_id, epoch_us(ts) AS us FROM events
      WHERE event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 20),
    found AS (
      SELECT s.device_id, s.stimulus_id, e.event_id, e.us - s.us AS wait_us
      FROM stimuli s ASOF LEFT JOIN (SELECT * FROM edges WHERE value = 1) e ON s.device_id = e.device_id AND s.us <= e.us)
    SELECT device_id, stimulus_id, CASE WHEN wait_us <= {12 * HOUR_US} THEN event_id END AS hit_id,
      CASE WHEN wait_us <= {12 * HOUR_US} THEN wait_us END AS wait_us FROM found""",
)
def trigger_latency(t):
    stimuli = t.events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("stimulus_id"), "ts",
        (k_of(F.col("props")) >= 20).alias("timed"),
    )
    out = sensors.trigger_latency(stimuli, detect_edges(t), limit_s=12 * 3600.0, edge_id="event_id")
    return out.select("device_id", "stimulus_id", "hit_id", "wait_us")


@query(
    "a21_double_runs",
    f"""{EDGES},
    detects AS (SELECT * FROM edges WHERE value = 1),
    owned AS (
      SELECT e.event_id, count(*) AS runs
      FROM (SELECT user_id AS device_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') r
      ASOF JOIN detects e ON r.device_id = e.device_id AND r.us >= e.us GROUP BY e.event_id)
    SELECT d.device_id, d.event_id, coalesce(o.runs, 0) AS runs, coalesce(o.runs, 0) > 1 AS double_run
    FROM detects d LEFT JOIN owned o ON d.event_id = o.event_id""",
)
def double_runs(t):
    runs = t.events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("run_id"), "ts"
    )
    return sensors.double_runs(detect_edges(t), runs, "event_id", "run_id")
