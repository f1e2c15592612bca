"""Sensor and command operators against recorded answers."""

import pytest
from fixtures import lamp, table, walk_events, walk_stimuli
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators import commands, sensors


@pytest.fixture(params=["plain", "hot"])
def grouping(request, spark):
    if request.param == "hot":
        spark.conf.set("spark.fleetwitness.hotGroupRows", "5")
    yield
    spark.conf.unset("spark.fleetwitness.hotGroupRows")


def test_walk_test(spark, grouping):
    flagged = sensors.mark_twins(walk_events(spark)).frame()
    assert flagged.where("is_twin").count() == 17
    kept = sensors.drop_twins(walk_events(spark))
    assert kept.frame().count() == 18
    changes = sensors.edges(kept)
    values = [r.value for r in changes.frame().collect()]
    assert (values.count(1), values.count(0)) == (9, 9)
    intervals = sensors.occupied_intervals(changes)
    closed = [r.duration_us for r in intervals.where("duration_us IS NOT NULL").orderBy("ts").collect()]
    assert closed == [63_326_000, 59_079_000, 58_929_000, 58_989_000, 65_290_000, 156_286_000, 59_011_000, 117_975_000]
    assert intervals.where("duration_us IS NULL").count() == 1
    kinds = [r.kind for r in sensors.silent_retriggers(intervals).orderBy("ts").collect()]
    assert kinds == ["extended", "clean", "clean", "clean", "extended", "silent", "clean", "silent"]
    assert sensors.sequence_gaps(walk_events(spark)).count() == 8


def test_trigger_latency(spark, grouping):
    detects = sensors.edges(sensors.drop_twins(walk_events(spark))).frame().where("value = 1")
    out = sensors.trigger_latency(walk_stimuli(spark), detects).orderBy("ts").collect()
    assert [r.wait_us for r in out] == [1_081_000, 821_000, 689_000, 803_000, 980_000, 288_000]


def test_tsn_wraps_and_zero_gap_counts(spark):
    rows = [(255, 1, "00:00:01"), (0, 1, "00:00:01"), (2, 1, "00:00:02")]
    from datetime import datetime

    ddl = "device_id STRING, cluster STRING, attr_name STRING, ts TIMESTAMP, tsn INT, value INT, n INT"
    data = [("d", "c", "a", datetime.fromisoformat(f"2026-01-01T{c}"), t, v, i) for i, (t, v, c) in enumerate(rows)]
    seq = sensors.stream_order(table(spark, ddl, data), order=["ts", "n"])
    assert [r.is_twin for r in sensors.mark_twins(seq).frame().orderBy("n").collect()] == [False, True, False]
    assert [r.missing for r in sensors.sequence_gaps(seq).collect()] == [1]


def test_command_verdicts(spark, grouping):
    cmds, reports, acks, profile = lamp(spark)
    out = {r.cmd_id: r for r in commands.confirm_commands(cmds, reports, profile, acks).collect()}
    assert {k: r.verdict for k, r in out.items()} == {
        1: "CONFIRMED", 2: "CONFIRMED", 3: "SUPERSEDED", 4: "SUPERSEDED", 5: "CONFIRMED", 6: "UNCONFIRMED",
        7: "CONFIRMED", 8: "TIMED_OUT", 9: "FAILED",
    }
    assert (out[1].latency_us, out[2].latency_us, out[5].latency_us) == (528_000, 6_658_000, 8_424_000)
    assert out[1].ack_us == 91_000
    assert out[8].no_change and out[8].rendered == "UNCONFIRMED"
    drift = commands.value_drift(cmds, reports, profile).collect()
    assert [(r.cmd_id, r.value) for r in drift] == [(7, 154.0)]


def test_a_newer_command_cuts_the_interval(spark):
    """Both targets are inside the tolerance of the report: only the newer is confirmed."""
    from fixtures import DAY, at

    cmds = table(
        spark,
        "cmd_id BIGINT, device_id STRING, attr_name STRING, capability STRING, ts TIMESTAMP, target DOUBLE",
        [(1, "d", "ct", "ct", at(DAY, "10:00:00"), 250.0), (2, "d", "ct", "ct", at(DAY, "10:00:01"), 251.0)],
    )
    reports = table(
        spark, "report_id BIGINT, device_id STRING, attr_name STRING, ts TIMESTAMP, value DOUBLE",
        [(1, "d", "ct", at(DAY, "10:00:05"), 251.0)],
    )
    profile = table(
        spark,
        "capability STRING, mode STRING, tolerance DOUBLE, unit STRING, confirmability STRING, timeout_ms BIGINT",
        [("ct", "TOLERANCE", 50.0, "kelvin", "CONFIRMABLE", 15000)],
    )
    out = commands.confirm_commands(cmds, reports, profile).orderBy("cmd_id").collect()
    assert [r.verdict for r in out] == ["SUPERSEDED", "CONFIRMED"]


def test_a_transient_confirms_nothing_and_an_unknown_capability_is_refused(spark):
    from fixtures import DAY, at

    cmds = table(
        spark, "cmd_id BIGINT, device_id STRING, attr_name STRING, capability STRING, ts TIMESTAMP, target DOUBLE",
        [(1, "d", "level", "level", at(DAY, "10:00:00"), 50.0), (2, "e", "level", "level", at(DAY, "10:00:00"), 50.0),
         (3, "f", "level", "other", at(DAY, "10:00:00"), 50.0)],
    )
    reports = table(
        spark, "report_id BIGINT, device_id STRING, attr_name STRING, ts TIMESTAMP, value DOUBLE",
        [(1, "d", "level", at(DAY, "10:00:01"), 49.0), (2, "d", "level", at(DAY, "10:00:02"), 128.0),
         (3, "e", "level", at(DAY, "10:00:01"), 20.0), (4, "e", "level", at(DAY, "10:00:02"), 49.0), (5, "f", "level", at(DAY, "10:00:01"), 50.0)],
    )
    profile = table(
        spark, "capability STRING, mode STRING, tolerance DOUBLE, unit STRING, confirmability STRING, timeout_ms BIGINT",
        [("level", "TOLERANCE", 2.0, "raw", "CONFIRMABLE", 15000)],
    )
    out = commands.confirm_commands(cmds, reports, profile, quiet_s=3).orderBy("cmd_id").collect()
    assert [(r.verdict, r.confirmed_by) for r in out] == [("TIMED_OUT", None), ("CONFIRMED", 4), ("REFUSED", None)]


def test_false_confirms(spark):
    cmds, reports, _, profile = lamp(spark)
    claims = cmds.withColumn("verdict", F.lit("CONFIRMED"))
    found = {r.cmd_id for r in commands.false_confirms(claims, cmds, reports, profile).collect()}
    assert found == {3, 4, 6, 8, 9}


def test_settled_level(spark):
    from fixtures import DAY, at

    rows = [("lamp", "c", "level", at(DAY, c), n, v) for n, (c, v) in enumerate(
        [("20:04:15.416", 22), ("20:04:16.424", 36), ("20:04:26.542", 13), ("20:04:27.553", 36)])]
    df = table(spark, "device_id STRING, cluster STRING, attr_name STRING, ts TIMESTAMP, tsn INT, value INT", rows)
    out = sensors.settled_values(df, quiet_s=3).orderBy("burst").collect()
    assert [(r.settled, r.n) for r in out] == [(36, 2), (36, 2)]


@pytest.mark.parametrize("limit", [None, 5])
def test_quantiles(spark, limit):
    import numpy as np

    if limit:
        spark.conf.set("spark.fleetwitness.hotGroupRows", str(limit))
    values = [(k, int(v)) for k in ("a", "b") for v in np.random.default_rng(len(k)).integers(0, 50, 41)]
    out = sensors.exact_quantiles(table(spark, "k STRING, v BIGINT", values), ["k"], "v", {"p50": 0.5, "p95": 0.95})
    spark.conf.unset("spark.fleetwitness.hotGroupRows")
    for r in out.collect():
        mine = [v for k, v in values if k == r.k]
        assert (r.n, r.min_v, r.max_v) == (41, min(mine), max(mine))
        assert r.p50 == pytest.approx(np.quantile(mine, 0.5)) and r.p95 == pytest.approx(np.quantile(mine, 0.95))


def test_first_after_matches_brute_force(spark, grouping):
    import random

    from fixtures import DAY, at

    rng = random.Random(3)
    left = [(f"d{rng.randrange(2)}", i, at(DAY, f"10:{rng.randrange(60):02d}:00")) for i in range(40)]
    right = [(f"d{rng.randrange(2)}", i, at(DAY, f"10:{rng.randrange(60):02d}:00")) for i in range(25)]
    a = table(spark, "device_id STRING, l BIGINT, ts TIMESTAMP", left)
    b = table(spark, "device_id STRING, r BIGINT, ts TIMESTAMP", right)
    got = {r.l: r.hit_id for r in sensors.first_after(a, b, ["device_id"], "l", "r").collect()}
    want = {
        i: min(((t2, j) for d2, j, t2 in right if d2 == d and t2 >= t), default=(None, None))[1] for d, i, t in left
    }
    assert got == want
    assert micros is not None
