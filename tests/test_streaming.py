"""Streams over several micro-batches, out of order, agree with their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from fixtures import EXPECTATION, table, walk_events
from pyspark.sql import functions as F

from fleetwitness.operators import adjudicate as judge
from fleetwitness.operators import commands, sensors
from fleetwitness.operators.liveness import read_states
from fleetwitness.plans import ORACLES
from fleetwitness.plans import log_queries as q
from fleetwitness.plans import standins as s
from fleetwitness.plans.registry import Tables
from fleetwitness.plans.stream_queries import KEYS
from fleetwitness.streaming import live
from fleetwitness.streaming.drain import read_stream, run_to_table
from fleetwitness.streaming.keyed import RunClock

SF = "/root/testdata/sf0.001"
START = datetime(2026, 7, 31)


def in_files(spark, df, folder, n, late_s=0.0, seed=1):
    """Write rows as ``n`` files by arrival (the time and up to ``late_s``); the stream takes one per batch."""
    rng = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: (r["ts"] + timedelta(seconds=rng.random() * late_s), rng.random()))
    step = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * step : (i + 1) * step]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return read_stream(spark, str(folder), df.schema, maxFilesPerTrigger=1)


def clock_row(df, **values):
    """A last row far behind all others, which moves the watermark past them."""
    spark = df.sparkSession
    return df.unionByName(spark.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema))


@pytest.mark.parametrize("late_s", [0.0, 500.0])
def test_twins_over_batches(spark, tmp_path, late_s):
    rows = clock_row(walk_events(spark), device_id="clock", ts=datetime(2026, 8, 1), tsn=1, value=1)
    stream = in_files(spark, rows, tmp_path / "in", 5, late_s)
    keys, order = ["device_id", "cluster", "attr_name"], ["ts", "tsn"]
    got = run_to_table(live.stream_drop_twins(stream, keys, order, 1.0, "10 minutes"), "twins", str(tmp_path / "out"))
    want = sensors.drop_twins(walk_events(spark)).frame()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select(*got.columns).collect())


def test_late_twins_are_not_judged(spark, tmp_path):
    rows = walk_events(spark).collect()
    schema = walk_events(spark).schema
    end = ("clock", "c", "a", datetime(2026, 8, 1), 1, 1)
    for part in ([*rows[:20], end], rows[20:], [end]):
        spark.createDataFrame([tuple(r) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), schema, maxFilesPerTrigger=1)
    got = run_to_table(live.stream_drop_twins(stream, ["device_id", "cluster", "attr_name"], ["ts", "tsn"], 1.0, "1 minute"), "twins", str(tmp_path / "out"))
    want = sensors.drop_twins(spark.createDataFrame(rows[:20], schema)).frame()
    assert sorted(r.tsn for r in got.collect()) == sorted(r.tsn for r in want.collect())


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Ended between two files and started again on its checkpoint: nothing twice, nothing missing."""
    rows = clock_row(walk_events(spark), device_id="clock", ts=datetime(2026, 8, 1), tsn=1, value=1)
    keys, order = ["device_id", "cluster", "attr_name"], ["ts", "tsn"]
    parts = [rows.where("tsn < 60 AND device_id = 'pir'"), rows.where("tsn >= 60 OR device_id = 'clock'")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = read_stream(spark, str(tmp_path / "in"), rows.schema, maxFilesPerTrigger=1)
        got = run_to_table(live.stream_drop_twins(stream, keys, order, 1.0, "10 minutes"), "twins", str(tmp_path / "out"))
    want = sensors.drop_twins(walk_events(spark)).frame()
    assert sorted(r.tsn for r in got.collect()) == sorted(r.tsn for r in want.collect())


@pytest.fixture(scope="module")
def command_files(spark, tmp_path_factory):
    """Commands and reports in five files each, up to forty minutes out of order."""
    t, folder = Tables(spark, SF), tmp_path_factory.mktemp("commands")
    cmds, reports = s.commands(t), s.reports(t)
    end = cmds.agg(F.max("ts")).first()[0] + timedelta(days=9)
    one = clock_row(cmds, cmd_id=-1, device_id=-1, ts=end, attr_name="clock", cluster="c", capability="on_off", target=0.0)
    two = clock_row(reports, report_id=-1, device_id=-1, ts=end, attr_name="clock", cluster="c", value=0.0)
    streams = in_files(spark, one, folder / "a", 5, 2400), in_files(spark, two, folder / "b", 5, 2400, 2)
    return t, cmds, reports, streams


def test_confirmation_over_batches(command_files, tmp_path):
    t, cmds, reports, streams = command_files
    got = run_to_table(live.stream_confirm(*streams, s.profile(t), KEYS, "1 hour"), "confirm", str(tmp_path / "out"))
    want = commands.confirm_commands(cmds, reports, s.profile(t))
    names = ["cmd_id", "verdict", "latency_us", "confirmed_by"]
    assert sorted(tuple(r) for r in got.select(names).collect() if r.cmd_id >= 0) == sorted(tuple(r) for r in want.select(names).collect())


def test_late_reports_over_batches(command_files, tmp_path):
    t, cmds, reports, streams = command_files
    got = run_to_table(live.late_reports(*streams, s.profile(t), KEYS, "1 hour"), "late", str(tmp_path / "out"))
    owned = commands.owned_reports(commands.command_timeline(cmds, reports))
    want = owned.join(s.profile(t), "capability").select("cmd_id", "report_id", "after_us", (F.col("after_us") > F.col("timeout_ms") * 1000).alias("late"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_outcomes_over_batches(command_files, tmp_path):
    t, cmds, reports, streams = command_files
    got = run_to_table(live.command_outcomes(*streams, s.profile(t), KEYS, "24 hours", "1 hour"), "outcomes", str(tmp_path / "out"))
    owned = commands.owned_reports(commands.command_timeline(cmds, reports)).where(F.col("after_us") <= 24 * 3600 * 1_000_000)
    first = {r.cmd_id: (r.n, r.first) for r in owned.groupBy("cmd_id").agg(F.count("*").alias("n"), F.min("after_us").alias("first")).collect()}
    want = []
    for r in cmds.join(s.profile(t), "capability").collect():
        n, at = first.get(r.cmd_id, (0, None))
        want.append((r.cmd_id, "no_edge" if not n else "late" if at > r.timeout_ms * 1000 else "in_time", n, at))
    assert sorted(tuple(r) for r in got.collect() if r.cmd_id >= 0) == sorted(want)
    assert {w[1] for w in want} == {"no_edge", "late", "in_time"}


def test_a_report_of_the_older_command_in_the_next_file(spark, tmp_path):
    profile = table(
        spark, "capability STRING, mode STRING, tolerance DOUBLE, unit STRING, confirmability STRING, timeout_ms BIGINT",
        [("level", "EXACT", 0.0, "raw", "CONFIRMABLE", 5000)],
    )
    cmd_ddl, report_ddl = "cmd_id BIGINT, device_id STRING, attr_name STRING, ts TIMESTAMP, capability STRING, target DOUBLE", "report_id BIGINT, device_id STRING, attr_name STRING, ts TIMESTAMP, value DOUBLE"
    at = lambda n: START + timedelta(seconds=n)
    cmds = table(spark, cmd_ddl, [(1, "d", "level", at(0), "level", 1.0), (2, "d", "level", at(20), "level", 1.0), (9, "x", "level", at(5000), "level", 1.0)])
    reports = [table(spark, report_ddl, [(k, "d", "level", at(n), 1.0) for k, n in part]) for part in ([(10, 8), (11, 30)], [(12, 900)], [(13, 4000)])]
    for n, part in enumerate(reports):
        (cmds if n == 0 else cmds.limit(0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    streams = [read_stream(spark, str(tmp_path / k), f.schema, maxFilesPerTrigger=1) for k, f in (("c", cmds), ("r", reports[0]))]
    got = run_to_table(live.late_reports(*streams, profile, KEYS, "1 hour"), "late", str(tmp_path / "out"))
    assert {r.report_id: (r.cmd_id, r.late) for r in got.collect()} == {10: (1, True), 11: (2, True)}


VERDICT = ["run_id", "status", "reason", "failed_i", "forbidden_idx", "decided_after_us"]


def test_verdicts_over_batches(spark, tmp_path):
    """Log, API and forbidden lines, one with an anchor, in five files out of order, like batch."""
    t = Tables(spark, SF)
    runs, catalogue, lines, reads = q.mixed_parts(t)
    forbidden = t.rows("scenario STRING, j INT, token STRING, after_token STRING", *[(k, j, *f) for k in ("weekday", "weekend") for j, f in enumerate([("error:", "signup:"), ('"k": 13}', None)])])
    own = lines.join(runs, "run_id").select("run_id", "scenario", "t0", F.col("observed_at").alias("ts"), "idx", "text")
    polls = read_states(reads, runs, catalogue).join(runs.select("run_id", "t0"), "run_id").select("run_id", "scenario", "t0", F.col("observed_at").alias("ts"), "poll_seq", "i", "state")
    end = own.agg(F.max("ts")).first()[0] + timedelta(days=9)
    stream = in_files(spark, clock_row(own, run_id="clock", scenario="weekday", t0=end, ts=end, idx=-1, text=""), tmp_path / "a", 5, 3000)
    polled = in_files(spark, clock_row(polls, run_id="clock", scenario="weekday", t0=end, ts=end, poll_seq=-1, i=1, state="pending"), tmp_path / "b", 5, 3000, 2)
    got = run_to_table(live.stream_verdicts(stream, catalogue, "1 hour", forbidden, polled), "verdicts", str(tmp_path / "out"))
    want = judge.adjudicate(runs, catalogue, forbidden, lines, reads=reads)
    a, b = ({r.run_id: tuple(r) for r in df.select(VERDICT).collect()} for df in (got, want))
    assert got.count() == len(a) == len(b) and a == b
    assert {r[2].split(":")[0] for r in a.values()} >= {"forbidden hit", "expected-not-seen"}
    passed = {r.run_id: r.last_idx for r in got.collect() if r.forbidden_idx is None}
    assert passed == {r.run_id: r.last_idx for r in want.collect() if r.run_id in passed}


def expected(spark, *rows):
    return table(spark, EXPECTATION, rows)


LINES = "run_id STRING, scenario STRING, t0 TIMESTAMP, ts TIMESTAMP, idx BIGINT, text STRING"


def test_deadlines_over_batches(spark, tmp_path):
    """One run decides on a number, another misses its second line, a third is a second late."""
    texts = {"ok": ["n=1", "n=9", "n=2", "x", "done"], "miss": ["n=7", "x", "x", "x", "x"], "slow": ["n=1", "n=2", "x", "x", "n=9"], "mute": []}
    rows = [(run, "s", START, START + timedelta(seconds=n), n, text) for run, lines in texts.items() for n, text in enumerate(lines)]
    rows += [("mute", "s", START, START, -1, None), ("none", "other", START, START, 0, "done"), ("clock", "s", START, START + timedelta(hours=1), 99, "")]
    catalogue = expected(spark, ("s", 0, ["n="], [], 1, r"n=(\d+)", 5, 3), ("s", 1, ["done"], [], 1, None, None, 3))
    stream = in_files(spark, table(spark, LINES, rows), tmp_path / "in", 4)
    out = run_to_table(live.stream_verdicts(stream, catalogue, "10 seconds"), "deadlines", str(tmp_path / "out"))
    got = {r.run_id: (r.status, r.failed_i, r.last_idx, r.decided_after_us) for r in out.collect()}
    assert got == {"ok": ("PASS", None, 4, 4_000_000), "miss": ("FAIL", 1, 0, 3_000_000), "slow": ("FAIL", 0, None, 3_000_000), "mute": ("FAIL", 0, None, 3_000_000)}


def test_a_decided_run_is_not_opened_again(spark, tmp_path):
    at = lambda n: START + timedelta(seconds=n)
    files = [[("r", 1, "up"), ("r", 2, "x"), ("clock", 900, "")], [("r", 1000, "up"), ("clock", 2000, "")], [("r", 2100, "bad"), ("clock", 9000, "")]]
    for part in files:
        table(spark, LINES, [(r, "s", START, at(n), n, text) for r, n, text in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), table(spark, LINES, []).schema, maxFilesPerTrigger=1)
    catalogue = expected(spark, ("s", 0, ["up"], [], 1, None, None, 60))
    out = run_to_table(live.stream_verdicts(stream, catalogue, "5 minutes", keep="1 day"), "again", str(tmp_path / "out"))
    assert [(r.run_id, r.status) for r in out.collect() if r.run_id == "r"] == [("r", "PASS")]


def test_the_clock_of_a_run():
    """The verdict is the same wherever the rows are cut, and no later than needed."""
    plan = {"lines": [{"i": 0, "need": 2, "within_s": 5, "kind": "log"}, {"i": 1, "need": 1, "within_s": 5, "kind": "api"}], "forbidden": [{"j": 0, "token": "bad", "anchors": [0]}, {"j": 1, "token": "never", "anchors": []}]}
    clock = RunClock(plan, 0)
    clock.line(1_000_000, 1, [(0, True)], [0])
    assert clock.verdict(1_000_000) == (None, 5_000_000)
    clock.line(3_000_000, 2, [(0, True)], [0, 1])
    clock = RunClock.load(clock.dump())
    assert clock.verdict(3_000_000) == (None, 8_000_000)
    late = RunClock.load(clock.dump())
    clock.read(4_000_000, 1, "pending")
    clock.read(6_000_000, 1, "ok")
    clock.read(7_000_000, 1, "fail")
    done, _ = clock.verdict(6_000_000)
    assert (done["status"], done["reason"], done["last_idx"], done["decided_after_us"]) == ("PASS", "2/2 positive · 0 forbidden", 2, 6_000_000)
    late.line(5_000_000, 3, [], [0])
    done, _ = late.verdict(5_000_000)
    assert (done["reason"], done["forbidden_idx"], done["decided_after_us"]) == ("forbidden hit: bad", 3, 5_000_000)
    wrong = RunClock(plan, 0)
    wrong.line(1, 1, [(0, True)], [])
    wrong.line(2, 2, [(0, True)], [])
    wrong.read(9, 1, "fail")
    assert wrong.verdict(9)[0]["failed_i"] == 1 and wrong.verdict(9)[0]["decided_after_us"] == 9
    assert RunClock(plan, 0).verdict(5_000_000)[0]["reason"] == "expected-not-seen: line 0"


def test_only_anchored_lines_are_forbidden(spark, tmp_path):
    """The anchor comes in the same stream, and in a later file than what stands below it."""
    at = lambda n: START + timedelta(seconds=n)
    files = [[("r", 0, "bad"), ("q", 5, "bad")], [("r", 30, "bad"), ("r", 10, "up")], [("r", 20, "bad, up"), ("q", 40, "worse"), ("clock", 9000, "")]]
    rows = [[(run, "s", at(n), n, text) for run, n, text in part] for part in files]
    ddl = "run_id STRING, scenario STRING, ts TIMESTAMP, idx BIGINT, text STRING"
    for part in rows:
        table(spark, ddl, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), table(spark, ddl, []).schema, maxFilesPerTrigger=1)
    rules = table(spark, "scenario STRING, j INT, token STRING, after_token STRING", [("s", 0, "bad", "up"), ("s", 1, "worse", None)])
    catalogue = expected(spark, ("s", 0, ["up"], [], 1, None, None, 60))
    hits = run_to_table(live.stream_anchored(stream, catalogue, rules, "1 minute"), "r2", str(tmp_path / "a"))
    assert sorted((r.run_id, r.j, r.idx) for r in hits.collect()) == [("r", 0, 20), ("r", 0, 30)]
    runs = table(spark, "run_id STRING, scenario STRING", [("r", "s"), ("q", "s")])
    first = run_to_table(live.stream_forbidden(stream.drop("scenario"), runs, rules), "r2", str(tmp_path / "b"))
    assert [(r.run_id, r.j, r.idx, r.token) for r in first.collect()] == [("q", 1, 40, "worse")]


def test_a_night_given_twice_is_written_once(spark, tmp_path):
    from fleetwitness.sources.sinks import append_digest

    lines = table(spark, "night STRING, line STRING, latency STRING", [("n1", "b", "x"), ("n1", "a", None), ("n2", "c", "y")])
    append_digest(lines, str(tmp_path / "d"))
    assert sorted((r.night, r.line) for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [("n1", "a"), ("n2", "c")]


def test_digest_is_appended_once(spark, tmp_path):
    from fleetwitness.sources.sinks import append_digest

    lines = table(spark, "night STRING, line STRING, latency STRING", [("n1", "a", "x"), ("n2", "b", "y")])
    folder = str(tmp_path / "digest")
    append_digest(lines.where("night = 'n1'"), folder)
    append_digest(lines, folder)
    assert sorted(r.night for r in spark.read.parquet(folder).collect()) == ["n1", "n2"]
    assert "r9_stream_digest" in ORACLES
