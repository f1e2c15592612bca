"""Transcripts, floor, digest and latency: the texts are exact."""

import json

import pytest
from fixtures import table
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import seconds_text, verdict_line
from fleetwitness.operators import suites

# Nights of a made-up bench: a greenhouse with a valve, a fan and two probes.
TIMED = "valve-opens"
FOLDER = "/evidence/2031/valve-opens-0007"
SHORT = ["[PASS] probes-report", "[PASS] valve-opens", f"    [--] bundle: {FOLDER}", "[PASS] fan-follows"]
NIGHTS = {
    "calm": ["greenhouse bench", *SHORT, "done"],
    "one-out": ["[PASS] probes-report", "[SKIP] mist-cycle — SKIPPED: [mister] — tank empty", *SHORT[1:]],
    "two-out": ["[SKIP] mist-cycle — SKIPPED: [mister] — tank empty", "[SKIP] drain — SKIPPED: [pump], [mister] — off", "[PASS] valve-opens",
                f"  [--] bundle: {FOLDER}-old", f"  [--] bundle: {FOLDER}"],
    "stuck": ["[FAIL] valve-opens — stuck at 40 %", f"  [--] bundle: {FOLDER}", "[PASS] fan-follows"],
    "dark": ["[SKIP] valve-opens — SKIPPED: [power] — breaker", "[PASS] fan-follows"],
    "barred": ["[PASS] fan-follows", "[REFUSED] prune-roots — needs a gardener", "[PASS] probes-report"],
    "silent": ["", "Segmentation fault"],
}


@pytest.fixture
def transcript(spark):
    rows = [(n, i, line) for n, lines in NIGHTS.items() for i, line in enumerate(lines)]
    return table(spark, "night STRING, idx BIGINT, line STRING", rows)


@pytest.fixture
def verdicts(transcript):
    return suites.read_transcript(transcript)


@pytest.fixture
def calendar(spark):
    return table(spark, "night STRING", [(n,) for n in NIGHTS])


def test_floor(verdicts, calendar):
    floor = {r.night: r.floor for r in suites.floor_text(verdicts, calendar).collect()}
    assert floor["calm"] == "3/3 PASS"
    assert floor["one-out"] == "3/4 PASS · 1 SKIP(mister)"
    assert floor["stuck"] == f"1/2 · FAIL valve-opens · bundle {FOLDER}"
    assert floor["two-out"] == "1/3 PASS · 1 SKIP(mister) · 1 SKIP(pump+mister)"
    assert "REFUSED prune-roots" in floor["barred"]
    assert floor["silent"] == "no verdicts (suite output unparseable — treat as red)"


def test_coverage(verdicts):
    lines = {r.night: r.line for r in suites.coverage(verdicts).collect()}
    assert lines["calm"] == "ran 3/3"
    assert lines["one-out"] == "ran 3/4 — 1 SKIPPED: [mister]"
    assert lines["barred"] == "ran 2/3 — 1 REFUSED"


def test_the_last_bundle_below_a_verdict(verdicts):
    assert {(r.night, r.bundle) for r in verdicts.where("bundle IS NOT NULL").collect()} == {(n, FOLDER) for n in ("calm", "one-out", "two-out", "stuck")}


def test_digest_line(spark):
    row = table(spark, "n STRING", [("2031-05-14",)])
    line = lambda *parts: row.select(suites.digest(F.col("n"), *[F.lit(p) for p in parts])).first()[0]
    assert line("quiesced", "3/3 PASS", "RESTORED", "1.20s") == "2031-05-14 quiesced AUTO floor: 3/3 PASS · bench-hero RESTORED ✓ · ON-latency 1.20s"
    assert "bench-hero RESTORE-FAILED ⛔ ·" in line("quiesced", "3/3 PASS", "RESTORE-FAILED", "1.20s")
    assert "bench-hero PRESENT ✓ (never swapped) ·" in line("p", "q", "NEVER-SWAPPED-PRESENT", "r")
    assert "bench-hero unheard ·" in line("p", "q", "unheard", "r")


def body(*phases):
    return json.dumps({"data": {"lifecycle": {p: {"at": f"2031-05-14T22:{at}Z"} for p, at in phases}}})


def test_night_latency(spark, verdicts, calendar):
    ddl = "bundle STRING, idx INT, body STRING, readable BOOLEAN"
    whole = body(("DISPATCHED", "07:59.300"), ("CONFIRMED", "08:00.500"))
    captures = table(spark, ddl, [(FOLDER, 3, body(("ACCEPTED", "07:59.100")), True), (FOLDER, 4, whole[:40], True), (FOLDER, 5, whole, True)])
    out = {r.night: r.latency for r in suites.night_latency(verdicts, captures, calendar, TIMED).collect()}
    assert out == {
        "calm": "1.20s", "one-out": "1.20s", "two-out": "1.20s", "stuck": "n/a(FAIL)", "dark": "n/a(SKIP)", "barred": "n/a(no-verdict)",
        "silent": "n/a(no-verdict)",
    }
    broken = table(spark, ddl, [(FOLDER, 0, None, False)])
    out = {r.night: r.latency for r in suites.night_latency(verdicts, broken, calendar, TIMED).collect()}
    assert out["calm"] == "n/a(captures-unreadable)"


def test_exit_codes(spark, verdicts):
    codes = {r.night: r.exit_code for r in suites.suite_exit(verdicts).collect()}
    assert codes == {"calm": 0, "one-out": 0, "two-out": 0, "stuck": 1, "dark": 0, "barred": 2}
    nights = table(
        spark, "restore STRING, suite_exit INT, signal STRING",
        [("RESTORED", None, None), ("RESTORED", 137, "timeout"), ("RESTORE-FAILED", 0, None), ("RESTORED", 0, None)],
    )
    assert [(r.exit_code, r.exit_path) for r in suites.night_exit(nights).collect()] == [
        (1, "pre-suite-crash"), (137, "timeout"), (3, "restore-failed"), (0, "normal"),
    ]


def test_presence_pair(spark):
    """Nights named by what their reads say: there, away, failed, or not read."""
    reads = {
        "away-there": [("quiesce", 200, "{}"), ("restore", 200, "fern")],
        "there-away": [("quiesce", 200, "fern"), ("restore", 200, "{}")],
        "away-failed": [("quiesce", 200, ""), ("restore", 503, "fern")],
        "end-there": [("end", 200, "fern")],
        "end-failed": [("end", 503, None)],
        "none": [],
    }
    days = table(spark, "night STRING", [(n,) for n in reads])
    rows = [(night, phase, n, status, text) for night, own in reads.items() for n, (phase, status, text) in enumerate(own)]
    frame = table(spark, "night STRING, phase STRING, read_seq BIGINT, status INT, body STRING", rows)
    out = {r.night: (r.evidence_class, r.restore) for r in suites.presence_pair(days, frame, "fern").collect()}
    assert out["away-there"] == ("quiesced", "RESTORED")
    assert out["there-away"] == ("UNQUIESCED(QUIESCE-ASSERT-FAILED)", "RESTORE-FAILED")
    assert out["away-failed"] == ("QUIESCE-UNVERIFIED(read-failed)", "RESTORE-FAILED")
    assert out["end-there"] == ("QUIESCE-UNVERIFIED(early-exit)", "NEVER-SWAPPED-PRESENT")
    assert out["end-failed"][1] == out["none"][1] == "NEVER-SWAPPED-UNVERIFIED"


def test_seconds_text(spark):
    values = ["0.111", "9.994", "9.995", "10.25", "-0.5", "0"]
    df = table(spark, "s STRING", [(v,) for v in values])
    got = [r[0] for r in df.select(seconds_text(F.col("s").cast("decimal(20,6)"))).collect()]
    assert got == ["0.11s", "9.99s", "10.00s", "10.3s", "n/a(negative-latency)", "0.00s"]


def test_verdict_line(spark):
    df = table(spark, "s STRING, n STRING, r STRING", [("SKIPPED", "x", "why"), ("PASS", "y", "")])
    got = [r[0] for r in df.select(verdict_line(F.col("s"), F.col("n"), F.col("r"))).collect()]
    assert got == ["[SKIP] x — why", "[PASS] y"]
