"""Liveness: each case breaks one condition."""

import json

import pytest
from fixtures import table
from pyspark.sql import functions as F

from fleetwitness.operators import liveness as ops
from fleetwitness.sources.captures import read_api_captures, read_runs_and_chains

OLD = {"runId": "OLD", "triggeredAt": "2020-01-01T00:00:00Z", "status": "COMPLETED"}
LATE = "2099-01-01T00:00:05Z"
GOOD = {"trigger": {"matchedAt": LATE}, "actions": [{"command": "a", "outcome": "DISPATCHED"}, {"command": "b", "outcome": "UNCONFIRMED"}]}


def new(run="NEW", at=LATE):
    return {"runId": run, "triggeredAt": at, "status": "COMPLETED"}


# case -> (snapshot, polls, chain of NEW)
CASES = {
    "pass": ([OLD], [[OLD], [OLD], [OLD, new()]], GOOD),
    "no-new-run": ([OLD], [[OLD], [OLD]], None),
    "pre-reopen": ([OLD], [[OLD, new(at="2020-01-02T00:00:00Z")]], GOOD | {"trigger": {"matchedAt": "2020-01-02T00:00:00Z"}}),
    "snapshot-member": ([OLD, new()], [[OLD, new()]], GOOD),
    "empty-chain": ([OLD], [[OLD, new()]], GOOD | {"actions": [{"command": "a"}]}),
    "no-trigger": ([OLD], [[OLD, new()]], {"actions": GOOD["actions"]}),
    "bad-instant": ([OLD], [[OLD, new()]], GOOD | {"trigger": {"matchedAt": "soon"}}),
}
REASONS = {
    "pass": "accepted", "pre-reopen": "predates", "empty-chain": "no executed action", "no-trigger": "trigger view absent",
    "bad-instant": "unparseable matchedAt",
}


@pytest.mark.parametrize("case", CASES)
def test_new_run_after(spark, case):
    first, polls, chain = CASES[case]
    reads = [("s", "/api/v1/runs", n, 200, json.dumps({"data": rows})) for n, rows in enumerate([first, *polls])]
    if chain is not None:
        reads.append(("s", "/api/v1/runs/NEW/causal-chain", 0, 200, json.dumps({"data": chain})))
    df = table(spark, "scope STRING, path STRING, poll_seq INT, status INT, body STRING", reads)
    runs, chains, _ = read_runs_and_chains(df)
    anchors = table(spark, "scope STRING", [("s",)]).withColumn("m_observed", F.lit("2026-08-01").cast("timestamp"))
    snapshot, later = runs.where("poll_seq = 0"), runs.where("poll_seq > 0")
    judged = ops.new_run_after(later, snapshot, chains, anchors, snapshot)
    assert {r.result for r in judged.collect()} == ({REASONS[case]} if case in REASONS else set())
    verdict = ops.liveness_verdict(anchors, judged).first()
    assert verdict.status == ("PASS" if case == "pass" else "FAIL")
    if case == "pass":
        assert (verdict.run_id, verdict.agree) == ("NEW", True)


CHAINS = "scope STRING, run_id STRING, poll_seq INT, status INT, matched_at STRING, executed INT"


def test_a_poll_sees_the_chain_of_its_time(spark):
    """Five polls and five reads: one row per poll, none with a later read; no anchor, no verdict."""
    runs = table(
        spark, "scope STRING, poll_seq INT, list_pos INT, run_id STRING, triggered_at STRING",
        [(s, n, 0, "N", LATE) for s in ("a", "b") for n in range(1, 6)],
    )
    chains = table(spark, CHAINS, [(s, "N", n, 200 if n > 2 else 404, LATE, int(n > 3)) for s in ("a", "b") for n in range(1, 6)])
    anchors = table(spark, "scope STRING", [("a",)]).withColumn("m_observed", F.lit("2026-08-01").cast("timestamp"))
    judged = ops.new_run_after(runs, runs.where("false"), chains, anchors)
    got = {(r.scope, r.poll_seq): r.result for r in judged.collect()}
    assert judged.count() == 10
    assert [got["a", n] for n in range(1, 6)] == ["chain not 200"] * 2 + ["no executed action"] + ["accepted"] * 2
    assert {got["b", n] for n in range(1, 6)} == {"refused: no anchor"}
    assert {r.scope: r.status for r in ops.liveness_verdict(runs, judged, anchors).collect()} == {"a": "PASS", "b": "REFUSED"}


def test_an_action_counts_only_from_a_readable_chain(spark):
    runs = table(spark, "scope STRING, run_id STRING", [("a", "1"), ("b", "1"), ("a", "2")])
    rows = [("a", "1", 503, "CONFIRMED"), ("b", "1", 200, "CONFIRMED"), ("a", "2", 200, "TIMED_OUT")]
    actions = table(spark, "scope STRING, run_id STRING, status INT, outcome STRING", rows)
    assert [tuple(r) for r in ops.confirmed_new_run(runs, runs.where("false"), actions).collect()] == [("b", "1")]


def test_without_a_snapshot_nothing_is_accepted(spark):
    runs = table(spark, "scope STRING, poll_seq INT, list_pos INT, run_id STRING, triggered_at STRING", [("s", 1, 0, "N", LATE)])
    none = runs.where("false")
    chains = table(spark, CHAINS, [("s", "N", 1, 200, LATE, 1)])
    anchors = table(spark, "scope STRING", [("s",)]).withColumn("m_observed", F.lit("2026-08-01").cast("timestamp"))
    assert ops.new_run_after(runs, none, chains, anchors, none).count() == 0


def test_polls(spark):
    def read(terminal, phase):
        return json.dumps({"data": {"terminal": terminal, "currentPhase": phase}})

    rows = [
        ("ok", 0, 401, read(True, "CONFIRMED")), ("ok", 1, 200, read(False, "DISPATCHED")), ("ok", 2, 200, read(True, "CONFIRMED")),
        ("ok", 3, 200, read(True, "TIMED_OUT")), ("wrong", 0, 200, read(True, "TIMED_OUT")), ("wrong", 1, 200, read(True, "CONFIRMED")),
        ("text", 0, 200, read("true", "CONFIRMED")), ("cut", 0, 200, read(True, "CONFIRMED")[:20]), ("list", 0, 200, "[1]"),
    ]
    reads = ops.parse_body(table(spark, "line STRING, poll_seq INT, status INT, body STRING", rows))
    out = ops.decide_api(reads, ops.terminal_state(F.col("doc"), F.lit("CONFIRMED")), ["line"])
    assert {r.line: (r.state, r.decided_at_poll) for r in out.collect()} == {
        "ok": ("ok", 2), "wrong": ("fail", 0), "text": ("pending", None), "cut": ("pending", None), "list": ("pending", None),
    }


def test_rows_state(spark):
    rows = [('{"data": [1, 2]}', "ok"), ('{"data": [1]}', "pending"), ('{"data": 2}', "pending"), ("{}", "pending")]
    docs = ops.parse_body(table(spark, "body STRING, want STRING", rows))
    for r in docs.select("want", ops.rows_state(F.col("doc"), F.lit(2)).alias("got")).collect():
        assert r.got == r.want


def test_captures(spark):
    texts = [("a", json.dumps([{"when": "t", "what": "w", "status": 200, "body": '{"x": 1}'}, {"body": '{"x'}])), ("b", "nope")]
    out = read_api_captures(table(spark, "bundle STRING, text STRING", texts)).orderBy("bundle", "idx").collect()
    assert [(r.bundle, r.readable, r.idx, r.doc is not None) for r in out] == [
        ("a", True, 0, True), ("a", True, 1, False), ("b", False, None, False),
    ]
