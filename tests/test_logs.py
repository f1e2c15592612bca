"""Log operators and adjudication on the bench's line form."""

import random

import pytest
from fixtures import (
    EXPECTATION,
    RESEAT_FLAP,
    RESEAT_OK,
    boot_catalogue,
    boot_forbidden,
    boot_text,
    log_rows,
    reseat,
    table,
)
from pyspark.sql import functions as F

from fleetwitness.operators import adjudicate as judge
from fleetwitness.operators import grams, logs
from fleetwitness.sources.logs import carry_stamp, parse_log_line, read_log_lines, split_text, with_offsets


def runs_of(spark, scenario, *names):
    return table(spark, "run_id STRING, scenario STRING", [(n, scenario) for n in names]).withColumn(
        "t0", F.lit("2026-07-31").cast("timestamp")
    )


@pytest.fixture
def boots(spark):
    return log_rows(
        spark, {"pass": boot_text(6), "missing": boot_text(1), "proposed": boot_text(6, proposed=True)}
    )


def test_boot_logs_in_a_finished_window(spark, boots):
    runs = runs_of(spark, "boot", "pass", "missing", "proposed", "silent")
    out = {r.run_id: r for r in judge.adjudicate_window(runs, boot_catalogue(spark), boot_forbidden(spark), boots).collect()}
    assert out["pass"].status == "PASS"
    assert (out["missing"].status, out["missing"].reason) == ("FAIL", "expected-not-seen: line 2 (saw 1/2)")
    assert (out["proposed"].status, out["proposed"].forbidden_idx) == ("FAIL", 8)
    assert out["silent"].failed_i == 0


def test_boot_logs_with_deadlines(spark, boots):
    runs = runs_of(spark, "boot", "pass", "missing", "proposed")
    out = {r.run_id: r for r in judge.adjudicate(runs, boot_catalogue(spark), boot_forbidden(spark), boots).collect()}
    assert out["pass"].status == "PASS" and out["pass"].reason == "5/5 positive · 0 forbidden"
    assert out["missing"].failed_i == 2 and out["proposed"].reason == "forbidden hit: device_proposed"


def test_a_scoped_forbidden_line_counts_below_its_anchor_only(spark):
    lines = log_rows(spark, {"ok": reseat(RESEAT_OK), "flap": reseat(RESEAT_FLAP)})
    catalogue = table(
        spark,
        EXPECTATION,
        [
            ("seat", 0, ["zigbee.transport_failed", "zigbee.port_unhealthy"], [], 1, None, None, 30),
            ("seat", 1, ["zigbee.reopened"], [], 1, None, None, 120),
        ],
    )
    forbidden = table(
        spark,
        "scenario STRING, j INT, token STRING, after_token STRING",
        [("seat", 0, "zigbee.reopen_no_target", "zigbee.reopened")],
    )
    runs = runs_of(spark, "seat", "ok", "flap")
    for fn in (judge.adjudicate_window,):
        out = {r.run_id: r.status for r in fn(runs, catalogue, forbidden, lines).collect()}
        assert out == {"ok": "PASS", "flap": "FAIL"}


def test_or_line_stamps_only_the_member_that_appeared(spark):
    lines = log_rows(spark, {"r": ["a b", "c"]})
    catalogue = table(spark, EXPECTATION, [("s", 0, ["b", "zz"], [], 1, None, None, 9)])
    matches = logs.match_tokens(lines, runs_of(spark, "s", "r"), catalogue)
    assert [r.token for r in logs.first_observed(matches).collect()] == ["b"]


def test_extract_live_and_window_forms_differ(spark):
    """Live: the first number that reaches the minimum decides; window: only the last line counts."""
    lines = log_rows(spark, {"r": ["n=1", "n=9", "n=2"]})
    catalogue = table(spark, EXPECTATION, [("s", 0, ["n="], [], 1, r"n=(\d+)", 5, 99)])
    none = table(spark, "scenario STRING, j INT, token STRING, after_token STRING", [("other", 0, "zzz", None)])
    runs = runs_of(spark, "s", "r")
    assert judge.adjudicate(runs, catalogue, none, lines).first().status == "PASS"
    assert judge.adjudicate_window(runs, catalogue, none, lines).first().status == "FAIL"


def loop_verdict(lines, expectations, t0=0):
    """The deadline rule as a direct loop over one run (seconds)."""
    clock = t0
    for i, (token, need, within) in enumerate(expectations):
        hits = [at for at, text in lines if token in text]
        if len(hits) < need or hits[need - 1] > clock + within:
            return i
        clock = max(clock, hits[need - 1])
    return None


def test_deadlines_match_a_loop(spark):
    rng = random.Random(11)
    runs, exp_rows, want, logs_by_run = [], [], {}, {}
    for n in range(60):
        name = f"r{n}"
        expectations = [(rng.choice("abc"), rng.randint(1, 3), rng.randint(1, 8)) for _ in range(3)]
        texts = ["".join(rng.choices("abcdxyz", k=2)) for _ in range(rng.randint(0, 14))]
        logs_by_run[name] = texts
        want[name] = loop_verdict([(i, x) for i, x in enumerate(texts)], expectations)
        runs.append((name, f"s{n}"))
        exp_rows += [(f"s{n}", i, [t], [], need, None, None, within) for i, (t, need, within) in enumerate(expectations)]
    run_df = table(spark, "run_id STRING, scenario STRING", runs).withColumn("t0", F.lit("2026-07-31").cast("timestamp"))
    none = table(spark, "scenario STRING, j INT, token STRING, after_token STRING", [("x", 0, "Q", None)])
    out = judge.adjudicate(run_df, table(spark, EXPECTATION, exp_rows), none, log_rows(spark, logs_by_run))
    assert {r.run_id: r.failed_i for r in out.collect()} == want


def test_a_large_catalogue_matches_pair_by_pair(spark, boots, monkeypatch):
    runs = runs_of(spark, "boot", "pass", "missing")
    cols = ["run_id", "i", "idx"]
    compiled = sorted(logs.match_tokens(boots, runs, boot_catalogue(spark)).select(*cols).collect())
    monkeypatch.setattr(logs, "MAX_PATTERNS", 2)
    assert sorted(logs.match_tokens(boots, runs, boot_catalogue(spark)).select(*cols).collect()) == compiled


def test_tokens_with_one_prefix_meet_by_their_own_grams(spark, monkeypatch):
    """Every token and line starts alike: candidates are about as many as matches."""
    monkeypatch.setattr(logs, "MAX_PATTERNS", 2)
    prefix = "com.example.service.valve."
    catalogue = table(spark, EXPECTATION, [("s", n, [f"{prefix}{n:05d}x"], [], 1, None, None, 9) for n in range(400)])
    lines = log_rows(spark, {"r": [f"at {prefix}{n:05d}x here" for n in range(400)] + [prefix] * 50})
    tokens = catalogue.select(F.explode("tokens").alias("token"))
    key = grams.rarest_key(grams.gram_counts(lines, [8]))
    keyed = tokens.select("token", key(F.col("token")).alias("key"))
    found = lines.select(F.explode(grams.keys_in(grams.key_maps(keyed), [8])(F.col("text"))).alias("key"))
    assert found.join(keyed, "key").count() < 3 * 400
    got = logs.match_tokens(lines, runs_of(spark, "s", "r"), catalogue).select("i", "idx").collect()
    assert sorted(tuple(r) for r in got) == [(n, n) for n in range(400)]
    kept = logs.keep_mentioned(lines, tokens)
    assert {r.idx for r in kept.collect()} == set(range(400))


def test_a_catalogue_beyond_the_bound_stays_a_table(spark, monkeypatch):
    """Tokens of all lengths, several in one line, empty, repeated, and scenarios apart; the patterns are not read."""
    rng = random.Random(3)
    texts = {f"r{n}": ["".join(rng.choices("abé", k=rng.randint(0, 40))) for _ in range(30)] + [None, ""] for n in range(4)}
    token = lambda: "".join(rng.choices("abé", k=rng.choice([1, 2, 3, 5, 18])))
    rows = [(f"s{n % 2}", n, [token() for _ in range(rng.randint(0, 3))], [token()[:2]], 1, None, None, 9) for n in range(60)]
    text = next(t for t in texts["r0"] if t and len(t) > 25)
    rows += [("s0", 60, ["b", "a", "b"], None, 1, None, None, 9), ("s1", 61, [""], [], 1, None, None, 9), ("s0", 62, [text[3:24]], [], 1, None, None, 9)]
    lines = log_rows(spark, texts)
    runs = runs_of(spark, "s0", "r0", "r1").unionByName(runs_of(spark, "s1", "r2", "r3"))
    scenario = {"r0": "s0", "r1": "s0", "r2": "s1", "r3": "s1"}
    want = sorted(
        (run, i, idx) for run, parts in texts.items() for idx, x in enumerate(parts) for s, i, any_of, all_of, *_ in rows
        if s == scenario[run] and x is not None and any(t in x for t in any_of) and all(t in x for t in all_of or [])
    )
    catalogue = table(spark, EXPECTATION, rows)
    monkeypatch.setattr(logs, "MAX_PATTERNS", 2)
    found = logs.match_tokens(lines, runs, catalogue).select("run_id", "i", "idx").collect()
    assert sorted(tuple(r) for r in found) == want and any(i == 62 for _, i, _ in want)


@pytest.mark.parametrize(("earliest", "status"), [(True, "FAIL"), (False, "PASS")])
def test_an_anchor_named_by_two_lines(spark, earliest, status):
    """With deadlines the forbidden line is watched from the first of them on, over a window from the last."""
    texts = ["reopened"] + ["bad" if n == 2 else "up" if n == 4 else "reopened done" if n == 7 else "x" for n in range(1, 8)]
    lines = log_rows(spark, {"r": texts})
    catalogue = table(
        spark, EXPECTATION,
        [("s", 0, ["reopened"], [], 1, None, None, 99), ("s", 1, ["up"], [], 1, None, None, 99), ("s", 2, ["reopened"], ["done"], 1, None, None, 99)],
    )
    forbidden = table(spark, "scenario STRING, j INT, token STRING, after_token STRING", [("s", 0, "bad", "reopened")])
    judged = (judge.adjudicate if earliest else judge.adjudicate_window)(runs_of(spark, "s", "r"), catalogue, forbidden, lines)
    assert judged.first().status == status


def test_a_stamped_line_without_a_message(spark):
    rows = [("12:00:00.000 [t] INFO x -- ",), ("12:00:00.000 [t] INFO x -- a\u0001b k=1",), ("12:00 no form",), ("tail \u0001",)]
    out = parse_log_line(table(spark, "text STRING", rows)).collect()
    assert [(r.message, r.logger) for r in out] == [("", "x"), ("a\u0001b k=1", "x"), ("12:00 no form", None), ("tail \u0001", None)]
    assert not out[0].token and out[0].thread == "t" and out[0].tod_ms == 43_200_000


def test_the_cap_is_named(spark):
    lines = parse_log_line(log_rows(spark, {"t": ["00:00:01.000 a"] * 5})).withColumn("byte_off", F.col("idx") * 10)
    runs = table(spark, "run_id STRING, start_ms BIGINT", [("t", 0)])
    none = table(spark, "run_id STRING, seq INT, log_offset BIGINT", [("other", 0, 0)])
    whole, cut = logs.evidence_slice(lines, runs, none).collect(), logs.evidence_slice(lines, runs, none, cap=2).collect()
    assert len(whole) == 5 and {r.label for r in whole} == {"time window"}
    assert len(cut) == 2 and {r.label for r in cut} == {"time window, last 2 of 5 lines"}


def test_parse_and_carry(spark, boots):
    parsed = parse_log_line(boots.where("run_id = 'pass'").withColumnRenamed("run_id", "boot_id"))
    rows = carry_stamp(parsed).orderBy("idx").collect()
    assert sum(r.tod_ms is None for r in rows) == 4
    assert rows[4].carried_ms == rows[3].tod_ms
    assert rows[1].kv == {"devices": "6", "entities": "6", "position": "25065"}
    assert (rows[1].token, rows[1].level, rows[1].logger, rows[1].thread) == (
        "registry.projection_live", "INFO", "bench.Registry", "main",
    )


def test_file_order_and_offsets_over_splits(spark, tmp_path):
    texts = [f"line {i} é{'x' * (i % 40)}" for i in range(3000)]
    raw = "\n".join(texts).encode() + b"\nbad \xff tail"
    (tmp_path / "a.log").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    rows = read_log_lines(spark, str(tmp_path)).orderBy("idx").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows[:3000]] == texts and [r.idx for r in rows] == list(range(3001))
    assert all(raw[r.byte_off :].startswith(r.text.encode()) for r in rows[:3000:97])


def test_split_text_offsets(spark):
    df = table(spark, "k INT, text STRING", [(1, "é\n\nab")])
    rows = with_offsets(split_text(df, "k"), ["k"]).orderBy("idx").collect()
    assert [(r.idx, r.byte_off, r.text) for r in rows] == [(0, 0, "é"), (1, 3, ""), (2, 4, "ab")]


def test_evidence_tiers(spark):
    lines = log_rows(spark, {r: ["00:00:01.000 a", "b", "00:00:03.000 c"] for r in ("w", "re", "t", "n")})
    lines = parse_log_line(lines).withColumn("byte_off", F.col("idx") * 10)
    markers = table(spark, "run_id STRING, seq INT, log_offset BIGINT", [("w", 0, 10), ("re", 0, 20), ("re", 1, 500)])
    runs = table(spark, "run_id STRING, start_ms BIGINT", [("w", 0), ("re", 0), ("t", 2000), ("n", 4000)])
    out = logs.evidence_slice(lines, runs, markers).collect()
    got = sorted((r.run_id, r.tier, -1 if r.idx is None else r.idx) for r in out)
    assert got == [("n", "none", -1), ("re", "re-read", 2), ("t", "time-window", 2), ("w", "window", 1), ("w", "window", 2)]


def test_outage(spark):
    lines = log_rows(spark, {"ok": reseat(RESEAT_OK), "flap": reseat(RESEAT_FLAP[:3])}).withColumnRenamed("run_id", "boot_id")
    out = {r.boot_id: r for r in logs.outage_intervals(lines).collect()}
    assert (out["ok"].retries, out["ok"].recovered, out["ok"].duration_us) == (2, True, 4_000_000)
    assert (out["flap"].retries, out["flap"].recovered) == (1, False)


def test_boot_outcome_failure_first(spark):
    lines = log_rows(spark, {"f": ["x", "zigbee.network_up integration.failed"], "u": ["zigbee.network_up"], "n": ["x"]})
    lines = lines.withColumnRenamed("run_id", "boot_id")
    starts = lines.groupBy("boot_id").agg(F.min("observed_at").alias("started_at"))
    assert {r.boot_id: r.outcome for r in logs.boot_outcome(lines, starts).collect()} == {
        "f": "FAILED", "u": "UP", "n": "UNDECIDED",
    }
