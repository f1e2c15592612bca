"""Captures of devices, catalogue rules and merges."""

import json

from fixtures import table
from pyspark.sql import functions as F

from fleetwitness.functions import scalars as x
from fleetwitness.operators import catalog, corpus, fleet
from fleetwitness.sources import captures


# Fixed values of this file: field names of the captures and the counter's text form; all readings are made up.
def test_radio_fixture_with_time_of_day(spark, tmp_path):
    doc = {
        "environment": {"host": "h", "device": {"model": "m"}},
        "sequences": [
            {"name": "s", "events": [
                {"ts": "09:30:00.125", "dir": "in", "cluster": "0x0006", "frame": "ack", "commandId": 0, "status": "SUCCESS"},
                {"ts": "09:30:00.500", "dir": "in", "cluster": "0x0006", "frame": "r", "attr": {"name": "on_off", "value": False}},
                {"ts": "23:59:59.750", "dir": "in", "cluster": "0x0300", "frame": "r", "attrs": {"ct": 301, "x": 3}},
                {"note": "nothing follows"},
            ]},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    events, notes = captures.read_radio_fixture(spark, str(tmp_path), date="2031-05-14", zone="America/New_York")
    rows = events.orderBy("pos", "attr_name").collect()
    assert [(r.attr_name, r.value) for r in rows] == [(None, None), ("on_off", "false"), ("ct", "301"), ("x", "3")]
    assert str(rows[0].ts) == "2031-05-14 13:30:00.125000" and rows[0].environment.device == {"model": "m"}
    assert [(r.pos, r.note) for r in notes.collect()] == [(3, "nothing follows")]


def test_diagnostics_keep_mixed_values(spark, tmp_path):
    attributes = [
        {"id": "0x0010", "name": "addr", "zcl_type": "EUI64", "value": [17, 34, 51, 254, 255, 68, 85, 102]},
        {"id": "0x0004", "name": "maker", "zcl_type": "string", "value": "acme"},
        {"id": "0x0021", "name": "battery", "zcl_type": "uint8", "value": 200},
        {"id": "0x0033", "name": "count", "unsupported": True},
    ]
    cluster = {"cluster_id": "0x0001", "endpoint_attribute": "power", "attributes": attributes}
    data = {"model": "m", "lqi": 101, "rssi": -72, "last_seen": "2031-05-14T06:07:08.900000+00:00",
            "endpoints": {"1": {"profile_id": 260, "in_clusters": [cluster], "out_clusters": []}}}
    (tmp_path / "d.json").write_text(json.dumps({"data": data}, indent=1))
    devices, found = captures.read_diagnostics(spark, str(tmp_path))
    assert devices.select("lqi", "rssi").first() == (101, -72)
    address = found.where("attr_name = 'addr'").select(
        x.eui64_text(F.variant_get("value", "$", "array<bigint>")).alias("a")
    )
    assert address.first().a == "66:55:44:ff:fe:33:22:11"
    text = F.try_variant_get("value", "$", "string")
    got = {r.attr_name: (r[1], r.unsupported) for r in found.select("attr_name", text, "unsupported").collect()}
    assert got["maker"] == ("acme", False) and got["battery"] == ("200", False) and got["count"] == (None, True)


def test_coordinator(spark, tmp_path):
    counter = {"repr": "Counter(name='MAC_TX', _raw_value=7001, reset_count=4, _last_reset_value=0)"}
    doc = {"data": {"application_state": {"counters": {"ezsp": {"MAC_TX": counter}, "other": {}}},
                    "energy_scan": {"14": 31.5, "25": 8.25, "18": 90.0}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    counters, scan = captures.read_coordinator(spark, str(tmp_path))
    assert counters.select("counter_group", "name", "raw_value", "reset_count").collect() == [("ezsp", "MAC_TX", 7001, 4)]
    quiet = corpus.quiet_channels(scan, ["snapshot_id"], 2).orderBy("rank").collect()
    assert [r.channel for r in quiet] == [25, 14]


def test_snapshot_diff_and_merge(spark):
    before = table(spark, "k STRING, value STRING", [("lqi", "101"), ("rssi", "-72"), ("same", "1"), ("gone", None)])
    after = table(spark, "k STRING, value STRING", [("lqi", "88"), ("rssi", "-75"), ("same", "1"), ("new", "2")])
    got = {r.k: (r.before, r.after, r.change) for r in corpus.snapshot_diff(before, after, ["k"]).collect()}
    assert got == {
        "lqi": ("101", "88", "changed"), "rssi": ("-72", "-75", "changed"), "gone": (None, None, "removed"),
        "new": (None, "2", "added"),
    }
    merged = {r.k: (r.value, r.origin, r.conflict) for r in corpus.merge_sources(before, after, ["k"]).collect()}
    assert merged["lqi"] == ("88", "bench", True) and merged["same"] == ("1", "bench", False)


def test_templates(spark):
    rows = [("a", None, {"x": "1", "y": "1"}), ("b", "a", {"y": "2"}), ("c", "b", {"z": "3"}), ("loop", "loop", {"q": "1"})]
    out = corpus.inherit_templates(table(spark, "key STRING, extends STRING, deltas MAP<STRING,STRING>", rows))
    got = {r.key: (r.deltas, r.resolved) for r in out.collect()}
    assert got["c"] == ({"x": "1", "y": "2", "z": "3"}, True)
    assert got["loop"][1] is False


def test_templates_of_any_depth_and_those_that_are_missing(spark):
    rows = [("t0", None, {"v": "0"})] + [(f"t{n}", f"t{n - 1}", {"v": str(n)}) for n in range(1, 13)]
    rows += [("lost", "nowhere", {"q": "1"}), ("child", "lost", {}), ("x", "y", {}), ("y", "x", {})]
    out = corpus.inherit_templates(table(spark, "key STRING, extends STRING, deltas MAP<STRING,STRING>", rows))
    got = {r.key: (r.depth, r.resolved, r.problem) for r in out.collect()}
    assert got["t12"] == (12, True, None) and len(got) == len(rows)
    assert got["lost"] == (0, False, "missing: nowhere") and got["child"] == (1, False, "missing: nowhere")
    assert got["x"] == (1, False, "cycle: x") and got["y"] == (1, False, "cycle: y")


def test_scrub(spark):
    key = ":".join(["AB"] * 16)
    df = table(spark, "t STRING", [(f"key {key} at 02:11:22:33:44:55:66:77 clock 06:07:08 id 0x0406",)])
    assert corpus.scrub_keys(df, ["t"]).first().t == "key **REDACTED** at **REDACTED** clock 06:07:08 id 0x0406"


def test_empty_positives_are_refused(spark):
    scenarios = table(
        spark,
        "scenario STRING, file_stem STRING, tier STRING, keys ARRAY<STRING>, requires_is_list BOOLEAN, precondition STRING, uses_exactly BOOLEAN",
        [("s", "s", "AUTO", ["scenario", "evidence"], True, None, False)],
    )
    positives = table(
        spark,
        "scenario STRING, i INT, kinds ARRAY<STRING>, log STRING, log_any ARRAY<STRING>, count INT, has_extract BOOLEAN, "
        "has_min BOOLEAN, within STRING, assert_keys ARRAY<STRING>, anchor STRING",
        [("other", 0, ["log"], "t", None, 1, False, False, "9s", None, None)],
    )
    forbidden = table(spark, "scenario STRING, j INT, token STRING, after_token STRING", [("s", 0, "x", None)])
    broken = catalog.validate_expectations(scenarios, positives, forbidden)
    assert [(r.scenario, r.rule) for r in broken.collect()] == [("s", "L7")]
    assert catalog.first_refusal(broken).first().rule == "L7"


def test_required_settings(spark):
    required = table(spark, "path STRING, is_duration BOOLEAN", [("a", False), ("b", True), ("c", True), ("d", False), ("e", False)])
    constants = table(spark, "path STRING, value STRING", [("a", "x"), ("b", "45m"), ("c", "soon"), ("d", "PLACEHOLDER")])
    out = {r.path: r.problem for r in catalog.find_unset(required, constants).collect()}
    assert out == {"c": "not a duration", "d": "unset", "e": "unset"}


def test_settings_by_branch(spark):
    """A branch asks for its own settings; no branch, or another word, is a problem itself."""
    required = table(spark, "path STRING, is_duration BOOLEAN, branch STRING", [("mode", False, None), ("wait", True, None), ("pump", False, "wet")])
    rows = [(1, "mode", "dry"), (1, "wait", "9s"), (2, "mode", "wet"), (2, "wait", "9s"), (3, "mode", "damp"), (4, "wait", "long"), (5, "mode", "wet"), (5, "wait", "9"), (5, "pump", "on")]
    out = catalog.branch_problems(required, table(spark, "config_id INT, path STRING, value STRING", rows), "mode", ["dry", "wet"])
    assert sorted((r.config_id, r.path, r.problem) for r in out.collect()) == [
        (2, "pump", "unset"), (3, "mode", "not a branch"), (3, "wait", "unset"), (4, "mode", "not a branch"), (4, "wait", "not a duration"),
    ]


def test_scalars(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(x.hex_to_int(F.lit("0x01000D08"))) == 16780552
    assert one(x.int_to_hex(F.lit(16780552), 8)) == "0x01000D08"
    assert [one(x.percent_to_level(x.level_to_percent(F.lit(v)))) for v in (51, 127)] == [51, 127]
    assert one(x.battery_percent(F.lit(200))) == 100.0 and one(x.battery_millivolts(F.lit(28))) == 2800
    assert one(x.iso_instant(F.lit("2026-08-01T08:31:02.050z"))) is not None
    assert one(x.iso_instant(F.lit("not a time"))) is None
    assert one(x.capability_group(F.lit("SKIPPED: [a], [b] — x"))) == "a+b"


def test_retention(spark):
    logs = table(spark, "bench_id STRING, boot_id STRING, boot_seq INT, copied BOOLEAN",
                 [("b", f"l{i}", i, i != 1) for i in range(5)])
    cited = table(spark, "boot_id STRING", [("l0",)])
    assert [r.boot_id for r in fleet.prunable_logs(logs, cited).collect()] == ["l2"]
