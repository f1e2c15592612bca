"""Evidence is published whole or not at all."""

import pytest
from fixtures import table

from fleetwitness.sources import sinks

RUNS = "run_id STRING, scenario STRING, night STRING, status STRING"


def parts_of(spark, text, runs=("a", "b")):
    logs = table(spark, "run_id STRING, idx BIGINT, text STRING", [(r, n, f"{text}{n}") for r in runs for n in range(3)])
    empty = table(spark, "run_id STRING, name STRING, value STRING", [])
    resolved = sinks.resolved_values(table(spark, "run_id STRING, name STRING, value STRING", [(r, "within", "9") for r in runs]), empty, empty)
    return {"log_lines": logs, "resolved": resolved}


def seen(spark, folder):
    return sorted((r.run_id, r.status, r.log_lines, r.absent) for r in sinks.read_evidence(spark, folder, "manifest").collect())


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "evidence")
    with pytest.raises(FileNotFoundError):
        sinks.read_evidence(spark, folder, "manifest")
    verdicts = table(spark, RUNS, [("a", "s", "n1", "PASS"), ("b", "s", "n2", "FAIL"), ("c", "t", "n1", "PASS")])
    parts = parts_of(spark, "x")
    assert sinks.publish_evidence(sinks.evidence_manifest(verdicts, parts), parts, folder) == 1
    first = [("a", "PASS", 3, ""), ("b", "FAIL", 3, ""), ("c", "PASS", 0, "log_lines,resolved")]
    assert seen(spark, folder) == first
    # A writer that dies before the last step leaves nothing visible.
    later = verdicts.where("run_id = 'b'").replace("FAIL", "PASS")
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "committed", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.publish_evidence(sinks.evidence_manifest(later, parts), parts, folder)
    assert seen(spark, folder) == first
    # Only the scenario and night that are written again are replaced, in all tables.
    parts = parts_of(spark, "y", ("b",))
    assert sinks.publish_evidence(sinks.evidence_manifest(later, parts), parts, folder) == 2
    assert seen(spark, folder) == [first[0], ("b", "PASS", 3, ""), first[2]]
    lines = {(r.run_id, r.text) for r in sinks.read_evidence(spark, folder, "log_lines").collect()}
    assert lines == {("a", f"x{n}") for n in range(3)} | {("b", f"y{n}") for n in range(3)}
    # A number that another writer has claimed is left to it.
    (tmp_path / "evidence" / "commits" / "claim-000000003").touch()
    assert sinks.publish_evidence(sinks.evidence_manifest(later, parts), parts, folder) == 4
    assert sorted((r.kind, r.name, r.value) for r in sinks.read_evidence(spark, folder, "resolved").where("run_id = 'b'").collect()) == [("constant", "within", "9")]
