import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetwitness.llm import warc
from fleetwitness.llm.common import Steps, reach_package

PAGES = "page_id bigint, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-row:id:99999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows):
    groups = defaultdict(list)
    for key, _, html in rows:
        groups[html or ""].append(key)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        known = [k for k in groups[html or ""] if k is not None]
        first = min(known, default=None)
        revisit = len(body) >= 100 and first is not None and key != first
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("id", "payload_bytes", "digest", "type", "refers_to").collect()], key=repr)


ROWS = [
    (1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, None), (4, "http://c/\r\nWARC-Type: x", ""),
    (7, "u", "long page " * 20), (5, "u", "long page " * 20), (6, "u", "long page " * 20), (6, "u", "long page " * 20),
    (8, "u", f"<p>{FAKE}</p>"), (9, "u", FAKE * 30), (10, "u", "WARC/1.1\r\n" * 50), (11, "u", "x\r\n\r\n" + FAKE + "\r\n\r\n"),
    (12, "u", "é 漢 \U0001f600 " * 40), (13, "u", "WARC/1." * 3), (14, "u", "y" * 300_000), (None, "u", "no id " * 40), (None, "u", "no id " * 40),
    (None, "u", "long page " * 20), (15, "u", f"{'WARC/1.0' + chr(13) + chr(10)}Content-Length: 99999999\r\nWARC-Type: response\r\n\r\nz"),
]


@pytest.mark.parametrize("split", ["128m", "2000", "137"])
def test_round_trip_over_splits(spark, split):
    """Splits of a few bytes cut headers, payloads and the magic itself."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    rows = [r for r in ROWS if split != "137" or r[0] != 14]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("c")).withColumn("value", F.lit("c")).coalesce(1)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert rows_of(warc.archive_round_trip(pages)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_no_rows_and_many_files(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    assert rows_of(warc.archive_round_trip(pages.where("false"))) == []
    assert rows_of(warc.archive_round_trip(pages.repartition(5))) == brute(ROWS)


def test_shuffled_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW_COPIES", 0)
    assert rows_of(warc.archive_round_trip(spark.createDataFrame(ROWS, PAGES))) == brute(ROWS)


def record(kind, key, block, size=None):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{key}>\r\ncontent-length: {len(block) if size is None else size}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_others_and_broken_chains(spark, tmp_path):
    """Other kinds, version 1.0, header names in any case; what follows a break is not returned."""
    reach_package(spark)
    whole = record("warcinfo", "i", b"software: x\r\n") + record("resource", "r", bytes(range(256))) + record("metadata", "m", b"")
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(record("resource", "b1", b"one") + b"junk" + record("resource", "b2", b"two"))
    (tmp_path / "c.warc").write_bytes(record("resource", "c1", b"one") + record("resource", "c2", b"cut off", 5000))
    (tmp_path / "d.warc").write_bytes(b"no archive at all")
    (tmp_path / "e.warc").write_bytes(b"")
    got = {r["record_id"]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["urn:b1", "urn:c1", "urn:i", "urn:m", "urn:r"]
    assert got["urn:r"]["digest"] == hashlib.sha256(bytes(range(256))).hexdigest() and got["urn:m"]["payload_bytes"] == 0


def test_payloads_by_record(spark, tmp_path):
    reach_package(spark)
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(2)
    warc.write_archive(pages, str(tmp_path / "w"), max_records=4)
    steps = Steps(spark)
    found = steps.keep(warc.candidates(spark, str(tmp_path / "w"), steps), "candidates")
    assert found.where("type IS NOT NULL").count() > len(ROWS)
    records = found.join(warc.reachable(found, steps), ["file", "offset"])
    assert records.count() == len(ROWS)
    blocks = [bytes(r["block"]) for r in warc.record_bytes(spark, str(tmp_path / "w"), records.where("type = 'response'"), found).collect()]
    bodies = {b.split(b"\r\n\r\n", 1)[1].decode() for b in blocks}
    assert bodies == {r[2] or "" for r in ROWS}


def test_pointer_jumping_over_many_splits(spark, tmp_path):
    reach_package(spark)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(record("resource", f"n{n}", FAKE.encode() * (n % 3)) for n in range(120)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [r["record_id"] for r in warc.read_archive(spark, str(tmp_path / "w")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(f"urn:n{n}" for n in range(120))
