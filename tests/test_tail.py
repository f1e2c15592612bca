"""Growing files: whole lines once, partial ones held back, over restarts and small ranges."""

import pytest

from fleetwitness.sources import tail
from fleetwitness.streaming.drain import run_to_table


def lines_of(text):
    out, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        out.append((at, line.decode()))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_partial_lines_are_held_back(spark, tmp_path, size):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    steps = [("a.log", "one\ntwo\nthr"), ("a.log", "ee\n"), ("b.log", "é\n\nlong" + "g" * 40), ("b.log", "\nx\ny"), ("a.log", "four\n"), (".hidden", "no\n")]
    texts = {}
    for name, more in steps:
        texts[name] = texts.get(name, "") + more
        (folder / name).write_text(texts[name])
        got = run_to_table(tail.tail_lines(spark, str(folder), size), "tail", out).collect()
        rows = {n: sorted((r.byte_off, r.text) for r in got if r.file.endswith(n)) for n in texts if n != ".hidden"}
        assert rows == {n: lines_of(t) for n, t in texts.items() if n != ".hidden"}
    assert len(got) == 8 and not any(".hidden" in r.file for r in got)


def test_a_file_started_anew_is_read_again(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for text in ("first line\nsecond line\n", "new\n"):
        (folder / "a.log").write_text(text)
        got = run_to_table(tail.tail_lines(spark, str(folder)), "tail", out)
    assert sorted((r.byte_off, r.text) for r in got.collect()) == [(0, "first line"), (0, "new"), (11, "second line")]


def test_parsed(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("06:07:08.900 [main] INFO valve.Driver -- valve.open id=7\nplain\n06:0")
    got = run_to_table(tail.tail_log_lines(spark, str(folder)).select("byte_off", "level"), "parsed", str(tmp_path / "out"))
    assert {r.byte_off: r.level for r in got.collect()} == {0: "INFO", 57: None}


def test_ranges_cover_each_line_once(tmp_path):
    text = "".join(f"{'x' * (n % 13)}{n}\n" for n in range(200)) + "open"
    (tmp_path / "a.log").write_text(text)
    for size in (1, 3, 8, 50, 10_000):
        reader = tail.TailReader(str(tmp_path), size)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        rows = [(o, t) for p in parts for b in reader.read(p) for o, t in zip(b.column("byte_off").to_pylist(), b.column("text").to_pylist(), strict=True)]
        assert rows == lines_of(text)
