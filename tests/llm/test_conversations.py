import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from fleetwitness.llm import conversations as c

sys.setrecursionlimit(20_000)  # the brute force walks a conversation by calls
ROWS = "conv_id bigint, turn bigint, role string, text string"


def solve(rows):
    """Least (cost, audit) by trying every edit, with at most two inserts in a gap."""

    @cache
    def best(at, state, inserts):
        out = []
        if at == len(rows) and state in "ea":
            out.append((0, ""))
        following = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 2:
            cost, audit = best(at, following, inserts + 1)
            out.append((cost + 3, "I" + audit))
        if at < len(rows):
            initial, fault = rows[at]
            cost, audit = best(at + 1, state, 0)
            out.append((cost + 4, "D" + audit))
            if fault < 2:
                more = 3 * (fault == 1)
                if initial == "" or initial == following or (initial, state) == ("s", "e"):
                    cost, audit = best(at + 1, state if initial == "" else initial, 0)
                    out.append((cost + more, "K" + audit))
                cost, audit = best(at + 1, following, 0)
                out.append((cost + more + 3, "R" + audit))
        return min(out, default=(10**9, ""))

    return best(0, "e", 0)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        own += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = solve(tuple((i if i in ("s", "u", "a", "") else "x", {"": 0, "t": 1}.get(f, 2)) for i, f in zip(initials, faults, strict=True)))
        lines, left, state = [], iter(own), "e"
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            following = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
            if edit in "RI":
                role = {"u": "user", "a": "assistant"}[following]
            if edit != "D":
                state = role[:1] or state
                lines.append(f"{role}:{text}")
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows_of(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted([tuple(r) for r in df.select(names).collect()], key=repr)


def test_all_short_conversations():
    """Every combination of up to four row codes, from and to every state that the whole allows."""
    for n in range(5):
        kinds = range(15) if n < 4 else (0, 1, 3, 5, 6, 7, 9, 12)
        for codes in itertools.product(kinds, repeat=n):
            rows = tuple(({"-": ""}.get(c._INITIALS[k // 3], c._INITIALS[k // 3]), k % 3) for k in codes)
            assert c.cheapest(bytes(codes), c.EMPTY, (c.EMPTY, c.ASSISTANT)) == solve(rows)


def test_pieces_like_the_whole(monkeypatch):
    rng = random.Random(4)
    cases = [bytes(rng.choices(range(15), weights=[3, 1, 1, 6, 2, 1, 6, 2, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(5, 60))) for _ in range(120)]
    whole = [c.repair(codes) for codes in cases]
    monkeypatch.setattr(c, "PIECE", 4)
    assert [c.repair(codes) for codes in cases] == whole


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(8)
    texts = ["Yes.", "no", "Why? ", "", " \t\n", "Done!\r\n", "é ß.", "Yes.", None, "a.b", "..."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "unknown", "tool"]
    rows = [(conv, turn, rng.choice(roles), rng.choice(texts)) for conv in range(150) for turn in range(rng.randrange(1, 12))]
    rows += [(300, turn, ("user", "assistant")[turn % 2], f"Line {turn}.") for turn in range(900)]
    rows += [(301, 4, "user", "Same.")] * 40 + [(302, None, r, t) for r in roles for t in texts] + [(None, t, "user", "Hi.") for t in (1, None, 7)]
    rows += [(303, -5, "user", "x" * 300_000), (304, 2, None, None)] + [(305, turn, "assistant", "Same.") for turn in range(60)]
    return rows


@pytest.mark.parametrize("short", [2000, 3])
def test_like_brute_force(spark, odd_rows, monkeypatch, short):
    """``short``: conversations above so many rows are hashed in the second stream."""
    monkeypatch.setattr(c, "SHORT_ROWS", short)
    frame = spark.createDataFrame(odd_rows, ROWS).repartition(5)
    frame = frame.selectExpr("*", *[f"'c' AS {n}" for n in ("conv", "key", "gone", "audit", "cost", "cut", "blank", "again", "n")])
    assert rows_of(c.repair_conversations(frame)) == brute(odd_rows)
    if short == 3:
        assert rows_of(c.repair_conversations(frame.where("false"))) == []


def test_repeats_by_shuffle(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(c, "FEW_REPEATS", 0)
    assert rows_of(c.repair_conversations(spark.createDataFrame(odd_rows, ROWS))) == brute(odd_rows)


def test_nothing_left_and_no_damage(spark):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(c.repair_conversations(frame)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    whole = hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
    assert rows_of(c.repair_conversations(frame, damage=False)) == [(gone, 0, 0, 0, 0, 0, 3, "KI", whole)]
    assert frame.select(F.crc32(F.lit(f"{gone}:0").cast("binary")) % 20).first()[0] == 0
