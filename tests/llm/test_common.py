import random

import pytest

from fleetwitness.llm import common
from fleetwitness.llm.common import components
from fleetwitness.llm.spans import Memory, segments


def brute(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(common, "TASK_EDGES", limit)
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(77, i) for i in range(0, 200)],
        "none": [],
    }[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {a: r for a, r in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_segments_keep_every_character():
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "c", " d"]) for _ in range(5000))
    parts = list(segments(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert all(p[0] == " " and p[1] not in " \n" for p in parts[1:])
    assert list(segments("")) == [""]


def test_memory_forgets():
    memory = Memory(len, 3)
    assert [memory["a" * i] for i in range(9)] == list(range(9)) and len(memory) <= 3
