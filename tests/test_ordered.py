"""Hot groups give the same rows as plain windows."""

import random

import pytest
from fixtures import table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetwitness.operators import ordered as o

DDL = "k STRING, a BIGINT, b BIGINT, v BIGINT"


def reference(rows):
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        known = None
        for i, r in enumerate(group):
            later = [x[3] for x in group[i + 1 :] if x[3] is not None]
            seen = [x[3] for x in group[: i + 1] if x[3] is not None]
            out[r[:3]] = (
                group[i - 1][3] if i else None,
                group[i + 1][3] if i + 1 < len(group) else None,
                known,
                r[3] if r[3] is not None else known,
                later[0] if later else None,
                sum(seen) if seen else None,
                max(seen) if seen else None,
                i + 1,
            )
            known = r[3] if r[3] is not None else known
    return out


def scanned(df, limit):
    seq = o.ordered(df, ["k"], ["a", "b"], limit).scan(
        prev=o.previous("v"), nxt=o.following("v"), before=o.last_before("v"), upto=o.last_upto("v"),
        after=o.next_after("v"), total=o.running_sum("v"), top=o.running_max("v"), n=o.row_index(),
    )
    return {(r.k, r.a, r.b): tuple(r)[4:] for r in seq.frame().collect()}


rows_of = st.lists(
    st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 5), st.one_of(st.none(), st.integers(-9, 9))),
    min_size=1,
    max_size=60,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_of, st.integers(1, 12))
def test_scans_match_a_loop(spark, rows, limit):
    rows = [(k, a, i, v) for i, (k, a, v) in enumerate(rows)]
    df = table(spark, DDL, rows)
    want = reference(rows)
    assert scanned(df, limit) == want
    assert scanned(df, 1000) == want


def test_a_chain_keeps_its_segments(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, i, rng.randrange(3)) for i in range(300)]
    df = table(spark, DDL, rows)

    def chain(limit):
        seq = o.ordered(df, ["k"], ["a", "b"], limit).scan(p=o.previous("v"))
        seq = seq.where(F.col("p").isNull() | (F.col("p") != F.col("v"))).scan(n=o.row_index(), nxt=o.following("a"))
        return sorted(tuple(r) for r in seq.frame().select("k", "a", "v", "n", "nxt").collect())

    assert chain(20) == chain(10_000)
    hot = o.ordered(df, ["k"], ["a", "b"], 20)
    segments = hot.split.groupBy("_seg").count().collect()
    assert len(segments) > 5 and max(r["count"] for r in segments) < 100


def test_no_hot_group_is_a_plain_window(spark):
    df = table(spark, DDL, [("x", 1, 1, 1)])
    assert o.ordered(df, ["k"], ["a", "b"]).split is None


def test_a_catalogue_is_counted_before_it_is_broadcast(spark):
    small, large = spark.range(10), spark.range(100)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(o.small_side(small, 50))
    assert "broadcast" not in plan(o.small_side(large, 50))


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from fleetwitness import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_ranks_by_counts_like_a_sort(spark, monkeypatch):
    """Any number of ranks, over ranges of a few places, null and hot keys, gaps in the order."""
    import random

    from fleetwitness.operators import ordered as o

    rng = random.Random(6)
    rows = [(k, at, 3 if k == "a" else 40) for k in ("a", "b", None) for at in rng.sample(range(-200, 900), 150)] + [("c", 5, 40)]
    df = spark.createDataFrame(rows, "k string, at bigint, want int")
    monkeypatch.setattr(o, "TASK_RANKS", 1)
    monkeypatch.setattr(o, "RANGE", 16)
    own = {k: sorted(at for x, at, _ in rows if x == k) for k in ("a", "b", None, "c")}
    got = o.smallest(df, ["k"], [F.col("at")], 40, F.col("at")).collect()
    assert sorted(((r.k, r["_rank"], r["at"]) for r in got), key=repr) == sorted(((k, n, at) for k, v in own.items() for n, at in enumerate(v[:40], 1)), key=repr)
    last = o.smallest(df, ["k"], [F.col("at").desc()], 7, -F.col("at")).collect()
    assert sorted(((r.k, r["at"]) for r in last), key=repr) == sorted(((k, at) for k, v in own.items() for at in v[-7:]), key=repr)
    nth = o.ranked_upto(df, ["k"], F.col("at"), F.col("want"), only_limit=True).where("_rank = want").collect()
    assert {r.k: r["at"] for r in nth} == {"a": own["a"][2], "b": own["b"][39], None: own[None][39]}
