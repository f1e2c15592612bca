import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwitness.llm import embed_dedup, minhash

from docs_fixture import DOCS, words


def shingle_set(text, size):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(own) < size:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def linked(items, alike):
    """Smallest id that links reach, by comparing all."""
    roots = list(range(len(items)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if alike(items[i], items[j]):
                roots[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    roots = linked(sets, lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    low = {}
    for (key, _), root in zip(rows, roots, strict=True):
        low[root] = min((k for k in (low.get(root), key) if k is not None), default=None)
    return sorted([(k, len(s), low[r] if s else k, k == (low[r] if s else k)) for (k, _), s, r in zip(rows, sets, roots, strict=True)], key=repr)


@pytest.fixture(scope="module")
def crowd(spark):
    """Documents changed a little more each time, a crowd of near copies, and strangers."""
    rng = random.Random(7)
    rows = []
    for _ in range(8):
        chain = words(rng, rng.randrange(30, 200))
        for _ in range(6):
            rows.append(" ".join(chain))
            chain[rng.randrange(len(chain))] = f"new{rng.random()}"
    base = words(rng, 120)
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = f"v{rng.random()}"
        rows.append(" ".join(copy))
    rows += [" ".join(words(rng, 60, 12)) for _ in range(30)] + ["of the and in to", "of the and in to ", "OF the and in to", "x", "X", ""]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], DOCS)


@pytest.mark.parametrize(("small", "levels"), [(64, 4), (4, 2), (2, 1)])
def test_components_like_brute_force(crowd, monkeypatch, small, levels):
    """Nodes in one step, by branching, and by blocks where branching ends."""
    monkeypatch.setattr(minhash, "SMALL_NODE", small)
    monkeypatch.setattr(minhash, "LEVELS", levels)
    got = sorted([tuple(r) for r in minhash.near_duplicates(crowd).collect()], key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in crowd.collect()], 3, 85)


def test_odd_rows(odd_docs, no_docs):
    got = sorted([tuple(r) for r in minhash.near_duplicates(odd_docs).collect()], key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 3, 85)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(crowd):
    kept = minhash.drop_near_duplicates(crowd, 5, 80)
    assert kept.columns == crowd.columns
    want = brute([(r["doc_id"], r["text"]) for r in crowd.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[3])


def test_rows_go_by_id_and_text(spark):
    """One id in two texts, null ids beside others and alone, equal rows: one row of each group stays."""
    rng = random.Random(31)
    parts = [words(rng, 300) for _ in range(5)]
    text = [" ".join(p) for p in parts]
    near = [" ".join([*p[:-1], "changed"]) for p in parts]
    rows = [(1, text[0]), (5, near[0]), (5, text[1]), (7, text[2]), (None, near[2]), (None, text[3]), (None, near[3]), (8, text[4]), (8, text[4]), (9, None), (9, None)]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(frame).collect()]
    of_nulls = [t for i, t in kept if i is None]
    assert len(of_nulls) == 1 and of_nulls[0] in (text[3], near[3])
    want = [(1, text[0]), (5, text[1]), (7, text[2]), (8, text[4]), (9, None), (9, None)]
    assert sorted([k for k in kept if k[0] is not None], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_trees_give_the_stated_recall_in_crowded_nodes(spark, percent):
    """A pair at the threshold shares the minima of all levels in one of the trees that a row really has."""
    docs = spark.createDataFrame([(1, "some words of a text")], "id bigint, text string")
    row = minhash._sketch(docs, 3, percent).first()
    assert (1 - (percent / 100) ** minhash.LEVELS) ** len(row["nodes"]) <= 1e-5
    assert len(row["minima"]) >= 4 * len(row["nodes"]) * minhash.LEVELS


def vectors(rng, crowds):
    out = []
    for size, spread in crowds:
        centre = rng.standard_normal(16)
        out += [(centre + spread * rng.standard_normal(16)).tolist() for _ in range(size)]
    return out


def brute_vectors(rows, cosine):
    def ready(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    def unit(v):
        v = np.array(v, float)
        v /= np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) if ready(v) else None for _, v in rows]
    alike = lambda a, b: a is not None and b is not None and len(a) == len(b) and float(a @ b) >= cosine
    roots = linked(units, alike)
    low = {}
    for (key, _), root in zip(rows, roots, strict=True):
        low[root] = min((k for k in (low.get(root), key) if k is not None), default=None)
    links = [sum(alike(a, b) for j, b in enumerate(units) if j != i) for i, a in enumerate(units)]
    return sorted([(k, n, low[r], k == low[r]) for (k, _), n, r in zip(rows, links, roots, strict=True)], key=repr)


@pytest.mark.parametrize(("window", "tile"), [(128, 1024), (8, 16)])
def test_vectors_like_brute_force(spark, monkeypatch, window, tile):
    """Crowds larger than the window and than a tile, copies, and vectors that can't be compared."""
    monkeypatch.setattr(embed_dedup, "WINDOW", window)
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    found = vectors(rng, [(150, 0.02), (40, 0.05), (9, 0.1), *[(1, 0.0)] * 100])
    found += found[:3] * 4 + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e300] * 16, [1e-300] * 16]
    rows = [(i if i != 5 else None, v) for i, v in enumerate(found)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS key", "2 AS rank", "3 AS links")
    got = sorted([tuple(r) for r in embed_dedup.near_vectors(frame, recall=0.99999).collect()], key=repr)
    assert got == brute_vectors(rows, 0.9)
    assert embed_dedup.near_vectors(frame.where("false")).count() == 0


def test_recall_on_a_table(spark):
    """All pairs at the limit or above, over a whole table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r["id"]: r["n_links"] for r in embed_dedup.near_vectors(table).collect()}
    found = np.array([got[k] for k, _ in rows])
    assert (found <= close).all() and found.sum() >= 0.99 * close.sum()


def test_passes_grow_slowly():
    assert embed_dedup.passes_for(100, 0.9, 0.99)[0] <= 3
    few, many = embed_dedup.passes_for(10**5, 0.9, 0.99), embed_dedup.passes_for(10**7, 0.9, 0.99)
    assert few[0] < many[0] < 20 * few[0] and many[1] == few[1] + 7


@pytest.mark.parametrize("strangers", [0, 5])
def test_dealt_rows_grow_with_the_crowd(spark, strangers):
    """What a pivot has joined up does not meet itself again: rows dealt are in proportion to the crowd."""
    dealt = []
    for crowd in (1000, 2000, 4000):
        rows = spark.range(crowd + strangers).select(
            F.lit(0).alias("cluster"), F.col("id").alias("c"), F.when(F.col("id") < crowd, F.lit(0)).otherwise(F.col("id")).alias("root")
        )
        blocks = minhash._blocks(rows, ["cluster"])
        dealt.append(blocks.count())
        if strangers:
            meet = blocks.alias("x").join(blocks.alias("y"), ["cluster", "i", "j"]).where(f"x.c >= {crowd} AND x.c <> y.c")
            assert meet.select("x.c", "y.c").distinct().count() == strangers * (crowd + strangers - 1)
    assert dealt[2] <= 4.2 * dealt[0]
    assert bool(dealt[0]) == bool(strangers)
