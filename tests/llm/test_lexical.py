import math
import random
import re
from collections import Counter

import pytest
from docs_fixture import words

from fleetwitness.llm import lexical

ITEMS = "item_id bigint, text string"


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k):
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.fixture(scope="module")
def crowd(spark):
    """Common and rare words, copies of one text, and ties."""
    rng = random.Random(5)
    rows = [(n, " ".join(rng.choices(words(rng, 400, 300), k=rng.randrange(1, 120)))) for n in range(400)]
    rows += [(1000 + n, "W1 w2, w3! é-ß w2") for n in range(120)] + [(2000, None), (2001, "... --"), (None, "w1 w2 w3"), (2002, "w7 " * 3000)]
    items = [(n, " ".join(words(rng, rng.randrange(1, 40), 300))) for n in range(25)]
    items += [(100, "w1 w1 W1 é"), (101, "absent words only here"), (102, None), (103, ""), (104, "w2 w3"), (104, "w2 w3"), (None, "w7")]
    return rows, items


@pytest.mark.parametrize("part", [(60_000, 20_000), (300, 20_000), (60_000, 7)])
def test_like_brute_force(spark, crowd, monkeypatch, part):
    rows, items = crowd
    monkeypatch.setattr(lexical, "PART_POSTINGS", part[0])
    monkeypatch.setattr(lexical, "PART_DOCS", part[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, ITEMS)
    assert rows_of(lexical.search(docs, asked, k=5)) == brute(rows, items, 5)


def test_items_in_several_blocks(spark, crowd):
    rows, items = crowd
    docs, asked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)
    assert rows_of(lexical.search(docs, asked, k=20, block_terms=250)) == brute(rows, items, 20)


def test_accumulators_are_limited_and_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    stopped = 0
    for _ in range(200):
        docs = 300
        sizes = sorted(rng.integers(1, 200, 6).tolist())
        lists = [(rng.choice(docs, n, replace=False), rng.integers(1, 4000 // n + 2, n)) for n in sizes]
        whole = np.zeros(docs, np.int64)
        for d, g in lists:
            whole[d] += g
        got = np.zeros(docs, np.int64)
        met = lexical.limited_scores(lists, [int(g.max()) for _, g in lists], got, 3, 0)
        kth = np.sort(whole)[-3]
        assert set(np.flatnonzero(whole >= max(kth, 1))) <= set(met) and (got[met] == whole[met]).all()
        stopped += len(met) < (whole > 0).sum()
    assert stopped > 50


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w1 w2 42 same"), (2, "漢 é ü alone HERE")], ITEMS)
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert want and rows_of(lexical.search(odd_docs, items)) == want
    assert rows_of(lexical.search(no_docs, items)) == [] == rows_of(lexical.search(odd_docs, items.where("false")))


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(words(random.Random(2), 5000)).encode()
    monkeypatch.setattr(lexical, "CHUNK", 100)
    parts = list(lexical.terms_of(text))
    assert len(parts) > 100 and [t for p in parts for t in p] == text.split()


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r["rank"], r["doc_id"]) for r in lexical.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


