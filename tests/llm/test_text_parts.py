import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from docs_fixture import DOCS, words
from pyspark.sql import functions as F

from fleetwitness.llm import line_dedup, substring_dedup
from fleetwitness.llm.words import shingles, word_hashes


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_windows_cover_every_span():
    """The smallest token of any long enough span names a window that holds the span."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        values = rng.integers(0, int(rng.integers(2, 60)), int(rng.integers(0, 60))).astype(np.uint64)
        width = int(rng.integers(1, 12))
        places, left, right = substring_dedup.compact_windows(values, width)
        spans = list(zip(places.tolist(), left.tolist(), right.tolist(), strict=True))
        for c, a, b in spans:
            assert values[c - a : c + b + 1].min() == values[c] and a + b + 1 >= width
        assert len({(c - a, c + b, values[c]) for c, a, b in spans}) == len(spans)
        for s in range(len(values) - width + 1):
            for e in range(s + width, len(values) + 1):
                low = values[s:e].min()
                assert any(values[c] == low and c - a <= s and e - 1 <= c + b for c, a, b in spans)


@pytest.fixture(scope="module")
def passages(spark):
    """Passages that repeat exactly or with a changed word, among text of its own."""
    rng = random.Random(5)
    shared = [words(rng, n) for n in (50, 55, 70, 120, 400)]
    rows = []
    for i in range(70):
        text = words(rng, rng.randrange(10, 120), 10**6)
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(shared))
            if len(passage) > 60 and rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = f"changed{i}"
            text += passage + words(rng, rng.randrange(30), 10**6)
        rows.append((i, " ".join(text), "en", "a", 1))
    rows += [(70, " ".join(["again"] * 300), "en", "a", 1), (71, " ".join(shared[0][:49]), "en", "a", 1), (72, " ".join(words(rng, 20) * 12), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


def repeats(rows, length=50):
    """Words inside some run of ``length`` words that another document holds too."""
    texts = {k: (t or "").encode().lower().split() for k, t in rows}
    own = defaultdict(set)
    for k, w in texts.items():
        for a in range(len(w) - length + 1):
            own[tuple(w[a : a + length])].add(k)
    return texts, {k: {i for a in range(len(w) - length + 1) if len(own[tuple(w[a : a + length])]) > 1 for i in range(a, a + length)} for k, w in texts.items()}


def runs(w, size=5):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_passages_like_brute_force(passages):
    rows = [(r["doc_id"], r["text"]) for r in passages.collect()]
    texts, need = repeats(rows)
    found = substring_dedup.repeated_passages(passages).collect()
    flagged = defaultdict(set)
    for r in found:
        a, b = texts[r["id"]][r["start"] :][: r["length"]], texts[r["other_id"]][r["other_start"] :][: r["other_length"]]
        assert len(a) >= 50 and len(b) >= 50 and r["id"] != r["other_id"]
        x, y = runs(a), runs(b)
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
        flagged[r["id"]].update(range(r["start"], r["start"] + r["length"]))
        flagged[r["other_id"]].update(range(r["other_start"], r["other_start"] + r["other_length"]))
    for key, must in need.items():
        assert must <= flagged[key]
    assert not flagged[70] and not flagged[71] and not flagged[72]


def test_windows_of_texts_in_a_row():
    """Many texts at a time give the tokens of each alone, with one border behind each."""
    rng = random.Random(3)
    texts = [" ".join(words(rng, n, 40)) for n in (3, 50, 49, 300, 51, 0, 1000, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    seen = {}
    for docs, begins, tokens, border in substring_dedup._texts_in_a_row(batch, 50):
        assert border.sum() == len(docs) and border[-1]
        for doc, begin, end in zip(docs.tolist(), begins.tolist(), np.nonzero(border)[0].tolist(), strict=True):
            seen[doc] = tokens[begin:end].tolist()
    assert seen == {i: shingles(word_hashes(t), 5).tolist() for i, t in enumerate(texts) if len(t.split()) >= 50}


def test_crowds_in_blocks_like_brute_force(passages, monkeypatch):
    """Tokens of many classes: the first class, then blocks, cover what brute force does."""
    monkeypatch.setattr(substring_dedup, "FEW_CLASSES", 1)
    monkeypatch.setattr(substring_dedup, "CROWD", 4)
    monkeypatch.setattr(substring_dedup, "BLOCK", 3)
    test_passages_like_brute_force(passages)


def test_one_copy_of_each_passage_stays(passages):
    cut = substring_dedup.remove_repeats(passages)
    assert cut.columns == passages.columns and cut.count() == passages.count()
    before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (passages, cut))
    _, need = repeats(after.items())
    assert not any(need.values())
    holders = Counter(run for t in before.values() for run in runs(t.lower().split(), 50))
    still = {run for t in after.values() for run in runs(t.lower().split(), 50)}
    parts = [runs(t.lower().split()) for t in after.values()]
    for run, count in holders.items():  # what several documents held is still there, or with a word changed
        if count > 1:
            assert run in still or max(len(runs(run) & p) for p in parts) >= 46 - 5
    for key, text in after.items():
        if text != before[key]:
            assert set(text.split()) <= set(before[key].split()) and len(text.split()) <= len(before[key].split()) - 50


def test_texts_are_cut_by_one_join(passages):
    """Every text is shuffled once, whether or not it changes."""
    cut = substring_dedup.remove_repeats(passages)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_odd_rows_keep_their_texts(odd_docs, no_docs):
    cut = substring_dedup.remove_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    before, after = (sorted(((r["doc_id"], r["text"]) for r in f.collect()), key=repr) for f in (odd_docs, cut))
    changed = [b for b, a in zip(before, after, strict=True) if a != b]
    assert len(changed) == 1 and changed[0][0] in (9, 10)
    assert substring_dedup.repeated_passages(odd_docs).count() == 1
    assert substring_dedup.repeated_passages(no_docs).count() == substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("others", [5, 150])
def test_passages_around_a_common_line(spark, others):
    """Two documents alone share a passage; most of it is a line that many others hold, too."""
    rng = random.Random(17)
    line = words(rng, 44)
    rows = []
    for i in range(others):
        rows.append((i, " ".join(words(rng, 60, 10**7) + line + words(rng, 60, 10**7)), "en", "a", 1))
    need = {}
    for k in range(20):
        passage = words(rng, 8, 10**7) + line + words(rng, 8, 10**7)
        for i in (1000 + 2 * k, 1001 + 2 * k):
            rows.append((i, " ".join(words(rng, 40, 10**7) + passage + words(rng, 40, 10**7)), "en", "a", 1))
        need[frozenset((1000 + 2 * k, 1001 + 2 * k))] = 60
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {frozenset((r["id"], r["other_id"])): r["length"] for r in found} == need


def test_nearly_equal_passages_are_all_found(spark):
    """300 pairs of passages of 60 words with one changed word, at a similarity of 0.82 to 0.84."""
    rng = random.Random(23)
    rows = []
    for k in range(300):
        passage = words(rng, 60, 10**8)
        changed = [*passage]
        changed[rng.randrange(12, 48)] = f"changed{k}"
        for i, part in enumerate((passage, changed)):
            rows.append((2 * k + i, " ".join(words(rng, 40, 10**8) + part + words(rng, 40, 10**8)), "en", "a", 1))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["id"] // 2 for r in found if r["length"] == 60 and r["id"] // 2 == r["other_id"] // 2} == set(range(300))


def brute_lines(rows, percent):
    places = defaultdict(list)
    for key, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            places[frozenset(w for w in line.split(" ") if w)].append((key is None, key or 0, n, key))
    out = []
    for own, at in places.items():
        near = [min(p) for other, p in places.items() if own and len(own & other) * 100 >= percent * len(own | other)]
        for p in at:
            first = min(near) if near else p
            out.append((p[3], p[2], first[3], first[2], (first[3], first[2]) == (p[3], p[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [10, 1000])
def test_lines_like_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            line = words(rng, rng.randrange(1, 14), 9 if rng.random() < 0.3 else 40)
            lines.append("  ".join(line) if rng.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join([*lines, "the hot line of all"] if i % 3 == 0 else lines), "en", "a", 1))
    got = line_dedup.near_lines(spark.createDataFrame(rows, DOCS))
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_lines([r[:2] for r in rows], 80)


def test_odd_lines(odd_docs, no_docs):
    got = sorted([tuple(r) for r in line_dedup.near_lines(odd_docs).collect()], key=repr)
    assert got == brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 80)
    assert line_dedup.near_lines(no_docs).count() == 0


def test_counts_are_of_all_lines(spark):
    lines = spark.createDataFrame([(0, "a b a"), (1, "a\nc")], "doc_id bigint, text string")
    table = line_dedup.rarity(line_dedup.lines_of(lines, "doc_id", "text"))
    assert sum(spark.range(1).select(table.alias("t")).first()["t"]) == sum(n.bit_length() for n in Counter("abaac").values())


def edited(rng, passage):
    """One to three insertions, deletions or replacements of up to ten words each."""
    out = list(passage)
    for _ in range(rng.randrange(1, 4)):
        at, n, kind = rng.randrange(2, len(out) - 2), rng.randrange(1, 11), rng.randrange(3)
        if kind == 0:
            out[at:at] = words(rng, n, 10**7)
        elif kind == 1:
            del out[at : at + n]
        else:
            out[at : at + n] = words(rng, len(out[at : at + n]), 10**7)
    return out


def planted(seed, count):
    """Pairs of passages of 54 to 140 words at a similarity of 0.8 or more, by the definition itself."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        p = words(rng, rng.randrange(54, 141), 10**7)
        q = edited(rng, p)
        a, b = runs(p), runs(q)
        if len(q) >= 50 and len(a & b) / len(a | b) >= 0.8:
            out.append((p, q))
    return out


def test_passages_with_edits_are_verified():
    """Insertions and replacements in the middle are bridged: of 2,000 similar pairs 99.8 % are found."""
    rng, missed = random.Random(7), 0
    tokens = lambda w: substring_dedup.shingles(substring_dedup.word_hashes([t.encode() for t in w]), 5)
    for p, q in planted(71, 2000):
        x, y = (tokens(words(rng, rng.randrange(5, 60), 10**7) + w + words(rng, rng.randrange(5, 60), 10**7)) for w in (p, q))
        found = substring_dedup.passages(x, y, 46, 0.8)
        for a, b, c, d, j in found:
            mine, theirs = set(x[a : b + 1].tolist()), set(y[c : d + 1].tolist())
            assert j == pytest.approx(len(mine & theirs) / len(mine | theirs)) and j >= 0.8 and min(b - a, d - c) >= 45
        missed += not found
    assert missed <= 4
    middle = words(rng, 45, 10**7), words(rng, 45, 10**7)
    x, y = tokens(middle[0] + middle[1]), tokens(middle[0] + words(rng, 8, 10**7) + middle[1])
    assert substring_dedup.passages(x, y, 46, 0.8)


def test_passages_with_edits_are_found(spark):
    """Windows, hulls and verification together on 250 similar pairs in other text."""
    rng, rows = random.Random(29), []
    pairs = planted(72, 250)
    for k, pair in enumerate(pairs):
        for n, part in enumerate(pair):
            text = words(rng, rng.randrange(30, 80), 10**7) + part + words(rng, rng.randrange(30, 80), 10**7)
            rows.append((2 * k + n, " ".join(text), "en", "a", 1))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    hit = {min(r["id"], r["other_id"]) // 2 for r in found if abs(r["id"] - r["other_id"]) == 1 and min(r["id"], r["other_id"]) % 2 == 0}
    assert len(hit) >= 247 and all(r["id"] // 2 == r["other_id"] // 2 for r in found)


def test_crowds_of_near_copies_give_few_pairs(spark, monkeypatch):
    """A copy is paired with others until they hold what it shares, under all of its tokens together."""
    monkeypatch.setattr(substring_dedup, "FEW_CLASSES", 2)
    rng = random.Random(31)
    base, rows = words(rng, 300, 10**7), []
    for i in range(60):
        rows.append((i, " ".join(w if rng.random() > 0.02 else f"changed{i}" for w in base), "en", "a", 1))
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text", substring_dedup.document_key(F.col("doc_id"), F.col("text")).alias("doc"))
    pairs = substring_dedup._candidates(docs, substring_dedup._windows(docs, 50), 50, 0.8)
    assert 59 <= pairs.count() <= 2000
    assert pairs.select("x").distinct().count() == 59


def kept_tables(monkeypatch):
    """(name, rows, documents, path) of every table that the passages keep between their steps."""
    seen, keep = [], substring_dedup.Steps.keep

    def noted(self, frame, name):
        out = keep(self, frame, name)
        docs = out.select("doc").distinct().count() if "doc" in out.columns else None
        seen.append((name, out.count(), docs, self.paths[name][-1]))
        return out

    monkeypatch.setattr(substring_dedup.Steps, "keep", noted)
    return seen


def test_a_large_crowd_sends_on_what_can_have_a_partner(spark, monkeypatch):
    """A common line in 150 different texts and in 20 pairs of passages: the documents of the pairs alone
    are compared, however many others hold the line, and every pair is found."""
    for name, value in (("FEW_CLASSES", 2), ("CROWD", 8), ("COUNTED", 50)):
        monkeypatch.setattr(substring_dedup, name, value, raising=False)
    seen, rng = kept_tables(monkeypatch), random.Random(41)
    line = words(rng, 30)
    rows = [(i, " ".join(words(rng, 60, 10**7) + line + words(rng, 60, 10**7)), "en", "a", 1) for i in range(150)]
    for k in range(20):
        passage = words(rng, 20, 10**7) + line + words(rng, 20, 10**7)
        rows += [(i, " ".join(words(rng, 40, 10**7) + passage + words(rng, 40, 10**7)), "en", "a", 1) for i in (1000 + 2 * k, 1001 + 2 * k)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {(min(r["id"], r["other_id"]), max(r["id"], r["other_id"])): r["length"] for r in found} == {(1000 + 2 * k, 1001 + 2 * k): 70 for k in range(20)}
    assert [docs for name, _, docs, _ in seen if name == "crowds"] == [40]


def test_steps_of_passages_leave_no_tables(spark, passages, monkeypatch):
    """One cut text a pair is kept, texts go in parts, and only the result stays."""
    monkeypatch.setattr(substring_dedup, "FEW_CLASSES", 1)
    monkeypatch.setattr(substring_dedup, "FEW_ENDS", 0)
    seen = kept_tables(monkeypatch)
    substring_dedup.repeated_passages(passages).collect()
    hulls, cuts = ([n for name, n, *_ in seen if name == wanted] for wanted in ("hulls", "cuts"))
    assert len(hulls) == 1 and len(cuts) > 1 and sum(cuts) == hulls[0] > 0
    assert {name for name, *_, path in seen if os.path.exists(path.removeprefix("file:"))} == {"passages"}


def test_crowds_of_lines_give_few_links(spark, monkeypatch):
    """Near copies of one line are linked with early ones; what is earliest stays that of brute force."""
    links, keep = [], line_dedup.Steps.keep

    def counted(self, frame, name):
        out = keep(self, frame, name)
        if name == "line-links":
            links.append(out.count())
        return out

    monkeypatch.setattr(line_dedup.Steps, "keep", counted)
    rng = random.Random(37)
    base = words(rng, 40, 10**7)
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"changed{i}" for w in base), "en", "a", 1) for i in range(150)]
    got = line_dedup.near_lines(spark.createDataFrame(rows, DOCS))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_lines([r[:2] for r in rows], 80)
    assert links[0] < 10 * len(rows)
