import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from docs_fixture import DOCS
from pyspark.sql import functions as F

from fleetwitness.llm import langid, url_filter
from fleetwitness.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.01"


def host_path(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


class Model:
    """Witten-Bell interpolation, straight from counts."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            for gram in grams(text):
                for k in range(5):
                    self.seen[gram[4 - k : 4]][gram[4]] += 1

    def p(self, gram):
        p = 1 / 65536
        for k in range(5):
            own = self.seen.get(gram[4 - k : 4])
            if own:
                p = (own[gram[4]] + len(own) * p) / (sum(own.values()) + len(own))
        return p


def grams(text):
    padded = "\x02" * 4 + text + "\x03"
    return [padded[i : i + 5] for i in range(len(text) + 1)]


def brute(spark, rows):
    fold = {r["u"]: r["f"] for r in spark.createDataFrame([(u or "",) for _, u in rows], "u string").selectExpr("u", "pmod(xxhash64(u), 5) f").collect()}
    texts = [u or "" for _, u in rows]
    ruled = [rule_of(*host_path(t)) for t in texts]
    models = {v: Model([t for t, r in zip(texts, ruled, strict=True) if r and r[0] == v and fold[t]]) for v in ("allow", "block")}
    score = {t: round(sum(math.log(models["allow"].p(g)) - math.log(models["block"].p(g)) for g in grams(t)) / len(grams(t)), 9) for t in texts}
    bins = defaultdict(lambda: [0, 0])
    for t, r in zip(texts, ruled, strict=True):
        if r and not fold[t]:
            bins[max(-1000, min(1000, math.floor(score[t] / 0.01)))][r[0] == "block"] += 1
    limit = url_filter.threshold([(b, *n) for b, n in bins.items()])
    out = []
    for (key, _), t, r in zip(rows, texts, ruled, strict=True):
        out.append((key, *host_path(t), r[1] + r[2] if r else None, r[0] if r else "allow" if score[t] >= limit else "block", score[t]))
    return out


def test_urls_like_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    rows = [tuple(p) for p in pages] + [
        (1001, None), (1002, ""), (None, "no scheme"), (1003, "http://A.Example.NET/en/x"), (1003, "http://A.Example.NET/en/x"),
        (1004, "http://example.net?en/"), (1005, "x://net/"), (1006, "x://net"), (1007, "http://Äe.org/fr/é\n#"), (1008, "http://aexample.net/en/"),
        (1009, "a://b://c/d"), (1010, "http://x.com/" + "y" * 30_000), (1011, "://"), (1012, "http://example.com/de"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'c' AS rule", "1 AS gram", "2 AS n", "3 AS host")
    result = url_filter.judge_urls(frame, RULES)
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = sorted([tuple(r) for r in result.collect()], key=repr)
    want = sorted(brute(spark, rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-6)
    assert url_filter.judge_urls(frame.where("false"), RULES).count() == 0


def test_without_training_urls_the_rest_is_allowed(spark):
    frame = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/de/")], "page_id bigint, url string")
    assert {r["verdict"] for r in url_filter.judge_urls(frame, RULES).collect()} == {"allow"}


def test_a_filter_learns_a_pattern(spark):
    """Unruled URLs like the blocked ones are blocked, those like the allowed ones allowed."""
    rng = random.Random(2)
    name = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    rows = [(i, f"http://{name('abcde')}.org/fr/{name('abcde')}") for i in range(300)]
    rows += [(300 + i, f"http://{name('vwxyz')}.net/{name('vwxyz')}") for i in range(300)]
    rows += [(600 + i, f"http://{name('abcde')}.com/{name('abcde')}") for i in range(40)] + [(640 + i, f"http://{name('vwxyz')}.com/{name('vwxyz')}") for i in range(40)]
    got = {r["id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    assert sum(got[i] == "allow" for i in range(600, 640)) >= 38 and sum(got[i] == "block" for i in range(640, 680)) >= 38


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(odd_docs, no_docs):
    got = langid.language_of(odd_docs).collect()
    for r in got:
        if r["id"] in (1, 2, 3, 7):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        else:
            assert r["lang_pred"] in ("en", "fr", "de")
    assert len(got) == odd_docs.count() and langid.language_of(no_docs).count() == 0
    kept = langid.identify(odd_docs, {}, "text", odd_docs.columns, names=("p", "q", "r"))
    assert {r["p"] for r in kept.collect()} == {"und"} and kept.columns[: len(odd_docs.columns)] == odd_docs.columns


def test_languages_like_plain_compression(spark):
    """Prediction, score and rejection as by a plain loop over the same dictionaries."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = docs.where(~langid.held_out("doc_id"))
    learned = langid.fit_dictionaries(usable, "doc_id", "text", "lang")
    # The sample itself: the rows of least hash of each language.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(langid.HASH_PLACES))
    ranks = {}
    for lang, _ in sorted((r["lang"], r["h"]) for r in usable.where("text <> '' AND lang IS NOT NULL").select("lang", place.alias("h")).collect()):
        ranks[lang] = min(400, ranks.get(lang, 0) + 1)
    assert sorted(learned) == sorted(ranks)
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    for row in docs.limit(60).collect():
        text = langid.letters(row["text"] or "")
        sizes = []
        for lang, content in learned.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(content), source_size=65536, write_content_size=False, write_checksum=False, write_dict_id=False)
            data.precompute_compress(compression_params=params)
            plain = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
            sizes.append((sum(len(plain.compress(text[i : i + 65536])) for i in range(0, len(text), 65536)), lang))
        sizes.sort()
        found = got[row["doc_id"]]
        if text.strip() and sizes[0][0] < sizes[1][0]:
            assert found["lang_pred"] == sizes[0][1] and found["score"] == pytest.approx(1 - sizes[0][0] / sizes[1][0])
            assert found["rejected"] == (found["score"] < 0.001)


def test_ties_and_margins():
    learned = {"a": b"the quick brown fox jumps over the lazy dog " * 20, "b": b"le vif renard brun saute par dessus le chien " * 20}
    sizes = langid.Sizes(learned)
    assert sizes.best("the quick brown dog jumps over the fox")[0] == "a" and sizes.best("le renard saute dessus")[0] == "b"
    assert sizes.best("THE LAZY fox!!")[0] == "a"
    assert langid.Sizes({"a": learned["a"], "b": learned["a"]}).best("quick fox") == ("a", 0.0)
    assert langid.Sizes({"a": learned["a"]}).best("quick") == ("a", 1.0)


def test_labels_of_held_out_rows_teach_nothing(spark):
    """Wrong labels on held-out rows change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    a, b = ({r["id"]: (r["lang_pred"], r["score"]) for r in langid.language_of(d).collect()} for d in (docs, lied))
    assert a == b


def test_schema_of_documents_is_the_fixture(spark):
    assert spark.read.parquet(f"{SF}/documents.parquet").columns == [c.split()[0] for c in DOCS.split(", ")]
