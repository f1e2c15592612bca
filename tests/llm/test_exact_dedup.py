import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from fleetwitness.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    out = []
    for body, own in groups.items():
        keep = min(own)[3]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(o[3], keep, len(own), o[3] == keep, sha) for o in own]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=repr)


def test_like_brute_force(odd_docs, no_docs):
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert rows_of(exact_dedup.exact_groups(odd_docs)) == want
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_bytes_decide_where_hashes_collide(odd_docs):
    """A hash with two values joins nothing that differs."""
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 32, "0"))
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert rows_of(exact_dedup.exact_groups(odd_docs, content_hash=weak)) == want


def test_one_row_of_each_group_stays(odd_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({w[4] for w in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])})


def test_query_like_its_twin(spark):
    from oracle import compare

    from fleetwitness.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf), sf, sql) == (None, 1000)
