import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from fleetwitness.llm import bpe, packing, token_counts

BYTE, WORD, PIECE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
BITS = ["a", "b", "e", "th", "he", " ", "  ", "\n", "\t", "é", "ß", "漢", "\U0001f600", "'s", "1", "99", "..", "!", " ", "ing", "tion", " the",
        "\x1c", "'ll", "A", "\r\n", "́", "\xa0", "Σ", "<|endoftext|>", "</w>"]


def texts(count, longest=40, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(longest))) for _ in range(count)]


def unpack(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE), special_tokens={})


def test_bpe_like_the_library(tik, monkeypatch):
    own = bpe.Codec(BYTE, P.PATTERN)
    monkeypatch.setattr(bpe, "MOST_STATES", 40)  # forgets all the time
    for text in [*texts(3000), "x" * 3000, " " * 50 + "a", "aaaabaaab" * 99, "กำ" * 40]:
        ids = own.encode(text)
        assert unpack(ids) == tik.encode_ordinary(text), repr(text)
        assert "".join(own.decode(ids, 3)) == text


def test_transducer_like_merges():
    """Small vocabularies full of overlaps, against plain merging."""
    rng = random.Random(8)
    for _ in range(40):
        ranks = {b: i for i, b in enumerate((b"a", b"b", b"c"))}
        for _ in range(rng.randrange(1, 14)):
            new = rng.choice(list(ranks)) + rng.choice(list(ranks))
            if len(new) <= 6 and len(bpe.merge_by_rank(new, ranks)) == 2:  # as trained vocabularies are
                ranks.setdefault(new, len(ranks))
        machine = bpe.Transducer(ranks)
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
            want = [ranks[data]] if data in ranks else [ranks[p] for p in bpe.merge_by_rank(data, ranks)]
            assert machine.encode(data) == want, (ranks, data)


def test_bytes_that_are_no_text():
    own = bpe.codec(BYTE, P.PATTERN)
    ids = [own.machine.ranks[bytes([b])] for b in "é".encode()[:1]]
    assert "".join(own.decode(struct.pack("<1I", *ids))) == "�"


def test_bpe_operator(spark, odd_docs, no_docs, tik):
    rows = bpe.encode_texts(odd_docs, BYTE, P.PATTERN, "text", ["doc_id", "kept"], decode=True)
    got = sorted([(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]).decode(), r["kept"]) for r in rows.collect()], key=repr)
    want = []
    for r in odd_docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], struct.pack(f"<{len(ids)}I", *ids), r["text"] or "", "c"))
    assert got == sorted(want, key=repr)
    back = bpe.decode_ids(rows.withColumn("ids", F.when(F.col("doc_id") != 9, F.col("ids"))), BYTE, P.PATTERN, "ids", ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in back.collect()}[9] == ""
    assert bpe.encode_texts(no_docs, BYTE, P.PATTERN, "text", ["doc_id"]).count() == 0


def test_counts_like_the_library():
    import sentencepiece

    own = token_counts.counter(PIECE)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    entries = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    unigram = models.Unigram(entries, unk_id=0, byte_fallback=True)
    for text in [*texts(2500), "▁ ▁▁a ▁b"]:
        assert own.count(text) == (len(unigram.tokenize("▁" + text.replace(" ", "▁"))) if text else 0), repr(text)


def test_ties_and_unknown_runs_like_the_library():
    entries = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aa", -4.0), ("▁a", -3.0), ("aba", -6.0)]
    unigram = models.Unigram(entries, unk_id=0, byte_fallback=False)
    own, rng = token_counts.Counter(entries[1:], False), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abab xé▁") for _ in range(rng.randrange(14)))
        assert own.count(text) == (len(unigram.tokenize("▁" + text.replace(" ", "▁"))) if text else 0), repr(text)


def test_count_operator(odd_docs, no_docs):
    own = token_counts.counter(PIECE)
    got = sorted([tuple(r) for r in token_counts.count_tokens(odd_docs, PIECE, "text", ["doc_id", "n"]).collect()], key=repr)
    assert got == sorted([(r["doc_id"], "c", own.count(r["text"] or "")) for r in odd_docs.collect()], key=repr)
    assert token_counts.count_tokens(no_docs, PIECE, "text", ["doc_id"]).count() == 0


def test_words_alone_like_the_library():
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    own = packing.WordIds(WORD)
    for text in texts(3000):
        assert unpack(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_patterns_hold_every_rest():
    rng = random.Random(2)
    for size in (8, 64, 2048):
        histogram = {n: rng.randrange(1, 30) for n in rng.sample(range(1, size), min(size - 1, 300))}
        patterns = packing.pack_patterns(dict(histogram), size)
        held = defaultdict(int)
        for pattern, count in patterns:
            assert sum(pattern) <= size
            for length in pattern:
                held[length] += count
        assert held == histogram
        spots = sorted(packing.places(patterns))
        for (a, first, end, *_), (b, next_first, *_) in zip(spots, spots[1:], strict=False):
            assert next_first == (end if a == b else 0) and first < end


def check_packing(rows, docs, size):
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] * 4 == len(r["ids"]) > 0
    for r in sequences.values():
        at = 0
        for piece in sorted(r, key=lambda p: p["offset"]):
            assert piece["offset"] == at
            at += piece["length"]
        assert at <= size
    for key, pieces in by_doc.items():
        mine = [ids for none, k, ids in want if (None if none else k) == key]
        assert sorted(zlib.crc32(bytes(p["ids"])) for p in pieces) == sorted(
            zlib.crc32(struct.pack(f"<{len(ids[a : a + size])}I", *ids[a : a + size])) for ids in mine for a in range(0, len(ids), size)
        )
        assert sorted(p["start"] for p in pieces) == sorted(a for ids in mine for a in range(0, len(ids), size))
        assert {p["doc_tokens"] for p in pieces} == {len(ids) for ids in mine}
    return sum(p["length"] for p in rows), len(sequences)


def test_pack_operator(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)  # many cells
    rows = packing.pack(odd_docs, WORD, size=64).collect()
    check_packing(rows, odd_docs.collect(), 64)
    assert packing.pack(no_docs, WORD, size=64).count() == 0


def test_pack_a_table_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens, sequences = check_packing(packing.pack(docs, WORD).collect(), docs.collect(), 2048)
    assert tokens / (sequences * 2048) > 0.98


def test_queries_give_the_digests(spark, tik):
    from fleetwitness.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts_by_id = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_byte_bpe"](spark, sf).collect():
        ids = tik.encode_ordinary(texts_by_id[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts_by_id[r["doc_id"]].encode()).hexdigest()
    own = token_counts.counter(PIECE)
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        assert r["n_tokens"] == own.count(texts_by_id[r["doc_id"]])
