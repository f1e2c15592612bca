"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwitness.llm import (
    bpe,
    conversations,
    embed_dedup,
    exact_dedup,
    langid,
    lexical,
    line_dedup,
    minhash,
    packing,
    substring_dedup,
    token_counts,
    url_filter,
    warc,
)
from fleetwitness.llm.common import reach_package
from fleetwitness.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES: list[url_filter.Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            shared_dir(spark)
            reach_package(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query(
    "op3_exact_dedup",
    r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
""",
)
def op3(table) -> DataFrame:
    return exact_dedup.exact_groups(table("documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


@query("op4_byte_bpe")
def op4(table) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode_texts(table("documents"), path, public_tokenizers.PATTERN, "text", ["doc_id"], decode=True)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_url_filter")
def op6(table) -> DataFrame:
    return url_filter.judge_urls(table("pages"), RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


@query("op7_token_counts")
def op7(table) -> DataFrame:
    return token_counts.count_tokens(table("documents"), public_tokenizers.path("piece_bpe_32k.model"), "text", ["doc_id"])


@query("op8_packing")
def op8(table) -> DataFrame:
    rows = packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op9_language_id")
def op9(table) -> DataFrame:
    rows = langid.language_of(table("documents"), min_margin=0.001)
    return rows.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


@query("op10_minhash_dedup")
def op10(table) -> DataFrame:
    return minhash.near_duplicates(table("documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op2_substring_dedup")
def op2(table) -> DataFrame:
    return substring_dedup.repeated_passages(table("documents")).select(
        F.col("id").alias("doc_id"), "start", "length", F.col("other_id").alias("other_doc_id"), "other_start", "other_length", "similarity"
    )


@query("op1_embedding_dedup")
def op1(table) -> DataFrame:
    return embed_dedup.near_vectors(table("embeddings")).withColumnRenamed("id", "vec_id")


@query("op5_line_dedup")
def op5(table) -> DataFrame:
    return line_dedup.near_lines(table("documents")).select(
        F.col("id").alias("doc_id"), "line", F.col("first_id").alias("first_doc_id"), "first_line", "kept"
    )


TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""


@query(
    "op11_ranked_search",
    f"""
WITH words AS (SELECT doc_id, {TERMS} AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS doc_terms FROM held GROUP BY ALL),
total AS (SELECT count(*) AS all_docs, sum(doc_terms)::BIGINT AS all_terms FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM held GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM dfs, total),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {TERMS} AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
    sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * doc_terms * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
""",
)
def op11(table) -> DataFrame:
    return lexical.search(table("documents"), table("benchmark"), k=20)


@query(
    "op12_warc_round_trip",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, body, octet_length(encode(body)) AS size, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
""",
)
def op12(table) -> DataFrame:
    return warc.archive_round_trip(table("pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


@query(
    "op13_conversation_repair",
    r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations),
drawn AS (
  SELECT raw.*, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d FROM raw, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(k)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
    count(*) OVER (PARTITION BY conv_id) AS n, role[1] AS i FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again,
    lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i AS pair FROM numbered),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
    count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM faults GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS r, {'c': 0, 't': ''} AS e, {'c': 6, 't': 'II'} AS s, {'c': 3, 't': 'I'} AS u, {'c': 0, 't': ''} AS a FROM counts
  UNION ALL
  SELECT conv_id, r,
    list_min([de, {'c': du.c + 3, 't': 'I' || du.t}, {'c': da.c + 6, 't': 'II' || da.t}]),
    list_min([ds, {'c': du.c + 3, 't': 'I' || du.t}, {'c': da.c + 6, 't': 'II' || da.t}]),
    list_min([du, {'c': da.c + 3, 't': 'I' || da.t}]),
    list_min([da, {'c': du.c + 3, 't': 'I' || du.t}])
  FROM (
    SELECT b.conv_id, b.r - 1 AS r,
      list_min([{'c': e.c + 4, 't': 'D' || e.t}, CASE WHEN ok AND i = 's' THEN {'c': s.c + x, 't': 'K' || s.t} END,
        CASE WHEN ok AND i = 'u' THEN {'c': u.c + x, 't': 'K' || u.t} END, CASE WHEN ok THEN {'c': u.c + x + 3, 't': 'R' || u.t} END]) AS de,
      list_min([{'c': s.c + 4, 't': 'D' || s.t}, CASE WHEN ok AND i = 'u' THEN {'c': u.c + x, 't': 'K' || u.t} END,
        CASE WHEN ok THEN {'c': u.c + x + 3, 't': 'R' || u.t} END]) AS ds,
      list_min([{'c': u.c + 4, 't': 'D' || u.t}, CASE WHEN ok AND i = 'a' THEN {'c': a.c + x, 't': 'K' || a.t} END,
        CASE WHEN ok THEN {'c': a.c + x + 3, 't': 'R' || a.t} END]) AS du,
      list_min([{'c': a.c + 4, 't': 'D' || a.t}, CASE WHEN ok AND i = 'u' THEN {'c': u.c + x, 't': 'K' || u.t} END,
        CASE WHEN ok THEN {'c': u.c + x + 3, 't': 'R' || u.t} END]) AS da
    FROM best b JOIN (SELECT *, f NOT IN (1, 2) AS ok, CASE WHEN f = 3 THEN 3 ELSE 0 END AS x FROM faults) w
      ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.r = b.r - 1)),
audits AS (SELECT conv_id, e.c AS cost, e.t AS audit FROM best WHERE r = 1),
edits AS (SELECT conv_id, k, audit[k] AS op, k - length(replace(audit[:k], 'I', '')) AS inserted FROM audits, range(1, length(audit) + 1) AS g(k)),
outs AS (
  SELECT o.conv_id, o.op, w.role, w.text, row_number() OVER (PARTITION BY o.conv_id ORDER BY k) AS p,
    first_value(o.op = 'K' AND w.i = 's') OVER (PARTITION BY o.conv_id ORDER BY k) AS led
  FROM edits o LEFT JOIN faults w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.r = o.k - o.inserted AND o.op <> 'I' WHERE o.op <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (p - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM outs GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
  coalesce(a.audit, '') AS audit, sha256(coalesce(l.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
""",
)
def op13(table) -> DataFrame:
    return conversations.repair_conversations(table("conversations"))
