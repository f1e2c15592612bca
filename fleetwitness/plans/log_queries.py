"""Log queries: S2, S3, F1–F5, A1, A2, A14, A16, A22, W10–W13, W16–W19, J4, J23."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators import adjudicate as judge
from fleetwitness.operators import logs
from fleetwitness.plans.registry import query
from fleetwitness.plans.standins import (
    BASE_TS,
    BOOT_LINES,
    DOC_EXPECTATIONS,
    DOC_FORBIDDEN,
    DOC_LINES,
    HOUR_US,
    boot_log,
    doc_expectations,
    doc_forbidden,
    doc_lines,
    doc_runs,
    k_of,
)
from fleetwitness.sources.logs import carry_stamp, parse_log_line, with_offsets

MATCHES = f"WITH {DOC_LINES}, {DOC_EXPECTATIONS}"
NUMBER = "regexp_extract(text, '([0-9]+)', 1)"


def doc_run_exp(t):
    return logs.run_expectations(doc_runs(t), doc_expectations(t))


def doc_matches(t):
    return logs.match_tokens(doc_lines(t), doc_runs(t), doc_expectations(t))


@query(
    "s2_parse_log_line",
    f"""WITH {BOOT_LINES} SELECT boot_id, idx, byte_off, tod_ms, 'w-' || boot_id AS thread,
      CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS level, 'bench.Events' AS logger, event_type AS token,
      CAST(event_id AS VARCHAR) AS pair_id FROM (SELECT * REPLACE (CAST(byte_off AS BIGINT) AS byte_off) FROM boot_log)""",
)
def parse_lines(t):
    out = parse_log_line(boot_log(t).select("boot_id", "idx", "byte_off", "text"))
    return out.select(
        "boot_id", "idx", "byte_off", F.col("tod_ms").cast("bigint"), "thread", "level", "logger", "token",
        F.col("kv")["id"].alias("pair_id"),
    )


@query(
    "s3_carry_stamp",
    f"""WITH {BOOT_LINES} SELECT boot_id, idx,
      last_value(tod_ms IGNORE NULLS) OVER (PARTITION BY boot_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS carried_ms
    FROM boot_log""",
)
def carried(t):
    out = carry_stamp(parse_log_line(boot_log(t).select("boot_id", "idx", "text")))
    return out.select("boot_id", "idx", F.col("carried_ms").cast("bigint"))


@query("f1_match_tokens", f"{MATCHES} SELECT run_id, i, idx FROM hits")
def match_tokens(t):
    return doc_matches(t).select("run_id", "i", "idx")


@query(
    "f1_large_catalogue",
    f"""WITH {DOC_LINES}, ends AS (
      SELECT doc_id AS i, lang AS scenario, left(text, 12) AS a, right(text, 12) AS b, left(text, 2) AS c FROM documents)
    SELECT l.run_id, e.i, l.idx FROM lines l JOIN ends e ON l.scenario = e.scenario
    WHERE (contains(l.text, e.a) OR contains(l.text, e.b)) AND contains(l.text, e.c)""",
)
def match_large_catalogue(t):
    """As many expectations as documents: their first and last characters, wherever a line has them."""
    expectations = t.documents.select(
        F.col("lang").alias("scenario"), F.col("doc_id").alias("i"), F.array(F.expr("left(text, 12)"), F.expr("right(text, 12)")).alias("tokens"),
        F.array(F.expr("left(text, 2)")).alias("same_line"),
    )
    return logs.match_tokens(doc_lines(t), doc_runs(t), expectations).select("run_id", "i", "idx")


@query(
    "f2_scope_to_window",
    f"""WITH {DOC_LINES} SELECT l.run_id, l.idx, CAST(l.byte_off AS BIGINT) AS byte_off
    FROM lines l JOIN documents d ON l.run_id = d.doc_id WHERE l.byte_off >= d.n_chars // 2""",
)
def scope_to_window(t):
    markers = t.documents.select(
        F.col("doc_id").alias("run_id"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("seq"), F.lit(0).cast("bigint").alias("log_offset")),
            F.struct(F.lit(1).alias("seq"), F.floor(F.col("n_chars") / 2).alias("log_offset")),
        )).alias("m"),
    ).select("run_id", "m.*")
    return logs.scope_to_window(with_offsets(doc_lines(t), ["run_id"]), markers).select("run_id", "idx", "byte_off")


START_MS = 64_800_000  # 18:00:00
CAP = 20
TIMED = f"""begins AS (
  SELECT boot_id, min(idx) FILTER (tod_ms IS NOT NULL AND (tod_ms // 1000 - {START_MS // 1000} + 86400) % 86400 <= 43200) AS b
  FROM boot_log GROUP BY boot_id),
kept AS (
  SELECT l.*, count(*) OVER (PARTITION BY l.boot_id) AS total, row_number() OVER (PARTITION BY l.boot_id ORDER BY idx DESC) AS back
  FROM boot_log l JOIN begins USING (boot_id) WHERE idx >= b)"""


def parsed_boot_log(t):
    return parse_log_line(boot_log(t).select("boot_id", "idx", "byte_off", "text", "observed_at")).withColumnRenamed(
        "boot_id", "run_id"
    )


def boot_runs(t):
    return t.events.select(F.col("user_id").alias("run_id")).distinct().withColumn("start_ms", F.lit(START_MS))


@query(
    "f3_time_of_day_slice",
    f"""WITH {BOOT_LINES}, {TIMED} SELECT boot_id AS run_id, idx, total,
      CASE WHEN total > {CAP} THEN 'time window, last {CAP} of ' || total || ' lines' ELSE 'time window' END AS label
    FROM kept WHERE back <= {CAP}""",
)
def time_of_day_slice(t):
    return logs.time_of_day_slice(parsed_boot_log(t), boot_runs(t), cap=CAP).select("run_id", "idx", "total", "label")


@query(
    "f4_evidence_slice",
    f"""WITH {BOOT_LINES}, {TIMED},
    marks AS (SELECT boot_id, max_by(byte_off, idx) AS log_offset FROM boot_log
              WHERE event_type = 'signup' AND value >= 60 GROUP BY boot_id)
    SELECT l.boot_id AS run_id, l.idx, 'window' AS tier, 'window' AS label FROM boot_log l JOIN marks m USING (boot_id) WHERE l.byte_off >= m.log_offset
    UNION ALL
    SELECT boot_id, idx, 'time-window', CASE WHEN total > {CAP} THEN 'time window, last {CAP} of ' || total || ' lines' ELSE 'time window' END
    FROM kept WHERE back <= {CAP} AND boot_id NOT IN (SELECT boot_id FROM marks)""",
)
def evidence_slice(t):
    marked = boot_log(t).where((F.col("event_type") == "signup") & (F.col("value") >= 60))
    markers = marked.select(
        F.col("boot_id").alias("run_id"), F.col("idx").alias("seq"), F.col("byte_off").alias("log_offset")
    )
    return logs.evidence_slice(parsed_boot_log(t), boot_runs(t), markers, cap=CAP).select("run_id", "idx", "tier", "label")


@query(
    "f5_health_tokens",
    f"""WITH {BOOT_LINES}, marked AS (
      SELECT boot_id, idx, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'health' END AS family FROM boot_log
      WHERE event_type IN ('click', 'view', 'error')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY boot_id, family ORDER BY idx DESC) AS r FROM marked)
    SELECT boot_id, idx, family FROM ranked WHERE r <= CASE family WHEN 'health' THEN 20 ELSE 10 END""",
)
def health_tokens(t):
    return logs.health_tokens(boot_log(t), health=("click:", "view:"), failure=("error:",)).select(
        "boot_id", "idx", "family"
    )


@query(
    "a1_at_least",
    f"""{MATCHES}, seen AS (SELECT run_id, i, count(*) AS n FROM hits GROUP BY run_id, i)
    SELECT d.doc_id AS run_id, e.i, coalesce(s.n, 0) AS seen, coalesce(s.n, 0) >= e.need AS ok,
      'saw ' || coalesce(s.n, 0) || '/' || e.need AS progress
    FROM documents d JOIN exp e ON d.lang = e.scenario LEFT JOIN seen s ON s.run_id = d.doc_id AND s.i = e.i""",
)
def at_least(t):
    return logs.at_least(doc_matches(t), doc_run_exp(t)).select("run_id", "i", "seen", "ok", "progress")


@query(
    "a2_extract_min",
    f"""{MATCHES}, last_hit AS (
      SELECT run_id, i, count(*) AS seen, max(idx) AS idx, max_by(text, idx) AS text FROM hits WHERE i = 2 GROUP BY run_id, i)
    SELECT run_id, i, seen, idx, nullif({NUMBER}, '') AS value,
      coalesce(TRY_CAST({NUMBER} AS BIGINT) >= 3, false) AS ok FROM last_hit""",
)
def extract_min(t):
    return logs.extract_min(doc_matches(t)).select("run_id", "i", "seen", "idx", "value", "ok")


@query(
    "w10_first_observed",
    f"""{MATCHES}, tok AS (SELECT h.run_id, h.idx, h.text, unnest(e.tokens) AS token
      FROM hits h JOIN exp e ON h.i = e.i AND e.scenario = 'en')
    SELECT run_id, token, min(idx) AS after_s FROM tok WHERE contains(text, token) GROUP BY run_id, token""",
)
def first_observed(t):
    base = micros(F.lit(BASE_TS).cast("timestamp"))
    out = logs.first_observed(doc_matches(t))
    return out.select("run_id", "token", ((micros(F.col("m_observed")) - base) / 1_000_000).cast("bigint").alias("after_s"))


@query(
    "w11_nth_match",
    f"""{MATCHES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, i ORDER BY idx) AS r FROM hits)
    SELECT run_id, i, idx FROM ranked WHERE r = need""",
)
def nth_match(t):
    return logs.nth_match(doc_matches(t), logs.needs(doc_expectations(t))[0]).select("run_id", "i", "idx")


# Runs on the event stream: one user day, three ordered expectations, two forbidden kinds.
H6, H12 = 6 * HOUR_US, 12 * HOUR_US
DAY_RUNS = f"""WITH lines AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS run_id, event_id AS idx, event_type, epoch_us(ts) AS us,
    epoch_us(date_trunc('day', ts)) AS t0 FROM events),
days AS (SELECT run_id, min(t0) AS t0, dayofweek(make_timestamp(min(t0))) IN (0, 6) AS weekend FROM lines GROUP BY run_id),
runs AS (SELECT run_id, t0, CASE WHEN weekend THEN {H12} ELSE {10 * HOUR_US} END AS w0, {H12} AS w1,
  CASE WHEN weekend THEN {H6} ELSE {8 * HOUR_US} END AS w2 FROM days),
k0 AS (SELECT run_id, min_by(us, idx) AS m, min(idx) AS idx FROM lines WHERE event_type IN ('click', 'view') GROUP BY run_id),
k1 AS (SELECT run_id, us AS m, idx FROM (
  SELECT run_id, us, idx, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS r FROM lines WHERE event_type IN ('view', 'purchase', 'click')) WHERE r = 2),
k2 AS (SELECT run_id, min_by(us, idx) AS m, min(idx) AS idx FROM lines WHERE event_type = 'signup' GROUP BY run_id)"""


def day_scenario(day):
    return F.when(F.dayofweek(day).isin(1, 7), "weekend").otherwise("weekday")


def day_expectations(t, form=("", [])):
    """Three ordered expectations per kind of day; ``form`` is the token's end and the same-line text."""
    end, same = form
    rows = []
    for scenario, first, third in (("weekday", 36_000, 28_800), ("weekend", 43_200, 21_600)):
        rows.append((scenario, 0, [f"click{end}", f"view{end}"], [], 1, None, None, first))
        rows.append((scenario, 1, [f"view{end}", f"purchase{end}", f"click{end}"], same, 2, None, None, 43_200))
        rows.append((scenario, 2, [f"signup{end}"], [], 1, None, None, third))
    return t.rows(
        "scenario STRING, i INT, tokens ARRAY<STRING>, same_line ARRAY<STRING>, need INT, extract STRING, "
        "min_value BIGINT, within_s INT",
        *rows,
    )


@query(
    "w12_adjudicate",
    f"""{DAY_RUNS},
    timed AS (
      SELECT r.run_id, r.t0, k0.m AS m0, k1.m AS m1, k2.m AS m2, k0.idx AS x0, k1.idx AS x1, k2.idx AS anchor,
        r.t0 + w0 AS d0, greatest(r.t0, coalesce(k0.m, r.t0)) + w1 AS d1,
        greatest(r.t0, coalesce(k0.m, r.t0), coalesce(k1.m, r.t0)) + w2 AS d2
      FROM runs r LEFT JOIN k0 USING (run_id) LEFT JOIN k1 USING (run_id) LEFT JOIN k2 USING (run_id)),
    ended AS (
      SELECT *, CASE WHEN NOT coalesce(m0 <= d0, false) THEN 0 WHEN NOT coalesce(m1 <= d1, false) THEN 1
                     WHEN NOT coalesce(m2 <= d2, false) THEN 2 END AS failed_i FROM timed),
    bounds AS (
      SELECT *, CASE failed_i WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE greatest(m0, m1, m2) END AS end_us FROM ended),
    bad AS (
      SELECT l.run_id, l.us, l.idx, 0 AS j, 'error:' AS token FROM lines l JOIN bounds b USING (run_id)
      WHERE l.event_type = 'error' AND failed_i IS NULL AND l.idx > b.anchor AND l.us <= b.end_us
      UNION ALL
      SELECT l.run_id, l.us, l.idx, 1, '"k": 13' FROM lines l JOIN bounds b USING (run_id) JOIN events e ON e.event_id = l.idx
      WHERE contains(e.props, '"k": 13') AND l.us <= b.end_us),
    hit AS (SELECT run_id, min(us) AS us, min_by(idx, (us, j, idx)) AS idx, min_by(token, (us, j, idx)) AS token FROM bad GROUP BY run_id)
    SELECT b.run_id, CASE WHEN h.us IS NOT NULL OR failed_i IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN h.us IS NOT NULL THEN 'forbidden hit: ' || h.token WHEN failed_i IS NOT NULL THEN 'expected-not-seen: line ' || failed_i
           ELSE '3/3 positive · 0 forbidden' END AS reason,
      CASE WHEN h.us IS NULL THEN failed_i END AS failed_i, h.idx AS forbidden_idx,
      CASE failed_i WHEN 0 THEN NULL WHEN 1 THEN x0 WHEN 2 THEN greatest(x0, x1) ELSE greatest(x0, x1, anchor) END AS last_idx,
      coalesce(h.us, end_us) - t0 AS decided_after_us
    FROM bounds b LEFT JOIN hit h USING (run_id)""",
)
def adjudicate(t):
    lines = t.events.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").alias("idx"),
        F.col("ts").alias("observed_at"),
        F.concat_ws(": ", "event_type", "props").alias("text"),
    )
    runs = lines.groupBy("run_id").agg(F.min(F.date_trunc("day", "observed_at")).alias("t0")).select(
        "run_id", day_scenario(F.col("t0")).alias("scenario"), "t0"
    )
    forbidden = t.rows(
        "scenario STRING, j INT, token STRING, after_token STRING",
        *[(s, *f) for s in ("weekday", "weekend") for f in ((0, "error:", "signup:"), (1, '"k": 13', None))],
    )
    expectations = day_expectations(t, (":", ["k"]))
    return judge.adjudicate(runs, expectations, forbidden, lines).drop("scenario")


# The second line of a run is an API line: purchases are reads of a command's phase. Below 10
# the read fails, from 50 on the phase is terminal, and an odd number is a wrong phase.
MIXED = f"""{DAY_RUNS},
reads AS (
  SELECT run_id, idx, us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM lines l JOIN events e ON e.event_id = l.idx WHERE l.event_type = 'purchase'),
said AS (SELECT run_id, min_by(us, idx) AS us, min_by(k % 2, idx) AS odd FROM reads WHERE k >= 50 GROUP BY run_id),
timed AS (
  SELECT r.run_id, r.t0, k0.m AS m0, CASE WHEN odd = 0 THEN s.us END AS m1, CASE WHEN odd = 1 THEN s.us END AS wrong, k2.m AS m2,
    k0.idx AS x0, k2.idx AS x2, r.t0 + w0 AS d0, greatest(r.t0, coalesce(k0.m, r.t0)) + w1 AS d1,
    greatest(r.t0, coalesce(k0.m, r.t0), coalesce(CASE WHEN odd = 0 THEN s.us END, r.t0)) + w2 AS d2
  FROM runs r LEFT JOIN k0 USING (run_id) LEFT JOIN said s USING (run_id) LEFT JOIN k2 USING (run_id)),
ended AS (
  SELECT *, CASE WHEN NOT coalesce(m0 <= d0, false) THEN 0 WHEN NOT coalesce(m1 <= d1, false) THEN 1
                 WHEN NOT coalesce(m2 <= d2, false) THEN 2 END AS failed_i FROM timed)"""


def day_lines(t):
    return t.events.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_id").alias("idx"),
        F.col("ts").alias("observed_at"), F.concat_ws(": ", "event_type", "props").alias("text"), "event_type", "props",
    )


def mixed_parts(t):
    """(runs, expectations, log lines, API reads) of the mixed scenarios."""
    lines = day_lines(t)
    runs = lines.groupBy("run_id").agg(F.min(F.date_trunc("day", "observed_at")).alias("t0")).select(
        "run_id", day_scenario(F.col("t0")).alias("scenario"), "t0"
    )
    check = "ARRAY<STRUCT<name: STRING, field: STRING, value: STRING, type: STRING, ids: ARRAY<STRING>, n: INT>>"
    asserts = [("phase_terminal", None, "CONFIRMED", None, None, None), ("field_equals", "data.kind", "command", "string", None, None)]
    rows = []
    for scenario, first, third in (("weekday", 36_000, 28_800), ("weekend", 43_200, 21_600)):
        rows.append((scenario, 0, "log", ["click:", "view:"], [], 1, None, None, first, None))
        rows.append((scenario, 1, "api", None, None, 1, None, None, 43_200, asserts))
        rows.append((scenario, 2, "log", ["signup:"], [], 1, None, None, third, None))
    catalogue = t.rows(
        "scenario STRING, i INT, kind STRING, tokens ARRAY<STRING>, same_line ARRAY<STRING>, need INT, extract STRING, "
        f"min_value BIGINT, within_s INT, asserts {check}",
        *rows,
    )
    k = k_of(F.col("props"))
    phase = F.when(k % 2 == 0, "CONFIRMED").otherwise("TIMED_OUT")
    data = F.struct((k >= 50).alias("terminal"), phase.alias("currentPhase"), F.lit("command").alias("kind"))
    reads = lines.where("event_type = 'purchase'").select(
        "run_id", F.lit(1).alias("i"), F.col("idx").alias("poll_seq"), "observed_at", F.when(k < 10, 503).otherwise(200).alias("status"),
        F.to_json(F.struct(data.alias("data"))).alias("body"), F.lit(None).cast("string").alias("run_state"),
    )
    return runs, catalogue, lines.drop("event_type", "props"), reads


@query(
    "w12_adjudicate_mixed",
    f"""{MIXED},
    bounds AS (
      SELECT *, CASE failed_i WHEN 0 THEN d0 WHEN 1 THEN least(d1, coalesce(wrong, d1)) WHEN 2 THEN d2 ELSE greatest(m0, m1, m2) END AS end_us FROM ended),
    bad AS (
      SELECT l.run_id, l.us, l.idx FROM lines l JOIN bounds b USING (run_id)
      WHERE l.event_type = 'error' AND failed_i IS NULL AND l.idx > b.x2 AND l.us <= b.end_us),
    hit AS (SELECT run_id, min(us) AS us, min_by(idx, (us, idx)) AS idx FROM bad GROUP BY run_id)
    SELECT b.run_id, CASE WHEN h.us IS NOT NULL OR failed_i IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN h.us IS NOT NULL THEN 'forbidden hit: error:' WHEN failed_i IS NOT NULL THEN 'expected-not-seen: line ' || failed_i
           ELSE '3/3 positive · 0 forbidden' END AS reason,
      CASE WHEN h.us IS NULL THEN failed_i END AS failed_i, h.idx AS forbidden_idx,
      CASE WHEN failed_i = 0 THEN NULL WHEN failed_i IN (1, 2) THEN x0 ELSE greatest(x0, x2) END AS last_idx,
      coalesce(h.us, end_us) - t0 AS decided_after_us
    FROM bounds b LEFT JOIN hit h USING (run_id)""",
)
def adjudicate_mixed(t):
    """Log, API, log: each clock starts when the line before was met."""
    runs, catalogue, lines, reads = mixed_parts(t)
    forbidden = t.rows(
        "scenario STRING, j INT, token STRING, after_token STRING", *[(s, 0, "error:", "signup:") for s in ("weekday", "weekend")]
    )
    return judge.adjudicate(runs, catalogue, forbidden, lines, reads=reads).drop("scenario")


@query(
    "w12_line_results",
    f"""{MIXED}
    SELECT run_id, v.i, CASE WHEN failed_i IS NULL OR v.i < failed_i THEN '[ok]' WHEN v.i = failed_i THEN '[X]' ELSE '[ ]' END AS mark,
      CASE v.i WHEN 0 THEN x0 WHEN 2 THEN x2 END AS idx, CASE v.i WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END - t0 AS after_us,
      CASE v.i WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END - t0 AS deadline_after_us
    FROM ended, (VALUES (0), (1), (2)) v(i)""",
)
def line_results(t):
    runs, catalogue, lines, reads = mixed_parts(t)
    return judge.line_results(judge.check_lines(runs, catalogue, lines, reads)).drop("scenario")


@query(
    "w13_adjudicate_window",
    f"""{MATCHES}, {DOC_FORBIDDEN},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, i ORDER BY idx) AS r FROM hits),
    per AS (
      SELECT run_id, i, count(*) AS seen, max(idx) FILTER (r = need) AS nth_idx, max(idx) AS last_idx,
        max_by(text, idx) AS text FROM ranked GROUP BY run_id, i),
    checked AS (
      SELECT d.doc_id AS run_id, e.i, e.need, coalesce(p.seen, 0) AS seen,
        CASE WHEN e.i = 2 THEN last_idx ELSE nth_idx END AS idx,
        coalesce(p.seen, 0) >= e.need AND (e.i <> 2 OR coalesce(TRY_CAST({NUMBER.replace('text', 'p.text')} AS BIGINT) >= 3, false)) AS ok
      FROM documents d JOIN exp e ON d.lang = e.scenario LEFT JOIN (SELECT run_id AS rid, * EXCLUDE (run_id) FROM per) p
        ON p.rid = d.doc_id AND p.i = e.i),
    anchor AS (SELECT run_id, idx FROM checked WHERE i = 0 AND ok),
    bad AS (
      SELECT l.run_id, f.j, l.idx FROM lines l CROSS JOIN forb f LEFT JOIN anchor a ON a.run_id = l.run_id
      WHERE contains(l.text, f.token) AND (f.after_token IS NULL OR l.idx > a.idx)),
    hit AS (SELECT run_id, min(j) AS j, min_by(idx, (j, idx)) AS idx FROM bad GROUP BY run_id),
    failed AS (SELECT run_id, max(idx) FILTER (ok) AS last_idx, min(i) FILTER (NOT ok) AS i, min_by(seen, i) FILTER (NOT ok) AS seen,
      min_by(need, i) FILTER (NOT ok) AS need FROM checked GROUP BY run_id)
    SELECT f.run_id, CASE WHEN h.j IS NOT NULL OR f.i IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN h.j IS NOT NULL THEN 'forbidden hit: ' || (SELECT token FROM forb WHERE j = h.j)
           WHEN f.i IS NOT NULL THEN 'expected-not-seen: line ' || f.i || ' (saw ' || f.seen || '/' || f.need || ')'
           ELSE '3 log positive(s) satisfied' END AS reason,
      f.i AS failed_i, h.idx AS forbidden_idx, f.last_idx
    FROM failed f LEFT JOIN hit h ON f.run_id = h.run_id""",
)
def adjudicate_window(t):
    out = judge.adjudicate_window(doc_runs(t), doc_expectations(t), doc_forbidden(t), doc_lines(t))
    return out.drop("scenario")


@query(
    "j4_forbidden_hits",
    f"""WITH {DOC_LINES}, {DOC_FORBIDDEN},
    anchor AS (SELECT run_id, min(idx) AS idx FROM lines WHERE contains(text, 'the') GROUP BY run_id)
    SELECT l.run_id, f.j, l.idx FROM lines l CROSS JOIN forb f LEFT JOIN anchor a ON a.run_id = l.run_id
    WHERE contains(l.text, f.token) AND (f.after_token IS NULL OR l.idx > a.idx)""",
)
def forbidden_hits(t):
    lines = doc_lines(t)
    anchors = lines.where(F.contains("text", F.lit("the"))).groupBy("run_id").agg(F.min("idx").alias("anchor_idx"))
    specs = doc_runs(t).join(doc_forbidden(t), "scenario").select("run_id", "j", "token", "after_token")
    return logs.forbidden_hits(lines, specs, anchors.withColumn("token", F.lit("the")), doc_forbidden(t)).select("run_id", "j", "idx")


@query(
    "j23_outstanding",
    f"""{MATCHES}, tok AS (
      SELECT l.run_id, e.i FROM lines l JOIN exp e ON l.scenario = e.scenario
      WHERE contains(l.text, e.tokens[1]) OR contains(l.text, e.tokens[2]))
    SELECT d.doc_id AS run_id, e.i, e.tokens[1] || ' OR ' || e.tokens[2] AS waiting_for
    FROM documents d JOIN exp e ON d.lang = e.scenario
    WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.run_id = d.doc_id AND tok.i = e.i)""",
)
def outstanding(t):
    run_exp = doc_run_exp(t)
    none = F.array().cast("array<string>")
    any_of = doc_expectations(t).withColumn("same_line", none)
    satisfied = logs.first_observed(logs.match_tokens(doc_lines(t), doc_runs(t), any_of))
    return logs.outstanding(run_exp, satisfied).select("run_id", "i", "waiting_for")


@query(
    "w16_last_n",
    f"""WITH {DOC_LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx DESC) AS r FROM lines)
    SELECT run_id, idx, md5(text) AS line_md5 FROM ranked WHERE r <= 3""",
)
def last_lines(t):
    return logs.last_n(doc_lines(t), ["run_id"], "idx", 3).select("run_id", "idx", F.md5("text").alias("line_md5"))


@query(
    "w17_boot_outcome",
    f"""WITH {BOOT_LINES}, s AS (SELECT boot_id, min(us) AS t0 FROM boot GROUP BY boot_id),
    h AS (
      SELECT boot_id, greatest(CAST(ceil((us - t0) / 1e6) AS BIGINT), 1) AS sec, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS r
      FROM boot JOIN s USING (boot_id) WHERE event_type IN ('error', 'purchase') AND ceil((us - t0) / 1e6) <= 43200),
    d AS (SELECT boot_id, min((sec, r)) AS f, min(sec) AS sec FROM h GROUP BY boot_id)
    SELECT s.boot_id, CASE WHEN d.sec IS NULL THEN 'UNDECIDED' WHEN d.f[2] = 0 THEN 'FAILED' ELSE 'UP' END AS outcome,
      d.sec AS after_s FROM s LEFT JOIN d USING (boot_id)""",
)
def boot_outcome(t):
    lines = boot_log(t)
    starts = lines.groupBy("boot_id").agg(F.min("observed_at").alias("started_at"))
    return logs.boot_outcome(lines, starts, up="purchase:", failed="error:", limit_s=43_200)


@query(
    "w18_position_regressions",
    """WITH p AS (
      SELECT user_id AS bench_id, event_id AS boot_seq, CAST(round(value * 100) AS BIGINT) AS position,
        lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_position
      FROM events),
    f AS (SELECT *, coalesce(position < prev_position, false) AS fell, position < 1000 AS below_watermark FROM p)
    SELECT * FROM f WHERE fell OR below_watermark""",
)
def position_regressions(t):
    positions = t.events.select(
        F.col("user_id").alias("bench_id"),
        F.col("event_id").alias("boot_seq"),
        F.round(F.col("value") * 100).cast("bigint").alias("position"),
    )
    return logs.position_regressions(positions, F.lit(1000))


@query(
    "w19_outage_intervals",
    f"""WITH {BOOT_LINES},
    m AS (SELECT boot_id, idx, us, event_type FROM boot WHERE event_type IN ('error', 'signup', 'view')),
    st AS (
      SELECT *, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS)
        OVER (PARTITION BY boot_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM m),
    f AS (SELECT *, event_type = 'error' AND coalesce(state, 'signup') = 'signup' AS starts FROM st),
    isl AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY boot_id ORDER BY idx) AS outage FROM f),
    g AS (
      SELECT boot_id, outage, min(us) FILTER (starts) AS lost_us, min(us) FILTER (event_type = 'signup') AS reopened_us,
        count(*) FILTER (event_type = 'view' AND state = 'error') AS retries
      FROM isl WHERE outage > 0 GROUP BY boot_id, outage)
    SELECT boot_id, CAST(outage AS BIGINT) AS outage, lost_us, reopened_us, retries, reopened_us IS NOT NULL AS recovered,
      reopened_us - lost_us AS duration_us FROM g""",
)
def outage_intervals(t):
    out = logs.outage_intervals(boot_log(t), lost=("error:",), back=("signup:",), retry=("view:",))
    return out.select(
        "boot_id", "outage", micros(F.col("lost_at")).alias("lost_us"), micros(F.col("reopened_at")).alias("reopened_us"),
        "retries", "recovered", "duration_us",
    )


@query(
    "a14_log_growth",
    f"""WITH {BOOT_LINES} SELECT boot_id, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS lines,
      CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM boot GROUP BY ALL""",
)
def log_growth(t):
    out = logs.log_growth(boot_log(t))
    return out.select("boot_id", micros(F.col("hour")).alias("hour_us"), "lines", "bytes")


@query(
    "a16_profile_posture",
    """WITH s AS (
      SELECT user_id AS device_id, count(*) FILTER (event_type = 'view') AS verified,
        count(*) FILTER (event_type = 'error') AS degraded FROM events GROUP BY user_id)
    SELECT c.c_custkey AS device_id, coalesce(verified, 0) AS verified, coalesce(degraded, 0) AS degraded,
      coalesce(verified, 0) > 0 AND coalesce(degraded, 0) = 0 AS ok
    FROM customer c LEFT JOIN s ON s.device_id = c.c_custkey""",
)
def profile_posture(t):
    posture = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "error", "degraded")
    lines = t.events.select(F.col("user_id").alias("device_id"), posture.alias("posture"))
    devices = t.customer.select(F.col("c_custkey").alias("device_id"))
    return logs.profile_posture(lines, devices).select("device_id", "verified", "degraded", "ok")


@query(
    "a22_identity_continuity",
    """WITH i AS (SELECT l_orderkey AS address, count(DISTINCT l_suppkey) AS ids FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    p AS (SELECT l_orderkey AS address, count(*) AS proposed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(i.address, p.address) AS address, coalesce(ids, 0) AS ids, coalesce(proposed, 0) AS proposed,
      coalesce(ids, 0) = 1 AND coalesce(proposed, 0) = 0 AS continuous FROM i FULL JOIN p ON i.address = p.address""",
)
def identity_continuity(t):
    # Every line has a role: a returned one is a proposal, the others are links.
    rows = t.lineitem.select(F.col("l_orderkey").alias("address"), F.col("l_suppkey").alias("device_id"), "l_returnflag")
    links = rows.where("l_returnflag <> 'R'").select("address", "device_id")
    proposals = rows.where("l_returnflag = 'R'").select("address")
    return logs.identity_continuity(links, proposals)
