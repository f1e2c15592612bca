"""Liveness and API queries: S7, S8, F6, F7, F9–F11, J1–J3, J5, U1, A3, W14."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.operators import liveness as ops
from fleetwitness.plans.registry import query
from fleetwitness.plans.standins import k_of
from fleetwitness.sources import captures

# Runs are orders, polled by year and scoped by priority; orders before 1996 were already
# there at the marker. Chains are the orders' lines.
RUNS = """runs AS (
  SELECT o_orderpriority AS scope, CAST(o_orderkey AS VARCHAR) AS run_id, year(o_orderdate) AS poll_seq,
    o_orderdate, o_orderkey FROM orders),
fresh AS (SELECT * FROM runs WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
actions AS (
  SELECT o_orderpriority AS scope, CAST(l_orderkey AS VARCHAR) AS run_id, l_linenumber AS pos, CASE WHEN l_tax = 0.08 THEN 503 ELSE 200 END AS status,
    CASE l_returnflag WHEN 'A' THEN 'CONFIRMED' WHEN 'N' THEN 'DISPATCHED' END AS outcome, l_tax, l_discount, l_quantity, l_shipdate,
    year(o_orderdate) + l_orderkey % 2 AS poll_seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
polls AS (SELECT scope, run_id, poll_seq + d AS poll_seq, o_orderdate, o_orderkey FROM runs, (VALUES (0), (1)) v(d)),
chains AS (
  SELECT scope, run_id, poll_seq, CASE WHEN max(l_tax) = 0.08 AND min(l_tax) > 0.03 THEN 503 ELSE 200 END AS status,
    CASE WHEN min(l_discount) > 0.06 THEN NULL WHEN min(l_quantity) = 1 THEN 'soon'
         ELSE strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') END AS matched_at,
    min(l_shipdate) AS matched, count(outcome) AS executed
  FROM actions GROUP BY scope, run_id, poll_seq)"""


def run_rows(t):
    return t.orders.select(
        F.col("o_orderpriority").alias("scope"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.year("o_orderdate").alias("poll_seq"),
        F.col("o_orderkey").alias("list_pos"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("triggered_at"),
        "o_orderdate",
    )


def snapshot(t):
    return run_rows(t).where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))


def actions(t):
    outcome = F.when(F.col("l_returnflag") == "A", "CONFIRMED").when(F.col("l_returnflag") == "N", "DISPATCHED")
    # The chain of an order is read in the poll of its year, or in the next one.
    poll = (F.year("o_orderdate") + F.col("l_orderkey") % 2).cast("int")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("scope"), F.col("l_orderkey").cast("string").alias("run_id"), poll.alias("poll_seq"),
        F.when(F.col("l_tax") == 0.08, 503).otherwise(200).alias("status"), outcome.alias("outcome"), "l_tax", "l_discount",
        "l_quantity", "l_shipdate",
    )


def chains(t):
    stamp = F.date_format(F.min("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return actions(t).groupBy("scope", "run_id", "poll_seq").agg(
        F.when((F.max("l_tax") == 0.08) & (F.min("l_tax") > 0.03), 503).otherwise(200).alias("status"),
        F.when(F.min("l_discount") > 0.06, F.lit(None)).when(F.min("l_quantity") == 1, "soon").otherwise(stamp).alias("matched_at"),
        F.count("outcome").alias("executed"),
    )


def anchors(t):
    """Every scope but one has an anchor."""
    scopes = t.orders.select(F.col("o_orderpriority").alias("scope")).where("scope <> '5-LOW'").distinct()
    return scopes.withColumn("m_observed", F.lit("1998-06-01").cast("timestamp"))


@query("j1_new_runs", f"WITH {RUNS} SELECT scope, run_id FROM fresh")
def new_runs(t):
    return ops.new_runs(run_rows(t), snapshot(t)).select("scope", "run_id")


@query(
    "j2_confirmed_new_run",
    f"""WITH {RUNS} SELECT scope, run_id FROM fresh f
    WHERE EXISTS (SELECT 1 FROM actions a WHERE a.run_id = f.run_id AND a.scope = f.scope AND a.status = 200 AND a.outcome = 'CONFIRMED')""",
)
def confirmed_new_run(t):
    return ops.confirmed_new_run(run_rows(t), snapshot(t), actions(t)).select("scope", "run_id")


JUDGED = f"""WITH {RUNS},
judged AS (
  SELECT f.scope, f.run_id, f.poll_seq, f.o_orderkey,
    CASE WHEN f.scope = '5-LOW' THEN 'refused: no anchor' WHEN coalesce(c.status, 0) <> 200 THEN 'chain not 200' WHEN c.matched_at IS NULL THEN 'trigger view absent'
         WHEN c.matched_at = 'soon' THEN 'unparseable matchedAt'
         WHEN c.matched < TIMESTAMP '1998-06-01' THEN 'predates'
         WHEN c.executed = 0 THEN 'no executed action' ELSE 'accepted' END AS result,
    coalesce(c.matched_at <> 'soon' AND c.matched = f.o_orderdate, false) AS agree
  FROM (SELECT * FROM polls WHERE o_orderdate >= TIMESTAMP '1996-01-01') f
  LEFT JOIN chains c ON c.scope = f.scope AND c.run_id = f.run_id AND c.poll_seq <= f.poll_seq)"""


def judged(t):
    """Each run is listed by two polls."""
    again = F.explode(F.array(F.col("poll_seq"), F.col("poll_seq") + 1))
    polls = run_rows(t).drop("o_orderdate").withColumn("poll_seq", again)
    return ops.new_run_after(polls, snapshot(t), chains(t), anchors(t))


@query("j3_new_run_after", f"{JUDGED} SELECT scope, run_id, poll_seq, result, agree FROM judged")
def new_run_after(t):
    return judged(t).select("scope", "run_id", F.col("poll_seq").cast("bigint").alias("poll_seq"), "result", "agree")


@query(
    "j3_liveness_verdict",
    f"""{JUDGED}, won AS (
      SELECT scope, min_by(run_id, (poll_seq, o_orderkey)) AS run_id, min_by(agree, (poll_seq, o_orderkey)) AS agree
      FROM judged WHERE result = 'accepted' GROUP BY scope),
    n AS (SELECT scope, count(DISTINCT run_id) AS new_runs FROM judged GROUP BY scope)
    SELECT s.scope, CASE WHEN s.scope = '5-LOW' THEN 'REFUSED' WHEN w.run_id IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, w.run_id, w.agree,
      coalesce(n.new_runs, 0) AS new_runs
    FROM (SELECT DISTINCT scope FROM runs) s LEFT JOIN won w USING (scope) LEFT JOIN n USING (scope)""",
)
def liveness_verdict(t):
    return ops.liveness_verdict(run_rows(t), judged(t), anchors(t))


# API reads: a user day is one polled line; error events are failed reads; k >= 80 is terminal.
READS = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id || '-' || strftime(ts, '%Y-%m-%d') AS run_id
  FROM events)"""


def api_reads(t):
    k = k_of(F.col("props"))
    phase = F.when(F.col("event_type") == "purchase", "CONFIRMED").otherwise("TIMED_OUT")
    body = F.to_json(F.struct(F.struct((k >= 80).alias("terminal"), phase.alias("currentPhase"), k.alias("k")).alias("data")))
    cut = F.when(F.col("event_type") == "signup", F.expr("left(body, 20)")).otherwise(F.col("body"))
    rows = t.events.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").alias("poll_seq"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"),
        "event_type",
        body.alias("body"),
    )
    return rows.withColumn("body", cut)


@query(
    "w14_decide_api",
    f"""WITH {READS}, st AS (
      SELECT run_id, event_id, CASE WHEN event_type IN ('error', 'signup') OR k < 80 THEN 'pending'
        WHEN event_type = 'purchase' THEN 'ok' ELSE 'fail' END AS state FROM ev)
    SELECT run_id, coalesce(min_by(state, event_id) FILTER (state <> 'pending'), 'pending') AS state,
      min(event_id) FILTER (state <> 'pending') AS decided_at_poll, count(*) AS polls FROM st GROUP BY run_id""",
)
def decide_api(t):
    reads = ops.parse_body(api_reads(t))
    return ops.decide_api(reads, ops.terminal_state(F.col("doc"), F.lit("CONFIRMED")), ["run_id"])


@query(
    "w14_all_asserts",
    f"""WITH {READS}, st AS (
      SELECT run_id, event_id, CASE WHEN event_type IN ('error', 'signup') OR k < 80 THEN 'pending'
        WHEN event_type <> 'purchase' THEN 'fail' WHEN k <> 90 THEN 'pending' ELSE 'ok' END AS state FROM ev)
    SELECT run_id, coalesce(min_by(state, event_id) FILTER (state <> 'pending'), 'pending') AS state,
      min(event_id) FILTER (state <> 'pending') AS decided_at_poll, count(*) AS polls FROM st GROUP BY run_id""",
)
def decide_all(t):
    """Two asserts of one line: the terminal phase, then a field of the body."""
    doc = F.col("doc")
    field = F.when(ops.same_text(doc, "data.k", "90", "bigint"), "ok").otherwise("pending")
    both = ops.all_asserts([ops.terminal_state(doc, F.lit("CONFIRMED")), field])
    return ops.decide_api(ops.parse_body(api_reads(t)), both, ["run_id"])


@query(
    "f6_json_field",
    f"""WITH {READS} SELECT event_id, CASE WHEN event_type <> 'signup' THEN k END AS k,
      CAST(NULL AS VARCHAR) AS missing FROM ev""",
)
def json_field(t):
    docs = ops.parse_body(api_reads(t))
    return docs.select(
        F.col("poll_seq").alias("event_id"),
        ops.json_at(F.col("doc"), "data.k", "bigint").alias("k"),
        ops.json_at(F.col("doc"), "data.k.deeper").alias("missing"),
    )


@query(
    "f7_field_equals",
    f"""WITH {READS} SELECT event_id, event_type <> 'signup' AND k = 90 AS as_number, false AS as_text,
      event_type <> 'signup' AND k >= 80 AS as_flag FROM ev""",
)
def field_equals(t):
    docs = ops.parse_body(api_reads(t))
    return docs.select(
        F.col("poll_seq").alias("event_id"),
        ops.same_text(F.col("doc"), "data.k", "90", "bigint").alias("as_number"),
        ops.same_text(F.col("doc"), "data.k", "90", "string").alias("as_text"),
        ops.same_text(F.col("doc"), "data.terminal", "true", "boolean").alias("as_flag"),
    )


@query(
    "w14_catalogue_asserts",
    f"""WITH {READS} SELECT event_id AS poll_seq, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS i,
      CASE WHEN event_type = 'error' THEN 'pending'
        WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'pending' WHEN k % 2 = 1 THEN 'fail' WHEN k = 90 THEN 'ok' ELSE 'pending' END
        WHEN event_type = 'view' THEN CASE WHEN k % 3 = 2 THEN 'ok' ELSE 'pending' END
        WHEN event_type = 'click' THEN CASE WHEN k % 3 = 2 THEN 'ok' ELSE 'pending' END
        WHEN k >= 50 THEN 'ok' ELSE 'pending' END AS state FROM ev""",
)
def catalogue_asserts(t):
    """Every assert of the catalogue, on reads of the event stream: one line per kind of event."""
    check = "ARRAY<STRUCT<name: STRING, field: STRING, value: STRING, type: STRING, ids: ARRAY<STRING>, n: INT>>"
    asserts = [
        [("phase_terminal", None, "CONFIRMED", None, None, None), ("field_equals", "data.k", "90", "bigint", None, None)],
        [("rows", None, None, None, None, 2)],
        [("ulids", None, None, None, ["id1", "id0"], None)],
        [("new_confirmed_run", None, None, None, None, None), ("new_run_after", None, None, None, None, None)],
    ]
    catalogue = t.rows(f"scenario STRING, i INT, kind STRING, asserts {check}", *[("s", i, "api", a) for i, a in enumerate(asserts)])
    k, kind = k_of(F.col("props")), F.col("event_type")
    phase = F.when(k % 2 == 0, "CONFIRMED").otherwise("TIMED_OUT")
    items = F.slice(F.array(*[F.struct(F.lit(f"id{n}").alias("id")) for n in range(2)]), F.lit(1), (k % 3).cast("int"))
    one = F.to_json(F.struct(F.struct((k >= 50).alias("terminal"), phase.alias("currentPhase"), k.alias("k")).alias("data")))
    reads = t.events.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.when(kind == "purchase", 0).when(kind == "view", 1).when(kind == "click", 2).otherwise(3).alias("i"),
        F.col("event_id").alias("poll_seq"), F.col("ts").alias("observed_at"), F.when(kind == "error", 503).otherwise(200).alias("status"),
        F.when(kind.isin("view", "click"), F.to_json(F.struct(items.alias("data")))).otherwise(one).alias("body"),
        F.when(k >= 50, "ok").otherwise("pending").alias("run_state"),
    )
    runs = reads.select("run_id", F.lit("s").alias("scenario")).distinct()
    return ops.read_states(reads, runs, catalogue).select("poll_seq", "i", "state")


@query(
    "s7_read_api_captures",
    f"""WITH {READS} SELECT event_id AS bundle, event_type <> 'view' AS readable,
      CASE WHEN event_type <> 'view' THEN 0 END AS idx,
      CASE WHEN event_type = 'error' THEN 503 WHEN event_type <> 'view' THEN 200 END AS status,
      CASE WHEN event_type NOT IN ('view', 'signup') THEN k END AS k FROM ev""",
)
def read_api_captures(t):
    reads = api_reads(t)
    one = F.to_json(F.array(F.struct(F.lit("t0").alias("when"), F.lit("poll").alias("what"), "status", "body")))
    files = reads.select(
        F.col("poll_seq").alias("bundle"), F.when(F.col("event_type") == "view", "not a list").otherwise(one).alias("text")
    )
    out = captures.read_api_captures(files)
    return out.select("bundle", "readable", "idx", "status", ops.json_at(F.col("doc"), "data.k", "bigint").alias("k"))


def chain_reads(t):
    """One read per order for the run list, one per order line for its chain."""
    listed = F.array(
        F.struct(
            F.col("o_orderkey").cast("string").alias("runId"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("triggeredAt"),
            F.col("o_orderstatus").alias("status"),
        )
    )
    runs = t.orders.select(
        F.col("o_orderpriority").alias("scope"),
        F.lit("/api/v1/runs").alias("path"),
        F.col("o_orderkey").alias("poll_seq"),
        F.lit(200).alias("status"),
        F.to_json(F.struct(listed.alias("data"))).alias("body"),
    )
    outcome = F.when(F.col("l_returnflag") == "A", "CONFIRMED").when(F.col("l_returnflag") == "N", "DISPATCHED")
    data = F.struct(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("matchedAt")).alias("trigger"),
        F.array(F.struct(F.col("l_linestatus").alias("command"), outcome.alias("outcome"))).alias("actions"),
    )
    lines = t.lineitem.select(
        F.lit(None).cast("string").alias("scope"),
        F.concat(F.lit("/api/v1/runs/"), F.col("l_orderkey"), F.lit("/causal-chain")).alias("path"),
        F.col("l_linenumber").cast("bigint").alias("poll_seq"),
        F.lit(200).alias("status"),
        F.to_json(F.struct(data.alias("data"))).alias("body"),
    )
    return runs.unionByName(lines)


@query(
    "s8_read_runs",
    """SELECT o_orderpriority AS scope, CAST(o_orderkey AS VARCHAR) AS run_id,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS triggered_at, o_orderstatus AS status FROM orders""",
)
def read_runs(t):
    return captures.read_runs_and_chains(chain_reads(t))[0].select("scope", "run_id", "triggered_at", "status")


@query(
    "s8_read_chains",
    """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS matched_at,
      CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE 0 END AS executed FROM lineitem""",
)
def read_chains(t):
    return captures.read_runs_and_chains(chain_reads(t))[1].select("run_id", "matched_at", "executed")


@query(
    "s8_chain_actions",
    """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_linestatus AS command,
      CASE l_returnflag WHEN 'A' THEN 'CONFIRMED' WHEN 'N' THEN 'DISPATCHED' END AS outcome, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def chain_actions(t):
    found = captures.read_runs_and_chains(chain_reads(t))[2]
    return found.groupBy("run_id", "command", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f9_terminal_reads",
    f"""WITH {READS} SELECT event_id FROM ev WHERE event_type = 'click' OR (event_type = 'view' AND k < 50)""",
)
def terminal_reads(t):
    name = F.when(F.col("event_type") == "click", "phase_terminal").when(F.col("event_type") == "view", "field_equals").otherwise("rows")
    field = F.when(k_of(F.col("props")) < 50, "data.terminal").otherwise("data.other")
    rows = t.events.withColumn("asserts", F.array(F.struct(name.alias("name"), field.alias("field"))))
    return ops.terminal_reads(rows).select("event_id")


@query(
    "f10_command_target",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS entity FROM events""",
)
def command_target(t):
    verb = F.when(F.col("event_type") == "click", "commands").otherwise("state")
    path = F.concat(F.lit("/api/v1/entities/"), F.col("user_id"), F.lit("/"), verb)
    return t.events.select("event_id", ops.command_target(path).alias("entity"))


@query(
    "f11_select_other",
    """SELECT p_partkey, CASE WHEN p_size = 20 THEN 50 ELSE 20 END AS chosen,
      CASE WHEN p_size = 20 THEN NULL ELSE 20 END AS single FROM part""",
)
def select_other(t):
    levels = F.array(F.lit(20), F.lit(50), F.lit(80))
    return t.part.select(
        "p_partkey",
        ops.select_other(levels, F.col("p_size")).alias("chosen"),
        ops.select_other(F.array(F.lit(20)), F.col("p_size")).alias("single"),
    )


@query(
    "a3_row_count_equals",
    "SELECT conv_id, count(*) AS n, count(*) = 6 AS equal FROM conversations GROUP BY conv_id",
)
def row_count_equals(t):
    return ops.row_count_equals(t.conversations, ["conv_id"], F.lit(6))


@query(
    "j5_id_set_equal",
    """WITH f AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0),
    e AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1),
    b AS (SELECT coalesce(f.p_brand, e.p_brand) AS p_brand, f.p_size AS fs, e.p_size AS es
          FROM f FULL JOIN e ON f.p_brand = e.p_brand AND f.p_size = e.p_size)
    SELECT p_brand, count(*) FILTER (fs IS NULL) AS missing, count(*) FILTER (es IS NULL) AS extra,
      count(*) FILTER (fs IS NULL OR es IS NULL) = 0 AS equal FROM b GROUP BY p_brand""",
)
def id_set_equal(t):
    found, expected = t.part.where("p_partkey % 2 = 0"), t.part.where("p_partkey % 2 = 1")  # every part has a role
    return ops.id_set_equal(found, expected, ["p_brand"], "p_size")


@query(
    "u1_id_set_delta",
    """SELECT c_custkey AS id, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey FROM customer)""",
)
def id_set_delta(t):
    found = t.lineitem.select(F.col("l_orderkey").alias("id"))
    expected = t.customer.select(F.col("c_custkey").alias("id"))
    return ops.id_set_delta(found, expected)
