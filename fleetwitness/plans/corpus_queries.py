"""Corpus and catalogue queries: J7, J12–J19, T3, U2–U4, S13, A17, F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators import catalog, corpus, fleet
from fleetwitness.plans.registry import query

MAPPING = """mapping(cluster, attr_name, capability) AS (VALUES ('A', 'F', 'on_off'), ('N', 'O', 'brightness'), ('R', 'F', 'motion'))"""


def mapping(t):
    return t.rows(
        "cluster STRING, attr_name STRING, capability STRING",
        ("A", "F", "on_off"), ("N", "O", "brightness"), ("R", "F", "motion"),
    )


def attributes(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("device_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.col("l_returnflag").alias("cluster"), F.col("l_linestatus").alias("attr_name"),
        (F.col("l_tax") < 0.05).alias("supported"),
    )


@query(
    "j12_map_capabilities",
    f"""WITH {MAPPING} SELECT l_suppkey AS device_id, l_orderkey AS k, l_linenumber AS n, capability,
      CASE WHEN capability IS NULL THEN 'N/A' WHEN l_tax < 0.05 THEN 'MATCH' ELSE 'GAP' END AS verdict
    FROM lineitem LEFT JOIN mapping ON l_returnflag = cluster AND l_linestatus = attr_name""",
)
def map_capabilities(t):
    return corpus.map_capabilities(attributes(t), mapping(t)).select("device_id", "k", "n", "capability", "verdict")


@query(
    "j12_device_verdicts",
    f"""WITH {MAPPING}, v AS (SELECT l_suppkey AS device_id, count(*) FILTER (capability IS NOT NULL AND l_tax < 0.05) AS matched,
      count(*) FILTER (capability IS NOT NULL AND l_tax >= 0.05) AS gaps, count(*) FILTER (capability IS NULL) AS unmapped
      FROM lineitem LEFT JOIN mapping ON l_returnflag = cluster AND l_linestatus = attr_name GROUP BY 1)
    SELECT *, CASE WHEN matched = 0 THEN 'NONE' WHEN gaps > 0 THEN 'PARTIAL' ELSE 'FULL' END AS device_verdict FROM v""",
)
def device_verdicts(t):
    return corpus.device_verdicts(corpus.map_capabilities(attributes(t), mapping(t)))


@query(
    "j13_predicted_vs_measured",
    """WITH p AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_size <= 30),
    m AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_size >= 10)
    SELECT p_brand, p_type, p_size, CASE WHEN max(s) = 1 THEN 'MISSING' WHEN min(s) = 2 THEN 'DELTA' ELSE 'CONFIRMED' END AS result
    FROM (SELECT *, 1 AS s FROM p UNION ALL SELECT *, 2 FROM m) GROUP BY ALL""",
)
def predicted_vs_measured(t):
    return corpus.predicted_vs_measured(
        t.part.where("p_size <= 30"), t.part.where("p_size >= 10"), ["p_brand", "p_type", "p_size"]
    )


# A second snapshot of the parts: one brand renamed, one size changed, one type gone.
def parts_before(t):
    return corpus.fields_of(t.part, ["p_partkey"], ["p_name", "p_brand", "p_size"])


def parts_after(t):
    later = t.part.where(F.col("p_type") != "SMALL").withColumns(
        {
            "p_size": F.when(F.col("p_size") > 45, None).otherwise(F.col("p_size")),
            "p_name": F.when(F.col("p_brand") == "Brand#1", F.upper("p_name")).otherwise(F.col("p_name")),
        }
    )
    return corpus.fields_of(later, ["p_partkey"], ["p_name", "p_brand", "p_size"])


FIELDS = """fb AS (
  SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
  UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part),
fa AS (
  SELECT p_partkey, 'p_name' AS field, CASE WHEN p_brand = 'Brand#1' THEN upper(p_name) ELSE p_name END AS value FROM part WHERE p_type <> 'SMALL'
  UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_type <> 'SMALL'
  UNION ALL SELECT p_partkey, 'p_size', CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_size AS VARCHAR) END FROM part WHERE p_type <> 'SMALL')"""


@query(
    "j14_snapshot_diff",
    f"""WITH {FIELDS} SELECT fb.p_partkey, fb.field, fb.value AS before, fa.value AS after,
      CASE WHEN fa.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM fb LEFT JOIN fa ON fa.p_partkey = fb.p_partkey AND fa.field = fb.field
    WHERE fa.p_partkey IS NULL OR fa.value IS DISTINCT FROM fb.value""",
)
def snapshot_diff(t):
    return corpus.snapshot_diff(parts_before(t), parts_after(t), ["p_partkey", "field"])


@query(
    "j15_merge_sources",
    """WITH u AS (SELECT s_nationkey, s_suppkey, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS value FROM supplier WHERE s_acctbal > 1000),
    b AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name ELSE CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) END AS value
      FROM supplier WHERE s_acctbal < 8000)
    SELECT coalesce(u.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(b.value, u.value) AS value,
      CASE WHEN b.value IS NOT NULL THEN 'bench' ELSE 'upstream' END AS origin, coalesce(u.value <> b.value, false) AS conflict
    FROM u FULL JOIN b ON u.s_suppkey = b.s_suppkey""",
)
def merge_sources(t):
    balance = F.round("s_acctbal").cast("bigint").cast("string")
    upstream = t.supplier.where("s_acctbal > 1000").select("s_suppkey", balance.alias("value"))
    bench = t.supplier.where("s_acctbal < 8000").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise(balance).alias("value")
    )
    return corpus.merge_sources(upstream, bench, ["s_suppkey"])


@query(
    "j16_inherit_templates",
    """WITH r AS (
      SELECT c_name AS key, 2 AS depth, n_name AS zone, c_mktsegment AS tier, r_name AS area, NULL AS problem
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT n_name, 1, n_name, r_name, r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT r_name, 0, NULL, r_name, r_name, NULL FROM region
      UNION ALL SELECT s_name, 0, NULL, 'own', NULL, 'missing: no such template' FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT s_name, 0, NULL, 'own', NULL, 'cycle: ' || s_name FROM supplier WHERE s_suppkey % 2 = 1)
    SELECT key, depth, zone, tier, area, problem IS NULL AS resolved, problem FROM r""",
)
def inherit_templates(t):
    def record(key, extends, **deltas):
        pairs = [x for k, v in deltas.items() for x in (F.lit(k), F.col(v))]
        return [F.col(key).alias("key"), extends.alias("extends"), F.create_map(*pairs).alias("deltas")]

    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    records = (
        customers.select(*record("c_name", F.col("n_name"), tier="c_mktsegment"))
        .unionByName(nations.select(*record("n_name", F.col("r_name"), zone="n_name")))
        .unionByName(t.region.select(*record("r_name", F.lit(None).cast("string"), tier="r_name", area="r_name")))
    )
    # Suppliers extend what is not there, or themselves.
    wrong = F.when(F.col("s_suppkey") % 2 == 0, "no such template").otherwise(F.col("s_name"))
    suppliers = t.supplier.withColumn("own", F.lit("own"))
    records = records.unionByName(suppliers.select(*record("s_name", wrong, tier="own")))
    out = corpus.inherit_templates(records)
    value = {k: F.col("deltas")[k].alias(k) for k in ("zone", "tier", "area")}
    return out.select("key", "depth", *value.values(), "resolved", "problem")


@query(
    "j17_cross_validate",
    f"""WITH {FIELDS} SELECT fb.p_partkey, count(*) AS compared,
      count(*) FILTER (fa.p_partkey IS NULL OR fa.value IS DISTINCT FROM fb.value) AS disagreeing,
      count(*) FILTER (fa.p_partkey IS NULL OR fa.value IS DISTINCT FROM fb.value) = 0 AS trusted
    FROM fb LEFT JOIN fa ON fa.p_partkey = fb.p_partkey AND fa.field = fb.field GROUP BY fb.p_partkey""",
)
def cross_validate(t):
    return corpus.cross_validate(parts_before(t), parts_after(t), ["p_partkey", "field"], ["p_partkey"])


@query(
    "j18_anchor_check",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing'
      WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'anchored' ELSE 'mismatch' END AS anchor FROM orders""",
)
def anchor_check(t):
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("firmware")
    )
    frozen = t.rows("o_orderpriority STRING, firmware STRING", ("1-URGENT", "F"), ("2-HIGH", "F"), ("3-MEDIUM", "X"))
    return corpus.anchor_check(rows, frozen, ["o_orderpriority"], ["firmware"]).select("o_orderkey", "anchor")


@query(
    "j19_prunable_logs",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey AS bench_id, o_orderkey AS boot_id FROM r
    WHERE n > 2 AND o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3)""",
)
def prunable_logs(t):
    logs = t.orders.select(
        F.col("o_custkey").alias("bench_id"), F.col("o_orderkey").alias("boot_id"),
        F.col("o_orderkey").alias("boot_seq"), (F.col("o_orderstatus") == "F").alias("copied"),
    )
    # A log that more than three lines point to is cited.
    pointed = t.lineitem.groupBy(F.col("l_orderkey").alias("boot_id")).agg(F.count(F.lit(1)).alias("n"))
    cited = pointed.where("n > 3").select("boot_id")
    return fleet.prunable_logs(logs, cited).select("bench_id", "boot_id")


SCAN = """scan AS (SELECT l_suppkey AS coordinator, l_linenumber AS channel, CAST(sum(l_quantity) AS DOUBLE) AS energy
  FROM lineitem GROUP BY 1, 2)"""


@query(
    "t3_quiet_channels",
    f"""WITH {SCAN}, r AS (SELECT *, row_number() OVER (PARTITION BY coordinator ORDER BY energy, channel) AS rank FROM scan)
    SELECT coordinator, channel, energy, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""",
)
def quiet_channels(t):
    scan = t.lineitem.groupBy(F.col("l_suppkey").alias("coordinator"), F.col("l_linenumber").alias("channel")).agg(
        F.sum("l_quantity").alias("energy")
    )
    return corpus.quiet_channels(scan, ["coordinator"], 2)


@query(
    "u2_cluster_set_delta",
    """WITH p AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0),
    m AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1)
    (SELECT *, 'both' AS side FROM (SELECT * FROM p INTERSECT SELECT * FROM m))
    UNION ALL (SELECT *, 'predicted' FROM (SELECT * FROM p EXCEPT SELECT * FROM m))
    UNION ALL (SELECT *, 'measured' FROM (SELECT * FROM m EXCEPT SELECT * FROM p))""",
)
def cluster_set_delta(t):
    keys = ["p_brand", "p_size"]
    predicted, measured = t.part.where("p_partkey % 2 = 0"), t.part.where("p_partkey % 2 = 1")  # every part has a role
    return corpus.cluster_set_delta(predicted.select(*keys), measured.select(*keys))


@query(
    "u3_unknown_keys",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority ELSE o_orderpriority || ',' || o_orderstatus END AS unknown
    FROM orders""",
)
def unknown_keys(t):
    keys = F.map_keys(F.create_map("o_orderpriority", F.lit(1), "o_orderstatus", F.lit(2)))
    return t.orders.select("o_orderkey", F.array_join(catalog.unknown_keys(keys, ("F", "O")), ",").alias("unknown"))


@query(
    "u4_evidence_union",
    """SELECT 'log' AS kind, epoch_us(ts) AS at_us, event_id AS ref, event_type AS text, CAST(NULL AS DOUBLE) AS amount FROM events
    UNION ALL SELECT 'api', epoch_us(o_orderdate), o_orderkey, NULL, o_totalprice FROM orders
    UNION ALL SELECT 'radio', epoch_us(l_shipdate), l_orderkey, l_returnflag, l_quantity FROM lineitem""",
)
def evidence_union(t):
    return fleet.evidence_union(
        {
            "log": t.events.select(micros(F.col("ts")).alias("at_us"), F.col("event_id").alias("ref"), F.col("event_type").alias("text")),
            "api": t.orders.select(micros(F.col("o_orderdate")).alias("at_us"), F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("amount")),
            "radio": t.lineitem.select(
                micros(F.col("l_shipdate")).alias("at_us"), F.col("l_orderkey").alias("ref"),
                F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("amount"),
            ),
        }
    )


@query(
    "u4_evidence_timeline",
    """WITH rows AS (
      SELECT 'log' AS kind, 0 AS kind_order, epoch_us(ts) AS at_us, event_id AS seq FROM events
      UNION ALL SELECT 'api', 1, epoch_us(o_orderdate), o_orderkey FROM orders
      UNION ALL SELECT 'radio', 2, epoch_us(l_shipdate), l_orderkey * 8 + l_linenumber FROM lineitem),
    days AS (SELECT *, at_us // 2592000000000 AS month FROM rows)
    SELECT month, kind, at_us, seq, row_number() OVER (PARTITION BY month ORDER BY at_us, kind_order, seq) AS place FROM days""",
)
def evidence_timeline(t):
    """Log, API and radio rows of thirty days are one time line."""
    month = F.floor(F.col("at_us") / 2_592_000_000_000).alias("month")
    parts = {
        "log": t.events.select(micros(F.col("ts")).alias("at_us"), F.col("event_id").alias("seq")),
        "api": t.orders.select(micros(F.col("o_orderdate")).alias("at_us"), F.col("o_orderkey").alias("seq")),
        "radio": t.lineitem.select(micros(F.col("l_shipdate")).alias("at_us"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")),
    }
    rows = fleet.evidence_timeline({k: df.select("*", month) for k, df in parts.items()}, ["month"])
    return rows.select("month", "kind", "at_us", "seq", F.col("place").cast("bigint").alias("place"))


KEY_SQL = corpus.KEY_MATERIAL
ADDRESS_SQL = corpus.EXTENDED_ADDRESS


@query(
    "s13_scrub_keys",
    f"""WITH s AS (
      SELECT doc_id, regexp_replace(regexp_replace(text, '{KEY_SQL}', '**REDACTED**', 'g'), '{ADDRESS_SQL}', '**REDACTED**', 'g') AS clean FROM documents)
    SELECT doc_id, md5(clean) AS text_md5, contains(clean, '**REDACTED**') AS redacted FROM s""",
)
def scrub_keys(t):
    out = corpus.scrub_keys(t.documents.select("doc_id", "text"), ["text"])
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.contains("text", F.lit("**REDACTED**")).alias("redacted"))


# The catalogue under test: a customer is a scenario, an order one of its evidence lines.
def scenario_rows(t):
    segment = F.col("c_mktsegment")
    return t.customer.select(
        F.col("c_name").alias("scenario"),
        F.when(F.col("c_acctbal") < 0, "other").otherwise(F.col("c_name")).alias("file_stem"),
        F.when(segment == "MACHINERY", "OPERATOR").when(segment == "HOUSEHOLD", "MANUAL").otherwise("AUTO").alias("tier"),
        F.array(F.lit("scenario"), F.lit("evidence"), F.when(F.col("c_nationkey") == 7, "evidnce").otherwise("tier")).alias("keys"),
        (F.col("c_nationkey") != 3).alias("requires_is_list"),
        F.when(F.col("c_nationkey") == 5, "stopped").alias("precondition"),
        (F.col("c_acctbal") > 9500).alias("uses_exactly"),
    )


def positive_rows(t):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    api = priority == "5-LOW"
    lines = t.orders.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    kinds = F.when(api, F.array(F.lit("api"))).when(priority == "1-URGENT", F.array(F.lit("log"), F.lit("log_any")))
    kinds = kinds.when(priority == "2-HIGH", F.array(F.lit("log_any"))).otherwise(F.array(F.lit("log")))
    return lines.select(
        F.col("c_name").alias("scenario"),
        F.col("o_orderkey").cast("int").alias("i"),
        kinds.alias("kinds"),
        F.when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), F.concat(F.lit("tok-"), status)).alias("log"),
        F.when(priority == "2-HIGH", F.when(status == "F", F.array().cast("array<string>")).otherwise(F.array(F.lit("any")))).alias("log_any"),
        F.when(status == "P", 0).otherwise(2).alias("count"),
        (status == "F").alias("has_extract"),
        (F.col("o_totalprice") > 400000).alias("has_min"),
        F.when(F.col("o_totalprice") < 20000, "soon").otherwise("30s").alias("within"),
        F.when(api & (status == "F"), F.array(F.lit("new_run_after")))
        .when(api & (status == "O"), F.array(F.lit("new_confirmed_run"), F.lit("rows")))
        .when(api, F.array(F.lit("row"))).alias("assert_keys"),
        F.when(api & (status == "F"), "tok-O").alias("anchor"),
    )


RULES = """WITH s AS (SELECT c_name AS scenario, * FROM customer),
p AS (
  SELECT c_name AS scenario, CAST(o_orderkey AS INTEGER) AS i, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
broken AS (
  SELECT scenario, 'L1' AS rule, 0 AS section, 0 AS line, 1 AS rule_no FROM s WHERE c_acctbal < 0
  UNION ALL SELECT scenario, 'L2', 0, 0, 2 FROM s WHERE c_nationkey = 7
  UNION ALL SELECT scenario, 'L3', 0, 0, 3 FROM s WHERE c_mktsegment = 'HOUSEHOLD'
  UNION ALL SELECT scenario, 'L4', 0, 0, 4 FROM s WHERE c_nationkey = 3
  UNION ALL SELECT scenario, 'L5', 0, 0, 5 FROM s WHERE c_acctbal > 9500
  UNION ALL SELECT scenario, 'L6', 0, 0, 6 FROM s WHERE c_nationkey = 5
  UNION ALL SELECT scenario, 'L7', 1, 0, 7 FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.scenario = s.scenario)
  UNION ALL SELECT scenario, 'L8', 2, i, 8 FROM p WHERE pr = '1-URGENT'
  UNION ALL SELECT scenario, 'L9', 2, i, 9 FROM p WHERE price < 20000
  UNION ALL SELECT scenario, 'L10', 2, i, 10 FROM p WHERE (pr = '2-HIGH' AND st = 'F') OR pr = '1-URGENT'
  UNION ALL SELECT scenario, 'L11', 2, i, 11 FROM p WHERE st = 'P'
  UNION ALL SELECT scenario, 'L12', 2, i, 12 FROM p WHERE price > 400000 AND st <> 'F'
  UNION ALL SELECT scenario, 'L13', 2, i, 13 FROM p WHERE pr = '5-LOW' AND st = 'P'
  UNION ALL SELECT scenario, 'L14', 2, i, 14 FROM p WHERE pr = '5-LOW' AND st = 'F' AND NOT EXISTS (
    SELECT 1 FROM p q WHERE q.scenario = p.scenario AND q.i < p.i AND q.st = 'O' AND q.pr IN ('3-MEDIUM', '4-NOT SPECIFIED'))
  UNION ALL SELECT scenario, 'L15', 3, 0, 15 FROM p WHERE pr = '5-LOW' AND st IN ('F', 'O') GROUP BY scenario HAVING count(DISTINCT st) = 2
  UNION ALL SELECT scenario, 'L16', 4, 0, 16 FROM s WHERE c_nationkey = 9 AND NOT EXISTS (
    SELECT 1 FROM p WHERE p.scenario = s.scenario AND st = 'P' AND pr IN ('3-MEDIUM', '4-NOT SPECIFIED'))
  UNION ALL SELECT scenario, 'L17', 5, 0, 17 FROM s WHERE c_nationkey = 11
  UNION ALL SELECT scenario, 'L17', 6, 0, 17 FROM s WHERE c_nationkey = 13)"""


def broken_rules(t):
    forbidden = t.customer.where(F.col("c_nationkey") == 9).select(
        F.col("c_name").alias("scenario"), F.lit(0).alias("j"), F.lit("bad").alias("token"), F.lit("tok-P").alias("after_token")
    )
    stimuli = t.customer.select(
        F.col("c_name").alias("scenario"), F.lit(0).alias("i"),
        F.when(F.col("c_nationkey") == 11, F.array(F.lit("kick"))).otherwise(F.array(F.lit("bench"))).alias("kinds"),
    )
    bindings = t.customer.select(
        F.col("c_name").alias("scenario"), F.lit(0).alias("i"),
        F.when(F.col("c_nationkey") == 13, F.array(F.lit("api"), F.lit("other_of"))).otherwise(F.array(F.lit("api"))).alias("forms"),
    )
    return catalog.validate_expectations(scenario_rows(t), positive_rows(t), forbidden, stimuli, bindings)


@query("a17_validate_expectations", f"{RULES} SELECT * FROM broken")
def validate_expectations(t):
    return broken_rules(t).drop("detail")


@query(
    "a17_first_refusal",
    f"{RULES} SELECT scenario, min_by(rule, (section, line, rule_no)) AS rule, count(*) AS broken FROM broken GROUP BY scenario",
)
def first_refusal(t):
    return catalog.first_refusal(broken_rules(t))


@query(
    "j7_bind_parameters",
    """SELECT c_custkey,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN n_regionkey < 4 THEN n_name ELSE '${C.nation.' || c_nationkey || '}' END
        ELSE 'zone ' || CASE WHEN n_regionkey < 4 THEN n_name ELSE '${C.nation.' || c_nationkey || '}' END || ' by ${let.level}' END AS bound,
      CASE WHEN c_mktsegment = 'MACHINERY' AND n_regionkey < 4 THEN 'INT' ELSE 'STRING' END AS value_type, n_regionkey >= 4 AS refused
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def bind_parameters(t):
    ref = F.concat(F.lit("${C.nation."), F.col("c_nationkey"), F.lit("}"))
    whole = F.col("c_mktsegment") == "MACHINERY"
    texts = t.customer.select(
        "c_custkey", F.when(whole, ref).otherwise(F.concat(F.lit("zone "), ref, F.lit(" by ${let.level}"))).alias("text")
    )
    constants = t.nation.where("n_regionkey < 4").select(
        F.concat(F.lit("${C.nation."), F.col("n_nationkey"), F.lit("}")).alias("ref"),
        F.col("n_name").alias("value"), F.lit("INT").alias("value_type"),
    )
    return catalog.bind_parameters(texts, constants, ["c_custkey"]).drop("text")


@query(
    "f8_find_unset",
    """WITH c AS (SELECT o_custkey, max(o_orderstatus) AS st, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT c_custkey, c_mktsegment = 'MACHINERY' AS is_duration,
      CASE st WHEN 'P' THEN 'PLACEHOLDER' WHEN 'O' THEN 'soon' ELSE CASE WHEN n > 1 THEN '45m' ELSE ' ' END END AS value
      FROM customer LEFT JOIN c ON o_custkey = c_custkey)
    SELECT 'bench.' || c_custkey AS path, CASE WHEN value IS NULL OR trim(value) = '' OR value = 'PLACEHOLDER' THEN 'unset' ELSE 'not a duration' END AS problem
    FROM r WHERE value IS NULL OR trim(value) = '' OR value = 'PLACEHOLDER' OR (is_duration AND value = 'soon')""",
)
def find_unset(t):
    required = t.customer.select(
        F.concat(F.lit("bench."), F.col("c_custkey")).alias("path"), (F.col("c_mktsegment") == "MACHINERY").alias("is_duration")
    )
    seen = t.orders.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("st"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("st") == "P", "PLACEHOLDER").when(F.col("st") == "O", "soon").when(F.col("n") > 1, "45m").otherwise(" ")
    constants = seen.select(F.concat(F.lit("bench."), F.col("o_custkey")).alias("path"), value.alias("value"))
    return catalog.find_unset(required, constants).select("path", "problem")


@query(
    "f8_branch_problems",
    """WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'B' WHEN 'FURNITURE' THEN 'b' END AS mode,
      CASE WHEN c_nationkey % 3 = 0 THEN '45m' WHEN c_nationkey % 3 = 1 THEN 'soon' END AS bound, CASE WHEN c_acctbal > 0 THEN 'x' ELSE ' ' END AS variant FROM customer)
    SELECT c_custkey AS config_id, 'mode' AS path, 'not a branch' AS problem FROM c WHERE mode IS NULL OR mode = 'b'
    UNION ALL SELECT c_custkey, 'limit', CASE WHEN bound IS NULL THEN 'unset' ELSE 'not a duration' END FROM c WHERE bound IS NULL OR bound = 'soon'
    UNION ALL SELECT c_custkey, 'variant', 'unset' FROM c WHERE mode = 'B' AND variant = ' '""",
)
def branch_problems(t):
    """A customer is a configuration; its segment names the branch, which asks for a variant in one case."""
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey") % 3
    mode = F.when(segment == "BUILDING", "A").when(segment == "MACHINERY", "B").when(segment == "FURNITURE", "b")
    bound = F.when(nation == 0, "45m").when(nation == 1, "soon")
    entries = [("mode", mode), ("limit", bound), ("variant", F.when(F.col("c_acctbal") > 0, "x").otherwise(" "))]
    pairs = F.array(*[F.struct(F.lit(path).alias("path"), value.alias("value")) for path, value in entries])
    constants = t.customer.select(F.col("c_custkey").alias("config_id"), F.explode(pairs).alias("p")).select("config_id", "p.path", "p.value")
    required = t.rows("path STRING, is_duration BOOLEAN, branch STRING", ("mode", False, None), ("limit", True, None), ("variant", False, "B"))
    return catalog.branch_problems(required, constants, "mode", ["A", "B"])
