"""New runs against a snapshot, bound to causal chains, and polled API assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import iso_instant, json_at
from fleetwitness.operators.ordered import last_before, ordered, small_side


def new_runs(runs: DataFrame, snapshot: DataFrame, on: tuple[str, ...] = ("scope", "run_id")) -> DataFrame:
    """Runs that are not in the marker snapshot."""
    return runs.join(snapshot.select(*on), list(on), "left_anti")


def confirmed_new_run(runs: DataFrame, snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """New runs with at least one CONFIRMED action in a chain that was read with status 200.

    ``actions``: scope, run_id, status, outcome.
    """
    confirmed = actions.where((F.col("status") == 200) & (F.col("outcome") == "CONFIRMED")).select("scope", "run_id")
    return new_runs(runs, snapshot).join(confirmed, ["scope", "run_id"], "left_semi")


def chain_as_of(polls: DataFrame, chains: DataFrame) -> DataFrame:
    """Every poll of a run with ``chain``, the newest chain read of that run up to the poll.

    Polls and reads lie on one time line per run, so their numbers never multiply.
    """
    known = F.struct(F.col("status").alias("chain_status"), "matched_at", "executed")
    reads = chains.select("scope", "run_id", "poll_seq", F.lit(0).alias("_side"), known.alias("_chain"))
    rows = polls.withColumn("_side", F.lit(1)).unionByName(reads, allowMissingColumns=True)
    # Reads of one poll number come in an order of their own, so that the scan is total.
    rows = rows.withColumn("_nth", F.coalesce("list_pos", F.xxhash64("_chain")).cast("bigint"))
    seq = ordered(rows, ["scope", "run_id"], ["poll_seq", "_side", "_nth"])
    return seq.scan(chain=last_before("_chain")).where(F.col("_side") == 1).frame().select(*polls.columns, "chain")


def new_run_after(
    runs: DataFrame, snapshot: DataFrame, chains: DataFrame, anchors: DataFrame, snapshot_scopes: DataFrame | None = None
) -> DataFrame:
    """Every poll of a new run with the reason it is ignored, or ``accepted``.

    Reasons in order: the scope has no anchor (a refusal), chain not readable, no trigger
    view, unparseable instant, instant before the anchor observation, no executed action.
    The trigger instant of the chain, as of the poll, binds; the run's own ``triggered_at``
    is compared but never used instead. ``runs``: scope, run_id, poll_seq, list_pos,
    triggered_at; ``chains``: scope, run_id, poll_seq, status, matched_at, executed. Without
    a snapshot (scope not in ``snapshot_scopes``) a scope stays pending.
    """
    fresh = new_runs(runs, snapshot)
    if snapshot_scopes is not None:
        fresh = fresh.join(snapshot_scopes.select("scope").distinct(), "scope", "left_semi")
    joined = chain_as_of(fresh, chains).select(*fresh.columns, "chain.*").join(anchors.select("scope", "m_observed"), "scope", "left")
    matched, triggered = iso_instant(F.col("matched_at")), iso_instant(F.col("triggered_at"))
    reason = (
        F.when(F.col("m_observed").isNull(), "refused: no anchor")
        .when(F.coalesce(F.col("chain_status"), F.lit(0)) != 200, "chain not 200")
        .when(F.col("matched_at").isNull(), "trigger view absent")
        .when(matched.isNull(), "unparseable matchedAt")
        .when(matched < F.col("m_observed"), "predates")
        .when(F.coalesce(F.col("executed"), F.lit(0)) == 0, "no executed action")
        .otherwise("accepted")
    )
    agree = F.coalesce(F.date_trunc("second", matched) == F.date_trunc("second", triggered), F.lit(False))
    return joined.withColumns({"result": reason, "agree": agree})


def liveness_verdict(scopes: DataFrame, judged: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """First accepted run in poll and list order per scope; otherwise FAIL with the number of new runs.

    With ``anchors`` a scope that has none is REFUSED.
    """
    order = F.struct("poll_seq", "list_pos", "run_id")
    per = judged.groupBy("scope").agg(
        F.min_by(F.struct("run_id", "agree"), F.when(F.col("result") == "accepted", order)).alias("won"),
        F.count_distinct("run_id").alias("new_runs"),
    )
    out = scopes.select("scope").distinct().join(per, "scope", "left").withColumn("_anchored", F.lit(True))
    if anchors is not None:
        out = out.drop("_anchored").join(anchors.select("scope", F.lit(True).alias("_anchored")).distinct(), "scope", "left")
    return out.select(
        "scope",
        F.when(F.col("_anchored").isNull(), "REFUSED").when(F.col("won").isNotNull(), "PASS").otherwise("FAIL").alias("status"),
        F.col("won.run_id").alias("run_id"),
        F.col("won.agree").alias("agree"),
        F.coalesce("new_runs", F.lit(0)).cast("bigint").alias("new_runs"),
    )


def parse_body(reads: DataFrame) -> DataFrame:
    """Body text to VARIANT; a cut or broken body is NULL."""
    return reads.withColumn("doc", F.try_parse_json("body"))


def is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def same_text(doc: Column, path: str, value: str, value_type: str = "string") -> Column:
    """Compare a field with a literal by type first, then by text."""
    found = F.try_variant_get(doc, "$." + path, "variant")
    kinds = {
        "string": ["STRING"],
        "boolean": ["BOOLEAN"],
        "bigint": ["BIGINT"],
        "double": ["DOUBLE", "FLOAT"],
    }[value_type]
    kind = F.schema_of_variant(found)
    typed = kind.startswith("DECIMAL") if value_type == "double" else F.lit(False)
    return F.coalesce((kind.isin(*kinds) | typed) & (json_at(doc, path) == F.lit(value)), F.lit(False))


def terminal_state(doc: Column, phase: Column, terminal_path: str = "data.terminal", phase_path: str = "data.currentPhase") -> Column:
    """ok, pending or fail for one read; a wrong terminal phase can never right itself."""
    kind = F.schema_of_variant(F.try_variant_get(doc, "$." + terminal_path, "variant"))
    terminal = F.coalesce((kind == "BOOLEAN") & json_at(doc, terminal_path, "boolean"), F.lit(False))
    right = F.coalesce(json_at(doc, phase_path) == phase, F.lit(False))
    return F.when(~terminal, "pending").when(right, "ok").otherwise("fail")


def rows_state(doc: Column, expected: Column) -> Column:
    """ok when ``data`` is an array of the expected length."""
    rows = F.try_variant_get(doc, "$.data", "array<variant>")
    return F.when(F.coalesce(F.size(rows) == expected, F.lit(False)), "ok").otherwise("pending")


def all_asserts(states: list[Column]) -> Column:
    """First state that is not ok, in the order of the asserts."""
    first = F.filter(F.array(*states), lambda s: s != "ok")
    return F.when(F.size(first) == 0, "ok").otherwise(F.element_at(first, 1))


def assert_state(doc: Column, check: Column, fields: Sequence[tuple[str, str]], run_state: Column) -> Column:
    """ok, pending or fail of one assert of the catalogue on one readable body.

    ``check``: name, field, value, type, ids, n. ``fields`` lists the (field, type) pairs of
    the catalogue; ``run_state`` is what the run conditions said at this read.
    """
    equal = F.lit(False)
    for field, kind in fields:
        same = same_text(doc, field, check["value"], kind)
        equal = F.when((check["field"] == field) & (check["type"] == kind), same).otherwise(equal)
    rows = F.try_variant_get(doc, "$.data", "array<variant>")
    ids = F.transform(rows, lambda r: F.try_variant_get(r, "$.id", "string"))
    same_ids = F.sort_array(F.array_distinct(ids)) == F.sort_array(F.array_distinct(check["ids"]))
    said = F.coalesce(run_state, F.lit("pending"))
    met = (
        F.when(check["name"] == "field_equals", equal)
        .when(check["name"] == "rows", F.size(rows) == check["n"])
        .when(check["name"] == "ulids", same_ids)
    )
    return (
        F.when(check["name"] == "phase_terminal", terminal_state(doc, check["value"]))
        .when(check["name"].isin("new_confirmed_run", "new_run_after"), said)
        .when(F.coalesce(met, F.lit(False)), "ok")
        .otherwise("pending")
    )


def read_states(reads: DataFrame, runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """``state`` of every read under all asserts of its API line, in their order.

    ``reads``: run_id, i, poll_seq, observed_at, status, body, run_state — what the runner read
    for that line, hence after its clock had started. A read without status 200 or with a
    body that is no object is pending. The fields to compare are read from the catalogue
    when the plan is made.
    """
    lines = expectations.where("kind = 'api'").select("scenario", "i", "asserts")
    named = lines.select(F.explode("asserts").alias("a")).where("a.name = 'field_equals'").select("a.field", "a.type").distinct()
    fields = sorted((r["field"], r["type"]) for r in named.collect())
    rows = parse_body(reads.join(runs.select("run_id", "scenario"), "run_id").join(small_side(lines), ["scenario", "i"]))
    states = F.transform("asserts", lambda a: assert_state(F.col("doc"), a, fields, F.col("run_state")))
    first = F.get(F.filter(states, lambda s: s != "ok"), F.lit(0))
    readable = (F.col("status") == 200) & is_object(F.col("doc"))
    state = F.when(~F.coalesce(readable, F.lit(False)), "pending").otherwise(F.coalesce(first, F.lit("ok")))
    return rows.withColumn("state", state).drop("doc", "asserts")


def decide_api(reads: DataFrame, state: Column, keys: list[str]) -> DataFrame:
    """First decisive poll per key; without one the line stays pending (expected-not-seen).

    ``reads``: keys, poll_seq, status, doc. Reads that are not a 200 JSON object
    stay pending.
    """
    usable = (F.col("status") == 200) & F.col("doc").isNotNull() & is_object(F.col("doc"))
    polled = reads.withColumn("state", F.when(usable, state).otherwise("pending"))
    decisive = F.when(F.col("state") != "pending", F.col("poll_seq"))
    return polled.groupBy(*keys).agg(
        F.coalesce(F.min_by("state", decisive), F.lit("pending")).alias("state"),
        F.min(decisive).alias("decided_at_poll"),
        F.count(F.lit(1)).alias("polls"),
    )


def terminal_reads(expectations: DataFrame, terminal_field: str = "data.terminal") -> DataFrame:
    """API lines that read the end of a command: ``phase_terminal``, or ``field_equals`` on the field.

    ``expectations``: …, asserts ARRAY<STRUCT<name, field, value>>.
    """
    return expectations.where(
        F.exists(
            "asserts",
            lambda a: (a["name"] == "phase_terminal")
            | ((a["name"] == "field_equals") & (a["field"] == terminal_field)),
        )
    )


def command_target(path: Column) -> Column:
    """Entity id out of the command path, NULL for any other path."""
    return F.nullif(F.regexp_extract(path, r"^/api/v1/entities/([^/]+)/commands$", 1), F.lit(""))


def row_count_equals(rows: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Rows per key against the expected number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("equal", F.col("n") == expected)


def id_set_equal(found: DataFrame, expected: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Missing and extra ids per key, by a join on the id; equal sets have neither."""
    f = found.select(*keys, id_col).distinct().withColumn("_f", F.lit(1))
    e = expected.select(*keys, id_col).distinct().withColumn("_e", F.lit(1))
    both = f.join(e, [*keys, id_col], "full")
    return both.groupBy(*keys).agg(
        F.count(F.when(F.col("_f").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("extra"),
    ).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def id_set_delta(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected ∖ found and found ∖ expected, labeled. Both have the same columns."""
    missing = expected.distinct().join(found, expected.columns, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.distinct().join(expected, found.columns, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def select_other(levels: Column, current: Column) -> Column:
    """First member of the list whose text differs from the current value; NULL when none does."""
    return F.try_element_at(F.filter(levels, lambda x: x.cast("string") != current.cast("string")), F.lit(1))
