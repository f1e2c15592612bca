"""Ordered expectations and forbidden lines to one verdict per run.

Matching lines are thinned out where they are read, reduced map-side to the one
line that decides each expectation, and then folded per run. What is kept per run
is one row per line of its scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros, whole_number
from fleetwitness.operators.liveness import read_states
from fleetwitness.operators.logs import captured, keep_mentioned, lines_by_token, match_tokens, needs, nth_match
from fleetwitness.operators.ordered import small_side


def deciding_lines(matches: DataFrame, max_need: int, max_numbered: int | None = None) -> DataFrame:
    """Lines that can satisfy an expectation as they arrive; the first by index does.

    Without ``extract`` that is the N-th match; with it, the first match from the
    N-th on whose number reaches the minimum. Only expectations that need more
    than one match are ranked; the others are a plain minimum. ``max_numbered`` is
    the largest need among the lines with ``extract``.
    """
    value = captured(F.col("text"), F.col("extract"))
    reaches = value.isNotNull() & (F.col("min_value").isNull() | (whole_number(value) >= F.col("min_value")))
    reaches = F.coalesce(reaches, F.lit(False))
    numbered = F.col("extract").isNotNull()
    hits = matches.where((F.col("need") == 1) & (~numbered | reaches))
    if max_need > 1:
        ranked = matches.where(F.col("need") > 1)
        nth = nth_match(ranked, max_need)
        hits = hits.unionByName(nth.where(~numbered))
        if max_numbered is None or max_numbered > 1:
            late = ranked.where(numbered & reaches).join(
                nth.where(numbered).select("run_id", "i", F.col("idx").alias("_nth")), ["run_id", "i"]
            )
            hits = hits.unionByName(late.where(F.col("idx") >= F.col("_nth")).drop("_nth"))
    return hits.select("run_id", "scenario", "i", "idx", micros(F.col("observed_at")).alias("m_us"))


def expected_lines(runs: DataFrame, expectations: DataFrame, *columns: str) -> DataFrame:
    """One row per run and line of its scenario."""
    return runs.join(small_side(expectations.select("scenario", "i", *columns)), "scenario")


def chain_deadlines(runs: DataFrame, expectations: DataFrame, deciding: DataFrame, grace_s: float = 0.0) -> DataFrame:
    """Match time, deadline and result of every expectation of a run.

    A line's clock starts when the line before it was satisfied, so its start is
    the running maximum of the earlier match times and the start of the run. The
    expected and the deciding lines meet in one aggregation, so a line that was
    never met is a row too. A read that can never right itself (``wrong_us``) fails its
    line at once.
    """
    blank = F.lit(None).cast("bigint")
    expected = expected_lines(runs, expectations, "within_s").select(
        "run_id", "scenario", "i", micros(F.col("t0")).alias("t0_us"), "within_s", blank.alias("idx"), blank.alias("m_us"),
        blank.alias("api_us"), blank.alias("wrong_us"),
    )
    rows = expected.unionByName(deciding, allowMissingColumns=True)
    per_line = rows.groupBy("run_id", "scenario", "i").agg(
        F.max("t0_us").alias("t0_us"), F.max("within_s").alias("within_s"), F.min("idx").alias("idx"),
        F.coalesce(F.min_by("m_us", "idx"), F.min("api_us")).alias("m_us"), F.min("wrong_us").alias("wrong_us"),
    )
    before = F.max("m_us").over(
        Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    )
    # greatest() passes over NULL: a line that was never met moves no clock.
    start = F.greatest("t0_us", before)
    deadline = start + F.col("within_s").cast("bigint") * 1_000_000 + int(grace_s * 1_000_000)
    return per_line.withColumn("deadline_us", deadline).withColumn(
        "ok", F.coalesce(F.col("m_us") <= F.col("deadline_us"), F.lit(False))
    )


def with_anchors(forbidden: DataFrame, expectations: DataFrame) -> DataFrame:
    """Forbidden lines with the positions of the lines that name their anchor token.

    Catalogue only: ``anchor_lines`` is NULL for a line without ``after_token``.
    """
    tokens = expectations.select("scenario", "i", F.explode("tokens").alias("after_token"))
    named = forbidden.join(tokens, ["scenario", "after_token"], "left")
    return named.groupBy("scenario", "j", "token", "after_token").agg(F.collect_set("i").alias("_lines")).select(
        "scenario", "j", "token", F.when(F.col("after_token").isNotNull(), F.col("_lines")).alias("anchor_lines")
    )


def active_forbidden(judged: DataFrame, forbidden: DataFrame, expectations: DataFrame, earliest: bool) -> DataFrame:
    """Forbidden lines per run, with the index below which they count.

    ``judged`` has ``met``, the (i, idx) of satisfied lines. Several of them may name
    the token (every member of an OR line counts). With deadlines the forbidden line
    is watched from the ``earliest`` of them on; over a finished window the last one
    is the anchor. An unmet anchor leaves its forbidden line inactive.
    """
    specs = judged.join(small_side(with_anchors(forbidden, expectations)), "scenario")
    naming = F.filter("met", lambda m: F.array_contains(F.col("anchor_lines"), m["i"]))
    anchor = F.array_min(F.transform(naming, lambda m: m["idx"])) if earliest else F.array_max(naming)["idx"]
    specs = specs.withColumn("anchor_idx", F.when(F.col("anchor_lines").isNotNull(), anchor))
    return specs.where(F.col("anchor_lines").isNull() | F.col("anchor_idx").isNotNull())


def forbidden_lines(lines: DataFrame, specs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Lines that a forbidden line of their run names; no text is shuffled unless the catalogue is large."""
    below = F.col("anchor_idx").isNull() | (F.col("idx") > F.col("anchor_idx"))
    held = lines_by_token(lines, forbidden.select("token"))
    if held is not None:
        return held.join(specs, ["run_id", "token"]).where(below)
    mentioned = keep_mentioned(lines, forbidden.select("token"))
    return mentioned.join(specs, "run_id").where(F.contains("text", F.col("token")) & below)


def verdict_rows(checked: DataFrame) -> DataFrame:
    """First failed line, end, and satisfied lines of each run.

    ``last_idx`` is the last line that counted; lines after the failed one do not.
    """
    failed_i = F.min(F.when(~F.col("ok"), F.col("i"))).over(Window.partitionBy("run_id"))
    rows = checked.withColumn("failed_i", failed_i)
    met = F.col("failed_i").isNull() | (F.col("i") < F.col("failed_i"))
    return rows.groupBy("run_id", "scenario").agg(
        F.max("t0_us").alias("t0_us"),
        F.count(F.lit(1)).alias("n"),
        F.max("failed_i").alias("failed_i"),
        F.max(F.when(F.col("i") == F.col("failed_i"), F.col("m_us"))).alias("failed_m_us"),
        F.coalesce(
            F.max(F.when(F.col("i") == F.col("failed_i"), F.least("deadline_us", "wrong_us"))), F.max("m_us")
        ).alias("end_us"),
        F.max(F.when(met, F.col("idx"))).alias("last_idx"),
        F.collect_list(F.when(met, F.struct("i", "idx"))).alias("met"),
    )


def deciding_reads(reads: DataFrame, runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """The first read that decides each API line: ``api_us`` when it met it, ``wrong_us`` when it never will."""
    decisive = read_states(reads, runs, expectations).where("state <> 'pending'")
    first = decisive.groupBy("run_id", "scenario", "i").agg(
        F.min_by(F.struct("state", micros(F.col("observed_at")).alias("us")), "poll_seq").alias("d")
    )
    at = lambda state: F.when(F.col("d.state") == state, F.col("d.us"))
    return first.select("run_id", "scenario", "i", at("ok").alias("api_us"), at("fail").alias("wrong_us"))


def check_lines(
    runs: DataFrame, expectations: DataFrame, lines: DataFrame, reads: DataFrame | None = None, grace_s: float = 0.0
) -> DataFrame:
    """Every expectation of every run with its match time, deadline and result; log and API
    lines on one chain of clocks. Lines of ``kind`` 'api' have asserts, the others tokens."""
    of_log = expectations if "kind" not in expectations.columns else expectations.where("kind = 'log'")
    matches = match_tokens(lines, runs, of_log)
    deciding = deciding_lines(matches, *needs(of_log))
    if reads is not None:
        deciding = deciding.unionByName(deciding_reads(reads, runs, expectations), allowMissingColumns=True)
    return chain_deadlines(runs, expectations, deciding, grace_s)


def line_results(checked: DataFrame) -> DataFrame:
    """One row per expectation of a run: ``mark`` is [ok], [X] for the line that failed, and
    [ ] for those behind it, which were not waited for."""
    failed_i = F.min(F.when(~F.col("ok"), F.col("i"))).over(Window.partitionBy("run_id"))
    rows = checked.withColumn("_failed", failed_i)
    mark = F.when(F.col("_failed").isNull() | (F.col("i") < F.col("_failed")), "[ok]").when(F.col("i") == F.col("_failed"), "[X]")
    return rows.select(
        "run_id", "scenario", "i", mark.alias("_mark"), "idx", (F.col("m_us") - F.col("t0_us")).alias("after_us"),
        (F.col("deadline_us") - F.col("t0_us")).alias("deadline_after_us"),
    ).withColumn("mark", F.coalesce("_mark", F.lit("[ ]"))).drop("_mark")


def adjudicate(
    runs: DataFrame, expectations: DataFrame, forbidden: DataFrame, lines: DataFrame, grace_s: float = 0.0,
    reads: DataFrame | None = None,
) -> DataFrame:
    """Verdict per run with chained deadlines, over log lines and, with ``reads``, API lines.

    The first line that misses its deadline decides. A forbidden line seen up to
    the end of the run (last match, or the missed deadline) decides before it; the
    earliest one is named.
    """
    judged = verdict_rows(check_lines(runs, expectations, lines, reads, grace_s))
    specs = active_forbidden(judged, forbidden, expectations, earliest=True).select("run_id", "j", "token", "anchor_idx", "end_us")
    at_us = micros(F.col("observed_at"))
    hit = (
        forbidden_lines(lines, specs, forbidden)
        .where(at_us <= F.col("end_us"))
        .groupBy("run_id")
        .agg(F.min(F.struct(at_us.alias("at_us"), "j", "idx", "token")).alias("hit"))
    )
    bad = F.col("hit").isNotNull()
    reason = (
        F.when(bad, F.concat(F.lit("forbidden hit: "), F.col("hit.token")))
        .when(F.col("failed_i").isNotNull(), F.concat(F.lit("expected-not-seen: line "), F.col("failed_i")))
        .otherwise(F.concat(F.col("n"), F.lit("/"), F.col("n"), F.lit(" positive · 0 forbidden")))
    )
    return judged.join(hit, "run_id", "left").select(
        "run_id",
        "scenario",
        F.when(bad | F.col("failed_i").isNotNull(), "FAIL").otherwise("PASS").alias("status"),
        reason.alias("reason"),
        F.when(~bad, F.col("failed_i")).alias("failed_i"),
        F.col("hit.idx").alias("forbidden_idx"),
        "last_idx",
        (F.coalesce(F.col("hit.at_us"), F.col("end_us")) - F.col("t0_us")).alias("decided_after_us"),
    )


def count_lines(runs: DataFrame, expectations: DataFrame, lines: DataFrame) -> DataFrame:
    """Per run and line: matches, deciding index, and whether the line is satisfied.

    Of what ``extract`` captures a row carries the number and whether there is a text, not the text: buffers
    of fixed length are hashed where lines are read, texts would have a task sort all its lines.
    """
    matches = match_tokens(lines, runs, expectations)
    value = captured(F.col("text"), F.col("extract"))
    rows = matches.withColumn("_value", value).select(
        "run_id", "scenario", "i", "idx", F.lit(1).cast("bigint").alias("one"),
        F.when(F.col("need") == 1, F.col("idx")).alias("nth"),
        F.col("_value").isNotNull().alias("captured"), whole_number(F.col("_value")).alias("number"),
    )
    max_need, _ = needs(expectations)
    if max_need > 1:
        nth = nth_match(matches.where(F.col("need") > 1), max_need)
        rows = rows.unionByName(nth.select("run_id", "scenario", "i", F.col("idx").alias("nth")), allowMissingColumns=True)
    numbered = F.col("extract").isNotNull().alias("numbered")
    expected = expected_lines(runs, expectations, "need", "extract", "min_value").select(
        "run_id", "scenario", "i", "need", numbered, "min_value"
    )
    per_line = rows.unionByName(expected, allowMissingColumns=True).groupBy("run_id", "scenario", "i").agg(
        F.max("need").alias("need"), F.max("numbered").alias("numbered"),
        F.max("min_value").alias("min_value"), F.coalesce(F.sum("one"), F.lit(0)).alias("seen"),
        F.min("nth").alias("nth"), F.max("idx").alias("last"),
        F.max_by("captured", "idx").alias("captured"), F.max_by("number", "idx").alias("number"),
    )
    reaches = F.coalesce(F.col("captured"), F.lit(False)) & (
        F.col("min_value").isNull() | F.coalesce(F.col("number") >= F.col("min_value"), F.lit(False))
    )
    return per_line.withColumns(
        {
            "ok": (F.col("seen") >= F.col("need")) & (~F.col("numbered") | reaches),
            "at": F.when(F.col("numbered"), F.col("last")).otherwise(F.col("nth")),
        }
    )


def adjudicate_window(
    runs: DataFrame, expectations: DataFrame, forbidden: DataFrame, lines: DataFrame
) -> DataFrame:
    """Verdict per run over a finished window, without deadlines.

    Every line is evaluated; a forbidden hit (first in list order, then in file
    order) outranks the first failed line. With ``extract`` only the last match is
    tested.
    """
    judged = count_lines(runs, expectations, lines).groupBy("run_id", "scenario").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("i", "seen", "need"), F.when(~F.col("ok"), F.col("i"))).alias("f"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_idx"),
        F.collect_list(F.when(F.col("ok"), F.struct("i", F.col("at").alias("idx")))).alias("met"),
    )
    specs = active_forbidden(judged, forbidden, expectations, earliest=False).select("run_id", "j", "token", "anchor_idx")
    hit = forbidden_lines(lines, specs, forbidden).groupBy("run_id").agg(F.min(F.struct("j", "idx", "token")).alias("hit"))
    failed = F.format_string("expected-not-seen: line %d (saw %d/%d)", "f.i", "f.seen", "f.need")
    return judged.join(hit, "run_id", "left").select(
        "run_id",
        "scenario",
        F.when(F.col("hit").isNotNull() | F.col("f").isNotNull(), "FAIL").otherwise("PASS").alias("status"),
        F.when(F.col("hit").isNotNull(), F.concat(F.lit("forbidden hit: "), F.col("hit.token")))
        .when(F.col("f").isNotNull(), failed)
        .otherwise(F.concat(F.col("n"), F.lit(" log positive(s) satisfied")))
        .alias("reason"),
        F.col("f.i").alias("failed_i"),
        F.col("hit.idx").alias("forbidden_idx"),
        "last_idx",
    )
