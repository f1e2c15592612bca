"""Log lines: token matching, window scoping, slices, boot outcomes, outages."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros_between, whole_number
from fleetwitness.operators.grams import gram_counts, key_maps, keys_in, lengths_of, rarest_key
from fleetwitness.operators.ordered import (
    cut_lineage,
    last_before,
    next_after,
    ordered,
    TASK_RANKS,
    previous,
    ranked_upto,
    running_sum,
    small_side,
    smallest,
)

# Token families of the health report.
HEALTH_TOKENS = (
    "projection_live", "adoption_maps_rehydrated", "network_restored_from_parameters",
    "network_formed", "network_resumed", "zigbee.network_up", "permit_join_opened",
    "device_relinked", "device_announce", "device_proposed", "reporting_configured",
    "key_establish",
)
FAILURE_TOKENS = (
    "integration.failed", "transient_failure", "network_parameter_mismatch",
    "auto_detect_failed", "transport_failed", "reporting_ack_lies", "ERROR",
)

# Up to here a catalogue is spelled out as a column expression; a larger one is met by its rarest grams.
MAX_PATTERNS = 256
# So many expectations of one token, on average at most, meet its lines in one task.
CROWD = 3_000


def mentions_any(text: Column, tokens: Sequence[str]) -> Column:
    """Whether the text contains one of a few tokens; never, without tokens."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens], F.lit(False))


def keep_mentioned(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """Drop lines that contain none of the catalogue's tokens, before any shuffle.

    ``tokens`` has one column. Up to ``MAX_PATTERNS`` distinct ones are spelled out; of more, lines
    are kept that have a key of one, so a few without a token stay.
    """
    own = tokens.toDF("token").where("token IS NOT NULL").distinct()
    found = sorted(r[0] for r in own.take(MAX_PATTERNS + 1))
    if len(found) <= MAX_PATTERNS:
        return lines.where(mentions_any(F.col("text"), found))
    lengths = lengths_of(own)
    keyed = own.select(rarest_key(gram_counts(lines, lengths))(F.col("token")).alias("key"))
    return lines.where(F.size(keys_in(key_maps(keyed), lengths)(F.col("text"))) > 0)


def lines_by_token(lines: DataFrame, tokens: DataFrame) -> DataFrame | None:
    """One row per line and token of the catalogue that it contains, without its text, tested where a
    line is read; None for a catalogue of more than ``MAX_PATTERNS``."""
    found = sorted(r[0] for r in tokens.toDF("token").where("token IS NOT NULL").distinct().take(MAX_PATTERNS + 1))
    if len(found) > MAX_PATTERNS:
        return None
    has = [F.when(F.contains(F.col("text"), F.lit(t)), F.lit(t)) for t in found] or [F.lit(None).cast("string")]
    held = lines.where(mentions_any(F.col("text"), found)).withColumn("token", F.explode(F.array_compact(F.array(*has))))
    return held.drop("text")


def run_expectations(runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """One row per run and expectation of its scenario."""
    return runs.join(small_side(expectations), "scenario")


def pattern_key() -> Column:
    return F.to_json(F.struct("tokens", F.coalesce("same_line", F.array().cast("array<string>")).alias("same_line")))


def pattern_test(text: Column, tokens: Sequence[str], same_line: Sequence[str]) -> Column:
    def has(t: str) -> Column:
        return F.contains(text, F.lit(t))

    some = functools.reduce(lambda a, b: a | b, [has(t) for t in tokens], F.lit(False))
    return functools.reduce(lambda a, b: a & b, [has(t) for t in same_line], some)


def match_tokens(lines: DataFrame, runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """Lines that contain any token and every ``same_line`` text of an expectation of their run.

    Up to ``MAX_PATTERNS`` distinct patterns are one column expression, tested where a line is read.
    A larger catalogue stays a table: a line meets a token by the token's rarest gram (see
    ``grams``). Both ways give the same; only lines that can match are shuffled, by run. A NULL line
    matches nothing, an empty token every other line.
    """
    rows = expectations.select("tokens", "same_line", pattern_key().alias("key")).dropDuplicates(["key"])
    found = sorted(rows.take(MAX_PATTERNS + 1), key=lambda r: r["key"])
    if len(found) > MAX_PATTERNS:
        return _match_by_grams(lines, runs, expectations)
    tests = [
        F.when(pattern_test(F.col("text"), r["tokens"] or [], r["same_line"] or []), F.lit(n))
        for n, r in enumerate(found)
    ]
    number = F.create_map(*[x for n, r in enumerate(found) for x in (F.lit(r["key"]), F.lit(n))]).cast("map<string,int>")
    marked = lines.withColumn("_pattern", F.explode(F.array_compact(F.array(*tests).cast("array<int>"))))
    wanted = small_side(expectations.withColumn("_pattern", F.element_at(number, pattern_key())))
    return marked.join(runs, "run_id").join(wanted, ["scenario", "_pattern"]).drop("_pattern")


def _match_by_grams(lines: DataFrame, runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """A line meets the different tokens first, by their keys, and only a token that it contains leads
    on to the expectations that hold it. Those are met by the first token that the line contains, so
    once, in a last join that nothing comes after; what the token itself contains is not tested again.
    Expectations that share one token are dealt into parts of ``CROWD``."""
    wanted = expectations.withColumn("_token", F.explode(F.array_distinct("tokens"))).where("_token IS NOT NULL")
    tokens = wanted.select(F.col("_token").alias("token")).distinct()
    lengths = lengths_of(tokens)
    # Kept, so that the bitmaps and the join see the same keys and they are made once.
    keyed = cut_lineage(tokens.withColumn("_key", rarest_key(gram_counts(lines, lengths))(F.col("token"))))
    maps = key_maps(keyed.select(F.col("_key").alias("key")))
    met = lines.withColumn("_key", F.explode(keys_in(maps, lengths)(F.col("text"))))
    held = met.join(keyed.withColumnRenamed("token", "_token"), "_key").where(F.contains(F.col("text"), F.col("_token"))).drop("_key")
    crowds = wanted.groupBy("scenario", "_token").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.broadcast(cut_lineage(crowds))
    dealt = lambda df: df.join(parts, ["scenario", "_token"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    earlier = F.expr("array_compact(slice(tokens, 1, cast(array_position(tokens, _token) - 1 AS INT)))")
    rest = F.filter(F.coalesce("same_line", F.array().cast("array<string>")), lambda s: ~F.coalesce(F.contains(F.col("_token"), s), F.lit(False)))
    members = dealt(wanted.withColumns({"_earlier": earlier, "_rest": rest}))
    members = members.withColumn("_part", F.pmod(F.xxhash64(*expectations.columns), F.col("_parts")).cast("int")).drop("_parts")
    spread = dealt(held.join(runs, "run_id")).withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)"))).drop("_parts")
    # Dealt by the join itself: a broadcast would leave all lines of a frequent token in the task that found them.
    both = spread.join(members.hint("merge"), ["scenario", "_token", "_part"])
    has = lambda t: F.contains(F.col("text"), t)
    first = (F.size("_earlier") == 0) | ~F.exists("_earlier", has)
    every = (F.size("_rest") == 0) | F.forall("_rest", has)
    return both.where(first & every).drop("_token", "_part", "_earlier", "_rest")


def at_least(matches: DataFrame, run_exp: DataFrame) -> DataFrame:
    """Matches per expectation against the needed number; no match is a row with 0."""
    seen = matches.groupBy("run_id", "i").agg(F.count(F.lit(1)).alias("seen"))
    out = run_exp.select("run_id", "i", "need").join(seen, ["run_id", "i"], "left")
    n = F.coalesce(F.col("seen"), F.lit(0)).cast("bigint")
    return out.withColumns({"seen": n, "ok": n >= F.col("need")}).withColumn(
        "progress", F.concat(F.lit("saw "), F.col("seen"), F.lit("/"), F.col("need"))
    )


def captured(text: Column, pattern: Column) -> Column:
    """Capture group 1 of the expectation's pattern, NULL when it finds nothing."""
    return F.when(F.regexp_like(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(1)))


def extract_min(matches: DataFrame, need: str = "need") -> DataFrame:
    """Number in the last matching line and whether it reaches the minimum."""
    wanted = matches.where(F.col("extract").isNotNull())
    last = wanted.groupBy("run_id", "i").agg(
        F.max_by(F.struct("idx", "text", "extract", "min_value", F.col(need).alias("need")), "idx").alias("l"),
        F.count(F.lit(1)).alias("seen"),
    )
    value = captured(F.col("l.text"), F.col("l.extract"))
    number = whole_number(value)
    return last.select(
        "run_id",
        "i",
        "seen",
        F.col("l.idx").alias("idx"),
        value.alias("value"),
        (
            (F.col("seen") >= F.col("l.need"))
            & value.isNotNull()
            & (F.col("l.min_value").isNull() | F.coalesce(number >= F.col("l.min_value"), F.lit(False)))
        ).alias("ok"),
    )


def nth_match(matches: DataFrame, max_need: int) -> DataFrame:
    """The line that completes the needed number of matches."""
    keys = ["run_id", "i"]
    if max_need > TASK_RANKS:
        rows = ranked_upto(matches, keys, F.col("idx"), F.col("need"), only_limit=True)
    else:
        rows = smallest(matches, keys, [F.col("idx")], max_need)
    return rows.where(F.col("_rank") == F.col("need")).drop("_rank")


def needs(expectations: DataFrame) -> tuple[int, int]:
    """Largest needed number of matches: over all lines, and over those with ``extract`` (0 if none)."""
    numbered = F.max(F.when(F.col("extract").isNotNull(), F.col("need")))
    largest = expectations.agg(F.max("need"), numbered).first()
    return int(largest[0] or 0), int(largest[1] or 0)


def first_observed(matches: DataFrame) -> DataFrame:
    """Earliest instant at which each token really appeared in a matching line.

    Tokens of an OR line that did not appear get no instant.
    """
    seen = matches.select("run_id", "observed_at", "text", F.explode("tokens").alias("token"))
    return (
        seen.where(F.contains(F.col("text"), F.col("token")))
        .groupBy("run_id", "token")
        .agg(F.min("observed_at").alias("m_observed"))
    )


def forbidden_hits(
    lines: DataFrame, run_forbidden: DataFrame, satisfied: DataFrame, catalogue: DataFrame | None = None
) -> DataFrame:
    """Forbidden tokens; one with ``after_token`` counts strictly below its anchor's line.

    ``satisfied``: run_id, token, anchor_idx — an anchor that was not met leaves
    its forbidden line inactive.
    """
    mentioned = lines if catalogue is None else keep_mentioned(lines, catalogue.select("token"))
    anchors = satisfied.select("run_id", F.col("token").alias("after_token"), "anchor_idx")
    active = run_forbidden.join(anchors, ["run_id", "after_token"], "left").where(
        F.col("after_token").isNull() | F.col("anchor_idx").isNotNull()
    )
    below = F.col("anchor_idx").isNull() | (F.col("idx") > F.col("anchor_idx"))
    return mentioned.join(active, "run_id").where(F.contains(F.col("text"), F.col("token")) & below)


def outstanding(run_exp: DataFrame, satisfied: DataFrame) -> DataFrame:
    """Expectations without a satisfied token; one member satisfies an OR line."""
    members = run_exp.select("run_id", "i", F.explode("tokens").alias("token"))
    met = members.join(satisfied.select("run_id", "token").distinct(), ["run_id", "token"], "left_semi")
    out = run_exp.join(met.select("run_id", "i").distinct(), ["run_id", "i"], "left_anti")
    return out.withColumn("waiting_for", F.array_join("tokens", " OR "))


def scope_to_window(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """Lines at or after the byte offset of the run's latest marker."""
    latest = markers.groupBy("run_id").agg(F.max_by("log_offset", "seq").alias("log_offset"))
    return lines.join(small_side(latest), "run_id").where(F.col("byte_off") >= F.col("log_offset"))


def in_time_window() -> Column:
    """A stamped line 0–12 h after the start of the run, past midnight too."""
    ahead = F.pmod(F.floor(F.col("tod_ms") / 1000) - F.floor(F.col("start_ms") / 1000), F.lit(86400))
    return F.col("tod_ms").isNotNull() & (ahead <= 43200)


def window_label(total: Column, cap: int | None) -> Column:
    """Names the slice, and the cut if there was one."""
    if cap is None:
        return F.lit("time window")
    return F.when(total > cap, F.format_string(f"time window, last {cap} of %d lines", total)).otherwise(F.lit("time window"))


def time_of_day_slice(lines: DataFrame, runs: DataFrame, cap: int | None = None) -> DataFrame:
    """Lines from the first stamped line 0–12 h after the run start to the end of the log.

    ``runs``: run_id, start_ms (time of day). A report that wants no more than the last
    ``cap`` lines says so; the label then names the cut.
    """
    rows = lines.join(small_side(runs.select("run_id", "start_ms")), "run_id").where(F.col("text") != "")
    begin = rows.groupBy("run_id").agg(F.min(F.when(in_time_window(), F.col("idx"))).alias("begin"))
    kept = rows.join(begin, "run_id").where(F.col("idx") >= F.col("begin"))
    total = kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    tail = kept if cap is None else smallest(kept, ["run_id"], [F.col("idx").desc()], cap, -F.col("idx")).drop("_rank")
    return tail.join(total, "run_id").withColumn("label", window_label(F.col("total"), cap))


def evidence_slice(lines: DataFrame, runs: DataFrame, markers: DataFrame, cap: int | None = None) -> DataFrame:
    """Best available slice per run, with its source named.

    window (latest marker) → re-read (first marker) → time window when the run has
    no marker → no lines. A run without lines keeps one row with a NULL line. ``cap``
    bounds a time window only; the label then names the cut.
    """
    offsets = markers.groupBy("run_id").agg(
        F.max_by("log_offset", "seq").alias("_latest"), F.min_by("log_offset", "seq").alias("_first")
    )
    facts = runs.select("run_id", "start_ms").join(offsets, "run_id", "left")
    rows = lines.join(small_side(facts), "run_id").where(F.col("text") != "")
    tiers = rows.groupBy("run_id").agg(
        F.max(F.col("byte_off") >= F.col("_latest")).alias("_window"),
        F.max(F.col("byte_off") >= F.col("_first")).alias("_reread"),
        F.min(F.when(F.col("_latest").isNull() & in_time_window(), F.col("idx"))).alias("_begin"),
    )
    tier = (
        F.when(F.col("_window"), "window").when(F.col("_reread"), "re-read").when(F.col("_begin").isNotNull(), "time-window")
    )
    begin = tiers.select("run_id", tier.alias("tier"), "_begin").where(F.col("tier").isNotNull())
    inside = (
        F.when(F.col("tier") == "window", F.col("byte_off") >= F.col("_latest"))
        .when(F.col("tier") == "re-read", F.col("byte_off") >= F.col("_first"))
        .otherwise(F.col("idx") >= F.col("_begin"))
    )
    kept = rows.join(begin, "run_id").where(inside).select("run_id", "idx", "text", "tier", F.col("tier").alias("label"))
    timed = kept.where(F.col("tier") == "time-window")
    total = timed.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    if cap is not None:
        timed = smallest(timed, ["run_id"], [F.col("idx").desc()], cap, -F.col("idx")).drop("_rank")
    timed = timed.join(total, "run_id").withColumn("label", window_label(F.col("total"), cap)).drop("total")
    none = runs.select("run_id").join(begin, "run_id", "left_anti").withColumns({"tier": F.lit("none"), "label": F.lit("none")})
    return (
        kept.where(F.col("tier") != "time-window")
        .unionByName(timed)
        .unionByName(none, allowMissingColumns=True)
    )


def mentions(text: Column, tokens: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])


def health_tokens(
    lines: DataFrame,
    key: str = "boot_id",
    health: Sequence[str] = HEALTH_TOKENS,
    failure: Sequence[str] = FAILURE_TOKENS,
    last_health: int = 20,
    last_failure: int = 10,
) -> DataFrame:
    """Last health and last failure lines of each boot."""
    families = F.array_compact(
        F.array(
            F.when(mentions(F.col("text"), health), F.lit("health")),
            F.when(mentions(F.col("text"), failure), F.lit("failure")),
        )
    )
    limit = F.when(F.col("family") == "health", last_health).otherwise(last_failure)
    rows = lines.withColumn("family", F.explode(families))
    last = smallest(rows, [key, "family"], [F.col("idx").desc()], max(last_health, last_failure), -F.col("idx"))
    return last.where(F.col("_rank") <= limit).drop("_rank")


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows per key; ``order`` is a whole number, unique per key."""
    return smallest(df, keys, [F.col(order).desc()], n, -F.col(order)).drop("_rank")


def boot_outcome(
    lines: DataFrame,
    starts: DataFrame,
    key: str = "boot_id",
    up: str = "zigbee.network_up",
    failed: str = "integration.failed",
    limit_s: float = 90,
) -> DataFrame:
    """FAILED, UP or UNDECIDED per boot within the limit; a failure is checked first.

    ``starts``: key, started_at. The poll looks once a second, and a failure wins
    over an up signal of the same second.
    """
    rows = lines.join(starts, key)
    after = micros_between(F.col("started_at"), F.col("observed_at"))
    second = F.ceil(after / F.lit(1_000_000)).cast("bigint")
    token = F.when(F.contains("text", F.lit(failed)), 0).when(F.contains("text", F.lit(up)), 1)
    hits = rows.where(token.isNotNull() & (after >= 0) & (second <= limit_s)).withColumns(
        {"_second": F.greatest(second, F.lit(1)), "_rank": token}
    )
    first = hits.groupBy(key).agg(F.min(F.struct("_second", "_rank")).alias("d"))
    outcome = F.when(F.col("d._rank") == 0, "FAILED").when(F.col("d._rank") == 1, "UP").otherwise("UNDECIDED")
    return starts.join(first, key, "left").select(
        key, outcome.alias("outcome"), F.col("d._second").alias("after_s")
    )


def position_regressions(positions: DataFrame, watermark: Column, keys: Sequence[str] = ("bench_id",)) -> DataFrame:
    """Boots whose replayed position fell below the boot before or below the watermark.

    ``positions``: keys, boot_seq, position.
    """
    seq = ordered(positions, keys, ["boot_seq"]).scan(prev_position=previous("position"))
    fell = F.coalesce(F.col("position") < F.col("prev_position"), F.lit(False))
    below = F.coalesce(F.col("position") < watermark, F.lit(False))
    return seq.frame().withColumns({"fell": fell, "below_watermark": below}).where("fell OR below_watermark")


def outage_intervals(
    lines: DataFrame,
    key: str = "boot_id",
    lost: Sequence[str] = ("zigbee.transport_failed", "zigbee.port_unhealthy"),
    back: Sequence[str] = ("zigbee.reopened",),
    retry: Sequence[str] = ("zigbee.reopen_no_target",),
) -> DataFrame:
    """Port loss to the next reopen: duration, retries in between, recovered or not."""
    text = F.col("text")
    marked = lines.where(mentions(text, [*lost, *back, *retry])).withColumns(
        {"_lost": mentions(text, lost), "_back": mentions(text, back), "_retry": mentions(text, retry)}
    )
    # An outage starts at the first loss after a reopen (or after the start of the boot).
    kind = F.when(F.col("_back"), "back").when(F.col("_lost"), "lost")
    seq = ordered(marked, [key], ["idx"]).scan(_state=last_before(kind))
    starts = (F.coalesce(F.col("_state"), F.lit("back")) == "back") & (kind == "lost")
    seq = seq.with_columns({"_starts": F.coalesce(starts, F.lit(False))})
    reopened = F.when(F.col("_back"), F.struct("idx", "observed_at"))
    seq = seq.scan(outage=running_sum(F.col("_starts").cast("bigint")), _reopen=next_after(reopened))
    rows = seq.where(F.col("outage") > 0).frame()
    before_reopen = F.col("_retry") & F.coalesce(F.col("_state") == "lost", F.lit(False))
    return rows.groupBy(key, "outage").agg(
        F.min(F.when(F.col("_starts"), F.col("observed_at"))).alias("lost_at"),
        F.max(F.when(F.col("_starts"), F.col("_reopen.observed_at"))).alias("reopened_at"),
        F.count(F.when(before_reopen, 1)).alias("retries"),
    ).withColumns(
        {
            "recovered": F.col("reopened_at").isNotNull(),
            "duration_us": micros_between(F.col("lost_at"), F.col("reopened_at")),
        }
    )


def log_growth(lines: DataFrame, key: str = "boot_id", window: str = "1 hour") -> DataFrame:
    """Bytes and lines per boot and hour."""
    return lines.groupBy(key, F.window("observed_at", window).start.alias("hour")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text") + 1).cast("bigint").alias("bytes")
    )


def profile_posture(lines: DataFrame, devices: DataFrame, state_key: str = "posture") -> DataFrame:
    """Verified and degraded reporting lines per device; a device without a line is a row of zeros.

    ``lines`` carry ``device_id`` and the posture text; ``devices`` lists every device.
    """
    seen = lines.groupBy("device_id").agg(
        F.count(F.when(F.col(state_key) == "verified", 1)).alias("verified"),
        F.count(F.when(F.col(state_key) == "degraded", 1)).alias("degraded"),
    )
    out = devices.join(seen, "device_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("verified", "degraded")}
    return out.withColumns(zero).withColumn("ok", (F.col("verified") > 0) & (F.col("degraded") == 0))


def identity_continuity(links: DataFrame, proposals: DataFrame) -> DataFrame:
    """Same id for an address over all boots and no new proposal.

    ``links``: address, device_id; ``proposals``: address (one row per proposal).
    """
    # Distinct pairs first: the per-address count then runs over ids, not lines.
    ids = links.select("address", "device_id").distinct().groupBy("address").agg(F.count("device_id").alias("ids"))
    proposed = proposals.groupBy("address").agg(F.count(F.lit(1)).alias("proposed"))
    out = ids.join(proposed, "address", "full")
    return out.select(
        "address",
        F.coalesce("ids", F.lit(0)).cast("bigint").alias("ids"),
        F.coalesce("proposed", F.lit(0)).cast("bigint").alias("proposed"),
    ).withColumn("continuous", (F.col("ids") == 1) & (F.col("proposed") == 0))
