"""Suite transcripts, coverage, floor, digest, latency of the night, preflight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import (
    STATUS_TAGS,
    capability_group,
    iso_instant,
    json_at,
    micros_between,
    seconds_text,
    status_tag,
)
from fleetwitness.operators.ordered import ordered, running_max, running_sum, small_side

# Forms and words of the nightly report.
VERDICT_LINE = r"^\[(PASS|FAIL|SKIP|REFUSED|DEFER)\]\s+(\S+)(?:\s+—\s+(.*))?$"
BUNDLE_LINE = r"^\s+\[--\]\s+bundle:\s+(.+?)\s*$"
NO_VERDICTS = "no verdicts (suite output unparseable — treat as red)"
RESTORE_WORDS = {
    "RESTORED": "RESTORED ✓",
    "RESTORE-FAILED": "RESTORE-FAILED ⛔",
    "NEVER-SWAPPED-PRESENT": "PRESENT ✓ (never swapped)",
    "NEVER-SWAPPED-UNVERIFIED": "PRESENT-UNVERIFIED (never swapped)",
}


def lookup(words: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), key)


def read_transcript(transcript: DataFrame, key: str = "night") -> DataFrame:
    """Verdict rows of suite transcripts (``key, idx, line``), with their bundle.

    A bundle line belongs to the verdict line above it; a later one wins. Partial
    transcripts give the verdicts they have.
    """
    tag = F.nullif(F.regexp_extract("line", VERDICT_LINE, 1), F.lit(""))
    bundle = F.nullif(F.regexp_extract("line", BUNDLE_LINE, 1), F.lit(""))
    marked = transcript.withColumns({"_tag": tag, "_bundle": bundle}).where("_tag IS NOT NULL OR _bundle IS NOT NULL")
    return attach_bundle(marked, key, F.col("_tag").isNotNull()).select(
        key,
        F.col("first.idx").alias("idx"),
        F.regexp_extract("first.line", VERDICT_LINE, 2).alias("scenario"),
        lookup({tag: status for status, tag in STATUS_TAGS.items()}, F.col("first._tag")).alias("status"),
        F.regexp_extract("first.line", VERDICT_LINE, 3).alias("reason"),
        "bundle",
    )


def attach_bundle(marked: DataFrame, key: str, is_verdict: Column) -> DataFrame:
    """Group each verdict line with the bundle lines below it; the last bundle is kept."""
    seq = ordered(marked, [key], ["idx"]).scan(leg=running_sum(is_verdict.cast("bigint")))
    rows = seq.where(F.col("leg") > 0).frame()
    return rows.groupBy(key, "leg").agg(
        F.min_by(F.struct("idx", "line", "_tag"), F.when(is_verdict, F.col("idx"))).alias("first"),
        F.max_by("_bundle", F.when(F.col("_bundle").isNotNull(), F.col("idx"))).alias("bundle"),
    )


def joined_text(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), sep)


def skip_groups(verdicts: DataFrame, key: str, form: str) -> DataFrame:
    """One text per key listing the skipped legs by capability group, in name order."""
    groups = (
        verdicts.where(F.col("status") == "SKIPPED")
        .groupBy(key, capability_group(F.col("reason")).alias("cap"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    text = F.format_string(form, "n", "cap")
    # One entry per capability group, not per verdict.
    return groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cap", text.alias("t")))).alias("_g")).select(
        key, F.array_join(F.col("_g.t"), " · ").alias("skips")
    )


def coverage(verdicts: DataFrame, key: str = "night") -> DataFrame:
    """Ran, total, deferred, refused and the coverage line per key."""
    status = F.col("status")
    counts = verdicts.groupBy(key).agg(
        F.count(F.when(status.isin("PASS", "FAIL"), 1)).alias("ran"),
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(status == "DEFERRED", 1)).alias("deferred"),
        F.count(F.when(status == "REFUSED", 1)).alias("refused"),
    )
    rows = counts.join(skip_groups(verdicts, key, "%d SKIPPED: [%s]"), key, "left")
    tail = joined_text(
        F.array(
            F.col("skips"),
            F.when(F.col("deferred") > 0, F.format_string("%d OPERATOR-deferred", "deferred")),
            F.when(F.col("refused") > 0, F.format_string("%d REFUSED", "refused")),
        ),
        " · ",
    )
    line = F.concat(
        F.format_string("ran %d/%d", "ran", "total"), F.when(tail != "", F.concat(F.lit(" — "), tail)).otherwise("")
    )
    return rows.select(key, "ran", "total", "deferred", "refused", line.alias("line"))


def floor_text(verdicts: DataFrame, calendar: DataFrame, key: str = "night") -> DataFrame:
    """Passes over total, every failure with its bundle, refusals by name, skips by group.

    A night of the calendar without verdicts reads as red. The text names every
    failing and refused leg, so it grows with these, never with the passing ones.
    """
    status = F.col("status")
    counts = verdicts.groupBy(key).agg(
        F.count(F.when(status == "PASS", 1)).alias("passes"),
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(status.isin("FAIL", "REFUSED", "DEFERRED"), 1)).alias("named"),
    )
    fail = F.concat(
        F.lit("FAIL "), F.col("scenario"), F.lit(" · bundle "), F.coalesce(F.col("bundle"), F.lit("ABSENT"))
    )
    named = (
        verdicts.where(status.isin("FAIL", "REFUSED", "DEFERRED"))
        .select(
            key,
            F.when(status == "FAIL", 0).otherwise(1).alias("g"),
            "idx",
            F.when(status == "FAIL", fail)
            .otherwise(F.concat(status_tag(status), F.lit(" "), F.col("scenario")))
            .alias("t"),
        )
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("g", "idx", "t"))).alias("_n"))
        .select(key, F.array_join(F.col("_n.t"), " · ").alias("names"))
    )
    rows = (
        calendar.select(key)
        .join(counts, key, "left")
        .join(named, key, "left")
        .join(skip_groups(verdicts, key, "%d SKIP(%s)"), key, "left")
    )
    head = F.concat(
        F.format_string("%d/%d", "passes", "total"), F.when(F.col("named") == 0, " PASS").otherwise("")
    )
    text = joined_text(F.array(head, F.col("names"), F.col("skips")), " · ")
    return rows.select(key, F.when(F.col("total").isNull(), NO_VERDICTS).otherwise(text).alias("floor"))


def digest(night: Column, evidence_class: Column, floor: Column, restore: Column, latency: Column) -> Column:
    """The one line of a night."""
    words = F.coalesce(lookup(RESTORE_WORDS, restore), restore)
    return F.concat(
        night, F.lit(" "), evidence_class, F.lit(" AUTO floor: "), floor, F.lit(" · bench-hero "), words,
        F.lit(" · ON-latency "), latency,
    )


def phase_latency_us(captures: DataFrame, keys: Sequence[str], start: str = "DISPATCHED", end: str = "CONFIRMED") -> DataFrame:
    """Time between two phases from the last capture that parses and carries both.

    ``captures``: keys, idx, body. A capture cut in the middle does not parse and
    is passed over.
    """
    doc = F.try_parse_json("body")
    at = {p: iso_instant(json_at(F.col("doc"), f"data.lifecycle.{p}.at")) for p in (start, end)}
    both = captures.withColumn("doc", doc).withColumns({"_a": at[start], "_b": at[end]})
    usable = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy(*keys).agg(
        F.max_by(micros_between(F.col("_a"), F.col("_b")), F.when(usable, F.col("idx"))).alias("latency_us"),
        F.count(F.lit(1)).alias("captures"),
    )


def night_latency(verdicts: DataFrame, captures: DataFrame, calendar: DataFrame, leg: str, key: str = "night") -> DataFrame:
    """Latency of the leg of record per night, or ``n/a(reason)``.

    ``captures``: bundle, idx, body, readable (false when the file is not a capture list).
    """
    first = (
        verdicts.where(F.col("scenario") == leg)
        .groupBy(key)
        .agg(F.min_by(F.struct("status", "bundle"), "idx").alias("v"))
        .select(key, "v.*")
    )
    measured = phase_latency_us(captures.where("readable"), ["bundle"])
    known = captures.groupBy("bundle").agg(F.bool_and("readable").alias("readable"))
    rows = (
        calendar.select(key).join(first, key, "left").join(known, "bundle", "left").join(measured, "bundle", "left")
    )
    text = (
        F.when(F.col("status").isNull(), "n/a(no-verdict)")
        .when(F.col("status") != "PASS", F.concat(F.lit("n/a("), status_tag(F.col("status")), F.lit(")")))
        .when(F.col("bundle").isNull() | F.col("readable").isNull(), "n/a(no-bundle)")
        .when(~F.col("readable"), "n/a(captures-unreadable)")
        .when(F.col("latency_us").isNull(), "n/a(no-lifecycle)")
        .otherwise(seconds_text(F.col("latency_us") / F.lit(1_000_000)))
    )
    return rows.select(key, F.when(text.startswith("n/a"), None).otherwise(F.col("latency_us")).alias("latency_us"), text.alias("latency"))


def latency_series(nights: DataFrame, keys: Sequence[str], window_us: int, order: str = "night") -> DataFrame:
    """Running count, sum and maximum of the latency per device, and the margin to the window."""
    seq = ordered(nights, keys, [order]).scan(
        n=running_sum(F.col("latency_us").isNotNull().cast("bigint")),
        total_us=running_sum("latency_us"),
        max_us=running_max("latency_us"),
    )
    return seq.frame().withColumns(
        {"mean_us": F.col("total_us") / F.col("n"), "margin_us": F.lit(window_us) - F.col("latency_us")}
    )


def suite_exit(verdicts: DataFrame, keys: Sequence[str] = ("night",)) -> DataFrame:
    """1 when any leg failed, else 2 when any was refused, else 0."""
    status = F.col("status")
    return verdicts.groupBy(*keys).agg(
        F.when(F.max((status == "FAIL").cast("int")) == 1, 1)
        .when(F.max((status == "REFUSED").cast("int")) == 1, 2)
        .otherwise(0)
        .alias("exit_code")
    )


def night_exit(nights: DataFrame) -> DataFrame:
    """Exit code and path of a night.

    ``nights``: restore, suite_exit (NULL when the suite never reported), signal
    (``timeout`` → 124, ``killed`` → 137 arrive as the suite's own exit code).
    """
    failed = F.col("restore") == "RESTORE-FAILED"
    code = F.when(failed, 3).otherwise(F.coalesce(F.col("suite_exit"), F.lit(1)))
    path = (
        F.when(failed, "restore-failed")
        .when(F.col("signal").isNotNull(), F.col("signal"))
        .when(F.col("suite_exit").isNull(), "pre-suite-crash")
        .otherwise("normal")
    )
    return nights.withColumns({"exit_code": code.cast("int"), "exit_path": path})


def presence_pair(calendar: DataFrame, reads: DataFrame, token: str, key: str = "night") -> DataFrame:
    """Quiesce and restore words of a night from its paired reads.

    ``reads``: key, phase (``quiesce`` | ``restore`` | ``end``), status, body. The token
    must be absent while quiesced and present after; an unreadable pair is an
    instrument failure, never a quiet success.
    """
    present = F.coalesce(F.contains("body", F.lit(token)), F.lit(False))
    ok = (F.col("status") == 200) & (F.coalesce(F.length("body"), F.lit(0)) > 0)
    state = F.when(ok & ~present, "absent").when((F.col("status") == 200) & present, "present").otherwise("unread")
    latest = F.struct(F.col("read_seq"))
    per = reads.withColumn("_s", state).groupBy(key).agg(
        *[F.max_by("_s", F.when(F.col("phase") == p, latest)).alias(p) for p in ("quiesce", "restore", "end")]
    )
    evidence = (
        F.when(F.col("quiesce") == "absent", "quiesced")
        .when(F.col("quiesce") == "present", "UNQUIESCED(QUIESCE-ASSERT-FAILED)")
        .when(F.col("quiesce") == "unread", "QUIESCE-UNVERIFIED(read-failed)")
        .otherwise("QUIESCE-UNVERIFIED(early-exit)")
    )
    restore = (
        F.when(F.col("restore") == "present", "RESTORED")
        .when(F.col("restore").isNotNull() | F.col("quiesce").isNotNull(), "RESTORE-FAILED")
        .when(F.col("end") == "present", "NEVER-SWAPPED-PRESENT")
        .otherwise("NEVER-SWAPPED-UNVERIFIED")
    )
    return calendar.select(key).join(per, key, "left").select(
        key, evidence.alias("evidence_class"), restore.alias("restore")
    )


def suite_preflight(suite: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Ordered legs with RUN or REFUSED: unknown name, OPERATOR tier, or load failure.

    ``suite``: suite, pos, scenario; ``scenarios``: scenario, tier, load_error.
    """
    rows = suite.join(small_side(scenarios.withColumn("_known", F.lit(True))), "scenario", "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown scenario")
        .when(F.col("load_error").isNotNull(), F.col("load_error"))
        .when(F.col("tier") == "OPERATOR", "OPERATOR tier in the auto suite")
    )
    return rows.withColumns(
        {"reason": reason, "plan": F.when(reason.isNull(), "RUN").otherwise("REFUSED")}
    ).drop("_known")


def capability_gate(scenarios: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Unmet requirements per scenario, with the reason; only a literal true is met.

    ``scenarios``: scenario, requires ARRAY; ``capabilities``: capability, available, reason.
    """
    need = scenarios.select("scenario", F.posexplode("requires").alias("pos", "capability"))
    rows = need.join(small_side(capabilities), "capability", "left")
    reason = F.coalesce(F.col("reason"), F.concat(F.lit("capability "), F.col("capability"), F.lit(" not declared available")))
    unmet = rows.where(~F.coalesce(F.col("available"), F.lit(False)))
    return unmet.select("scenario", "pos", "capability", reason.alias("reason"))


def missing_nights(calendar: DataFrame, digests: DataFrame, keys: Sequence[str] = ("night",)) -> DataFrame:
    """Nights without a digest line: red."""
    return calendar.join(digests.select(*keys).distinct(), list(keys), "left_anti")


def calendar_of(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Every day from the first to the last seen day of each key."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(day))


def failure_evidence(verdicts: DataFrame, reads: DataFrame, key: str = "night") -> DataFrame:
    """The night's quiesce evidence beside every FAIL leg that has a bundle, and only those.

    Each leg points at the night's one evidence record (how many reads, the last of
    them); the reads themselves are not copied per leg.
    """
    evidence = reads.groupBy(key).agg(F.count(F.lit(1)).alias("reads"), F.max("read_seq").alias("last_read"))
    failed = verdicts.where((F.col("status") == "FAIL") & F.col("bundle").isNotNull())
    return failed.join(evidence, key)


def verdict_envelope(events: DataFrame, keys: Sequence[str], kinds: Sequence[str], type_col: str = "event_type") -> DataFrame:
    """Events per type, as columns."""
    kind = F.col(type_col)
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(kind == k, 1)).alias(k) for k in kinds]
    )

