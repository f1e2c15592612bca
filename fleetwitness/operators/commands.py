"""Command confirmation: acknowledgements, authoritative reports, verdicts, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros_between
from fleetwitness.operators.ordered import Ordered, following, last_before, next_after, ordered, small_side
from fleetwitness.operators.sensors import exact_quantiles, first_after

CHANNEL = ("device_id", "cluster")
ATTRIBUTE = ("device_id", "attr_name")


def match_command_ack(cmds: DataFrame, acks: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """First acknowledgement after each command and before the next command of the channel."""
    a = cmds.select(
        *keys, "ts", F.lit(0).alias("_side"), F.col("cmd_id").alias("_id"), F.lit(None).cast("string").alias("status")
    )
    b = acks.select(*keys, "ts", F.lit(1).alias("_side"), F.col("ack_id").alias("_id"), "status")
    both = ordered(a.unionByName(b), keys, ["ts", "_side", "_id"])
    ack = F.when(F.col("_side") == 1, F.struct("ts", F.col("_id").alias("id"), "status"))
    next_cmd = F.when(F.col("_side") == 0, F.col("ts"))
    out = both.scan(_ack=next_after(ack), _next=next_after(next_cmd)).where(F.col("_side") == 0).frame()
    mine = F.col("_ack").isNotNull() & (F.col("_next").isNull() | (F.col("_ack.ts") < F.col("_next")))
    return out.select(
        *keys,
        F.col("_id").alias("cmd_id"),
        "ts",
        F.when(mine, F.col("_ack.id")).alias("ack_id"),
        F.when(mine, F.col("_ack.status")).alias("ack_status"),
        F.when(mine, micros_between(F.col("ts"), F.col("_ack.ts"))).alias("ack_us"),
    )


def within_tolerance(target: Column, value: Column, tolerance: Column, unit: Column) -> Column:
    """Distance in the unit of the profile: kelvin compares 1e6/mired, others compare raw."""
    kelvin = F.abs(F.lit(1e6) / target - F.lit(1e6) / value)
    raw = F.abs(target - value)
    distance = F.when(unit == "kelvin", F.when((target != 0) & (value != 0), kelvin)).otherwise(raw)
    return F.coalesce(distance <= F.coalesce(tolerance, F.lit(0.0)), F.lit(False))


def is_command() -> Column:
    return F.col("_side") == 0


def command_timeline(cmds: DataFrame, reports: DataFrame, keys: Sequence[str] = ATTRIBUTE) -> Ordered:
    """Commands and reports of each attribute on one time line.

    Every row sees the latest command before it (``_cmd``), the next command after
    it (``_next``) and the value last reported before it (``_known``). A newer
    command cuts the interval of the older one, so a report has one owner and no
    interval join is needed.
    """
    a = cmds.select(
        *keys,
        "ts",
        F.lit(0).alias("_side"),
        F.col("cmd_id").alias("_id"),
        F.col("target").cast("double").alias("value"),
        "capability",
    )
    b = reports.select(
        *keys,
        "ts",
        F.lit(1).alias("_side"),
        F.col("report_id").alias("_id"),
        F.col("value").cast("double"),
        F.lit(None).cast("string").alias("capability"),
    )
    both = ordered(a.unionByName(b), keys, ["ts", "_side", "_id"])
    command = F.struct("ts", F.col("_id").alias("id"), F.col("value").alias("target"), "capability")
    return both.scan(
        _cmd=last_before(F.when(is_command(), command)),
        _next=next_after(F.when(is_command(), F.col("ts"))),
        _known=last_before(F.when(~is_command(), F.struct("value"))),
    )


def owned_reports(timeline: Ordered) -> DataFrame:
    """Reports with the command that owns them."""
    return timeline.where(~is_command() & F.col("_cmd").isNotNull()).frame().select(
        F.col("_cmd.id").alias("cmd_id"),
        F.col("_cmd.target").alias("target"),
        F.col("_cmd.capability").alias("capability"),
        F.col("_id").alias("report_id"),
        "value",
        micros_between(F.col("_cmd.ts"), F.col("ts")).alias("after_us"),
    )


def report_tests(target: Column, value: Column) -> tuple[Column, Column]:
    """(exact, agrees) of a report under the mode of its profile row."""
    exact = value == target
    close = within_tolerance(target, value, F.col("tolerance"), F.col("unit"))
    return exact, F.when(F.col("mode") == "TOLERANCE", close).otherwise(exact)


def qualifying_reports(owned: DataFrame, profile: DataFrame, grace_ms: int = 0) -> DataFrame:
    """Owned reports inside the timeout of their command, with the tolerance test."""
    exact, agrees = report_tests(F.col("target"), F.col("value"))
    return (
        owned.join(small_side(profile), "capability")
        .where(F.col("after_us") <= (F.col("timeout_ms") + grace_ms) * 1000)
        .withColumns({"exact": exact, "agrees": agrees})
    )


def confirm_commands(
    cmds: DataFrame,
    reports: DataFrame,
    profile: DataFrame,
    acks: DataFrame | None = None,
    keys: Sequence[str] = ATTRIBUTE,
    ack_keys: Sequence[str] = CHANNEL,
    grace_ms: int = 0,
    quiet_s: float | None = None,
) -> DataFrame:
    """One verdict per command.

    Order: FAILED (refused by the device) · REFUSED (the profile has no row for the
    capability) · UNCONFIRMED (the capability cannot be confirmed) · CONFIRMED (a report agrees inside the timeout and before the next
    command) · SUPERSEDED (a newer command came first) · TIMED_OUT. An
    acknowledgement alone never confirms. ``no_change`` says that the commanded
    value was already the reported one. With ``quiet_s`` only settled values count: a
    report that another one follows within that time, before the next command, is a
    step on the way and confirms nothing.

    The time line is read once: a command row brings its own terms, a report row a
    candidate for its owner, and both meet in one aggregation by command.
    """
    own = F.struct(
        *keys, "ts", "capability", F.col("value").alias("target"), F.col("_next").alias("next_ts"),
        F.col("_known.value").alias("known_value"), "confirmability", "timeout_ms",
    )
    _, agrees = report_tests(F.col("_cmd.target"), F.col("value"))
    after = micros_between(F.col("_cmd.ts"), F.col("ts"))
    counts = ~is_command() & (after <= (F.col("timeout_ms") + grace_ms) * 1000) & agrees
    timeline = command_timeline(cmds, reports, keys)
    if quiet_s is not None:
        timeline = timeline.scan(_later=next_after(F.when(~is_command(), F.col("ts"))))
        pause = micros_between(F.col("ts"), F.col("_later")) > int(quiet_s * 1_000_000)
        counts = counts & (F.col("_later").isNull() | pause | F.coalesce(F.col("_next") <= F.col("_later"), F.lit(False)))
    rows = timeline.where(is_command() | F.col("_cmd").isNotNull()).frame()
    rows = rows.withColumns(
        {
            "cmd_id": F.when(is_command(), F.col("_id")).otherwise(F.col("_cmd.id")),
            "capability": F.when(is_command(), F.col("capability")).otherwise(F.col("_cmd.capability")),
        }
    ).join(small_side(profile), "capability", "left")
    out = rows.where(is_command() | counts).groupBy("cmd_id").agg(
        F.max(F.when(is_command(), own)).alias("own"),
        F.min_by(
            F.struct(F.col("_id").alias("report_id"), after.alias("after_us"), "value"),
            F.when(~is_command(), F.struct(after, "_id")),
        ).alias("hit"),
    ).select("cmd_id", "own.*", "hit")
    if acks is not None:
        answered = match_command_ack(cmds, acks, ack_keys).select("cmd_id", "ack_status", "ack_us")
        out = out.join(answered, "cmd_id", "left")
    else:
        out = out.withColumns({"ack_status": F.lit(None).cast("string"), "ack_us": F.lit(None).cast("bigint")})
    superseded = micros_between(F.col("ts"), F.col("next_ts")) <= (F.col("timeout_ms") + grace_ms) * 1000
    verdict = (
        F.when(F.col("ack_status") != "SUCCESS", "FAILED")
        .when(F.col("confirmability").isNull(), "REFUSED")
        .when(F.col("confirmability") == "UNCONFIRMABLE", "UNCONFIRMED")
        .when(F.col("hit").isNotNull(), "CONFIRMED")
        .when(superseded, "SUPERSEDED")
        .otherwise("TIMED_OUT")
    )
    return out.withColumns(
        {
            "verdict": verdict,
            "latency_us": F.when(verdict == "CONFIRMED", F.col("hit.after_us")),
            "confirmed_by": F.when(verdict == "CONFIRMED", F.col("hit.report_id")),
            "reported_value": F.when(verdict == "CONFIRMED", F.col("hit.value")),
            "no_change": F.coalesce(F.col("known_value") == F.col("target"), F.lit(False)),
            "rendered": F.when(verdict == "TIMED_OUT", "UNCONFIRMED").otherwise(verdict),
        }
    ).drop("hit")


def no_change_commands(cmds: DataFrame, reports: DataFrame, keys: Sequence[str] = ATTRIBUTE) -> DataFrame:
    """Commands whose target equals the value last reported before them."""
    rows = command_timeline(cmds, reports, keys).where(is_command() & (F.col("_known.value") == F.col("value")))
    return rows.frame().select(
        *keys, F.col("_id").alias("cmd_id"), "ts", "capability", F.col("value").alias("target")
    )


def superseded(cmds: DataFrame, keys: Sequence[str] = ATTRIBUTE) -> DataFrame:
    """Next command on the same attribute, and how long after."""
    seq = ordered(cmds, keys, ["ts", "cmd_id"]).scan(_next=following(F.struct("ts", "cmd_id")))
    return seq.where(F.col("_next").isNotNull()).frame().select(
        *cmds.columns,
        F.col("_next.cmd_id").alias("next_cmd_id"),
        micros_between(F.col("ts"), F.col("_next.ts")).alias("next_after_us"),
    )


def value_drift(cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str] = ATTRIBUTE) -> DataFrame:
    """Reports inside the tolerance that an exact comparison would reject."""
    tested = qualifying_reports(owned_reports(command_timeline(cmds, reports, keys)), profile)
    return tested.where((F.col("mode") == "TOLERANCE") & F.col("agrees") & ~F.col("exact")).select(
        "cmd_id", "report_id", "target", "value", "after_us"
    )


def false_confirms(verdicts: DataFrame, cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str] = ATTRIBUTE) -> DataFrame:
    """CONFIRMED verdicts without a supporting report."""
    owned = owned_reports(command_timeline(cmds, reports, keys))
    support = qualifying_reports(owned, profile).where("agrees").select("cmd_id")
    return verdicts.where(F.col("verdict") == "CONFIRMED").join(support, "cmd_id", "left_anti")


def latency_envelope(confirmed: DataFrame, keys: Sequence[str], value: str = "latency_us") -> DataFrame:
    """n, min, max, median and p95 per key."""
    return exact_quantiles(confirmed, keys, value, {"median": 0.5, "p95": 0.95})


def timeout_headroom(envelope: DataFrame, profile: DataFrame, value: str = "latency_us") -> DataFrame:
    """Measured maximum against the timeout of the capability."""
    limit = F.col("timeout_ms") * 1000
    return envelope.join(profile.select("capability", "timeout_ms"), "capability", "left").withColumns(
        {"headroom": limit / F.col(f"max_{value}"), "inside": F.col(f"max_{value}") < limit}
    )


def post_window_state(fails: DataFrame, states: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """First state read at or after the first failure of each run.

    ``fails``: run_id, device_id, ts, fail_id. A matching value means the report
    came late; another value means there was no edge.
    """
    first = fails.groupBy("run_id").agg(
        F.min_by(F.struct(*[c for c in fails.columns if c != "run_id"]), F.struct("ts", "fail_id")).alias("f")
    )
    first = first.select("run_id", "f.*")
    reads = first_after(first, states, keys, "fail_id", "state_id", payload="value")
    found = reads.select("fail_id", "hit_id", "wait_us", F.col("hit_value").alias("state_value"))
    return first.join(found, "fail_id", "left")


def phase_durations(lifecycle: DataFrame, phases: Sequence[str]) -> DataFrame:
    """First time of each phase per command and the time between successive phases.

    ``lifecycle``: command_id, phase, at.
    """
    wide = lifecycle.groupBy("command_id").agg(
        *[F.min(F.when(F.col("phase") == p, F.col("at"))).alias(p) for p in phases]
    )
    steps = {
        f"{a}_to_{b}_us": micros_between(F.col(a), F.col(b)) for a, b in zip(phases, phases[1:], strict=False)
    }
    return wide.withColumns(steps)
