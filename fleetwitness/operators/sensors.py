"""Sensor streams: twins, edges, intervals, gaps, cadence and trigger latency.

Input rows: ``device_id, cluster, attr_name, ts, tsn, value``.
Each function accepts a DataFrame, or an ``Ordered`` to reuse a prepared order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros_between
from fleetwitness.operators.ordered import (
    Ordered,
    following,
    last_before,
    next_after,
    ordered,
    previous,
    running_sum,
)
from fleetwitness.session import cut_lineage

STREAM = ("device_id", "cluster", "attr_name")
TIME = ("ts", "tsn")


def stream_order(
    events: DataFrame | Ordered, keys: Sequence[str] = STREAM, order: Sequence[str] = TIME
) -> Ordered:
    return events if isinstance(events, Ordered) else ordered(events, keys, order)


def mark_twins(events: DataFrame | Ordered, max_gap_s: float = 1.0) -> Ordered:
    """Flag a report that repeats the one before: same value, next TSN, within the gap.

    TSN counts modulo 256. There is no lower limit on the gap.
    """
    before = previous(F.struct("value", "tsn", "ts"))
    seq = stream_order(events).scan(_before=before)
    twin = (
        F.col("_before.value").eqNullSafe(F.col("value"))
        & (F.pmod(F.col("tsn") - F.col("_before.tsn"), F.lit(256)) == 1)
        & (micros_between(F.col("_before.ts"), F.col("ts")) <= int(max_gap_s * 1_000_000))
    )
    return seq.with_columns({"is_twin": F.coalesce(twin & F.col("_before").isNotNull(), F.lit(False))}).drop(
        "_before"
    )


def drop_twins(events: DataFrame | Ordered, max_gap_s: float = 1.0) -> Ordered:
    return mark_twins(events, max_gap_s).where(~F.col("is_twin")).drop("is_twin")


def edges(events: DataFrame | Ordered) -> Ordered:
    """Keep rows whose value differs from the row before; the first row is an edge."""
    seq = stream_order(events).scan(_before=previous(F.struct("value")))
    changed = F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value"))
    return seq.where(changed).drop("_before")


def occupied_intervals(edge_rows: DataFrame | Ordered, detect: float = 1) -> DataFrame:
    """One row per detect edge up to the next clear edge; an open end stays NULL."""
    seq = stream_order(edge_rows).scan(end_ts=following("ts"))
    out = seq.where(F.col("value") == detect).frame()
    return out.withColumn("duration_us", micros_between(F.col("ts"), F.col("end_ts")))


def silent_retriggers(intervals: DataFrame, base_s: float = 59.0, clean: float = 1.02, silent: float = 1.8) -> DataFrame:
    """Class of each closed interval by its length over the base clear delay."""
    ratio = F.col("duration_us") / F.lit(int(base_s * 1_000_000))
    kind = F.when(ratio >= silent, "silent").when(ratio > clean, "extended").otherwise("clean")
    return intervals.where(F.col("duration_us").isNotNull()).withColumns(
        {"kind": kind, "extensions": F.greatest(F.floor(ratio + F.lit(0.5)) - 1, F.lit(0)).cast("bigint")}
    )


def sequence_gaps(events: DataFrame | Ordered) -> DataFrame:
    """TSNs missing before a row, counted with the 8-bit wrap."""
    seq = stream_order(events).scan(prev_tsn=previous("tsn"))
    step = F.pmod(F.col("tsn") - F.col("prev_tsn"), F.lit(256))
    out = seq.with_columns({"missing": (step - 1).cast("bigint")}).where(step > 1)
    return out.frame()


def twin_rate(events: DataFrame | Ordered, max_gap_s: float = 1.0) -> DataFrame:
    """Share of a device's reports that are twins."""
    flagged = mark_twins(events, max_gap_s).frame()
    return flagged.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_twin").cast("bigint")).alias("twins"),
        F.avg(F.col("is_twin").cast("int")).alias("twin_share"),
    )


def nearest_rank_bounds(n: Column, q: float) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank (1-based) and weight of the interpolated quantile."""
    at = (n - 1) * F.lit(q)
    low = F.floor(at)
    return low + 1, F.ceil(at) + 1, at - low


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Count, min, max and interpolated quantiles of an integer value per key.

    Equal values are counted map-side first; the running count then runs over
    distinct values only, and a hot key is scanned in segments. The counts are
    checkpointed, so the input is computed once for their three uses.
    """
    counted = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = ordered(counted, keys, [value]).scan(_upto=running_sum("_n")).frame()
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}")
    )
    joined = ranked.join(totals, list(keys))
    picks = []
    for name, q in quantiles.items():
        low, high, weight = nearest_rank_bounds(F.col("n"), q)
        for side, rank in (("lo", low), ("hi", high)):
            hit = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(weight).alias(f"_{name}_w"))
    stats = ("n", f"min_{value}", f"max_{value}")
    out = joined.groupBy(*keys).agg(*[F.max(s).alias(s) for s in stats], *picks)
    values = [
        (
            F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
        ).alias(name)
        for name in quantiles
    ]
    return out.select(*keys, *stats, *values)


def report_cadence(events: DataFrame | Ordered) -> DataFrame:
    """Smallest and median interval between reports of a stream."""
    seq = stream_order(events).scan(_before=previous("ts"))
    gaps = seq.with_columns({"gap_us": micros_between(F.col("_before"), F.col("ts"))}).frame()
    return exact_quantiles(gaps, stream_keys(events), "gap_us", {"median_gap_us": 0.5})


def stream_keys(events: DataFrame | Ordered) -> list[str]:
    return events.keys if isinstance(events, Ordered) else list(STREAM)


def _timeline(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, payload: str | None = None
) -> DataFrame:
    """Both inputs on one time line; at equal times the left row comes first."""
    carried = F.lit(None) if payload is None else F.col(payload)
    a = left.select(*keys, F.col("ts"), F.lit(0).alias("_side"), F.col(left_id).cast("bigint").alias("_id"))
    b = right.select(
        *keys, F.col("ts"), F.lit(1).alias("_side"), F.col(right_id).cast("bigint").alias("_id"), carried.alias("_payload")
    )
    return a.unionByName(b, allowMissingColumns=True)


def first_after(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    limit_s: float | None = None,
    payload: str | None = None,
) -> DataFrame:
    """First right row at or after each left row of the same key (forward as-of join).

    One union, one ordered scan: no pairs are formed. ``payload`` names a column of
    the right row to bring along as ``hit_value``.
    """
    both = ordered(_timeline(left, right, keys, left_id, right_id, payload), keys, ["ts", "_side", "_id"])
    found = F.struct(F.col("ts").alias("ts"), F.col("_id").alias("id"), F.col("_payload").alias("value"))
    out = both.scan(_hit=next_after(F.when(F.col("_side") == 1, found))).where(F.col("_side") == 0).frame()
    wait = micros_between(F.col("ts"), F.col("_hit.ts"))
    inside = F.lit(True) if limit_s is None else wait <= int(limit_s * 1_000_000)
    columns = {"hit_id": F.col("_hit.id"), "hit_ts": F.col("_hit.ts"), "wait_us": wait}
    if payload is not None:
        columns["hit_value"] = F.col("_hit.value")
    return out.select(
        *keys, F.col("_id").alias(left_id), "ts", *[F.when(inside, c).alias(n) for n, c in columns.items()]
    )


def trigger_latency(
    stimuli: DataFrame, edge_rows: DataFrame, limit_s: float = 5.0, stimulus_id: str = "stimulus_id", edge_id: str = "tsn"
) -> DataFrame:
    """First detect edge at or after each timed stimulus of the device, within the limit."""
    timed = stimuli.where(F.col("timed") & F.col("ts").isNotNull())
    return first_after(timed, edge_rows, ["device_id"], stimulus_id, edge_id, limit_s)


def double_runs(edge_rows: DataFrame, runs: DataFrame, edge_id: str, run_id: str) -> DataFrame:
    """Runs started per detect edge (edge at or before the run); more than one is a finding."""
    both = ordered(
        _timeline(edge_rows, runs, ["device_id"], edge_id, run_id), ["device_id"], ["ts", "_side", "_id"]
    )
    edge = F.when(F.col("_side") == 0, F.col("_id"))
    owned = both.scan(_edge=last_before(edge)).where(F.col("_side") == 1).frame()
    started = (
        owned.where(F.col("_edge").isNotNull())
        .groupBy("device_id", "_edge")
        .agg(F.count(F.lit(1)).alias("runs"))
    )
    edge_keys = edge_rows.select("device_id", F.col(edge_id).cast("bigint").alias("_edge"))
    return edge_keys.join(started, ["device_id", "_edge"], "left").select(
        "device_id",
        F.col("_edge").alias(edge_id),
        F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"),
        (F.coalesce("runs", F.lit(0)) > 1).alias("double_run"),
    )


def bursts(reports: DataFrame | Ordered, quiet_s: float) -> Ordered:
    """Number the bursts of each stream; a pause longer than ``quiet_s`` starts a new one."""
    seq = stream_order(reports).scan(_before=previous("ts"))
    starts = F.col("_before").isNull() | (
        micros_between(F.col("_before"), F.col("ts")) > int(quiet_s * 1_000_000)
    )
    return seq.with_columns({"_starts": starts.cast("bigint")}).scan(burst=running_sum("_starts")).drop(
        "_before", "_starts"
    )


def settled_values(reports: DataFrame | Ordered, quiet_s: float) -> DataFrame:
    """Last report of every burst: value, time, first time and size."""
    seq = bursts(reports, quiet_s)
    at = F.struct(*seq.order)
    return seq.frame().groupBy(*seq.keys, "burst").agg(
        F.max_by("value", at).alias("settled"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("settled_ts"),
        F.count(F.lit(1)).alias("n"),
    )
