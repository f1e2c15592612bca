"""Latency against a device's own past: mergeable quantile sketches, or exact quantiles, and a change-point test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import micros
from fleetwitness.operators.ordered import ordered, running_sum
from fleetwitness.session import cut_lineage

WEEK_US = 7 * 86_400_000_000
#: Accuracy of a sketch: with 200, ranks are off by 1.7 % at most in 99 of 100 cases; up to 200 values it is exact.
SKETCH_K = 200
#: Quantiles at which a week is compared, and those that stand for its past. None falls between two values.
GRID, PAST_GRID = 20, 200
# Factors of the two-sample test of Kolmogorov and Smirnov by its level.
LEVELS = {0.10: 1.224, 0.05: 1.358, 0.01: 1.628, 0.001: 1.949}


SHIFT = 0.37


def grid(n: int) -> list[float]:
    return [(i - SHIFT) / n for i in range(1, n + 1)]


def weekly_sketches(latencies: DataFrame, key: str = "device_id", value: str = "latency_us", k: int = SKETCH_K) -> DataFrame:
    """One sketch per key and week, combined map-side; sketches of parts merge like those of the whole."""
    week = F.floor(micros(F.col("ts")) / WEEK_US).alias("week")
    rows = latencies.where(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(key, week, F.col(value).cast("bigint").alias("_v"))
    return rows.groupBy(key, "week").agg(F.kll_sketch_agg_bigint("_v", k).alias("sketch"))


def quantile(sketch: str, q: float | Column) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, q if isinstance(q, Column) else F.lit(q))


def _rank(n: Column, q: float) -> Column:
    """The place (from 1) of the discrete quantile ``q`` among ``n`` values."""
    return F.greatest(F.lit(1).cast("bigint"), n - F.floor(n - F.lit(q) * n))


def exact_weeks(latencies: DataFrame, key: str, value: str, weeks: int) -> tuple[DataFrame, DataFrame]:
    """Every week of a key (``n``, ``p50``, ``p95``, ``own``) and its past (``base_…``, ``_base``), exactly.

    Equal values are counted map-side; the running count runs over distinct values and a hot group is
    scanned in segments, so no task holds a key's history. Only the rows that hold a quantile go on.
    """
    week = F.floor(micros(F.col("ts")) / WEEK_US).alias("week")
    rows = latencies.where(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(key, week, F.col(value).cast("bigint").alias("_v"))
    now = cut_lineage(rows.groupBy(key, "week", "_v").agg(F.count(F.lit(1)).alias("_m")))
    ahead = now.select(key, F.explode(F.sequence(F.col("week") + 1, F.col("week") + weeks)).alias("week"), "_v", "_m")
    past = ahead.join(now.select(key, "week").distinct(), [key, "week"], "left_semi").groupBy(key, "week", "_v").agg(F.sum("_m").alias("_m"))
    return _quantiles(now, key, GRID, ("n", "p50", "p95", "own")), _quantiles(cut_lineage(past), key, PAST_GRID, ("base_n", "base_p50", "base_p95", "_base"))


def _quantiles(counted: DataFrame, key: str, size: int, names: tuple[str, str, str, str]) -> DataFrame:
    """The size of every group and its values at the median, the 95th percentile and the grid."""
    totals = counted.groupBy(key, "week").agg(F.sum("_m").alias("_n"))
    ranked = ordered(counted, [key, "week"], ["_v"]).scan(_upto=running_sum("_m")).frame().join(totals, [key, "week"])
    held = lambda rank: (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_m"))
    middle, high = (held(_rank(F.col("_n"), q)) for q in (0.5, 0.95))
    # Quantiles of the grid up to a place, with room for rounding on both sides; their exact places are compared below.
    upto = lambda place, room: F.floor(place * size / F.col("_n") + SHIFT + room)
    near = upto(F.col("_upto"), 1e-3) > upto(F.col("_upto") - F.col("_m"), -1e-3)
    places = F.array(*[_rank(F.col("_n"), q) for q in grid(size)])
    some = ranked.where(middle | high | near).withColumn("_held", F.size(F.filter(places, held)))
    own = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("_held") > 0, F.struct("_v", "_held")))), lambda s: F.array_repeat(s["_v"], s["_held"])))
    of = lambda test: F.max(F.when(test, F.col("_v")))
    n, p50, p95, values = names
    return some.groupBy(key, "week").agg(F.max("_n").alias(n), of(middle).alias(p50), of(high).alias(p95), own.alias(values))


def latency_drift(
    latencies: DataFrame, key: str = "device_id", value: str = "latency_us", weeks: int = 4, level: float = 0.01, least: int = 8, k: int | None = SKETCH_K
) -> DataFrame:
    """P2: every week of a key against the ``weeks`` weeks before it; a flag, never an action.

    ``latencies``: key, ts, value. The largest distance between the two distributions, taken at the
    week's own quantiles (twenty, against two hundred of its past), is compared with the two-sample bound at ``level``. ``drift`` is
    ``slower`` or ``faster`` (by the median) where it is exceeded, else ``steady``; ``too_few`` with
    fewer than ``least`` values on either side. A week's sketch goes to the weeks it is a baseline
    of and is merged there, so no task holds a key's history. Without ``k`` the quantiles are exact
    at any size, from counts of values instead of sketches.
    """
    if k is None:
        now, past = exact_weeks(latencies, key, value, weeks)
        rows = now.join(past, [key, "week"], "left").withColumn("base_n", F.coalesce("base_n", F.lit(0).cast("bigint")))
        return _judged(rows, level, least).drop("own", "_base")
    now = weekly_sketches(latencies, key, value, k)
    ahead = now.select(key, F.explode(F.sequence(F.col("week") + 1, F.col("week") + weeks)).alias("week"), "sketch")
    past = ahead.groupBy(key, "week").agg(F.kll_merge_agg_bigint("sketch", k).alias("past"))
    both = now.join(past, [key, "week"], "left").withColumns(
        {"n": F.kll_sketch_get_n_bigint("sketch"), "base_n": F.coalesce(F.kll_sketch_get_n_bigint("past"), F.lit(0).cast("bigint"))}
    )
    own, base = (quantile(c, F.array(*[F.lit(q) for q in grid(n)])) for c, n in (("sketch", GRID), ("past", PAST_GRID)))
    rows = both.withColumns(
        {
            "p50": quantile("sketch", 0.5), "p95": quantile("sketch", 0.95), "own": own, "_base": F.when(F.col("base_n") > 0, base),
            "base_p50": F.when(F.col("base_n") > 0, quantile("past", 0.5)), "base_p95": F.when(F.col("base_n") > 0, quantile("past", 0.95)),
        }
    )
    return _judged(rows, level, least).drop("sketch", "past", "own", "_base")


def _judged(rows: DataFrame, level: float, least: int) -> DataFrame:
    """Weeks with their quantiles and those of their past, compared."""
    judged = (F.col("n") >= least) & (F.col("base_n") >= least)
    gaps = F.transform(
        "own", lambda v, i: F.abs(F.size(F.filter("_base", lambda b: b <= v)) / PAST_GRID - (i + 1 - SHIFT) / GRID)
    )
    bound = F.lit(LEVELS[level]) * F.sqrt((F.col("n") + F.col("base_n")) / (F.col("n") * F.col("base_n")))
    rows = rows.withColumns(
        {"distance": F.when(judged, F.round(F.array_max(gaps), 9)), "bound": F.when(judged, F.round(bound, 9))}
    )
    drift = (
        F.when(~judged, "too_few")
        .when(F.col("distance") <= F.col("bound"), "steady")
        .when(F.col("p50") > F.col("base_p50"), "slower")
        .when(F.col("p50") < F.col("base_p50"), "faster")
        .otherwise("steady")
    )
    return rows.withColumn("drift", drift)
