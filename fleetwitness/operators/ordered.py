"""Ordered scans (previous row, last known value, running sum) that survive hot keys.

A window partitioned by device puts every row of that device into one task. That
is the right plan while devices are small. A device that holds a large share of
all rows is cut into consecutive *segments* instead: its rows are range
partitioned by (key, order), the segment number is stored with a reliable
checkpoint, each segment is scanned by its own task, and one summary row per
segment carries the state over the borders.

The check of the group sizes reads only the key columns and counts map-side.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwitness.session import cut_lineage

HOT_ROWS_CONF = "spark.fleetwitness.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
MAX_SEGMENTS = 10_000
MAX_BROADCAST_KEYS = 100_000
# Spark limits ranks per task before the shuffle up to here.
TASK_RANKS = 1_000
RANGE = 65_536
SEG = "_seg"


@dataclass(frozen=True)
class Scan:
    """One scanned column: how to get it in a window and how to carry it over borders."""

    kind: str
    expr: Column


def _column(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def previous(expr: Column | str) -> Scan:
    """Value on the row before."""
    return Scan("previous", _column(expr))


def following(expr: Column | str) -> Scan:
    """Value on the row after."""
    return Scan("following", _column(expr))


def last_before(expr: Column | str) -> Scan:
    """Latest non-null value on an earlier row."""
    return Scan("last_before", _column(expr))


def last_upto(expr: Column | str) -> Scan:
    """Latest non-null value on this or an earlier row."""
    return Scan("last_upto", _column(expr))


def next_after(expr: Column | str) -> Scan:
    """Earliest non-null value on a later row."""
    return Scan("next_after", _column(expr))


def running_sum(expr: Column | str) -> Scan:
    """Sum up to and including this row."""
    return Scan("running_sum", _column(expr))


def running_max(expr: Column | str) -> Scan:
    """Largest value up to and including this row."""
    return Scan("running_max", _column(expr))


def row_index() -> Scan:
    """1 for the first row of the key."""
    return Scan("running_sum", F.lit(1).cast("bigint"))


def hot_rows_limit(spark: SparkSession, hot_rows: int | None = None) -> int:
    if hot_rows is not None:
        return hot_rows
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def _null_safe(pairs: dict[str, str]) -> Column:
    return functools.reduce(
        lambda a, b: a & b, [F.col(left).eqNullSafe(F.col(right)) for left, right in pairs.items()]
    )


class Ordered:
    """Rows grouped by ``keys`` and totally ordered by ``order`` inside each group.

    ``plain`` holds the groups that fit a task, ``split`` the segmented hot ones.
    Filters and added columns keep the segmentation, so a chain of scans checks
    and splits its input once.
    """

    def __init__(
        self,
        keys: Sequence[str],
        order: Sequence[str],
        plain: DataFrame | None,
        split: DataFrame | None,
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        self.plain, self.split = plain, split

    def _map(self, fn: Callable[[DataFrame], DataFrame]) -> Ordered:
        return Ordered(
            self.keys,
            self.order,
            None if self.plain is None else fn(self.plain),
            None if self.split is None else fn(self.split),
        )

    def where(self, condition: Column | str) -> Ordered:
        return self._map(lambda df: df.where(condition))

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self._map(lambda df: df.withColumns(columns))

    def drop(self, *names: str) -> Ordered:
        return self._map(lambda df: df.drop(*names))

    def frame(self) -> DataFrame:
        """All rows, without the segment number."""
        parts = [p.drop(SEG) for p in (self.plain, self.split) if p is not None]
        return functools.reduce(DataFrame.unionByName, parts)

    def scan(self, **scans: Scan) -> Ordered:
        plain = None if self.plain is None else self.plain.withColumns(
            {name: _in_window(s, self.keys, self.order) for name, s in scans.items()}
        )
        split = None if self.split is None else self._scan_split(scans)
        return Ordered(self.keys, self.order, plain, split)

    def _scan_split(self, scans: dict[str, Scan]) -> DataFrame:
        keys, order, df = self.keys, self.order, self.split
        at = F.struct(*order)
        summary = df.groupBy(*keys, SEG).agg(
            *[_summary(s, at).alias(f"_s_{name}") for name, s in scans.items()]
        )
        carry = summary.select(
            *keys,
            SEG,
            *[_carry(s, f"_s_{name}", keys).alias(f"_c_{name}") for name, s in scans.items()],
        )
        local = df.withColumns(
            {f"_l_{name}": _in_window(s, [*keys, SEG], order) for name, s in scans.items()}
            | {
                "_first": F.lag(F.lit(True)).over(Window.partitionBy(*keys, SEG).orderBy(*order)).isNull(),
                "_last": F.lead(F.lit(True)).over(Window.partitionBy(*keys, SEG).orderBy(*order)).isNull(),
            }
        )
        carry = carry.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, SEG]})
        joined = local.join(carry, _null_safe({k: f"_k_{k}" for k in [*keys, SEG]}), "left")
        return joined.withColumns({name: _stitch(s, name) for name, s in scans.items()}).select(
            *df.columns, *scans
        )


def _in_window(s: Scan, keys: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order)
    if s.kind == "previous":
        return F.lag(s.expr).over(w)
    if s.kind == "following":
        return F.lead(s.expr).over(w)
    if s.kind == "last_before":
        return F.last(s.expr, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if s.kind == "last_upto":
        return F.last(s.expr, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if s.kind == "next_after":
        # Reversed order keeps the frame growing; a shrinking frame is quadratic.
        back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
        return F.last(s.expr, True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    if s.kind == "running_sum":
        return F.sum(s.expr).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if s.kind == "running_max":
        return F.max(s.expr).over(w.rowsBetween(Window.unboundedPreceding, 0))
    raise ValueError(s.kind)


def _summary(s: Scan, at: Column) -> Column:
    boxed = F.struct(s.expr.alias("v"))
    known = F.when(s.expr.isNotNull(), at)
    if s.kind == "previous":
        return F.max_by(boxed, at)
    if s.kind == "following":
        return F.min_by(boxed, at)
    if s.kind in ("last_before", "last_upto"):
        return F.max_by(boxed, known)
    if s.kind == "next_after":
        return F.min_by(boxed, known)
    return F.struct((F.max if s.kind == "running_max" else F.sum)(s.expr).alias("v"))


def _carry(s: Scan, name: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(SEG)
    value = F.col(f"{name}.v")
    if s.kind == "previous":
        return F.lag(value).over(w)
    if s.kind == "following":
        return F.lead(value).over(w)
    if s.kind in ("last_before", "last_upto"):
        return F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if s.kind == "next_after":
        back = Window.partitionBy(*keys).orderBy(F.col(SEG).desc())
        return F.last(value, True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    total = F.max if s.kind == "running_max" else F.sum
    return total(value).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _stitch(s: Scan, name: str) -> Column:
    local, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if s.kind == "previous":
        return F.when(F.col("_first"), carry).otherwise(local)
    if s.kind == "following":
        return F.when(F.col("_last"), carry).otherwise(local)
    if s.kind == "running_max":
        return F.greatest(local, carry)
    if s.kind == "running_sum":
        return F.when(local.isNull(), carry).otherwise(local + F.coalesce(carry, F.lit(0)))
    return F.coalesce(local, carry)


def ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None
) -> Ordered:
    """Prepare ``df`` for scans; groups above ``hot_rows`` rows are cut into segments.

    ``order`` must be a total order inside each group (end it in a unique column).
    """
    spark = df.sparkSession
    limit = hot_rows_limit(spark, hot_rows)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot_count, hot_total = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not hot_count:
        return Ordered(keys, order, df, None)
    hot = cut_lineage(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    side = F.broadcast(hot) if hot_count <= MAX_BROADCAST_KEYS else hot
    match = _null_safe({k: f"_h_{k}" for k in keys})
    plain = df.join(side, match, "left_anti")
    segments = min(MAX_SEGMENTS, max(2, math.ceil(hot_total / limit)))
    split = (
        df.join(side, match, "left_semi")
        .repartitionByRange(segments, *keys, *order)
        .withColumn(SEG, F.spark_partition_id())
    )
    return Ordered(keys, order, plain, cut_lineage(split))


def in_segments(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str]) -> Ordered:
    """Rows that already lie in consecutive bounded segments, such as file splits."""
    return Ordered(keys, order, None, df.withColumn(SEG, F.col(segment)))


def smallest(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int, place: Column | None = None) -> DataFrame:
    """The first ``n`` rows per key with their ``_rank``.

    Up to ``TASK_RANKS`` Spark cuts each task to ``n`` rows before the shuffle. More, where ``place``
    gives the order as a whole number, are found by counts per range (see ``ranked_upto``).
    """
    if n > TASK_RANKS and place is not None:
        return ranked_upto(df, keys, place, F.lit(n)).where(F.col("_rank") <= n)
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)


def ranked_upto(df: DataFrame, keys: Sequence[str], place: Column, limit: Column, only_limit: bool = False) -> DataFrame:
    """Rows up to about the ``limit``-th of their key by ``place`` (a whole number, unique per key),
    with ``_rank``; the limit is one per key. No task ranks more than a range of ``RANGE`` places.

    Rows are counted per range first, map-side, and the counts of a key's ranges are added up in
    order; only ranges that start below the limit are ranked, with ``only_limit`` only the one that
    holds it.
    """
    ranged = df.withColumns({"_place": place.cast("bigint"), "_limit": limit}).withColumn("_range", F.floor(F.col("_place") / RANGE))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_upto"))
    before = ordered(counts, keys, ["_range"]).scan(_sum=running_sum("_n")).frame()
    wanted = before.withColumn("_skip", F.col("_sum") - F.col("_n")).where(F.col("_skip") < F.col("_upto"))
    if only_limit:
        wanted = wanted.where(F.col("_sum") >= F.col("_upto"))
    names = [f"_w_{k}" for k in keys]
    wanted = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_w_range"), "_skip")
    match = _null_safe(dict(zip(keys, names, strict=True))) & (F.col("_range") == F.col("_w_range"))
    rows = ranged.join(wanted, match).drop(*names, "_w_range")
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_place"))
    return rows.withColumn("_rank", F.col("_skip") + inside).drop("_place", "_limit", "_range", "_skip")


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Broadcast hint for a catalogue after counting it; a larger one joins by shuffle."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows else df
