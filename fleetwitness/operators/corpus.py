"""Device corpus: capability mapping, predicted against measured, snapshots, merges."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.operators.ordered import small_side, smallest
from fleetwitness.session import cut_lineage


def map_capabilities(attrs: DataFrame, mapping: DataFrame) -> DataFrame:
    """MATCH, GAP or N/A per device attribute.

    ``attrs``: device_id, cluster, attr_name, supported; ``mapping``: cluster,
    attr_name, capability. No mapped capability is N/A, an unsupported one a GAP.
    """
    rows = attrs.join(small_side(mapping), ["cluster", "attr_name"], "left")
    verdict = F.when(F.col("capability").isNull(), "N/A").when(F.col("supported"), "MATCH").otherwise("GAP")
    return rows.withColumn("verdict", verdict)


def device_verdicts(mapped: DataFrame) -> DataFrame:
    """Roll-up per device: FULL, PARTIAL or NONE of its mapped capabilities."""
    counts = mapped.groupBy("device_id").agg(
        F.count(F.when(F.col("verdict") == "MATCH", 1)).alias("matched"),
        F.count(F.when(F.col("verdict") == "GAP", 1)).alias("gaps"),
        F.count(F.when(F.col("verdict") == "N/A", 1)).alias("unmapped"),
    )
    return counts.withColumn(
        "device_verdict",
        F.when(F.col("matched") == 0, "NONE").when(F.col("gaps") > 0, "PARTIAL").otherwise("FULL"),
    )


def predicted_vs_measured(pred: DataFrame, meas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CONFIRMED, DELTA (measured only) or MISSING (predicted only) per key."""
    p = pred.select(*keys).distinct().withColumn("_p", F.lit(1))
    m = meas.select(*keys).distinct().withColumn("_m", F.lit(1))
    result = F.when(F.col("_p").isNull(), "DELTA").when(F.col("_m").isNull(), "MISSING").otherwise("CONFIRMED")
    return p.join(m, list(keys), "full").select(*keys, result.alias("result"))


def fields_of(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide rows to ``keys, field, value`` with values as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.field", "_p.value")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields that differ between two snapshots, null-safe. Inputs: keys, value."""
    b = before.select(*keys, F.col("value").alias("before"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col("value").alias("after"), F.lit(True).alias("_a"))
    both = b.join(a, list(keys), "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    differs = ~F.col("before").eqNullSafe(F.col("after")) | F.col("_b").isNull() | F.col("_a").isNull()
    return both.where(differs).select(*keys, "before", "after", change.alias("change"))


def merge_sources(upstream: DataFrame, bench: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bench value over upstream value per key, with origin and conflict. Inputs: keys, value."""
    u = upstream.select(*keys, F.col("value").alias("upstream"))
    b = bench.select(*keys, F.col("value").alias("bench"))
    both = u.join(b, list(keys), "full")
    conflict = F.coalesce(F.col("upstream") != F.col("bench"), F.lit(False))
    return both.select(
        *keys,
        F.coalesce("bench", "upstream").alias("value"),
        F.when(F.col("bench").isNotNull(), "bench").otherwise("upstream").alias("origin"),
        conflict.alias("conflict"),
    )


def inherit_templates(records: DataFrame) -> DataFrame:
    """Resolve ``extends`` chains; a record's own deltas win over its templates'.

    ``records``: key, extends, deltas MAP. Out: key, deltas, depth, resolved, problem. One
    join per level, until no record is open: as many as the longest chain has links. A
    template that does not exist and a cycle leave a record unresolved, with ``missing: key``
    or ``cycle: key`` as the problem and the deltas found so far. Each level is written to the
    shared folder, and a job counts the open records.
    """
    parents = records.select(F.col("key").alias("_pk"), F.col("extends").alias("_pe"), F.col("deltas").alias("_pd"))
    none = F.lit(None).cast("string")
    open_rows = records.select(
        "key", F.col("extends").alias("_next"), "deltas", F.lit(0).alias("depth"), F.array("key").alias("_seen"), none.alias("problem")
    )
    done = None
    own = ["key", "deltas", "depth", "problem"]
    while True:
        closed = F.col("_next").isNull() | F.col("problem").isNotNull()
        finished = open_rows.where(closed).select(*own)
        done = finished if done is None else done.unionByName(finished)
        open_rows = open_rows.where(~closed)
        if not open_rows.take(1):
            return done.select("key", "deltas", "depth", F.col("problem").isNull().alias("resolved"), "problem")
        inherited = F.map_concat(F.map_filter("_pd", lambda k, v: ~F.array_contains(F.map_keys("deltas"), k)), F.col("deltas"))
        found = F.col("_pk").isNotNull()
        again = F.array_contains("_seen", F.col("_next"))
        problem = F.when(again, F.concat(F.lit("cycle: "), "_next")).when(~found, F.concat(F.lit("missing: "), "_next"))
        open_rows = cut_lineage(
            open_rows.join(parents, F.col("_next") == F.col("_pk"), "left").select(
                "key",
                F.col("_pe").alias("_next"),
                F.when(found & ~again & F.col("_pd").isNotNull(), inherited).otherwise(F.col("deltas")).alias("deltas"),
                (F.col("depth") + (found & ~again).cast("int")).alias("depth"),
                F.array_append("_seen", F.col("_next")).alias("_seen"),
                problem.alias("problem"),
            )
        )


def cross_validate(capture: DataFrame, reference: DataFrame, keys: Sequence[str], per: Sequence[str]) -> DataFrame:
    """Two captures agree per key; a group is trusted only when every key agrees. Inputs: keys, value."""
    c = capture.select(*keys, F.struct("value").alias("_c"))
    r = reference.select(*keys, F.struct("value").alias("_r"))
    agree = F.coalesce(F.col("_c.value").eqNullSafe(F.col("_r.value")) & F.col("_c").isNotNull() & F.col("_r").isNotNull(), F.lit(False))
    both = c.join(r, list(keys), "full").withColumn("agree", agree)
    return both.groupBy(*per).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count(F.when(~F.col("agree"), 1)).alias("disagreeing"),
        F.bool_and("agree").alias("trusted"),
    )


def anchor_check(captures: DataFrame, baseline: DataFrame, on: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Every capture carries its versions and they equal the baseline's."""
    base = baseline.select(*on, *[F.col(v).alias(f"_b_{v}") for v in versions])
    rows = captures.join(small_side(base), list(on), "left")
    absent = functools.reduce(lambda a, b: a | b, [F.col(v).isNull() for v in versions])
    equal = functools.reduce(
        lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_b_{v}")) for v in versions]
    )
    state = F.when(absent, "missing").when(equal, "anchored").otherwise("mismatch")
    return rows.withColumn("anchor", state).drop(*[f"_b_{v}" for v in versions])


def quiet_channels(scan: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` channels with the least energy per coordinator."""
    return smallest(scan, keys, [F.col("energy"), F.col("channel")], k).withColumnRenamed("_rank", "rank")


def cluster_set_delta(pred: DataFrame, meas: DataFrame) -> DataFrame:
    """Clusters predicted only, measured only, and in both."""
    return (
        pred.intersect(meas).withColumn("side", F.lit("both"))
        .unionByName(pred.subtract(meas).withColumn("side", F.lit("predicted")))
        .unionByName(meas.subtract(pred).withColumn("side", F.lit("measured")))
    )


def scrub(text: Column, patterns: Sequence[str], mark: str = "**REDACTED**") -> Column:
    """Replace everything the patterns find."""
    return functools.reduce(lambda t, p: F.regexp_replace(t, p, mark), patterns, text)


# Network keys (16 hex octets or a run of 32 hex digits and more) and extended addresses (8 hex octets).
KEY_MATERIAL = r"\b(?:[0-9A-Fa-f]{2}[: ]){15}[0-9A-Fa-f]{2}\b|\b[0-9A-Fa-f]{32,}\b"
EXTENDED_ADDRESS = r"\b(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}\b"


def scrub_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Redact key material and extended addresses in text columns."""
    return df.withColumns({c: scrub(F.col(c), [KEY_MATERIAL, EXTENDED_ADDRESS]) for c in columns})
