"""Quantile sketches of weeks and the drift they show."""

import random
from datetime import datetime, timedelta

from fixtures import table
from pyspark.sql import functions as F

from fleetwitness.operators import drift

START = datetime(2031, 5, 5)


def test_sketches_of_parts_merge_within_their_bound(spark):
    """Ranks from merged weekly sketches of 60,000 skewed values are off by less than 1.7 %."""
    rng = random.Random(4)
    values = [int(rng.lognormvariate(10, 1)) for _ in range(60_000)]
    rows = table(spark, "device_id BIGINT, ts TIMESTAMP, latency_us BIGINT", [(1, START + timedelta(minutes=n), v) for n, v in enumerate(values)])
    weeks = drift.weekly_sketches(rows.repartition(7))
    merged = weeks.groupBy().agg(F.kll_merge_agg_bigint("sketch", drift.SKETCH_K).alias("s"))
    values.sort()
    for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99):
        got = merged.select(drift.quantile("s", q)).first()[0]
        at = sum(v <= got for v in values) / len(values)
        assert abs(at - q) < 0.017


def test_a_slower_device_is_flagged(spark):
    rng = random.Random(9)
    rows = []
    for device, factor in ((1, 1.0), (2, 3.0), (3, 0.3)):
        for week in range(8):
            for n in range(60):
                base = rng.lognormvariate(10, 0.3) * (factor if week >= 5 else 1)
                rows.append((device, START + timedelta(weeks=week, minutes=n), int(base)))
    rows += [(4, START, 7), (4, None, 9), (4, START, None)]
    out = {(r.device_id, r.week): r for r in drift.latency_drift(table(spark, "device_id BIGINT, ts TIMESTAMP, latency_us BIGINT", rows)).collect()}
    weeks = sorted({w for d, w in out if d == 2})
    by = lambda d: [out[(d, w)].drift for w in weeks]
    assert by(1)[1:] == ["steady"] * 7 and by(1)[0] == "too_few"
    assert by(2)[1:6] == ["steady"] * 4 + ["slower"] and by(3)[5] == "faster"
    assert [r.drift for (d, _), r in out.items() if d == 4] == ["too_few"]
