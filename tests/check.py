"""Run registered queries against the oracle: ``python tests/check.py [name part …]``."""

import sys
import time
import traceback

sys.path[:0] = [".", "tests"]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare  # noqa: E402

from fleetwitness.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.01"


def main(parts):
    spark = local_session(8)
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, SF)
            if name in oracles:
                problem, n = compare(df, SF, oracles[name])
            else:
                problem, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
            if parts:
                traceback.print_exc()
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad", bad)


main(sys.argv[1:])
