"""Compare a registered query with its SQL twin: columns, rows and values, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql).to_arrow_table()


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return str(value) if value is not None else None


def canonical(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [[cell(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns, strict=True), key=repr) if names else []


def kinds(table) -> dict[str, str]:
    return {f.name: str(f.type) for f in table.schema}


def compare(spark_df, sf_dir: str, sql: str) -> tuple[str | None, int]:
    """(problem or None, number of rows)."""
    got = spark_df.toArrow()
    want = oracle_rows(sf_dir, sql)
    a, b = canonical(got), canonical(want)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}", got.num_rows
    types = {n: (x, kinds(want)[n]) for n, x in kinds(got).items() if x.replace("large_", "") != kinds(want)[n].replace("large_", "")}
    if a[1] != b[1]:
        only_a = [r for r in a[1] if r not in set(b[1])][:3]
        only_b = [r for r in b[1] if r not in set(a[1])][:3]
        return f"rows {len(a[1])} vs {len(b[1])}; {a[0]} spark-only {only_a} oracle-only {only_b}", got.num_rows
    if types:
        return f"types {types}", got.num_rows
    return None, got.num_rows
