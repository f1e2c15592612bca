"""One key holds a third of all rows, and groups of that size are cut into segments."""

import duckdb
import pytest
from oracle import TABLES, compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "w1_drop_twins", "w2_edges", "w3_occupied_intervals", "w5_sequence_gaps", "w7_settled_values", "a7_latency_envelope",
    "a10_latency_series", "a13_report_cadence", "j8_match_command_ack", "j9_confirm_commands", "j10_no_change_commands",
    "j11_trigger_latency", "j20_post_window_state", "a21_double_runs", "w6_superseded", "w8_value_drift", "s3_carry_stamp",
    "f2_scope_to_window", "f3_time_of_day_slice", "w12_adjudicate", "w13_adjudicate_window", "w18_position_regressions",
    "w19_outage_intervals", "s9_read_suite_transcript", "a5_floor", "r4_stream_confirm", "r5_stream_drop_twins",
    "j3_new_run_after", "j12_device_verdicts", "j19_prunable_logs", "s1_read_log_lines",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The tables with a third of the rows moved to one user, order, customer and document."""
    folder = tmp_path_factory.mktemp("skewed")
    changed = {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM src",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_linenumber <= 2 THEN 7 ELSE l_orderkey END AS l_orderkey) FROM src",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM src",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id = 1 THEN repeat(text || chr(10), 400) ELSE text END AS text) FROM src",
    }
    con = duckdb.connect()
    for name in TABLES:
        sql = changed.get(name, "SELECT * FROM src").replace("src", f"'{SF}/{name}.parquet'")
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, name):
    spark.conf.set("spark.fleetwitness.hotGroupRows", "40")
    try:
        problem, rows = compare(entry.queries()[name](spark, skewed), skewed, entry.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.fleetwitness.hotGroupRows")
    assert problem is None, problem
    assert rows > 0
