"""Every query against DuckDB's SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandlog.operators import frames as O
from strandlog.plans import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    with duckdb.connect() as db:
        for p in glob.glob(f"{DIR}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        r = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        want = sorted(str([row[names.index(c)] for c in cols]) for row in r.fetchall())
    assert sorted(str([row[c] for c in cols]) for row in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bounds_reach_the_scan(spark):
    plan = core.replay_time_range(spark, DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


def test_no_task_holds_a_whole_stream(spark):
    for name in ("merge_concat", "frame_layout", "rotate_records"):
        plan = core.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "", 1) or name == "merge_concat"


def test_indexed_replay_is_the_full_scan_when_times_are_out_of_order(spark):
    rows = [(k, t, None, 1, '{"a":1}') for k, t in enumerate([50, 10, 10, 90, 20, 90, 0, 30, 5, 60])]
    f = spark.createDataFrame(rows, "frame_index long, ts_ns long, type long, length long, payload string")
    for low in (0, 10, 30, 60, 90, 91):
        got = O.replay_indexed(f, O.index(f, 3), 3, low)
        assert sorted(r.frame_index for r in got.collect()) == [k for k, t in enumerate([50, 10, 10, 90, 20, 90, 0, 30, 5, 60]) if t >= low]
