import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from quotegrid.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
# Trees and the schema report have no exact SQL form.
ROWS_ONLY = {"m04_tree", "v01_schema_check"}


def test_registry_is_complete():
    names = set(QUERIES)
    assert names <= set(entry.queries())
    assert names - set(ORACLES) == ROWS_ONLY
    wanted = {"s": 10, "c": 15, "g": 7, "f": 9, "w": 12, "l": 9, "m": 11, "k": 12, "r": 14, "p": 16, "v": 15, "z": 7, "t": 6}
    for letter, count in wanted.items():
        assert {n[1:3] for n in names if n[0] == letter and n[1:3].isdigit()} == {f"{i:02d}" for i in range(1, count + 1)}


@pytest.mark.parametrize("name", ["flagship_daily_spread", "g04_grid_ranges", "c03_session_assignment", "l01_labels", "m01_scaler_stats", "m02_gram", "m03_ridge", "m08_predict_library", "m08_fitted_library", "m10_fitted_ensemble",
                                  "k04_intent_fate", "r10_period_feedback", "p02_cross_day_summary", "v07_session_quality", "t01_stream_grid"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rows, ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 30
