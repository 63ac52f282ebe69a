import pytest
from pyspark.sql import functions as F

from quotegrid.sources import runs
from quotegrid.sources import tables as src

SNAP = "max_age_ms int, file_date string, ts_ns bigint, source_recv_ns bigint, age_ms double"
ROWS = [(5, "2024-01-02", 20, 11, 1.0), (5, "2024-01-03", 30, 28, 1.0), (9, "2024-01-02", 20, 11, 7.0)]
FROM = {"source_name": "book"}


def test_a_run_is_read_as_it_was_published(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame(ROWS, SNAP)
    assert runs.published(spark, root).count() == 0
    row = src.write_snapshots(df, root, "a", FROM)
    assert (row["rows"], row["first_ns"], row["last_ns"], row["partial"]) == (3, 20, 30, False)
    back = runs.read_run(spark, root, "a")
    assert sorted(map(tuple, back.select(*df.columns, "source_name", "run", "partial").collect())) == sorted((*r, "book", "a", False) for r in ROWS)
    assert dict(back.dtypes)["file_date"] == "string"
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        src.write_snapshots(df, root, "a", FROM)
    src.write_snapshots(df.where("max_age_ms = 9"), root, "b", FROM)
    assert {r["run"]: r["rows"] for r in runs.published(spark, root).collect()} == {"a": 3, "b": 1}


def test_broken_empty_and_changed_outputs_stay_unpublished(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame(ROWS, SNAP)
    with pytest.raises(ValueError, match="too_old"):
        src.write_snapshots(df.withColumn("age_ms", F.lit(6.0)), root, "old", FROM)
    with pytest.raises(ValueError, match="not_causal"):
        src.write_snapshots(df.withColumn("source_recv_ns", F.lit(None).cast("bigint")), root, "null", FROM)
    with pytest.raises(ValueError, match="no rows"):
        src.write_snapshots(df.where("ts_ns < 0"), root, "none", FROM)
    for name in ("old", "null", "none", "never"):
        with pytest.raises(ValueError, match="not published"):
            runs.read_run(spark, root, name)
    src.write_snapshots(df, root, "good", FROM)
    with pytest.raises(ValueError, match="other columns"):
        src.write_snapshots(df.withColumn("more", F.lit(1)), root, "wide", FROM)


def test_a_partial_run_is_refused(spark, tmp_path):
    root = str(tmp_path)
    src.write_snapshots(spark.createDataFrame(ROWS, SNAP), root, "part", FROM, partial=True)
    with pytest.raises(ValueError, match="partial"):
        runs.read_run(spark, root, "part")
    assert runs.read_run(spark, root, "part", allow_partial=True).where("partial").count() == 3


def test_windows_read_only_the_sessions_they_name(spark, tmp_path):
    rows = [(1, s, t, 0, 100) for s, t in (("d1", 10), ("d1", 20), ("d2", 50))]
    df = spark.createDataFrame(rows, "instrument_id bigint, session_id string, ts_ns bigint, open_ns bigint, close_ns bigint")
    src.write_prepared(df, str(tmp_path), "p", FROM)
    found = src.read_window(spark, str(tmp_path), "p", 15, 60, ["d1"])
    assert [r["ts_ns"] for r in found.collect()] == [20]
    assert "session_id" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    with pytest.raises(ValueError, match="outside_session"):
        src.write_prepared(df.withColumn("close_ns", F.lit(15).cast("bigint")), str(tmp_path), "late", FROM)
