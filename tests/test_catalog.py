import json

import pytest

from quotegrid.operators.calendar import CalendarRules, Rule
from quotegrid.sources import catalog as src

IDENTITY = {"dataset": "D", "symbol": "S"}
HOURS = {"open_day_offset": -1, "open": "17:00", "close": "16:00", "breaks": [{"day_offset": 0, "start": "15:15", "end": "15:30"}]}
CALENDAR = {"calendar_id": "c", "symbol": "S", "timezone": "America/Chicago", "valid_from": "2024-01-02", "valid_through": "2024-01-30", "sources": ["x"],
            "regular": HOURS, "closed_session_dates": ["2024-01-15"], "overrides": {"2024-01-16": {**HOURS, "open_day_offset": -2, "breaks": []}}}


def write(path, document):
    path.write_text(document if isinstance(document, str) else json.dumps(document, indent=1))
    return str(path)


def test_catalog_faults_are_listed(spark, tmp_path):
    files = [{"date": "2024-01-02", "condition": "available", "rows": 3, "parquet": "a.parquet"}, {"date": "20240103", "condition": "x", "rows": 0, "parquet": "a.csv"},
             {"date": "2024-02-30", "rows": 1, "parquet": "b.parquet", "more": 1}]
    good = src.read_catalog(spark, write(tmp_path / "a.json", {"dataset": "D", "symbol": "S", "files": files}))
    assert sorted(map(tuple, src.audit_catalog(good, IDENTITY).collect())) == [
        ("2024-02-30", "bad_date"), ("20240103", "bad_date"), ("20240103", "bad_rows"), ("20240103", "not_parquet")]
    other = src.read_catalog(spark, write(tmp_path / "b.json", {"dataset": "E", "symbol": "S", "files": files[:1]}))
    assert [tuple(r) for r in src.audit_catalog(other, IDENTITY).collect()] == [("2024-01-02", "wrong_identity")]
    torn = src.read_catalog(spark, write(tmp_path / "c.json", '{"dataset": "D", "files": [{"rows": '))
    assert [tuple(r) for r in src.audit_catalog(torn, IDENTITY).collect()] == [(None, "unreadable")]


def test_files_are_held_against_the_catalog(spark, tmp_path):
    for day, rows in (("2024-01-02", 3), ("2024-01-03", 2), ("2024-01-04", 1)):
        spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/data/day={day}")
    listed = spark.createDataFrame([("2024-01-02", 3, None), ("2024-01-03", 9, 1), ("2024-01-05", 1, None)], "file_date string, rows bigint, parquet_bytes bigint")
    found = src.reconcile_files(spark, f"{tmp_path}/data", listed)
    assert sorted(map(tuple, found.collect())) == [
        ("2024-01-03", "bytes_differ"), ("2024-01-03", "rows_differ"), ("2024-01-04", "unlisted_file"), ("2024-01-05", "missing_file")]


def test_calendar_document_becomes_rules(spark, tmp_path):
    read = lambda document: src.read_calendar(spark, write(tmp_path / "cal.json", document), "S", "America/Chicago")
    assert read(CALENDAR) == CalendarRules("America/Chicago", "2024-01-02", "2024-01-30", Rule(-1, "17:00", "16:00", ((0, "15:15", "15:30"),)),
                                           ("2024-01-15",), {"2024-01-16": Rule(-2, "17:00", "16:00")})
    for change, message in (({"symbol": "T"}, "is for T"), ({"sources": []}, "identity"), ({"valid_from": "2024-02-01"}, "contradict"),
                            ({"closed_session_dates": ["2024-01-16"]}, "contradict"), ({"closed_session_dates": ["2024-01-13"]}, "contradict")):
        with pytest.raises(ValueError, match=message):
            read({**CALENDAR, **change})
    with pytest.raises(ValueError, match="readable"):
        read('{"calendar_id": ')
