"""Queries that do the whole of a job of which an older query does a part."""

import os

import duckdb

from lakewarden.plans import reference


def test_incident_windows(spark, tmp_path):
    c = duckdb.connect()
    meta = [
        ("fine", "2025-01-06T10:00:00Z", "2025-01-06T11:00:00Z", None), ("reversed", "2025-01-06T10:00:00Z", "2025-01-06T09:00:00Z", None), ("open", "2025-01-06T10:00:00Z", None, None),
        ("unreadable", "2025-05-05T25:61:00Z", "2025-05-05T10:00:00Z", None), ("by zone", "2025-01-06 10:00:00", "2025-01-06T14:00:00Z", "ny"),
    ]
    c.sql("CREATE TABLE meta(incident_id VARCHAR, time_window_start VARCHAR, time_window_end VARCHAR, reporting_source VARCHAR, severity VARCHAR DEFAULT 'low')")
    c.executemany("INSERT INTO meta(incident_id, time_window_start, time_window_end, reporting_source) VALUES (?, ?, ?, ?)", meta)
    c.sql("CREATE TABLE ev AS SELECT incident_id, row_number() OVER () AS event_id FROM meta")
    c.sql("CREATE TABLE acts AS SELECT incident_id, true AS approval FROM meta")
    c.sql("CREATE TABLE src AS SELECT 'ny' AS log_source, 'America/New_York' AS tz_name, 'YMD' AS date_order")
    for t, name in (("meta", "incident_meta"), ("ev", "telemetry"), ("acts", "human_actions"), ("src", "log_sources")):
        c.sql(f"COPY {t} TO '{os.path.join(tmp_path, name)}.parquet' (FORMAT parquet)")
    got = {r.incident_id: r.issues for r in reference.incident_validation(spark, str(tmp_path)).collect()}
    assert got == {"fine": "", "reversed": "window_reversed", "open": "no_window", "unreadable": "no_window", "by zone": "window_reversed"}


def test_notes_are_whole(spark, tmp_path):
    rows = [(1, "x" * 81 + " end"), (2, "Ask USER_12 about it"), (3, "short"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.redacted, r.note) for r in reference.redact_contact_notes(spark, str(tmp_path)).collect()}
    assert got == {1: (False, "x" * 81 + " end"), 2: (True, "[note withheld]"), 3: (False, "short"), 5: (False, "")}


def test_all_sources_are_counted_in_order(spark, tmp_path):
    rows = [(s,) for i, s in enumerate(["a", "b", "c", "d", "e", "f", None]) for _ in range(8 - i)] + [("aa",)] * 8
    spark.createDataFrame(rows, "source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.source, r.n) for r in reference.topk_count_desc(spark, str(tmp_path)).collect()]
    assert got == [("a", 8), ("aa", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4), ("f", 3), (None, 2)]
