"""The general problems against plain Python versions of the same definitions, and edge cases."""

import json
import re
from collections import defaultdict
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators.instants import FORMATS, rewritten, source_zones, with_instant
from lakewarden.operators.nested import flat_table, groups, node_rows, nodes, repair_backslashes, tables, triples
from lakewarden.operators.sessions import merge_intervals, sessionize
from lakewarden.plans import problems

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MISSING = ("", "N/A", "null", "None")


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def in_zone(naive, name):
    local = naive.replace(tzinfo=ZoneInfo(name), fold=0)
    back = local.astimezone(UTC).astimezone(ZoneInfo(name))
    return us(local) if back.replace(tzinfo=None) == naive else None


def brute_instant(text, tz, order):
    """A second, separate reading of the definition, with strptime."""
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", t):
        x = float(t) if "." in t else int(t)
        return round(x * 10**6) if x < 1e11 else x * 1000 if x < 1e14 else x
    t = re.sub(r"\[.*\]$", "", t)
    if m := re.fullmatch(r"(.*\d) ([A-Z]{3,4})", t):
        if m[2] in ("AM", "PM"):
            pass
        else:
            for fold in (0, 1):
                try:
                    local = datetime.strptime(m[1], "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(tz), fold=fold)
                except ValueError:
                    return None
                if local.tzname() == m[2]:
                    return us(local)
            return None
    day_first = "%m/%d/%Y" if order == "MDY" else "%d/%m/%Y"
    for f in (
        "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M",
        "%Y-%m-%dT%H:%M:%S,%f", f"{day_first} %I:%M:%S %p", f"{day_first} %H:%M:%S", "%d-%b-%Y %H:%M:%S.%f", "%a, %d %b %Y %H:%M:%S %z", "%b %d, %Y, %I:%M:%S %p", "%Y%m%dT%H%M%S%z",
    ):
        try:
            p = datetime.strptime(t, f)
        except ValueError:
            continue
        return us(p) if p.tzinfo else in_zone(p, tz or "UTC")
    return None


def zones_of(spark, small):
    return {r.log_source: (r.tz_name, r.date_order) for r in spark.read.parquet(f"{small}/log_sources.parquet").collect()}


def timed(spark, small):
    zones = zones_of(spark, small)
    out = {}
    for r in spark.read.parquet(f"{small}/telemetry.parquet").collect():
        out[r.event_id] = (r, brute_instant(r.timestamp, *zones.get(r.details.log_source, (None, None))))
    return out


def test_p6_against_brute_force(spark, small):
    zones = zones_of(spark, small)
    plain = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?Z")
    want = set()
    for i, (r, at) in timed(spark, small).items():
        if at is not None and not plain.fullmatch(r.timestamp):
            want.add(("telemetry", str(i), "timestamp", at))
    for r in spark.read.parquet(f"{small}/incident_meta.parquet").collect():
        for f in ("time_window_start", "time_window_end"):
            at = brute_instant(r[f], *zones.get(r.reporting_source, (None, None)))
            if at is not None and not plain.fullmatch(r[f]):
                want.add(("incident_meta", r.incident_id, f, at))
    rows = [tuple(r) for r in problems.p6_found(spark, small).select("table_name", "record_key", "field_name", "instant_us").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


@pytest.mark.parametrize(
    ("text", "source", "want"),
    [
        ("2025-03-30 02:30:00", "madrid", None),  # skipped
        ("2025-10-26 02:30:00", "madrid", "2025-10-26T00:30:00+00:00"),  # twice: the earlier
        ("2025-11-02 01:30:00 EDT", "york", "2025-11-02T05:30:00+00:00"),
        ("2025-11-02 01:30:00 EST", "york", "2025-11-02T06:30:00+00:00"),
        ("2025-11-02 01:30:00 XYZ", "york", None),
        ("2025-06-01 00:00:00 IST", "pune", "2025-05-31T18:30:00+00:00"),
        ("03/04/2025 10:00:00", "york", "2025-03-04T15:00:00+00:00"),
        ("03/04/2025 10:00:00", "madrid", "2025-04-03T08:00:00+00:00"),
        ("31/06/2025 10:00:00", "madrid", None),
        ("13/13/2025 10:00:00", "york", None),
        ("2025-02-29T10:00:00Z", None, None),
        ("2024-02-29T10:00:00Z", None, "2024-02-29T10:00:00+00:00"),
        ("2025-01-05T24:00:00Z", None, None),
        ("2025-01-05T23:59:60Z", None, None),
        ("2025-01-05", None, "2025-01-05T00:00:00+00:00"),
        ("2025-01-05 07:08", "york", "2025-01-05T12:08:00+00:00"),
        ("01/05/2025 12:00:01 AM", "york", "2025-01-05T05:00:01+00:00"),
        ("01/05/2025 13:00:01 PM", "york", None),
        ("Jan 5, 2025, 12:00:01 PM", None, "2025-01-05T12:00:01+00:00"),
        ("Sun, 05 Jan 2025 10:00:00 -0330", "york", "2025-01-05T13:30:00+00:00"),
        ("05-Jan-2025 10:00:00.25", None, "2025-01-05T10:00:00.250000+00:00"),
        ("2025-01-05T10:00:00.5+02:00[Europe/Athens]", "york", "2025-01-05T08:00:00.500000+00:00"),
        ("2025-01-05T10:00:00[Europe/Athens]", "york", "2025-01-05T08:00:00+00:00"),
        ("2025-01-05T10:00:00[Nowhere/City]", "york", None),
        ("20250105T101112123456Z", None, "2025-01-05T10:11:12.123456+00:00"),
        ("1736071200", "york", "2025-01-05T10:00:00+00:00"),
        ("1736071200.5", "york", "2025-01-05T10:00:00.500000+00:00"),
        ("1736071200500", "york", "2025-01-05T10:00:00.500000+00:00"),
        ("1736071200500001", "york", "2025-01-05T10:00:00.500001+00:00"),
        ("1736071200500001002", "york", "2025-01-05T10:00:00.500001+00:00"),
        (" \t2025-01-05T10:00:00Z ", None, "2025-01-05T10:00:00+00:00"),
        ("2025-01-05T10:00:00Z and more", None, None),
        ("", None, None), ("N/A", None, None), ("-", None, None), (None, "york", None), ("x" * 50_000, "york", None), ("9" * 400, None, None),
    ],
)
def test_instants(spark, text, source, want):
    sources = spark.createDataFrame(
        [("york", "America/New_York", "MDY"), ("madrid", "Europe/Madrid", "DMY"), ("pune", "Asia/Kolkata", "DMY"), ("bad", "No/Where", "DMY"), (None, None, None)],
        "log_source string, tz_name string, date_order string",
    )
    df = spark.createDataFrame([(text, source, 7)], "value string, source string, instant int")
    row = with_instant(df, "value", "source", source_zones(sources)).collect()[0]
    assert row.instant == 7
    assert row.instant_us == (None if want is None else us(datetime.fromisoformat(want)))


def test_instants_of_nothing(spark, small):
    zones = source_zones(spark.read.parquet(f"{small}/log_sources.parquet"))
    none = spark.createDataFrame([], "k string, a string, s string")
    assert with_instant(none, "a", None, None).count() == 0
    assert rewritten(none, "k", ["a"], "s", zones, "t").count() == 0
    twice = spark.createDataFrame([("k", "2025-01-05 10:00", None)] * 2 + [(None, "2025-01-05 10:00", None)], "k string, a string, s string")
    assert [tuple(r) for r in rewritten(twice, "k", ["a"], "s", zones, "t").collect()] == [("t", "k", "a", us(datetime(2025, 1, 5, 10, tzinfo=UTC)))]
    assert len({f[0] for f in FORMATS}) == len(FORMATS)


def brute_sessions(events, gap):
    by = defaultdict(list)
    for key, at in events:
        if key is not None and at is not None:
            by[key].append(at)
    out = []
    for key, all_at in by.items():
        all_at.sort()
        start = last = all_at[0]
        n = 0
        for at in all_at:
            if at - last > gap:
                out.append((key, start, last, n))
                start, n = at, 0
            last, n = at, n + 1
        out.append((key, start, last, n))
    return sorted(out)


def test_p3_against_brute_force(spark, small):
    events = []
    for r, at in timed(spark, small).values():
        names = [x.strip() if x is not None else "" for x in (r.username, r.source_ip)]
        actor = next((x for x in names if x not in MISSING), None)
        events.append((actor, at))
    rows = [tuple(r) for r in problems.p3_found(spark, small).select("actor", "start_us", "end_us", "event_count").collect()]
    assert sorted(rows) == brute_sessions(events, 30 * 60 * 10**6)


def test_sessions_edges(spark):
    gap = 100
    events = [("a", 0), ("a", 100), ("a", 201), ("a", 201), ("b", -250), ("b", -150), ("b", 5), (None, 3), ("c", None), ("", 9)] + [("hot", i * 37 % 5000) for i in range(900)]
    df = spark.createDataFrame(events, "actor string, at bigint").withColumn("start_us", F.lit("clash"))
    rows = sorted(tuple(r) for r in sessionize(df, "actor", "at", gap).drop("duration_us").collect())
    assert rows == brute_sessions(events, gap)
    assert sessionize(df.limit(0), "actor", "at", gap).count() == 0
    # Results of parts can be united and merged again.
    parts = [sessionize(df.where(F.col("at") % 2 == k), "actor", "at", gap).drop("duration_us") for k in (0, 1)]
    assert sorted(tuple(r) for r in merge_intervals(parts[0].union(parts[1]), "actor", gap).collect()) == rows


LONE = "processes, children, alerts, evidence, connections, hops, attachments, related, modules".split(", ")


def brute_nodes(text, root):
    """All list elements that are objects, by recursion."""
    out = []

    def read(t):
        for attempt in (lambda: json.loads(t), lambda: json.loads(repair_backslashes(t))):
            try:
                return attempt()
            except ValueError:
                continue
        return None

    def go(v, path, parent, listed):
        if isinstance(v, str) and v.strip()[:1] in ("{", "["):
            inner = read(v)
            v = inner if isinstance(inner, (dict, list)) else v
        if isinstance(v, dict):
            if listed:
                out.append((path, parent))
                parent = path
            for k, x in v.items():
                y = read(x) if isinstance(x, str) and x.strip()[:1] in ("{", "[") else x
                if k in LONE and isinstance(y, dict):
                    go(y, f"{path}.{k}[0]", parent, True)
                else:
                    go(x, f"{path}.{k}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", parent, True)

    go(read(text) if text is not None else None, root, "", False)
    return out


def test_p5_against_brute_force(spark, small):
    want = set()
    for r in spark.read.parquet(f"{small}/telemetry.parquet").collect():
        for root in ("raw", "source_summary"):
            want |= {("telemetry", r.event_id, *x) for x in brute_nodes(r.details[root], root)}
    for r in spark.read.parquet(f"{small}/verifier_output.parquet").collect():
        want |= {("verifier_output", r.run_id, f"violations[{i}]", "") for i, v in enumerate(r.violations or []) if v is not None}
    rows = [tuple(r) for r in problems.p5_found(spark, small).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


def test_nested_edges(spark):
    texts = [
        (1, '{"children":{"a":1,"children":[{},{"b":"x"}]}}'),
        (2, '{"p":"{\\"alerts\\":{\\"k\\":null}}"}'),
        (3, '[{"a":[[{"z":1}],[]]}, 5, null, "[{}]"]'),
        (4, r'{"modules":[{"path":"C:\Users\x"}]}'),
        (5, '{"modules":[{"path":"cut'), (6, ""), (7, None), (8, "null"), (9, "{}"), (10, "[" * 5000), (11, '"[{\\"a\\":1}]"'),
        (None, '{"hops":{}}'), (12, '{"x":[' + ",".join(['{"k":1}'] * 3000) + "]}"), (13, '{"\\u0068ops":{}}'),
    ]
    df = spark.createDataFrame(texts, "id bigint, doc string").withColumn("node_path", F.lit("clash"))
    rows = sorted((r.owner_id or 0, r.node_path, r.parent_path) for r in nodes(df, "id", ["doc"]).collect())
    want = sorted((i or 0, *x) for i, t in texts if i != 10 for x in brute_nodes(t, "doc"))
    assert rows == want
    assert (4, "doc.modules[0]", "") in rows and (13, "doc.hops[0]", "") in rows
    assert nodes(df.limit(0), "id", ["doc"]).count() == 0

    found = triples(df.where("id in (1, 3)"), "id", ["doc"])
    assert {(r.group_path, r.field) for r in groups(found).collect()} == {("doc.children[]", "a"), ("doc.children[].children[]", "b"), ("doc[].a[][]", "z"), ("doc[]", "value")}
    table = flat_table(found, "doc.children[].children[]", ["b", "owner_id"]).orderBy("node_path").collect()
    assert [tuple(r) for r in table] == [(1, "doc.children[0].children[0]", "doc.children[0]", None, None), (1, "doc.children[0].children[1]", "doc.children[0]", "x", None)]


def test_further_time_writings_and_reasons(spark):
    zones = source_zones(spark.createDataFrame([("madrid", "Europe/Madrid", "DMY"), ("howe", "Australia/Lord_Howe", "DMY")], "log_source string, tz_name string, date_order string"))
    rows = [
        ("Thu Jan  2 03:04:05 2025", None, "2025-01-02T03:04:05+00:00", None), ("Thu Jan 2 03:04:05 UTC 2025", "madrid", "2025-01-02T03:04:05+00:00", None),
        ("2025-01-02T03:04:05-03", "madrid", "2025-01-02T06:04:05+00:00", None), ("2025-01-02t03:04:05z", "madrid", "2025-01-02T03:04:05+00:00", None),
        ("20250102T030405+01", None, "2025-01-02T02:04:05+00:00", None), ("January 2, 2025", None, "2025-01-02T00:00:00+00:00", None), ("2 Sept 2025", None, "2025-09-02T00:00:00+00:00", None),
        ("Jantastic 2, 2025", None, None, "unreadable"), ("Foo, 02 Jan 2025 03:04:05 +0000", None, None, "unreadable"), ("2025-W01-4", None, None, "unreadable"), ("2025-02-30", None, None, "unreadable"),
        ("2025-03-30 02:30:00", "madrid", None, "skipped"), ("2025-10-26 02:30:00", "madrid", "2025-10-26T00:30:00+00:00", "ambiguous"), ("2025-10-26 02:30:00+01:00", "madrid", "2025-10-26T01:30:00+00:00", None),
        ("2025-04-06 01:45:00", "howe", "2025-04-05T14:45:00+00:00", "ambiguous"), (" ", "madrid", None, "missing"), (None, None, None, "missing"), ("1736071200", "madrid", "2025-01-05T10:00:00+00:00", None),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, *_) in enumerate(rows)], "i int, t string, src string")
    got = {r.i: (r.instant_us, r.why) for r in with_instant(df, "t", "src", zones, why="why").collect()}
    assert got == {i: (None if at is None else us(datetime.fromisoformat(at)), why) for i, (_, _, at, why) in enumerate(rows)}


def test_tables_of_nested_records(spark):
    texts = [
        (1, '{"host":"a","tags":[1,"x",null],"alerts":[{"code":"A","evidence":{"kind":"k1","tags":[["t"]]}},{"code":1.50,"node_path":true,"deep":{"er":{"v":null}}}]}'),
        (2, '{"alerts":[{"evidence":[{"kind":"k2"},{}]}],"tags":[]}'), (None, '{"host":"b"}'), (3, '5'), (4, 'broken {'),
    ]
    rows = node_rows(spark.createDataFrame(texts, "id bigint, doc string"), "id", ["doc"]).cache()
    found = {k: sorted((tuple(r) for r in t.collect()), key=str) for k, t in tables(rows).items()}
    names = {k: t.columns[3:] for k, t in tables(rows).items()}
    assert names == {
        "doc": ["", "host"], "doc.tags[]": ["value"], "doc.alerts[]": ["code", "deep.er.v", "_node_path"],
        "doc.alerts[].evidence[]": ["kind"], "doc.alerts[].evidence[].tags[][]": ["value"],
    }
    assert found["doc"] == [(1, "", "", None, "a"), (3, "", "", "5", None), (None, "", "", None, "b")]
    assert found["doc.tags[]"] == [(1, "doc.tags[0]", "", "1"), (1, "doc.tags[1]", "", "x"), (1, "doc.tags[2]", "", None)]
    assert found["doc.alerts[]"] == [(1, "doc.alerts[0]", "", "A", None, None), (1, "doc.alerts[1]", "", "1.50", None, "true"), (2, "doc.alerts[0]", "", None, None, None)]
    assert found["doc.alerts[].evidence[]"] == [(1, "doc.alerts[0].evidence[0]", "doc.alerts[0]", "k1"), (2, "doc.alerts[0].evidence[0]", "doc.alerts[0]", "k2"), (2, "doc.alerts[0].evidence[1]", "doc.alerts[0]", None)]
    assert found["doc.alerts[].evidence[].tags[][]"] == [(1, "doc.alerts[0].evidence[0].tags[0][0]", "doc.alerts[0].evidence[0]", "t")]
    with pytest.raises(ValueError, match="more than 3 columns"):
        tables(rows, most=3)
    deep = spark.createDataFrame([(1, '[{"a":' * 5000 + "1" + "}]" * 5000)], "id bigint, doc string")
    assert nodes(deep, "id", ["doc"]).count() == 5000


def test_repair():
    assert repair_backslashes(r"C:\Users") == r"C:\\Users"
    assert repair_backslashes(r"a\\nb\q\u12x\u00e9" + "\\") == r"a\\nb\\q\\u12x\u00e9" + "\\\\"


def test_many_runs_schema(spark, small):
    for q in problems.queries().values():
        assert isinstance(q(spark, small).schema, T.StructType)
    assert timezone.utc is UTC
