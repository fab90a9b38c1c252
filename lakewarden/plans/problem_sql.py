"""SQL of the general problems, written separately from the operators: strptime instead of patterns, tables of zone
offsets instead of zone functions, recursion instead of a parser's walk."""

# ruff: noqa: E501
from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

#: Zones that the SQL knows, and the years: enough for the test tables.
ZONES = ("UTC", "America/New_York", "America/Sao_Paulo", "America/Chicago", "Europe/Madrid", "Europe/Lisbon", "Europe/Warsaw", "Australia/Sydney", "Asia/Kolkata", "Asia/Tokyo")
YEARS = (2023, 2028)


def _periods(zone: str) -> list[tuple[str, int, int, int, str]]:
    """zone, first and last UTC second, offset in seconds and abbreviation of each period without a change."""
    tz, at, end = ZoneInfo(zone), datetime(YEARS[0], 1, 1, tzinfo=UTC), datetime(YEARS[1], 1, 1, tzinfo=UTC)
    out: list[list] = []
    while at < end:
        local = at.astimezone(tz)
        now = (int(local.utcoffset().total_seconds()), local.tzname())
        if not out or (out[-1][3], out[-1][4]) != now:
            out.append([zone, int(at.timestamp()), 0, *now])
        out[-1][2] = int((at + timedelta(hours=1)).timestamp())
        at += timedelta(hours=1)
    return [tuple(x) for x in out]


_VALUES = ", ".join(str(p) for z in ZONES if z in available_timezones() for p in _periods(z))
_ISO = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S,%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%d-%b-%Y %H:%M:%S.%f", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y, %I:%M:%S %p"]
_DAY = [*_ISO, "%d/%m/%Y %I:%M:%S %p", "%d/%m/%Y %H:%M:%S"]
_MONTH = [*_ISO, "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M:%S"]


def instants(rows: str) -> str:
    """CTEs that end in ``timed``: the columns of ``rows`` (a query with columns value and src) and instant_us."""
    return f"""zone_values(tz, a, b, off, abbr) AS (VALUES {_VALUES}),
zone_periods AS (SELECT tz, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(off AS BIGINT) AS off, abbr FROM zone_values),
raw_ AS ({rows}),
text_ AS (SELECT r.*, row_number() OVER () AS rid_, trim(value) AS t, coalesce(s.tz_name, 'UTC') AS tz, s.date_order AS ord FROM raw_ r LEFT JOIN log_sources s ON s.log_source = r.src),
cut_ AS (SELECT *, regexp_replace(t, '\\[[A-Za-z/_]+\\]$', '') AS u FROM text_),
zoned AS (SELECT *, CASE WHEN regexp_matches(u, '[0-9] ?[AP]M$') THEN '' ELSE trim(regexp_extract(u, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}}| [A-Z]{{2,5}})$', 1)) END AS z,
  CASE WHEN regexp_full_match(t, '[0-9]{{9,19}}(\\.[0-9]+)?') THEN CAST(t AS DECIMAL(28, 6)) END AS num FROM cut_),
wall AS (SELECT *, CASE WHEN num IS NULL THEN epoch_us(CASE WHEN ord = 'MDY' THEN try_strptime(trim(left(u, len(u) - len(z))), {_MONTH}) ELSE try_strptime(trim(left(u, len(u) - len(z))), {_DAY}) END) END AS w FROM zoned),
local_ AS (SELECT rid_, min(w - off * 1000000) AS us FROM wall JOIN zone_periods p ON p.tz = wall.tz AND w - off * 1000000 >= a * 1000000 AND w - off * 1000000 < b * 1000000 WHERE z = '' GROUP BY 1),
named AS (SELECT DISTINCT tz, abbr, off FROM zone_periods),
timed AS (SELECT wall.*, CASE WHEN num IS NOT NULL THEN CAST(CASE WHEN num < 1e11 THEN num * 1000000 WHEN num < 1e14 THEN num * 1000 ELSE num END AS BIGINT)
  WHEN z = '' THEN l.us WHEN z = 'Z' THEN w
  WHEN z[1] IN ('+', '-') THEN w - (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS BIGINT) * 3600 + CAST(z[-2:] AS BIGINT) * 60) * 1000000
  ELSE w - n.off * 1000000 END AS instant_us
  FROM wall LEFT JOIN local_ l ON l.rid_ = wall.rid_ LEFT JOIN named n ON n.tz = wall.tz AND n.abbr = wall.z)"""


def present(x: str) -> str:
    return f"(CASE WHEN trim({x}) NOT IN ('', 'N/A', 'null', 'None') THEN trim({x}) END)"


EVENTS = f"SELECT DISTINCT event_id, event_type, {present('username')} AS username, {present('source_ip')} AS source_ip, timestamp AS value, details.log_source AS src FROM telemetry"

P3 = f"""WITH {instants(EVENTS)},
e AS (SELECT coalesce(username, source_ip) AS actor, instant_us AS t FROM timed WHERE coalesce(username, source_ip) IS NOT NULL AND instant_us IS NOT NULL),
m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY actor ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT actor, min(t) AS start_us, max(t) AS end_us, count(*) AS event_count FROM s GROUP BY actor, k"""

_ALL = """SELECT 'telemetry' AS table_name, CAST(event_id AS VARCHAR) AS record_key, 'timestamp' AS field_name, timestamp AS value, details.log_source AS src FROM telemetry
UNION ALL SELECT 'incident_meta', incident_id, 'time_window_start', time_window_start, reporting_source FROM incident_meta
UNION ALL SELECT 'incident_meta', incident_id, 'time_window_end', time_window_end, reporting_source FROM incident_meta"""

P6 = f"""WITH {instants(_ALL)}
SELECT DISTINCT table_name, record_key, field_name, instant_us FROM timed
WHERE instant_us IS NOT NULL AND record_key IS NOT NULL AND NOT regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{6}})?Z')"""

_LONE = "('processes', 'children', 'alerts', 'evidence', 'connections', 'hops', 'attachments', 'related', 'modules')"
_MARK = """'(\\\\(?:["\\\\/bfnrt]|u[0-9a-fA-F]{4}))'"""
_FIXED = f"replace(regexp_replace(regexp_replace({{x}}, {_MARK} || '|\\\\', '\\1' || chr(1), 'g'), {_MARK} || chr(1), '\\1', 'g'), chr(1), '\\\\')"


def _json(x: str) -> str:
    fixed = _FIXED.replace("{x}", x)
    return f"CASE WHEN json_valid({x}) THEN CAST({x} AS JSON) WHEN json_valid({fixed}) THEN CAST({fixed} AS JSON) END"


def _entered(x: str) -> str:
    """A JSON value, or what its text holds where that is an object or a list."""
    inner = f"({x}->>'$')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({inner}, '^\\s*[\\[{{]') AND json_valid({inner}) THEN CAST({inner} AS JSON) ELSE {x} END"


_WALK = f"""WITH RECURSIVE start_ AS (
  SELECT DISTINCT 'telemetry' AS owner_table, event_id AS owner_id, 'raw' AS path, {_json('details.raw')} AS v FROM telemetry WHERE details.raw IS NOT NULL
  UNION SELECT DISTINCT 'telemetry', event_id, 'source_summary', {_json('details.source_summary')} FROM telemetry WHERE details.source_summary IS NOT NULL
  UNION SELECT DISTINCT 'verifier_output', run_id, 'violations', to_json(violations) FROM verifier_output WHERE len(violations) > 0),
walk AS (
  SELECT owner_table, owner_id, path, '' AS parent, false AS listed, {_entered('v')} AS v FROM start_ WHERE v IS NOT NULL
  UNION ALL
  SELECT owner_table, owner_id, path || step, parent, listed, {_entered('v')} FROM (
    SELECT owner_table, owner_id, path, CASE WHEN listed THEN path ELSE parent END AS parent, false AS listed, '.' || k AS step, json_extract(v, '$."' || k || '"') AS v
      FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT') WHERE NOT (k IN {_LONE} AND json_type({_entered("json_extract(v, '$." + chr(34) + "' || k || '" + chr(34) + "')")}) = 'OBJECT')
    UNION ALL
    SELECT owner_table, owner_id, path, CASE WHEN listed THEN path ELSE parent END, true, '.' || k || '[0]', json_extract(v, '$."' || k || '"')
      FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT') WHERE k IN {_LONE} AND json_type({_entered("json_extract(v, '$." + chr(34) + "' || k || '" + chr(34) + "')")}) = 'OBJECT'
    UNION ALL
    SELECT owner_table, owner_id, path, parent, true, '[' || i || ']', json_extract(v, '$[' || i || ']')
      FROM (SELECT *, unnest(range(0, CAST(json_array_length(v) AS BIGINT))) AS i FROM walk WHERE json_type(v) = 'ARRAY'))
  WHERE json_type({_entered('v')}) IN ('OBJECT', 'ARRAY'))"""
P5 = f"""{_WALK}
SELECT DISTINCT owner_table, owner_id, path AS node_path, parent AS parent_path FROM walk WHERE listed AND json_type(v) = 'OBJECT'"""

P5_VALUES = f"""{_WALK},
scalars AS (
  SELECT owner_table, owner_id, CASE WHEN listed THEN path ELSE parent END AS node, path || '.' || k AS spot, false AS alone, json_extract(v, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT')
  UNION ALL SELECT owner_table, owner_id, path || '[' || i || ']', '', true, json_extract(v, '$[' || i || ']') FROM (SELECT *, unnest(range(0, CAST(json_array_length(v) AS BIGINT))) AS i FROM walk WHERE json_type(v) = 'ARRAY')
  UNION ALL SELECT owner_table, owner_id, '', path, false, v FROM walk WHERE NOT listed AND parent = '' AND NOT contains(path, '.') AND json_type(v) <> 'NULL')
SELECT DISTINCT owner_table, owner_id, node AS node_path, CASE WHEN alone THEN 'value' WHEN node = '' THEN substr(spot, length(regexp_extract(spot, '^[a-z_]+')) + 2) ELSE substr(spot, length(node) + 2) END AS field, v->>'$' AS value
FROM scalars WHERE json_type({_entered('v')}) NOT IN ('OBJECT', 'ARRAY')"""

P5_VIOLATIONS = """WITH v AS (SELECT DISTINCT run_id AS owner_id, violations FROM verifier_output WHERE len(violations) > 0),
u AS (SELECT owner_id, unnest(range(0, len(violations))) AS i, unnest(violations) AS x FROM v)
SELECT owner_id, 'violations[' || i || ']' AS node_path, '' AS parent_path, x.rule_id AS rule_id, x.severity AS severity, x.type AS type, x.action AS action, x.repair AS repair, x.missing_before AS missing_before FROM u WHERE x IS NOT NULL"""
