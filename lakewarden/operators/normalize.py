"""Raw records to typed rows: renaming, priority lookups, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.present import first_present, present, strip_quotes
from lakewarden.functions.text import slug, tag_part, without_tags

# How the files of the known exporters begin and the source type each stands for, in order.
SOURCE_PREFIXES = (
    ("dataset-alsd", "ALSD"),
    ("dataset-bloodhoundv2", "BLOODHOUND"),
    ("dataset-eap", "EAP"),
    ("dataset-edr", "EDR"),
    ("dataset-ips", "IPS"),
    ("dataset-rbmws", "RBMWS"),
    ("dataset-utm", "UTM"),
    ("datset-linuxos", "LINUX_OS"),
    ("dataset-linuxos", "LINUX_OS"),
)

# The exporters' column names for each field, first choice first.
VENDOR_NAMES = {
    "event_type": ["Event Name"],
    "category": ["Low Level Category"],
    "timestamp": ["Start Time"],
    "source_ip": ["Source IP"],
    "dest_ip": ["Destination IP"],
    "username": ["Username", "Account Name (custom)"],
    "command": ["Command (custom)", "Command Line (custom)", "Parent Command Line (custom)", "Grandparent Command Line (custom)"],
    "log_source": ["Log Source", "Fortinet Device Name (custom)"],
}
SEVERITY_NAMES = ["CS-Severity (custom)", "FortinetSeverity (custom)", "Threat Severity (custom)", "Fortinet Level (custom)"]
QUOTED_NAMES = ["FortinetSeverity (custom)", "Fortinet Level (custom)"]
UNKNOWN = ["event_type", "category"]


def source_type(name: Column | str) -> Column:
    """The type that the first fitting prefix names, else the name in upper case."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.upper(name)
    for prefix, kind in reversed(SOURCE_PREFIXES):
        out = F.when(F.startswith(F.lower(name), F.lit(prefix)), kind).otherwise(out)
    return out


def event_columns(telemetry: DataFrame) -> DataFrame:
    """Flat events, copies included: placeholders to null, quotes round commands dropped, severity and category in lower case.

    Adds details_text, the details as JSON with sorted keys, in lower
    case, for needles in any detail.
    """
    d = "details."
    details = F.to_json(F.struct(*[F.col(d + c).alias(c) for c in ("command", "log_source", "raw", "severity", "source_summary")]), {"ignoreNullFields": "false"})
    return telemetry.select(
        "event_id", "incident_id", "line_no", F.coalesce(present("event_type"), F.lit("unknown")).alias("event_type"), F.lower(present("category")).alias("category"),
        "timestamp", present("source_type").alias("source_type"), present("source_ip").alias("source_ip"), present("dest_ip").alias("dest_ip"), present("username").alias("username"),
        strip_quotes(present(d + "command")).alias("command"), F.lower(present(d + "severity")).alias("severity"), present(d + "log_source").alias("log_source"),
        F.col(d + "source_summary").alias("source_summary"), F.col(d + "raw").alias("raw"), F.lower(details).alias("details_text"),
    )


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the rows that are alike in ``keys``; those whose first key is null all stay, spread over the tasks."""
    own = F.when(F.col(keys[0]).isNull(), F.monotonically_increasing_id())
    return rows.withColumn("_own", own).dropDuplicates([*keys, "_own"]).drop("_own")


def event_rows(telemetry: DataFrame) -> DataFrame:
    """event_columns() with each event once: its first line stands for all of its deliveries.

    Events without an id are events of their own.  What only asks whether there is an event, or
    has few rows left, does better with event_columns() and once().
    """
    own = F.when(F.col("event_id").isNull(), F.xxhash64("incident_id", "line_no"))
    first = Window.partitionBy("event_id", own).orderBy("line_no")
    return event_columns(telemetry.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1))


def pick(record: str, names: list[str]) -> Column:
    """The first present value among the keys ``names`` of a MAP<STRING, STRING> column."""
    return first_present(*[F.try_element_at(F.col(record), F.lit(n)) for n in names])


def vendor_events(df: DataFrame, record: str, kind: Column | str) -> DataFrame:
    """Events from flat records (MAP<STRING, STRING>) of exporters: a column per field, and source_type from ``kind``.

    A value counts when it is present and, for the severities that exporters put in quotes, not empty
    without them.  Event type and category are "unknown" where there is none.  Other columns are kept.
    """
    fields = {name: pick(record, names) for name, names in VENDOR_NAMES.items()}
    fields |= {name: F.coalesce(fields[name], F.lit("unknown")) for name in UNKNOWN}
    found = [pick(record, [n]) for n in SEVERITY_NAMES]
    fields["severity"] = F.coalesce(*[F.nullif(strip_quotes(c) if n in QUOTED_NAMES else c, F.lit("")) for n, c in zip(SEVERITY_NAMES, found, strict=True)])
    return df.withColumns({**fields, "source_type": kind if isinstance(kind, Column) else F.lit(kind)})


def iso_millis(value: Column | str) -> Column:
    """Milliseconds since 1970 as yyyy-MM-ddTHH:mm:ss.SSSZ."""
    return F.date_format(F.timestamp_millis(F.col(value) if isinstance(value, str) else value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def severity_level(value: Column) -> Column:
    """low, medium, high or critical; anything else is medium."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("low", "medium", "high", "critical"), v).otherwise("medium")


def export_meta(exports: DataFrame, role: str = "endpoint") -> DataFrame:
    """One incident row per raw export (incident_id, incident_type_ids, severity_code, resolution_id, start_date, inc_start,
    end_date, inc_last_modified_date as milliseconds, properties).

    Criticality is the severity.  A missing start stays null (a clock's time would make the result
    depend on when it runs), a missing end is the start.
    """
    start = F.coalesce(iso_millis("start_date"), iso_millis("inc_start"))
    level = severity_level(F.coalesce("severity_code", "properties.cs_severity"))
    return exports.select(
        "incident_id", slug(F.coalesce(F.get("incident_type_ids", F.lit(0)), F.lit("suspicious_activity"))).alias("incident_type"),
        level.alias("severity"), level.alias("asset_criticality"), F.lit(role).alias("asset_role"), start.alias("time_window_start"),
        F.coalesce(iso_millis("end_date"), iso_millis("inc_last_modified_date"), start).alias("time_window_end"),
        slug(F.coalesce("resolution_id", "properties.status_do_incidente")).alias("final_status"), F.col("properties.cs_hostname").alias("asset_host"),
    )


def export_events(exports: DataFrame) -> DataFrame:
    """The events of raw exports: one detection each, then one per note that is not empty without markup.

    Columns: incident_id, line_no (1 for the detection), event_type, category, timestamp, source_ip, username, command, severity, log_source.
    """
    p = "properties."
    label = F.coalesce(F.nullif("description", F.lit("")), F.nullif("name", F.lit("")), F.lit("detection"))
    none = F.lit(None).cast("string")
    detections = exports.select(
        "incident_id", F.lit(1).alias("line_no"), F.lit("command_execution_attempt").alias("event_type"), slug(label).alias("category"),
        F.coalesce(iso_millis("discovered_date"), iso_millis("start_date")).alias("timestamp"), F.nullif(p + "cs_source_ip", F.lit("")).alias("source_ip"),
        F.col(p + "cs_username").alias("username"), F.nullif(p + "cs_command_line", F.lit("")).alias("command"), severity_level(F.col(p + "cs_severity")).alias("severity"), F.lit("soar_export").alias("log_source"),
    )
    notes = exports.select("incident_id", F.posexplode("extracted_notes").alias("_n", "_note")).withColumn("_text", without_tags(F.col("_note.text")))
    return detections.unionByName(
        notes.where(F.col("_text") != "").select(
            "incident_id", (F.col("_n") + 2).alias("line_no"), F.lit("case_note").alias("event_type"), F.lit("soar_note").alias("category"), iso_millis("_note.create_date").alias("timestamp"),
            none.alias("source_ip"), F.col("_note.user_name").alias("username"), F.substring("_text", 1, 220).alias("command"), none.alias("severity"), F.lit("soar_note").alias("log_source"),
        )
    )


def run_tag(*parts: Column | str) -> Column:
    """Parts of a tag, each without odd characters, joined by underscores."""
    return F.concat_ws("_", *[tag_part(p) for p in parts])


def event_line(at: str = "timestamp", event_type: str = "event_type", command: str = "command") -> Column:
    """"[19 characters of time] type: 80 characters of command", parts that are missing left out."""
    return F.concat(F.coalesce(F.concat(F.lit("["), F.substring(F.col(at), 1, 19), F.lit("] ")), F.lit("")), F.col(event_type), F.coalesce(F.concat(F.lit(": "), F.substring(F.col(command), 1, 80)), F.lit("")))


def relative_path(path: Column | str, marker: str) -> Column:
    """What follows the first ``marker`` in a path, marker included; the path itself without one."""
    path = F.col(path) if isinstance(path, str) else path
    at = F.instr(path, marker)
    return F.when(at > 0, path.substr(at, F.length(path))).otherwise(path)


def csv_items(text: Column | str) -> Column:
    """The items of a comma-separated text: trimmed, no empty ones, each once in first order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def overlay(main: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``main``, and those of ``fallback`` whose key it lacks."""
    return main.unionByName(fallback.join(main.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
