"""Mixed time writings to one instant: microseconds since 1970-01-01 UTC.

An ordered cascade of anchored patterns takes a value apart into its fields.  A value
that fits no pattern, or whose fields are out of range, has no instant: nothing is
guessed.  A zone or offset in the value decides; an abbreviation is read as that of the
source's zone; a value without either is wall-clock time of the source's zone, or UTC
when the source is unknown.  Policy for local times: one that occurs twice means the
earlier instant, one that the zone skips has none.

All of it runs as column expressions, so it stays in the JVM and inside code generation.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.present import strip
from lakewarden.sources.tables import bounded_rows

DATE_ORDERS = ("DMY", "MDY", "YMD")

# Month names as they are written in the formats below.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

_FULL = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_MONTH = rf"(?=(?:{_FULL})(?![a-z]))(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_DAY = "(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([AaPp][Mm]))?"
_ZONE = r"(?: ?(?:([A-Z]{1,5}|z)|([+-]\d{2})(?::?(\d{2}))?))?(?:\[([A-Za-z0-9_+\-/]+)\])?"

# Each pattern and the order of its groups in: year, month, day, hour, minutes:seconds.
# fraction, half of the day, name of the zone, offset, region, how the value was written.
FORMATS: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5:$6.$7||$8|$9:$10|$11|"),
    ("numeric date", rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5:$6.$7|$8|$9|$10:$11|$12|N"),
    ("number", r"^(-?\d{1,19}(?:\.\d{1,9})?)$", "$1|||||||||E"),
    ("day month", rf"^{_DAY}(\d{{1,2}})[ \-]{_MONTH}[ \-](\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5:$6.$7|$8|$9|$10:$11|$12|M"),
    ("month day", rf"^{_DAY}{_MONTH} (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5:$6.$7|$8|$9|$10:$11|$12|M"),
    ("clock before year", rf"^{_DAY}{_MONTH} {{1,2}}(\d{{1,2}}) {_CLOCK}{_ZONE} (\d{{4}})$", "$11|$1|$2|$3|$4:$5.$6||$7|$8:$9|$10|M"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(\d{0,6})(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?$", "$1|$2|$3|$4|$5:$6.$7||$8|$9:$10||"),
    ("year first", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:,?[T ]{_CLOCK}{_HALF}{_ZONE})?$", "$1|$2|$3|$4|$5:$6.$7|$8|$9|$10:$11|$12|"),
]

#: Rows of a source lookup up to which it may be broadcast; beyond, a plain join is used.
LOOKUP_ROWS = 10_000


def abbreviations(zone: str) -> dict[str, str]:
    """The abbreviations used in ``zone`` since 1970 and their offsets (+hh:mm), the latest use of each."""
    found: dict[str, str] = {}
    tz, at = ZoneInfo(zone), datetime(1970, 1, 1, tzinfo=UTC)
    while at.year < 2040:
        local = at.astimezone(tz)
        if local.tzname() and local.tzname()[0] not in "+-":
            found[local.tzname()] = local.isoformat()[-6:]
        at += timedelta(days=10)
    return found


def source_zones(sources: DataFrame, key: str = "log_source", zone: str = "tz_name", order: str = "date_order") -> DataFrame:
    """A lookup with columns _source, _tz, _order, _abbr (abbreviation to offset) from a source table.

    Zone names are at most some 600, so the table of abbreviations is small whatever the
    size of ``sources``.  The lookup is marked for broadcast only when it was counted to
    hold at most LOOKUP_ROWS rows.  Sources with a null key or unknown zone are left out
    (their values count as without a source).
    """
    spark = sources.sparkSession
    all_zones = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "_tz string")
    # At most as many rows as there are zones.
    named = all_zones.join(sources.select(F.col(zone).alias("_tz")).distinct(), "_tz", "left_semi").collect()
    known = [(r[0], abbreviations(r[0])) for r in named]
    zones = spark.createDataFrame(known, "_tz string, _abbr map<string,string>")
    lookup = (
        sources.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_source"))
        .agg(F.min(zone).alias("_tz"), F.min(F.upper(order)).alias("_order"))
        .join(F.broadcast(zones), "_tz")
        .select("_source", "_tz", "_order", "_abbr")
    )
    small = bounded_rows(lookup.select("_source"), LOOKUP_ROWS) is not None
    return F.broadcast(lookup) if small else lookup


def _settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    The optimizer pushes filters and projections through plain projections by putting the
    whole expression in the place of each mention; over a chain of them the plan grows
    exponentially.  Nothing is pushed through a generator's output.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_w_one")
    return df.select("*", one).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_w_one.{n}").alias(n) for n in columns])


def with_instant(df: DataFrame, value: str, source: str | None, zones: DataFrame | None, out: str = "instant_us", why: str | None = None) -> DataFrame:
    """Adds BIGINT ``out``: the instant of the time string in column ``value``, or null.

    ``source`` names a column that holds the source of each row, ``zones`` is the lookup of
    source_zones(); with neither, values without zone are UTC.  Null, empty and unreadable
    values, impossible dates and skipped local times give null.  ``why`` adds a column that tells what the
    policy did: missing, unreadable, skipped, ambiguous (twice there: the earlier) or null.  Rows are neither added nor
    dropped; other columns of any name (but those that begin with ``_w_``) are kept.
    """
    kept = list(df.columns)
    if source is not None and zones is not None:
        z = zones.select(*[F.col(c).alias("_w" + c) for c in ("_source", "_tz", "_order", "_abbr")])
        df = df.withColumn("_w_key", F.col(source)).join(z, F.col("_w_key") == F.col("_w_source"), "left")
    else:
        df = df.withColumns({"_w_tz": F.lit(None).cast("string"), "_w_order": F.lit(None).cast("string"), "_w_abbr": F.lit(None).cast("map<string,string>")})
    v = F.col("_w_v")
    taken = F.lit(None).cast("string")
    for _, pattern, groups in reversed(FORMATS):
        taken = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, groups)).otherwise(taken)
    df = _settle(df.withColumn("_w_v", strip(value)), _w_p=F.split(taken, r"\|", -1))

    def part(i: int) -> Column:
        return F.get(F.col("_w_p"), F.lit(i))

    # Only MDY puts the month first in a numeric date; sources with another or no order count as day first.
    month_first = F.coalesce(F.col("_w_order") == "MDY", F.lit(False))
    kind = part(9)
    month = F.when(kind == "M", F.expr(f"(locate(get(_w_p, 1), '{MONTHS}') + 2) div 3").cast("string")).when((kind == "N") & ~month_first, part(2)).otherwise(part(1))
    day = F.when((kind == "N") & ~month_first, part(1)).otherwise(part(2))
    twelve = part(3).try_cast("int")
    hour = (
        F.when(part(3) == "", "0")
        .when(part(5) == "", part(3))
        .when(twelve.between(1, 12), (twelve % 12 + F.when(F.lower(part(5)) == "pm", 12).otherwise(0)).cast("string"))
    )
    clock = F.rtrim(part(4), F.lit("."))
    clock = F.when(clock == ":", "00:00").when(F.endswith(clock, F.lit(":")), F.concat(clock, F.lit("00"))).otherwise(clock)
    named = (part(6) == "") & (part(7) == ":")
    offset = F.when(F.endswith(part(7), F.lit(":")), F.concat(part(7), F.lit("00"))).otherwise(part(7))
    fixed = F.when(part(6).isin("Z", "z", "UTC", "GMT", "UT"), "Z").when(part(7) != ":", offset).otherwise(F.try_element_at(F.col("_w_abbr"), part(6)))
    there = F.when(part(8) != "", part(8)).otherwise(F.coalesce(F.col("_w_tz"), F.lit("UTC")))
    df = _settle(
        df,
        _w_local=F.when(kind != "E", F.concat(part(0), F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":"), clock)),
        _w_zone=F.when(named, F.concat(F.lit(" "), there)).otherwise(fixed),
        _w_number=F.when(kind == "E", part(0).try_cast("decimal(28,9)")),
    )
    df = _settle(df, _w_at=F.concat("_w_local", "_w_zone").try_cast("timestamp"))
    skipped = F.from_utc_timestamp("_w_at", F.ltrim("_w_zone")) != F.concat("_w_local", F.lit("Z")).try_cast("timestamp")
    size = F.abs("_w_number")
    scale = F.when(size < 10**11, 10**6).when(size < 10**14, 10**3)
    number = F.col("_w_number")
    epoch = F.when(scale.isNotNull(), (number * scale).cast("bigint")).when(size < 10**17, number.cast("bigint")).otherwise(F.floor(number / 1000).cast("bigint"))
    at = F.when(F.startswith(F.col("_w_zone"), F.lit(" ")) & skipped, None).otherwise(F.unix_micros("_w_at"))
    instant = F.when(number.isNotNull(), epoch).otherwise(at)
    told = []
    if why is not None:
        # Zones go back by an hour, some by half of one or two.
        later = [F.from_utc_timestamp(F.timestamp_micros(F.unix_micros("_w_at") + m * 60_000_000), F.ltrim("_w_zone")) == F.concat("_w_local", F.lit("Z")).try_cast("timestamp") for m in (30, 60, 120)]
        twice = later[0] | later[1] | later[2]
        local = F.startswith(F.col("_w_zone"), F.lit(" "))
        reason = F.when(F.coalesce(v, F.lit("")) == "", "missing").when(local & skipped, "skipped").when(instant.isNull(), "unreadable").when(number.isNull() & local & twice, "ambiguous")
        told = [reason.alias(why)]
    return df.select(*[F.col(f"`{c}`") for c in kept], instant.alias(out), *told)


PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?Z$"


def rewritten(df: DataFrame, key: str, fields: list[str], source: str, zones: DataFrame, table_name: str) -> DataFrame:
    """The values of ``fields`` that have an instant but aren't in the plain UTC form.

    One row per distinct (table_name, record_key, field_name, instant_us): records that were
    written twice count once.  Rows without a key are left out.
    """
    long = df.select(
        F.col(key).cast("string").alias("record_key"),
        F.col(source).alias("_src"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("_f"),
    ).select("record_key", "_src", "_f.field_name", "_f.value")
    odd = long.where(F.col("record_key").isNotNull() & F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN))
    timed = with_instant(odd, "value", "_src", zones).where(F.col("instant_us").isNotNull())
    return timed.select(F.lit(table_name).alias("table_name"), "record_key", "field_name", "instant_us").distinct()
