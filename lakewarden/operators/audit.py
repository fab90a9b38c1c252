"""Data quality, privacy and provenance over whole tables; every check is a column or a row, never an exception."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.numbers import slot
from lakewarden.functions.text import EMAIL, HEX_HASH, IPV4, PHONE, POSIX_USER, WINDOWS_USER

#: Fields of a node that keep their order when they are numbered.
NODE_FIELDS = 1_000_000
LEVELS = ("low", "medium", "high", "critical")


def null_counts(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """rows and the nulls of each column, per key or in all."""
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]]
    return (df.groupBy(key) if key else df.groupBy()).agg(*counts)


def contiguous_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, rows, missing, valid: whether the order values of a key are exactly 1 to the number of rows."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(order).isNull()).alias("missing"), F.count_distinct(order).alias("_d"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    valid = (F.col("missing") == 0) & (F.col("_d") == F.col("rows")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("rows"))
    return out.select(key, "rows", "missing", F.coalesce(valid, F.lit(False)).alias("valid"))


def reject(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of the checks that a row fails (a null check counts as failed)."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])))


def incident_issues(meta: DataFrame, actions: DataFrame, events: DataFrame, start_us: str, end_us: str) -> DataFrame:
    """Per incident: how many events and actions it has, and what is wrong with it, as an array of names.

    Events and actions are counted before they are joined, so a busy incident is one row.
    """
    n_events = events.groupBy("incident_id").agg(F.count(F.lit(1)).alias("events"))
    n_actions = actions.groupBy("incident_id").agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("approval").isNull()).alias("no_approval"))
    out = meta.join(n_events, "incident_id", "left").join(n_actions, "incident_id", "left").fillna(0, ["events", "actions", "no_approval"])
    found = reject(
        out,
        {
            "no_events": F.col("events") > 0,
            "no_actions": F.col("actions") > 0,
            "approval_missing": F.col("no_approval") == 0,
            "bad_severity": F.col("severity").isin(*LEVELS),
            "window_reversed": F.coalesce(F.col(end_us) >= F.col(start_us), F.lit(True)),
            "no_window": F.col(start_us).isNotNull() & F.col(end_us).isNotNull(),
        },
    )
    return found.select("incident_id", "events", "actions", F.col("errors").alias("issues"))


# How masked mail addresses, IPv4 addresses and phone numbers look, {n} being a number from 1.
MASKED = {"email": r"^user_\d+@masked\.local$", "ipv4": r"^10\.255\.", "phone": r"^<phone_\d+>$"}


def word(term: str) -> str:
    """A pattern for a term as a whole word, without letter case."""
    return r"(?i)\b" + re.escape(term) + r"\b"


def personal_data(df: DataFrame, key: str, text: str, terms: list[str] = (), markers: list[str] = (), whole_words: bool = False) -> DataFrame:
    """key, line_no (from 1), kind, value: the first hit of each kind in every line of a text.

    Kinds: email, ipv4, phone, term and marker (of a local environment).  Hits that are masks already
    are left out, and so are later ones of that kind in the line; phone numbers within a
    checksum of a line that names one are none.  Terms count as parts of words too, unless
    ``whole_words``.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    hits = []
    for kind, pattern in (("email", EMAIL), ("ipv4", IPV4), ("phone", PHONE)):
        value = F.nullif(F.regexp_extract("_line", pattern, 0), F.lit(""))
        is_none = value.rlike(MASKED[kind])
        if kind == "phone":
            hashes = F.array_join(F.regexp_extract_all("_line", F.lit(HEX_HASH), F.lit(0)), " / ")
            is_none = is_none | (F.contains(F.lower("_line"), F.lit("sha256")) & F.contains(hashes, value))
        hits.append(F.when(~is_none, F.struct(F.lit(kind).alias("kind"), value.alias("value"))))
    for kind, names in (("term", terms), ("marker", markers)):
        for t in names:
            there = F.col("_line").rlike(word(t)) if whole_words else F.contains(F.lower("_line"), F.lit(t.lower()))
            hits.append(F.when(there, F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("value"))))
    return lines.select(key, (F.col("_at") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*hits))).alias("_h")).select(key, "line_no", "_h.kind", "_h.value")


#: Width of the stretches of order in which first appearances are numbered before they are added up.
SPAN = 100_000


def first_seen_tokens(df: DataFrame, key: str, order: str, value: str, tie: str | None = None, span: int = SPAN) -> DataFrame:
    """key, value, token: a number per key for every distinct value, in the order in which they first appear.

    ``order`` is a whole number, ``tie`` a second one.  Values are numbered within stretches of ``span``
    of the order, and the counts of the stretches before are added, so a key with any number of
    values is in no single task.  Null keys are one key.
    """
    own = F.struct(F.col(order).alias("o"), F.col(tie).alias("t")) if tie else F.struct(F.col(order).alias("o"))
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.min(own).alias("_first"))
    first = first.withColumn("_stretch", slot(F.col("_first.o").cast("bigint"), span))
    before = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy("_key", "_stretch").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_key").alias("_k"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = first.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_stretch").orderBy("_first", "_value")))
    met = numbered.join(counts, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_stretch").eqNullSafe(F.col("_s")))
    return met.select(F.col("_key").alias(key), F.col("_value").alias(value), (F.col("_rn") + F.col("_before")).cast("int").alias("token"))


def mask_numbered(df: DataFrame, row: str, key: str, order: str, text: str, pattern: str, prefix: str | Callable[[Column], Column], out: str) -> DataFrame:
    """Adds ``out``: ``text`` with every match of ``pattern`` replaced by the name that its value has within ``key``.

    Values are numbered per key in the order in which they first appear (by ``order``, then place in
    the text); the name is a prefix and the number, or what a function makes of the number.
    ``row`` identifies a row.  Matches are numbered and put back by joins on (key, value)
    and row, so no key's texts come to one task.  Rows without a key are keys of their own.
    """
    name = prefix if callable(prefix) else lambda n: F.concat(F.lit(prefix), n.cast("string"))
    own = F.when(F.col(key).isNull(), F.col(row))
    hits = df.select(F.col(row).alias("_row"), F.struct(F.col(key).alias("a"), own.alias("b")).alias("_key"), F.col(order).alias("_order"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("_pos", "_value"))
    numbers = first_seen_tokens(hits, "_key", "_order", "_value", "_pos").select(F.col("_key").alias("_k"), F.col("_value").alias("_v"), name(F.col("token")).alias("_name"))
    named = hits.join(numbers, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_value") == F.col("_v"))).select("_row", "_pos", "_name")
    per_row = named.groupBy(F.col("_row").alias("_mask_row")).agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_mask_names"))
    both = df.join(per_row, F.col(row) == F.col("_mask_row"), "left")
    names = F.coalesce("_mask_names", F.expr("cast(array() as array<struct<_pos:int,_name:string>>)"))
    pieces = F.zip_with(F.split(F.col(text), pattern, -1), names, lambda p, n: F.concat(p, F.coalesce(n["_name"], F.lit(""))))
    return both.select(*df.columns, F.array_join(pieces, "").alias(out))


def sanitize(df: DataFrame, row: str, key: str, order: str, text: str, terms: dict[str, str], out: str, domain: str = "masked.local") -> DataFrame:
    """Adds ``out``: ``text`` with terms replaced, then mail addresses, IPv4 addresses, phone numbers and users' folders masked.

    Names are numbered within ``key`` in the order of their first appearance: user_0001@domain,
    10.255.1.1 (250 to a block), <phone_0001>; folders become user_home.  Each step sees what the one
    before has left.  Null texts stay null.
    """
    value = F.col(text)
    for term, instead in terms.items():
        value = F.regexp_replace(value, word(term), instead)
    made = df.withColumn("_t0", value)
    steps = (
        (EMAIL, lambda n: F.format_string(f"user_%04d@{domain}", n)),
        (IPV4, lambda n: F.format_string("10.255.%d.%d", F.floor((n - 1) / 250) + 1, (n - 1) % 250 + 1)),
        (PHONE, lambda n: F.format_string("<phone_%04d>", n)),
    )
    for i, (pattern, name) in enumerate(steps):
        made = mask_numbered(made, row, key, order, f"_t{i}", pattern, name, f"_t{i + 1}").drop(f"_t{i}")
    last = F.col(f"_t{len(steps)}")
    last = F.regexp_replace(F.regexp_replace(last, WINDOWS_USER, "$1user_home"), POSIX_USER, "$1user_home")
    return made.withColumn(out, last).drop(f"_t{len(steps)}")


def sanitize_values(rows: DataFrame, row: str, key: str, order: str, terms: dict[str, str], domain: str = "masked.local") -> DataFrame:
    """node_rows() of nested records with every text in them sanitized, at any depth: the fields keep their names.

    Each value is a text of its own; ``row`` identifies a node, and its fields come in the order of their names.
    """
    each = rows.select(row, key, order, F.posexplode(F.array_sort(F.map_entries("fields"))).alias("_at", "_f")).select(row, key, order, "_at", F.col("_f.key").alias("_name"), F.col("_f.value").alias("_text"))
    each = each.withColumns({"_id": F.struct(row, "_at"), "_place": F.col(order) * F.lit(NODE_FIELDS) + F.col("_at")})
    clean = sanitize(each, "_id", key, "_place", "_text", terms, "_clean", domain)
    back = clean.groupBy(F.col(row).alias("_mask_row")).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_clean"))).alias("_mask_fields"))
    return rows.join(back, F.col(row) == F.col("_mask_row"), "left").withColumn("fields", F.coalesce("_mask_fields", "fields")).drop("_mask_row", "_mask_fields")


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, declared, actual, verdict of a manifest (path, sha256) against files (path, content): ok, changed, missing or undeclared.

    A path that the manifest has twice with different sums is changed in one of them.
    """
    made = files.select("path", F.sha2("content", 256).alias("actual"), F.lit(True).alias("_there"))
    met = manifest.select("path", F.lower("sha256").alias("declared"), F.lit(True).alias("_told")).join(made, "path", "full")
    verdict = F.when(F.col("_told").isNull(), "undeclared").when(F.col("_there").isNull(), "missing").when(F.col("declared").eqNullSafe(F.col("actual")), "ok").otherwise("changed")
    return met.select("path", "declared", "actual", verdict.alias("verdict"))


def action_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action_id").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("incident_id").alias("incidents"), F.count_if("approval").alias("approved"))


def provenance(catalog: DataFrame, stats: DataFrame, rules: DataFrame) -> DataFrame:
    """The catalog with how its actions are used and which rules name them (rule_id, action)."""
    named = rules.groupBy(F.col("action").alias("action_id")).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    out = catalog.select("action_id", "requires_approval").join(stats, "action_id", "left").join(named, "action_id", "left")
    return out.fillna(0, ["uses", "incidents", "approved"]).fillna("", ["rules"])
