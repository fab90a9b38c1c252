"""Readers for JSON, JSON lines, CSV lists and rule files; broken records become columns or errors as asked."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a fixed schema.  Blank lines are skipped; a broken line fails the job when
    ``strict``, else it is a row of nulls with the line in _corrupt."""
    wanted = T.StructType.fromDDL(schema)
    if strict:
        return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
    return spark.read.schema(wanted.add("_corrupt", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per file, or an array of objects per file; other top-level values fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL by name, each row with the source_type of its frame; columns that one lacks are null."""
    out = None
    for kind, frame in frames.items():
        tagged = frame.withColumn("source_type", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


# Each valid pair is matched first and kept by its group; a backslash that is left over starts none.
_PAIRS = r'(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|\\'


def repaired_json(text: Column | str) -> Column:
    """``text`` with every backslash doubled that starts no valid JSON escape, left to right."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(text, _PAIRS, "$1\u0001")
    # A mark after a valid pair is dropped, one that stands alone was such a backslash.
    return F.replace(F.regexp_replace(marked, "(\\\\(?:[\"\\\\/bfnrt]|u[0-9a-fA-F]{4}))\u0001", "$1"), F.lit("\u0001"), F.lit("\\\\"))


def readable_json(text: Column | str) -> Column:
    """``text`` where it is JSON, else its repaired form where that is, else null."""
    text = F.col(text) if isinstance(text, str) else text
    fixed = repaired_json(text)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.contains(text, F.lit("\\")) & F.try_parse_json(fixed).isNotNull(), fixed)


def versioned_else_canonical(versioned: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """All versioned rows, and canonical rows only of keys without any."""
    return versioned.unionByName(canonical.join(versioned.select(key).distinct(), key, "left_anti"))


def read_rules(path: str) -> list[dict]:
    """A small list of objects from a JSON file, or YAML where a parser is installed; nothing counts as an empty list."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML parser; JSON files need none") from e
        value = yaml.safe_load(text)
    else:
        value = json.loads(text or "null")
    value = [] if value is None else value
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ValueError(f"not a list of objects: {path}")
    return value


def active_objects(bundles: DataFrame, kind: str, source: str) -> DataFrame:
    """id and name of the objects of a kind in bundles (objects ARRAY<STRUCT<type, name, revoked, deprecated,
    external_references ARRAY<STRUCT<source_name, external_id>>>>), without revoked and deprecated ones; the last wins."""
    o = bundles.select(F.posexplode("objects").alias("_n", "_o")).select("_n", "_o.*")
    o = o.where((F.col("type") == kind) & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))
    ids = F.get(F.filter("external_references", lambda r: (r["source_name"] == source) & r["external_id"].isNotNull()), F.lit(0))["external_id"]
    return o.withColumn("id", ids).where("id is not null").groupBy("id").agg(F.max_by("name", "_n").alias("name"))
