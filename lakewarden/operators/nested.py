"""Deeply nested records to related flat tables.

Records stream through a parser one at a time, and each is walked once, giving path-value-ordinal
triples.  Every object that is an element of a list is a *node*, and so is every scalar in a
list; a triple belongs to its nearest node, and nodes whose paths are alike but for the places in
lists (same repeated ancestor) form a *group*.  All triples of a record come from one place, so
they are grouped by node where they are made, without a shuffle.  Each group pivots into one flat
table whose rows keep the path of their parent, so tables join by
(owner_id, parent_path) = (owner_id, node_path).

Parsing has no counterpart among the built-in functions (depth, names and types are
open, and text in text is to be entered), so it runs in Arrow batches in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields in which a lone object is a list of one.
LONE = ("processes", "children", "alerts", "evidence", "connections", "hops", "attachments", "related", "modules")

TRIPLE_SCHEMA = "owner_id bigint, group_path string, node_path string, parent_path string, field string, value string, ordinal int"
ROW_SCHEMA = "owner_id bigint, group_path string, node_path string, parent_path string, is_object boolean, fields map<string,string>"

#: Tables and their columns that tables() makes at most: their names are held on the driver.
NAMES = 10_000

_BLANK = re.compile(r"[ \t\n\r]*")
# Numbers stay as they are written.
_DECODER = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=str)
_SCALAR = json.JSONDecoder().scan_once
_PAIR = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\')


def repair_backslashes(text: str) -> str:
    """Doubles each backslash that starts no valid JSON escape, from left to right; valid pairs stay."""
    return _PAIR.sub(lambda m: m[0] if len(m[0]) > 1 else "\\\\", text)


def parse_deep(text: str) -> object:
    """json.loads for any depth: containers wait on a list instead of the call stack."""

    def skip(at: int) -> int:
        return _BLANK.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("no name")
        name, at = _SCALAR(text, at)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        return name, skip(at + 1)

    # Containers that are open, and the name (None in a list) under which each lies in the one before it.
    opened: list[tuple[dict | list, str | None]] = []
    name, at = None, skip(0)
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            value: object = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                opened.append((value, name))
                name, at = key(at) if c == "{" else (None, at)
                continue
            at += 1
        else:
            try:
                value, at = _SCALAR(text, at)
            except StopIteration:
                raise ValueError("no value") from None
        while opened:
            into, outer = opened[-1]
            if isinstance(into, dict):
                into[name] = value
            else:
                into.append(value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                name, at = key(at) if isinstance(into, dict) else (None, at)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError("no end")
            opened.pop()
            value, name, at = into, outer, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("more than a value")
            return value


def _loads(text: str, numbers: bool = True) -> object:
    try:
        return json.loads(text) if numbers else _DECODER.decode(text)
    except RecursionError:
        return parse_deep(text)


def parse(text: str, numbers: bool = True) -> object:
    """The JSON value of ``text``, if need be after the backslash repair; None where it can't be read.

    Without ``numbers``, these stay as they are written, as text.
    """
    try:
        return _loads(text, numbers)
    except ValueError:
        pass
    try:
        return _loads(repair_backslashes(text), numbers) if "\\" in text else None
    except ValueError:
        return None


def walk(value: object, root: str, lone: frozenset[str], structure_only: bool = False) -> Iterator[tuple]:
    """The triples (group_path, node_path, parent_path, field, value, ordinal) of a parsed record.

    Each object in a list gives one triple with a null field, which marks that it is there even when
    it is empty.  A scalar's field is its path below its node ("" for a record that is a scalar); a
    scalar in a list is a node of its own with the field "value".  ordinal counts the triples of a
    node.  With ``structure_only``, only the marks are given.
    """
    counts: dict[str, int] = {}
    # What is left to do, in reverse order: value, its path, its group path, is it in a list, the nearest node, its group, the field below it.
    todo: list[tuple] = [(value, root, root, False, "", root, "")]
    while todo:
        v, path, group, listed, node, node_group, field = todo.pop()
        if isinstance(v, str):
            head = v.lstrip()[:1]
            if head and head in "{[":
                inner = parse(v, numbers=False)
                if isinstance(inner, (dict, list)):
                    v = inner
        if isinstance(v, dict):
            if listed:
                yield group, path, node, None, None, 0
                node, node_group, field = path, group, ""
            for k in reversed(v):
                x, p, g, f = v[k], f"{path}.{k}", f"{group}.{k}", f"{field}.{k}" if field else k
                if k in lone and not isinstance(x, list):
                    y = x
                    if isinstance(y, str) and y.lstrip()[:1] in ("{", "["):
                        y = parse(y, numbers=False)
                    if isinstance(y, dict):
                        todo.append((y, p + "[0]", g + "[]", True, node, node_group, f + "[0]"))
                        continue
                todo.append((x, p, g, False, node, node_group, f))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                todo.append((v[i], f"{path}[{i}]", f"{group}[]", True, node, node_group, f"{field}[{i}]"))
        elif not structure_only:
            text = v if isinstance(v, str) or v is None else json.dumps(v)
            if listed:
                yield group, path, node, "value", text, 0
            else:
                n = counts[node] = counts.get(node, -1) + 1
                yield node_group, node, None, field, text, n


def candidates(lone: Iterable[str] = LONE) -> str:
    """A pattern that every text matches from which a node can come: a list, a lone element's name, or an escape that could hide either.

    In text in text, backslashes stand before the closing quote.
    """
    return r'[\[]|\\u|"(' + "|".join(lone) + r')\\*"'


def _records(df: DataFrame, owner: str, texts: list[str]) -> DataFrame:
    """owner_id and the JSON texts; rows without any are left out."""
    asked = df.select(F.col(owner).cast("bigint").alias("owner_id"), *[F.col(t).cast("string").alias(f"_{i}") for i, t in enumerate(texts)])
    return asked.where(F.coalesce(*[F.col(f"_{i}") for i in range(len(texts))]).isNotNull())


def _stream(batches: Iterator[pa.RecordBatch], texts: list[str], lone: frozenset[str]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Record by record: its owner and its triples."""
    for batch in batches:
        owners = batch.column(0).to_pylist()
        for i, name in enumerate(texts):
            for owner_id, text in zip(owners, batch.column(i + 1).to_pylist(), strict=True):
                value = parse(text, numbers=False) if text is not None else None
                if value is not None:
                    yield owner_id, list(walk(value, name, lone))


def triples(df: DataFrame, owner: str, texts: list[str], lone: Iterable[str] = LONE) -> DataFrame:
    """The path-value-ordinal triples of the JSON texts in the columns ``texts``.

    Columns: owner_id, group_path, node_path, parent_path, field, value, ordinal.  The node of
    what lies outside of all lists is the record itself, with an empty node_path.  Null, empty
    and unreadable texts give no rows; a null owner is kept.  Numbers are given as they are
    written.  ``df`` must be free of copies.
    """
    names, lone_set = list(texts), frozenset(lone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for owner_id, found in _stream(batches, names, lone_set):
            out += [(owner_id, *t) for t in found]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["owner_id", "group_path", "node_path", "parent_path", "field", "value", "ordinal"])

    return _records(df, owner, names).mapInArrow(run, TRIPLE_SCHEMA)


def node_rows(df: DataFrame, owner: str, texts: list[str], lone: Iterable[str] = LONE) -> DataFrame:
    """The triples grouped by node: one row per node, and one per record for what lies outside of all lists.

    Columns: owner_id, group_path, node_path ("" for the record), parent_path ("" where the parent is
    the record), is_object (false for a scalar in a list), fields (MAP of names to values as text).
    A name that an object has twice has its last value.  Edge cases are those of triples().
    """
    names, lone_set = list(texts), frozenset(lone)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        maps: list[dict[str, str | None]] = []
        for owner_id, found in _stream(batches, names, lone_set):
            at: dict[str, dict] = {}
            for group, node, parent, field, value, _ in found:
                fields = at.get(node)
                if fields is None:
                    fields = at[node] = {}
                    rows.append((owner_id, group, node, parent or "", field is None or parent is None))
                    maps.append(fields)
                if field is not None:
                    fields[field] = value
            if len(rows) > 10_000:
                yield _batch(rows, maps)
                rows, maps = [], []
        yield _batch(rows, maps)

    def _batch(rows: list[tuple], maps: list[dict]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        ends, n = [0], 0
        for m in maps:
            n += len(m)
            ends.append(n)
        fields = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for m in maps for k in m], pa.string()), pa.array([v for m in maps for v in m.values()], pa.string()))
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields], ["owner_id", "group_path", "node_path", "parent_path", "is_object", "fields"])

    return _records(df, owner, names).mapInArrow(run, ROW_SCHEMA)


def objects(rows: DataFrame) -> DataFrame:
    """Of node_rows(), the objects that are elements of lists."""
    return rows.where(F.col("is_object") & (F.col("node_path") != ""))


def nodes(df: DataFrame, owner: str, texts: list[str], lone: Iterable[str] = LONE) -> DataFrame:
    """owner_id, group_path, node_path, parent_path of every object that is an element of a list."""
    return objects(node_rows(df, owner, texts, lone)).select("owner_id", "group_path", "node_path", "parent_path")


def pivot(rows: DataFrame, group_path: str, fields: list[str]) -> DataFrame:
    """One group of node_rows() as a flat table: owner_id, node_path, parent_path and a STRING column per field.

    A field that a node lacks, or that is null there, is null.  Fields with the name of a leading
    column get an underscore in front.  Nothing is shuffled.
    """
    lead = ("owner_id", "node_path", "parent_path")
    return rows.where(F.col("group_path") == group_path).select(*lead, *[F.try_element_at("fields", F.lit(f)).alias("_" + f if f in lead else f) for f in fields])


def tables(rows: DataFrame, most: int = NAMES) -> dict[str, DataFrame]:
    """Every group of node_rows() as a flat table, by group path.

    The names of groups and fields are a schema, not data: more than ``most`` of them are refused.
    ``rows`` is read once for the names and once per table that is used, so keep it written.
    """
    names = rows.select("group_path", F.explode_outer(F.map_keys("fields")).alias("field")).distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"more than {most} columns in all tables")
    found: dict[str, list[str]] = {}
    for r in sorted(names, key=lambda r: (r.group_path, r.field or "")):
        found.setdefault(r.group_path, []).extend([r.field] if r.field is not None else [])
    return {group: pivot(rows, group, fields) for group, fields in found.items()}


def groups(found: DataFrame) -> DataFrame:
    """The groups and fields that triples() found: group_path, field, how many nodes have it."""
    return found.where(F.col("field").isNotNull()).groupBy("group_path", "field").agg(F.count(F.lit(1)).alias("n"))


def flat_table(found: DataFrame, group_path: str, fields: list[str]) -> DataFrame:
    """The nodes of one group as a table: owner_id, node_path, parent_path and a STRING column per field.

    A field that a node lacks, or that is null there, is null.  Field names may clash with the
    three leading columns; they are then prefixed with an underscore.
    """
    lead = ("owner_id", "node_path", "parent_path")
    own = found.where(F.col("group_path") == group_path)
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias("_" + f if f in lead else f) for f in fields]
    return own.groupBy("owner_id", "node_path").agg(F.max("parent_path").alias("parent_path"), *columns)
