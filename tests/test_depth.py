"""Nested records of any depth."""

import json

import pytest

from lakewarden.operators import nested


def test_any_depth():
    text = '[{"a":' * 1500 + "1" + "}]" * 1500
    assert sum(1 for _ in nested.walk(nested.parse(text), "r", frozenset(), structure_only=True)) == 1500


def test_beyond_the_parsers_recursion():
    value, levels = nested.parse('[{"a":' * 100_000 + "1" + "}]" * 100_000), 0
    while isinstance(value, (dict, list)):
        value, levels = (value["a"] if isinstance(value, dict) else value[0]), levels + 1
    assert (value, levels) == (1, 200_000)


def test_deep_parser_reads_what_json_does():
    for t in ('{"a": [1, -2.5e3, "x\\n\\u00e9", null, true, {}, [], [[]]], "a": {"b": [{"c": NaN}]}, "d": 2}', " [ ] ", "3", '"s"', '{"a":1,"a":2}', '[{"a":{"b":1},"c":[2,{}]},3]'):
        assert repr(nested.parse_deep(t)) == repr(json.loads(t))
    for t in ("", "[1,]", "[1", "{,}", '{"a"}', '{"a":}', "{1:2}", "[1] 2", "]", '["\n"]', "[1}", '{"a":1]', '{"a":1,}'):
        for read in (json.loads, nested.parse_deep):
            with pytest.raises(ValueError):
                read(t)
