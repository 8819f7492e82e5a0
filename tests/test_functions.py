import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import jsonx as J
from tessera.functions.schema import SchemaError, UnresolvableRef, Validator, outcome


@pytest.mark.parametrize("text,want", [("a</think> b</think>c ", "b</think>c"), (" plain ", "plain"), ("", ""), (None, None)])
def test_strip_think(text, want):
    assert J.strip_think(text) == want


@pytest.mark.parametrize(
    "mode,text,want",
    [
        ("chunk", 'x [1] {"a":[2]} ', '{"a": [2]}'), ("chunk", '```json\n{bad}\n``` {"a":1}', None), ("chunk", "none", None),
        ("completion", '[{"a":1}]', '{"a": 1}'), ("completion", '[{"a":1},{"b":2}]', '[{"a": 1}, {"b": 2}]'), ("completion", "nope", None), ("completion", " 12 ", "12"),
        ("output", "</think>[1,2]", None), ("output", 'x</think>so {"a":1}.', '{"a": 1}'), ("output", '```json\n[1]\n```', "[1]"),
        ("strict", '```json\n{"a":1}\n```', '{"a": 1}'), ("strict", 'so {"a":1}', None),
    ],
)
def test_extract(mode, text, want):
    assert J.extract(text, mode) == want


def test_calls_and_sections():
    assert J.function_call("123") == "123"
    assert J.function_call('<functioncall> {"a":1} x') == '{"a":1}'
    assert J.function_call('<functioncall> {"a":1} FUNCTION RESPONSE: {"b":2}') is None
    one = '<tool_call>{"é":1}</tool_call>'
    assert J.tool_call(one) == '{"é": 1}' and J.tool_call(one + one) is None
    assert J.sections('=== json ===\r\n{"a":1}\n=== JSON_SCHEMA ===\n{"type":"object"}') == ('{"a": 1}', '{"type": "object"}', None)
    assert J.sections("=== JSON ===\n{}\n=== JSON_SCHEMA ===\n[]")[2] and J.sections("{}")[2]
    assert J.prompt_schema('x\n=== json schema ===\n{"type":"object"}') == '{"type":"object"}'
    assert J.prompt_schema("=== JSON Schema === a === JSON Schema ===\n{}") is None


def test_leaves_and_metrics():
    assert J.leaves(json.loads('{"b":[1,{"c":null}],"a":{},"z":{"q":true}}')) == {"b[0]": 1, "b[1].c": None, "z.q": True}
    assert J.leaves(5) == {"": 5}
    assert J.evaluate("null", "{}", "{}") == (True, False, False, 1.0, 0.0)
    assert J.evaluate('{"a":1}', '{"a":1}', "{}") == (False, True, False, 1.0, 1.0)
    assert J.evaluate('{"a":true}', '{"a":1.0}', '{"type":"object"}') == (False, True, True, 0.0, 1.0)
    assert J.value_match({"b": 1}, {"a": None, "b": 1}) == 1.0 and J.value_match({"b": 1}, {"a": None, "b": 1}, strict=True) == 0.5
    assert J.value_match([], {}) == 1.0
    schema = {"properties": {"a": {}, "items": {"type": "array", "items": {"properties": {"x": {}}}}}, "required": ["a"]}
    assert J.noise_ratio({"items": [{"x": 1}], "q": 2}, schema) == pytest.approx(2 / 3)
    assert J.noise_ratio([1], {"type": "object"}) == 1.0 and J.noise_ratio({}, {}) == 0.0
    assert J.reward('[{"a":1}]', '{"type":"array"}') == 0.3 and J.reward("nope", "{}") == 0.0 and J.reward("{}", "{bad") == 0.3 and J.reward("{}", "{}") == 1.0


@pytest.mark.parametrize(
    "schema,want",
    [
        ({"type": "integer", "exclusiveMinimum": 3}, "4"), ({"type": "integer", "minimum": 5, "multipleOf": 4}, "8"), ({"type": ["null", "string"]}, '"a"'),
        ({"type": "object", "properties": {"z": {"type": "boolean"}, "a": {}}}, '{"z": true}'), ({"type": "array", "minItems": 2}, "[{}, {}]"),
        ({"type": "number", "exclusiveMinimum": 0}, None), ({"type": "string", "pattern": "^[0-9]+$"}, None), ({"enum": []}, None), (True, "{}"),
        ({"$defs": {"d": {"const": 7}}, "$ref": "#/$defs/d"}, "7"), ({"anyOf": [{"$ref": "#/x"}, {"type": "null"}], "x": {}}, "null"),
        ({"allOf": [{"type": "object", "required": ["a"]}, {"properties": {"a": {"type": "string", "minLength": 3}}}]}, '{"a": "aaa"}'),
        ({"type": "string", "format": "date", "minLength": 2}, '"2024-01-01"'), ({"type": "array", "prefixItems": [{"const": 1}], "items": False, "minItems": 1}, "[1]"),
    ],
)
def test_minimal(schema, want):
    assert J.minimal(json.dumps(schema)) == want


VALID = [
    ({"type": "integer"}, [1, 1.0], [True, 1.5, "1"]), ({"const": 1}, [1, 1.0], [True]), ({"enum": [[1], None]}, [[1.0], None], [[True], 0]),
    ({"minimum": 2, "exclusiveMaximum": 5}, [2, 4.9, "x"], [1, 5]), ({"multipleOf": 0.1}, [0.3, 1], [0.25]), ({"maxLength": 1}, ["é", "𝒳"], ["ab"]),
    ({"pattern": "b"}, ["abc", 5], ["ac"]), ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1], []], [[1], ["a", "b"]]),
    ({"contains": {"const": 1}, "maxContains": 1}, [[1, 2]], [[1, 1], []]), ({"uniqueItems": True}, [[1, True], [0, False]], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"properties": {"a": {"type": "null"}}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, [{"a": None, "x1": 2}], [{"b": 1}, {"x": "s"}]),
    ({"required": ["a"], "minProperties": 1}, [{"a": 1}, 5], [{}]), ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, {}], [{"a": 1}]), ({"dependentSchemas": {"a": {"required": ["c"]}}}, [{"b": 1}], [{"a": 1}]),
    ({"not": {"type": "string"}}, [1], ["a"]), ({"oneOf": [{"minimum": 2}, {"multipleOf": 2}]}, [3, 0], [4, 1]), ({"anyOf": [{"type": "null"}, {"minimum": 3}]}, [None, 4], [2]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 0}}, ["ab", 1], ["a", -1]),
    ({"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}, "additionalProperties": False}}, "$ref": "#/$defs/n"}, [{"next": {"next": {}}}], [{"next": {"x": 1}}]),
    ({"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"a": {"type": "string"}}, "properties": {"x": {"$ref": "#/definitions/a", "maxLength": 1}}}, [{"x": "long"}], [{"x": 1}]),
    ({"$schema": "http://json-schema.org/draft-04/schema#", "minimum": 1, "exclusiveMinimum": True}, [2], [1]),
    ({"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}], "additionalItems": False}, [["a"]], [["a", 1], [1]]),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}]), ({"anyOf": [{"prefixItems": [True]}], "unevaluatedItems": False}, [[1]], [[1, 2]]),
    ({"$id": "http://x/y", "$defs": {"q": {"$anchor": "here", "type": "integer"}}, "$ref": "#here"}, [1], ["a"]), (False, [], [1, None]), (True, [1], []),
]


@pytest.mark.parametrize("schema,good,bad", VALID)
def test_validator(schema, good, bad):
    v = Validator(schema)
    assert all(map(v.is_valid, good)) and not any(map(v.is_valid, bad))


@pytest.mark.parametrize("schema", [{"type": "strin"}, {"minLength": -1}, {"required": "a"}, {"properties": []}, {"pattern": "("}, [], {"allOf": []}, {"multipleOf": 0}])
def test_schema_errors(schema):
    with pytest.raises(SchemaError):
        Validator(schema)


def test_references_that_lead_nowhere():
    with pytest.raises(UnresolvableRef):
        Validator({"$ref": "#/nope"}).is_valid(1)
    assert outcome(1, '{"$ref":"#/nope"}') == (False, "unresolvable-ref: #/nope")
    assert not outcome(1, '{"$ref":"#"}')[0]


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(values)
def test_metric_properties(v):
    assert J.value_match(v, v) == 1.0
    assert J.evaluate(json.dumps(v), json.dumps(v), '{"minLength":0}')[1:4] == ((True, True, 0.0) if v is not None else (False, False, 1.0))


def random_schema(r, depth=0):
    kind = r.choice(["string", "integer", "number", "boolean", "null", "array", "object"] if depth < 3 else ["string", "integer"])
    s = {"type": kind}
    if kind == "integer" and r.random() < 0.5:
        s["minimum"] = r.randint(-5, 9)
    if kind == "array":
        s |= {"items": random_schema(r, depth + 1), "minItems": r.randint(0, 2)}
    if kind == "object":
        s["properties"] = {k: random_schema(r, depth + 1) for k in "abc"[: r.randint(0, 3)]}
        s["required"] = [k for k in s["properties"] if r.random() < 0.5]
    return s


def test_minimal_instances_are_valid():
    r = random.Random(4)
    for _ in range(300):
        s = random_schema(r)
        made = J.minimal(json.dumps(s))
        assert made is not None and Validator(s).is_valid(json.loads(made)), s
