"""Error lists: the shape of each keyword's error, from one schema for sensor readings and the ways to break it."""

import json

import pytest

from skein.operators.validator import Validator

READING = {
    "type": "object",
    "required": ["sensor", "at"],
    "properties": {
        "sensor": {"type": "string", "minLength": 4, "maxLength": 8, "pattern": "^[A-Z]{2}-"},
        "at": {"format": "date-time"},
        "celsius": {"type": ["number", "null"], "minimum": -80, "exclusiveMaximum": 60.5},
        "watts": {"exclusiveMinimum": 0, "maximum": 3.2e3, "multipleOf": 25},
        "state": {"enum": ["idle", "busy", 0]},
        "unit": {"const": {"si": True}},
        "trace": {"minItems": 1, "maxItems": 4, "uniqueItems": True, "contains": {"type": "boolean"}, "minContains": 0, "maxContains": 1},
        "tags": {"minProperties": 1, "maxProperties": 2, "propertyNames": {"maxLength": 6}, "patternProperties": {"_at$": {"type": "integer"}}},
        "site": {"type": "object", "properties": {"lat": {}, "lon": {}}, "additionalProperties": False, "dependentRequired": {"lat": ["lon"]}},
        "gone": False,
    },
}
FINE = {"sensor": "TX-1", "at": "2031-05-06T07:08:09Z", "celsius": None, "watts": 75, "state": 0.0, "unit": {"si": True}, "trace": [1, True], "tags": {"b_at": 2}, "site": {"lon": 8}}

#: What is changed in FINE (None: taken away), and the errors: path, place in the schema, params, message.
BROKEN = [
    ({"sensor": ...}, [("required", "", "#/required", {"missingProperty": "sensor"}, "must have required property 'sensor'")]),
    ({"sensor": 17}, [("type", "/sensor", "#/properties/sensor/type", {"type": "string"}, "must be string")]),
    ({"sensor": "A"}, [("minLength", "/sensor", "#/properties/sensor/minLength", {"limit": 4}, "must NOT have fewer than 4 characters"), ("pattern", "/sensor", "#/properties/sensor/pattern", {"pattern": "^[A-Z]{2}-"}, 'must match pattern "^[A-Z]{2}-"')]),
    ({"sensor": "TX-ÄÖÜ😀😀😀"}, [("maxLength", "/sensor", "#/properties/sensor/maxLength", {"limit": 8}, "must NOT have more than 8 characters")]),
    ({"at": "yesterday"}, [("format", "/at", "#/properties/at/format", {"format": "date-time"}, 'must match format "date-time"')]),
    ({"celsius": "warm"}, [("type", "/celsius", "#/properties/celsius/type", {"type": "number, null"}, "must be number, null")]),
    ({"celsius": -80.5}, [("minimum", "/celsius", "#/properties/celsius/minimum", {"comparison": ">=", "limit": -80}, "must be >= -80")]),
    ({"celsius": 60.5}, [("exclusiveMaximum", "/celsius", "#/properties/celsius/exclusiveMaximum", {"comparison": "<", "limit": 60.5}, "must be < 60.5")]),
    ({"watts": 0}, [("exclusiveMinimum", "/watts", "#/properties/watts/exclusiveMinimum", {"comparison": ">", "limit": 0}, "must be > 0")]),
    ({"watts": 3210}, [("maximum", "/watts", "#/properties/watts/maximum", {"comparison": "<=", "limit": 3200.0}, "must be <= 3200"), ("multipleOf", "/watts", "#/properties/watts/multipleOf", {"multipleOf": 25}, "must be multiple of 25")]),
    ({"state": False}, [("enum", "/state", "#/properties/state/enum", {"allowedValues": ["idle", "busy", 0]}, "must be equal to one of the allowed values")]),
    ({"unit": {"si": 1}}, [("const", "/unit", "#/properties/unit/const", {"allowedValue": {"si": True}}, "must be equal to constant")]),
    ({"trace": []}, [("minItems", "/trace", "#/properties/trace/minItems", {"limit": 1}, "must NOT have fewer than 1 items")]),
    ({"trace": [0, 1, 2, 3, 4]}, [("maxItems", "/trace", "#/properties/trace/maxItems", {"limit": 4}, "must NOT have more than 4 items")]),
    ({"trace": ["p", {"q": 1}, 5, {"q": 1.0}]}, [("uniqueItems", "/trace", "#/properties/trace/uniqueItems", {"i": 1, "j": 3}, "must NOT have duplicate items (items ## 3 and 1 are identical)")]),
    ({"trace": [True, False]}, [("contains", "/trace", "#/properties/trace/contains", {"limit": 1}, "contains: need at most 1 match(es)")]),
    ({"tags": {}}, [("minProperties", "/tags", "#/properties/tags/minProperties", {"limit": 1}, "must NOT have fewer than 1 properties")]),
    ({"tags": {"x": 0, "y": 0, "z": 0}}, [("maxProperties", "/tags", "#/properties/tags/maxProperties", {"limit": 2}, "must NOT have more than 2 properties")]),
    ({"tags": {"seen_at": "now"}}, [("pattern", "/tags", "#/properties/tags/patternProperties", {"pattern": "_at$"}, "patternProperties: value invalid for key seen_at"), ("maxLength", "/tags", "#/properties/tags/propertyNames/maxLength", {"limit": 6}, "must NOT have more than 6 characters")]),
    ({"site": {"lat": 1, "alt": 2}}, [("additionalProperties", "/site", "#/properties/site/additionalProperties", {"additionalProperty": "alt"}, "must NOT have additional properties"), ("required", "/site", "#/properties/site/dependentRequired", {"missingProperty": "lon"}, "must have required property 'lon'")]),
    ({"gone": 1}, [("false schema", "/gone", "#/properties/gone", {}, "boolean schema is false")]),
]


def told(schema, value):
    return [(e["keyword"], e["instancePath"], e["schemaPath"], json.loads(e["params"]), e["message"]) for e in Validator(schema).check(value)["errors"]]


def test_nothing_to_tell():
    assert told(READING, FINE) == []


@pytest.mark.parametrize(("change", "errors"), BROKEN)
def test_one_change(change, errors):
    value = {k: v for k, v in {**FINE, **change}.items() if v is not ...}
    assert told(READING, value) == errors


def test_changes_add_up():
    """All changes to different properties at once, in the order of the schema's properties."""
    first = {k: (v, e) for change, e in BROKEN for k, v in change.items() if v is not ...}
    value = {**FINE, **{k: v for k, (v, _) in first.items()}}
    assert told(READING, value) == [x for k in READING["properties"] if k in first for x in first[k][1]]


@pytest.mark.parametrize(("word", "schema", "value", "message"), [
    ("anyOf", {"anyOf": [{"required": ["lat"]}, {"required": ["post"]}]}, {"lon": 3}, "must match a schema in anyOf"),
    ("oneOf", {"oneOf": [{"required": ["lat"]}, {"required": ["post"]}]}, {"lat": 1, "post": 2}, "must match exactly one schema in oneOf"),
    ("not", {"not": {"maxProperties": 1}}, {"lat": 1}, "must NOT be valid"),
])
def test_compositions_tell_no_branch(word, schema, value, message):
    assert told(schema, value) == [(word, "", f"#/{word}", {}, message)]


def test_all_branches_of_all_of_tell():
    found = told({"allOf": [{"minimum": 9}, {"multipleOf": 4}]}, 6)
    assert [(e[0], e[2]) for e in found] == [("minimum", "#/allOf/0/minimum"), ("multipleOf", "#/allOf/1/multipleOf")]


def test_conditions_tell_their_branch():
    schema = {"if": {"required": ["post"]}, "then": {"properties": {"post": {"minLength": 5}}}, "else": {"required": ["lat"]}}
    assert [e[:3] for e in told(schema, {"post": "80"})] == [("minLength", "/post", "#/then/properties/post/minLength")]
    assert [e[:3] for e in told(schema, {})] == [("required", "", "#/else/required")]


def test_lists_and_references():
    schema = {"$defs": {"site": READING["properties"]["site"]}, "prefixItems": [{"const": "v2"}], "items": {"$ref": "#/$defs/site"}}
    assert [e[:3] for e in told(schema, ["v3", {"lon": 1}, {"lat": 1}, 5])] == [
        ("required", "/2", "#/items/dependentRequired"),
        ("type", "/3", "#/items/type"),
        ("const", "/0", "#/prefixItems/0/const"),
    ]


def test_what_is_left_over():
    assert [e[0::3] for e in told({"properties": {"a": {}}, "unevaluatedProperties": {"type": "null"}}, {"a": 1, "b": None, "c": 2})] == [("unevaluatedProperties", {"unevaluatedProperty": "c"})]
    assert [e[0::3] for e in told({"prefixItems": [{}], "unevaluatedItems": False}, [1, 2, 3])] == [("unevaluatedItems", {"limit": 1})]


def test_a_wrong_type_hides_its_siblings():
    assert [e[0] for e in told({"type": "array", "enum": [[1]], "minItems": 3}, "ab")] == ["type"]
