"""References, mutators, sources, streams, bundles and the other parts of the interface."""

import io
import json

import pytest
from pyspark.sql import functions as F

from skein.functions import formats, patterns
from skein.operators import validator
from skein.operators.validator import Facade, Validator, batch_valid, bundle, load_bundle, validate, version
from skein.plans.schema import SchemaError, evaluated, fingerprint, normalise_draft7
from skein.sources import harness
from skein.sources.ndjson import lines_of, read_ndjson
from skein.streaming.route import route

TREE = {"type": "object", "properties": {"n": {"type": "integer"}, "kids": {"items": {"$ref": "#"}}}, "required": ["n"]}


def test_recursion_runs_on_the_interpreter(spark):
    v = Validator(TREE)
    assert not v.as_columns
    df = spark.createDataFrame([('{"n":1,"kids":[{"n":2,"kids":[{"n":3}]}]}',), ('{"n":1,"kids":[{"n":2,"kids":[{"n":"3"}]}]}',)], "value string")
    assert [r[0] for r in df.select(v.is_valid("value")).collect()] == [True, False]


def test_references():
    a = {"$id": "https://x.org/a", "properties": {"b": {"$ref": "b"}}}
    b = {"$id": "https://x.org/b", "properties": {"c": {"$ref": "c#/$defs/n"}}}
    c = {"$id": "https://x.org/c", "$defs": {"n": {"minimum": 3}}}
    v = Validator({"$ref": "https://x.org/a"}, [a, b, c])
    assert v.accepts({"b": {"c": 3}})
    assert not v.accepts({"b": {"c": 2}})
    v = Validator({"$defs": {"a/b": {"type": "string"}, "c%d": {"type": "null"}}, "properties": {"x": {"$ref": "#/$defs/a~1b"}, "y": {"$ref": "#/$defs/c%25d"}}})
    assert v.accepts({"x": "", "y": None})
    assert not v.accepts({"x": 1})
    assert not v.accepts({"y": 1})
    cycle = Validator({"$ref": "https://x.org/p"}, {"https://x.org/p": {"properties": {"q": {"$ref": "https://x.org/q"}}}, "https://x.org/q": {"properties": {"p": {"$ref": "https://x.org/p"}, "n": {"type": "integer"}}}})
    assert not cycle.accepts({"q": {"p": {"q": {"n": "x"}}}})


@pytest.mark.parametrize("schema", [{"$ref": "#/$defs/none"}, {"type": "strin"}, {"pattern": "("}, {"$dynamicRef": "#a"}, "{broken"])
def test_bad_schemas_raise(schema):
    with pytest.raises(SchemaError):
        Validator(schema).accepts(1)


def test_registry_contract():
    v = Validator({"$ref": "urn:n"})
    with pytest.raises(SchemaError):
        v.add_schema({"type": "number"})
    v.add_schema({"$id": "urn:n", "type": "number"})
    assert v.accepts(1)
    with pytest.raises(SchemaError):
        v.add_schema({"$id": "urn:m"})
    assert fingerprint({}, {"a": 1}) != fingerprint({}, {"a": 2})


def test_draft7():
    old = {"definitions": {"a": {"items": [{"type": "string"}], "additionalItems": False}}, "dependencies": {"x": ["y"], "z": {"required": ["w"]}}}
    new = normalise_draft7(old)
    assert new == {"$defs": {"a": {"prefixItems": [{"type": "string"}], "items": False}}, "dependentRequired": {"x": ["y"]}, "dependentSchemas": {"z": {"required": ["w"]}}}
    assert "definitions" in old
    v = Validator({"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"n": {"type": "null"}}, "items": [{"$ref": "#/definitions/n"}], "additionalItems": False})
    assert v.accepts([None])
    assert not v.accepts([None, 1])


def test_transform():
    v = Validator({"properties": {"role": {"default": "user"}, "age": {"type": "integer"}, "ok": {"type": "boolean"}, "s": {"type": "string"}, "in": {"properties": {"d": {"default": [1]}}, "additionalProperties": False}}, "additionalProperties": False}, coerce_types=True, remove_additional=True)
    given = {"age": "25", "ok": "1", "s": 1.0, "extra": 1, "in": {"e": 2}}
    assert v.transform(given) == {"age": 25, "ok": True, "s": "1", "in": {"d": [1]}, "role": "user"}
    assert given["age"] == "25"
    assert v.transform([1]) == [1]
    n = Validator({"properties": {"a": {"type": "number"}, "b": {"type": "integer"}}}, coerce_types=True)
    assert n.transform({"a": "0x1F", "b": "2.5"}) == {"a": 31, "b": "2.5"}
    assert n.transform({"a": "12d", "b": ""}) == {"a": "12d", "b": ""}
    assert n.transform({"a": True, "b": " 7 "}) == {"a": 1, "b": 7}


def test_evaluated_sets():
    node = Validator({"properties": {"a": {}}, "allOf": [{"properties": {"b": {}}, "prefixItems": [{}]}], "anyOf": [{}]}).node
    assert evaluated(node) == {"props": ["a", "b"], "items": 1, "allProps": False, "allItems": False, "dynamic": True}


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ({"properties": {"kind": {}}, "if": {"properties": {"kind": {"const": "p"}}}, "then": {"properties": {"name": {}}}, "else": {"properties": {"title": {}}}, "unevaluatedProperties": False}, {"kind": "p", "name": 1}, {"kind": "p", "title": 1}),
    ({"allOf": [{"prefixItems": [True, True]}], "unevaluatedItems": False}, [1, 2], [1, 2, 3]),
    ({"properties": {"e": {}}, "dependentSchemas": {"e": {"properties": {"f": {}}}}, "unevaluatedProperties": False}, {"e": 1, "f": 2}, {"f": 2}),
    ({"unevaluatedProperties": {"type": "string"}}, {"a": "x"}, {"a": 1}),
])
def test_unevaluated(schema, good, bad):
    assert Validator(schema).accepts(good)
    assert not Validator(schema).accepts(bad)


def test_equality_of_values():
    v = Validator({"enum": [{"a": 1, "b": [2]}]})
    assert v.accepts({"b": [2.0], "a": 1.0})
    assert not Validator({"const": 1}).accepts(True)
    assert not Validator({"const": 0}).accepts(False)
    assert Validator({"uniqueItems": True}).accepts([["a,string:b"], ["a", "b"]])
    assert not Validator({"uniqueItems": True}).accepts([{"a": 1, "b": 2}, {"b": 2, "a": 1}])
    assert Validator({"multipleOf": 0.01}).accepts(-0.07)


def test_buffers_and_lines(spark, tmp_path):
    v = Validator({"type": "object", "required": ["berth"]})
    buffer = b'{"berth":"A"}\n{"berth":0}\n\n{"quay":[]}\n'
    assert v.accepts_lines(buffer) == [True, True, False]
    assert v.accepts_lines("") == []
    assert batch_valid({"type": "number"}, ["1", "x", b"3"]) == 2
    df = spark.createDataFrame([(bytearray(buffer),)], "b binary")
    assert [tuple(r) for r in lines_of(df, "b").select("line_no", v.is_valid("value")).collect()] == [(0, True), (1, True), (2, False)]
    assert df.select(v.is_valid_prefix("b", 13)).collect()[0][0]
    (tmp_path / "x.ndjson").write_bytes(buffer)
    lines = read_ndjson(spark, str(tmp_path), numbered=True)
    assert tuple(v.count_valid(lines).collect()[0]) == (2, 3)
    good, bad = v.split_valid(lines)
    assert (good.count(), [r.errors[0].keyword for r in bad.collect()]) == (2, ["required"])


def test_large_numbers_in_both_engines(spark):
    """Integers of 64 bits are exact, whatever the engine; others are doubles."""
    edge = [2**53 - 1, 2**53, 2**53 + 1, 2**53 + 2, -(2**53) - 1, 2**63 - 1, 2**63 - 512, 2**63, -(2**63), -(2**63) - 1, 10**19, 10**25, 2**56 + 1]
    texts = [*map(str, edge), "9007199254740992.0", "9007199254740993.0", "9.007199254740992e15", "1e19", "9223372036854775807.0", "1e25", "0.1", "-0", "0", "1e400", "9" * 400]
    docs = [*texts, *(f"[{a},{b}]" for a in texts for b in texts)]
    made = [{w: n} for n in [*edge, 9007199254740992.0, 2.0**63, 1e19] for w in ("const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")]
    made += [{"enum": edge[:5]}, {"type": "integer"}, {"uniqueItems": True, "items": {"type": ["integer", "number"]}}]
    df = spark.createDataFrame([(t,) for t in docs], "value string").coalesce(2)
    checks = [Validator(s) for s in made]
    assert all(v.as_columns for v in checks)
    for part in (checks[:35], checks[35:]):
        got = df.select([v.is_valid("value").alias(f"c{i}") for i, v in enumerate(part)]).collect()
        for t, row in zip(docs, got, strict=True):
            assert list(row) == [v.accepts_json(t) for v in part], (t, [v.schema for v, x in zip(part, row, strict=True) if x != v.accepts_json(t)])


def test_harness():
    case = {"schema": {"type": "string"}, "tests": [{"instance": "a"}, {"instance": 1}]}
    lines = [{"cmd": "start", "version": 1}, {"cmd": "dialect", "dialect": "https://json-schema.org/draft/2020-12/schema"}, {"cmd": "run", "seq": 7, "case": case}, {"cmd": "run", "seq": 8, "case": {"schema": {"$ref": "urn:x"}, "registry": {"urn:x": {"maximum": 2}}, "tests": [{"instance": 3}]}}, {"cmd": "run", "seq": 9, "case": {"schema": {"type": "strin"}, "tests": []}}, {"cmd": "stop"}, {"cmd": "run"}]
    out = io.StringIO()
    harness.serve(io.StringIO("\n\n".join(map(json.dumps, lines))), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert said[0]["version"] == 1 and said[1] == {"ok": True} and len(said) == 5
    assert said[2] == {"seq": 7, "results": [{"valid": True}, {"valid": False}]}
    assert said[3] == {"seq": 8, "results": [{"valid": False}]}
    assert (said[4]["seq"], said[4]["errored"]) == (9, True)


def test_safe_patterns():
    bad = {"properties": {"a": {"pattern": "^(x+)+$"}}}
    assert Validator(bad).accepts({"a": "xx"})
    with pytest.raises(SchemaError):
        Validator(bad, safe_patterns=True).accepts({})
    with pytest.raises(SchemaError):
        Validator({"patternProperties": {"(a*)*": {}}}, safe_patterns=True).accepts({})
    assert Validator({"pattern": "^(ab|c)+$"}, safe_patterns=True).accepts("abc")


def test_compiled_schemas_are_bounded(monkeypatch):
    monkeypatch.setattr(validator, "MOST_COMPILED", 3)
    for i in range(10):
        Validator({"minimum": i}).accepts(1)
    assert len(validator._COMPILED) == 3


def test_equal_checks_have_equal_plans(spark):
    df = spark.createDataFrame([("1",)], "value string")
    plans = {df.select(Validator({"minimum": 1}).is_valid("value").alias("ok"))._jdf.queryExecution().analyzed().canonicalized().toString() for _ in range(2)}
    assert len(plans) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"k":1}\n{"k":"x"}\n\nnope\n')
    v = Validator({"properties": {"k": {"type": "integer"}}})
    q = route(spark.readStream.text(str(tmp_path / "in")).where(F.length("value") > 0), v, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.value for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ['{"k":1}']
    assert sorted(r.errors[0].keyword for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["syntax", "type"]


def test_typed_rows_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (2, None, 9.0), (3, "zz", None), (4, "a", float("nan"))], "id long, s string, x double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    v = Validator({"properties": {"s": {"type": "string", "maxLength": 1}, "x": {"type": "number", "maximum": 5}}, "required": ["id"]})
    assert sorted(r.id for r in df.where(v.row_valid(df)).collect()) == [1]
    nested = Validator({"anyOf": [{"required": ["s"]}, {"properties": {"x": {"maximum": 5}}}]})
    assert sorted(r.id for r in df.where(nested.row_valid(df)).collect()) == [1, 3, 4]
    low = Validator({"properties": {"id": {"type": "integer", "minimum": 3}}, "required": ["id"]})
    plan = df.where(low.row_valid(df))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,3)" in plan


def test_persistence_and_facade(spark):
    v = Validator({"type": "number"}, coerce_types=True)
    w = Validator({"type": "string"})
    text = bundle([v, w, Validator({"type": "number"}, coerce_types=True)])
    assert len(json.loads(text)["specs"]) == 2
    made = load_bundle(text)
    assert [m.accepts(1) for m in made] == [True, False, True]
    assert Validator.from_spec(json.dumps(v.spec())).coerce_types
    f = Facade().add_schema({"$id": "urn:a", "minimum": 3})
    run = f.compile({"$ref": "urn:a"})
    assert not run(1)
    assert run.errors[0]["keyword"] == "minimum"
    assert f.validate("urn:a", 4) and f.errors is None
    assert validate({"type": "number"}, "{oops")["errors"][0]["keyword"] == "syntax"
    assert version()
    df = spark.createDataFrame([("1",), ('"x"',)], "value string")
    rows = df.select(v.standard("value").alias("s")).select(F.to_json("s.value"), F.size("s.issues")).collect()
    assert [tuple(r) for r in rows] == [("1", None), (None, 1)] or [tuple(r) for r in rows] == [("1", -1), (None, 1)]


def test_patterns_and_formats():
    assert not patterns.compiled("^a$").search("a\n")
    assert patterns.compiled("[[]").search("[")
    assert patterns.compiled("\\s").search("\u2003")
    assert patterns.nested_quantifier("^(a+)+$")
    assert not patterns.nested_quantifier("^[a+]+(b|c)*$")
    good = {"email": "a@b.c", "date": "2020-99-99", "uuid": "123E4567-e89b-12d3-a456-426614174000", "date-time": "2020-01-01T00:00:00.1Z", "time": "23:59:59", "duration": "P1DT2H", "uri": "a:", "uri-reference": "a/b", "ipv4": "255.0.0.1", "ipv6": "::1", "hostname": "a-b.c", "other": ""}
    bad = {"email": "a@.b", "date": "2020-1-1", "uuid": "x", "date-time": "2020-01-01 00:00:00Z", "time": "24:00:00", "duration": "P", "uri": "1:", "uri-reference": "", "ipv4": "256.0.0.1", "ipv6": "1", "hostname": "-a"}
    assert all(formats.matches(k, v) for k, v in good.items())
    assert not any(formats.matches(k, v) for k, v in bad.items())
