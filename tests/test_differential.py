"""Compiled columns against the interpreter on random schemas and documents of all keywords."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators.validator import Validator
from skein.plans import compile as plan

FORMATS = ["email", "date", "uuid", "date-time", "time", "duration", "uri", "uri-reference", "ipv4", "ipv6", "hostname", "nonsense"]
STRINGS = ["", "a", "ab", "xyz", "x_1", "ß😀", "a\n", "a@b.c", "@b.c", "a@b", "a@.b", "a@@.c", "2020-01-31", "2020-13-01T00:00:00Z", "2020-02-30T10:00:00.5+01:00", "10:00:00", "24:00:00", "P1D", "P", "PT", "PT1.5S", "http://x", "x y", "1.2.3.4", "01.2.3.4", "::1", "1:2:3", "a-b.c", "-a", "123e4567-e89b-12d3-a456-426614174000", "p0", "p1"]
NUMBERS = ["0", "1", "-1", "2.5", "1.0", "1e2", "100", "0.3", "12345678901234567890123", "1e400", "-7", "49", "9007199254740991", "9007199254740992", "9007199254740993", "9007199254740993.0", "9223372036854775807", "9223372036854775808", "-9223372036854775809"]


def schema(rng, depth):
    if rng.random() < 0.08:
        return rng.random() < 0.7
    s = {}

    def sub():
        return schema(rng, depth - 1)

    def maybe(p, word, make):
        if rng.random() < p:
            s[word] = make()

    kinds = ["string", "number", "integer", "boolean", "null", "object", "array"]
    maybe(0.5, "type", lambda: rng.choice(kinds) if rng.random() < 0.7 else rng.sample(kinds, 2))
    maybe(0.1, "enum", lambda: rng.sample(["a", "x_1", 1, 2.5, None, True, 100, 2**53, 2**53 + 1, 2**63 - 1], 5))
    maybe(0.05, "const", lambda: rng.choice(["ab", 1, False, None, 2**53 + 1, 2**63]))
    for w in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
        maybe(0.1, w, lambda: rng.choice([0, 1, 2.5, 50, 2**53, 2**53 + 1, 2**63 - 1, 2**63]))
    maybe(0.1, "multipleOf", lambda: rng.choice([2, 0.1, 7]))
    maybe(0.1, "minLength", lambda: rng.randrange(4))
    maybe(0.1, "maxLength", lambda: rng.randrange(6))
    maybe(0.1, "pattern", lambda: rng.choice(["^a", "b$", "^[a-z_]+\\d?$", "\\s", "^x_", "[[&&]"]))
    maybe(0.15, "format", lambda: rng.choice(FORMATS))
    if depth > 0:
        maybe(0.35, "properties", lambda: {f"p{i}": sub() for i in range(rng.randrange(1, 4))})
        maybe(0.2, "required", lambda: [f"p{i}" for i in range(rng.randrange(1, 3))])
        maybe(0.15, "additionalProperties", lambda: False if rng.random() < 0.5 else sub())
        maybe(0.15, "patternProperties", lambda: {"^x_": sub(), "1$": sub()})
        maybe(0.1, "propertyNames", lambda: {"maxLength": 2} if rng.random() < 0.5 else {"not": {"pattern": "^x"}})
        maybe(0.1, "minProperties", lambda: rng.randrange(3))
        maybe(0.1, "maxProperties", lambda: rng.randrange(3))
        maybe(0.1, "dependentRequired", lambda: {"p0": ["p1"]})
        maybe(0.1, "dependentSchemas", lambda: {"p1": sub()})
        maybe(0.25, "items", sub)
        maybe(0.15, "prefixItems", lambda: [sub(), sub()])
        maybe(0.15, "contains", sub)
        if "contains" in s:
            maybe(0.4, "minContains", lambda: rng.randrange(3))
            maybe(0.4, "maxContains", lambda: rng.randrange(3))
        maybe(0.1, "minItems", lambda: rng.randrange(3))
        maybe(0.1, "maxItems", lambda: rng.randrange(4))
        if rng.random() < 0.08 and "prefixItems" not in s:
            s |= {"uniqueItems": True, "items": {"type": ["string", "number", "boolean", "null"]}}
        maybe(0.1, "allOf", lambda: [sub(), sub()])
        maybe(0.1, "anyOf", lambda: [sub(), sub()])
        maybe(0.1, "oneOf", lambda: [sub(), sub()])
        maybe(0.1, "not", sub)
        if rng.random() < 0.12:
            s |= {"if": sub(), "then": sub(), "else": sub()}
        maybe(0.12, "unevaluatedProperties", lambda: False if rng.random() < 0.7 else sub())
        maybe(0.12, "unevaluatedItems", lambda: False if rng.random() < 0.7 else sub())
        maybe(0.1, "$ref", lambda: "#/$defs/d")
    return s


def text(rng, depth):
    r = rng.random()
    if depth > 0 and r < 0.4:
        keys = rng.sample(["p0", "p1", "p2", "x_1", "q", ""], rng.randrange(5))
        return "{" + ",".join(f"{json.dumps(k)}:{text(rng, depth - 1)}" for k in keys) + "}"
    if depth > 0 and r < 0.65:
        return "[" + ",".join(text(rng, depth - 1) for _ in range(rng.randrange(5))) + "]"
    if r < 0.8:
        return rng.choice(NUMBERS)
    if r < 0.93:
        return json.dumps(rng.choice(STRINGS), ensure_ascii=False)
    return rng.choice(["null", "true", "false"])


BAD = ["", "{", "[1,]", "01", "NaN", "{'a':1}", '{"a":1}x', "1,2", "1] x", '{"a":1,"a":2}', "nul", '"a', None]


@pytest.mark.parametrize("seed", range(6))
def test_columns_agree_with_the_interpreter(spark, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame([(text(rng, 3),) for _ in range(250)] + [(b,) for b in BAD], "value string").coalesce(2)
    texts = [r.value for r in df.collect()]
    made = []
    while len(made) < 14:
        s = schema(rng, 2)
        s = {**s, "$defs": {"d": schema(rng, 0)}} if isinstance(s, dict) else s
        v = Validator(s)
        if plan.expressible(v.node):
            made.append(v)
    got = df.select([v.is_valid("value").alias(f"c{i}") for i, v in enumerate(made)]).collect()
    for t, row in zip(texts, got, strict=True):
        for i, v in enumerate(made):
            assert row[i] == (t is not None and v.accepts_json(t)), (v.schema, t)
    errors = df.select(made[0].result("value").alias("r")).collect()
    assert all(r.r.valid == (not r.r.errors) for r in errors)


def test_interpreter_engine_agrees(spark):
    s = {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}
    df = spark.createDataFrame([('{"a":1}',), ('{"a":"x"}',), ("{}",), ("[",), (None,)], "value string")
    rows = df.select(Validator(s, engine="interpreter").is_valid("value"), Validator(s).is_valid("value"), F.size(Validator(s).errors("value"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, 0), (False, False, 1), (False, False, 1), (False, False, 1), (False, False, 1)]
