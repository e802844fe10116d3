"""Verdicts as functions of values against the interpreter, and what a value costs them."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from skein.catalog import TREE
from skein.functions.values import BadJson, parse
from skein.operators import interpreter
from skein.operators.validator import Validator
from skein.operators.verdict import accepts_text, verdict
from tests.test_differential import BAD, schema, text


def odd(rng):
    """A schema with what columns can't hold: recursion, containers to compare, any items to be unique."""
    s = schema(rng, 2)
    if not isinstance(s, dict):
        return s
    for w in ("properties", "patternProperties"):
        if w in s and rng.random() < 0.6:
            s[w] = {**s[w], rng.choice(["p0", "x_1"]): {"$ref": "#"}}
    for w in ("items", "additionalProperties", "contains", "unevaluatedProperties", "unevaluatedItems", "propertyNames"):
        if w in s and rng.random() < 0.4:
            s[w] = {"$ref": "#"}
    if rng.random() < 0.2:
        s["uniqueItems"] = True
    if rng.random() < 0.2:
        s.setdefault("properties", {})["p1"] = {"enum": [[1, "a"], {"p0": 1}, {}, [], None, 1]}
    d = schema(rng, 1)
    return {**s, "$defs": {"d": {k: x for k, x in d.items() if k != "$ref"} if isinstance(d, dict) else d}}  # or it refers to itself


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_agree_with_the_interpreter(seed):
    rng = random.Random(seed)
    texts = [text(rng, 4) for _ in range(150)]
    said = set()
    for _ in range(50):
        v = Validator(odd(rng))
        test = verdict(v.node)
        for t in [*texts, *BAD]:
            ok = accepts_text(test, t)
            assert ok == (t is not None and v.accepts_json(t)), (v.schema, t)
            said.add(ok)
    assert said == {True, False}


def calls(run) -> int:
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_a_value_costs_few_calls():
    """Whoever checks rows under a recursive schema pays for each value of each row."""
    value = parse('{"n":3,"kids":[{"n":1,"kids":[]},{"n":2}]}')
    node = Validator(TREE).node
    test = verdict(node)
    assert test(value)
    assert 4 * calls(lambda: test(value)) < calls(lambda: interpreter.is_valid(node, value))


def test_columns_of_recursive_schemas(spark):
    """All forms of the check on rows say the same under schemas that refer to each other."""
    a = {"$id": "urn:even", "properties": {"n": {"type": "integer"}, "next": {"$ref": "urn:odd"}}, "required": ["n"]}
    b = {"$id": "urn:odd", "properties": {"s": {"type": "string"}, "next": {"$ref": "urn:even"}}, "required": ["s"]}
    v = Validator(a, [b])
    good, bad = '{"n":1,"next":{"s":"x","next":{"n":2}}}', '{"n":1,"next":{"s":"x","next":{"m":2}}}'
    df = spark.createDataFrame([(good,), (bad,), ("{",), ('{"n":1,"n":1}',), (None,)], "value string").coalesce(1)
    assert [r[0] for r in df.select(v.is_valid("value")).collect()] == [True, False, False, False, False]
    assert [[e.keyword for e in r[0]] for r in df.select(v.errors("value")).collect()] == [[], ["required"], ["syntax"], ["syntax"], ["syntax"]]
    assert df.agg(F.collect_list("value").alias("all")).select(v.count_in("all")).collect()[0][0] == 1


def test_texts_share_a_decoder(monkeypatch):
    """Both kinds of text: without and with integers that may not fit 64 bits."""
    monkeypatch.setattr(json, "JSONDecoder", None)  # what json.loads makes decoders of
    edge = {"9" * 18: 10**18 - 1, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "9223372036854775808": 2.0**63, "-9223372036854775809": -(2.0**63), "9" * 400: float("inf")}
    for digits, value in edge.items():
        got = parse(f'{{"a":[{digits},1]}}')["a"]
        assert (got[0], type(got[0]), got[1]) == (value, type(value), 1)
    for bad in ('{"a":1,"a":1}', f'[{"9" * 30},{{"a":1,"a":1}}]', "NaN", "[1] x", "﻿1"):
        with pytest.raises(BadJson):
            parse(bad)
