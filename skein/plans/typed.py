"""Schema nodes to predicates on a table's own columns, which scans can push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans import compile as plan
from skein.plans.schema import Node

WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMBERS = (*WHOLE, "float", "double")
COLUMN_WORDS = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "title", "description", "default", "examples", "$comment"}
ROW_WORDS = {"type", "properties", "required", "additionalProperties", "minProperties", "title", "description", "$schema", "$id", "$comment", "default"}


def column_valid(node: Node, c: Column, kind: str) -> Column | None:
    """Whether a column's value, if it isn't NULL, is valid; None if the node asks for more than this can say."""
    if isinstance(node.raw, bool):
        return F.lit(node.raw)
    raw = node.raw
    if set(raw) - COLUMN_WORDS or kind != "string" and kind != "boolean" and kind not in NUMBERS:
        return None
    number = kind in NUMBERS
    finite = ~F.isnan(c) & (F.abs(c) < float("inf")) if kind in ("float", "double") else F.lit(True)
    tests = []
    if "type" in raw:
        kinds = [raw["type"]] if isinstance(raw["type"], str) else raw["type"]
        whole = c == F.rint(c) if kind in ("float", "double") else F.lit(True)
        fits = {"string": F.lit(kind == "string"), "boolean": F.lit(kind == "boolean"), "number": finite if number else F.lit(False), "integer": finite & whole if number else F.lit(False)}
        if number and "number" in kinds or kind == "string" and "string" in kinds or kind == "boolean" and "boolean" in kinds:
            if kind in ("float", "double"):
                tests.append(finite)
        else:
            tests.append(plan.either([fits[k] for k in kinds if k in fits]))
    if "enum" in raw or "const" in raw:
        for allowed in [raw["enum"]] if "enum" in raw else [], [[raw["const"]]] if "const" in raw else []:
            for values in allowed:
                same = [x for x in values if isinstance(x, bool) == (kind == "boolean") and isinstance(x, str) == (kind == "string") and x is not None and not isinstance(x, (dict, list))]
                tests.append(c.isin(same) if same else F.lit(False))
    if number:
        tests += plan.numeric(raw, c, kind in WHOLE)
    if kind == "string":
        tests += plan.textual(raw, c)
    return plan.both(tests)


def row_valid(node: Node, df: DataFrame) -> Column | None:
    if not isinstance(node.raw, dict) or set(node.raw) - ROW_WORDS or node.get("type", "object") != "object" or isinstance(node.get("additionalProperties"), dict) or node.has("minProperties"):
        return None
    types, tests, required = dict(df.dtypes), [], node.get("required", [])
    for k in required:
        tests.append(F.col(f"`{k}`").isNotNull() if k in types else F.lit(False))
    for k, s in node.many("properties"):
        if k in types:
            test = column_valid(s, F.col(f"`{k}`"), types[k])
            if test is None:
                return None
            tests.append(test if k in required else F.col(f"`{k}`").isNull() | test)
    if node.get("additionalProperties") is False:
        tests += [F.col(f"`{c}`").isNull() for c in df.columns if c not in (node.get("properties") or {})]
    return plan.both(tests)
