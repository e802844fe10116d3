"""Defaults, coercion and removal of undeclared properties, on parsed values and on typed columns. The order is remove,
coerce, default; values of other types than the schema's objects are left alone."""

from __future__ import annotations

import copy
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.values import is_number, js_number
from skein.plans.schema import Node

#: Number() of a non-empty string: decimal or 0x, 0o, 0b integers, inside white space.
DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)", re.A)
RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")


def js_to_number(s: str) -> float | int | None:
    t = s.strip()
    if s == "":
        return None
    if t == "":
        return 0
    if RADIX.fullmatch(t):
        return int(t, 0)
    if not DECIMAL.fullmatch(t):
        return None
    n = float(t)
    return int(n) if math.isfinite(n) and n == int(n) and abs(n) < 2**53 else n


def coerce(value: Any, kind: str) -> Any:
    if kind in ("number", "integer"):
        n = int(value) if isinstance(value, bool) else js_to_number(value) if isinstance(value, str) else None
        if n is None or kind == "integer" and not (math.isfinite(n) and n == int(n)):
            return value
        return n
    if kind == "string" and (isinstance(value, bool) or is_number(value)):
        return ("true" if value else "false") if isinstance(value, bool) else js_number(value)
    if kind == "boolean" and isinstance(value, str):
        return {"true": True, "1": True, "false": False, "0": False}.get(value, value)
    return value


def transform(node: Node, value: Any, defaults: bool = True, coercion: bool = False, removal: bool = False) -> Any:
    """The value with undeclared properties removed, scalars coerced and defaults filled in, at every level that
    `properties` reaches."""
    if not isinstance(value, dict) or not isinstance(node.raw, dict):
        return value
    out = dict(value)
    props = node.many("properties")
    if removal and node.get("additionalProperties") is False and node.has("properties"):
        out = {k: v for k, v in out.items() if k in node.raw["properties"]}
    for k, s in props:
        if k in out:
            if coercion and isinstance(s.get("type"), str):
                out[k] = coerce(out[k], s.raw["type"])
            out[k] = transform(s, out[k], defaults, coercion, removal)
        elif defaults and s.has("default"):
            out[k] = copy.deepcopy(s.raw["default"])
    return out


def coerce_column(c: Column, source: str, kind: str) -> Column:
    """M02 to M05 on a typed column: a string column becomes the kind's type where its text allows, else NULL."""
    if source == "string":
        t = F.trim(c)
        number = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
        if kind == "number":
            return number
        if kind == "integer":
            return F.when(number == F.rint(number), number.cast("bigint"))
        if kind == "boolean":
            return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)
        return c
    if kind == "string":
        whole = (c == F.rint(c)) & (F.abs(c) < 1e21) if source in ("double", "float") else F.lit(False)
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")) if source in ("double", "float") else c.cast("string")
    if source == "boolean" and kind in ("number", "integer"):
        return c.cast("int")
    return c


def transform_columns(df: DataFrame, node: Node, defaults: bool = True, coercion: bool = False, removal: bool = False) -> DataFrame:
    """The same for the top-level columns of a table: SQL NULL is an absent property. Plain column expressions."""
    types, props = dict(df.dtypes), dict(node.many("properties"))
    keep = [c for c in df.columns if not removal or node.get("additionalProperties") is not False or c in props]
    columns = []
    for name in keep:
        c = F.col(f"`{name}`")
        s = props.get(name)
        if s is not None and coercion and isinstance(s.get("type"), str):
            c = coerce_column(c, types[name], s.raw["type"])
        if s is not None and defaults and s.has("default") and not isinstance(s.raw["default"], (dict, list)):
            c = F.coalesce(c, F.lit(s.raw["default"]))
        columns.append(c.alias(name))
    if defaults:
        columns += [F.lit(s.raw["default"]).alias(k) for k, s in props.items() if k not in types and s.has("default") and not isinstance(s.raw["default"], (dict, list))]
    return df.select(*columns)
