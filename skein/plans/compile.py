"""Schema nodes to boolean columns over VARIANT. No column here is ever NULL, or `not`, `oneOf` and `if` would break."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import formats, patterns
from skein.functions.values import is_number
from skein.functions.values import number as normal
from skein.plans.schema import Node, reach, recursive, unrolled

#: Larger expressions cost more to plan than the interpreter costs to run.
MOST_NODES = 400
SCALARS = {"string", "number", "integer", "boolean", "null"}


def both(parts: list[Column]) -> Column:
    """A balanced conjunction."""
    if not parts:
        return F.lit(True)
    if len(parts) == 1:
        return parts[0]
    return both(parts[: len(parts) // 2]) & both(parts[len(parts) // 2 :])


def either(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(False)
    if len(parts) == 1:
        return parts[0]
    return either(parts[: len(parts) // 2]) | either(parts[len(parts) // 2 :])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.exists(F.array(value), body)


def expressible(node: Node) -> bool:
    """Whether columns can hold the check: no recursion, no comparison of containers, not too large."""
    if recursive(node) or unrolled(node) > MOST_NODES:
        return False
    for n in reach(node):
        values = [*n.get("enum", []), *([n.raw["const"]] if n.has("const") else [])]
        if any(isinstance(x, (dict, list)) for x in values):
            return False
        if n.get("uniqueItems") is True:
            item = n.children.get(("items", None))
            kinds = item.get("type") if item else None
            if n.many("prefixItems") or not kinds or not set([kinds] if isinstance(kinds, str) else kinds) <= SCALARS:
                return False
    return True


class Value:
    """The views of a VARIANT column that the checks need."""

    def __init__(self, v: Column):
        self.v = v
        self.tag = F.schema_of_variant(v)
        self.number = F.try_variant_get(v, "$", "double")
        self.whole = F.try_variant_get(v, "$", "bigint")  # only meant for the tag BIGINT
        self.string = F.try_variant_get(v, "$", "string")
        self.items = F.try_variant_get(v, "$", "array<variant>")
        self.map = F.try_variant_get(v, "$", "map<string,variant>")

    def is_(self, kind: str) -> Column:
        numeric = self.tag.isin("BIGINT", "DOUBLE", "FLOAT") | self.tag.startswith("DECIMAL")
        finite = F.abs(self.number) < float("inf")
        test = {
            "string": lambda: self.tag == "STRING",
            "boolean": lambda: self.tag == "BOOLEAN",
            "null": lambda: F.is_variant_null(self.v),
            "number": lambda: numeric & finite,
            "integer": lambda: numeric & finite & (self.number == F.rint(self.number)),
            "object": lambda: self.tag.startswith("OBJECT"),
            "array": lambda: self.tag.startswith("ARRAY"),
        }[kind]()
        return F.coalesce(test, F.lit(False))


def child(x: Value, key: str) -> Column:
    """The property's value, NULL if it isn't there. A path reads one field; the map of all is built only for keys that
    a path can't name."""
    if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key):
        return F.try_variant_get(x.v, f"$.{key}", "variant")
    if re.fullmatch(r"[^\"\\\[\]\x00-\x1f]+", key):
        return F.try_variant_get(x.v, f'$["{key}"]', "variant")
    return F.try_element_at(x.map, F.lit(key))


def equals(x: Value, to: Any) -> Column:
    if to is None:
        return x.is_("null")
    if isinstance(to, bool):
        return x.is_("boolean") & F.coalesce(F.try_variant_get(x.v, "$", "boolean") == to, F.lit(False))
    if isinstance(to, str):
        return x.is_("string") & F.coalesce(x.string == to, F.lit(False))
    return x.is_("number") & F.coalesce(compared(x, "==", to), F.lit(False))


SIGNS = {"==": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def compared(x: Value, sign: str, to: float | int) -> Column:
    """x against a number, exactly. Doubles decide unless the number is an integer from 2^53 on, where doubles are not
    dense: 64-bit integers are then compared as such, and a double with the double next to the number."""
    to, test = normal(to), SIGNS[sign]
    if to != to or abs(to) == float("inf") or abs(to) < 2**53 or to != int(to):
        return test(x.number, F.lit(float(to)))
    near, exact = float(to), int(to)
    below = int(near) < exact
    if sign == "==":
        rough = x.number == near if int(near) == exact else F.lit(False)
    elif sign in ("<=", ">"):  # a double is at most the number if it is at most the largest double that is
        rough = SIGNS["<=" if sign == "<=" else ">"](x.number, F.lit(near)) if int(near) <= exact else SIGNS["<" if sign == "<=" else ">="](x.number, F.lit(near))
    else:
        rough = SIGNS["<=" if sign == "<" else ">"](x.number, F.lit(near)) if below else SIGNS[sign](x.number, F.lit(near))
    whole = test(x.whole, F.lit(exact)) if -(2**63) <= exact < 2**63 else F.lit(test(0, exact))
    return F.when(x.tag == "BIGINT", whole).otherwise(rough)


def matches(s: Column, pattern: str) -> Column:
    start = patterns.prefix(pattern)
    return s.startswith(start) if start else s.rlike(patterns.java(pattern))


def valid(node: Node, v: Column) -> Column:
    """Whether v (a VARIANT that is not SQL NULL) satisfies node. Cheap tests come first."""
    if isinstance(node.raw, bool):
        return F.lit(node.raw)
    x, raw = Value(v), node.raw
    kinds = [raw["type"]] if isinstance(raw.get("type"), str) else raw.get("type")
    parts = [either([x.is_(k) for k in kinds])] if kinds is not None else []

    def given(kind: str, tests: list[Column]) -> None:
        if not tests or kinds is not None and kind not in kinds and not (kind == "number" and "integer" in kinds):
            return
        held = F.coalesce(both(tests), F.lit(False))
        parts.append(held if kinds is not None and len(kinds) == 1 else ~x.is_(kind) | held)

    if "enum" in raw:
        parts.append(either([equals(x, c) for c in raw["enum"]]))
    if "const" in raw:
        parts.append(equals(x, raw["const"]))
    given("number", [compared(x, sign, raw[word]) for word, sign in BOUNDS.items() if is_number(raw.get(word))] + multiple(raw, x.number))
    given("string", textual(raw, x.string))
    given("array", _array(node, x))
    given("object", _object(node, x))
    if node.ref:
        parts.append(valid(node.ref, v))
    parts += [valid(s, v) for _, s in node.many("allOf")]
    if node.has("anyOf"):
        parts.append(either([valid(s, v) for _, s in node.many("anyOf")]))
    if node.has("oneOf"):
        parts.append(sum((valid(s, v).cast("int") for _, s in node.many("oneOf")), F.lit(0)) == 1)
    if node.has("not"):
        parts.append(~valid(node.one("not"), v))
    if node.has("if") and (node.has("then") or node.has("else")):
        then = valid(node.one("then"), v) if node.has("then") else F.lit(True)
        otherwise = valid(node.one("else"), v) if node.has("else") else F.lit(True)
        parts.append(F.when(valid(node.one("if"), v), then).otherwise(otherwise))
    return F.coalesce(both(parts), F.lit(False))


BOUNDS = {"minimum": ">=", "maximum": "<=", "exclusiveMinimum": ">", "exclusiveMaximum": "<"}


def numeric(raw: dict, d: Column, whole: bool = False) -> list[Column]:
    """The numeric checks of a typed column; whole: of integers, which are compared with integers as such."""
    bounds = [SIGNS[sign](d, F.lit(float(raw[word]) if not whole or raw[word] != int(raw[word]) or abs(raw[word]) >= 2**63 else int(raw[word]))) for word, sign in BOUNDS.items() if is_number(raw.get(word))]
    return bounds + multiple(raw, d)


def multiple(raw: dict, d: Column) -> list[Column]:
    if not is_number(raw.get("multipleOf")):
        return []
    n = float(raw["multipleOf"])
    r = F.try_mod(d, F.lit(n))
    return [(F.abs(r) <= 1e-8) | (F.abs(r - n) <= 1e-8) | (F.abs(r + n) <= 1e-8)]


def _sizes(raw: dict, n: Column, what: str) -> list[Column]:
    out = [n >= F.lit(raw[w])] if is_number(raw.get(w := f"min{what}")) else []
    return out + ([n <= F.lit(raw[w])] if is_number(raw.get(w := f"max{what}")) else [])


def textual(raw: dict, s: Column) -> list[Column]:
    out = _sizes(raw, F.length(s), "Length")
    if isinstance(raw.get("pattern"), str):
        out.append(matches(s, raw["pattern"]))
    if isinstance(raw.get("format"), str) and raw["format"] in formats.WHOLE:
        out.append(formats.column(raw["format"], s))
    return out


def _scalar_key(v: Column) -> Column:
    """Equal for equal scalars. A 64-bit integer that no double holds keeps its distance from the nearest one."""
    x = Value(v)
    edge = F.abs(x.number) >= F.lit(2.0**63)  # where a double can't become an integer again
    off = F.when(edge, F.nullif(x.whole, F.lit(-(2**63)))).otherwise(F.nullif(x.whole - F.when(edge, F.lit(0)).otherwise(x.number.cast("bigint")), F.lit(0)))
    off = F.when((x.tag == "BIGINT") & (F.abs(x.number) >= F.lit(2.0**53)), off.cast("string"))
    return F.when(x.is_("number"), F.concat(F.lit("n"), (x.number + 0.0).cast("string"), F.coalesce(F.concat(F.lit("|"), off), F.lit("")))).otherwise(F.concat(x.tag, F.coalesce(x.string, F.lit(""))))


def _array(node: Node, x: Value) -> list[Column]:
    raw, a = node.raw, x.items
    out = _sizes(raw, F.size(a), "Items")
    fixed = node.many("prefixItems")
    if node.has("items"):
        s = node.one("items")
        if s.raw is False:
            out.append(F.size(a) <= len(fixed))
        elif s.raw is not True:
            rest = F.slice(a, len(fixed) + 1, F.greatest(F.size(a), F.lit(1))) if fixed else a
            out.append(F.forall(rest, lambda i: valid(s, i)))
    for i, s in fixed:
        out.append((F.size(a) <= i) | let(F.get(a, F.lit(i)), lambda v: F.coalesce(valid(s, v), F.lit(False))))
    if raw.get("uniqueItems") is True:
        out.append(F.size(F.array_distinct(F.transform(a, _scalar_key))) == F.size(a))
    if node.has("contains"):
        s = node.one("contains")
        n = F.size(F.filter(a, lambda i: valid(s, i)))
        out.append(n >= F.lit(raw.get("minContains", 1)))
        if is_number(raw.get("maxContains")):
            out.append(n <= F.lit(raw["maxContains"]))
    if node.has("unevaluatedItems"):
        s = node.one("unevaluatedItems")
        out.append(F.forall(F.transform(a, lambda v, i: seen_item(node, x.v, i, v, own=False) | valid(s, v)), lambda ok: ok))
    return out


def _object(node: Node, x: Value) -> list[Column]:
    raw, m = node.raw, x.map
    keys = raw.get("properties") or {}
    required = raw.get("required", [])
    names = F.map_keys(m)
    has = lambda k: child(x, k).isNotNull()
    checked = {k for k, s in node.many("properties") if s.raw is not True}
    out = [has(k) for k in required if k not in checked] + _sizes(raw, F.size(m), "Properties")
    more = raw.get("additionalProperties")
    res = [p for p, _ in node.many("patternProperties")]
    if more is False:
        if not res and set(keys) == set(required):
            out.append(F.size(m) == len(keys))  # all are there, so any more is one too many
        else:
            out.append(F.forall(names, lambda k: _known(k, list(keys), res)))
    for k, needed in (raw.get("dependentRequired") or {}).items():
        out.append(~has(k) | both([has(d) for d in needed]))
    for k, s in node.many("properties"):
        if s.raw is not True:
            # a required property is read once, for its presence and its check
            out.append(let(child(x, k), lambda v: F.coalesce(valid(s, v), F.lit(False)) & v.isNotNull() if k in required else v.isNull() | F.coalesce(valid(s, v), F.lit(False))))
    entries = [(p, s) for p, s in node.many("patternProperties") if s.raw is not True]
    rest = node.one("additionalProperties") if isinstance(more, dict) else None
    if entries or rest:

        def each(e: Column) -> Column:
            tests = [~matches(e["key"], p) | valid(s, e["value"]) for p, s in entries]
            if rest:
                tests.append(_known(e["key"], list(keys), res) | valid(rest, e["value"]))
            return both(tests)

        out.append(F.forall(F.map_entries(m), each))
    for k, s in node.many("dependentSchemas"):
        out.append(~has(k) | valid(s, x.v))
    if node.has("propertyNames"):
        out.append(F.forall(names, lambda k: valid_name(node.one("propertyNames"), k)))
    if node.has("unevaluatedProperties"):
        s = node.one("unevaluatedProperties")
        out.append(F.forall(F.map_entries(m), lambda e: seen_key(node, x.v, m, e["key"], own=False) | valid(s, e["value"])))
    return out


def _known(k: Column, keys: list[str], res: list[str]) -> Column:
    return either([*([k.isin(keys)] if keys else []), *(matches(k, p) for p in res)])


def valid_name(node: Node, k: Column) -> Column:
    """Whether a property's name, a string column, satisfies node."""
    if isinstance(node.raw, bool):
        return F.lit(node.raw)
    raw = node.raw
    kinds = [raw["type"]] if isinstance(raw.get("type"), str) else raw.get("type", ["string"])
    parts = [F.lit("string" in kinds), *textual(raw, k)]
    if "enum" in raw:
        parts.append(k.isin([c for c in raw["enum"] if isinstance(c, str)]))
    if "const" in raw:
        parts.append(k == raw["const"] if isinstance(raw["const"], str) else F.lit(False))
    go = lambda s: valid_name(s, k)
    parts += [go(s) for _, s in node.many("allOf")] + ([go(node.ref)] if node.ref else [])
    if node.has("anyOf"):
        parts.append(either([go(s) for _, s in node.many("anyOf")]))
    if node.has("oneOf"):
        parts.append(sum((go(s).cast("int") for _, s in node.many("oneOf")), F.lit(0)) == 1)
    if node.has("not"):
        parts.append(~go(node.one("not")))
    if node.has("if"):
        parts.append(F.when(go(node.one("if")), go(node.one("then")) if node.has("then") else F.lit(True)).otherwise(go(node.one("else")) if node.has("else") else F.lit(True)))
    return F.coalesce(both(parts), F.lit(False))


def _through(node: Node, v: Column, go: Callable[[Node], Column], has: Callable[[str], Column] | None) -> list[Column]:
    """go over the subschemas that apply to v itself, where they accept it."""
    out = [go(s) for _, s in node.many("allOf")] + ([go(node.ref)] if node.ref else [])
    out += [valid(s, v) & go(s) for word in ("anyOf", "oneOf") for _, s in node.many(word)]
    if node.has("if"):
        ok = valid(node.one("if"), v)
        then = either([go(node.one("if")), *([go(node.one("then"))] if node.has("then") else [])])
        out.append(F.when(ok, then).otherwise(go(node.one("else")) if node.has("else") else F.lit(False)))
    if has:
        out += [has(k) & go(s) for k, s in node.many("dependentSchemas")]
    return out


def seen_key(node: Node, v: Column, m: Column, k: Column, own: bool = True) -> Column:
    """Whether node evaluates the property k of the object v."""
    if not isinstance(node.raw, dict):
        return F.lit(False)
    if node.has("additionalProperties") or own and node.has("unevaluatedProperties"):
        return F.lit(True)
    parts = [_known(k, [p for p, _ in node.many("properties")], [p for p, _ in node.many("patternProperties")])]
    parts += _through(node, v, lambda s: seen_key(s, v, m, k), lambda key: F.coalesce(F.map_contains_key(m, key), F.lit(False)))
    return F.coalesce(either(parts), F.lit(False))


def seen_item(node: Node, v: Column, i: Column, item: Column, own: bool = True) -> Column:
    """Whether node evaluates the item at index i of the array v."""
    if not isinstance(node.raw, dict):
        return F.lit(False)
    if node.has("items") or own and node.has("unevaluatedItems"):
        return F.lit(True)
    parts = [i < len(node.many("prefixItems"))]
    if node.has("contains"):
        parts.append(valid(node.one("contains"), item))
    return F.coalesce(either(parts + _through(node, v, lambda s: seen_item(s, v, i, item), None)), F.lit(False))

