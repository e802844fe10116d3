"""A JSON Schema, read once on the driver, as a graph of nodes with resolved references."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from skein.functions import patterns
from skein.functions.values import number

TYPES = ("string", "number", "integer", "boolean", "null", "object", "array")
DRAFT_7 = ("http://json-schema.org/draft-07/schema", "http://json-schema.org/draft-07/schema#")
ONE = ("additionalProperties", "propertyNames", "items", "contains", "not", "if", "then", "else", "unevaluatedProperties", "unevaluatedItems")
LIST = ("allOf", "anyOf", "oneOf", "prefixItems")
MAP = ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions")


class SchemaError(ValueError):
    """The schema can't be compiled."""


@dataclass(eq=False)
class Node:
    """One schema object: raw is its JSON (or a boolean); children by (keyword, key or index or None)."""

    raw: Any
    base: str
    children: dict[tuple[str, Any], Node] = field(default_factory=dict)
    ref: Node | None = None

    def has(self, keyword: str) -> bool:
        return isinstance(self.raw, dict) and keyword in self.raw

    def get(self, keyword: str, default: Any = None) -> Any:
        return self.raw.get(keyword, default) if isinstance(self.raw, dict) else default

    def one(self, keyword: str) -> Node:
        return self.children[keyword, None]

    def many(self, keyword: str) -> list[tuple[Any, Node]]:
        return [(k, n) for (word, k), n in self.children.items() if word == keyword]


def normalise_draft7(schema: Any) -> Any:
    """A copy in the 2020-12 vocabulary: definitions, dependencies and array-valued items are rewritten throughout."""
    if isinstance(schema, list):
        return [normalise_draft7(s) for s in schema]
    if not isinstance(schema, dict):
        return schema
    out = dict(schema)
    if "definitions" in out and "$defs" not in out:
        out["$defs"] = out.pop("definitions")
    for key, value in (out.pop("dependencies", None) or {}).items():
        word = "dependentRequired" if isinstance(value, list) else "dependentSchemas"
        out[word] = {**out.get(word, {}), key: value}
    if isinstance(out.get("items"), list):
        out["prefixItems"] = out.pop("items")
        if "additionalItems" in out:
            out["items"] = out.pop("additionalItems")
    out.pop("additionalItems", None)
    for word in MAP:
        if isinstance(out.get(word), dict):
            out[word] = {k: normalise_draft7(v) for k, v in out[word].items()}
    for word in (*ONE, *LIST):
        if word in out:
            out[word] = normalise_draft7(out[word])
    if isinstance(out.get("$ref"), str) and out["$ref"].startswith("#/definitions/") and "definitions" not in out:
        out["$ref"] = "#/$defs/" + out["$ref"].removeprefix("#/definitions/")
    return out


def load(schema: Any) -> Any:
    """Schema text, object or boolean to a private copy; Draft-7 is rewritten."""
    if isinstance(schema, str):
        try:
            schema = json.loads(schema)
        except ValueError as e:
            raise SchemaError(f"invalid schema: {e}") from e
    schema = copy.deepcopy(schema)
    if isinstance(schema, dict) and schema.get("$schema") in DRAFT_7:
        schema = normalise_draft7(schema)
    return schema


class Compiler:
    """Builds nodes for a schema and for those of the registry that it refers to."""

    def __init__(self, schema: Any, registry: Mapping[str, Any] | None = None):
        self.nodes: dict[int, Node] = {}
        self.resources: dict[str, Any] = {}
        self.keep: list[Any] = []  # nodes are known by the identity of their JSON, which must live as long
        for name, other in (registry or {}).items():
            other = load(other)
            self._index(other, name)
            self.resources.setdefault(name, other)
        self.schema = load(schema)
        base = self.schema.get("$id", "") if isinstance(self.schema, dict) else ""
        self._index(self.schema, base)
        self.resources[base] = self.schema
        self.root = self._node(self.schema, base)

    def _index(self, schema: Any, base: str) -> None:
        """Notes every $id below."""
        self.keep.append(schema)
        for sub, own in _below(schema, base):
            if isinstance(sub, dict) and isinstance(sub.get("$id"), str):
                self.resources[own] = sub
                self.resources.setdefault(sub["$id"], sub)

    def _node(self, raw: Any, base: str) -> Node:
        if isinstance(raw, dict) and isinstance(raw.get("$id"), str):
            base = urljoin(base, raw["$id"])
        if not isinstance(raw, (dict, bool)):
            raw = True  # anything else constrains nothing
        if isinstance(raw, dict) and (known := self.nodes.get(id(raw))):
            return known
        node = Node(raw, base)
        if isinstance(raw, bool):
            return node
        self.nodes[id(raw)] = node
        self._check(raw)
        for word in ONE:
            if word in raw:
                node.children[word, None] = self._node(raw[word], base)
        for word in LIST:
            for i, s in enumerate(raw.get(word) or []):
                node.children[word, i] = self._node(s, base)
        for word in MAP[:3]:
            for k, s in (raw.get(word) or {}).items():
                node.children[word, k] = self._node(s, base)
        if "$ref" in raw:
            node.ref = self._resolve(raw["$ref"], base)
        return node

    def _check(self, raw: dict) -> None:
        if "$dynamicRef" in raw or "$recursiveRef" in raw:
            raise SchemaError("dynamic references are not supported")
        for t in [raw["type"]] if isinstance(raw.get("type"), str) else raw.get("type", []):
            if t not in TYPES:
                raise SchemaError(f"unknown type {t!r}")
        for p in [*([raw["pattern"]] if isinstance(raw.get("pattern"), str) else []), *(raw.get("patternProperties") or {})]:
            try:
                patterns.compiled(p)
            except Exception as e:
                raise SchemaError(f"bad pattern {p!r}: {e}") from e

    def _resolve(self, ref: str, base: str) -> Node:
        if ref in self.resources:
            return self._node(self.resources[ref], ref)
        where, fragment = urldefrag(urljoin(base, ref)) if not ref.startswith("#") else (base, ref[1:])
        target = self.resources.get(where, self.resources.get(ref.partition("#")[0]))
        if target is None:
            raise SchemaError(f"unresolved reference {ref!r}")
        own = where
        for part in unquote(fragment).split("/")[1:] if fragment else []:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                target = target[int(part)] if isinstance(target, list) else target[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise SchemaError(f"unresolved reference {ref!r}") from None
            if isinstance(target, dict) and isinstance(target.get("$id"), str):
                own = urljoin(own, target["$id"])
        if fragment and not fragment.startswith("/"):
            raise SchemaError(f"unresolved reference {ref!r}")
        return self._node(target, own)


def _below(schema: Any, base: str) -> Iterator[tuple[Any, str]]:
    if isinstance(schema, dict):
        base = urljoin(base, schema["$id"]) if isinstance(schema.get("$id"), str) else base
        yield schema, base
        for word in ONE:
            if word in schema:
                yield from _below(schema[word], base)
        for word in LIST:
            for s in schema.get(word) or [] if isinstance(schema.get(word), list) else []:
                yield from _below(s, base)
        for word in MAP:
            for s in (schema.get(word) or {}).values() if isinstance(schema.get(word), dict) else []:
                yield from _below(s, base)


def reach(node: Node) -> Iterator[Node]:
    """Every node that a check of node can come to, once."""
    seen: set[int] = set()
    todo = [node]
    while todo:
        n = todo.pop()
        if id(n) in seen:
            continue
        seen.add(id(n))
        yield n
        todo += [*n.children.values(), *([n.ref] if n.ref else [])]


def recursive(node: Node) -> bool:
    """Whether a check can come back to a node."""
    state: dict[int, int] = {}

    def visit(n: Node) -> bool:
        if state.get(id(n)) == 1:
            return True
        if state.get(id(n)) == 2:
            return False
        state[id(n)] = 1
        found = any(visit(c) for c in [*n.children.values(), *([n.ref] if n.ref else [])])
        state[id(n)] = 2
        return found

    return visit(node)


def unrolled(node: Node, most: int = 100_000) -> int:
    """How many nodes an expression without sharing has; most at most."""
    sizes: dict[int, int] = {}

    def size(n: Node) -> int:
        if id(n) not in sizes:
            sizes[id(n)] = min(most, 1 + sum(size(c) for c in [*n.children.values(), *([n.ref] if n.ref else [])]))
        return sizes[id(n)]

    return size(node)


def canonical(value: Any) -> str:
    """Equal for values that JSON Schema calls equal: key order doesn't count and numbers compare by value."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        value = number(value)
        return "n" + (str(int(value)) if value == value and abs(value) != float("inf") and value == int(value) else repr(float(value)))
    if isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"


def fingerprint(schema: Any, registry: Mapping[str, Any] | None = None) -> str:
    """A key of the schema's and the registry's contents."""
    text = canonical([schema, [[k, (registry or {})[k]] for k in sorted(registry or {})]])
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def evaluated(node: Node) -> dict[str, Any]:
    """What a check of node always evaluates: props, items (a count), allProps, allItems, and dynamic if more depends on
    the value."""
    out = {"props": [], "items": 0, "allProps": False, "allItems": False, "dynamic": False}
    seen: set[int] = set()

    def visit(n: Node) -> None:
        if id(n) in seen or not isinstance(n.raw, dict):
            return
        seen.add(id(n))
        out["props"] += [k for k, _ in n.many("properties") if k not in out["props"]]
        out["items"] = max(out["items"], len(n.many("prefixItems")))
        out["allProps"] |= n.has("additionalProperties") or n.has("unevaluatedProperties") and n is not node
        out["allItems"] |= n.has("items") or n.has("unevaluatedItems") and n is not node
        out["dynamic"] |= any(n.many(w) for w in ("patternProperties", "anyOf", "oneOf", "dependentSchemas")) or n.has("contains") or n.has("if")
        for _, c in n.many("allOf"):
            visit(c)
        if n.ref:
            visit(n.ref)

    visit(node)
    return out
