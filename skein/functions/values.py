"""Strict JSON text for Python, and the few functions on VARIANT that the compiled checks use."""

from __future__ import annotations

import json
import re
import secrets
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: A word that no text knows, one for each process, so that equal checks have equal plans.
_MARK = secrets.token_hex(16)


class BadJson(ValueError):
    pass


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise BadJson("duplicate key")
    return out


def _constant(name: str) -> Any:
    raise BadJson(f"unexpected token {name}")


def number(v: Any) -> Any:
    """Numbers have one rule everywhere: integers written as such that fit 64 bits are exact, all others are doubles."""
    if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
        return float(v) if abs(v) < 2**1024 else INF if v > 0 else -INF
    return v


def _decoder(**how: Any) -> Callable[[], json.JSONDecoder]:
    made = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_constant, **how)
    return lambda: made


#: Made once: json.loads with hooks would make a decoder for each text. Integers that may not fit 64 bits have 19 digits at least;
#: without any, int itself can read them.
_SHORT, _LONG = _decoder(), _decoder(parse_int=lambda s: number(int(s)) if len(s) < 400 else float(s))
_DIGITS = re.compile("[0-9]{19}")


def parse(text: str | None) -> Any:
    """Strict JSON: no duplicate keys, no NaN, nothing after the value."""
    text = text if text is not None else ""
    try:
        return json.loads(text, cls=_SHORT if isinstance(text, str) and not _DIGITS.search(text) else _LONG)
    except (ValueError, RecursionError) as e:
        raise BadJson(str(e)) from e


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < INF


def kind_fits(v: Any, name: str) -> bool:
    match name:
        case "string":
            return isinstance(v, str)
        case "number":
            return is_number(v)
        case "integer":
            return is_number(v) and v == int(v)
        case "boolean":
            return isinstance(v, bool)
        case "null":
            return v is None
        case "object":
            return isinstance(v, dict)
        case _:
            return isinstance(v, list)


def js_number(n: Any) -> str:
    return str(int(n)) if isinstance(n, float) and abs(n) < 1e21 and n == int(n) else str(n)


def document(text: Column) -> Column:
    """The text's value as VARIANT, NULL if it isn't one strict JSON value. Text after a value would be ignored by the
    parser, so the value is parsed as the first of two array items, the second a word that no text knows."""
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))
    return F.element_at(
        F.transform(
            F.array(pair),
            lambda p: F.when(
                F.coalesce((F.size(F.try_variant_get(p, "$", "array<variant>")) == 2) & (F.try_variant_get(p, "$[1]", "string") == _MARK), F.lit(False)),
                F.try_variant_get(p, "$[0]", "variant"),
            ),
        ),
        1,
    )
