"""ECMA regular expressions for Java's and Python's engines."""

from __future__ import annotations

import re as _re
from functools import lru_cache

import regex

#: White space of ECMA's \s, as the inside of a class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def translate(pattern: str, end: str) -> str:
    """The pattern for an engine whose absolute end is `end`: $ is the very end, \\d and \\w are ASCII, \\s is Unicode,
    brackets and && inside a class are literal, [] matches nothing and [^] anything."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "u" and (m := _re.match(r"\\u\{([0-9A-Fa-f]+)\}", pattern[i:])):
                out.append(_re.escape(chr(int(m[1], 16))))
                i += m.end()
                continue
            if n == "c" and i + 2 < len(pattern) and pattern[i + 2].isalpha():
                out.append(f"\\x{ord(pattern[i + 2].upper()) - 64:02x}")
                i += 3
                continue
            if n in "sS":
                out.append(SPACE if inside and n == "s" else f"[{'^' if n == 'S' else ''}{SPACE}]")
            elif n in "dD":
                out.append("0-9" if inside and n == "d" else f"[{'^' if n == 'D' else ''}0-9]")
            elif n in "wW":
                out.append("A-Za-z0-9_" if inside and n == "w" else f"[{'^' if n == 'W' else ''}A-Za-z0-9_]")
            elif n in "/-" and not inside:
                out.append("/" if n == "/" else "\\-")
            else:
                out.append(c + n)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            elif c in "[&~":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            if pattern.startswith("[^]", i):
                out.append("(?s:.)")
                i += 3
                continue
            inside = True
            out.append("[^" if pattern.startswith("[^", i) else "[")
            i += pattern.startswith("[^", i)
        elif c == "$":
            out.append(end)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    return translate(pattern, "\\z")


@lru_cache(4096)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(translate(pattern, "\\Z"), regex.V0)


def prefix(pattern: str) -> str | None:
    """The literal of a pattern that only asks for a beginning."""
    return pattern[1:] if _re.fullmatch(r"\^[A-Za-z0-9_ /:@#%&,;=!<>~\"'-]+", pattern) else None


def nested_quantifier(pattern: str) -> bool:
    """Whether a repeated group holds a repetition, which backtracking engines may take exponential time for."""
    stack, last = [], False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            last = False
            continue
        if c == "[":
            close = pattern.find("]", i + 2)
            i = close if close > 0 else len(pattern)
            last = False
        elif c == "(":
            stack.append(False)
            last = False
        elif c == ")":
            last = stack.pop() if stack else False
        elif c in "*+{":
            if last:
                return True
            if stack:
                stack[-1] = True
        else:
            last = False
        i += 1
    return False
