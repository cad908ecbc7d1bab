"""Wildcard and shellstyle patterns as the literal pieces between their stars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.errors import InvalidPattern
from evmatch.functions.iregexp import escaped


def pieces(text: str, escapes: bool) -> tuple[str, ...]:
    """``escapes``: \\* and \\\\ are literals, other escapes are errors.  Two stars in a row are an error."""
    out, i, star = [""], 0, False
    while i < len(text):
        c = text[i]
        if c == "*":
            if star:
                raise InvalidPattern(f"adjacent stars in {text!r}")
            out.append("")
            star = True
        else:
            if c == "\\" and escapes:
                i += 1
                if text[i : i + 1] not in ("*", "\\"):
                    raise InvalidPattern(f"unknown escape in {text!r}")
                c = text[i]
            out[-1] += c
            star = False
        i += 1
    return tuple(out)


def to_regex(parts: tuple[str, ...]) -> str:
    return r"(?s)\A" + ".*".join("".join(map(escaped, p)) for p in parts) + r"\z"


def column(v: Column, parts: tuple[str, ...]) -> Column:
    """Literal string functions where they say it all, LIKE otherwise."""
    if len(parts) == 1:
        return v == parts[0]
    first, *middle, last = parts
    if not any(middle) and (not first or not last) and len(middle) == (1 if middle else 0) and not (middle and (first or last)):
        return v.startswith(first) if first else v.endswith(last) if last else v.isNotNull()
    if len(parts) == 3 and not first and not last:
        return v.contains(middle[0])
    quote = lambda p: "".join(f"!{c}" if c in "%_!" else c for c in p)
    return F.like(v, F.lit("%".join(map(quote, parts))), F.lit("!"))


def matches(text: str, parts: tuple[str, ...]) -> bool:
    if len(parts) == 1:
        return text == parts[0]
    first, *middle, last = parts
    if len(text) < len(first) + len(last) or not text.startswith(first) or not text.endswith(last):
        return False
    at, end = len(first), len(text) - len(last)
    for p in middle:
        found = text.find(p, at, end)
        if found < 0:
            return False
        at = found + len(p)
    return True
