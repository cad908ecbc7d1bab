"""Patterns: JSON objects whose leaves are lists of matchers.

Nested objects are nested paths, keys combine with AND, the entries of a list with OR.  ``parse``
gives a ``Pattern``: for every path its matchers.  Paths are tuples, so a dot in a key is a dot.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any, NamedTuple

from evmatch.errors import InvalidJson, InvalidPattern
from evmatch.functions import cidr as cidr_blocks
from evmatch.functions import iregexp, wildcard

Path = tuple[str, ...]


class Matcher(NamedTuple):
    """One alternative of a field; ``op`` says which of the other members count."""

    op: str
    text: str = ""
    texts: tuple[str, ...] = ()
    number: float = 0.0
    numbers: tuple[float, ...] = ()
    low: float | None = None
    high: float | None = None
    low_in: bool = False
    high_in: bool = False
    pieces: tuple[str, ...] = ()
    block: cidr_blocks.Block | None = None
    conditions: tuple[iregexp.Condition, ...] = ()


@dataclass(frozen=True)
class Pattern:
    fields: tuple[tuple[Path, tuple[Matcher, ...]], ...]

    @property
    def paths(self) -> tuple[Path, ...]:
        return tuple(p for p, _ in self.fields)


def number_text(x: float) -> str:
    """Shortest decimal form, never with an exponent; whole numbers without a fraction."""
    if x == int(x):
        return str(int(x))
    return format(Decimal(repr(x)), "f")


def _number(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise InvalidPattern(f"{x!r} is not a number")
    return _finite(x)


def _finite(x: int | float) -> float:
    """As a double; what is beyond doubles is no number of a pattern."""
    try:
        found = float(x)
    except OverflowError:
        found = math.inf
    if not math.isfinite(found):
        raise InvalidPattern("a number out of range")
    return found


def _string(op: str, x: Any) -> str:
    if not isinstance(x, str):
        raise InvalidPattern(f"{op} needs a string")
    return x


def _numeric(body: Any) -> Matcher:
    if not isinstance(body, list) or len(body) % 2:
        raise InvalidPattern("numeric needs pairs of an operator and a number")
    low = high = None
    low_in = high_in = False
    for op, value in zip(body[::2], body[1::2], strict=True):
        x = _number(value)
        if op not in (">", ">=", "<", "<=", "="):
            raise InvalidPattern(f"unknown numeric operator {op!r}")
        if op in (">", ">=", "="):
            low, low_in = x, op != ">"
        if op in ("<", "<=", "="):
            high, high_in = x, op != "<"
    return Matcher("numeric", low=low, high=high, low_in=low_in, high_in=high_in)


def _anything_but(body: Any) -> Matcher:
    items = body if isinstance(body, list) else [body]
    if not items:
        raise InvalidPattern("anything-but needs something")
    strings = [x for x in items if isinstance(x, str)]
    numbers = [x for x in items if isinstance(x, (int, float)) and not isinstance(x, bool)]
    if bool(strings) == bool(numbers):
        raise InvalidPattern("anything-but takes strings or numbers")
    if strings:
        return Matcher("anything-but", texts=tuple(dict.fromkeys(strings)))
    return Matcher("anything-but-numeric", numbers=tuple(dict.fromkeys(map(_finite, numbers))))


def _operator(body: dict, strict_lookaround: bool) -> Matcher:
    if not body:
        raise InvalidPattern("empty operator")
    op, value = next(iter(body.items()))  # the first key is the operator, others are ignored
    if op == "exists":
        if not isinstance(value, bool):
            raise InvalidPattern("exists needs true or false")
        return Matcher("exists" if value else "missing")
    if op in ("prefix", "suffix", "equals-ignore-case"):
        return Matcher(op, text=_string(op, value))
    if op in ("wildcard", "shellstyle"):
        return Matcher("wildcard", text=value, pieces=wildcard.pieces(_string(op, value), op == "wildcard"))
    if op == "anything-but":
        return _anything_but(value)
    if op == "numeric":
        return _numeric(value)
    if op == "cidr":
        return Matcher("cidr", block=cidr_blocks.parse(_string(op, value)))
    if op in ("regexp", "regex"):
        return Matcher("regexp", text=value, conditions=iregexp.translate(_string(op, value), strict_lookaround))
    raise InvalidPattern(f"unknown operator {op!r}")


def _matcher(x: Any, strict_lookaround: bool) -> Matcher:
    if isinstance(x, bool) or x is None:
        return Matcher("exact", text=json.dumps(x))
    if isinstance(x, str):
        return Matcher("exact", text=x)
    if isinstance(x, (int, float)):
        return Matcher("number", number=_finite(x), text=number_text(_finite(x)))
    if isinstance(x, dict):
        return _operator(x, strict_lookaround)
    raise InvalidPattern("a list inside a list of matchers")


def parse(text: str | dict, strict_lookaround: bool = False) -> Pattern:
    """Of JSON text or an equal dict.  A field with an empty list is left out."""
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except (ValueError, RecursionError) as e:
            raise InvalidJson(str(e)) from None
    if not isinstance(text, dict):
        raise InvalidPattern("a pattern is an object")
    found: dict[Path, tuple[Matcher, ...]] = {}

    def walk(node: dict, path: Path) -> None:
        for key, value in node.items():
            if isinstance(value, dict):
                walk(value, (*path, key))
            elif isinstance(value, list):
                found[*path, key] = tuple(_matcher(x, strict_lookaround) for x in value)
            else:
                raise InvalidPattern(f"field {key!r} needs a list or an object")

    walk(text, ())
    return Pattern(tuple((p, m) for p, m in found.items() if m))


#: how much work a matcher is, for cheap conjuncts first
COST = {"exists": 0, "missing": 0, "number": 1, "numeric": 1, "exact": 1, "prefix": 2, "suffix": 2, "anything-but": 2, "anything-but-numeric": 2, "equals-ignore-case": 3, "wildcard": 4, "cidr": 6, "regexp": 8}


def cost(matchers: tuple[Matcher, ...]) -> int:
    return max(COST[m.op] for m in matchers)
