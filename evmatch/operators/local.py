"""One event at a time, in plain Python: what the distributed plans must agree with."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from typing import Any, NamedTuple

from evmatch.errors import InvalidJson
from evmatch.functions import wildcard
from evmatch.functions.iregexp import for_python
from evmatch.functions.predicates import ignore_case_regex
from evmatch.plans.pattern import Matcher, Path, Pattern

Trail = tuple[tuple[str, int], ...]


class Leaf(NamedTuple):
    """A value with the array positions it was found at."""

    v: str
    d: float | None = None
    trail: Trail = ()


class _Token(str):
    """The text of a number as it stands."""


class _Pairs(list):
    """An object with every occurrence of a key."""


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_float=_Token, parse_int=_Token, parse_constant=_refuse, object_pairs_hook=_Pairs)
_LONE = re.compile("[\ud800-\udfff]")


def read(event: str | bytes) -> _Pairs:
    """Strict JSON of one object; lone surrogates are dropped from its strings later."""
    try:
        if isinstance(event, bytes):
            event = event.decode("utf-8")
        found = _DECODER.decode(event.strip(" \t\r\n"))
    except (ValueError, RecursionError) as e:
        raise InvalidJson(str(e)) from None
    if not isinstance(found, _Pairs):
        raise InvalidJson("an event is an object")
    return found


class Reader:
    """Reads the leaves at given paths, a list for each path, in order.

    An array's elements are at the array's own path; an empty array and an object are no leaves; each
    occurrence of a repeated key counts.
    """

    def __init__(self, paths: Iterable[Path]):
        self.tree: dict = {}
        self.many = 0
        for p in paths:
            node = self.tree
            for key in p:
                node = node.setdefault(key, {})
            node[None] = self.many
            self.many += 1

    def __call__(self, event: str | bytes) -> list[list[Leaf]]:
        found: list[list[Leaf]] = [[] for _ in range(self.many)]
        self._object(read(event), self.tree, (), "", found)
        return found

    def _object(self, pairs: _Pairs, node: dict, trail: Trail, place: str, found: list[list[Leaf]]) -> None:
        for n, (key, value) in enumerate(pairs):
            if key in node:
                self._put(value, node[key], trail, f"{place}/{n}", found)

    def _put(self, value: Any, node: dict, trail: Trail, place: str, found: list[list[Leaf]]) -> None:
        if isinstance(value, _Pairs):
            self._object(value, node, trail, place, found)
        elif isinstance(value, list):
            for n, inner in enumerate(value):
                self._put(inner, node, (*trail, (place, n)), f"{place}/{n}", found)
        elif None in node:
            if isinstance(value, _Token):
                leaf = Leaf(str(value), float(value), trail)
            elif isinstance(value, str):
                leaf = Leaf(value if value.isascii() else _LONE.sub("", value), None, trail)
            else:
                leaf = Leaf(json.dumps(value), None, trail)
            found[node[None]].append(leaf)


def leaves(event: str | bytes, paths: Iterable[Path]) -> dict[Path, list[Leaf]]:
    """The leaves at the given paths, by path."""
    paths = list(paths)
    return dict(zip(paths, Reader(paths)(event), strict=True))


@lru_cache(4096)
def _regex(pattern: str) -> Any:
    import regex

    return regex.compile(for_python(pattern))


def holds(m: Matcher, leaf: Leaf) -> bool:
    v, d = leaf.v, leaf.d
    if m.op == "exists":
        return True
    if m.op == "exact":
        return v == m.text
    if m.op == "number":
        return d == m.number if d is not None else v == m.text
    if m.op == "prefix":
        return v.startswith(m.text)
    if m.op == "suffix":
        return v.endswith(m.text)
    if m.op == "wildcard":
        return wildcard.matches(v, m.pieces)
    if m.op == "anything-but":
        return v not in m.texts
    if m.op == "anything-but-numeric":
        return d is None or d not in m.numbers
    if m.op == "equals-ignore-case":
        return _regex(ignore_case_regex(m.text)).search(v) is not None
    if m.op == "numeric":
        if d is None or m.low is None and m.high is None:
            return False
        return (m.low is None or d > m.low or m.low_in and d == m.low) and (m.high is None or d < m.high or m.high_in and d == m.high)
    if m.op == "cidr":
        return m.block.holds(v)
    if m.op == "regexp":
        return all(c.holds(v) for c in m.conditions)
    return False


def agree(a: Trail, b: Trail) -> bool:
    """No array is entered at two places."""
    return not any(x == y and i != j for x, i in a for y, j in b)


def matches(pattern: Pattern, found: dict[Path, list[Leaf]]) -> bool:
    """Every field holds, by leaves whose array positions agree; a pattern without fields never does."""
    if not pattern.fields:
        return False
    chosen: set[Trail] = {()}
    for path, matchers in pattern.fields:
        here = found.get(path, [])
        if not here and any(m.op == "missing" for m in matchers):
            continue
        fitting = {leaf.trail for leaf in here if any(holds(m, leaf) for m in matchers if m.op != "missing")}
        chosen = {tuple(sorted({*a, *t})) for a in chosen for t in fitting if agree(a, t)}
        if not chosen:
            return False
    return True
