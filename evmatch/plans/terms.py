"""Patterns as terms: what a value must say for a condition to hold, whatever kind its matchers are.

A condition is a path with a list of matchers, shared by all patterns that have it.  A value says keys, and a
condition is found under one of the keys that any value meeting it says:

* exact text and numbers      the text; the number
* prefix, suffix              the beginning or ending of that length
* wildcard, shellstyle        the q-gram of its pieces that fewest of the wildcards have; the pieces then decide
* equals-ignore-case          the text with each character as the first of those that fold with it, however far;
                              the characters decide where three fold together
* numeric                     nodes of a tree over the stretches between all bounds: a value says those above its own,
                              at the levels that ranges are found at
* cidr                        the network at each prefix length in use
* anything-but                nothing: the condition holds unless an excluded value is said
* others                      a number for each that holds, which takes an expression each

So the work a value causes depends on what it says, and not on how many patterns there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log2
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.functions import casefold, cidr
from evmatch.functions.binding import bound
from evmatch.functions.predicates import ignore_case_regex, predicate
from evmatch.plans.pattern import Matcher, Path, Pattern

GRAM, CHUNK = 3, 40


class Term(NamedTuple):
    """A condition to be found under a key, with what has to be checked besides: pieces of a wildcard, or a regexp."""

    condition: int
    pieces: tuple[str, ...] | None = None
    exact: str | None = None


@dataclass
class Ways:
    """What a path's values have to say."""

    text: bool = False
    number: bool = False
    starts: set[int] = field(default_factory=set)
    ends: set[int] = field(default_factory=set)
    grams: set[int] = field(default_factory=set)
    blocks: set[tuple[int, int]] = field(default_factory=set)
    folded: bool = False
    bounds: list[float] = field(default_factory=list)
    #: levels of the tree, from the leaves, that have terms
    levels: set[int] = field(default_factory=set)
    others: dict[Matcher, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        """Leaves of the tree over the stretches between the bounds."""
        return 1 << (2 * len(self.bounds)).bit_length()


def _grams(parts: tuple[str, ...]) -> set[str]:
    q = min(GRAM, max(map(len, parts)))
    return {p[k : k + q] for p in parts for k in range(len(p) - q + 1)}


def prefix_length(block: cidr.Block) -> int:
    return (32 if block.version == 4 else 128) - round(log2(block.high - block.low + 1))


def _network(block: cidr.Block) -> str:
    n = prefix_length(block)
    if block.version == 4:
        return f"4/{n}:{block.low}"
    return f"6/{n}:{f'{block.low:032x}'[: -(-n // 4)]}"


class Terms:
    """Patterns' conditions, the terms they are found under, and what values have to say.

    ``complement`` asks for anything-but by complement: ``negative`` conditions hold for values that say none of
    their excluded keys.
    """

    def __init__(self, patterns: list[Pattern], paths: list[Path], complement: bool = False):
        self.paths = paths
        self.ways = [Ways() for _ in paths]
        self.said: dict[tuple[int, str], list[Term]] = defaultdict(list)
        self.numbers: dict[tuple[int, float], list[Term]] = defaultdict(list)
        self.nodes: dict[tuple[int, int], list[Term]] = defaultdict(list)
        self.excluded: dict[tuple[int, str | float], list[int]] = defaultdict(list)
        self.negative: dict[int, int] = {}  # condition, path
        self.absent: dict[int, list[int]] = defaultdict(list)
        self.conditions: dict[tuple[int, tuple[Matcher, ...]], int] = {}
        #: conditions that are found under keys alone
        self.keyed: set[int] = set()
        self._wild: list[tuple[int, int, tuple[str, ...]]] = []
        self._ranges: dict[int, list[tuple[Matcher, int]]] = defaultdict(list)
        at = {p: n for n, p in enumerate(paths)}
        for pattern in patterns:
            for path, matchers in pattern.fields:
                if (at[path], matchers) not in self.conditions:
                    self.conditions[at[path], matchers] = len(self.conditions)
        for (path, matchers), c in self.conditions.items():
            without = [m for m in matchers if m.op.startswith("anything-but")]
            by_complement = complement and len(without) == 1
            if by_complement:
                self.negative[c] = path
            else:
                self.keyed.add(c)
            for m in dict.fromkeys(matchers):
                if by_complement and m in without:
                    self._exclude(path, m, c)
                else:
                    self._add(path, m, c)
        self._place_wildcards()
        for path, ranges in self._ranges.items():
            self._place_ranges(path, ranges)
        asked = [[self.conditions[at[p], ms] for p, ms in x.fields] for x in patterns]
        shared = Counter(c for cs in asked for c in cs if c in self.keyed)
        #: (pattern, the condition that fewest patterns share, or None if none is found under keys; all its conditions)
        self.patterns = [(n, min((c for c in cs if c in self.keyed), key=lambda c: (shared[c], c), default=None), cs) for n, cs in enumerate(asked)]
        #: whether a value can meet a condition in one way only
        self.once = all(len(matchers) == 1 for _, matchers in self.conditions)

    def _add(self, path: int, m: Matcher, c: int) -> None:
        ways = self.ways[path]
        say = lambda key, *check: self.said[path, key].append(Term(c, *check))
        if m.op == "exact" or m.op == "wildcard" and len(m.pieces) == 1:
            ways.text = True
            say("s" + (m.text if m.op == "exact" else m.pieces[0]))
        elif m.op == "number":
            ways.number = True
            self.numbers[path, m.number + 0.0].append(Term(c))
            say("t" + m.text)
        elif m.op in ("prefix", "suffix"):
            (ways.starts if m.op == "prefix" else ways.ends).add(len(m.text))
            say(f"{'p' if m.op == 'prefix' else 'x'}{len(m.text)}:{m.text}")
        elif m.op == "missing":
            self.absent[path].append(c)
        elif m.op == "wildcard" and any(m.pieces):
            self._wild.append((path, c, m.pieces))
        elif m.op == "equals-ignore-case":
            ways.folded = True
            say("i" + casefold.folded(m.text), None, ignore_case_regex(m.text))
        elif m.op == "numeric":
            self._ranges[path].append((m, c))
        elif m.op == "cidr":
            ways.blocks.add((m.block.version, prefix_length(m.block)))
            say(_network(m.block))
        else:
            k = ways.others.setdefault(m, len(ways.others))
            say(f"r{k}")

    def _exclude(self, path: int, m: Matcher, c: int) -> None:
        if m.op == "anything-but":
            self.ways[path].text = True
        for x in m.texts:
            self.excluded[path, "s" + x].append(c)
        for x in m.numbers:
            self.ways[path].number = True
            self.excluded[path, x + 0.0].append(c)

    def _place_wildcards(self) -> None:
        shared = Counter((path, g) for path, _, parts in self._wild for g in _grams(parts))
        for path, c, parts in self._wild:
            gram = min(_grams(parts), key=lambda g: (shared[path, g], g))
            self.ways[path].grams.add(len(gram))
            self.said[path, f"w{len(gram)}:{gram}"].append(Term(c, parts))

    def _place_ranges(self, path: int, ranges: list[tuple[Matcher, int]]) -> None:
        """Stretch 2 * k lies before the k-th bound, 2 * k + 1 is the bound itself."""
        ways = self.ways[path]
        ways.bounds = sorted({x + 0.0 for m, _ in ranges for x in (m.low, m.high) if x is not None})
        at = {x: n for n, x in enumerate(ways.bounds)}
        for m, c in ranges:
            if m.low is None and m.high is None:
                continue
            lo = 0 if m.low is None else 2 * at[m.low + 0.0] + (1 if m.low_in else 2)
            hi = 2 * len(at) if m.high is None else 2 * at[m.high + 0.0] + (1 if m.high_in else 0)
            lo, hi, level, term = lo + ways.size, hi + ways.size + 1, 0, Term(c)
            while lo < hi:
                for edge in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                    self.nodes[path, edge].append(term)
                    ways.levels.add(level)
                lo, hi, level = (lo + 1) >> 1, hi >> 1, level + 1

    # ---- what a value says

    def texts(self, path: int, v: Column, d: Column) -> Column:
        """Array of the keys that are texts."""
        ways = self.ways[path]
        said = [F.concat(F.lit("s"), v)] if ways.text else []
        if ways.number:
            said.append(F.when(d.isNull(), F.concat(F.lit("t"), v)))
        for n in sorted(ways.starts):
            said.append(F.concat(F.lit(f"p{n}:"), F.substring(v, 1, n)) if n else F.lit("p0:"))
        for n in sorted(ways.ends):
            said.append(F.concat(F.lit(f"x{n}:"), F.right(v, F.lit(n))) if n else F.lit("x0:"))
        if ways.folded:
            said.append(F.concat(F.lit("i"), casefold.folded_column(v)))
        said += [F.when(F.coalesce(predicate(m, v, d), F.lit(False)), F.lit(f"r{k}")) for m, k in ways.others.items()]
        parts = [F.array_compact(F.array(*said[i : i + CHUNK])) for i in range(0, len(said), CHUNK)]
        none = F.array().cast("array<string>")
        if ways.grams:
            parts.append(bound(F.split(v, ""), lambda c: F.array_distinct(F.concat(*(self._grams_of(c, q) for q in sorted(ways.grams)))), "array<string>"))
        for version, of in ((4, cidr.v4_number), (6, cidr.v6_digits)):
            lengths = sorted(n for found, n in ways.blocks if found == version)
            if lengths:
                parts.append(bound(of(v), self._networks(lengths, self._v4 if version == 4 else self._v6), "array<string>"))
        return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else none

    @staticmethod
    def _grams_of(chars: Column, q: int) -> Column:
        rest = lambda c, i: F.concat(F.lit(f"w{q}:"), c, *(F.get(chars, i + k) for k in range(1, q)))
        return F.array_compact(F.transform(chars, rest))  # null at the end, where characters lack

    @staticmethod
    def _networks(lengths: list[int], network: Callable[[Column, int], Column]) -> Callable[[Column], Column]:
        return lambda x: F.when(x.isNotNull(), F.array(*(network(x, n) for n in lengths))).otherwise(F.array().cast("array<string>"))

    @staticmethod
    def _v4(x: Column, n: int) -> Column:
        return F.concat(F.lit(f"4/{n}:"), (x - x % (1 << 32 - n)).cast("string"))

    @staticmethod
    def _v6(x: Column, n: int) -> Column:
        whole, bits = divmod(n, 4)
        last = [F.lower(F.hex(F.conv(F.substring(x, whole + 1, 1), 16, 10).cast("int").bitwiseAND(0xF & -(1 << 4 - bits))))] if bits else []
        return F.concat(F.lit(f"6/{n}:"), F.substring(x, 1, whole) if whole else F.lit(""), *last)

    def node_numbers(self, path: int, d: Column, bounds: Column) -> Column:
        """Nodes of the tree above the stretch that a number lies in; none for no number.  ``bounds`` is the path's
        sorted bounds as one constant."""
        ways = self.ways[path]
        steps = F.array(*(F.lit(1 << k) for k in range(len(ways.bounds).bit_length() - 1, -1, -1)))
        below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) < d, at + s).otherwise(at))
        levels = F.array(*map(F.lit, sorted(ways.levels))).cast("array<int>")

        def above(n: Column) -> Column:
            leaf = n * 2 + F.when(F.get(bounds, n) == d, 1).otherwise(0) + ways.size
            return F.transform(levels, lambda k: F.call_function("shiftright", leaf, k))

        return F.when(d.isNotNull() & ~F.isnan(d), bound(below, above, "array<int>")).otherwise(F.array().cast("array<int>"))


def fits(v: Column, pieces: Column) -> Column:
    """Whether a value is the pieces in order, the first and last at its ends, found from left to right."""
    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)

    def after(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, v, at)
        return F.when((at > 0) & (piece != ""), F.when(found > 0, found + F.char_length(piece)).otherwise(0)).otherwise(at)

    end = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces) - 2), F.char_length(first) + 1, after)
    return F.call_function("startswith", v, first) & F.call_function("endswith", v, last) & bound(end, lambda e: (e > 0) & (e - 1 + F.char_length(last) <= F.char_length(v)), "boolean")


def same_letters(v: Column, exact: Column) -> Column:
    """Whether a value with a pattern's key matches it without regard to case: it does unless a character is one of
    three that fold together."""
    return ~F.concat(v, exact).rlike(casefold.third_of()) | F.call_function("rlike", v, exact)


__all__ = ["Term", "Terms", "Ways", "fits", "same_letters"]
