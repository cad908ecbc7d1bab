"""Patterns on typed columns and one array of them, by classes of values: the fastest plan inside the row.

Values of a field that meet the same conditions are one class.  The classes of a row's fields, and of an element's,
are one number each, and a constant of the plan lists the patterns of every pair of them.  So an element costs a search
for each of its fields and one look, however many patterns there are; elements of equal classes are looked up once.

It is for comparisons: equal texts and numbers, numeric, anything-but and exists.  Sets with other matchers, fields of
several arrays or too many pairs of classes are for the plans that look up conditions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evmatch.functions.binding import bound
from evmatch.operators.flatten import TypedFlattener
from evmatch.plans import inline
from evmatch.plans.inline import TooManyTerms, _Constants, _place
from evmatch.plans.pattern import Matcher, Path, Pattern

#: pairs of classes, and values of a field up to which they are compared one by one
PAIRS, CHAIN = 200_000, 8
Matchers = tuple[Matcher, ...]


class _Field:
    """A field's classes: ``found[matchers]`` are the classes whose values meet a condition, of ``size`` in all; class 0 is
    of no value.

    Atoms are the values that no bound and no other value parts.  They are gone through in order, with the conditions
    that change from one to the next, so a field costs what its classes list and not each condition for each value.
    """

    def __init__(self, conditions: list[Matchers], numeric: bool):
        ops = {m.op for ms in conditions for m in ms}
        if not ops <= {"exact", "number", "numeric", "anything-but", "anything-but-numeric", "exists", "missing"} or numeric and ops & {"exact", "anything-but"}:
            raise TooManyTerms
        self.numeric, every = numeric, [m for ms in conditions for m in ms]
        if numeric:
            found = {x + 0.0 for m in every for x in ([m.number] if m.op == "number" else m.numbers or [x for x in (m.low, m.high) if x is not None])}
            self.said: list = sorted(found)
            self.many, spans = 2 * len(self.said) + 2, self._numbers  # 0: NaN; 2 * k + 1 before the k-th, 2 * k + 2 the k-th
        else:
            self.said = sorted({t for m in every for t in ((m.text,) if m.op in ("exact", "number") else m.texts)}, key=str.encode)
            self.many, spans = len(self.said) + 1, self._texts  # 0: any text that no matcher names
        self.at = {x: n for n, x in enumerate(self.said)}
        changes: dict[int, list[tuple[int, int]]] = {}
        for c, ms in enumerate(conditions):
            for first, end in (span for m in dict.fromkeys(ms) for span in spans(m) if span[0] < span[1]):
                changes.setdefault(first, []).append((c, 1))
                changes.setdefault(end, []).append((c, -1))
        met: list[list[int]] = [[0] if any(m.op == "missing" for m in ms) else [] for ms in conditions]
        place: dict[frozenset[int], int] = {}
        held, least, other = Counter[int](), frozenset[int](), set[int]()  # ``other``: what differs from the first atom's
        listed, self.size, self.classes = sum(map(len, met)), 1, []
        for a in range(self.many):
            for c, by in changes.get(a, ()):
                held[c] += by
            for c in {c for c, _ in changes.get(a, ())}:
                (other.discard if (held[c] > 0) == (c in least) else other.add)(c)
            if not a:
                least, other = frozenset(other), set()
            if not a or a in changes:
                key = frozenset(other)
                if key not in place:
                    place[key], self.size = self.size, self.size + 1
                    now = least ^ key
                    listed += len(now)
                    if listed > inline.INLINE_ENTRIES:  # patterns would be listed as often at least
                        raise TooManyTerms
                    for c in now:
                        met[c].append(place[key])
            self.classes.append(place[key])
        self.found = dict(zip(conditions, met, strict=True))

    def _but(self, atoms: Iterable[int]) -> list[tuple[int, int]]:
        """All atoms but some."""
        edges = sorted(atoms)
        return list(zip([0, *(a + 1 for a in edges)], [*edges, self.many], strict=True))

    def _texts(self, m: Matcher) -> list[tuple[int, int]]:
        """The atoms that a matcher takes, as spans without their end."""
        if m.op in ("exact", "number"):
            return [(self.at[m.text] + 1, self.at[m.text] + 2)]
        if m.op == "anything-but":
            return self._but(self.at[t] + 1 for t in m.texts)
        return [(0, self.many)] if m.op in ("exists", "anything-but-numeric") else []

    def _numbers(self, m: Matcher) -> list[tuple[int, int]]:
        at = lambda x: 2 * self.at[x + 0.0] + 1
        if m.op == "number":
            return [(at(m.number) + 1, at(m.number) + 2)]
        if m.op == "anything-but-numeric":
            return self._but({at(x) + 1 for x in m.numbers})
        if m.op == "exists":
            return [(0, self.many)]
        if m.op != "numeric" or m.low is None and m.high is None:
            return []
        return [(1 if m.low is None else at(m.low) + (1 if m.low_in else 2), self.many if m.high is None else at(m.high) + (2 if m.high_in else 1))]

    def column(self, v: Column, d: Column | None, constant: _Constants) -> Column:
        """The class of a value."""
        first, *rest = self.classes
        if self.numeric:
            known = F.when(d.isNull(), 0).when(F.isnan(d), first)
            if len(self.said) <= CHAIN:
                for n, x in enumerate(self.said):
                    known = known.when(d < x, rest[2 * n]).when(d == x, rest[2 * n + 1])
                return known.otherwise(rest[-1])
            bounds, of = constant(self.said, "array<double>"), constant(rest, "array<int>")
            steps = F.array(*(F.lit(1 << k) for k in range(len(self.said).bit_length() - 1, -1, -1)))
            below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) < d, at + s).otherwise(at))
            return known.otherwise(bound(below, lambda n: F.get(of, n * 2 + F.when(F.get(bounds, n) == d, 1).otherwise(0)), "int"))
        known = F.when(v.isNull(), 0)
        if len(self.said) <= CHAIN:
            for x, k in zip(self.said, rest, strict=True):
                known = known.when(v == x, k)
            return known.otherwise(first)
        return known.otherwise(F.coalesce(F.get(constant(rest, "array<int>"), _place(constant(self.said, "array<string>"), len(self.said), v)), F.lit(first)))


def class_column(df: DataFrame, flattener: TypedFlattener, patterns: list[Pattern], ids: list[str], ordered: bool) -> Column:
    """Ids of the patterns that match a row, each once; TooManyTerms if the set is not for this plan."""
    conditions: dict[Path, dict[Matchers, None]] = {}
    for path, matchers in (f for p in patterns for f in p.fields):
        conditions.setdefault(path, {})[matchers] = None
    fields: dict[Path, _Field] = {}
    outside: dict[Path, tuple[Column, Column | None]] = {}
    within: dict[Path, Callable[[Column], tuple[Column, Column | None]]] = {}
    arrays: dict[Path, Column] = {}
    for path, found in conditions.items():
        if (flat := flattener.scalar(df, path)) is not None:
            outside[path] = flat
            fields[path] = _Field(list(found), flat[1] is not None)
        elif (element := flattener.element(df, path)) is not None and not any(m.op == "missing" for ms in found for m in ms):
            arrays[element[0]], within[path] = element[1], element[2]
            fields[path] = _Field(list(found), _numeric(df, path))
        else:
            raise TooManyTerms
    many = lambda paths: prod(fields[p].size for p in paths)
    if len(arrays) > 1 or many(fields) > PAIRS:
        raise TooManyTerms
    strides = lambda paths: {p: prod(fields[q].size for q in list(paths)[:n]) for n, p in enumerate(paths)}
    out_by, in_by = strides(outside), strides(within)
    alone: list[list[str]] = [[] for _ in range(many(outside))]
    pairs: list[list[list[str]]] = [[[] for _ in range(many(within))] for _ in alone] if arrays else []
    entries = 0
    for pattern, i in zip(patterns, ids, strict=True):
        asked = dict(pattern.fields)
        fine = lambda p: fields[p].found[asked[p]] if p in asked else range(fields[p].size)  # noqa: B023, E731
        keys = lambda by: [sum(k * by[p] for k, p in zip(ks, by, strict=True)) for ks in product(*map(fine, by))]  # noqa: B023, E731
        nested = any(p in within for p in asked)
        entries += prod(len(fine(p)) for p in fields if p in outside or nested)
        if entries > inline.INLINE_ENTRIES:
            raise TooManyTerms
        inside = keys(in_by) if nested else None
        for o in keys(out_by):
            for to in [alone[o]] if inside is None else [pairs[o][k] for k in inside]:
                to.append(i)
    constant = _Constants()
    number = lambda by, of: sum((fields[p].column(*of(p), constant) * by[p] for p in by), F.lit(0))
    row = number(out_by, lambda p: outside[p])
    parts = [F.get(constant(alone, "array<array<string>>"), row)] if any(alone) else []
    if arrays:
        (array,) = arrays.values()
        said = F.array_distinct(F.transform(array, lambda x: number(in_by, lambda p: within[p](x))))
        listed = lambda of: F.flatten(F.transform(said, lambda k: F.get(of, k)))
        parts.append(F.coalesce(bound(F.get(constant(pairs, "array<array<array<string>>>"), row), listed, "array<string>"), F.array().cast("array<string>")))
    if constant.size > inline.INLINE_BYTES:
        raise TooManyTerms
    found = F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts)) if parts else F.array().cast("array<string>")
    return F.sort_array(found) if ordered else found


def _numeric(df: DataFrame, path: Path) -> bool:
    """Whether a path within an array is of numbers."""
    from pyspark.sql import types as T

    kind = df.schema
    for key in path:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[key].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, T.NumericType)


__all__ = ["class_column"]
