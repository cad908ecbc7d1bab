"""Many patterns inside the row: the plan for arrays, JSON and matchers of every kind.

The terms of a pattern set are constants of the plan.  What a value says is searched for in sorted keys, which gives
the conditions it meets, with its positions in arrays; a pattern is a candidate once the condition that fewest
patterns share is met, and its other conditions are looked for among those of the row, by values whose array
positions agree.  Nothing is exploded, moved or numbered, so batches and streams are matched alike.

It is for sets of up to INLINE_ENTRIES terms whose constants have up to INLINE_BYTES; the join plan takes larger ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from evmatch.functions.binding import bound
from evmatch.plans.columns import STEPS, agree
from evmatch.plans.pattern import Path, Pattern
from evmatch.plans.terms import Term, Terms, fits, same_letters

#: elements of an array whose places are the bits of a number
BITS = 63
INLINE_BYTES, INLINE_ENTRIES = 6 << 20, 500_000
INTS = "array<int>"
LEAF = f"struct<path:int,met:{INTS},ex:{INTS},trail:{STEPS}>"
GOT = f"array<{LEAF}>"


class TooManyTerms(Exception):
    """The set is for the join plan."""


class _Constants:
    """Python values as columns that the optimizer makes constants of; they count what they take."""

    def __init__(self) -> None:
        self.size = 0

    def __call__(self, value: Any, kind: str) -> Column:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        self.size += len(text)
        return F.from_json(F.lit(text), kind)


def _place(keys: Column, many: int, x: Column) -> Column:
    """Where x is in sorted keys, or null."""
    steps = F.array(*(F.lit(1 << k) for k in range(many.bit_length() - 1, -1, -1)))
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(keys, at + s - 1) < x, at + s).otherwise(at))
    return bound(below, lambda at: F.when(F.get(keys, at) == x, at), "int")


def _none() -> Column:
    return F.array().cast(INTS)


class InRow:
    """A pattern set as one expression over the leaves of a row."""

    def __init__(self, patterns: list[Pattern], paths: list[Path], ids: list[str], arrays: bool = True):
        t = self.terms = Terms(patterns, paths, complement=True)
        self.entries = sum(len(x) for found in (t.said, t.numbers, t.nodes, t.excluded) for x in found.values())
        if self.entries > INLINE_ENTRIES:
            raise TooManyTerms
        self.ids, self.arrays, self.constant = ids, arrays, _Constants()
        self.checked: list[Term] = []
        self.tables = [self._table(n) for n in range(len(paths))]
        by: list[list[int]] = [[] for _ in t.conditions]
        for n, lead, _ in t.patterns:
            if lead is not None:
                by[lead].append(n)
        self.by, self.always = self.constant(by, f"array<{INTS}>"), [n for n, lead, _ in t.patterns if lead is None]
        self.asked = self.constant([cs for _, _, cs in t.patterns], f"array<{INTS}>")
        #: whether what a condition is met with are the ids themselves
        self.alone = all(lead is not None and len(cs) == 1 for _, lead, cs in t.patterns)
        self.names = self.constant([list(dict.fromkeys(ids[n] for n in ns)) for ns in by], "array<array<string>>") if self.alone else self.constant(ids, "array<string>")
        self.without = self.constant([t.negative.get(c, -1) for c in range(len(t.conditions))], INTS)
        if self.constant.size > INLINE_BYTES:
            raise TooManyTerms

    def _entry(self, term: Term) -> int:
        """The condition, or, for one to be checked, its place among those as a negative number."""
        if term.pieces is None and term.exact is None:
            return term.condition
        self.checked.append(term)
        return -len(self.checked)

    def _table(self, n: int) -> dict[str, Any]:
        t = self.terms
        found: dict[str, Any] = {"checked": len(self.checked)}
        for name, kind, said in (("texts", "string", t.said), ("numbers", "double", t.numbers)):
            mine = {k for path, k in [*said, *t.excluded] if path == n and isinstance(k, str) == (kind == "string")}
            keys = sorted(mine, key=lambda k: k.encode() if isinstance(k, str) else k)
            met, ex = [[self._entry(x) for x in said.get((n, k), ())] for k in keys], [t.excluded.get((n, k), []) for k in keys]
            found[name] = (len(keys), self.constant(keys, f"array<{kind}>"), self.constant(met, f"array<{INTS}>"), self.constant(ex, f"array<{INTS}>")) if keys else None
        if t.ways[n].bounds:
            nodes = [[x.condition for x in t.nodes.get((n, k), ())] for k in range(2 * t.ways[n].size)]
            found["nodes"] = (self.constant(t.ways[n].bounds, "array<double>"), self.constant(nodes, f"array<{INTS}>"))
        found["checks"] = len(self.checked) > found.pop("checked")
        return found

    def column(self, leaves: list[Column], ordered: bool = True) -> Column:
        """Ids of the patterns that match, each once, from each path's array of leaves; sorted unless told not to."""
        self.ordered = ordered
        if self.checked:
            self.pieces = self.constant([list(x.pieces) if x.pieces is not None else None for x in self.checked], "array<array<string>>")
            self.exact = self.constant([x.exact for x in self.checked], "array<string>")
            self.of = self.constant([x.condition for x in self.checked], INTS)
        told = [bound(x, self._told(n), GOT) if n in self.terms.absent else F.transform(x, self._leaf(n)) for n, x in enumerate(leaves)]
        got = told[0] if len(told) == 1 else F.concat(*told)
        row = f"struct<got:{GOT},has:{INTS}" + (",bits:array<bigint>>" if self.arrays and not self.alone else ">")
        return bound(bound(got.cast(GOT), self._row, row), self._found, "array<string>")

    def _holds(self, x: Column, c: Column) -> Column:
        """Whether a leaf meets a condition."""
        met = F.array_contains(x["met"], c)
        return met | (x["path"] == F.get(self.without, c)) & ~F.array_contains(x["ex"], c) if self.terms.negative else met

    def _elements(self, got: Column) -> Callable[[Column], Column]:
        """The elements of the one array in which a condition holds, as bits; all of them if it holds outside."""
        bit = lambda x: F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.get(x["trail"], F.lit(0))["pos"]), F.lit(-1).cast("long"))
        return lambda c: F.aggregate(got, F.lit(0).cast("long"), lambda acc, x: F.when(self._holds(x, c), acc.bitwiseOR(bit(x))).otherwise(acc))

    def _row(self, got: Column) -> Column:
        """What all leaves of a row say; with ``bits`` of each condition met, if they lie in one array at most, in its
        first BITS elements."""
        met = F.array_distinct(F.flatten(F.transform(got, lambda x: x["met"])))
        if not self.arrays or self.alone:
            return F.struct(got.alias("got"), met.alias("has"))
        steps = F.flatten(F.transform(got, lambda x: x["trail"]))
        one = F.size(F.array_distinct(F.transform(steps, lambda s: s["arr"]))) <= 1
        flat = one & ~F.exists(got, lambda x: F.size(x["trail"]) > 1) & ~F.exists(steps, lambda s: s["pos"] >= BITS)
        whole = lambda has: F.struct(got.alias("got"), has.alias("has"), F.when(flat, F.transform(has, self._elements(got))).alias("bits"))
        return bound(met, whole, f"struct<got:{GOT},has:{INTS},bits:array<bigint>>")

    def _told(self, n: int) -> Callable[[Column], Column]:
        """Leaves of a path for whose absence some condition asks."""
        nothing = F.array(F.struct(F.lit(-2).alias("path"), F.array(*map(F.lit, self.terms.absent[n])).alias("met"), _none().alias("ex"), F.array().cast(STEPS).alias("trail")))
        return lambda x: F.when(F.size(x) == 0, nothing).otherwise(F.transform(x, self._leaf(n)))

    def _leaf(self, n: int) -> Callable[[Column], Column]:
        table, terms = self.tables[n], self.terms

        def said(lookups: list[tuple[Column, Column]]) -> Column:
            """Conditions met under the places of keys, of (array of places, table)."""
            under = lambda t: lambda k: F.coalesce(F.get(t, k), _none())
            parts = [F.flatten(F.transform(at, under(t))) for at, t in lookups]
            return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else _none()

        def leaf(x: Column) -> Column:
            v, d = x["v"], x["d"]
            none = F.array().cast(INTS)
            texts = F.transform(terms.texts(n, v, d), lambda k: _place(table["texts"][1], table["texts"][0], k)) if table["texts"] else none
            number = F.when(d.isNotNull(), F.array(_place(table["numbers"][1], table["numbers"][0], d))).otherwise(none) if table["numbers"] else none
            nodes = terms.node_numbers(n, d, table["nodes"][0]) if "nodes" in table else none

            def made(at: Column) -> Column:
                ways = [(at[name], name) for name in ("texts", "numbers") if table[name]]
                met = said([(k, table[name][2]) for k, name in ways] + ([(at["nodes"], table["nodes"][1])] if "nodes" in table else []))
                ex = said([(k, table[name][3]) for k, name in ways]) if n in terms.negative.values() else none
                met = self._fitting(met, v) if table["checks"] else met
                return F.struct(F.lit(n).alias("path"), met.alias("met"), ex.alias("ex"), x["trail"].alias("trail"))

            return bound(F.struct(texts.alias("texts"), number.alias("numbers"), nodes.alias("nodes")), made, LEAF)

        return leaf

    def _fitting(self, met: Column, v: Column) -> Column:
        def fine(k: Column) -> Column:
            pieces, exact = F.get(self.pieces, -k - 1), F.get(self.exact, -k - 1)
            return F.when(k >= 0, True).when(pieces.isNotNull(), fits(v, pieces)).otherwise(same_letters(v, exact))

        return F.transform(F.filter(met, fine), lambda k: F.when(k < 0, F.get(self.of, -k - 1)).otherwise(k))

    def _once(self, found: Column) -> Column:
        found = found if len(set(self.ids)) == len(self.ids) else F.array_distinct(found)
        return F.sort_array(found) if self.ordered else found

    def _found(self, row: Column) -> Column:
        got, has, negative = row["got"], row["has"], self.terms.negative
        if self.alone:
            return self._once(F.flatten(F.transform(has, lambda c: F.get(self.names, c))))
        candidates = F.flatten(F.transform(has, lambda c: F.get(self.by, c)))
        if self.always:
            candidates = F.concat(candidates, self.constant(self.always, INTS))

        def held(c: Column) -> Column:
            met = F.array_contains(has, c)
            return met | F.exists(got, lambda x: self._holds(x, c)) if negative else met

        def bits(c: Column) -> Column:
            known = F.array_position(has, c).cast("int")
            return F.when(known > 0, F.get(row["bits"], known - 1)).otherwise(self._elements(got)(c) if negative else F.lit(0).cast("long"))

        def meet(acc: Column, c: Column) -> Column:
            fitting = lambda a: F.filter(got, lambda x: self._holds(x, c) & agree(a, x["trail"]))
            return F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(fitting(a), lambda x: F.array_union(a, x["trail"])))))

        def of(conditions: Column) -> Column:
            if not self.arrays:
                return F.forall(conditions, held)
            same = F.aggregate(conditions, F.lit(-1).cast("long"), lambda acc, c: F.when(acc == 0, acc).otherwise(acc.bitwiseAND(bits(c)))) != 0
            together = F.size(F.aggregate(conditions, F.array(F.array().cast(STEPS)), meet)) > 0
            return F.when(row["bits"].isNotNull(), same).otherwise(F.forall(conditions, held) & ((F.size(conditions) == 1) | together))

        matches = lambda p: bound(F.get(self.asked, p), of, "boolean")
        return self._once(F.transform(F.filter(candidates, matches), lambda p: F.get(self.names, p)))
