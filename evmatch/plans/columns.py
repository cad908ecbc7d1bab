"""Patterns as boolean Columns: the plan for few patterns.

A field without arrays is a comparison on its column, which reaches the scan.  Otherwise a field is a
set of candidate trails; fields are folded into sets of trails that agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evmatch.functions.predicates import any_of
from evmatch.operators.flatten import TypedFlattener
from evmatch.plans.pattern import Matcher, Path, Pattern, cost

STEPS = "array<struct<arr:string,pos:int>>"


def _scalar(matchers: tuple[Matcher, ...], v: Column, d: Column | None) -> Column:
    found = any_of(matchers, v, d)
    if any(m.op == "missing" for m in matchers):
        return v.isNull() | found
    return found if all(m.op in ("exact", "prefix", "exists") for m in matchers) else v.isNotNull() & found


def agree(a: Column, t: Column) -> Column:
    return ~F.exists(a, lambda x: F.exists(t, lambda y: (x["arr"] == y["arr"]) & (x["pos"] != y["pos"])))


def _holds(matchers: tuple[Matcher, ...]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(any_of(matchers, x["v"], x["d"]), F.lit(False))


def _joined(trails: Column) -> Callable[[Column], Column]:
    return lambda a: F.transform(F.filter(trails, lambda x: agree(a, x)), lambda x: F.array_union(a, x))


def _element_holds(fields: list[tuple[Callable, tuple[Matcher, ...]]]) -> Callable[[Column], Column]:
    def holds(x: Column) -> Column:
        whole: Column | None = None
        for of, matchers in fields:
            v, d = of(x)
            one = v.isNotNull() & any_of(matchers, v, d)
            whole = one if whole is None else whole & one
        return F.coalesce(whole, F.lit(False))

    return holds


def pattern_column(
    pattern: Pattern, scalar: Callable[[Path], tuple[Column, Column | None] | None], leaves: dict[Path, Column], arrays: Callable[[Path], bool], element: Callable = lambda path: None
) -> Column:
    """Whether a row matches; null counts as no.  Cheap fields come first.

    Fields that cross one array each, and never ask for absence, need one element of each array that holds
    for all fields in it; trails are folded only where arrays are within arrays.
    """
    if not pattern.fields:
        return F.lit(False)
    fields = sorted(pattern.fields, key=lambda f: cost(f[1]))
    conjuncts: list[Column] = []
    nested = [f for f in fields if scalar(f[0]) is None]
    within = [(f, None if any(m.op == "missing" for m in f[1]) else element(f[0])) for f in nested if arrays(f[0])]
    if within and all(e for _, e in within):
        by_array: dict[Path, tuple[Column, list]] = {}
        for (_, matchers), (at, array, of) in within:
            by_array.setdefault(at, (array, []))[1].append((of, matchers))
        conjuncts += [F.coalesce(F.exists(array, _element_holds(some)), F.lit(False)) for array, some in by_array.values()]
        done = [f for f, _ in within]
        nested = [f for f in nested if f not in done]
    conjuncts = [_scalar(matchers, *flat) for path, matchers in fields if (flat := scalar(path)) is not None] + conjuncts
    must = [f for f in nested if not any(m.op == "missing" for m in f[1])]
    free = [f for f in nested if f not in must]
    bound = [f for f in nested if arrays(f[0])]
    together = len(bound) > 1
    for path, matchers in nested:
        here = leaves[path]
        some = F.exists(here, _holds(matchers))
        if (path, matchers) in free:
            only = all(m.op == "missing" for m in matchers)
            conjuncts.append(F.size(here) == 0 if only else (F.size(here) == 0) | some)
        else:
            conjuncts.append(some)
    if together:
        found = F.array(F.array().cast(STEPS))
        for path, matchers in bound:
            trails = F.array_distinct(F.transform(F.filter(leaves[path], _holds(matchers)), lambda x: x["trail"]))
            if any(m.op == "missing" for m in matchers):
                trails = F.when(F.size(leaves[path]) == 0, F.array(F.array().cast(STEPS))).otherwise(trails)
            found = F.array_distinct(F.flatten(F.transform(found, _joined(trails))))
        conjuncts.append(F.size(found) > 0)
    whole = conjuncts[0]
    for c in conjuncts[1:]:
        whole = whole & c
    return whole


def typed_scalars(df: DataFrame, flattener: TypedFlattener) -> Callable[[Path], tuple[Column, Column | None] | None]:
    return lambda path: flattener.scalar(df, path)


def has_array(df: DataFrame, path: Path) -> bool:
    """Whether a typed path crosses an array."""
    from pyspark.sql import types as T

    kind = df.schema
    for key in path:
        while isinstance(kind, T.ArrayType):
            return True
        if isinstance(kind, T.StructType):
            if key not in kind.names:
                return False
            kind = kind[key].dataType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        else:
            return False
    return isinstance(kind, T.ArrayType)
