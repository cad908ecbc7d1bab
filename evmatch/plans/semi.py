"""Whether rows match anything, for many patterns: a filter that reaches the scan, then semi joins.

Patterns that are found by equality or by a beginning say between which values a column has to be; files and row
groups without such values are not read.  Where patterns are of one field each, rows are then kept by a semi join with
the values, and no list of patterns is made.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evmatch.operators.flatten import TypedFlattener, fresh
from evmatch.plans.join import LOOKUPS, quoted, sized
from evmatch.plans.pattern import Matcher, Path, Pattern

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: values up to which a column's filter names them
NAMED = 200


def _column(df: DataFrame, path: Path) -> tuple[Column, T.DataType] | None:
    """A column or a field of one, as it is stored."""
    kind, c = df.schema, None
    for key in path:
        if not isinstance(kind, T.StructType) or key not in kind.names:
            return None
        kind, c = kind[key].dataType, quoted(key) if c is None else c.getField(key)
    return None if c is None else (c, kind)


def _after(prefix: str) -> str | None:
    """The least text behind all that begin so."""
    while prefix:
        c = ord(prefix[-1]) + 1
        if c <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if c == 0xD800 else c)
        prefix = prefix[:-1]
    return None


def _span(matchers: tuple[Matcher, ...], kind: T.DataType) -> list[tuple[str | float, str | float, bool]] | None:
    """(least, greatest or the first behind, exact) of the values that each matcher takes; None if that is not known."""
    found = []
    for m in matchers:
        if isinstance(kind, T.StringType) and m.op in ("exact", "number"):
            found.append((m.text, m.text, True))
        elif isinstance(kind, T.StringType) and m.op == "prefix" and (end := _after(m.text)) is not None:
            found.append((m.text, end, False))
        elif isinstance(kind, (T.DoubleType, *WHOLE)) and m.op == "number" and abs(m.number) < 1 << 53:
            found.append((m.number, m.number, True))
        else:
            return None
    return found


def scan_filter(df: DataFrame, patterns: list[Pattern]) -> Column | None:
    """A comparison of stored columns that every row matching a pattern meets, or None."""
    spans: dict[Path, list[tuple[str | float, str | float, bool]]] = {}
    stored = cache(lambda path: _column(df, path))
    for p in patterns:
        for path, matchers in p.fields:
            at = stored(path)
            if at and (mine := _span(matchers, at[1])):
                spans.setdefault(path, []).extend(mine)
                break
        else:
            return None
    whole: Column | None = None
    for path, found in spans.items():
        c, kind = stored(path)
        order = (lambda x: x.encode()) if isinstance(kind, T.StringType) else (lambda x: x)
        values = {lo for lo, _, exact in found if exact}
        as_stored = (lambda x: int(x) if x == int(x) else x) if isinstance(kind, WHOLE) else lambda x: x
        if len(values) <= NAMED and all(exact for *_, exact in found):
            one = c.isin([as_stored(x) for x in sorted(values, key=order)])
        else:
            least, greatest = min((lo for lo, _, _ in found), key=order), max((hi for _, hi, _ in found), key=order)
            one = (c >= as_stored(least)) & (c <= as_stored(greatest))
        whole = one if whole is None else whole | one
    return whole


def semi_joined(df: DataFrame, patterns: list[Pattern], flattener: TypedFlattener) -> DataFrame | None:
    """The rows that match any of patterns of one field each, found by equality, beginning or ending; else None."""
    ways: dict[tuple[Path, str], dict[str | float, None]] = {}
    plain = cache(lambda path: flattener.scalar(df, path))
    for p in patterns:
        if len(p.fields) != 1 or (scalar := plain(p.fields[0][0])) is None:
            return None
        path, matchers = p.fields[0]
        for m in matchers:
            if m.op == "exact" or m.op == "number" and scalar[1] is None:
                ways.setdefault((path, "s"), {})[m.text] = None
            elif m.op == "number":
                ways.setdefault((path, "n"), {})[m.number + 0.0] = None
            elif m.op in ("prefix", "suffix"):
                ways.setdefault((path, f"{m.op[0]}{len(m.text)}"), {})[m.text] = None
            else:
                return None
    if not 0 < len(ways) <= LOOKUPS:
        return None
    kept, name = df.columns, fresh(df, "_value")
    out, hit = df, F.lit(False)
    for k, ((path, way), values) in enumerate(ways.items()):
        v, d = plain(path)
        said = d + F.lit(0.0) if way == "n" else v if way == "s" else F.substring(v, 1, int(way[1:])) if way[0] == "p" else F.right(v, F.lit(int(way[1:])))
        table = df.sparkSession.createDataFrame(pa.table({f"{name}{k}": pa.array(list(values), type=pa.float64() if way == "n" else pa.string())}))
        keys = sized(table, len(values), sum(24 + 4 * len(str(x)) for x in values))
        out = out.join(keys, said == F.col(f"{name}{k}"), "left_semi" if len(ways) == 1 else "left")
        hit = hit | F.col(f"{name}{k}").isNotNull() if len(ways) > 1 else hit
    return out if len(ways) == 1 else out.filter(hit).select(*map(quoted, kept))
