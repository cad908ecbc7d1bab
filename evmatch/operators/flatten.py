"""Flatteners: from rows to the leaves at the paths that patterns use.

A flattener takes a DataFrame and paths and returns the DataFrame to go on with and, per path, a
Column of ``array<struct<v, d, trail>>``.

* ``TypedFlattener``    struct, array and map columns; expressions only
* ``VariantFlattener``  JSON text through VARIANT; expressions only, numbers in Spark's own notation
* ``ExactFlattener``    JSON text token by token in Arrow batches: raw numbers, repeated keys, errors

Only used paths are read, so column and nested-field pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evmatch.errors import InvalidJson
from evmatch.functions.binding import bound
from evmatch.operators.local import Leaf, Reader
from evmatch.plans.pattern import Path

LEAF = "struct<v:string,d:double,trail:array<struct<arr:string,pos:int>>>"
LEAVES = f"array<{LEAF}>"
ERROR = "_event_error"


def fresh(df: DataFrame, name: str) -> str:
    """A name that begins no column's: ``name``, longer by underscores where columns begin so."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


class Flattener(Protocol):
    def __call__(self, df: DataFrame, paths: list[Path]) -> tuple[DataFrame, dict[Path, Column]]: ...


def _leaf(v: Column, d: Column, trail: list[Column]) -> Column:
    steps = F.array(*trail) if trail else F.lit(None).cast("array<struct<arr:string,pos:int>>")
    return F.struct(v.alias("v"), d.alias("d"), F.coalesce(steps, F.array().cast("array<struct<arr:string,pos:int>>")).alias("trail")).cast(LEAF)


def _offsets(sizes: Iterable[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def _none() -> Column:
    return F.array().cast(LEAVES)


def text_of(c: Column, kind: T.DataType) -> Column:
    """How to_json writes a scalar, without quotes."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return c.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.trim(F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$.x"))
    return c.cast("string")


class TypedFlattener:
    """Paths name columns and their fields.  NULL is a missing field, or with ``nulls`` JSON's null."""

    def __init__(self, nulls: bool = False):
        self.nulls = nulls

    def scalar(self, df: DataFrame, path: Path) -> tuple[Column, Column | None] | None:
        """(v, d) of a path without arrays or maps above or at it, with d None for no number."""
        kind, c = df.schema, None
        for key in path:
            if not isinstance(kind, T.StructType) or key not in kind.names:
                return None
            kind = kind[key].dataType
            c = F.col(f"`{key.replace('`', '``')}`") if c is None else c.getField(key)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return None
        v = text_of(c, kind)
        return (F.coalesce(v, F.lit("null")) if self.nulls else v), c.cast("double") if isinstance(kind, T.NumericType) else None

    def element(self, df: DataFrame, path: Path) -> tuple[Path, Column, Callable[[Column], tuple[Column, Column | None]]] | None:
        """(array's path, array, (v, d) of an element) of a path that crosses one array and no map."""
        kind, c, at, inner = df.schema, None, None, []
        for n, key in enumerate((*path, None)):
            if isinstance(kind, T.ArrayType):
                if at is not None:
                    return None
                at, kind = n, kind.elementType
            if key is None:
                break
            if not isinstance(kind, T.StructType) or key not in kind.names:
                return None
            kind = kind[key].dataType
            if at is not None:
                inner.append(key)
            else:
                c = F.col(f"`{key.replace('`', '``')}`") if c is None else c.getField(key)
        if at is None or self.nulls or isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.NullType)):
            return None

        def of(x: Column) -> tuple[Column, Column | None]:
            for key in inner:
                x = x.getField(key)
            return text_of(x, kind), x.cast("double") if isinstance(kind, T.NumericType) else None

        return path[:at], c, of

    def __call__(self, df: DataFrame, paths: list[Path]) -> tuple[DataFrame, dict[Path, Column]]:
        return df, {p: self._at(df, p) for p in paths}

    def _at(self, df: DataFrame, path: Path) -> Column:
        key, *rest = path
        if key not in df.columns:
            return _none()
        return self._walk(F.col(f"`{key.replace('`', '``')}`"), df.schema[key].dataType, rest, [], F.lit(key))

    def _walk(self, c: Column, kind: T.DataType, rest: list[str], trail: list[Column], place: Column) -> Column:
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.NullType):
                return _none()

            def element(e: Column, i: Column) -> Column:
                step = F.struct(place.alias("arr"), i.cast("int").alias("pos"))
                return self._walk(e, kind.elementType, rest, [*trail, step], F.concat(place, F.lit("/"), i.cast("string")))

            return F.coalesce(F.flatten(F.transform(c, element)), _none())
        if isinstance(kind, T.StructType):
            if not rest or rest[0] not in kind.names:
                return _none()
            inner = self._walk(c.getField(rest[0]), kind[rest[0]].dataType, rest[1:], trail, F.concat(place, F.lit(f".{rest[0]}")))
            return F.when(c.isNull(), _none()).otherwise(inner) if self.nulls else inner
        if isinstance(kind, T.MapType):
            if not rest or not isinstance(kind.keyType, T.StringType):
                return _none()
            inner = self._walk(F.element_at(c, rest[0]), kind.valueType, rest[1:], trail, F.concat(place, F.lit(f".{rest[0]}")))
            return F.when(F.coalesce(F.map_contains_key(c, rest[0]), F.lit(False)), inner).otherwise(_none())
        if rest:
            return _none()
        d = c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        v = text_of(c, kind)
        if self.nulls:
            return F.array(_leaf(F.coalesce(v, F.lit("null")), d, trail))
        return F.when(c.isNull(), _none()).otherwise(F.array(_leaf(v, d, trail)))


LEVEL = "array<struct<v:variant,trail:array<struct<arr:string,pos:int>>,place:string>>"


class VariantFlattener:
    """JSON text in one column.  Malformed text has no leaves and a note in ``_event_error``.

    A path without arrays is one lookup; arrays are unrolled only in events that have them, ``unrolled``
    levels of arrays within arrays at once and any deeper ones by a loop.  Repeated keys make an event
    malformed.
    """

    def __init__(self, event: str = "event", unrolled: int = 2):
        self.event, self.unrolled = event, unrolled

    def __call__(self, df: DataFrame, paths: list[Path]) -> tuple[DataFrame, dict[Path, Column]]:
        """Values at paths, and their kinds, are columns, so that they are compiled and made once; leaves are arrays."""
        name, error = fresh(df, "_event_variant"), fresh(df, ERROR)
        text = F.col(self.event)
        df = df.withColumn(name, F.when(text.rlike(r"\A[ \t\r\n]*\{"), F.try_parse_json(text)))
        df = df.withColumn(error, F.when(F.col(name).isNull(), F.lit("not a JSON object")))
        values = {p: f"{name}_v{n}" for n, p in enumerate(paths)}
        kinds = {p: f"{name}_k{n}" for n, p in enumerate(paths)}
        df = df.withColumns({values[p]: F.try_variant_get(F.col(name), "$" + "".join(map(self._step, p)), "variant") for p in paths})
        df = df.withColumns({kinds[p]: F.schema_of_variant(F.col(values[p])) for p in paths})
        return df, {p: self._at(F.col(name), F.col(values[p]), F.col(kinds[p]), p) for p in paths}

    def _at(self, whole: Column, v: Column, kind: Column, path: Path) -> Column:
        here = F.array(self._leaf(F.struct(F.array().cast("array<struct<arr:string,pos:int>>").alias("trail")), kind, v))
        # what is not there at once can still be in arrays on the way, if the event's first field is there
        there = F.try_variant_get(whole, "$" + self._step(path[0]), "variant").isNotNull()
        plain = kind.isNotNull() & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
        return F.when(plain, here).when(kind.startswith("OBJECT") | ~there, _none()).otherwise(self._unrolled(whole, path))

    def _unrolled(self, v: Column, path: Path) -> Column:
        """Every level is bound to a name, so that it is made once."""
        steps = F.array().cast("array<struct<arr:string,pos:int>>")
        level = F.array(F.struct(v.alias("v"), steps.alias("trail"), F.lit("").alias("place"))).cast(LEVEL)
        is_array = lambda x: F.schema_of_variant(x["v"]).startswith("ARRAY")
        unroll = lambda x: F.flatten(F.transform(x, self._elements)).cast(LEVEL)
        once = lambda x: F.when(F.exists(x, is_array), unroll(x)).otherwise(x)
        # no more levels than brackets; the loop idles once nothing is left to unroll
        many = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(self.event, F.lit(r"\["))))
        rest = lambda x: F.when(F.exists(x, is_array), F.aggregate(many, x, lambda acc, _: once(acc))).otherwise(x)
        for key in path:
            level = F.filter(F.transform(level, self._field(key)), lambda x: x["v"].isNotNull()).cast(LEVEL)
            for _ in range(self.unrolled):
                level = bound(level, once, LEVEL)
            level = bound(level, rest, LEVEL)
        kinds = F.transform(level, lambda x: F.struct(x["v"].alias("v"), x["trail"].alias("trail"), F.schema_of_variant(x["v"]).alias("kind")))
        scalars = F.filter(kinds, lambda x: ~F.coalesce(x["kind"], F.lit("")).rlike("^(OBJECT|ARRAY)"))
        return F.coalesce(F.transform(scalars, lambda x: self._leaf(x, x["kind"])), _none())

    @staticmethod
    def _leaf(x: Column, kind: Column, v: Column | None = None) -> Column:
        v = x["v"] if v is None else v
        number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        text = F.when(kind == "VOID", F.lit("null")).otherwise(F.try_variant_get(v, "$", "string"))
        return F.struct(text.alias("v"), F.when(number, F.try_variant_get(v, "$", "double")).alias("d"), x["trail"].alias("trail")).cast(LEAF)

    @staticmethod
    def _step(key: str) -> str:
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        return f"['{quoted}']"

    @classmethod
    def _field(cls, key: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.try_variant_get(x["v"], f"${cls._step(key)}", "variant").alias("v"), x["trail"].alias("trail"), F.concat(x["place"], F.lit(f".{key}")).alias("place"))

    @staticmethod
    def _elements(x: Column) -> Column:
        inner = F.transform(
            F.try_variant_get(x["v"], "$", "array<variant>"),
            lambda e, i: F.struct(e.alias("v"), F.concat(x["trail"], F.array(F.struct(x["place"].alias("arr"), i.cast("int").alias("pos")))).alias("trail"), F.concat(x["place"], F.lit("/"), i.cast("string")).alias("place")),
        )
        return F.when(F.schema_of_variant(x["v"]).startswith("ARRAY"), F.filter(inner, lambda e: e["v"].isNotNull())).otherwise(F.array(x))


class ExactFlattener:
    """JSON text or bytes in one column, read strictly; a bad event has no leaves and its error in
    ``_event_error``."""

    def __init__(self, event: str = "event"):
        self.event = event

    def __call__(self, df: DataFrame, paths: list[Path]) -> tuple[DataFrame, dict[Path, Column]]:
        mark, error_name = fresh(df, "_leaves_"), fresh(df, ERROR)
        event, names = self.event, [f"{mark}{n}" for n in range(len(paths))]

        def column(found: list[list[Leaf]]) -> pa.Array:
            """Leaves of each event as one Arrow list column, its children made in one go."""
            flat = [x for one in found for x in one]
            steps = [s for x in flat for s in x.trail]
            inner = pa.StructArray.from_arrays([pa.array([a for a, _ in steps], type=pa.string()), pa.array([i for _, i in steps], type=pa.int32())], ["arr", "pos"])
            trails = pa.ListArray.from_arrays(pa.array(_offsets(len(x.trail) for x in flat), type=pa.int32()), inner)
            leaf = pa.StructArray.from_arrays([pa.array([x.v for x in flat], type=pa.string()), pa.array([x.d for x in flat], type=pa.float64()), trails], ["v", "d", "trail"])
            return pa.ListArray.from_arrays(pa.array(_offsets(map(len, found)), type=pa.int32()), leaf)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(paths)
            for batch in batches:
                cols: list[list[list[Leaf]]] = [[] for _ in paths]
                errors: list[str | None] = []
                for e in batch.column(event).to_pylist():
                    try:
                        found, error = reader(e or ""), None
                    except InvalidJson as x:
                        found, error = [()] * len(paths), str(x)
                    errors.append(error)
                    for out, some in zip(cols, found, strict=True):
                        out.append(some)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(column, cols), pa.array(errors, type=pa.string())], [*batch.schema.names, *names, error_name])

        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(LEAVES)) for n in names), T.StructField(error_name, T.StringType())])
        return df.mapInArrow(each, schema), {p: F.col(n) for p, n in zip(paths, names, strict=True)}
