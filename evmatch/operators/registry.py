"""The registry of patterns, and matching with it.

``PatternSet`` holds patterns under ids; several may share one.  It matches single events in Python,
and DataFrames, batch or streaming, through expressions (few patterns) or a join (many).
"""

from __future__ import annotations

import copy
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evmatch.errors import PatternError, UnsupportedMediaType
from evmatch.operators import local
from evmatch.operators.flatten import ERROR, ExactFlattener, Flattener, TypedFlattener, fresh
from evmatch.plans import columns, semi
from evmatch.plans.classes import class_column
from evmatch.plans.inline import InRow, TooManyTerms
from evmatch.plans.join import EVENT, looked_up, quoted, satisfied
from evmatch.plans.pattern import Path, Pattern, parse

JSON = "application/json"
FEW, VALUES = 50, 400  # patterns, and values in all of them, up to which each pattern is an expression of its own
MATCHED = "_matched_ids"
PUSHED = 8  # ids up to which rows without a match are filtered out by the scan
REBUILD_LEAST, REBUILD_SHARE = 1000, 0.2


def _or(columns: Iterable[Column]) -> Column:
    whole: Column | None = None
    for c in columns:
        whole = c if whole is None else whole | c
    return F.lit(False) if whole is None else whole


def _present(ids: Iterable[Column]) -> Column:
    """Array of those that are not null; compiled, unlike array_compact."""
    ids = list(ids)
    return F.array_except(F.array(*ids), F.array(F.lit(None).cast("string"))) if ids else F.array().cast("array<string>")


def _others(df: DataFrame, into: str) -> list[str]:
    """Columns but the one that is replaced; names that differ in case alone are one."""
    return [c for c in df.columns if c.lower() != into.lower()]


@dataclass(frozen=True)
class PrunerStats:
    """Results given, and results held back because their pattern was deleted."""

    emitted: int = 0
    filtered: int = 0

    @property
    def ratio(self) -> float:
        return self.filtered / self.emitted if self.emitted else 0.0


@dataclass(frozen=True)
class _Entry:
    id: Hashable
    text: str | dict
    pattern: Pattern
    deleted: bool = False


class Builder:
    """Collects options; ``build`` gives an empty set."""

    def __init__(self) -> None:
        self._media: str | None = None
        self._options: dict[str, Any] = {}

    def with_media_type(self, media_type: str) -> Builder:
        if "flattener" in self._options:
            raise UnsupportedMediaType("a flattener is set already")
        if media_type != JSON:
            raise UnsupportedMediaType(media_type)
        self._media = media_type
        return self

    def with_flattener(self, flattener: Flattener) -> Builder:
        if self._media or "flattener" in self._options:
            raise UnsupportedMediaType("a media type or flattener is set already")
        self._options["flattener"] = flattener
        return self

    def with_auto_rebuild(self, enabled: bool) -> Builder:
        self._options["auto_rebuild"] = enabled
        return self

    def with_strict_lookaround(self, enabled: bool) -> Builder:
        self._options["strict_lookaround"] = enabled
        return self

    def build(self) -> PatternSet:
        return PatternSet(**self._options)


class PatternSet:
    def __init__(self, flattener: Flattener | None = None, auto_rebuild: bool = True, strict_lookaround: bool = False):
        self.flattener = flattener or TypedFlattener()
        self.auto_rebuild, self.strict_lookaround = auto_rebuild, strict_lookaround
        self._entries: list[_Entry] = []
        self._emitted = self._filtered = 0
        self._reader: tuple[list[_Entry], list[Path], local.Reader] | None = None
        self._last: tuple[str | bytes, dict[Path, list[local.Leaf]]] | None = None

    @staticmethod
    def builder() -> Builder:
        return Builder()

    @classmethod
    def of(cls, patterns: dict[Hashable, str | dict | list], **options: Any) -> PatternSet:
        """From {id: pattern or list of patterns}."""
        out = cls(**options)
        for i, p in patterns.items():
            for one in p if isinstance(p, list) else [p]:
                out.add_pattern(i, one)
        return out

    # ---- registry

    def add_pattern(self, id: Hashable, text: str | dict) -> PatternSet:
        """Adds to the id's patterns; what was deleted under it stays deleted."""
        self._entries.append(_Entry(id, text, parse(text, self.strict_lookaround)))
        self._reader = None
        return self

    def delete_patterns(self, id: Hashable) -> None:
        """Marks all patterns of an id; an unknown id is no error."""
        self._entries = [_Entry(e.id, e.text, e.pattern, True) if e.id == id else e for e in self._entries]

    def rebuild(self) -> int:
        """Drops marked patterns and the statistics; how many were dropped."""
        before = len(self._entries)
        self._entries = [e for e in self._entries if not e.deleted]
        self._emitted = self._filtered = 0
        return before - len(self._entries)

    def should_rebuild(self) -> bool:
        return self._emitted + self._filtered >= REBUILD_LEAST and self.pruner_stats().ratio > REBUILD_SHARE

    def maybe_rebuild(self) -> int:
        return self.rebuild() if self.auto_rebuild and self.should_rebuild() else 0

    def pruner_stats(self) -> PrunerStats:
        return PrunerStats(self._emitted, self._filtered)

    def pattern_ids(self) -> list[Hashable]:
        return list(dict.fromkeys(e.id for e in self._entries if not e.deleted))

    def pattern_count(self) -> int:
        return len(self.pattern_ids())

    def is_empty(self) -> bool:
        return not self.pattern_ids()

    def contains_pattern(self, id: Hashable) -> bool:
        return id in self.pattern_ids()

    def clear(self) -> None:
        self._entries = []

    def clone(self) -> PatternSet:
        """A snapshot: later changes to either do not show in the other."""
        out = copy.copy(self)
        out._entries = [*self._entries]
        return out

    def in_time(self, times: dict[Hashable, Any]) -> PatternSet:
        """A set with one more field, of ``times``, in the patterns of each id that have any."""
        out = copy.copy(self)
        more = lambda e: replace(e.pattern, fields=(*e.pattern.fields, times[e.id]))
        out._entries = [replace(e, pattern=more(e)) if e.pattern.fields else e for e in self._entries]
        return out

    # ---- as a table

    def to_table(self, spark: SparkSession) -> DataFrame:
        """(pattern_id, pattern_json, deleted), to be kept where other jobs find it."""
        import json

        rows = [(str(e.id), e.text if isinstance(e.text, str) else json.dumps(e.text), e.deleted) for e in self._entries]
        return spark.createDataFrame(rows, "pattern_id string, pattern_json string, deleted boolean")

    @classmethod
    def from_table(cls, table: DataFrame, **options: Any) -> PatternSet:
        """The live patterns of a table.  Patterns are compiled on the driver, so there must be few enough for it."""
        out = cls(**options)
        for r in table.filter("not deleted").select("pattern_id", "pattern_json").toLocalIterator():
            out.add_pattern(r["pattern_id"], r["pattern_json"])
        return out

    # ---- one event

    def _live(self) -> list[_Entry]:
        return [e for e in self._entries if not e.deleted]

    @staticmethod
    def _paths(entries: Iterable[_Entry]) -> list[Path]:
        return list(dict.fromkeys(p for e in entries for p in e.pattern.paths))

    def _leaves(self, event: str | bytes) -> dict[Path, list[local.Leaf]]:
        """Leaves of an event; the reader is kept until patterns change, and the last event's leaves for other questions."""
        if self._reader is None or self._reader[0] is not self._entries:
            paths = self._paths(self._entries)
            self._reader, self._last = (self._entries, paths, local.Reader(paths)), None
        if self._last is None or type(self._last[0]) is not type(event) or self._last[0] != event:
            _, paths, reader = self._reader
            self._last = (event, dict(zip(paths, reader(event), strict=True)))
        return self._last[1]

    def matches_for_event(self, event: str | bytes) -> list[Hashable]:
        """Ids of the patterns that a JSON event matches, once each; an InvalidJson error for a bad one."""
        found = self._leaves(event)
        hits = [e for e in self._entries if local.matches(e.pattern, found)]
        ids = list(dict.fromkeys(e.id for e in hits if not e.deleted))
        self._emitted += len(ids)
        self._filtered += len({e.id for e in hits if e.deleted} - set(ids))
        return ids

    def has_matches(self, event: str | bytes) -> bool:
        return bool(self.matches_for_event(event))

    def count_matches(self, event: str | bytes) -> int:
        return len(self.matches_for_event(event))

    def flatten_only(self, event: str | bytes) -> int:
        """How many leaves of an event the patterns look at."""
        return sum(map(len, self._leaves(event).values()))

    # ---- DataFrames

    def _compiled(self, df: DataFrame) -> tuple[DataFrame, dict[Hashable, Column]]:
        """One boolean Column per id; null counts as no, so that comparisons stay plain enough for the scan."""
        live = self._live()
        paths = self._paths(live)
        typed = isinstance(self.flattener, TypedFlattener)
        scalar = columns.typed_scalars(df, self.flattener) if typed else lambda path: None
        arrays = (lambda path: columns.has_array(df, path)) if typed else (lambda path: True)
        element = (lambda path: self.flattener.element(df, path)) if typed else lambda path: None
        deep = [p for p in paths if scalar(p) is None]
        df, leaves = self.flattener(df, deep) if deep else (df, {})
        if leaves and not typed:
            mark = fresh(df, "_leaves_of")
            names = {p: f"{mark}{n}" for n, p in enumerate(deep)}
            df = df.withColumns({names[p]: leaves[p] for p in deep})
            leaves = {p: F.col(names[p]) for p in deep}
        found: dict[Hashable, Column] = {}
        for e in live:
            one = columns.pattern_column(e.pattern, scalar, leaves, arrays, element)
            found[e.id] = found[e.id] | one if e.id in found else one
        return df, found

    def _looked_up(self, df: DataFrame, live: list[_Entry], into: str) -> DataFrame | None:
        """The plan without a shuffle, if typed fields allow it."""
        if not isinstance(self.flattener, TypedFlattener) or any(columns.has_array(df, p) for p in self._paths(live)):
            return None
        nothing = (F.lit(None).cast("string"), None)
        return looked_up(df, [e.pattern for e in live], [str(e.id) for e in live], lambda p: self.flattener.scalar(df, p) or nothing, into)

    @staticmethod
    def _many(live: list[_Entry]) -> bool:
        return len(live) > FEW or sum(1 + len(m.texts) + len(m.numbers) for e in live for _, ms in e.pattern.fields for m in ms) > VALUES

    def _has_arrays(self, df: DataFrame, paths: Iterable[Path]) -> bool:
        return not isinstance(self.flattener, TypedFlattener) or any(columns.has_array(df, p) for p in paths)

    def _row_ids(self, df: DataFrame, live: list[_Entry], ordered: bool = True) -> tuple[DataFrame, Column] | None:
        """The plans whose tables are constants, if they are not too large."""
        paths, patterns, ids = self._paths(live), [e.pattern for e in live], [str(e.id) for e in live]
        if isinstance(self.flattener, TypedFlattener):
            try:
                return df, class_column(df, self.flattener, patterns, ids, ordered)
            except TooManyTerms:
                pass
        try:
            terms = InRow(patterns, paths, ids, self._has_arrays(df, paths))
        except TooManyTerms:
            return None
        flat, leaves = self.flattener(df, paths)
        return flat, terms.column([leaves[p] for p in paths], ordered)

    def _joined(self, df: DataFrame, key: list[str], live: list[_Entry], outer: bool = False) -> DataFrame:
        paths = self._paths(live)
        flat, leaves = self.flattener(df, paths)
        single = not self._has_arrays(df, paths)
        kept = [*key, *(self._error(df, flat) if outer else [])]
        return satisfied(flat, kept, [e.pattern for e in live], [str(e.id) for e in live], paths, leaves, single, outer)

    @staticmethod
    def _error(df: DataFrame, flat: DataFrame) -> list[str]:
        """The column of errors, if a flattener made one."""
        return [c for c in [fresh(df, ERROR)] if c in flat.columns]

    def match(self, df: DataFrame, into: str = "matches", observe: Observation | None = None) -> DataFrame:
        """``df`` with an array of the ids (as strings) that each row matches, sorted; a column of that name is replaced.

        The same rows come out of all plans, whatever columns they have: beyond FEW patterns or VALUES values
        are looked up in the row or, in sets too large for that, a row travels with its number through the join
        plan.  With ``observe`` results are counted for the statistics, which ``absorb`` adds once the rows are
        written.
        """
        if observe:
            return self._observed(df, into, observe)
        kept = _others(df, into)
        live = [e for e in self._live() if e.pattern.fields]
        if self._many(live):
            if (out := self._looked_up(df, live, into)) is not None:
                return out
            if (made := self._row_ids(df, live)) is not None:
                ids = fresh(df, MATCHED)
                out = made[0].withColumn(ids, made[1])
                return out.select(*map(quoted, kept), *map(quoted, self._error(df, out)), F.col(ids).alias(into))
            out = self._joined(df, kept, live, outer=True)
            return out.select("_key.*", F.array_sort("_ids").alias(into))
        flat, found = self._compiled(df)
        ids = _present(F.when(c, F.lit(str(i))) for i, c in found.items())
        return flat.withColumn(into, F.sort_array(ids)).select(*map(quoted, kept), *map(quoted, self._error(df, flat)), into)

    def _observed(self, df: DataFrame, into: str, observe: Observation) -> DataFrame:
        live, held = {e.id for e in self._live()}, "_held_back"
        dead = PatternSet(self.flattener)
        dead._entries = [_Entry(e.id, e.text, e.pattern) for e in self._entries if e.deleted and e.id not in live]
        both = self.match(dead.match(df, held).select(*map(quoted, df.columns), held), into)
        return both.observe(observe, F.sum(F.size(into)).alias("emitted"), F.sum(F.size(held)).alias("filtered")).drop(held)

    def absorb(self, observe: Observation) -> int:
        """Adds what a finished ``match`` counted to the statistics; how many patterns a rebuild dropped then."""
        self._emitted += observe.get["emitted"] or 0
        self._filtered += observe.get["filtered"] or 0
        return self.maybe_rebuild()

    def match_long(self, df: DataFrame, key: list[str], plan: str | None = None) -> DataFrame:
        """(*key, pattern_id), each pattern once a row.

        ``plan``: "columns", "lookup", "row", "join" or, for what keeps no state, "stream"; by the number of
        patterns, their values and fields if not said.
        """
        live = [e for e in self._live() if e.pattern.fields]
        event = getattr(self.flattener, "event", None)
        df = df.select(*map(quoted, dict.fromkeys([*key, event]))) if event else df
        many, ids = self._many(live), fresh(df, MATCHED)
        table = None
        if live and (plan == "lookup" or plan in (None, "stream") and many):
            table = self._looked_up(df, live, ids)
        if live and table is None and (plan == "row" or plan in (None, "stream") and many):
            if (made := self._row_ids(df, live, ordered=False)) is not None:
                # not of a column with a name, which the optimizer would make once more to filter by its size
                return made[0].select(*map(quoted, key), F.explode(made[1]).alias("pattern_id"))
        if table is not None:
            return table.select(*map(quoted, key), F.explode(ids).alias("pattern_id"))
        if plan in ("columns", "stream") or not live or plan is None and not many:
            flat, found = self._compiled(df)
            # a regexp reaches no scan, and would be decided once more in the filter; and the optimizer says a filter
            # on fields of an event anew in terms of its text, which is then parsed for each time a field is named
            made = not isinstance(self.flattener, (TypedFlattener, ExactFlattener))
            plain = not made and not any(m.op == "regexp" for e in live for _, ms in e.pattern.fields for m in ms)
            filtered = not made and len(found) == 1 or plain and 0 < len(found) <= PUSHED
            if filtered:
                flat = flat.filter(_or(found.values()))
            if filtered and len(found) == 1:
                return flat.select(*map(quoted, key), F.lit(str(next(iter(found)))).alias("pattern_id"))  # filtered above
            if not found:
                return flat.select(*map(quoted, key), F.lit("").alias("pattern_id")).filter(F.lit(False))
            each = flat.select(*map(quoted, key), F.explode(F.array(*(F.when(c, F.lit(str(i))) for i, c in found.items()))).alias("pattern_id"))
            return each.filter("pattern_id is not null")
        out = self._joined(df, key, live)
        if len({e.id for e in live}) < len(live):
            out = out.groupBy(EVENT, "_id").agg(F.first("_key").alias("_key"))
        return out.select("_key.*", F.col("_id").alias("pattern_id"))

    def matching(self, df: DataFrame) -> DataFrame:
        """The rows that match any pattern.  Comparisons of plain columns reach the scan."""
        kept = df.columns
        live = [e for e in self._live() if e.pattern.fields]
        if self._many(live):
            if isinstance(self.flattener, TypedFlattener) and not self.flattener.nulls:
                patterns = [e.pattern for e in live]
                if (at_scan := semi.scan_filter(df, patterns)) is not None:
                    df = df.filter(at_scan)
                if (rows := semi.semi_joined(df, patterns, self.flattener)) is not None:
                    return rows
            ids = fresh(df, MATCHED)
            return self.match(df, ids).filter(F.size(ids) > 0).select(*map(quoted, kept))
        flat, found = self._compiled(df)
        return flat.filter(_or(found.values())).select(*map(quoted, kept))

    def count_column(self, df: DataFrame, into: str = "n_matches") -> DataFrame:
        kept = _others(df, into)
        if self._many(self._live()):
            ids = fresh(df, MATCHED)
            return self.match(df, ids).select(*map(quoted, kept), F.size(ids).alias(into))
        flat, found = self._compiled(df)
        total = F.lit(0)
        for c in found.values():
            total = total + F.coalesce(c, F.lit(False)).cast("int")
        return flat.withColumn(into, total).select(*map(quoted, kept), into)

    def leaf_count(self, df: DataFrame, into: str = "n_leaves") -> DataFrame:
        kept = df.columns
        flat, leaves = self.flattener(df, self._paths(self._live()))
        total = F.lit(0)
        for c in leaves.values():
            total = total + F.size(c)
        return flat.withColumn(into, total).select(*map(quoted, kept), into)


class ValueMatcher:
    """Values rather than events: exact strings, prefixes and shellstyle patterns under ids."""

    def __init__(self) -> None:
        self._set: list[tuple[Hashable, Pattern]] = []

    def _add(self, id: Hashable, matcher: Any) -> ValueMatcher:
        self._set.append((id, parse({"v": [matcher]})))
        return self

    def add_string(self, id: Hashable, text: str) -> ValueMatcher:
        return self._add(id, text)

    def add_prefix(self, id: Hashable, text: str) -> ValueMatcher:
        return self._add(id, {"prefix": text})

    def add_shellstyle(self, id: Hashable, text: str) -> ValueMatcher:
        return self._add(id, {"shellstyle": text})

    def matches(self, value: str) -> list[Hashable]:
        return list(dict.fromkeys(i for i, p in self._set if local.matches(p, {("v",): [local.Leaf(value)]})))

    def column(self, v: Column) -> Column:
        """Array of the ids, as strings, that a string column matches."""
        from evmatch.functions.predicates import any_of

        by_id: dict[Hashable, Column] = {}
        for i, p in self._set:
            one = F.coalesce(any_of(p.fields[0][1], v, None), F.lit(False))
            by_id[i] = by_id[i] | one if i in by_id else one
        return _present(F.when(c, F.lit(str(i))) for i, c in by_id.items())


__all__ = ["Builder", "PatternError", "PatternSet", "PrunerStats", "ValueMatcher"]
