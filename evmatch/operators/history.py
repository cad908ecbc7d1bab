"""Patterns over time: each event is matched with the patterns that were valid when it happened.

``PatternHistory`` keeps versions, a pattern with the times from which and up to which it is valid.  All versions are
matched at once, by the plan that suits their number, and a row keeps those whose time its own is in; so a stream that
is read again, late events, and a table of last year get the matches of their time, whatever was added since.
"""

from __future__ import annotations

import json
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.operators.flatten import TypedFlattener, fresh
from evmatch.operators.registry import PatternSet
from evmatch.plans.join import quoted
from evmatch.plans.pattern import parse

FOREVER = (1 << 63) - 1
#: of the table of versions; times are microseconds since 1970
SCHEMA = "pattern_id string, pattern_json string, valid_from long, valid_to long"


def micros(at: datetime | int) -> int:
    """Microseconds since 1970; a time without a zone is UTC."""
    if isinstance(at, int):
        return at
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    since = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


@dataclass(frozen=True)
class Version:
    """A pattern from a time on, and before another one."""

    id: Hashable
    text: str | dict
    since: int
    until: int = FOREVER


class PatternHistory:
    def __init__(self, **options: Any):
        self._options, self._versions = options, []

    def add_pattern(self, id: Hashable, text: str | dict, at: datetime | int) -> PatternHistory:
        """Valid from then on, beside the id's other patterns."""
        parse(text, self._options.get("strict_lookaround", False))
        self._versions.append(Version(id, text, micros(at)))
        return self

    def delete_patterns(self, id: Hashable, at: datetime | int) -> None:
        """Ends the id's versions that are valid then, and those that were to begin later."""
        end = micros(at)
        self._versions = [replace(v, until=max(v.since, end)) if v.id == id and v.until > end else v for v in self._versions]

    def replace_patterns(self, id: Hashable, text: str | dict, at: datetime | int) -> PatternHistory:
        self.delete_patterns(id, at)
        return self.add_pattern(id, text, at)

    def versions(self) -> list[Version]:
        """Those that are valid at any time."""
        return [v for v in self._versions if v.since < v.until]

    def at(self, time: datetime | int) -> PatternSet:
        """The set as it was then."""
        found = PatternSet(**self._options)
        for v in self.versions():
            if v.since <= micros(time) < v.until:
                found.add_pattern(v.id, v.text)
        return found

    # ---- as a table

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(str(v.id), v.text if isinstance(v.text, str) else json.dumps(v.text), v.since, v.until) for v in self.versions()]
        return spark.createDataFrame(rows, SCHEMA)

    @classmethod
    def of(cls, rows: Iterable[tuple[Hashable, str | dict, int, int | None]], **options: Any) -> PatternHistory:
        """From (id, pattern, valid from, valid to or None) in microseconds."""
        out = cls(**options)
        for i, text, since, until in rows:
            out.add_pattern(i, text, since)
            out._versions[-1] = replace(out._versions[-1], until=FOREVER if until is None else until)
        return out

    @classmethod
    def from_table(cls, table: DataFrame, **options: Any) -> PatternHistory:
        """Versions are compiled on the driver, so there must be few enough for it."""
        return cls.of((tuple(r) for r in table.select("pattern_id", "pattern_json", "valid_from", "valid_to").toLocalIterator()), **options)

    # ---- DataFrames and streams

    def match(self, df: DataFrame, time: str, into: str = "matches") -> DataFrame:
        """``df`` with the sorted ids of the patterns that each row matches and that were valid at its ``time``.

        ``time`` is a timestamp, or microseconds as a long; a row without one matches nothing.
        """
        versions = self.versions()
        found, now = fresh(df, "_versions"), fresh(df, "_now")
        numbered = self._numbered(versions, now)
        at = quoted(time) if dict(df.dtypes)[time] == "bigint" else F.unix_micros(quoted(time).cast("timestamp"))
        rows = numbered.match(df.withColumn(now, at), found)
        constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        since, until = constant([v.since for v in versions], "bigint"), constant([v.until for v in versions], "bigint")
        names = constant([str(v.id) for v in versions], "string")
        number = lambda n: n.cast("int")
        valid = F.filter(found, lambda n: (F.get(since, number(n)) <= F.col(now)) & (F.col(now) < F.get(until, number(n))))
        ids = F.array_sort(F.array_distinct(F.transform(valid, lambda n: F.get(names, number(n)))))
        kept = [c for c in rows.columns if c not in (found, now) and c.lower() != into.lower()]
        return rows.select(*map(quoted, kept), ids.alias(into))

    def _numbered(self, versions: list[Version], now: str) -> PatternSet:
        """Versions under their numbers.  Of columns a version's time is one more field, by which few versions are
        found at any time; a double may be one for several microseconds, so times are compared as they are later."""
        numbered = PatternSet.of({n: v.text for n, v in enumerate(versions)}, **self._options)
        if not isinstance(numbered.flattener, TypedFlattener):
            return numbered
        bounds = [[">=", v.since, *(["<=", v.until] if v.until < FOREVER else [])] for v in versions]
        return numbered.in_time({n: parse({now: [{"numeric": x}]}).fields[0] for n, x in enumerate(bounds)})

    def match_long(self, df: DataFrame, key: list[str], time: str) -> DataFrame:
        """(*key, pattern_id), each pattern once a row; of batches and streams alike."""
        ids = fresh(df, "_valid")
        return self.match(df, time, ids).select(*map(quoted, key), F.explode(ids).alias("pattern_id"))
