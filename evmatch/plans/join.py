"""Patterns as a table joined with leaves: the plan for the largest sets; and lookups of plain fields in the row.

Every leaf says keys (see ``terms``), and terms are rows (path, key, condition), so one hash join finds an event's
conditions however many patterns there are.  A pattern is then looked up by the condition that fewest patterns
share, and its others are looked for among the event's.  Only the narrow rows that met a condition are grouped by
event, and only where a pattern has several fields.  Events are numbered for that, and the numbers are written
before they are used, so that a task that runs again finds the same ones.

Where no field is in an array and patterns can be found by an equality, ``looked_up`` joins a row's values with
broadcast tables instead, so that nothing is exploded or moved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evmatch.deploy import shared_dir
from evmatch.functions.predicates import predicate
from evmatch.plans.columns import STEPS, agree
from evmatch.plans.pattern import Matcher, Path, Pattern
from evmatch.plans.terms import Terms, fits, same_letters

BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 64 << 20
EVENT = "_event_no"
#: share of events looked at for common keys, how much of them a key has to be, and terms of such keys that are broadcast
LOOK, COMMON, COMMON_TERMS = 0.01, 0.001, 50_000


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def sized(table: DataFrame, rows: int, size: int) -> DataFrame:
    """Broadcast only up to BROADCAST_TERMS rows and BROADCAST_BYTES; beyond, the join is shuffled."""
    return F.broadcast(table) if rows <= BROADCAST_TERMS and size <= BROADCAST_BYTES else table


def _double_key(x: Column) -> Column:
    return F.concat(F.lit("n"), (x + F.lit(0.0)).cast("string"))


class TermTables:
    """The terms and patterns of a set as tables, and what leaves say to be joined with them."""

    def __init__(self, patterns: list[Pattern], paths: list[Path], ids: list[str]):
        self.terms, self.ids = Terms(patterns, paths), ids
        self.checked = {path for (path, _), found in self.terms.said.items() if any(t.pieces or t.exact for t in found)}
        self.patterns = self.terms.patterns

    def table(self, like: DataFrame) -> DataFrame:
        """(_path, _said, _condition, _pieces, _exact)."""
        t = self.terms
        rows = [(path, key, None, *x) for (path, key), found in t.said.items() for x in found]
        rows += [(path, None, number, *x) for (path, number), found in t.numbers.items() for x in found]
        rows += [(path, f"g{node}", None, *x) for (path, node), found in t.nodes.items() for x in found]
        rows += [(path, "m", None, c, None, None) for path, cs in t.absent.items() for c in cs]
        size = sum(40 + 4 * len(k or "") + 4 * len(e or "") + sum(16 + 4 * len(p) for p in ps or ()) for _, k, _, _, ps, e in rows)
        self.small = len(rows) <= BROADCAST_TERMS and size <= BROADCAST_BYTES
        return sized(self._rows(like, rows), len(rows), size)

    @staticmethod
    def _rows(like: DataFrame, rows: list[tuple]) -> DataFrame:
        kinds = [("_path", pa.int32()), ("_said", pa.string()), ("number", pa.float64()), ("_condition", pa.int32()), ("_pieces", pa.list_(pa.string())), ("_exact", pa.string())]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        raw = like.sparkSession.createDataFrame(pa.table({name: pa.array(c, type=kind) for (name, kind), c in zip(kinds, columns, strict=True)}))
        key = F.when(F.col("number").isNotNull(), _double_key(F.col("number"))).otherwise(F.col("_said"))
        return raw.select("_path", key.alias("_said"), "_condition", "_pieces", "_exact")

    def under(self, like: DataFrame, keys: list[tuple[int, str]], most: int) -> DataFrame | None:
        """The rows of ``table`` under some keys, from the driver's own terms; None if they are more than ``most``."""
        t, rows = self.terms, []
        for path, key in keys:
            if key[0] == "n":
                found = t.numbers.get((path, float(key[1:])), ())
            elif key[0] == "g":
                found = t.nodes.get((path, int(key[1:])), ())
            else:
                found = [(c, None, None) for c in t.absent.get(path, ())] if key == "m" else t.said.get((path, key), ())
            rows += [(path, key, None, *x) for x in found]
            if len(rows) > most:
                return None
        return self._rows(like, rows)

    def pattern_table(self, like: DataFrame) -> DataFrame:
        """(id of the pattern, condition to look it up by, all its conditions)."""
        n, leads, asked = zip(*self.patterns, strict=True)
        raw = like.sparkSession.createDataFrame(pa.table({"_id": pa.array([self.ids[k] for k in n], type=pa.string()), "_condition": pa.array(leads, type=pa.int32()), "_conditions": pa.array(asked, type=pa.list_(pa.int32()))}))
        many = sum(map(len, asked))
        return sized(raw, many, 8 * many + sum(24 + 4 * len(i) for i in self.ids))

    def saying(self, path: int) -> Callable[[Column], Column]:
        v = (lambda x: x["v"]) if path in self.checked else lambda x: F.lit(None).cast("string")
        return lambda x: F.struct(F.lit(path).alias("path"), self.keys(path, x["v"], x["d"]).alias("keys"), v(x).alias("v"), x["trail"].alias("trail"))

    def keys(self, path: int, v: Column, d: Column) -> Column:
        parts, ways = [self.terms.texts(path, v, d)], self.terms.ways[path]
        if ways.number:
            parts.append(F.array_compact(F.array(F.when(d.isNotNull(), _double_key(d)))))
        if ways.bounds:
            bounds = F.from_json(F.lit(str(ways.bounds)), "array<double>")
            parts.append(F.transform(self.terms.node_numbers(path, d, bounds), lambda n: F.concat(F.lit("g"), n.cast("string"))))
        return parts[0] if len(parts) == 1 else F.concat(*parts)


def joined_apart(said: DataFrame, terms: DataFrame, how: str, some: DataFrame | None = None, held: TermTables | None = None) -> DataFrame:
    """Keys with a table of terms that is too large for a broadcast.  A key that many events say would be one task's:
    the terms of common keys, which a look at some events finds, are broadcast, and only the others are shuffled.
    ``some`` are keys of the share LOOK of the events, where that is less work than taking it from ``said``; ``held`` has
    the terms where they are the driver's, which then asks no job for those of common keys."""
    some = said.sample(LOOK, seed=1) if some is None else some
    looked = some.filter(F.col("_said").isNotNull()).groupBy("_path", "_said").count()
    often = (F.col("count") >= 5) & (F.col("count") >= COMMON * F.col("_all"))
    common = looked.crossJoin(looked.agg(F.sum("count").alias("_all"))).filter(often).select("_path", "_said")
    keys = common.collect()  # 1 / COMMON at most
    if keys and held:
        mine = held.under(said, [tuple(k) for k in keys], COMMON_TERMS)
    else:
        mine = terms.join(F.broadcast(said.sparkSession.createDataFrame(keys, common.schema)), ["_path", "_said"], "left_semi") if keys else None
        mine = None if mine is None or mine.limit(COMMON_TERMS + 1).count() > COMMON_TERMS else mine
    if mine is None:
        return said.join(terms, ["_path", "_said"], how)
    flagged = said.join(F.broadcast(said.sparkSession.createDataFrame(keys, common.schema).withColumn("_common", F.lit(True))), ["_path", "_said"], "left")
    often, rest = flagged.filter("_common").drop("_common"), flagged.filter("_common is null").drop("_common")
    return often.join(F.broadcast(mine), ["_path", "_said"], how).unionByName(rest.join(terms, ["_path", "_said"], how))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with EVENT, a number of each, kept in the shared folder: numbers given anew might go to other rows."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.withColumn(EVENT, F.monotonically_increasing_id()).checkpoint()


def satisfied(df: DataFrame, key: list[str], patterns: list[Pattern], ids: list[str], paths: list[Path], leaves: dict[Path, Column], single: bool = False, outer: bool = False) -> DataFrame:
    """(_key, EVENT, _id): ids of the patterns that each event matches, with a struct ``_key`` of its columns ``key``.

    EVENT numbers the rows, so that rows of one key stay apart.  ``single`` says that no path crosses an
    array, so an event has one leaf at most at each.  With ``outer`` there is one row for each event, of an
    array ``_ids`` that can be empty.
    """
    tables = TermTables(patterns, paths, ids)
    terms, parts = tables.terms, []
    no_trail = F.array().cast(STEPS)
    for n, p in enumerate(paths):
        told = F.transform(leaves[p], tables.saying(n))
        if n in terms.absent:
            nothing = F.array(F.struct(F.lit(n).alias("path"), F.array(F.lit("m")).alias("keys"), F.lit(None).cast("string").alias("v"), no_trail.alias("trail")))
            told = F.when(F.size(leaves[p]) == 0, nothing).otherwise(told)
        parts.append(told)
    explode, how = (F.explode_outer, "left") if outer else (F.explode, "inner")
    carried = F.struct(*map(quoted, key)) if key else F.struct(F.lit(0).alias("_"))
    rows = numbered(df.select(carried.alias("_key"), F.concat(*parts).alias("_leaves")))
    each = rows.select("_key", EVENT, explode("_leaves").alias("_leaf"))
    said = each.select("_key", EVENT, F.col("_leaf.path").alias("_path"), F.col("_leaf.trail").alias("_trail"), F.col("_leaf.v").alias("_v"), explode("_leaf.keys").alias("_said"))
    terms_of = tables.table(df)
    met = said.join(terms_of, ["_path", "_said"], how) if tables.small else joined_apart(said, terms_of, how, held=tables)
    if tables.checked:
        fine = F.when(F.col("_pieces").isNotNull(), fits(F.col("_v"), F.col("_pieces"))).when(F.col("_exact").isNotNull(), same_letters(F.col("_v"), F.col("_exact"))).otherwise(True)
        met = met.withColumn("_condition", F.when(fine, F.col("_condition")))
        met = met if outer else met.filter("_condition is not null")
    met = met.select("_key", EVENT, "_condition", "_trail")
    asked = tables.pattern_table(df)
    if not outer and all(len(cs) == 1 for _, _, cs in tables.patterns):
        met = met.select("_key", EVENT, "_condition")
        if not (single and terms.once):
            met = met.groupBy(EVENT, "_condition").agg(F.first("_key").alias("_key"))
        return met.join(asked, "_condition").select("_key", EVENT, "_id")
    # rows of an event lie together, so most meet before anything moves
    got = F.collect_set(F.when(F.col("_condition").isNotNull(), F.struct("_condition", "_trail")))
    events = met.groupBy(EVENT).agg(F.first("_key").alias("_key"), got.alias("_got"))
    events = events.withColumn("_has", F.array_distinct(F.transform("_got", lambda g: g["_condition"])))
    found = events.select("_key", EVENT, "_got", "_has", explode("_has").alias("_condition")).join(asked, "_condition", how)
    complete = F.size(F.array_except("_conditions", "_has")) == 0

    def meet(acc: Column, c: Column) -> Column:
        fitting = lambda a: F.filter(F.col("_got"), lambda g: (g["_condition"] == c) & agree(a, g["_trail"]))
        return F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(fitting(a), lambda g: F.array_union(a, g["_trail"])))))

    nested = F.exists("_got", lambda g: F.size(g["_trail"]) > 0)
    together = F.when(nested & (F.size("_conditions") > 1), F.size(F.aggregate("_conditions", F.array(no_trail), meet)) > 0).otherwise(True)
    if outer:
        return found.groupBy(EVENT).agg(F.first("_key").alias("_key"), F.collect_set(F.when(complete & together, F.col("_id"))).alias("_ids"))
    return found.filter(complete).filter(together).select("_key", EVENT, "_id")


LOOKUPS, OTHERS = 12, 64
CANDIDATES = "array<struct<id:string,conditions:array<int>>>"


def looked_up(df: DataFrame, patterns: list[Pattern], ids: list[str], scalar: Callable[[Path], tuple[Column, Column | None]], into: str) -> DataFrame | None:
    """``df`` with the ids of the patterns that each row matches, for fields without arrays: nothing moves.

    A field's value is looked up in a broadcast table for each way to say it (as it is, as a number, its
    beginning or ending of a length), which gives the conditions it meets and the patterns to be found by
    them.  Other matchers are expressions.  None if there are too many ways or terms, or a pattern cannot be
    found by a lookup.
    """
    tables: dict[tuple[Path, str], dict[str | float, tuple[set[int], list[int]]]] = {}
    others: dict[tuple[Path, Matcher], set[int]] = {}
    conditions: dict[tuple, int] = {}
    keyed: dict[int, list[tuple[tuple[Path, str], str | float]]] = {}
    scalar = cache(scalar)
    for path, matchers in dict.fromkeys(f for p in patterns for f in p.fields):
        c = conditions[path, matchers] = len(conditions)
        d, at = scalar(path)[1], []
        for m in matchers:
            if m.op == "exact" or m.op == "number" and d is None:
                at.append(((path, "s"), m.text))
            elif m.op == "number":
                at.append(((path, "n"), m.number + 0.0))
            elif m.op in ("prefix", "suffix"):
                at.append(((path, f"{m.op[0]}{len(m.text)}"), m.text))
            else:
                others.setdefault((path, m), set()).add(c)
        if len(at) == len(matchers):
            keyed[c] = at
        for way, said in at:
            tables.setdefault(way, {}).setdefault(said, (set(), []))[0].add(c)
    asked = [[conditions[f] for f in p.fields] for p in patterns]
    size = sum(64 + 4 * len(str(said)) for rows in tables.values() for said in rows) + sum(64 + 4 * len(i) + 8 * len(cs) for i, cs in zip(ids, asked, strict=True))
    if len(tables) > LOOKUPS or len(others) > OTHERS or sum(map(len, tables.values())) > BROADCAST_TERMS or size > BROADCAST_BYTES:
        return None
    shared = Counter(c for cs in asked for c in cs)
    for n, cs in enumerate(asked):
        lead = min((c for c in cs if c in keyed), key=lambda c: (shared[c], c), default=None)
        if lead is None:
            return None
        for way, said in dict.fromkeys(keyed[lead]):
            tables[way][said][1].append(n)
    out, got, kept = df, [], df.columns
    alone = all(len(cs) == 1 for cs in asked)  # then what a value is found with are the ids themselves
    mark = "_look" + "_" * max((len(c) for c in kept if c.lower().startswith("_look")), default=0)  # begins no other column
    for k, ((path, way), rows) in enumerate(tables.items()):
        v, d = scalar(path)
        said = d + F.lit(0.0) if way == "n" else v if way == "s" else F.substring(v, 1, int(way[1:])) if way[0] == "p" else F.right(v, F.lit(int(way[1:])))
        if alone:
            found = pa.array([sorted({ids[n] for n in ns}) for _, ns in rows.values()], type=pa.list_(pa.string()))
            table = df.sparkSession.createDataFrame(pa.table({f"{mark}said{k}": pa.array(list(rows), type=pa.float64() if way == "n" else pa.string()), f"{mark}by{k}": found}))
            out = out.join(F.broadcast(table), said == F.col(f"{mark}said{k}"), "left")
            got.append(k)
            continue
        by = pa.list_(pa.struct([("id", pa.string()), ("conditions", pa.list_(pa.int32()))]))
        columns = {f"{mark}said{k}": pa.array(list(rows), type=pa.float64() if way == "n" else pa.string()), f"{mark}met{k}": pa.array([sorted(cs) for cs, _ in rows.values()], type=pa.list_(pa.int32()))}
        columns[f"{mark}by{k}"] = pa.array([[{"id": ids[n], "conditions": asked[n]} for n in ns] for _, ns in rows.values()], type=by)
        table = df.sparkSession.createDataFrame(pa.table(columns))
        out = out.join(F.broadcast(table), said == F.col(f"{mark}said{k}"), "left")
        got.append(k)
    if alone:
        found = [F.coalesce(F.col(f"{mark}by{k}"), F.array().cast("array<string>")) for k in got]
        return out.withColumn(into, found[0] if len(found) == 1 else F.sort_array(F.array_distinct(F.concat(*found)))).select(*(quoted(c) for c in kept if c.lower() != into.lower()), into)
    has = [F.coalesce(F.col(f"{mark}met{k}"), F.array().cast("array<int>")) for k in got]
    for (path, m), cs in others.items():
        v, d = scalar(path)
        holds = v.isNull() if m.op == "missing" else v.isNotNull() & predicate(m, v, d)
        has.append(F.when(F.coalesce(holds, F.lit(False)), F.array(*map(F.lit, sorted(cs)))).otherwise(F.array().cast("array<int>")))
    candidates = F.concat(*(F.coalesce(F.col(f"{mark}by{k}"), F.array().cast(CANDIDATES)) for k in got))
    fits = lambda p: F.forall(p["conditions"], lambda c: F.exists(f"{mark}has", lambda h: h == c))
    out = out.withColumn(f"{mark}all", candidates).withColumn(f"{mark}has", F.concat(*has))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(f"{mark}all", fits), lambda p: p["id"])))
    return out.withColumn(into, F.when(F.size(f"{mark}all") > 0, found).otherwise(F.array().cast("array<string>"))).select(*(quoted(c) for c in kept if c.lower() != into.lower()), into)
