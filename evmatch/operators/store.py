"""Pattern sets that no driver holds: compiled in tasks from a table, kept as tables, changed by what is new.

A store is a folder of tables, each in batches ``seq=n``:

* ``patterns``  a text with the condition to look it up by, and its others with what decides them; each text once
* ``ids``       (_id, _what)  ids and the digests of their texts
* ``terms``     what a value must say for a condition that is looked up, as in ``plans.terms``
* ``ways``      in which ways values are looked up, of each path
* ``deleted``   (_id)  ids whose patterns of earlier batches are gone

and a ``log`` that is written last, so that a batch is there as a whole or not at all, and one that failed is
written anew under its number.  Adding or deleting writes a batch and rewrites nothing.  One writer at a time.

Every term depends on its own pattern alone: a condition is named by a digest of what it says, and a range is
found in the one to three cells of a grid at least as wide as it is and then compared, so nothing has to be
known of other ranges.  An event looks up the condition of each pattern that fewest share (and long lists);
the other conditions are decided for the patterns found so, in the row.  Only the wildcards' rarest gram and the condition that fewest patterns share are chosen
over a batch, by counting in Spark.  The driver sees the ways that values have to be looked up (lengths of
beginnings, grid widths, ...) and the expressions of regexps, which are bounded, and no pattern.

Texts that many ids share are compiled, looked up and decided once; ids of the same texts are a group, which an event
meets or not, and only what is met is spread out over the ids.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.deploy import ship
from evmatch.errors import PatternError
from evmatch.functions.binding import bound
from evmatch.operators.flatten import Flattener, TypedFlattener
from evmatch.plans.columns import STEPS, agree
from evmatch.plans.join import BROADCAST_TERMS, COMMON_TERMS, EVENT, LOOK, _double_key, joined_apart, numbered, quoted
from evmatch.plans.pattern import Matcher, parse
from evmatch.plans.terms import Terms, _grams, fits, prefix_length, same_letters
from evmatch.sources.events import spread

#: ways in all that values may have to be looked up, and regexps among them
MOST_WAYS, MOST_REGEXPS = 5_000, 500
#: terms up to which a condition is decided in the row
FEW = 64
#: conditions of one value that a range, wildcard or beginning weighs as when a lookup is chosen
SOME = 1000
#: ways to look values up to which a row is carried along with each of its keys
CARRIED = 8
#: texts that a condition is looked up for, and ids of a text, up to which they lie beside its terms
TOGETHER = 2
CONDITIONS = "array<struct<condition:string,path:string,negative:boolean>>"
CHECK = "struct<_said:string,_number:double,_pieces:array<string>,_exact:string,_low:double,_high:double,_low_in:boolean,_high_in:boolean,_not:boolean>"
DECIDED = f"array<struct<condition:string,path:string,negative:boolean,terms:array<{CHECK}>>>"
TERM = "struct<_condition:string,_path:string,_way:string,_said:string,_number:double,_pieces:array<string>,_exact:string,_low:double,_high:double,_low_in:boolean,_high_in:boolean,_not:boolean,_grams:array<string>,_many:boolean>"
#: a condition to be looked up by, and how many values it may hold for: 0 few, 1 some, 2 most
KEYED = "struct<_lead:string,_broad:int>"
COMPILED = f"_what string, _json string, _error string, _conditions {CONDITIONS}, _keyed array<{KEYED}>, _terms array<{TERM}>"
LED = f"_what string, _json string, _lead string, _conditions {DECIDED}, _terms array<{TERM}>"
PATTERNS = f"_what string, _json string, _lead string, _conditions {DECIDED}, seq int"
TERMS = TERM[len("struct<") : -1].replace(":", " ").replace(",_grams array<string>,_many boolean", ", seq int")
WAYS = "_path string, _way string, _looked_up boolean, _not boolean, seq int"
GIVEN, IDS = "_id string, _json string, _what string", "_id string, _what string, seq int"
DELETED, REJECTED, LOG = "_id string, seq int", "_id string, _json string, _error string, seq int", "seq int, kind string"


def condition_name(path: tuple[str, ...], matchers: tuple[Matcher, ...]) -> str:
    said = [(m.op, m.text, m.texts, m.number, m.numbers, m.low, m.high, m.low_in, m.high_in, m.pieces, m.block and (m.block.version, m.block.low, m.block.high)) for m in matchers]
    return sha256(ascii((path, said)).encode()).hexdigest()[:32]


@lru_cache(maxsize=10_000)
def path_name(path: tuple[str, ...]) -> str:
    return json.dumps(path)


def cells(low: float, high: float) -> list[tuple[int, int]] | None:
    """(k, n): cells from n * 2^k on, as wide as the range at least, that cover it; None if no width is finite."""
    width = high - low
    if not math.isfinite(width) or (k := math.frexp(width)[1]) > 1000:
        return None
    return [(k, n) for n in range(math.floor(math.ldexp(low, -k)), math.floor(math.ldexp(high, -k)) + 1)]


class OwnTerms(Terms):
    """Terms of one pattern, as rows that depend on no other."""

    def __init__(self, text: str, strict_lookaround: bool = False):
        pattern = parse(text, strict_lookaround)
        self.rows: list[dict[str, Any]] = []
        super().__init__([pattern], list(pattern.paths), complement=True)
        self.path_names = [path_name(p) for p in self.paths]
        self.names = [condition_name(self.paths[path], ms) for path, ms in self.conditions]

    def _row(self, path: int, way: str, said: str | None, c: int, **more: Any) -> None:
        self.rows.append({"path": path, "_way": way, "_said": said, "c": c, **more})

    def _add(self, path: int, m: Matcher, c: int) -> None:
        if m.op == "exists" or m.op == "wildcard" and len(m.pieces) > 1 and not any(m.pieces):
            self._row(path, "e", "e", c)
        elif m.op == "number":
            self._row(path, "n", None, c, _number=m.number + 0.0)
            self._row(path, "n", "t" + m.text, c)
        elif m.op in ("regexp", "anything-but", "anything-but-numeric"):
            raw = {"regexp": m.text} if m.op == "regexp" else {"anything-but": list(m.texts or m.numbers)}
            self._row(path, "r" + json.dumps(raw), "r" + json.dumps(raw), c)
        else:
            super()._add(path, m, c)

    def _exclude(self, path: int, m: Matcher, c: int) -> None:
        for x in m.texts:
            self._row(path, "s", "s" + x, c, _not=True)
        for x in m.numbers:
            self._row(path, "n", None, c, _number=x + 0.0, _not=True)

    def _place_wildcards(self) -> None:
        for path, c, parts in self._wild:
            grams = sorted(_grams(parts))
            self._row(path, f"w{len(grams[0])}", None, c, _pieces=list(parts), _grams=[f"w{len(g)}:{g}" for g in grams])

    def _place_ranges(self, path: int, ranges: list[tuple[Matcher, int]]) -> None:
        for m, c in ranges:
            if m.low is None and m.high is None or None not in (m.low, m.high) and m.low > m.high:
                continue
            at = None if None in (m.low, m.high) else cells(m.low, m.high)
            for k, n in at or [(None, None)]:
                way = "f" if k is None else f"f{k}"
                self._row(path, way, way if n is None else f"{way}:{n}", c, _low=m.low, _high=m.high, _low_in=m.low_in, _high_in=m.high_in)

    def compiled(self) -> dict[str, Any]:
        """Conditions, those found under keys, and all terms."""
        for (path, key), found in self.said.items():
            way = {"s": "s", "i": "i"}.get(key[0], key.split(":")[0])
            for t in found:
                self._row(path, way, key, t.condition, _exact=t.exact)
        for path, cs in self.absent.items():
            for c in cs:
                self._row(path, "m", "m", c)
        asked = [(c, path) for (path, _), c in self.conditions.items()]
        negative = [path for c, path in asked if c in self.negative]
        broad = dict.fromkeys(self.names, 0)
        for r in self.rows:
            kind = 2 if r["_way"] in ("e", "m", "f", "p0", "x0") or r["_way"][0] == "r" else 1 if r["_way"][0] in "wfpx" else 0
            broad[self.names[r["c"]]] = max(broad[self.names[r["c"]]], kind)
        keyed = [{"_lead": self.names[c], "_broad": broad[self.names[c]]} for c in sorted(self.keyed)]
        terms = [{**{k: v for k, v in r.items() if k[0] == "_"}, "_path": self.path_names[r["path"]], "_condition": self.names[r["c"]], "_not": r.get("_not", False)} for r in self.rows]
        sizes = Counter(t["_condition"] for t in terms) if len(terms) > FEW else {}
        for t in terms:
            t["_many"] = sizes.get(t["_condition"], 0) > FEW
        if asked and not keyed:  # found by any value there
            name = f"e:{self.path_names[negative[0]]}"
            keyed = [{"_lead": name, "_broad": 2}]
            terms.append({"_condition": name, "_path": self.path_names[negative[0]], "_way": "e", "_said": "e", "_not": False, "_many": True})
        conditions = [{"condition": self.names[c], "path": self.path_names[path], "negative": c in self.negative} for c, path in asked]
        return {"_conditions": conditions, "_keyed": keyed, "_terms": terms}


def compiled(texts: DataFrame, strict_lookaround: bool) -> DataFrame:
    """COMPILED rows of (_what, _json), dealt over all cores: one that cannot be parsed has an ``_error`` and no terms."""
    ship(texts.sparkSession)
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    struct = lambda text: pa.struct([(f.split(":", 1)[0], kinds[f.split(":", 1)[1]]) for f in text[len("struct<") : -1].split(",")])
    schema = pa.schema([("_what", pa.string()), ("_json", pa.string()), ("_error", pa.string()), ("_conditions", pa.list_(struct(CONDITIONS[len("array<") : -1]))), ("_keyed", pa.list_(struct(KEYED))), ("_terms", pa.list_(struct(TERM)))])

    def one(what: str, text: str) -> dict[str, Any]:
        row: dict[str, Any] = {"_what": what, "_json": text, "_error": None, "_conditions": [], "_keyed": [], "_terms": []}
        try:
            return row | OwnTerms(text, strict_lookaround).compiled()
        except PatternError as e:
            return row | {"_error": f"{type(e).__name__}: {e}"}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_pylist([one(w.as_py(), t.as_py()) for w, t in zip(*some.columns, strict=True)], schema=schema)

    return spread(texts.select("_what", "_json")).mapInArrow(each, COMPILED)


def with_grams(terms: DataFrame) -> DataFrame:
    """Wildcards are found under that of their grams which fewest of the batch have."""
    plain = terms.filter("_grams is null").drop("_grams")
    wild = terms.filter("_grams is not null").dropDuplicates(["_condition", "_pieces"])
    each = wild.withColumn("_gram", F.explode("_grams")).drop("_grams")
    counts = each.groupBy("_path", "_gram").agg(F.count("*").alias("_n"))
    others = [c for c in plain.columns if c != "_said"]
    best = each.join(counts, ["_path", "_gram"]).groupBy(*others).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_said"))
    return plain.unionByName(best)


class PatternStore:
    """A set of patterns in a folder that all machines see."""

    def __init__(self, spark: SparkSession, path: str, strict_lookaround: bool = False, until: int | None = None):
        """An existing store; with ``until`` as it was after that batch, for reading only."""
        self.spark, self.path, self.strict_lookaround, self.until = spark, path.rstrip("/"), strict_lookaround, until

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options: Any) -> PatternStore:
        made = cls(spark, path, **options)
        spark.createDataFrame([(0, "created")], LOG).coalesce(1).write.parquet(f"{made.path}/log")
        return made

    # ---- batches

    def _batches(self) -> list[tuple[int, str]]:
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()  # one a batch
        return sorted((r["seq"], r["kind"]) for r in rows if self.until is None or r["seq"] <= self.until)

    def _read(self, name: str, schema: str, kind: str) -> DataFrame:
        found = [f"{self.path}/{name}/seq={seq}" for seq, k in self._batches() if k == kind]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*found)

    def _next(self) -> int:
        if self.until is not None:
            raise PatternError("a store as it was cannot be changed")
        return self._batches()[-1][0] + 1

    def _commit(self, seq: int, kind: str) -> int:
        self.spark.createDataFrame([(seq, kind)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return seq

    def _write(self, rows: DataFrame, name: str, seq: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/seq={seq}")

    # ---- changes

    def add_patterns(self, table: DataFrame) -> int:
        """Adds (pattern_id, pattern_json) rows to their ids' patterns; the number of the batch.

        Rows that are no patterns go to ``rejected`` with what is wrong; a null id or text is one of them.
        """
        seq = self._next()
        given = table.select(F.col("pattern_id").cast("string").alias("_id"), F.col("pattern_json").cast("string").alias("_json"))
        self._write(given.withColumn("_what", F.sha2("_json", 256)), "given", seq)
        given = self.spark.read.schema(GIVEN).parquet(f"{self.path}/given/seq={seq}")
        whole = given.filter("_id is not null and _json is not null")
        self._write(compiled(whole.select("_what", "_json").distinct(), self.strict_lookaround), "compiled", seq)
        rows = self.spark.read.schema(COMPILED).parquet(f"{self.path}/compiled/seq={seq}")
        wrong = whole.join(rows.filter("_error is not null").select("_what", "_error"), "_what").select("_id", "_json", "_error")
        lacking = given.filter("_id is null or _json is null").select("_id", "_json", F.lit("a pattern needs an id and a text").alias("_error"))
        self._write(wrong.union(lacking), "rejected", seq)
        self._write(whole.select("_id", "_what").distinct(), "ids", seq)
        fine = rows.filter("_error is null and size(_conditions) > 0")
        led = self._led(fine).select("_what", "_json", "_lead", _decided().alias("_conditions"), "_terms")
        self._write(led, "patterns", seq)
        led = self.spark.read.schema(LED).parquet(f"{self.path}/patterns/seq={seq}")
        looked_up = F.col("_t._many") | (F.col("_t._condition") == F.col("_lead"))
        each = led.select("_lead", F.explode("_terms").alias("_t")).select("_t.*", looked_up.alias("_looked_up"))
        self._write(each.groupBy("_path", "_way", "_looked_up").agg(F.max("_not").alias("_not")), "ways", seq)
        self._write(with_grams(each.filter("_looked_up").drop("_looked_up", "_many")).distinct(), "terms", seq)
        self._commit(seq, "added")
        for name in ("given", "compiled"):
            staged = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            staged.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(staged, True)
        return seq

    def _led(self, fine: DataFrame) -> DataFrame:
        """Compiled rows with the condition to look them up by: one that does not hold for most values, if there is one,
        and then that which fewest share.  What others share is counted only where there is a choice."""
        narrow = F.filter("_keyed", lambda k: k["_broad"] != 2)
        fine = fine.withColumn("_choice", F.when(F.size(narrow) > 0, narrow).otherwise(F.col("_keyed")))
        sure = fine.filter("size(_choice) = 1").withColumn("_lead", F.get("_choice", F.lit(0))["_lead"])
        others = fine.filter("size(_choice) > 1")
        if others.isEmpty():
            return sure
        choice = others.select("_what", F.inline("_choice"))
        shared = fine.select(F.inline("_keyed")).groupBy("_lead").agg(F.count("*").alias("_shared"))
        leads = choice.join(shared, "_lead").groupBy("_what").agg(F.min_by("_lead", F.struct(F.col("_shared") * F.when(F.col("_broad") == 1, SOME).otherwise(1), "_lead")).alias("_lead"))
        return sure.unionByName(others.join(leads, "_what"))

    def delete_patterns(self, ids: DataFrame) -> int:
        """Deletes all patterns so far of the ids in ``pattern_id``; an unknown id is no error."""
        seq = self._next()
        self._write(ids.select(F.col("pattern_id").cast("string").alias("_id")).filter("_id is not null").distinct(), "deleted", seq)
        return self._commit(seq, "deleted")

    def compact(self, path: str) -> PatternStore:
        """A new store of the live patterns alone."""
        made = PatternStore.create(self.spark, path, strict_lookaround=self.strict_lookaround)
        made.add_patterns(self.live().select(F.col("_id").alias("pattern_id"), F.col("_json").alias("pattern_json")))
        return made

    # ---- what is there

    def _ids(self) -> DataFrame:
        """(_id, _what) of the live patterns, once each."""
        dead = self._read("deleted", DELETED, "deleted").groupBy("_id").agg(F.max("seq").alias("_dead"))
        return self._read("ids", IDS, "added").join(dead, "_id", "left").filter("_dead is null or seq > _dead").select("_id", "_what").distinct()

    def _texts(self) -> DataFrame:
        """Each text once; any batch's way to look it up will do, as terms are never taken out."""
        found = self._read("patterns", PATTERNS, "added")
        if sum(kind == "added" for _, kind in self._batches()) < 2:
            return found.drop("seq")
        return found.groupBy("_what").agg(F.first(F.struct("_json", "_lead", "_conditions")).alias("_of")).select("_what", "_of.*")

    def live(self) -> DataFrame:
        """A row for each id and text."""
        return self._ids().join(self._texts(), "_what")

    def rejected(self) -> DataFrame:
        """(pattern_id, pattern_json, error, seq)"""
        return self._read("rejected", REJECTED, "added").toDF("pattern_id", "pattern_json", "error", "seq")

    def pattern_count(self) -> int:
        """Of ids."""
        return self.live().select("_id").distinct().count()

    # ---- matching

    def match_long(self, df: DataFrame, key: list[str], flattener: Flattener | None = None) -> DataFrame:
        """(*key, pattern_id), each pattern once a row, as ``PatternSet.match_long`` gives them.

        Leaves meet terms, and events their patterns, in shuffled joins; keys that many events say are met by a
        broadcast of their terms if these are few.  Only rows that met a condition are grouped by event.
        """
        flattener = flattener or TypedFlattener()
        ways = self._read("ways", WAYS, "added").groupBy("_path", "_way").agg(F.max("_looked_up").alias("up"), F.max(~F.col("_looked_up")).alias("inside")).limit(MOST_WAYS + 1).collect()
        if len(ways) > MOST_WAYS or sum(w["_way"][0] == "r" for w in ways) > MOST_REGEXPS:
            raise PatternError(f"values would have to be looked up in over {MOST_WAYS} ways, or meet over {MOST_REGEXPS} regexps")
        if not ways:
            return df.select(*map(quoted, key), F.lit("").alias("pattern_id")).filter(F.lit(False))
        event = getattr(flattener, "event", None)
        df = df.select(*map(quoted, dict.fromkeys([*key, event]))) if event else df
        names = sorted({w["_path"] for w in ways})
        paths = [tuple(json.loads(n)) for n in names]
        texts, terms, ids = self._texts(), self._read("terms", TERMS, "added"), self._ids()
        beside = texts.filter(F.exists("_conditions", lambda c: c["terms"].isNull() & (c["condition"] != F.col("_lead"))))
        many = terms.count()
        few = many <= BROADCAST_TERMS
        carried = (few or sum(w["up"] for w in ways) <= CARRIED) and beside.isEmpty()
        alike = ids.groupBy("_id").agg(F.count("*").alias("_n"), *(F.bit_xor(F.xxhash64("_what", F.lit(k))).alias(f"_h{k}") for k in range(3)))
        alone = alike.filter("_n > 1").isEmpty()
        sides = {name: [{w["_way"] for w in ways if w["_path"] == name and w[side]} for side in ("up", "inside")] for name in names}
        if carried and alone and all(len(up - {"m"}) <= 1 and up <= {"s", "n", "e", "m"} for up, _ in sides.values()):
            scalars = _scalars(df, flattener, paths)
            if scalars:
                return self._plain(df, key, dict(zip(names, scalars, strict=True)), sides, texts, terms, ids, many <= COMMON_TERMS)
        flat, leaves = flattener(df, paths)
        none, parts = F.lit(None).cast("string"), []
        for name, path in zip(names, paths, strict=True):
            up, inside = sides[name]
            told = F.transform(leaves[path], _saying(name, self._keys(up), self._keys({w for w in inside if w[0] not in "wf"}), any(w[0] in "wi" for w in up | inside)))
            if "m" in up | inside:
                missing = F.array(F.lit("m"))
                nothing = F.struct(F.lit(name).alias("path"), F.lit(-1).alias("n"), missing.alias("up"), missing.alias("keys"), none.alias("v"), none.cast("double").alias("d"), F.array().cast(STEPS).alias("trail"))
                told = F.when(F.size(leaves[path]) == 0, F.array(nothing)).otherwise(told)
            parts.append(told)
        rows = numbered(flat.select(_carried(key), F.concat(*parts).alias("_leaves")))
        row = ["_key", "_leaves"] if carried else []
        each = rows.select(EVENT, *row, F.explode("_leaves").alias("_leaf"))
        each = each.select(EVENT, *row, F.col("_leaf.path").alias("_path"), F.col("_leaf.n").alias("_n"), F.col("_leaf.v").alias("_v"), F.col("_leaf.d").alias("_d"), F.col("_leaf.trail").alias("_trail"), F.explode("_leaf.up").alias("_said"))
        keyed = terms.withColumn("_said", _term_key()).drop("_number", "_way", "seq").distinct()
        met = each.join(F.broadcast(keyed), ["_path", "_said"]) if few else joined_apart(each, keyed, "inner")
        met = met.filter(_fine(F.col("_v"), F.col("_d"), F.col))
        one = F.struct(F.col("_condition").alias("c"), F.col("_n").alias("n"), F.col("_trail").alias("trail"), F.col("_not").alias("ex"))
        if carried:  # nothing but what was met here is asked for, so no other row of the event is
            leading = met.filter("not _not").select(EVENT, *row, F.array(one).alias("_got"), F.col("_condition").alias("_lead"))
        else:
            events = met.groupBy(EVENT).agg(F.collect_set(one).alias("_got")).join(rows, EVENT)
            leading = events.select("*", F.explode(F.array_distinct(F.transform(F.filter("_got", lambda g: ~g["ex"]), lambda g: g["c"]))).alias("_lead"))
        found = leading.join(texts.select("_what", "_lead", "_conditions"), "_lead").filter(_together()).select(EVENT, "_key", "_what")
        if alone:
            groups = ids.withColumnRenamed("_what", "_group")
            found = found.withColumnRenamed("_what", "_group")
        else:
            groups = alike.select("_id", F.concat_ws(":", "_n", "_h0", "_h1", "_h2").alias("_group"))
            found = found.join(ids.join(groups, "_id").select("_what", "_group").distinct(), "_what")
        out = found.select(EVENT, "_key", "_group").dropDuplicates([EVENT, "_group"]).join(groups, "_group")
        return out.select(*(["_key.*"] if key else []), F.col("_id").alias("pattern_id"))

    def _plain(self, df: DataFrame, key: list[str], scalars: dict[str, tuple[Column, Column]], sides: dict[str, list[set[str]]], texts: DataFrame, terms: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
        """``match_long`` of fields in no array whose values say one key each, for ids of one text each.

        A row meets a pattern once then, as that is looked up by one condition, and so by one field.  So rows are not
        numbered, kept or made distinct, and they move once: to the terms, with which the patterns and ids lie that are
        found by them.  Where a condition is looked up for many ids, these are joined with what was met.
        """
        said, leaves = [], []
        for name, (v, d) in scalars.items():
            up, inside = sides[name]
            one = {"s": F.concat(F.lit("s"), v), "n": F.when(d.isNotNull(), _double_key(d)).otherwise(F.concat(F.lit("t"), v)), "e": F.lit("e")}
            if up:
                found = F.when(v.isNotNull(), one[min(up - {"m"})]) if up - {"m"} else F.when(v.isNotNull(), F.lit(None).cast("string"))
                said.append((name, found.otherwise(F.lit("m")) if "m" in up else found))
            if inside:
                text = v if any(w[0] in "wi" for w in inside) else F.lit(None).cast("string")
                ways = {w for w in inside if w[0] not in "wfm"}
                keys = F.array(*(one[w] for w in sorted(ways))).cast("array<string>") if ways <= set(one) else self._keys(ways)(v, d)
                n, keys = F.when(v.isNotNull(), 0).otherwise(-1), F.when(v.isNotNull(), keys).otherwise(F.array(F.lit("m")))
                leaf = F.struct(F.lit(name).alias("path"), n.alias("n"), keys.alias("keys"), text.alias("v"), d.alias("d"))
                leaves.append(leaf if "m" in inside else F.when(v.isNotNull(), leaf))
        values = F.array(*leaves) if leaves else F.array().cast("array<struct<path:string,n:int,keys:array<string>,v:string,d:double>>")

        def asking(rows: DataFrame) -> DataFrame:
            if len(said) == 1:
                return rows.select(_carried(key), values.alias("_leaves"), F.lit(said[0][0]).alias("_path"), said[0][1].alias("_said")).filter("_said is not null")
            each = F.explode(F.array(*(F.struct(F.lit(name).alias("_path"), x.alias("_said")) for name, x in said)))
            return rows.select(_carried(key), values.alias("_leaves"), each.alias("_s")).select("_key", "_leaves", "_s.*").filter("_said is not null")

        keyed = terms.filter("not _not").select("_path", _term_key().alias("_said"), F.col("_condition").alias("_lead")).distinct()
        others = F.filter("_conditions", lambda c: c["condition"] != F.col("_lead")).alias("_conditions")  # the lead is met
        decided = texts.select("_what", "_lead", others)
        few_of = lambda rows, by: rows.groupBy(by).count().filter(F.col("count") > TOGETHER).isEmpty()
        together = few_of(decided, "_lead") and few_of(ids, "_what")
        wanted = keyed.join(decided.join(ids, "_what").drop("_what"), "_lead").drop("_lead") if together else keyed
        met = asking(df).join(F.broadcast(wanted), ["_path", "_said"]) if few else joined_apart(asking(df), wanted, "inner", asking(df.sample(LOOK, seed=1)))
        found = (met if together else met.join(decided, "_lead")).filter(_each_holds())
        out = found if together else found.join(ids, "_what")
        return out.select(*(["_key.*"] if key else []), F.col("_id").alias("pattern_id"))

    def _keys(self, ways: set[str]) -> Callable[[Column, Column], Column]:
        return _keys(ways, self.strict_lookaround)


def _decided() -> Column:
    """Conditions with the terms that decide them in the row; null where they are looked up."""

    def one(c: Column) -> Column:
        own = F.filter("_terms", lambda t: t["_condition"] == c["condition"])
        apart = (c["condition"] == F.col("_lead")) | F.exists(own, lambda t: t["_many"])
        names = [f.split(":")[0] for f in CHECK[len("struct<") : -1].split(",")]
        terms = F.transform(own, lambda t: F.struct(*(t[n].alias(n) for n in names)))
        return F.struct(c["condition"].alias("condition"), c["path"].alias("path"), c["negative"].alias("negative"), F.when(~apart, terms).alias("terms"))

    return F.transform("_conditions", one).cast(DECIDED)


def _keys(ways: set[str], strict_lookaround: bool) -> Callable[[Column, Column], Column]:
    """What a value of a path has to say."""
    terms = Terms([], [])
    terms.ways = [own] = Terms([], [()]).ways
    widths: list[int] = []
    for w in sorted(ways):
        if w == "s":
            own.text = True
        elif w == "n":
            own.number = True
        elif w == "i":
            own.folded = True
        elif w[0] in "px":
            (own.starts if w[0] == "p" else own.ends).add(int(w[1:]))
        elif w[0] == "w":
            own.grams.add(int(w[1:]))
        elif w[0] in "46":
            own.blocks.add((int(w[0]), int(w[2:])))
        elif w[0] == "r":
            own.others[parse({"v": [json.loads(w[1:])]}, strict_lookaround).fields[0][1][0]] = w[1:]
        elif w[0] == "f" and w != "f":
            widths.append(int(w[1:]))

    def keys(v: Column, d: Column) -> Column:
        number = d.isNotNull() & ~F.isnan(d)
        more = [F.when(number, F.concat(F.lit(f"f{k}:"), F.floor(d / F.lit(2.0**k)).cast("string"))) for k in sorted(widths)]
        more += [F.when(number, F.lit("f"))] if "f" in ways else []
        more += [F.when(d.isNotNull(), _double_key(d))] if own.number else []
        more += [F.lit("e")] if "e" in ways else []
        texts = terms.texts(0, v, d)
        return F.concat(texts, F.array_compact(F.array(*more))) if more else texts

    return keys


def _saying(path: str, up: Callable[[Column, Column], Column], inside: Callable[[Column, Column], Column], checked: bool) -> Callable[[Column, Column], Column]:
    def said(x: Column, n: Column) -> Column:
        v = x["v"] if checked else F.lit(None).cast("string")
        return F.struct(F.lit(path).alias("path"), n.alias("n"), up(x["v"], x["d"]).alias("up"), inside(x["v"], x["d"]).alias("keys"), v.alias("v"), x["d"].alias("d"), x["trail"].alias("trail"))

    return said


def _fine(v: Column, d: Column, of: Callable[[str], Column]) -> Column:
    """What a term asks for besides its key."""
    low, high = of("_low"), of("_high")
    above = low.isNull() | (d > low) | of("_low_in") & (d == low)
    below = (high.isNull() | (d < high) | of("_high_in") & (d == high)) & ~F.isnan(d)
    pieces = F.when(of("_pieces").isNotNull(), fits(v, of("_pieces")))
    return pieces.when(of("_exact").isNotNull(), same_letters(v, of("_exact"))).when(of("_low_in").isNotNull(), above & below).otherwise(True)


def _carried(key: list[str]) -> Column:
    return (F.struct(*map(quoted, key)) if key else F.struct(F.lit(0).alias("_"))).alias("_key")


def _term_key() -> Column:
    return F.when(F.col("_number").isNotNull(), _double_key(F.col("_number"))).otherwise(F.col("_said"))


def _scalars(df: DataFrame, flattener: Flattener, paths: list[tuple[str, ...]]) -> list[tuple[Column, Column]] | None:
    """(v, d) of each path, if all are of typed columns and in no array or map."""
    if type(flattener) is not TypedFlattener or flattener.nulls:
        return None
    none = F.lit(None)
    found = [flattener.scalar(df, p) if p[0] in df.columns else (none.cast("string"), None) for p in paths]
    return [(f[0], none.cast("double") if f[1] is None else f[1]) for f in found if f] if all(found) else None


def _meets(t: Column, x: Column) -> Column:
    """Whether a leaf is what a term asks for."""
    by_key = t["_pieces"].isNull() & t["_low_in"].isNull()
    said = F.when(t["_number"].isNotNull(), x["d"] == t["_number"]).when(by_key, F.array_contains(x["keys"], t["_said"])).otherwise(x["n"] >= 0)
    return F.coalesce(said & _fine(x["v"], x["d"], lambda name: t[name]), F.lit(False))


def _inside(c: Column, x: Column) -> Column:
    """Whether a leaf meets a condition that is decided in the row."""
    any_of = lambda ex: F.exists(c["terms"], lambda t: (t["_not"] == ex) & _meets(t, x))
    return (x["path"] == c["path"]) & (any_of(F.lit(False)) | c["negative"] & (x["n"] >= 0) & ~any_of(F.lit(True)))


def _each_holds() -> Column:
    """Whether all conditions hold for values in no array."""
    return F.forall("_conditions", lambda c: F.exists("_leaves", lambda x: F.coalesce(_inside(c, x), F.lit(False))))


def _together() -> Column:
    """Whether all conditions of a pattern hold for values of the same elements of arrays."""

    def trails(c: Column) -> Column:
        sure = F.filter("_got", lambda g: (g["c"] == c["condition"]) & ~g["ex"])
        left_out = lambda x: F.exists("_got", lambda g: (g["c"] == c["condition"]) & g["ex"] & (g["n"] == x["n"]))
        default = F.filter("_leaves", lambda x: (x["path"] == c["path"]) & (x["n"] >= 0) & ~left_out(x))
        of = lambda found: F.transform(found, lambda x: x["trail"])
        looked_up = F.when(c["negative"], F.array_union(of(sure), of(default))).otherwise(of(sure))
        inside = F.filter("_leaves", lambda x: _inside(c, x))
        return F.when(c["terms"].isNull(), looked_up).otherwise(of(inside))

    def meet(acc: Column, c: Column) -> Column:
        fitting = lambda a, found: F.transform(F.filter(found, lambda t: agree(a, t)), lambda t: F.array_union(a, t))
        return bound(trails(c), lambda found: F.array_distinct(F.flatten(F.transform(acc, lambda a: fitting(a, found)))), f"array<{STEPS}>")

    alone = (F.size("_conditions") == 1) & ~F.get("_conditions", F.lit(0))["negative"]  # the lead, which holds
    return alone | (F.size(F.aggregate("_conditions", F.array(F.array().cast(STEPS)), meet)) > 0)


__all__ = ["OwnTerms", "PatternStore", "cells", "compiled", "prefix_length"]
