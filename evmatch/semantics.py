"""More named queries: the registry, flatteners, event syntax and the regexp dialect, each with its SQL.

They join those of ``queries`` under the same names' tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from evmatch.errors import PatternError, UnsupportedMediaType
from evmatch.functions import iregexp, numbits
from evmatch.functions.casefold import partner
from evmatch.operators.flatten import ExactFlattener, VariantFlattener
from evmatch.operators.registry import PatternSet
from evmatch.plans.pattern import Path, parse
from evmatch.queries import CUST, EVENT, LINE, ORDER, ORACLES, PART, add, simple, table
from evmatch.sources.events import as_event, spread

BY_TYPE = {"c": {"event_type": ["click"]}, "v": {"event_type": ["view"]}, "p": {"event_type": ["purchase"]}}

# ---------------------------------------------------------------- the registry


@add("clone_then_add", "SELECT event_id, 'clone' AS side, 'c' AS ids FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'first', CASE event_type WHEN 'click' THEN 'c' ELSE 'v' END FROM events WHERE event_type IN ('click', 'view')")
def clone_then_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = PatternSet.of({"c": BY_TYPE["c"]})
    clone = first.clone()
    first.add_pattern("v", BY_TYPE["v"])
    clone.add_pattern("p", BY_TYPE["p"])
    clone.delete_patterns("p")
    events = table(spark, sf_dir, "events")
    told = [p.match_long(events, EVENT).select("event_id", F.lit(side).alias("side"), F.col("pattern_id").alias("ids")) for side, p in (("clone", clone), ("first", first))]
    return told[0].unionByName(told[1])


@add("pruner_statistics", "SELECT count(*) FILTER (event_type = 'click')::BIGINT AS emitted, count(*) FILTER (event_type = 'view')::BIGINT AS filtered, (count(*) FILTER (event_type IN ('click', 'view')) >= 1000 AND count(*) FILTER (event_type = 'view') > 0.2 * count(*) FILTER (event_type = 'click'))::INT AS dropped FROM events")
def pruner_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while a table is matched; the deleted pattern's results lead to a rebuild."""
    patterns, seen = PatternSet.of({"c": BY_TYPE["c"], "v": BY_TYPE["v"]}), Observation()
    patterns.delete_patterns("v")
    patterns.match(table(spark, sf_dir, "events"), observe=seen).write.format("noop").mode("overwrite").save()
    counts = (seen.get["emitted"], seen.get["filtered"])
    return spark.createDataFrame([(*counts, patterns.absorb(seen))], "emitted long, filtered long, dropped int")


@add("rebuild_keeps_matches", "SELECT event_id, 'c' AS pattern_id FROM events WHERE event_type = 'click'")
def rebuild_keeps_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = PatternSet.of(BY_TYPE)
    patterns.delete_patterns("v")
    patterns.delete_patterns("p")
    patterns.delete_patterns("unknown")
    if patterns.rebuild() != 2 or patterns.rebuild() != 0:
        raise AssertionError("two patterns were deleted")
    return patterns.match_long(table(spark, sf_dir, "events"), EVENT)


_EMITTED, _HELD = "count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'view')"


@add("maybe_rebuild_switched_off", f"SELECT 0 AS dropped, ({_EMITTED} + {_HELD} >= 1000 AND {_HELD} > 0.2 * {_EMITTED})::INT AS dropped_after, 2 AS n_before FROM events")
def maybe_rebuild_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table's matching has counted leads to no rebuild while that is off."""
    patterns, seen = PatternSet.builder().with_auto_rebuild(False).build(), Observation()
    patterns.add_pattern("c", BY_TYPE["c"]).add_pattern("v", BY_TYPE["v"])
    before = patterns.pattern_count()
    patterns.delete_patterns("v")
    patterns.match(table(spark, sf_dir, "events"), observe=seen).write.format("noop").mode("overwrite").save()
    off = patterns.absorb(seen)
    patterns.auto_rebuild = True
    return spark.createDataFrame([(off, patterns.maybe_rebuild(), before)], "dropped int, dropped_after int, n_before int")


@add("registry_listing", "SELECT DISTINCT event_type AS pattern_id, true AS there FROM events WHERE event_type NOT IN ('click', 'error') UNION ALL SELECT 'click', false")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r[0] for r in table(spark, sf_dir, "events").filter("event_type <> 'error'").select("event_type").distinct().toLocalIterator()]
    patterns = PatternSet.of({k: {"event_type": [k]} for k in kinds})
    patterns.delete_patterns("click")
    cleared = patterns.clone()
    cleared.clear()
    if not cleared.is_empty() or patterns.is_empty() or len(patterns.pattern_ids()) != patterns.pattern_count():
        raise AssertionError("only the clone was cleared")
    return spark.createDataFrame([(k, patterns.contains_pattern(k)) for k in kinds], "pattern_id string, there boolean")


@add("builder_options", "SELECT event_id, 'c' AS pattern_id FROM events WHERE event_type = 'click'")
def builder_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        PatternSet.builder().with_media_type("text/csv")
        raise AssertionError("a media type that is not JSON")
    except UnsupportedMediaType:
        pass
    patterns = PatternSet.builder().with_media_type("application/json").with_auto_rebuild(False).build().add_pattern("c", BY_TYPE["c"])
    return patterns.match_long(table(spark, sf_dir, "events"), EVENT)


class KeyValues:
    """A flattener of one's own: ``k=v;k=v`` text in a column, all at the top."""

    event = "line"

    def __call__(self, df: DataFrame, paths: list[Path]) -> tuple[DataFrame, dict[Path, Column]]:
        from evmatch.operators.flatten import LEAVES

        pairs = F.split("line", ";")
        leaf = lambda x: F.struct(F.substring_index(x, "=", -1).alias("v"), F.lit(None).cast("double").alias("d"), F.array().cast("array<struct<arr:string,pos:int>>").alias("trail"))
        named = lambda key: lambda x: F.substring_index(x, "=", 1) == key
        return df, {p: F.transform(F.filter(pairs, named(p[0])), leaf).cast(LEAVES) for p in paths}


@add("own_flattener", "SELECT o_orderkey, 'f' AS pattern_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1-%'")
def own_flattener(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s="), "o_orderstatus", F.lit(";p="), "o_orderpriority").alias("line"))
    return PatternSet.of({"f": {"s": ["F"], "p": [{"prefix": "1-"}]}}, flattener=KeyValues()).match_long(lines, ORDER)


@add("single_events", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'one' ELSE '' END AS ids, c_nationkey = 1 AS has, (c_nationkey = 1)::INT AS n, 1 AS leaves FROM customer")
def single_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event by event, in tasks."""
    patterns = PatternSet.of({"one": {"c_nationkey": [1]}})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, ",".join(patterns.matches_for_event(e)), patterns.has_matches(e), patterns.count_matches(e), patterns.flatten_only(e)) for key, e in zip(b["c_custkey"], b["event"], strict=True)]
            yield pd.DataFrame(rows, columns=["c_custkey", "ids", "has", "n", "leaves"])

    return as_event(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))).mapInPandas(each, "c_custkey long, ids string, has boolean, n int, leaves int")


@add("number_keys_sort", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal - 5000, c_custkey))::INT AS place FROM customer")
def number_keys_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte keys of numbers are in the numbers' order, and read back to the same number."""
    @F.pandas_udf("binary")
    def key(x: pd.Series) -> pd.Series:
        made = x.map(numbits.to_key)
        if not (made.map(numbits.key_to_text).map(float) == x).all():
            raise AssertionError("a key that reads back to another number")
        return made

    keyed = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", key(F.col("c_acctbal") - 5000).alias("k"))
    return keyed.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("k", "c_custkey")).alias("place"))


# ---------------------------------------------------------------- many patterns


@add("match_60_patterns_array", "SELECT p_partkey, 's' || p_size AS ids FROM part")
def match_60_patterns_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = PatternSet.of({f"s{n}": {"p_size": [n]} for n in range(1, 61)}).match(table(spark, sf_dir, "part"))
    return got.select("p_partkey", F.array_join("matches", ",").alias("ids"))


@add("null_and_repeated_keys", "SELECT event_type, count(*)::BIGINT AS n, 'q' || (event_id % 60) AS pattern_id FROM events GROUP BY ALL")
def null_and_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing tells apart keep their own matches beyond any number of patterns."""
    rows = table(spark, sf_dir, "events").select(F.lit(None).cast("int").alias("key"), "event_type", (F.col("event_id") % 60).alias("path"))
    got = PatternSet.of({f"q{n}": {"path": [n]} for n in range(60)}).match(rows)
    return got.select("event_type", F.explode("matches").alias("pattern_id")).groupBy("event_type", "pattern_id").agg(F.count(F.lit(1)).alias("n"))


@add("many_patterns_shared_ids", "SELECT l_orderkey, l_linenumber, 'g' || (l_partkey % 7) AS pattern_id FROM lineitem WHERE l_partkey BETWEEN 1 AND 140")
def many_patterns_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {f"g{k}": [{"l_partkey": [n]} for n in range(1, 141) if n % 7 == k] for k in range(7)}
    return PatternSet.of(groups).match_long(table(spark, sf_dir, "lineitem"), LINE)


# ---------------------------------------------------------------- events


def events_of(text: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("event_id", F.expr(text).alias("event"))


QUOTED = "concat('{\"a\":\"', event_type, '\",\"a\":\"x\",\"b\":', event_id % 3, '}')"
simple("repeated_keys_exact", "events", EVENT, {"x": {"a": ["x"]}, "c": {"a": ["click"]}, "n": {"a": [{"anything-but": "x"}], "b": [1]}}, {"x": "true", "c": "event_type = 'click'", "n": "event_id % 3 = 1"}, events_of(QUOTED), flattener=ExactFlattener())
simple("repeated_pattern_keys", "events", EVENT, {"last": '{"event_type":["click"],"event_type":["view"]}'}, {"last": "event_type = 'view'"})
SPACES = "concat(' \\t\\n{ \"a\" \\r\\n:\\t[ \"', event_type, '\" , 1 ] \\n} ')"
simple("white_space_exact", "events", EVENT, {"c": {"a": ["click"]}, "one": {"a": [1]}}, {"c": "event_type = 'click'", "one": "true"}, events_of(SPACES), flattener=ExactFlattener())
simple("white_space_variant", "events", EVENT, {"c": {"a": ["click"]}, "one": {"a": [1]}}, {"c": "event_type = 'click'", "one": "true"}, events_of(SPACES), flattener=VariantFlattener())
DOTTED = "CASE event_id % 3 WHEN 0 THEN '{\"a.b\":1}' WHEN 1 THEN '{\"a\":{\"b\":1}}' ELSE '{\"a\":[{\"a\":1}]}' END"
simple("dots_are_dots", "events", EVENT, {"dot": {"a.b": [1]}, "deep": {"a": {"b": [1]}}, "own": {"a": [1]}}, {"dot": "event_id % 3 = 0", "deep": "event_id % 3 = 1"}, events_of(DOTTED), flattener=ExactFlattener())
NESTED = "CASE event_id % 4 WHEN 0 THEN '{\"a\":[[[[[\"x\"]]]]]}' WHEN 1 THEN '{\"a\":[1,[2,[\"x\",{\"b\":[[\"y\"]]}]]]}' WHEN 2 THEN '{\"a\":[[{\"b\":\"y\",\"c\":1},{\"b\":\"n\",\"c\":2}]]}' ELSE '{\"a\":[[]]}' END"
IN_ARRAYS = {"x": {"a": ["x"]}, "y": {"a": {"b": ["y"]}}, "cross": {"a": {"b": ["y"], "c": [2]}}, "same": {"a": {"b": ["n"], "c": [2]}}, "none": {"a": [{"exists": False}], "d": [{"exists": False}]}}
IN_ARRAYS_SQL = {"x": "event_id % 4 IN (0, 1)", "y": "event_id % 4 IN (1, 2)", "same": "event_id % 4 = 2", "none": "event_id % 4 IN (2, 3)"}
simple("arrays_in_arrays_exact", "events", EVENT, IN_ARRAYS, IN_ARRAYS_SQL, events_of(NESTED), flattener=ExactFlattener())
simple("arrays_in_arrays_variant", "events", EVENT, IN_ARRAYS, IN_ARRAYS_SQL, events_of(NESTED), flattener=VariantFlattener())
#: event texts, and whether they are one strict JSON object
TEXTS = (('{"a":01}', False), ('{"a":-}', False), ('{"a":1.}', False), ('{"a":[1,]}', False), ('{"a":1,}', False), ("{'a':1}", False), ('{"a":1} x', False), ('{"a":"\\u00e9"}', True), ('{"a":"\\q"}', False), ('{"a":NaN}', False), ("[1]", False), ('{"a":1e5}', True), ('{"a":{}}', True), ("", False))


@add("strict_events", f"SELECT event_id, (event_id % {len(TEXTS)} IN (7, 11, 12)) AS good FROM events")
def strict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``events`` says one of the texts."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in TEXTS)), (F.col("event_id") % len(TEXTS) + 1).cast("int"))
    got = PatternSet.of({"a": {"a": [{"exists": True}]}}, flattener=ExactFlattener()).match(table(spark, sf_dir, "events").select("event_id", text.alias("event")))
    return got.select("event_id", F.col("_event_error").isNull().alias("good"))


def verdicts(rows: DataFrame, key: str, text: str, into: str, accepts: Callable[[str], object]) -> DataFrame:
    """(key, ``into``): whether each text is taken, judged in tasks, each text once a batch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {}
            for t in b[text].unique():
                try:
                    accepts(t)
                    known[t] = True
                except PatternError:
                    known[t] = False
            yield pd.DataFrame({key: b[key], into: b[text].map(known).astype(bool)})

    return rows.select(key, text).mapInPandas(each, f"{key} long, {into} boolean")


#: pattern texts that are none; ``{t}`` is an event's type
BAD = (
    '{"{t}":', '["{t}"]', '{"{t}":1}', '{"{t}":[["x"]]}', '{"a":[{"{t}":1}]}', '{"{t}":[{}]}', '{"{t}":[1e999]}', '{"{t}":[' + "9" * 400 + "]}", '{"{t}":[{"numeric":["<"]}]}', '{"{t}":[{"numeric":["?",1]}]}', '{"{t}":[{"numeric":["<","1"]}]}',
    '{"{t}":[{"anything-but":[]}]}', '{"{t}":[{"anything-but":["x",1]}]}', '{"{t}":[{"exists":"yes"}]}', '{"{t}":[{"prefix":1}]}', '{"{t}":[{"cidr":"10.0.0.0/33"}]}', '{"{t}":[{"wildcard":"**"}]}', '{"{t}":[{"regexp":"("}]}',
)


@add("bad_patterns", f"SELECT event_id, event_id % {2 * len(BAD)} < {len(BAD)} AS rejected FROM events")
def bad_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns made of the events' types, every other one sound."""
    n = F.col("event_id") % (2 * len(BAD))
    form = F.coalesce(F.get(F.array(*map(F.lit, BAD)), n.cast("int")), F.lit('{"{t}":["{t}",{"numeric":["<",1]}]}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(form, F.lit("{t}"), F.col("event_type")).alias("pattern"))
    return verdicts(rows, "event_id", "pattern", "_taken", parse).select("event_id", (~F.col("_taken")).alias("rejected"))


# ---------------------------------------------------------------- regexps and case

NAME, SEGMENT = "c_name", "c_mktsegment"
simple("regexp_lazy", "customer", CUST, {"l": {NAME: [{"regexp": "C.+?r#.*?~d??~d{3}?1"}]}}, {"l": "c_name LIKE 'Customer#%1'"})
simple("regexp_name_classes", "customer", CUST, {"i": {SEGMENT: [{"regexp": "~i~c*"}]}, "n": {NAME: [{"regexp": "~i+#~c+"}]}, "not": {SEGMENT: [{"regexp": "~I+"}]}}, {"i": "true", "n": "true"})
simple("regexp_multi_escapes", "customer", CUST, {"w": {NAME: [{"regexp": "~w+#~d+"}]}, "s": {NAME: [{"regexp": "~S+"}]}, "x": {NAME: [{"regexp": "~D+~W~d*"}]}}, {"s": "true", "x": "true", "w": "true"})
simple("regexp_inverted_category", "customer", CUST, {"l": {SEGMENT: [{"regexp": "~P{Ll}+"}]}, "n": {NAME: [{"regexp": "[~P{Nd}]+~p{Nd}+"}]}}, {"l": "true", "n": "true"})
simple("regexp_counts", "part", PART, {"two": {"p_name": [{"regexp": "[a-z]{3,5} [a-z]{4,}"}]}, "none": {"p_name": [{"regexp": "[a-z]{2}"}]}}, {"two": "regexp_full_match(p_name, '[a-z]{3,5} [a-z]{4,}')"})
#: regexps, and whether the dialect has them; samples of our own for each rule
DIALECT = (
    ("", True), ("a|", True), ("(a|b)*c?", True), ("a{2}", True), ("a{2,}", True), ("a{2,3}", True), ("[a-c~-]", True), ("[^a]", True), ("[-a]", True), ("[a-]", True), ("~n~r~t", True),
    ("~p{L}", True), ("~P{Nd}", True), ("~p{IsBasicLatin}", True), (".", True), ("a(?=b)", True), ("a(?!b)", True), ("(?<=a)b", True), ("(?<!a)b", True), ("a+?", True),
    ("a{3,2}", False), ("*a", False), ("+", False), ("(a", False), ("a)", False), ("[a", False), ("[]", False), ("[b-a]", False), ("a**", False), ("~", False), ("~q", False), ("~p{Xx}", False),
    ("~p{IsNoSuchBlock}", False), ("(.)~1", False), ("(?<=a+)b", False), ("(?=(?=a)b)c", False), ("a{", False), ("a{x}", False), ("(?i)a", False), ("[a-~d]", False),
)


@add("regexp_dialect", f"SELECT event_id, event_id % {len(DIALECT)} < {sum(ok for _, ok in DIALECT)} AS fine FROM events")
def regexp_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translator's own verdict on a sample behind each event's type."""
    sample = F.element_at(F.array(*(F.lit(source) for source, _ in DIALECT)), (F.col("event_id") % len(DIALECT) + 1).cast("int"))
    between = F.when(sample.rlike("^[*+]"), F.lit("")).otherwise(F.col("event_type"))  # nothing to repeat is at the start
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(between, sample).alias("source"))
    return verdicts(rows, "event_id", "source", "fine", iregexp.translate)


#: pairs that fold together, one for each kind of letter: Latin, Greek, Cyrillic, Armenian, Georgian, Cherokee, Deseret
FOLDED = (("Ü", "ü"), ("Σ", "σ"), ("Ж", "ж"), ("Ա", "ա"), ("Ა", "ა"), ("Ꭰ", "ꭰ"), ("𐐀", "𐐨"))


@add("ignore_case_unicode", "SELECT event_id, 'p' || (event_id % 7) AS pattern_id FROM events")
def ignore_case_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    if any(partner(a) != b or partner(b) != a for a, b in FOLDED):
        raise AssertionError("partners go both ways")
    small = F.element_at(F.array(*(F.lit(f"x{b}k") for _, b in FOLDED)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", small.alias("t"))
    return PatternSet.of({f"p{n}": {"t": [{"equals-ignore-case": f"X{a}K"}]} for n, (a, _) in enumerate(FOLDED)}).match_long(rows, EVENT)


__all__ = ["DIALECT", "FOLDED", "ORACLES", "TEXTS"]
