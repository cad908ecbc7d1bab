"""Deep arrays, clashing names, null and repeated keys, and the same matches from every plan."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.errors import InvalidPattern
from evmatch.functions import casefold
from evmatch.operators import local
from evmatch.operators.flatten import ExactFlattener, VariantFlattener
from evmatch.plans.pattern import parse


@pytest.mark.parametrize("many", [50, 51, 60])
def test_the_number_of_patterns_changes_nothing(spark, many):
    """Null keys, repeated keys, repeated rows and clashing names, with and without arrays."""
    rows = [(None, 6, [6]), (None, 7, [1, 6]), (3, 6, []), (3, 9, None), (3, 9, None), (4, None, [7])]
    df = spark.createDataFrame(rows, "key int, path int, pattern array<int>").withColumn("matches", F.lit("old"))
    flat = PatternSet.of({f"p{n}": {"path": [n]} for n in range(many)})
    got = sorted((str(r["key"]), str(r["path"]), r["matches"]) for r in flat.match(df).collect())
    assert got == sorted((str(k), str(v), [] if v is None else [f"p{v}"]) for k, v, _ in rows)
    nested = PatternSet.of({f"p{n}": {"pattern": [n], "path": [{"exists": True}]} for n in range(many)})
    got = sorted((str(r["key"]), str(r["path"]), r["matches"]) for r in nested.match(df).collect())
    assert got == sorted((str(k), str(v), sorted(f"p{x}" for x in set(a or ())) if v is not None else []) for k, v, a in rows)
    assert flat.match(df).columns == ["key", "path", "pattern", "matches"]
    for patterns, many_hit in ((flat, 5), (nested, 2)):
        assert patterns.matching(df).count() == many_hit
        assert sorted(r["n"] for r in patterns.count_column(df, "n").collect()) == sorted(r["size(matches)"] for r in patterns.match(df).select(F.size("matches")).collect())


@pytest.mark.parametrize("plan", ["columns", "lookup", "join"])
def test_key_columns_may_have_any_name(spark, plan):
    names = ["path", "condition", "pattern", "trail", "key", "_key", "_said_0", "a.b"]
    df = spark.createDataFrame([(*range(8), "x"), (*range(8), "y")], ", ".join(f"`{n}` int" for n in names) + ", v string")
    patterns = PatternSet.of({"x": {"v": ["x"]}, "both": {"v": [{"prefix": "x"}, {"suffix": "x"}], "key": [4]}})
    got = patterns.match_long(df, names, plan=plan).collect()
    assert sorted(tuple(r) for r in got) == [(*range(8), "both"), (*range(8), "x")]


def random_pattern(rng):
    fields = {}
    for _ in range(rng.randint(1, 3)):
        value = rng.choice([rng.choice("abc"), {"prefix": rng.choice(["a", ""])}, {"suffix": "b"}, {"anything-but": "a"}, {"exists": True}, {"wildcard": "*a*"}])
        number = rng.choice([rng.randint(0, 3), {"numeric": [">", 1]}, {"anything-but": [2]}, {"exists": False}, "2"])
        name = rng.choice("stnm")
        fields[name] = [value] if name in "st" else [number]
        if rng.random() < 0.3:
            fields[name].append(rng.choice(["c", 1]))
    return fields


def test_plans_agree_on_random_patterns(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "ab", "b", "", None]), rng.choice(["c", "ca", None]), rng.choice([0, 1, 2, None]), rng.choice([1.0, 2.0, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, s string, t string, n int, m double")
    patterns = {f"p{k}": random_pattern(rng) for k in range(80)}
    by_event = {}
    for k, s, t, n, m in rows:
        event = json.dumps({x: y for x, y in {"s": s, "t": t, "n": n, "m": m}.items() if y is not None})
        by_event[k] = sorted(PatternSet.of(patterns).matches_for_event(event))
    found = PatternSet.of(patterns)
    for plan in ("columns", "lookup", "join"):
        got = {k: [] for k, *_ in rows}
        for r in found.match_long(df, ["id"], plan=plan).collect():
            got[r["id"]].append(r["pattern_id"])
        assert {k: sorted(v) for k, v in got.items()} == by_event, plan
    keyed = {f"q{k}": {**p, "s": [rng.choice("ab")]} for k, p in enumerate(patterns.values())}
    assert found._looked_up(df, PatternSet.of(keyed)._live(), "x") is not None
    long = PatternSet.of(keyed).match_long(df, ["id"]).collect()
    assert sorted(tuple(r) for r in long) == sorted(tuple(r) for r in PatternSet.of(keyed).match_long(df, ["id"], plan="join").collect())


def test_elements_of_one_array_against_trails(spark):
    rng = random.Random(4)
    events = [{"a": {"b": [{"x": rng.randint(0, 2), "y": {"z": rng.choice("pq")}} for _ in range(rng.randint(0, 3))], "c": [rng.choice("rs") for _ in range(2)]}, "d": rng.randint(0, 1)} for _ in range(80)]
    df = spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(events)], "id int, e string")
    typed = df.select("id", F.from_json("e", "a struct<b:array<struct<x:int,y:struct<z:string>>>,c:array<string>>, d int").alias("j")).select("id", "j.*")
    patterns = {"one": {"a": {"b": {"x": [1], "y": {"z": ["p"]}}}}, "two": {"a": {"b": {"x": [1, 2], "y": {"z": [{"anything-but": "p"}]}}, "c": ["r"]}, "d": [0]}, "gone": {"a": {"b": {"x": [{"exists": False}]}, "c": ["s"]}}}
    got = {r["id"]: r["matches"] for r in PatternSet.of(patterns).match(typed).collect()}
    assert got == {k: sorted(PatternSet.of(patterns).matches_for_event(json.dumps(e))) for k, e in enumerate(events)}


def test_arrays_of_any_depth(spark):
    events = ['{"a":[[[["x"]]]]}', '{"a":[1,[2,[3,[4,[5,["x",[{"b":["y"]}]]]]]]]}', '{"a":{"b":[[[[["y"]]]]]}}', '{"a":"x"}', '{"a":[]}', '{"b":"x"}', '{"a":{"b":"y"}}', '{"a":[{"b":"y","c":"x"},{"b":"n","c":"z"}]}', "{", '{"a":null}']
    patterns = {"x": {"a": ["x"]}, "y": {"a": {"b": ["y"]}}, "both": {"a": {"b": ["y"], "c": ["z"]}}, "same": {"a": {"b": ["y"], "c": ["x"]}}, "none": {"a": [{"exists": False}]}, "null": {"a": [None]}}
    df = spark.createDataFrame([(k, e) for k, e in enumerate(events)], "id int, event string")
    expected = {k: sorted(PatternSet.of(patterns).matches_for_event(e)) for k, e in enumerate(events) if e != "{"}
    for flattener in (VariantFlattener(), VariantFlattener(unrolled=0), ExactFlattener()):
        got = {r["id"]: (r["matches"], r["_event_error"]) for r in PatternSet.of(patterns, flattener=flattener).match(df).collect()}
        assert {k: got[k][0] for k in expected} == expected and got[8][1] and not got[0][1]


def test_a_clone_is_a_snapshot():
    first = PatternSet.of({"a": {"x": ["1"]}})
    second = first.clone()
    first.add_pattern("b", {"x": ["1"]})
    second.add_pattern("c", {"x": ["1"]})
    third = second.clone()
    second.delete_patterns("a")
    third.clear()
    assert (first.pattern_ids(), second.pattern_ids(), third.pattern_ids()) == (["a", "b"], ["c"], [])
    assert first.matches_for_event('{"x":"1"}') == ["a", "b"] and second.matches_for_event('{"x":"1"}') == ["c"]


def test_statistics_of_a_table(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 4).alias("v"))
    patterns = PatternSet.of({"a": {"v": [0, 1]}, "b": {"v": [2]}})
    patterns.delete_patterns("b")
    seen = Observation()
    assert patterns.match(df, observe=seen).filter("size(matches) > 0").count() == 1000
    assert patterns.pruner_stats().emitted == 0
    assert patterns.absorb(seen) == 1 and patterns.pattern_ids() == ["a"] and patterns.pruner_stats().filtered == 0


def test_case_partners():
    for a, b in (("A", "a"), ("Ꭰ", "ꭰ"), ("ᏸ", "Ᏸ"), ("ა", "Ა"), ("σ", "Σ"), ("μ", "µ"), ("ꙋ", "ᲈ"), ("\U00010c80", "\U00010cc0"), ("ƛ", "Ƛ"), ("\U00010d70", "\U00010d50")):
        assert casefold.partner(a) == b
    for c in "1 ßİﬅ":
        assert casefold.partner(c) is None
    assert casefold.partner("ſ") == "s" and casefold.partner("s") == "S" and casefold.partner("ꭰ") == "Ꭰ"


@pytest.mark.parametrize("bad", ['{"a":[1e999]}', '{"a":[' + "9" * 400 + "]}", '{"a":[{"numeric":["<",1e999]}]}', '{"a":[{"anything-but":[' + "9" * 400 + "]}]}"])
def test_numbers_beyond_doubles(bad):
    with pytest.raises(InvalidPattern):
        parse(bad)


def test_ten_thousand_strings_and_numbers():
    """Each of many random values matches its own pattern and no other."""
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(10_000)})
    numbers = list({rng.randint(-(2**52), 2**52) for _ in range(10_000)})
    for values in (words, numbers):
        patterns = [parse({"a": [v]}) for v in values]
        for k in range(0, len(values), 37):
            found = local.leaves(json.dumps({"a": values[k]}), [("a",)])
            assert local.matches(patterns[k], found) and not any(local.matches(patterns[m], found) for m in (k - 1, (k * 7 + 1) % len(values)) if m != k)


def test_a_stream_of_many_patterns_is_joined(spark, tmp_path):
    from evmatch.streaming.match import match_stream

    rows = spark.range(200).select("id", (F.col("id") % 90).cast("int").alias("n"), F.lit(None).cast("string").alias("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = match_stream(stream, PatternSet.of({f"p{k}": {"n": [k], "s": [{"exists": False}]} for k in range(60)}), ["id"])
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, f"p{i % 90}") for i in range(200) if i % 90 < 60)
