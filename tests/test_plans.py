"""DataFrames: every plan and flattener against single-event matching, and the queries against SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evmatch import ExactFlattener, PatternSet, TypedFlattener, ValueMatcher, VariantFlattener
from evmatch.operators.flatten import LEAVES
from evmatch.sources import events as sources
from evmatch.streaming.match import match_stream, match_with_current
from test_patterns import HARBOUR_PATTERNS, HARBOUR

MATCHERS = [
    "a", "foo", 1, 35, True, None, {"exists": True}, {"exists": False}, {"prefix": "f"}, {"suffix": "o"}, {"wildcard": "*o*"}, {"wildcard": "f*o"}, {"shellstyle": "*"},
    {"anything-but": ["a", "foo"]}, {"anything-but": 35}, {"equals-ignore-case": "FOO"}, {"equals-ignore-case": "Ka"}, {"numeric": [">", 1]}, {"numeric": [">=", 1, "<", 35]},
    {"cidr": "10.0.0.0/8"}, {"cidr": "2001:db8::/32"}, {"regexp": "[a-f]~w*"}, {"regexp": "f(?!oo)"}, {"regexp": "~p{L}+"},
]
VALUES = ["a", "foo", "FOO", "ka", "", 1, 35, 2.5, True, None, "10.1.2.3", "2001:db8:0:0:0:0:0:1", "f o", "é"]


def random_value(rng, depth=2):
    kind = rng.random()
    if depth and kind < 0.25:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if depth and kind < 0.5:
        return {k: random_value(rng, depth - 1) for k in rng.sample(["p", "q", "r"], rng.randint(0, 3))}
    return rng.choice(VALUES)


def random_pattern(rng):
    out = {}
    for key in rng.sample(["x", "y", "z"], rng.randint(1, 2)):
        leaf = lambda: [rng.choice(MATCHERS) for _ in range(rng.randint(1, 2))]
        out[key] = leaf() if rng.random() < 0.5 else {k: leaf() for k in rng.sample(["p", "q", "r"], rng.randint(1, 2))}
    return out


@pytest.fixture(scope="module")
def world():
    rng = random.Random(7)
    events = [json.dumps({k: random_value(rng) for k in rng.sample(["x", "y", "z"], rng.randint(0, 3))}, ensure_ascii=False) for _ in range(150)]
    patterns = {f"p{n}": random_pattern(rng) for n in range(45)} | {"harbour yes": HARBOUR_PATTERNS["yes"]}
    events += [json.dumps(HARBOUR), '{"x":1,}', "", "[1]"]
    expected = {}
    local = PatternSet.of(patterns)
    for n, e in enumerate(events):
        try:
            expected[n] = sorted(local.matches_for_event(e))
        except ValueError:
            expected[n] = []
    return events, patterns, expected


@pytest.mark.parametrize("flattener", [ExactFlattener, VariantFlattener])
@pytest.mark.parametrize("plan", ["columns", "join"])
def test_json_plans_agree_with_single_events(spark, world, flattener, plan):
    events, patterns, expected = world
    df = spark.createDataFrame(list(enumerate(events)), "id int, event string")
    got = {n: [] for n in expected}
    names = list(patterns)
    for lo in range(0, len(names), 23):
        some = PatternSet.of({i: patterns[i] for i in names[lo : lo + 23]}, flattener=flattener())
        for r in some.match_long(df, ["id"], plan=plan).collect():
            got[r["id"]].append(r["pattern_id"])
    assert {n: sorted(x) for n, x in got.items()} == {n: expected[n] if n < len(events) - 3 else [] for n in expected}


def test_typed_plans_agree_with_json(spark):
    rows = [(n, {"k": n % 3, "s": f"v{n % 4}"}, [{"a": n % 2, "b": None if n % 5 == 0 else "x"}, {"a": 2, "b": "y"}], {"m": n * 1.5}, n % 2 == 0) for n in range(40)]
    df = spark.createDataFrame(rows, "id int, o struct<k:int,s:string>, items array<struct<a:int,b:string>>, tags map<string,double>, even boolean")
    patterns = {
        "a": {"o": {"k": [1], "s": [{"suffix": "2"}]}}, "b": {"items": {"a": [1], "b": ["x"]}}, "c": {"items": {"a": [1], "b": ["y"]}}, "d": {"tags": {"m": [{"numeric": [">", 30]}]}},
        "e": {"even": [True], "items": {"b": [{"anything-but": "y"}]}}, "f": {"tags": {"none": [{"exists": False}]}, "id": [{"numeric": ["<", 3]}]}, "g": {"items": {"c": [{"exists": True}]}},
        "h": {"items": {"b": [{"exists": False}]}},
    }
    typed = PatternSet.of(patterns)
    events = {r["id"]: r["event"] for r in sources.as_event(df).select("id", "event").collect()}
    expected = {i: sorted(typed.matches_for_event(e)) for i, e in events.items()}
    assert {r["id"]: r["matches"] for r in typed.match(df).collect()} == expected
    for plan in ("columns", "join"):
        got = {i: [] for i in expected}
        for r in typed.match_long(df, ["id"], plan=plan).collect():
            got[r["id"]].append(r["pattern_id"])
        assert {i: sorted(x) for i, x in got.items()} == expected
    assert {r["id"] for r in typed.matching(df).collect()} == {i for i, x in expected.items() if x}
    assert {r["id"]: r["n_matches"] for r in typed.count_column(df).collect()} == {i: len(x) for i, x in expected.items()}
    nulls = PatternSet.of({"n": {"items": {"b": [None]}}}, flattener=TypedFlattener(nulls=True))
    assert {r["id"] for r in nulls.match_long(df, ["id"]).collect()} == {i for i in range(40) if i % 5 == 0}


def test_rows_of_one_key_stay_apart_in_the_join(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "a", "y")], "id int, s string, t string")
    patterns = PatternSet.of({"p": {"s": ["a"], "t": ["y"]}, "q": {"s": ["a"]}})
    for plan in ("columns", "join"):
        assert sorted(r["pattern_id"] for r in patterns.match_long(df, ["id"], plan=plan).collect()) == ["p", "q", "q"]


def test_many_patterns_match_into_an_array(spark):
    patterns = PatternSet.of({f"k{n}": {"v": [n]} for n in range(300)})
    df = spark.range(400).withColumn("v", F.col("id"))
    got = {r["id"]: r["matches"] for r in patterns.match(df).collect()}
    assert got == {n: [f"k{n}"] if n < 300 else [] for n in range(400)}


def test_plain_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumns({"s": F.lit("x"), "d": F.rand(1), "unused": F.lit(1)}).write.parquet(str(tmp_path / "t"))
    patterns = PatternSet.of({"p": {"d": [{"numeric": [">", 5]}], "s": ["x"]}})
    for df in (patterns.matching(spark.read.parquet(str(tmp_path / "t"))).select("id"), patterns.match_long(spark.read.parquet(str(tmp_path / "t")), ["id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(s,x)" in plan and "GreaterThan(d,5.0)" in plan and "unused" not in plan


def test_empty_sets_and_tables(spark):
    empty = spark.createDataFrame([], "id int, s string")
    assert PatternSet.of({"p": {"s": ["x"]}}).match(empty).count() == 0
    some = spark.createDataFrame([(1, None)], "id int, s string")
    assert PatternSet().match(some).first()["matches"] == [] and PatternSet().match_long(some, ["id"]).count() == 0
    assert PatternSet().matching(some).count() == 0
    assert PatternSet.of({"p": {"no such": ["x"]}}).match(some).first()["matches"] == []


def test_own_flattener(spark):
    def pairs(df, paths):
        found = {p: F.expr(f"transform(filter(kv, x -> x.k = '{'.'.join(p)}'), x -> cast(named_struct('v', x.v, 'd', cast(null as double), 'trail', array()) as {LEAVES[6:-1]}))") for p in paths}
        return df, found

    df = spark.createDataFrame([(1, [("a", "x"), ("b.c", "y")]), (2, [("a", "z")])], "id int, kv array<struct<k:string,v:string>>")
    patterns = PatternSet.builder().with_flattener(pairs).build().add_pattern("p", {"a": ["x"], "b": {"c": ["y"]}})
    assert [r["id"] for r in patterns.match_long(df, ["id"]).collect()] == [1]


def test_pattern_tables(spark):
    patterns = PatternSet.of({"a": {"s": ["x"]}, "b": '{"s":["y"]}'})
    patterns.delete_patterns("b")
    again = PatternSet.from_table(patterns.to_table(spark))
    assert again.pattern_ids() == ["a"] and again.matches_for_event('{"s":"x"}') == ["a"]


def test_sources_and_streams(spark, tmp_path):
    import gzip

    lines = ['{"id":1,"s":"x"}', "", '{"id":2,"s":"y"}', "{bad"]
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.json.gz", "wt") as f:
        f.write("\n".join(lines))
    batch = sources.json_lines(spark, str(tmp_path / "in"))
    patterns = PatternSet.of({"x": {"s": ["x"]}, "any": {"id": [{"exists": True}]}}, flattener=ExactFlattener())
    found = patterns.match(batch)
    assert sorted((r["matches"], r["_event_error"] is None) for r in found.collect()) == [([], False), (["any"], True), (["any", "x"], True)]
    sources.write_matches(patterns.match_long(batch, ["event"]), str(tmp_path / "out"))
    expected = sorted(r["pattern_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert expected == ["any", "any", "x"]
    stream = match_stream(sources.json_lines(spark, str(tmp_path / "in"), streaming=True), patterns, ["event"])
    query = stream.writeStream.format("memory").queryName("matched").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["pattern_id"] for r in spark.sql("select * from matched").collect()) == expected
    stream = sources.json_lines(spark, str(tmp_path / "in"), streaming=True)
    match_with_current(stream, lambda: patterns, ["event"], str(tmp_path / "batches"), str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(r["pattern_id"] for r in spark.read.parquet(str(tmp_path / "batches")).collect()) == expected


def test_value_columns(spark):
    values = ValueMatcher().add_string("s", "foo").add_prefix("p", "fo")
    df = spark.createDataFrame([("foo",), ("fox",), (None,)], "v string")
    assert [r[0] for r in df.select(values.column(F.col("v"))).collect()] == [["s", "p"], ["p"], []]


def test_an_event_is_not_parsed_again_for_a_filter(spark):
    """A filter on fields of an event would be said anew in terms of its text, and parse it for each field named."""
    rows = spark.createDataFrame([(1, '{"a":"x","n":4}'), (2, '{"a":"x","n":9}'), (3, "{")], "id int, event string")
    for patterns in ({"p": {"a": ["x"], "n": [{"numeric": ["<", 5]}]}}, {"p": {"a": ["x"], "n": [{"numeric": ["<", 5]}]}, "q": {"n": [9]}}):
        got = PatternSet.of(patterns, flattener=VariantFlattener()).match_long(rows, ["id"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1, plan
        assert sorted(map(tuple, got.collect())) == [(1, "p"), *([(2, "q")] if "q" in patterns else [])]
