"""Many patterns of every kind: the plans inside the row and by tables against events matched one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.functions import casefold, wildcard
from evmatch.functions.predicates import ignore_case_regex
from evmatch.operators import registry
from evmatch.operators.flatten import ExactFlattener, VariantFlattener
from evmatch.plans import inline, join
from evmatch.plans.terms import fits, same_letters

MATCHERS = (
    lambda r: r.choice(["a", "ab", "b", "é", "10.0.0.1"]), lambda r: r.randint(0, 3), lambda r: {"prefix": r.choice(["a", "", "ab"])}, lambda r: {"suffix": r.choice(["b", ""])},
    lambda r: {"anything-but": r.choice(["a", ["a", "b"]])}, lambda r: {"anything-but": [r.randint(0, 3), 2.5]}, lambda r: {"exists": True}, lambda r: {"exists": False},
    lambda r: {"wildcard": r.choice(["*a*", "a*b", "*", "a*b*a", "*ab*ba*", "ab", "*é*", "abc*c", "*b", "ab*ab"])}, lambda r: {"equals-ignore-case": r.choice(["AB", "k", "K", "K", "ς", "Straße", "É"])},
    lambda r: {"numeric": r.choice([[">", 1], ["<=", 2], ["=", 2], [">=", 0, "<", 3], [">", 2, "<", 1], []])}, lambda r: {"cidr": r.choice(["10.0.0.0/8", "10.0.0.0/31", "0.0.0.0/0", "2001:db8::/33", "2001:db8::1/128"])},
    lambda r: {"regexp": r.choice(["a+b?", "(a|b)*"])},
)
VALUES = ["a", "ab", "b", "", "abba", "aab", "abcc", "ababa", "é", "K", "k", "K", "σ", "ς", "Σ", "STRAßE", "10.0.0.1", "10.0.0.2", "11.0.0.1", "010.0.0.1", "2001:db8:0:0:0:0:0:1", "2001:db8:8000:0:0:0:0:1", 0, 1, 2, 2.5, 3, -0.0, None, True]


def random_pattern(rng):
    found = {}
    for _ in range(rng.randint(1, 3)):
        name, matchers = rng.choice("xyz"), [rng.choice(MATCHERS)(rng) for _ in range(rng.choice([1, 1, 2, 3]))]
        if name == "z":
            found.setdefault("m", {})[rng.choice("pq")] = matchers
        else:
            found[name] = matchers
    return found


def random_event(rng):
    found = {n: rng.choice(VALUES) for n in "xy" if rng.random() < 0.8}
    if rng.random() < 0.7:
        found["m"] = [{k: rng.choice(VALUES) for k in "pq" if rng.random() < 0.8} for _ in range(rng.choice([0, 1, 2, 3, 70]))]
    return found


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    patterns = {f"p{k}": random_pattern(rng) for k in range(150)}
    events = [random_event(rng) for _ in range(150)]
    expected = sorted((k, i) for k, e in enumerate(events) for i in PatternSet.of(patterns).matches_for_event(json.dumps(e)))
    return patterns, spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(events)], "id int, event string").cache(), expected


@pytest.mark.parametrize("plan", ["row", "join"])
def test_every_kind_in_arrays_of_json(world, plan):
    patterns, df, expected = world
    found = PatternSet.of(patterns, flattener=ExactFlattener()).match_long(df, ["id"], plan=plan)
    assert sorted(tuple(r) for r in found.collect()) == expected
    if plan == "row":
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_array_of_matches_in_either_plan(world, monkeypatch):
    patterns, df, expected = world
    by_event = {}
    for k, i in expected:
        by_event.setdefault(k, []).append(i)
    for limit in (inline.INLINE_ENTRIES, 0):
        monkeypatch.setattr(inline, "INLINE_ENTRIES", limit)
        got = PatternSet.of(patterns, flattener=ExactFlattener()).match(df)
        assert {r["id"]: r["matches"] for r in got.collect()} == {k: sorted(by_event.get(k, [])) for k in range(150)}
        assert got.columns == ["id", "event", "_event_error", "matches"]


def test_wildcards_letter_by_letter(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    rows = [(text(rng.randint(0, 9)), [text(rng.randint(0, 3)) for _ in range(rng.randint(2, 5))]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v string, p array<string>")
    for r in df.select("v", "p", fits(F.col("v"), F.col("p")).alias("m")).collect():
        assert r["m"] == wildcard.matches(r["v"], tuple(r["p"])), r


def test_folded_keys_of_every_character(spark):
    """A pattern of one character finds each partner by its key, and no other character."""
    some = sorted(casefold._firsts())
    pairs = [(a, b) for a in some for b in {a, casefold.partner(a) or a, casefold.folded(a), *(c for c in some if casefold.folded(c) == casefold.folded(a))}]
    df = spark.createDataFrame([(a, b, ignore_case_regex(a)) for a, b in pairs], "p string, v string, x string")
    got = df.select("p", "v", casefold.folded_column(F.col("v")).alias("k"), same_letters(F.col("v"), F.col("x")).alias("m")).collect()
    for r in got:
        assert r["k"] == casefold.folded(r["v"]) == casefold.folded(r["p"])
        assert r["m"] == (r["v"] in (r["p"], casefold.partner(r["p"])))


@pytest.mark.parametrize("flattener", [VariantFlattener, ExactFlattener])
@pytest.mark.parametrize("many", [2, 120])
def test_columns_of_any_name(spark, flattener, many):
    names = ["_event_variant", "_event_error", "_leaves_0", "_Leaves_of0", "Matches", "_matched_ids", "_event_no"]
    df = spark.createDataFrame([(*(f"mine{k}" for k in range(len(names))), '{"x":1,"a":[{"y":2}]}'), (*(f"mine{k}" for k in range(len(names))), "{")], ", ".join(f"`{n}` string" for n in [*names, "event"]))
    patterns = PatternSet.of({f"p{k}": {"x": [k], "a": {"y": [2]}} for k in range(many)}, flattener=flattener())
    rows = patterns.match(df).collect()
    assert [r["matches"] for r in rows] == [["p1"], []]
    for r in rows:
        assert [r[n] for n in names if n != "Matches"] == [f"mine{k}" for k, n in enumerate(names) if n != "Matches"]
    assert "Matches" not in patterns.match(df).columns  # names that differ in case alone are one
    assert [r["_event_error_"] is None for r in rows] == [True, False]
    assert [tuple(r) for r in patterns.match_long(df, names).collect()] == [(*(f"mine{k}" for k in range(len(names))), "p1")]
    assert patterns.matching(df).columns == df.columns and patterns.matching(df).count() == 1


def test_not_a_number_is_none(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None)], "id int, x double")
    few = {"above": {"x": [{"numeric": [">", 0]}]}, "at": {"x": [{"numeric": [">=", 5]}]}, "below": {"x": [{"numeric": ["<", 9]}]}}
    for more in ({}, {f"p{k}": {"x": [{"numeric": [">", k, "<", k + 10]}]} for k in range(60)}):
        got = PatternSet.of(few | more).match_long(df, ["id"]).filter("pattern_id in ('above', 'at', 'below')")
        assert sorted(tuple(r) for r in got.collect()) == [(2, "above"), (2, "at"), (2, "below")]


def test_numbers_of_events_are_kept(spark):
    """Rows that come in another order when they are read again keep their matches."""
    calls = spark.sparkContext.accumulator(0)

    def shuffled(batches):
        import random as r

        calls.add(1)
        for b in batches:
            order = list(range(b.num_rows))
            r.shuffle(order)
            yield b.take(order)

    rows = [(k, [k % 7, k % 11], k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b int").repartition(3).mapInArrow(shuffled, "id int, a array<int>, b int")
    patterns = {f"p{x}_{y}": {"a": [x], "b": [y]} for x in range(11) for y in range(5)}
    found = PatternSet.of(patterns).match_long(df, ["id"], plan="join")
    first, again = (sorted(tuple(r) for r in found.collect()) for _ in range(2))
    assert first == again == sorted((k, f"p{x}_{b}") for k, a, b in rows for x in set(a))
    before = calls.value
    found.count()
    assert calls.value == before  # what was numbered is not made again


def test_a_stream_of_a_thousand_patterns_with_arrays(spark, tmp_path):
    from evmatch.streaming.match import match_stream

    rows = spark.range(200).select("id", F.array(F.struct((F.col("id") % 500).cast("int").alias("n"), F.lit("x").alias("s")), F.struct(F.lit(7).alias("n"), F.lit("y").alias("s"))).alias("a"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    patterns = PatternSet.of({f"p{k}": {"a": {"n": [k], "s": [{"anything-but": "y"}]}} for k in range(1000)})
    query = match_stream(stream, patterns, ["id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted((k, f"p{k}") for k in range(200))


def test_plans_go_by_values(spark):
    df = spark.range(1000).select(F.col("id"), F.col("id").alias("x"))
    one = PatternSet.of({"even": {"x": list(range(0, 100_000, 2))}, "not": {"x": [{"anything-but": list(range(0, 100_000, 3))}]}})
    assert one._many(one._live()) and not one._many(PatternSet.of({"a": {"x": [1, 2, 3]}})._live())
    got = one.match_long(df, ["id"]).groupBy("pattern_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"even": 500, "not": 666}
    assert registry.VALUES < 1000


def test_errors_tell_their_place(spark):
    texts = ['{"a":1,\n "b":}', '{"a":\n\n 01}', '{"a":"\\q"}', '{"a":[1,2\n}', '{"a":1} x', "[1]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, event string")
    got = {r["id"]: r["_event_error"] for r in PatternSet.of({"p": {"a": [1]}}, flattener=ExactFlattener()).match(df).collect()}
    for k, place in enumerate(["line 2 column 6", "line 3 column 3", "line 1 column 7", "line 2 column 1", "line 1 column 9"]):
        assert place in got[k], (texts[k], got[k])
    assert got[5] == "an event is an object"


@pytest.mark.parametrize("outer", [False, True])
def test_a_common_value_is_not_one_task(spark, monkeypatch, outer):
    """Nine in ten events say one value, and the terms are too many for a broadcast."""
    monkeypatch.setattr(join, "BROADCAST_TERMS", 10)
    monkeypatch.setattr(join, "LOOK", 0.2)
    monkeypatch.setattr(inline, "INLINE_ENTRIES", 0)
    df = spark.range(0, 20_000, 1, 4).select("id", F.array(F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id").cast("string")))).alias("a"))
    patterns = PatternSet.of({f"p{k}": {"a": [f"v{k}"]} for k in range(0, 20_000, 10)} | {"hot": {"a": ["hot"]}, "two": {"a": ["hot", "v10"]}})
    if outer:
        found = patterns.match(df)
        assert {r["id"]: r["matches"] for r in found.collect()} == {k: ["hot", "two"] if k % 10 else [f"p{k}", *(["two"] if k == 10 else [])] for k in range(20_000)}
    else:
        found = patterns.match_long(df, ["id"])
        got = found.groupBy("pattern_id").count().collect()
        assert {r[0]: r[1] for r in got} == {f"p{k}": 1 for k in range(0, 20_000, 10)} | {"hot": 18_000, "two": 18_001}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "BroadcastHashJoin" in plan


def test_rows_of_a_small_file_are_dealt_out(spark):
    """One task's rows go to all cores, and what is asked of them afterwards is not done before."""
    from evmatch.sources.events import spread

    rows = spread(spark.range(0, 2000, 1, 1).withColumn("_dealt", F.col("id")))
    assert rows.columns == ["id", "_dealt"] and rows.rdd.getNumPartitions() >= 16
    plan = rows.filter("hash(id) % 2 = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("hash") < plan.index("Repartition")


def test_adding_a_pattern_copies_no_others():
    """A set of 100,000 was copied 100,000 times; a clone still keeps its own."""
    patterns = PatternSet.of({"a": {"x": [1]}})
    held, clone = patterns._entries, patterns.clone()
    assert patterns.matches_for_event('{"x":1}') == ["a"]
    patterns.add_pattern("b", {"x": [1]})
    assert patterns._entries is held and patterns.matches_for_event('{"x":1}') == ["a", "b"]
    clone.add_pattern("c", {"x": [1]})
    assert clone.matches_for_event('{"x":1}') == ["a", "c"] and patterns.pattern_ids() == ["a", "b"]


def test_terms_of_common_keys_are_found_without_a_job(spark):
    """What the driver holds under some keys is what the table has under them."""
    patterns = PatternSet.of({f"p{k}": {"x": [k * 1e7, {"numeric": [">", k, "<=", k + 9]}], "y": [f"t{k % 3}", {"prefix": "t"}, {"wildcard": f"a*{k}"}, {"exists": False}]} for k in range(20)})
    paths = patterns._paths(patterns._live())
    tables = join.TermTables([e.pattern for e in patterns._live()], paths, [str(k) for k in range(20)])
    df = spark.range(1)
    rows = [(r["_path"], r["_said"], r["_condition"], r["_pieces"], r["_exact"]) for r in tables.table(df).collect()]
    keys = list(dict.fromkeys(r[:2] for r in rows))
    assert {k[0] for _, k in keys} >= {"n", "g", "s", "m", "w", "p"}
    for some in (keys, keys[::3]):
        got = [(r["_path"], r["_said"], r["_condition"], r["_pieces"], r["_exact"]) for r in tables.under(df, some, len(rows)).collect()]
        assert sorted(map(str, got)) == sorted(str(r) for r in rows if r[:2] in some)
    assert tables.under(df, [*keys, (0, "g1"), (1, "snone")], len(rows) - 1) is None
    assert tables.under(df, [(0, "g999999"), (1, "snone")], 5).collect() == []
