"""Stores of patterns: the same matches as sets on the driver, changes by batches, and what is rejected."""

import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.operators.flatten import ExactFlattener
from evmatch.operators.store import PatternStore, cells

KINDS = [
    "a", "ab", 1, 2.5, True, None, {"exists": True}, {"exists": False}, {"prefix": "a"}, {"prefix": ""}, {"suffix": "b"}, {"wildcard": "*"}, {"wildcard": "a*b"},
    {"shellstyle": "*a*"}, {"anything-but": "a"}, {"anything-but": ["ab", "b"]}, {"anything-but": [1, 2]}, {"equals-ignore-case": "AB"}, {"equals-ignore-case": "k"},
    {"numeric": [">", 1]}, {"numeric": [">=", 1, "<", 3]}, {"numeric": ["=", 2.5]}, {"numeric": ["<=", 1e300]}, {"numeric": [">", 3, "<", 1]}, {"cidr": "10.0.0.0/24"},
    {"cidr": "2001:db8::/33"}, {"regexp": "[ab]+"}, {"regexp": "a(b|c)*"},
]
VALUES = ["a", "ab", "b", "acb", "AB", "k", "K", "", "10.0.0.7", "2001:db8::1", "1", 1, 2, 2.5, 3, 1e9, -0.0, True, None]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-store-")


def patterns_table(spark, patterns):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in patterns], "pattern_id string, pattern_json string")


def random_pattern(rng):
    fields = {name: [rng.choice(KINDS) for _ in range(rng.choice([1, 1, 2, 3]))] for name in rng.sample(["x", "y"], rng.randint(0, 2))}
    if rng.random() < 0.6:
        fields["in"] = {name: [rng.choice(KINDS)] for name in rng.sample(["u", "v", "w"], rng.randint(1, 3))}
    return fields or {"x": [rng.choice(KINDS)]}


def random_event(rng):
    some = lambda names: {n: rng.choice(VALUES) if rng.random() < 0.8 else [rng.choice(VALUES), rng.choice(VALUES)] for n in names if rng.random() < 0.7}
    return some(["x", "y"]) | {"in": [some(["u", "v", "w"]) for _ in range(rng.randint(0, 3))]}


def test_random_patterns_match_as_in_a_set(spark, folder):
    rng = random.Random(11)
    patterns = [(f"p{k % 200}", random_pattern(rng)) for k in range(240)]
    events = [(k, json.dumps(random_event(rng))) for k in range(100)]
    df = spark.createDataFrame(events, "id int, event string")
    alone = PatternSet()
    for i, p in patterns:
        alone.add_pattern(i, p)
    expected = sorted((k, i) for k, e in events for i in alone.matches_for_event(e))
    store = PatternStore.create(spark, f"{folder}/s")
    store.add_patterns(patterns_table(spark, patterns[:150]))
    store.add_patterns(patterns_table(spark, patterns[150:]))
    got = sorted((r["id"], r["pattern_id"]) for r in store.match_long(df, ["id"], ExactFlattener("event")).collect())
    assert len(expected) > 1000
    assert got == expected


def test_batches_add_and_delete(spark, folder):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0), (2, "b", 6.0)], "id int, s string, n double")
    found = lambda store: sorted((r["id"], r["pattern_id"]) for r in store.match_long(df, ["id"]).collect())
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "pattern_id string")
    store = PatternStore.create(spark, f"{folder}/s")
    assert found(store) == [] and store.match_long(df, ["id"]).columns == ["id", "pattern_id"] and store.pattern_count() == 0
    first = store.add_patterns(patterns_table(spark, [("x", {"s": ["a"]}), ("x", {"n": [5]}), ("y", {"n": [{"numeric": [">", 5]}]}), ("none", {})]))
    assert found(store) == [(1, "x"), (2, "y"), (2, "y")]
    store.delete_patterns(ids("x", "unknown", None))
    assert found(store) == [(2, "y"), (2, "y")] and store.pattern_count() == 1
    store.add_patterns(patterns_table(spark, [("x", {"s": ["b"]})]))
    assert found(store) == [(2, "x"), (2, "x"), (2, "y"), (2, "y")]
    assert found(PatternStore(spark, f"{folder}/s", until=first)) == [(1, "x"), (2, "y"), (2, "y")]
    small = store.compact(f"{folder}/t")
    assert found(small) == found(store) and small.live().count() == 2
    store.add_patterns(patterns_table(spark, []))
    assert found(store) == found(small)
    assert store.match_long(df.limit(0), ["id"]).count() == 0


def test_a_batch_that_failed_is_not_there_and_is_written_anew(spark, folder):
    df = spark.createDataFrame([("a",)], "s string")
    store = PatternStore.create(spark, f"{folder}/s")
    whole, store._commit = store._commit, lambda seq, kind: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.add_patterns(patterns_table(spark, [("lost", {"s": ["a"]})]))
    store._commit = whole
    assert store.match_long(df, ["s"]).count() == 0
    store.add_patterns(patterns_table(spark, [("kept", {"s": ["a"]})]))
    assert [tuple(r) for r in store.match_long(df, ["s"]).collect()] == [("a", "kept")]


def test_what_is_no_pattern_is_rejected_with_its_reason(spark, folder):
    store = PatternStore.create(spark, f"{folder}/s")
    bad = [("b1", "{"), ("b2", "[]"), ("b3", '{"a": 1}'), ("b4", '{"a": [[1]]}'), ("b5", '{"a": [{"regexp": "(a"}]}'), ("b6", None), (None, '{"a": [1]}'), ("good", '{"a": [1]}')]
    store.add_patterns(spark.createDataFrame(bad, "pattern_id string, pattern_json string"))
    rows = store.rejected().collect()
    assert sorted(str(r["pattern_id"]) for r in rows) == ["None", "b1", "b2", "b3", "b4", "b5", "b6"]
    assert all(r["error"] for r in rows) and store.pattern_count() == 1


def test_cells_cover_ranges_and_nothing_much_besides():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = (rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 290) for _ in range(2))
        lo, hi = sorted((a, b if rng.random() < 0.5 else a * (1 + rng.random() * 2.0 ** -rng.randint(0, 52))))
        if lo < hi:
            at = cells(lo, hi)
            assert 1 <= len(at) <= 3
            for x in (lo, hi, lo + (hi - lo) * rng.random()):
                assert any(math.floor(x / 2.0**k) == n for k, n in at)
            k = at[0][0]
            assert 2.0**k <= 4 * (hi - lo)
    assert cells(-1.7e308, 1.7e308) is None


def test_a_value_of_most_events_is_not_one_tasks(spark, folder):
    """Nine events in ten say one value; its term is broadcast, so no exchange moves its events by it."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("s"))
    store = PatternStore.create(spark, f"{folder}/s")
    table = spark.range(0, 5000, 10).select(F.concat(F.lit("p"), "id").alias("pattern_id"), F.concat(F.lit('{"s": ["'), "id", F.lit('"]}')).alias("pattern_json"))
    store.add_patterns(table.unionByName(patterns_table(spark, [("hot", {"s": ["hot"]})])))
    got = {r["pattern_id"]: r["count"] for r in store.match_long(df, ["id"]).groupBy("pattern_id").count().collect()}
    assert got.pop("hot") == 36_000 and len(got) == 500 and set(got.values()) == {1}


def test_texts_of_many_ids_are_kept_once(spark, folder):
    """And compiled, looked up and decided once; an id of two texts is there once, whichever an event meets."""
    df = spark.createDataFrame([(k, k % 7, "ab"[k % 2]) for k in range(40)], "id int, n int, s string")
    texts = [{"n": [{"numeric": [">=", 3]}], "s": ["a"]}, {"n": [1, 2]}, {"s": [{"prefix": "b"}]}]
    patterns = [(f"p{k}", texts[j]) for k in range(300) for j in {k % 3, k // 3 % 3}]
    store = PatternStore.create(spark, f"{folder}/s")
    store.add_patterns(patterns_table(spark, patterns))
    assert spark.read.parquet(f"{folder}/s/patterns").count() == 3
    alone = PatternSet()
    for i, p in patterns:
        alone.add_pattern(i, p)
    wanted = lambda ids: sorted((r["id"], i) for r in df.collect() for i in alone.matches_for_event(json.dumps({"n": r["n"], "s": r["s"]})) if i in ids)
    found = lambda: sorted((r["id"], r["pattern_id"]) for r in store.match_long(df, ["id"]).collect())
    assert found() == wanted({i for i, _ in patterns}) and store.pattern_count() == 300
    store.delete_patterns(spark.createDataFrame([(f"p{k}",) for k in range(150)], "pattern_id string"))
    store.add_patterns(patterns_table(spark, [x for x in patterns if x[0] in ("p1", "p2", "p3")]))  # the texts once more, in another batch
    assert found() == wanted({f"p{k}" for k in [1, 2, 3, *range(150, 300)]})


def test_few_texts_are_dealt_over_all_cores(spark, folder):
    from evmatch.operators.store import compiled

    texts = spark.createDataFrame([(str(k), json.dumps({"n": [k]})) for k in range(100)], "_what string, _json string").coalesce(1)
    assert compiled(texts, False).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_plain_fields_of_one_key_move_once(spark, folder):
    """Rows whose values say one key each meet a pattern once: none is numbered, kept or made distinct, however many ids
    a text has; other sets are matched as they were, with the same result."""
    events = [(k % 30, k % 11, None if k % 5 == 0 else float(k % 9), None if k % 7 == 0 else "ab-c"[k % 4]) for k in range(60)]
    df = spark.createDataFrame([*events, (1, None, math.nan, "a"), (1, None, math.nan, "a")], "id int, n int, d double, s string")
    others = [{"d": [{"numeric": [">", 4]}]}, {"s": [{"anything-but": ["a", "b"]}]}, {"s": ["a", {"prefix": "b"}], "d": [1, 2, {"exists": False}]}, {"s": [{"exists": False}]}, {"none": [{"exists": False}]}, {"s": [{"wildcard": "*b*"}, {"equals-ignore-case": "C"}]}, {}]
    alike = lambda n: {"n": [n % 11]} | others[n % len(others)]
    one, many = [(f"p{k}", alike(k)) for k in range(80)], [(f"q{k}", alike(k % 3)) for k in range(80)]
    two_ways = [("w", {"s": ["a", {"prefix": "a"}]}), *one]
    two_texts = [("p1", {"n": [3]}), *one]
    for k, (patterns, plain) in enumerate([(one, True), (many, True), (one[:7], True), (two_ways, False), (two_texts, False)]):
        alone = PatternSet()
        for i, p in patterns:
            alone.add_pattern(i, p)
        store = PatternStore.create(spark, f"{folder}/s{k}")
        store.add_patterns(patterns_table(spark, patterns))
        got = store.match_long(df, ["id"])
        expected = alone.match_long(df, ["id"])
        listed = lambda found: sorted((r["id"], r["pattern_id"]) for r in found.collect())
        assert listed(got) == listed(expected) and got.columns == expected.columns
        assert ("_event_no" in got._jdf.queryExecution().optimizedPlan().toString()) != plain


def test_rows_are_looked_for_in_a_table_too_large_for_a_broadcast(spark, folder, monkeypatch):
    from evmatch.operators import store as module

    monkeypatch.setattr(module, "COMMON_TERMS", 10)
    df = spark.range(3000).select((F.col("id") % 700).alias("id"), (F.col("id") % 50).alias("n"), (F.col("id") % 13).cast("double").alias("d"))
    table = spark.range(50).select(F.concat(F.lit("p"), "id").alias("pattern_id"), F.concat(F.lit('{"n": ['), "id", F.lit('], "d": [{"numeric": ["<", '), F.col("id") % 5, F.lit("]}]}")).alias("pattern_json"))
    store = PatternStore.create(spark, f"{folder}/s")
    store.add_patterns(table)
    got = sorted((r["id"], r["pattern_id"]) for r in store.match_long(df, ["id"]).collect())
    assert got == sorted((k % 700, f"p{k % 50}") for k in range(3000) if k % 13 < k % 50 % 5)


def test_what_others_share_is_counted_only_where_there_is_a_choice(spark, folder):
    """Beside a range, that most values may be in, an equality is the only choice."""
    store = PatternStore.create(spark, f"{folder}/s")
    rows = lambda texts: spark.createDataFrame([(t,) for t in texts], "_json string").select(F.md5("_json").alias("_what"), "_json")
    from evmatch.operators.store import compiled

    sure = [json.dumps({"a": [k % 3], "b": [{"numeric": [">", k]}]}) for k in range(20)]
    led = store._led(compiled(rows(sure), False))
    assert "Join" not in led._jdf.queryExecution().optimizedPlan().toString() and led.filter("_lead is not null").count() == 20
    choice = [json.dumps({"a": [1], "c": [k]}) for k in range(4)]
    led = {r["_json"]: r for r in store._led(compiled(rows(sure + choice), False)).collect()}
    assert len(led) == 24 and len({led[t]["_lead"] for t in choice}) == 4 and len({led[t]["_lead"] for t in sure}) == 3


def test_a_key_is_common_by_its_share_of_all_events(spark):
    """A few events of one key among many of others are no reason to join apart."""
    from evmatch.plans.join import joined_apart

    said = spark.range(20_000).select(F.lit("p").alias("_path"), F.when(F.col("id") < 6, F.lit("k")).otherwise(F.col("id").cast("string")).alias("_said"))
    terms = spark.createDataFrame([("p", "k", 1), ("p", "77", 2)], "_path string, _said string, c int")
    got = joined_apart(said, terms, "inner", said)
    assert got.count() == 7 and "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
