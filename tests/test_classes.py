"""The plan by classes of values: comparisons on typed columns and one array of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.operators.flatten import TypedFlattener
from evmatch.plans.classes import _Field, class_column
from evmatch.plans.inline import TooManyTerms
from evmatch.plans.pattern import parse

SCHEMA = "id int, s string, n double, items array<struct<t:string,q:double>>"
TEXTS, NUMBERS = [f"t{k}" for k in range(9)], [-7, -1.5, 0, 1, 2, 2.5, 7, 8, 1e300]
OF_TEXT = (lambda r: r.choice(TEXTS), lambda r: {"anything-but": r.sample(TEXTS, r.randint(1, 3))}, lambda r: {"exists": True}, lambda r: {"anything-but": [1]}, lambda r: {"numeric": [">", 0]})
OF_NUMBER = (
    lambda r: r.choice(NUMBERS), lambda r: {"anything-but": r.sample(NUMBERS, 2)}, lambda r: {"exists": True}, lambda r: {"numeric": [r.choice([">", ">=", "<", "<=", "="]), r.choice(NUMBERS)]},
    lambda r: {"numeric": [">", r.choice(NUMBERS), "<=", r.choice(NUMBERS)]}, lambda r: {"numeric": []},
)
OUTSIDE = {"s": (lambda r: r.choice("ab"), lambda r: {"anything-but": "a"}, lambda r: 7, lambda r: {"exists": False}), "n": (lambda r: {"numeric": [">", 0]}, lambda r: {"anything-but": 2}, lambda r: {"exists": False})}


def random_pattern(rng):
    some = lambda kinds: [rng.choice(kinds)(rng) for _ in range(rng.choice([1, 1, 2]))]
    found = {name: some(kinds) for name, kinds in OUTSIDE.items() if rng.random() < 0.4}
    inside = {name: some(kinds) for name, kinds in (("t", OF_TEXT), ("q", OF_NUMBER)) if rng.random() < 0.6}
    return found | ({"items": inside} if inside else {}) or {"s": ["a"]}


def random_row(rng, k):
    text, number = lambda: rng.choice([*TEXTS, "a", "b", "other", "7", None]), lambda: rng.choice([*map(float, NUMBERS), -0.0, 3.25, float("nan"), float("inf"), None])
    element = lambda: rng.choice([None, (text(), number())])
    return k, text(), number(), rng.choice([None, [element() for _ in range(rng.randint(0, 5))]])


@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_tables(spark, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame([random_row(rng, k) for k in range(150)], SCHEMA)
    patterns = PatternSet()
    for k in range(120):
        patterns.add_pattern(f"p{k % 100}", random_pattern(rng))
    live = patterns._live()
    class_column(df, TypedFlattener(), [e.pattern for e in live], [e.id for e in live], True)  # is for this plan
    got = sorted(map(tuple, patterns.match_long(df, ["id"], plan="row").collect()))
    assert got == sorted(map(tuple, patterns.match_long(df, ["id"], plan="join").collect())) and len(got) > 1000
    assert got == sorted((r["id"], i) for r in patterns.match(df).collect() for i in r["matches"])


def test_ids_are_made_once(spark):
    """A filter by their size would make them again."""
    df = spark.createDataFrame([(1, "a", 1.0, [("t1", 2.0)])], SCHEMA)
    patterns = PatternSet.of({f"p{k}": {"s": ["a"], "items": {"q": [k], "t": [{"anything-but": "t2"}]}} for k in range(60)})
    found = patterns.match_long(df, ["id"])
    assert [tuple(r) for r in found.collect()] == [(1, "p2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "Join" not in plan


def test_other_sets_are_for_other_plans(spark):
    df = spark.createDataFrame([(1, "a", 1.0, [("t1", 2.0)])], SCHEMA).withColumn("others", F.col("items"))
    for pattern in ({"s": [{"prefix": "a"}]}, {"n": ["1"]}, {"items": {"t": [{"exists": False}, "x"]}}, {"items": {"t": ["t1"]}, "others": {"t": ["t1"]}}, {"unknown": ["x"]}):
        one = PatternSet.of({"p": pattern})
        with pytest.raises(TooManyTerms):
            class_column(df, TypedFlattener(), [one._live()[0].pattern], ["p"], False)
        assert one.match_long(df, ["id"], plan="row").collect() == one.match_long(df, ["id"], plan="join").collect()


def test_classes_of_many_values_are_found_in_time_of_their_number():
    """Not of conditions times values: 5,000 ranges, exclusions and lists each took minutes."""
    many, began = 5000, time.process_time()
    fields = [[({"numeric": [">", 10 * n, "<=", 10 * n + 15]},) for n in range(many)], [(f"t{n}", f"t{n + 1}") for n in range(many)], [({"anything-but": list(range(many))},), tuple(range(0, many, 2))]]
    made = []
    for numeric, conditions in zip((True, False, True), fields, strict=True):
        parsed = [parse({"x": list(ms)}).fields[0][1] for ms in conditions]
        made.append((parsed, _Field(parsed, numeric)))
    assert time.process_time() - began < 10
    (ranges, by_range), (_, by_text), (lists, by_list) = made
    value = lambda f, x: f.classes[2 * f.at[x] + 2]
    assert value(by_range, 70) in by_range.found[ranges[6]] and value(by_range, 70) not in by_range.found[ranges[7]]
    assert by_range.size == 2 + 2 * many - 1  # of no value, of no range, each range alone or with the next
    assert by_text.size == 2 + many + 1
    assert [value(by_list, x) in by_list.found[lists[1]] for x in (0, 1)] == [True, False] and by_list.size == 4
    with pytest.raises(TooManyTerms):
        _Field([parse({"x": [{"numeric": [">", n]}]}).fields[0][1] for n in range(many)], True)
