"""Rows that match anything: the filter at the scan and semi joins against matching in full."""

import random

from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.plans import semi


def rows_of(spark, path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé\U0010ffff") for _ in range(rng.randint(0, 4)))
    rows = [(k, rng.choice([None, word()]), rng.choice([None, rng.randint(-50, 500)]), rng.choice([None, rng.random() * 100, float(rng.randint(0, 99))]), (word(),)) for k in range(600)]
    spark.createDataFrame(rows, "id int, s string, n long, d double, t struct<s:string>").write.parquet(path)
    return spark.read.parquet(path), word, rng


def test_rows_of_random_sets(spark, tmp_path):
    df, word, rng = rows_of(spark, str(tmp_path / "rows"))
    kinds = {
        "s": lambda: word(), "s*": lambda: {"prefix": word() + rng.choice("ab")}, "*s": lambda: {"suffix": word() + rng.choice("ab")}, "n": lambda: rng.randint(-20, 300), "n.": lambda: rng.choice([1.5, -3, 7]), "x": lambda: {"exists": True},
    }
    for some in (["s"], ["n"], ["n", "n."], ["s", "s*"], ["s", "*s", "n"], ["s*"], ["s", "x"]):
        for fields in (1, 2):
            patterns = {}
            for k in range(70):
                p = {}
                for _ in range(fields):
                    kind = rng.choice(some)
                    path = rng.choice(["n", "d", "s"] if kind[0] == "n" else ["s"] if kind != "s" else ["s", "t"])
                    p[path] = {"s": [kinds[kind]()]} if path == "t" else [kinds[kind](), kinds[kind]()]
                patterns[f"p{k}"] = p
            found = PatternSet.of(patterns)
            expected = sorted(r["id"] for r in found.match(df).filter("size(matches) > 0").collect())
            got = found.matching(df)
            assert sorted(r["id"] for r in got.collect()) == expected, (some, fields)
            assert got.columns == df.columns


def test_the_filter_reaches_the_scan(spark, tmp_path):
    df, *_ = rows_of(spark, str(tmp_path / "rows"))
    for patterns, pushed in (({f"p{k}": {"n": [k]} for k in range(1000)}, "GreaterThanOrEqual(n,0)"), ({f"p{k}": {"t": {"s": [f"a{k}"]}} for k in range(1000)}, "GreaterThanOrEqual(t.s,a0)"), ({f"p{k}": {"s": [f"a{k}"]} for k in range(60)}, "In(s, [a0")):
        plan = PatternSet.of(patterns).matching(df)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan and "LeftSemi" in plan and "size(" not in plan, plan


def test_the_least_text_behind_a_beginning():
    assert [semi._after(x) for x in ("a", "a\ud7ff", "a\U0010ffff", "\U0010ffff", "")] == ["b", "a\ue000", "b", None, None]


def test_names_of_values_clash_with_none(spark):
    df = spark.createDataFrame([("a", "mine"), ("b", "mine")], "x string, _value0 string")
    got = PatternSet.of({f"p{k}": {"x": [chr(97 + k)]} for k in range(0, 60, 2)} | {f"q{k}": {"x": [{"prefix": "zz"}]} for k in range(60)}).matching(df)
    assert [tuple(r) for r in got.select(F.col("x"), "_value0").collect()] == [("a", "mine")]
