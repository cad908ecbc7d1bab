"""Regexps in linear time: on values of a million characters in a task, and against backtracking on short ones."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from evmatch import PatternSet
from evmatch.errors import InvalidPattern
from evmatch.functions import automaton, iregexp
from evmatch.operators import local

MILLION = 1_000_000


def random_source(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.45:
        return rng.choice(["a", "b", "c", "é", "~d", "[ab]", "[^a]", ".", "~p{L}", "~P{Lu}", "~."])
    inner = lambda: random_source(rng, depth + 1)
    if kind < 0.6:
        return inner() + inner()
    if kind < 0.75:
        return "(" + "|".join(rng.choice([inner(), inner() + inner(), ""]) for _ in range(rng.randint(2, 3))) + ")"
    return f"({inner()})" + rng.choice(["*", "+", "?", "{2}", "{1,3}", "{0,2}", "{2,}"])


def backtracked(source):
    """The source read for a backtracking matcher, as it stands."""
    text = source
    out, i = "", 0
    while i < len(text):
        if text[i] == "~":
            out += {"d": "[0-9]", ".": r"\.", "p": r"\p", "P": r"\P"}[text[i + 1]]
            i += 2
        else:
            out += "(?s:.)" if text[i] == "." else text[i]
            i += 1
    return regex.compile(f"(?V1)\\A(?:{out})\\Z")


def random_pairs(n, seed):
    rng = random.Random(seed)
    for _ in range(n // 10):
        source = random_source(rng)
        for _ in range(10):
            yield source, "".join(rng.choice("aabbcé1.A") for _ in range(rng.randint(0, 7)))


def test_random_pairs_against_backtracking():
    known, tables, possessive = {}, 0, 0
    for source, value in random_pairs(10_000, 1):
        if source not in known:
            (c,) = iregexp.translate(source)
            known[source] = (backtracked(source), c)
            tables += c.table is not None
            possessive += "*+" in c.pattern or "++" in c.pattern
        expected = known[source][0].search(value) is not None
        c = known[source][1]
        assert c.holds(value) == expected, (source, value)
        if c.table:
            assert c.table.holds(value) == expected, (source, value)
    assert tables > 50 and possessive > 10


def test_random_pairs_in_the_engine(spark):
    """The JVM's answers, of sources and of tables, for sources of every kind."""
    pairs = list(random_pairs(1500, 2))
    by_source = {}
    for source, value in pairs:
        by_source.setdefault(source, []).append(value)
    sources = list(by_source)
    df = spark.createDataFrame([(v,) for v in sorted({v for _, v in pairs})], "v string")
    for lo in range(0, len(sources), 50):
        some = sources[lo : lo + 50]
        conditions = [iregexp.translate(s)[0] for s in some]
        columns = [c.column(F.col("v")).alias(f"m{k}") for k, c in enumerate(conditions)]
        columns += [c.table.column(F.col("v")).alias(f"t{k}") for k, c in enumerate(conditions) if c.table]
        for r in df.select("v", *columns).collect():
            for k, s in enumerate(some):
                expected = backtracked(s).search(r["v"]) is not None
                assert r[f"m{k}"] == expected and r.asDict().get(f"t{k}", expected) == expected, (s, r["v"])


@pytest.mark.parametrize(
    "source, unit, end",
    [
        ("(a|b)*c", "ab", "c"), ("(~p{L}|~d)+", "é7", "x"), ("((ab)*|c)*", "abc", "c"), ("(ab|cd)*e", "abcd", "e"), ("(a|aa)*c", "a", "c"),
        ("((a*)*)*b", "a", "b"), ("(a(b|c)?d)+", "abdacd", "ad"), (".*a.*b.*c", "xab", "c"), ("(~w+~.)+com", "ab.", "com"), ("(a?b?)*c", "ab", "c"),
    ],
)
def test_a_million_characters_in_a_task(spark, source, unit, end):
    df = spark.range(2).select(F.concat(F.repeat(F.lit(unit), MILLION // len(unit)), F.when(F.col("id") == 0, F.lit(end)).otherwise(F.lit("#"))).alias("v"), "id")
    got = PatternSet.of({"m": {"v": [{"regexp": source}]}}).match(df.repartition(2)).select("id", "matches").collect()
    expected = {0: ["m"], 1: []}
    assert {r["id"]: r["matches"] for r in got} == expected
    assert local.matches(next(iter(PatternSet.of({"m": {"v": [{"regexp": source}]}})._live())).pattern, {("v",): [local.Leaf("ab" * 1000 + "#")]}) is False


def test_the_limit_on_states():
    with pytest.raises(InvalidPattern, match="states"):
        iregexp.translate("(.*a.{20})*")
    assert iregexp.translate(".*a.{20}")[0].table is None  # loops over characters alone need none


def test_classes_instead_of_alternatives():
    assert automaton.linear(automaton.Rep(automaton.Alt((iregexp.literal("a"), iregexp.literal("b"))), 0, None)) == ("[ab]*", None, True)
    assert iregexp.translate("(ab){2,5}")[0].pattern == "(?:ab){2,5}+"


def test_the_source_of_an_automaton(spark):
    """Loops over first returns say what the fold says, and no table is followed where there is such a source."""
    sources = ["(a|ab|b)*d?", "((ab)*|c)*", "(a|ab)*(b|bc)*", "(a*b*)*c", "((a|b)*abb)+", "(((ab)*c)*d)*"]
    tables = [automaton.Positions(automaton.simple(iregexp.joined(iregexp.Parser(s).branches())[0])).table() for s in sources]
    values = spark.range(4**6).select(F.translate(F.conv("id", 10, 4), "0123", "abcd").alias("v"))
    said = values.select(*(c for k, t in enumerate(tables) for c in (t.minimal().column(F.col("v")).alias(f"s{k}"), t.fold(F.col("v")).alias(f"t{k}"))))
    assert all(t.minimal().source() for t in tables)
    assert said.filter(" or ".join(f"s{k} <> t{k}" for k in range(len(sources)))).count() == 0
    assert "aggregate(" not in values.select(iregexp.translate(sources[0])[0].column(F.col("v")))._jdf.queryExecution().toString()
