"""Patterns over time against the set as it was at each event's own time."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from evmatch.operators.flatten import ExactFlattener
from evmatch.operators.history import FOREVER, PatternHistory, micros

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def random_history(rng, **options):
    made = PatternHistory(**options)
    for _ in range(90):
        i, at = f"p{rng.randint(0, 9)}", START + timedelta(minutes=rng.randint(0, 1000))
        act = rng.random()
        pattern = {"x": [rng.randint(0, 4)]} if rng.random() < 0.5 else {"a": {"y": [{"numeric": [">", rng.randint(0, 4)]}]}}
        if act < 0.6:
            made.add_pattern(i, json.dumps(pattern) if rng.random() < 0.5 else pattern, at)
        elif act < 0.8:
            made.replace_patterns(i, pattern, at)
        else:
            made.delete_patterns(i, at)
    return made


def test_each_event_meets_the_set_of_its_time(spark):
    rng = random.Random(7)
    events = [(k, json.dumps({"x": rng.randint(0, 4), "a": [{"y": rng.randint(0, 6)} for _ in range(rng.randint(0, 3))]}), rng.choice([None, *[START + timedelta(seconds=rng.randint(-100, 61_000))] * 9])) for k in range(200)]
    df = spark.createDataFrame([(k, e, None if t is None else micros(t)) for k, e, t in events], "id int, event string, at long").withColumn("ts", F.timestamp_micros("at"))
    for history in (random_history(rng, flattener=ExactFlattener()), PatternHistory(flattener=ExactFlattener())):
        expected = {k: sorted(history.at(t).matches_for_event(e)) if t else [] for k, e, t in events}
        for time in ("ts", "at"):
            got = history.match(df, time)
            assert got.columns == ["id", "event", "at", "ts", *(["_event_error"] if history.versions() else []), "matches"]
            assert {r["id"]: r["matches"] for r in got.collect()} == expected
        long = sorted(tuple(r) for r in history.match_long(df.select("id", "event", "ts"), ["id"], "ts").collect())
        assert long == sorted((k, i) for k, ids in expected.items() for i in ids)
        again = PatternHistory.from_table(history.to_table(spark), flattener=ExactFlattener())
        assert sorted((v.id, v.since, v.until) for v in again.versions()) == sorted((v.id, v.since, v.until) for v in history.versions())


def test_ends_of_versions():
    history = PatternHistory().add_pattern("a", {"x": [1]}, 10).add_pattern("b", {"x": [1]}, 20)
    history.delete_patterns("a", 30)
    history.delete_patterns("a", 40)
    history.delete_patterns("b", 5)
    assert [(v.id, v.since, v.until) for v in history.versions()] == [("a", 10, 30)]
    assert [history.at(t).pattern_ids() for t in (9, 10, 29, 30)] == [[], ["a"], ["a"], []]
    assert history.add_pattern("a", {"x": [1]}, 50).versions()[-1].until == FOREVER
    assert micros(datetime(1970, 1, 1, 0, 0, 1)) == 1_000_000


def test_a_replayed_stream_gives_the_same(spark, tmp_path):
    """Patterns added meanwhile do not show in events of before."""
    history = PatternHistory().add_pattern("a", {"x": [1]}, 0)
    spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("x"), (F.col("id") * 10).alias("at")).write.parquet(str(tmp_path / "in"))

    def run(name):
        stream = spark.readStream.schema("id long, x int, at long").parquet(str(tmp_path / "in"))
        query = history.match_long(stream, ["id"], "at").writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())

    first = run("first")
    history.replace_patterns("a", {"x": [0]}, 5000)
    history.add_pattern("b", {"x": [0, 1]}, 2000)
    again = run("again")
    assert first == [(k, "a") for k in range(1, 100, 2)]
    assert [r for r in again if r[0] < 200] == [r for r in first if r[0] < 200]
    assert [r for r in again if r[0] * 10 < 2000] == [r for r in first if r[0] * 10 < 2000]


def test_versions_are_found_by_their_time(spark):
    """Time is a field of each version, so that no event meets the conditions of all versions; its bounds are exact."""
    edge = (1 << 53) + 1  # which no double is
    made = PatternHistory.of((f"p{n}", {"a": [{"exists": True}]}, edge + n, edge + n + 1) for n in range(60))
    df = spark.createDataFrame([(k, edge + k) for k in range(-1, 61)], "a long, t long")
    assert {tuple(r) for r in made.match_long(df, ["a"], "t").collect()} == {(n, f"p{n}") for n in range(60)}
    fields = {p for e in made._numbered(made.versions(), "_now")._live() for p in e.pattern.paths}
    assert fields == {("a",), ("_now",)}
