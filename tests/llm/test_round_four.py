"""Operators 11 to 13 against brute force, and the cases that earlier operators left open."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evmatch.llm import collocations, decontamination, kdtree, mixing, periodicity, quality

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 11, periodic runs


def brute_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randint(0, rng.choice([0, 1, 2, 6])) for _ in range(rng.randint(0, 60))]
    if w and rng.random() < 0.6:
        w += (w[: rng.randint(1, 6)] * 20)[: rng.randint(0, 70)]
    return w


@pytest.mark.parametrize("least, exponent", [(6, 4), (5, 3), (12, 5), (2, 3)])
def test_runs_against_brute_force(least, exponent):
    rng = random.Random(11)
    for _ in range(400):
        docs = [random_words(rng) for _ in range(rng.randint(1, 4))]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.array([x for d in docs for x in d], dtype=np.int64)
        expected = [(s + int(bounds[k]), n, q) for k, d in enumerate(docs) for s, n, q in brute_runs(d, least, exponent)]
        assert periodicity.runs_of(words, bounds, least, exponent) == expected


def test_long_texts_of_one_word_and_of_two():
    n = 200_000
    assert periodicity.runs_of(np.zeros(n, dtype=np.int64), np.array([0, n])) == [(0, n, 1)]
    assert periodicity.runs_of(np.arange(n) % 777, np.array([0, n])) == [(0, n, 777)]


def test_periodic_runs_of_rows(spark, documents, rows, nothing):
    """Every row its own, with nulls, empty and very long texts, repeats, and clashing columns."""
    extra = [(None, "a b " * 9, "x", None, 0, 1, 2, "y")] * 2 + [(7, " ".join("x y z".split() * 4), "x", None, 0, 1, 2, "y")]
    df = documents.unionByName(spark.createDataFrame(extra, documents.schema)).withColumn("runs", F.lit("mine"))
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodicity.periodic_runs(df).collect())
    expected = []
    for i, t, *_ in [*rows, *extra]:
        w = (t or "").encode().split()
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        expected.append((str(i), len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(expected)
    assert any(runs for *_, runs, _ in got) and periodicity.periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError, match="three periods"):
        periodicity.periodic_runs(df, exponent=2)


def test_planted_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", periodicity.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    hit = 0
    for r in docs.collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, w = h // 10, r["text"].encode().split()
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            hit += 1
        assert got[r["doc_id"]].encode().split() == w
    assert hit > 5


# ---------------------------------------------------------------- 12, collocations


def brute_collocations(rows, least, longest, cover, top):
    found, sizes = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            sizes[lang] = sizes.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    p = (lang, tuple(w[i : i + k]))
                    found[p] = found.get(p, 0) + 1
    often = {p: n for p, n in found.items() if len(p[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in often.items():
        inside = lambda long: any(long[i : i + len(p)] == p for i in range(len(long) - len(p) + 1))  # noqa: B023, E731
        if any(g == lang and len(long) > len(p) and 100 * n >= cover * a and inside(long) for (g, long), n in often.items()):
            continue
        cuts = [(2_000_000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, n + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, ps in out.items() for n, (s, a, p, left, right) in enumerate(sorted(ps)[:top]))


def test_collocations_against_brute_force(spark, monkeypatch, documents, nothing):
    monkeypatch.setattr(collocations, "SHARD", 300)  # many shards
    rng = random.Random(12)
    words = ["The", "rain", "é", "in", "x y", "\x00", "stone.", "und,", "a;b", "ÀB"]
    rows = [(rng.choice(["en", None, "und", "fr"]), rng.choice([" ", "  ", "\t", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", "the rain in " * 400), ("fr", "\n.\v")] + [("en", "one two three four five")] * 40
    df = spark.createDataFrame([(k, lang, t, k) for k, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, rank int").repartition(3)
    for least, longest, cover, top in ((30, 4, 80, 2000), (5, 3, 50, 7)):
        got = collocations.collocations(df, least=least, longest=longest, cover=cover, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, longest, cover, top)
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(documents.limit(3)).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts of which SCALE times one is beyond 64 bits."""
    huge = 9 * 10**17
    found = spark.createDataFrame([("en", "a", 1, huge + 7), ("en", "b", 1, huge + 5), ("en", "a b", 2, huge), ("en", "c", 1, huge), ("en", "b c", 2, huge - 1), ("en", "a b c", 3, huge // 5 * 4 + 1)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *_: (found, spark.createDataFrame([("en", 5)], "lang string, n long")))
    got = {r["phrase"]: r["score"] for r in collocations.collocations(found).collect()}
    f = {r["phrase"]: r["f"] for r in found.collect()}
    assert got == {"a b c": min(2_000_000 * f["a b c"] // (f["a"] + f["b c"]), 2_000_000 * f["a b c"] // (f["a b"] + f["c"]))}  # it covers 80 hundredths of both


# ---------------------------------------------------------------- 13, decontamination


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, width):
    out = []
    for i, t in docs:
        w, hit, ids = terms(t), set(), set()
        for item, text in items:
            x = terms(text)
            n = min(width, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == x[s : s + n]:
                        hit |= set(range(k, k + n))
                        ids.add("" if item is None else str(item))
        out.append((str(i), len(w), len(hit), sorted(ids)))
    return sorted(out)


def test_contamination_against_brute_force(spark, nothing):
    rng = random.Random(13)
    words = ["The", "of", "rain", "É", "İx", "K9", "Ⅷ", "a-b", "st", "ς"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(0, 14))) for k in range(12)] + [(None, text(6)), (3, "of of of of of of"), (40, None), (41, "rain"), (42, "one two three four five six seven")]
    docs = [(k, " ".join([text(rng.randint(0, 30)), rng.choice(items)[1] or "", text(rng.randint(0, 9))])) for k in range(60)]
    docs += [(None, None), (5, ""), (5, "of " * 50), (None, "one two three four five six seven"), (None, "one two three four five six seven")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id int, text string, pos int, term string, doc int").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, item int")
    for width in (10, 4):
        got = decontamination.contamination(df, bench, width=width).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == brute_contamination(docs, items, width)
    none = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert decontamination.contamination(nothing, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(df, none).collect()} == {0}


def test_near_matches(spark):
    """Words up to two places off are near, others are not."""
    docs = [(0, "a b c d e f g"), (1, "a x b c d e f"), (2, "a x y b z z z c d e f"), (3, "b a c d e f"), (4, "q q")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    index = decontamination.build(df)
    number = {r["doc"]: r["doc_id"] for r in index.documents.collect()}
    items = spark.createDataFrame([("i", "a b c d e f")], "item_id string, text string")
    found = lambda slop: {number[r["doc"]] for r in decontamination.near(index, items, slop, width=6).collect()}
    assert found(0) == {number[r["doc"]] for r in decontamination.phrases(index, items, width=6).collect()} == {0}
    assert found(1) == {0, 1} and found(2) == {0, 1, 3}


def test_lower_case_is_ascii_alone(spark):
    """Of every character."""
    df = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    odd = df.filter(decontamination.lowered(F.col("c")) != F.when(F.col("id").between(65, 90), F.lower("c")).otherwise(F.col("c")))
    assert odd.count() == 0


def test_what_separates_terms_is_named_one_by_one(spark):
    """No range, which the matcher asks for each character of a text; of every character the terms are those of the contract."""
    assert "-" not in decontamination.TERM
    df = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    contract = F.regexp_extract_all(F.translate("c", decontamination.CAPITALS, decontamination.SMALL), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    assert df.filter(decontamination.terms(F.col("c")) != contract).count() == 0


def test_postings_of_a_term_stand_together(spark):
    """In each segment, and no column is stored that tells the term once more."""
    df = spark.createDataFrame([(k, "b a b c %d a" % (k % 3)) for k in range(40)], "doc_id int, text string").coalesce(1)
    postings = decontamination.build(df).postings
    assert postings.columns == ["term", "doc", "pos"]
    said = [r["term"] for r in postings.collect()]
    assert len(said) == 240 and 1 + sum(a != b for a, b in zip(said, said[1:])) == len(set(said)) == 6


def test_the_decontamination_plan_has_no_python(spark):
    found = decontamination.op13_decontamination(spark, SF)
    assert "Python" not in found._jdf.queryExecution().toString() and "InArrow" not in found._jdf.queryExecution().toString()


# ---------------------------------------------------------------- earlier operators


def test_vectors_too_long_for_64_bits_take_no_part(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0]), (100, [1e20, 1.0]), (200, [1.0, 2.0]), (300, [3.0, 1.0]), (400, [3e9, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in kdtree.top_k(df, F.lit(True), scale=1).collect()]
    assert sorted(got) == [(200, 1, 300, 5), (300, 1, 200, 5)]


def test_all_passages_of_a_labelled_row_teach(spark):
    """Labels that only a few passages far inside long texts tell."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        w = [rng.choice(["rain", "stone", "light", "river"]) for _ in range(64 * 300)]
        if k % 2:
            w[64 * 201 + 5 : 64 * 204] = [rng.choice(["$$##@@", "!!??!!"]) for _ in range(64 * 3 - 5)]
        rows.append((k, " ".join(w), k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df, df)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in quality.score(df, model).collect()}
    assert sum(got[k] == bool(k % 2) for k in got) >= 57
    assert quality.fit(df, df, most=100) is None  # no row has so few passages


def test_mixing_orders_rows_of_one_id_by_what_is_kept(spark):
    rows = [(1, f"{k} {k}", "s", k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mine int")
    size = F.lit(2).cast("long")
    first, again = (sorted(tuple(r) for r in mixing.mix(df.repartition(n), size, keep=("mine",)).select("mine", "taken").collect()) for n in (1, 7))
    assert first == again and sum(n for _, n in first) > 0
