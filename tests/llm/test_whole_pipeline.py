"""Stages of the pipeline on inputs that the given tables do not hold, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
from evmatch.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_groups(texts):
    """{place: smallest place of its group} of those that are not the smallest."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: find(k) for k in range(len(texts)) if find(k) != k}


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}


def edited(rng, words, n):
    places = set(rng.sample(range(len(words)), n))
    return [f"e{rng.randint(0, 10**9)}" if k in places else w for k, w in enumerate(words)]


def test_every_pair_at_the_similarity_is_met(spark):
    """Pairs from 0.7 to 1, of texts from 1 to 400 words."""
    rng = random.Random(11)
    texts = []
    for k in range(150):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((1, 3, 5, 8, 40, 150, 400)))]
        texts += [" ".join(words), " ".join(edited(rng, words, min(len(words), k % 10 * len(words) // 250)) + ["end"] * (k % 3))]
    rng.shuffle(texts)
    assert found(spark, texts) == brute_groups(texts)


def test_texts_of_equal_fingerprints_are_not_equal(spark):
    """One repeated shingle decides all fingerprints."""
    rng = random.Random(12)
    texts = [" ".join(["-"] * 360 + [f"w{rng.randint(0, 10**6)}" for _ in range(250)]) for _ in range(4)]
    texts.append(texts[1])
    assert found(spark, texts) == {4: 1}


def test_mixing_tells_rows_of_one_id_apart(spark):
    rng = random.Random(14)
    ids = [None] * 20 + [7] * 20 + list(range(100, 160))
    rows = [(i, f"t{n} " + "x " * rng.randint(3, 30), "en", f"s{n % 3}", 0) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA)
    times = Counter(r["text"] for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert max(times.values()) <= 2
    size = {r[1]: len(r[1].split()) for r in rows}
    of = {r[1]: r[3] for r in rows}
    targets = {r["source"]: r["target"] for r in corpus_pipeline.mixing.mix(docs, corpus_pipeline.words("text"), keep=("source",)).collect()}
    got = Counter()
    for text, n in times.items():
        got[of[text]] += n * size[text]
    assert all(abs(got[s] - t) <= max(size.values()) for s, t in targets.items())
    assert any(times[r[1]] for r in rows if r[0] is None)


def test_a_drifting_group_of_near_copies(spark):
    """More copies of one text than are handled pair by pair, many of them below the similarity of each other."""
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, words, rng.choice((3, 4, 5, 6, 7)))) for _ in range(400)]
    assert found(spark, texts) == brute_groups(texts)


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    rng = random.Random(15)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(60)) for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (4, texts[2]), (4, texts[2]), (None, texts[0]), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert left == sorted([(1, texts[0]), (2, texts[1]), (4, texts[2]), (4, texts[2]), (None, texts[0]), (None, None), (5, None)], key=str)


def test_recall_in_bands_of_similarity(spark):
    """Pairs of every band are found, against all pairs."""
    rng = random.Random(16)
    texts = []
    for k in range(200):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        texts += [" ".join(words), " ".join(edited(rng, words, k % 5))]
    sets = [shingles(t) for t in texts]
    group = found(spark, texts)
    bands = Counter()
    for k in range(0, len(texts), 2):
        a, b = sets[k], sets[k + 1]
        j = len(a & b) / len(a | b)
        if j >= 0.8:
            band = min(19, int(j * 20 + 1e-9))
            bands[band, group.get(k + 1, k + 1) == group.get(k, k)] += 1
    assert all(hit for _, hit in bands) and len(bands) >= 3


def test_packing_carries_ids_and_copies(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 0)] * 3 + [(2, "x " * 5000, "en", "s", 0), (None, None, "en", "s", 0)], SCHEMA)
    got = corpus_pipeline.pack(spark, docs, "").collect()
    assert len({r["source_row"] for r in got}) == 5 and all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert len({(r["source_row"], r["piece"]) for r in got}) == len(got)
    by_row = Counter()
    for r in got:
        by_row[r["doc_id"], r["source_row"]] += r["length"]
    assert sorted(by_row.values())[:2] == [1, by_row[1, next(n for i, n in by_row if i == 1)]]


def test_narrow_tables_do_not_get_a_file_for_each_partition(spark):
    """Files cost processes on a local file system; the rows found stay the same."""
    from pathlib import Path

    from evmatch.llm.common import Scratch

    rng = random.Random(17)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(100)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1))]
    before, kept = len(Scratch.made), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, texts) == brute_groups(texts)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    wide = re.compile(r"/similar(-nodes|-first-sets|-rest-sets)?-[0-9a-f]{32}$")
    roots = [s.root.removeprefix("file:") for s in Scratch.made[before:]]
    many = [len(list(t.glob("part-*"))) for r in roots if not wide.search(r) for t in Path(r).iterdir()]
    assert len(many) >= 7 and max(many) <= spark.sparkContext.defaultParallelism


def test_near_duplicates_leave_no_wide_tables(spark):
    """What the next stage finds on disk is a few numbers a document, not its shingles and signatures."""
    from pathlib import Path

    from evmatch.llm.common import Scratch

    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(30)]
    before = len(Scratch.made)
    assert found(spark, texts + texts[:3]) == {30: 0, 31: 1, 32: 2}
    left = [t for s in Scratch.made[before:] if Path(s.root.removeprefix("file:")).exists() for t in Path(s.root.removeprefix("file:")).iterdir()]
    assert left and not {"signature", "bands", "prefix", "shingles"} & {c for t in left for c in spark.read.parquet(str(t)).columns}


def test_scratch_is_released(spark, tmp_path):
    import os

    from evmatch.llm.common import Scratch, materialize, release

    before = len(Scratch.made)
    materialize(spark.range(5), "released").count()
    root = Scratch.made[-1].root.removeprefix("file:")
    assert os.path.isdir(root)
    release(before)
    assert not os.path.exists(root) and len(Scratch.made) == before
