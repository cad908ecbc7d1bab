"""Each stage of the pipeline on what the one before kept, against brute force."""

from collections import Counter

import pytest
from test_text_operators import WORD, brute_windows, filled, vocabulary

import corpus_pipeline
from evmatch.llm import quality
from evmatch.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] == list(corpus_pipeline.COLUMNS)


def test_quality_stage(spark, stages):
    docs, kept = stages[:2]
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= 0.5}
    assert set(texts(kept)) == good and texts(kept).items() <= texts(docs).items()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert sum((i in good) == (q == 1) for i, q in labels.items() if i in texts(docs)) >= 0.98 * len(labels)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_near_duplicate_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert after.items() <= before.items()
    assert len(set(after.values())) == len(after) == len({t for t in after.values()})
    sets = {i: shingles(t) for i, t in before.items()}
    for i in before.keys() - after.keys():
        assert any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in before)
    assert {min(i for i, t in before.items() if t == text) for text in set(before.values())} >= after.keys()


def test_windows_stage(stages):
    before, after = stages[2].collect(), texts(stages[3])
    expected = brute_windows([(r["doc_id"], r["text"]) for r in before])
    for i, ((size, gone, _, _),) in expected.items():
        if size and gone == size:
            assert i not in after
        else:
            assert size - gone - 6 * (1 + gone) <= len(after[i].encode()) <= size - gone
            assert gone or after[i].encode() == dict((r["doc_id"], r["text"]) for r in before)[i].encode()


def test_mixing_stage(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    for source, target in filled(sizes).items():
        assert abs(taken[source] - target) <= max(size.values())
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    many = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    pieces = stages[5].collect()
    full = Counter()
    for r in pieces:
        full[r["sequence_id"]] += r["length"]
    assert sum(full.values()) == many and max(full.values()) <= 2048 and len(full) <= many / 2048 * 1.05 + 1


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
