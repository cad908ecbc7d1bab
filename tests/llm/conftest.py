import random

import pytest

WORDS = "the of and rain stone light river under above green door walk never seven clock paper".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard int, fp string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, empty and null texts, null sources, and a long text."""
    rng = random.Random(3)
    shared = prose(rng, 14)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0]] * 5 + [f"{texts[1]} {shared}", f"{shared} {texts[2]}", f"{prose(rng, 9)}\n{shared}", texts[3] + " x", "é" * 70, "è" + "é" * 70, "", None, "  \n ", prose(rng, 4000), "A" * 300, "a" * 300]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 4}", 0, 1, 2, "x") for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def documents(spark, rows):
    """With extra columns whose names clash with those the operators use."""
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
