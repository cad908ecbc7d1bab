"""Operators on inputs that the given tables do not hold."""

import numpy as np
import pyarrow as pa

from evmatch.llm import components, html, quality, simhash

ARTICLE = " ".join(f"word{k}" for k in range(80))


def test_a_container_around_the_article_may_have_any_name():
    weights = html.Weights({})
    for page in (
        f"<body class='single has-sidebar comments-open'><p>{ARTICLE}</p></body>",
        f"<body><main class='content with-sidebar'><p>{ARTICLE}</p></main></body>",
        f"<body><article class='post social-share'><p>{ARTICLE}</p><div class='share'>tell others</div></article></body>",
        f"<body><div class='page-with-sidebar'><p>{ARTICLE}</p></div><div class='sidebar'>more of it</div></body>",
    ):
        assert html.main_text(page, weights) == ARTICLE


def test_labelled_pages_overrule_the_fixed_names():
    page = f"<body><div class='widget'><article><p>{ARTICLE}</p></article></div><div class='sidebar'>{ARTICLE}</div></body>"
    weights = html.Weights(html.labelled(page))
    short = "<body><div class='widget'><p>one two three four five six</p></div><div class='sidebar'>a b c d e f g h i j</div></body>"
    assert html.main_text(short, weights) == "one two three four five six"


def test_a_crowded_bucket_with_repeated_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fps = [int(f) for f in rng.integers(0, 1 << 62, 3) for _ in range(20)]
    monkeypatch.setattr(simhash, "BUCKET", 16)
    df = spark.createDataFrame([([f], n) for n, f in enumerate(fps)], "fps array<long>, node long")
    found = {r["a"]: r["b"] for r in components.components(simhash.links(df)).collect()}
    assert found == {n: n // 20 * 20 for n in range(60) if n % 20}


def test_passages_of_a_very_long_text_are_as_long_as_others(monkeypatch):
    part = ARTICLE + " "
    text = part * 512
    x = quality.encode(text)
    assert len(x) == 80 * 512 // 64 and np.allclose(x[:5], quality.encode(part * 4))
    model = quality.GatedAttention()
    bags = [text, part, None, part * 3, text]
    whole = [model.forward(b, np.array([0]))[0][0] for b in map(quality.encode, bags)]
    for many in (16_384, 7):
        monkeypatch.setattr(quality, "PASSAGES", many)
        assert np.allclose(model.scores(pa.array(bags)), whole)


def test_a_passage_is_encoded_as_if_nothing_followed():
    first = " ".join(ARTICLE.split()[: quality.WORDS]) + " "
    alone = quality.encode(first)
    for rest in ("a", "ab", "abc def", "é", ARTICLE):
        assert np.array_equal(quality.encode(first + rest)[:1], alone)
        assert np.allclose(quality.encode(first + rest)[1:], quality.encode(rest))


def test_a_raw_element_without_an_end_tag_takes_no_text_along():
    weights = html.Weights({})
    for icon in ("<svg width='9'/>", "<object data='x' />", "<canvas>"):
        assert html.main_text(f"<body><p>{ARTICLE} {icon} and the end</p></body>", weights) == f"{ARTICLE} and the end"
    assert html.main_text(f"<body><p>{ARTICLE}</p><script>never closed", weights) == ARTICLE
