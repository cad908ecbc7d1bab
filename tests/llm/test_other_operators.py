"""Media, HTML, classifiers and top-k: round trips, held-out accuracy and brute force."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evmatch.llm import html, kdtree, media, quality, toxicity


def test_media_round_trip(documents, rows, nothing):
    got = {r["doc_id"]: r for r in media.described(media.with_media(documents)).collect()}
    by_text = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert by_text.setdefault(text or "", (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.described(media.with_media(nothing)).count() == 0


def test_frames_decode_alike_both_ways():
    rng = np.random.default_rng(0)
    payload = rng.integers(0, 256, 192 * 40, dtype=np.uint8).tobytes() + bytes([0, 255] * 96) + bytes(192) + b"\xff" * 192
    avi = media.read_avi(media.store(payload))
    assert np.stack(media.decode_frames(avi.frames)).tobytes() == payload
    assert np.stack([media.decode_frame(f) for f in avi.frames]).tobytes() == payload
    assert (avi.width, avi.height, avi.frame_us) == (16, 12, 40_000)


def test_avi_without_index_and_broken_files(spark):
    file = media.store(bytes(range(192)) * 3)
    cut = file[: file.rindex(b"idx1")]
    assert len(media.read_avi(cut).frames) == 3
    df = spark.createDataFrame([(1, file), (2, b"RIFFxxxxWAVE"), (3, None), (4, file[:100])], "doc_id long, media binary")
    assert {r["doc_id"] for r in media.clips(df).collect()} == {1}


def baseline(samples, quality, with_tables=True):
    """A grey baseline JPEG, by the standard tables."""
    tables = media.standard_tables()
    codes = [{s: k for k, s in tables[w].items()} for w in (0x00, 0x10)]
    h, w = samples.shape
    quant, bits, before = np.full(64, quality), "", 0

    def put(table, symbol, value, size):
        n, code = codes[table][symbol]
        return f"{code:0{n}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            block = np.rint((media._DCT @ (samples[y : y + 8, x : x + 8] - 128.0) @ media._DCT.T).ravel()[media._ZIGZAG] / quant).astype(int)
            d, before, run = int(block[0]) - before, int(block[0]), 0
            bits += put(0, abs(d).bit_length(), d, abs(d).bit_length())
            for n in range(1, 64):
                v = int(block[n])
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + put(1, 0xF0, 0, 0), run - 16
                bits, run = bits + put(1, run << 4 | abs(v).bit_length(), v, abs(v).bit_length()), 0
            if run:
                bits += put(1, 0, 0, 0)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    sof = h.to_bytes(2, "big") + w.to_bytes(2, "big")
    head = media._segment(0xDB, bytes([0, *quant])) + media._segment(0xC0, b"\x08" + sof + bytes([1, 1, 0x11, 0]))
    if with_tables:
        for which in (0x00, 0x10):
            head += media._segment(0xC4, bytes([which, *media._COUNTS[which], *tables[which].values()]))
    return b"\xff\xd8" + head + media._segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("with_tables", [True, False])
def test_baseline_frames(with_tables):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:24, 0:40]
    for samples, most in ((rng.integers(0, 256, (24, 40)), 2), ((128 + 100 * np.sin(x / 5) * np.cos(y / 7)).astype(int), 2)):
        frames = [baseline(samples, 1, with_tables)] * 3
        found = media.decode_frames(media.read_avi(media.write_avi(frames, 40, 24)).frames)
        assert len(found) == 3 and np.abs(found[0].astype(int) - samples).max() <= most
    assert all(len(t) == (162 if w >> 4 else 12) and len(set(t.values())) == len(t) for w, t in media.standard_tables().items())


def test_shots():
    rng = np.random.default_rng(4)
    dark, light = rng.integers(0, 60, (10, 12, 16)), rng.integers(180, 250, (15, 12, 16))
    frames = np.concatenate([dark, light, dark]).astype(np.uint8)
    assert media.cuts(frames) == [0, 10, 25] and media.cuts(frames[:1]) == [0] and media.cuts(frames[:0]) == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><ul><li><a href=x>Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this site to do a lot of things for you</div>
<ARTICLE><h2>Real&nbsp;heading</h2><p>First para with <a href=1>a <b>li</b>nk</a> &amp; more &#233;.<p>Second<br>para   here
is long enough.<div class="ad">Buy this now and never regret it</div><ul><li>One<li>Two</ul><script>var a = "</p>";</script><form>Name <input></form><!-- no --><p>End.</ARTICLE>
<div class="sidebar"><p>Other stories about things and stuff that is long enough to win maybe</p></div>
<section id="comments"><p>Great post! I think so many things about that and so on and on.</p></section><footer>Copyright</footer></body></html>"""
TEXT = "Real heading\nFirst para with a link & more é.\nSecond para here is long enough.\nOne\nTwo\nEnd."


@pytest.mark.parametrize("page", [PAGE, PAGE.replace("ARTICLE", "div")])
def test_main_text(page):
    assert html.main_text(page, html.Weights({})) == TEXT
    assert html.main_text(page, html.Weights(html.labelled(PAGE))) == TEXT


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>a<b"), (5, "u", "plain text"), (6, "u", "<script>x"), (None, "u", PAGE), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages, html.fit(pages)).collect()]
    expected = [(i, t, len(t)) for i, t in [(1, TEXT), (2, ""), (3, ""), (4, "a"), (5, "plain text"), (6, ""), (None, TEXT), (1, TEXT)]]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert html.extract(pages.limit(0), html.fit(pages.limit(0))).count() == 0


def test_best_region():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        lo, hi = html.best_region(scores)
        assert sum(scores[lo:hi]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


def judged(df, labels, column):
    found = df.join(labels, "doc_id").select("score", column, "held").collect()
    assert all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held"]]
    assert held
    return sum((r["score"] >= 0.5) == (r[column] == 1) for r in held) / len(held)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = "the rain falls on stones and rivers under green doors while clocks walk by".split()
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            text = [f"{w.upper()}!!" if i % 2 else f"{w} |" for w in text]
        if toxic:
            word = rng.choice(["idiot", "moron", "scum"])
            for _ in range(3):
                text.insert(rng.randrange(len(text)), word if i % 8 else rng.choice([word.replace("i", "1").replace("o", "0"), " ".join(word), word.replace("o", "oooo").replace("u", "uuuu")]))
        rows.append((i, " ".join(text), int(not bad), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (None, "x"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(950, 1, 1), (None, 0, 0), (901, 7, None)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.withColumn("held", F.col("doc_id") % 5 == 0).cache()


def test_quality(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels.filter("not held"))
    assert judged(quality.score(docs, model), labels, "quality") >= 0.95
    assert quality.score(docs, model).count() == docs.count()
    again = quality.fit(docs.repartition(7), labels.filter("not held"))
    assert np.allclose(again.p["E"], model.p["E"])
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert set(quality.score(docs, model, keep=("text",)).columns) == {"doc_id", "text", "score"}


def test_attention_gradient():
    """Against finite differences, for every parameter."""
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, quality.DIMS)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    model = quality.GatedAttention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = model.forward(x, starts)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = model.gradient(y, *model.forward(x, starts))
    for name, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(8)]:
            kept, found = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = kept + step
                found.append(loss())
            v[at] = kept
            assert grad[name][at] == pytest.approx((found[0] - found[1]) / 2e-5, rel=1e-4, abs=1e-8), name
    model = quality.GatedAttention().fit(x.astype(np.float32), starts, y)
    assert ((model.forward(x, starts)[0] > 0.5) == y).all()


def test_words_and_trigrams_of_a_passage():
    """Each bucket of a passage against counting one by one."""
    text = "The rain, the RAIN\tand\n stones " * 30
    x = quality.encode(text)
    words = text.split()
    data = text.encode()
    starts = [k for k in range(len(data)) if not chr(data[k]).isspace() and (k == 0 or chr(data[k - 1]).isspace())]
    assert len(x) == -(-len(words) // 64)
    for n, row in enumerate(x):
        lo, hi = starts[64 * n], starts[64 * n + 64] if 64 * n + 64 < len(starts) else len(data)
        counts = np.zeros(quality.BUCKETS)
        for k in range(lo, hi):
            part = [c + 32 if 65 <= c <= 90 else c for c in data[k : min(k + 3, hi)]]
            h = sum(c * m for c, m in zip(part, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=False)) * 0x27D4EB2F & 0xFFFFFFFF
            counts[h >> 25] += 1
        assert np.allclose(row[-quality.BUCKETS :], np.sqrt(counts / (hi - lo)), atol=1e-6)
        kinds = row[-2 * quality.BUCKETS : -quality.BUCKETS] ** 2
        assert kinds.sum() == pytest.approx(1, abs=1e-5) and (kinds > 0).sum() <= len(set(words))


def test_repeated_rows_of_a_labelled_id_teach_once(spark, corpus):
    docs, labels = corpus
    many = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id < 50"))
    assert np.allclose(quality.fit(many, labels).p["c"], quality.fit(docs, labels).p["c"])
    once, twice = (toxicity.fit(d, labels) for d in (docs, docs.unionByName(docs)))
    assert once.weights.keys() == twice.weights.keys()


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.filter("not held"))
    assert judged(toxicity.score(docs, model), labels, "toxic") >= 0.9
    out = toxicity.score(docs, model, restored="said")
    assert out.count() == docs.count() and out.filter("said is null").count() == 0
    nothing = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_restoring():
    text = "the idiot and the moron are scum and the loser is stupid pathetic trash " * 30
    s = np.concatenate([[0, 0], toxicity.symbols(text), [0]])
    counts = np.bincount(s[:-2] * 784 + s[1:-1] * 28 + s[2:], minlength=28**3)
    restore = toxicity.Restorer(toxicity.log_probabilities(counts))
    for written, meant in [("1di0t", "idiot"), ("m o r o n", "moron"), ("s.c.u.m", "scum"), ("looooser", "loser"), ("tra$h", "trash"), ("5tup1d!", "stupid!"), ("m-0-r-0-n", "moron"), ("iidiioott", "idiot"), ("s  c   u  m", "scum")]:
        assert restore(f"so {written} then") == f"so {meant} then"
    for plain in ["the 2nd", "eredsh$$$", "OU!! NO!!", "a b c", "", "12345", "x" * 5]:
        assert restore(plain) == plain or plain == "xxxxx"


def language(text):
    s = np.concatenate([[0, 0], toxicity.symbols(text), [0]])
    return toxicity.log_probabilities(np.bincount(s[:-2] * 784 + s[1:-1] * 28 + s[2:], minlength=28**3))


def said(out, log_p):
    s = [0, 0, *(toxicity._symbol(c) for c in out), 0]
    return sum(log_p[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))


SPEECH = "the idiot and the moron are scum and the loser is stupid pathetic trash under green doors while seven clocks walk by "


def test_viterbi_against_every_source():
    from itertools import product

    rng, log_p = random.Random(3), language(SPEECH * 20)
    for _ in range(300):
        span = "".join(rng.choice("aeinst0134@$!. -") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(1, 6)))
        runs = toxicity.runs_of(span)
        for has in ((), ("doubling",), ("spelling", "leetspeak")):
            costs = toxicity.habit(*has)
            scores = {}
            for parts in product(*(toxicity.ways(c, n, costs) for c, n in runs)):
                out = "".join(p for p, _ in parts)
                scores[out] = max(scores.get(out, -1e9), costs[0] + sum(k for _, k in parts) + said(out, log_p))
            best, out = toxicity.decode(runs, costs, log_p)
            assert best == pytest.approx(max(scores.values())) and scores[out] == pytest.approx(best)


def test_viterbi_of_long_spans():
    """Spans beyond any limit against all states at once, one matrix a symbol."""
    rng, log_p = random.Random(4), language(SPEECH * 20)
    for size in (65, 200, 1500):
        span = "".join(rng.choice("moronstupid0135$") * rng.choice((1, 1, 1, 2)) for _ in range(size))
        runs, costs = toxicity.runs_of(span), toxicity.habit("leetspeak")
        score = np.full((28, 28), -np.inf)
        score[0, 0] = costs[0]
        for c, n in runs:
            after = np.full((28, 28), -np.inf)
            for out, cost in toxicity.ways(c, n, costs):
                now = score + cost
                for s in (toxicity._symbol(x) for x in out):
                    moved = np.full((28, 28), -np.inf)
                    moved[:, s] = (now + log_p[:, :, s]).max(axis=0)
                    now = moved
                after = np.maximum(after, now)
            score = after
        best, out = toxicity.decode(runs, costs, log_p)
        assert best == pytest.approx((score + log_p[:, :, 0]).max())
    assert len(toxicity.restore("m0r0n" * 40_000, log_p)) == 200_000


def test_restoring_takes_time_in_proportion():
    restore = toxicity.Restorer(language(SPEECH))
    for text in ("ab" * 200_000, "a b " * 20_000 + "word", "-" * 200_000, "a" * 200_000, "1" * 200_000, "! " * 50_000, "a1" * 3_000, "_" * 200_000):
        assert restore(text)


def test_recall_of_restoring():
    """Words of the language, written by each habit, come back."""
    rng, restore = random.Random(5), toxicity.Restorer(language(SPEECH * 50))
    looks = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}
    words = [w for w in set(SPEECH.split()) if len(w) > 3]
    habits = {
        "look-alikes": lambda w: "".join(looks.get(c, c) if rng.random() < 0.6 else c for c in w[:-1]) + w[-1],
        "doubled": lambda w: "".join(c * 2 for c in w),
        "repeated": lambda w: (k := rng.randrange(len(w))) is not None and w[:k] + w[k] * rng.randint(3, 6) + w[k + 1 :],
        "spaced": lambda w: " ".join(w),
        "wide": lambda w: "".join(c + rng.choice([" ", "  ", " - ", "..."]) for c in w[:-1]) + w[-1],
        "both": lambda w: ".".join(looks.get(c, c) for c in w[:-1]) + "." + w[-1],
    }
    for name, write in habits.items():
        tries = [w for w in words for _ in range(5)]
        back = sum(restore(f"so {write(w)} then") == f"so {w} then" for w in tries)
        assert back >= 0.9 * len(tries), (name, back, len(tries))
    clean = " ".join(words) * 3
    assert restore(clean) == clean


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).round(2).tolist() for _ in range(300)]
    vectors[7], vectors[11], vectors[12], vectors[13] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]
    vectors[14], vectors[20] = [], vectors[21]
    rows = [(i, v, 1, 2) for i, v in enumerate(vectors)] + [(None, vectors[0], 1, 2), (1000, [1.0, 2.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    fit = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in fit if i % 10 == 0):
        scores = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q and len(v) == len(fit[q]))[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    found = kdtree.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=32)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == sorted(expected)
    assert kdtree.top_k(df.limit(0), F.lit(True)).count() == 0


def brute_top(rows, k, every=10):
    """(query id, id, score) lists of each query row, among all other rows of its length."""
    out = []
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out.append((i, [(j, -s) for s, j, _ in found]))
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_top_k_of_copies_and_repeated_ids(spark, shard_rows):
    """A third of the rows are one vector, some ids come twice, and many scores tie."""
    rng = np.random.default_rng(8)
    rows = [(i, [512, 512, -512] if i % 3 == 0 else rng.integers(-1, 2, 3).tolist()) for i in range(400)]
    rows += [(i, [int(x) for x in rng.integers(-1, 2, 3)]) for i in (0, 0, 10, 11)] + [(401, [1, 2]), (410, [3, 1])]
    df = spark.createDataFrame([(i, [x / 1024 for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    lists = {}
    for r in kdtree.top_k(df, F.col("vec_id") % 10 == 0, k=4, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    got = []
    for i, found in lists.items():  # rows of one query id: their lists interleave by rank
        many = sum(1 for j, _ in rows if j == i)
        expected = sorted((n, *one) for q, best in brute_top(rows, 4) if q == i for n, one in enumerate(best, 1))
        assert sorted(found) == expected and len(found) <= 4 * many
        got.append(i)
    assert set(got) == {i for i, _ in rows if i % 10 == 0}


def test_trees():
    rng = np.random.default_rng(6)
    v = rng.integers(-50, 50, (2300, 4))
    v[100:2100] = v[0]
    tree = kdtree.KDTree(np.arange(2300), np.arange(2300), v, leaf=20, keep=6)
    again = kdtree.KDTree.load(tree.dump())
    q = rng.integers(-9, 9, (30, 4))
    bounds = kdtree.bound(q, again.lo, again.hi)
    for n, (lo, hi) in enumerate(again.runs):
        assert (again.vectors[lo:hi] @ q.T <= bounds[:, n]).all()
    assert len(again.ids) < 800  # of copies the smallest ids are enough
    for x, best in zip(q, again.search(q, np.full(30, -1), [kdtree.NONE] * 30, 5), strict=True):
        assert [(s, i) for s, i, _ in best] == [(-s, i) for s, i in sorted((-int(v[i] @ x), i) for i in range(2300))[:5]]
        floor = best[2][:2]
        assert list(again.search(x[None], np.array([-1]), [floor], 5))[0][:3] == best[:3]


def test_cells_are_even_and_whole():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 8)).round(2) * 100
    v = v.astype(np.int64)
    cells = kdtree.Cells(v[:1000], 4)
    counts = np.bincount(cells.of(v), minlength=16)
    assert len(counts) == 16 and counts.min() > 100 and counts.max() < 500
    assert (kdtree.Cells(np.zeros((50, 3), dtype=np.int64), 3).of(v[:, :3]) >= 0).all()


def test_big_integers_do_not_overflow(spark):
    df = spark.createDataFrame([(0, [3e15, 1.0]), (1, [3e15, 2.0]), (2, [-3e15, 1.0])], "vec_id long, embedding array<double>")
    assert json.dumps([r["vec_id"] for r in kdtree.top_k(df.withColumn("embedding", F.transform("embedding", lambda x: x / 2e9)), F.col("vec_id") == 0).orderBy("rank").collect()]) == "[1, 2]"


def test_damaged_files_never_fail(spark):
    """Every truncation of a file, and 10,000 of flipped bytes, both kinds of frames."""
    rng = np.random.default_rng(12)
    lossless = media.store(rng.integers(0, 256, 192 * 4, dtype=np.uint8).tobytes())
    jpegs = media.write_avi([baseline(rng.integers(0, 256, (8, 16)), 9)] * 2, 16, 8)
    files = [f[:k] for f in (lossless, jpegs) for k in range(len(f))]
    for n in range(10_000):
        data = bytearray(lossless if n % 2 else jpegs)
        for at in rng.integers(0, len(data), rng.integers(1, 4)):
            data[at] = rng.integers(0, 256)
        files.append(bytes(data))
    whole = 0
    for f in files:
        try:
            whole += len(media._samples(media.read_avi(f))) > 0
        except media.Damaged:
            pass
    assert whole > 1000
    some = spark.createDataFrame([(n, f) for n, f in enumerate([lossless, *files[:: len(files) // 300]])], "doc_id long, media binary")
    assert 0 in {r["doc_id"] for r in media.clips(some).collect()}


def test_an_index_that_names_a_frame_again_and_again():
    file = media.store(bytes(192) * 2)
    at = file.rindex(b"idx1")
    entry = file[at + 8 : at + 24]
    again = file[:at] + media._chunk(b"idx1", entry * 5000)
    again = again[:4] + (len(again) - 8).to_bytes(4, "little") + again[8:]
    assert len(media.read_avi(again).frames) == 2
