"""SimHash, suffix-array dedup, sharding, mixing and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evmatch.llm import components, mixing, packing, sharding, simhash, suffixes
from evmatch.llm.common import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(documents, rows, nothing):
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    expected = classes(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_of_a_sliced_text(monkeypatch):
    text = "Some Words in a row that are\tcut anywhere \n at all, é and so on"
    whole = simhash.fingerprint(text)[0]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text)[0] == whole == fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    rng, golay = np.random.default_rng(1), simhash.Golay()
    v = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in rng.integers(0, 3, 500)], dtype=np.uint64)
    for keys in (lambda x: simhash.golay_keys(x, golay), simhash.byte_keys):
        a, b = (set(zip(*(x.tolist() for x in keys(y)), strict=True)) for y in (v, v ^ flips))
        assert len({r for r, _ in a & b}) == 500


def test_a_crowded_bucket_goes_the_other_way(spark, monkeypatch):
    """Fingerprints around one centre, more than a bucket takes."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(k) for k in rng.choice(40, rng.integers(1, 4), replace=False)) for _ in range(300)})
    monkeypatch.setattr(simhash, "BUCKET", 16)
    df = spark.createDataFrame([([f], f) for f in fps], "fps array<long>, node long")
    found = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in found) and len(found) < 28 * len(fps)
    exact = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    assert classes(fps, found) == exact


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, 50), (50, 100), (7, 7), (None, 3)]
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(1, 41)} | {100: 50}


def test_similar_documents(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    edit = lambda n: " ".join("zzz" if k in set(rng.sample(range(400), n)) else w for k, w in enumerate(base))
    near = [" ".join("q" if k in (5, 200) else w for k, w in enumerate(base))]
    other = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(20)]
    texts = [" ".join(base), *other, *near, " ".join(base), edit(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert got == {21: 0, 22: 0}


def brute_windows(rows):
    seen, out = defaultdict(lambda: 1 << 60), {}
    for i, text in rows:
        data = (text or "").encode()
        for a in range(len(data) - 49):
            seen[data[a : a + 50]] = min(seen[data[a : a + 50]], i)
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, dtype=np.int8)
        for a in range(len(data) - 49):
            if seen[data[a : a + 50]] < i:
                gone[a + 1 : a + 51] = 1
        kept = bytes(b for b, g in zip(data, gone[1:-1], strict=True) if not g)
        out.setdefault(i, []).append((len(data), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def removed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {i: sorted(x) for i, x in out.items()}


def test_suffixes(documents, rows, nothing):
    assert removed(suffixes.deduplicate(documents)) == brute_windows([(r[0], r[1]) for r in rows])
    assert suffixes.deduplicate(nothing).count() == 0


def test_suffixes_of_rows_with_one_id_or_none(spark):
    text = "one text that is surely longer than fifty bytes, and then some more of it"
    rows = [(1, text), (1, text + " other"), (1, text), (2, "x" + text), (2, "y" + text + "z"), (None, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = removed(suffixes.deduplicate(df))
    expected = brute_windows([r for r in rows if r[0] is not None])
    assert {i: got[i] for i in (1, 2, 3)} == expected and got[None][0][1] == 0
    kept = {(r["doc_id"], r["kept_text"]) for r in suffixes.deduplicate(df, with_text=True).collect()}
    assert (2, "x") in kept and (2, "yz") in kept


def test_radix_sort_of_windows():
    rng = np.random.default_rng(0)
    data, ids, group = rng.integers(0, 2, (400, 50), dtype=np.uint8), rng.integers(0, 5, 400), rng.integers(0, 3, 400)
    data[:, :46] = 7
    least = {}
    for g, d, i in zip(group, data, ids, strict=True):
        least[g, d.tobytes()] = min(least.get((g, d.tobytes()), 99), i)
    assert suffixes.windows_by_radix(group, data, ids).tolist() == [i > least[g, d.tobytes()] for g, d, i in zip(group, data, ids, strict=True)]


def test_anchors_of_a_sliced_text(monkeypatch):
    data = np.random.default_rng(3).integers(97, 101, 5000, dtype=np.uint8)
    windows = lambda found: {(a, d, p) for d, p, lo, hi in zip(*(x.tolist() for x in found), strict=True) for a in range(lo, hi + 1)}
    whole = windows(suffixes.anchors(data))
    assert {a for a, _, _ in whole} == set(range(len(data) - 49))
    monkeypatch.setattr(suffixes, "SLICE", 700)
    assert windows(suffixes.anchors(data)) == whole


def test_sharding(documents, rows, nothing):
    out = sharding.interleave(documents, 7).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    total = Counter(r["source"] for r in out)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        for source, n in Counter(r["source"] for r in members).items():
            assert abs(n - total[source] / 7) <= 2
    assert sorted(map(str, out)) == sorted(map(str, sharding.interleave(documents.repartition(5), 7).collect()))
    assert sharding.interleave(nothing, 7).count() == 0
    assert sharding.interleave(documents.limit(3), 7).count() == 3


def filled(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    money, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = (money - sum(target.values())) / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not stopped:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in stopped}
        open_ -= stopped
    return target


@pytest.mark.parametrize("cut", ["word", "document"])
def test_mixing(documents, rows, nothing, cut):
    out = mixing.mix(documents, words("text"), cut=cut).collect()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    expected, taken = filled(sizes), Counter()
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(expected[source[r["doc_id"]]])
        assert cut == "word" or not r["size"] or r["taken"] % r["size"] == 0
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in expected.items():
        assert taken[s] == int(t) if cut == "word" else abs(taken[s] - t) <= max(size.values())
    assert mixing.mix(nothing, words("text")).count() == 0


def test_mixing_of_sources_without_words(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "c", "x")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(df, words("text")).collect()} == {(1, 2), (None, 2), (2, 0), (3, 0)} or sum(r["taken"] for r in mixing.mix(df, words("text")).collect()) == 4


VOCABULARY = None


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(packing.VOCABULARY)


def test_packing(documents, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    out = packing.pack(documents, vocabulary(), capacity=128, with_ids=True).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, parts in pieces.items():
        parts.sort(key=lambda r: r["piece"])
        got = [x for p in parts for x in np.frombuffer(bytes(p["ids"]), dtype="<u4").tolist()]
        assert got == ids[i] and all(p["length"] == 128 for p in parts[1:]) and all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in parts)
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
    assert set(pieces) == set(ids)
    for members in bins.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == [sum(x["length"] for x in members[:k]) for k in range(len(members))]
        assert sum(r["length"] for r in members) <= 128
    assert len(bins) <= 1.05 * sum(map(len, ids.values())) / 128 + 1
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_chunks_give_the_tokenizers_ids():
    import random

    from tokenizers import Tokenizer

    rng, tokenizer, coder = random.Random(1), Tokenizer.from_file(vocabulary()), packing.Chunks(vocabulary())
    bits = [" ", "  ", "\n", "\t", " \n", "a", "b'", "'s", " the", ".", "é", "12", "ing", "　", "!!", "\r\n", "²", "\x1c", "\x85", "漢字", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert coder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_packing_plans():
    import random

    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        got = Counter()
        for many, bin_ in packing.plan(counts, 60):
            at = 0
            for n, k, offset in bin_:
                assert offset == at
                at += n * k
                got[n] += many * k
            assert at <= 60
        assert got == Counter(counts)
