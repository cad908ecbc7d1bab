"""The passes of the suffix sort without Spark between them, with small limits, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import brute_windows

from evmatch.llm import suffixes


def batches(rows, kinds, size=7):
    names = [n for n, _ in kinds]
    for lo in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, (_, t) in zip(zip(*rows[lo : lo + size], strict=True), kinds, strict=True)], names)


def rows_of(found):
    return [tuple(r.values()) for b in found for r in b.to_pylist()]


FIRST = [("bucket", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("digit", pa.int64())]
SECOND = [("bucket", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.list_(pa.int32()))]


def removed(docs, buckets, coarse, tasks=3):
    """(id, bytes to remove) by the very functions that run in the tasks."""
    texts = [("id", pa.int64()), ("body", pa.string())]
    first = [r for t in range(tasks) for r in rows_of(suffixes._first_digit(coarse)(batches(docs[t::tasks], texts)))]
    second_pass = coarse < buckets
    if second_pass:
        first.sort(key=lambda r: r[0])
        first = rows_of(suffixes._deal_first(buckets)(batches(first, FIRST)))
    first.sort(key=lambda r: (r[0], r[1] is None, r[3] if r[3] is not None else -1))
    digits = defaultdict(list)
    for i, d in rows_of(suffixes._reduce_first(batches(first, FIRST))):
        digits[i].append(d)
    wanted = [(i, t, digits[i]) for i, t in docs if i in digits]
    second = [r for t in range(tasks) for r in rows_of(suffixes._contexts(coarse)(batches(wanted[t::tasks], [*texts, ("digits", pa.list_(pa.int64()))])))]
    if second_pass:
        second = rows_of(suffixes._deal_second(buckets)(batches(second, SECOND)))
    second.sort(key=lambda r: r[0])
    spans = defaultdict(list)
    for i, h, at in rows_of(suffixes._reduce_second(batches(second, SECOND))):
        spans[i, h] += at
    out = {}
    for i, t in docs:
        data = (t or "").encode()
        gone = suffixes.merged(spans.get((i, suffixes.text_hash(data)), []))
        out.setdefault(i, []).append((sum(b - a for a, b in gone), len(gone)))
    return {i: sorted(x) for i, x in out.items()}, digits


def corpus(rng, n):
    phrase, line = "a phrase that is common", "one line that a third of all documents have in common, word for word, to its end"
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        if rng.random() < 0.5:
            parts += [phrase + rng.choice([" ", ""]), " ".join(word() for _ in range(3)), phrase, " ".join(word() for _ in range(9))]
        if rng.random() < 0.3:
            parts.append(line)
        if docs and rng.random() < 0.3:
            parts.append(rng.choice(docs)[1][5:])
        docs.append((i, " ".join(parts)))
    docs += [(3, docs[4][1] + "other"), (3, docs[3][1]), (n, ""), (n + 1, None), (n + 2, line * 9)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [3, 10_000])
@pytest.mark.parametrize("buckets, coarse", [(16, 16), (64, 8)])
def test_passes_against_brute_force(monkeypatch, hot, buckets, coarse):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FLUSH_ANCHORS", 300)
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "WINDOWS", 50)
    docs = corpus(random.Random(hot + buckets), 60)
    got, digits = removed(docs, buckets, coarse)
    expected = {i: sorted((gone, spans) for _, gone, spans, _ in x) for i, x in brute_windows(docs).items()}
    assert got == expected
    assert any(d < 0 for some in digits.values() for d in some) == (hot == 3)


def test_a_phrase_with_any_surroundings_is_spread(monkeypatch):
    """No bucket gets more than its share of what a hot anchor's documents send."""
    monkeypatch.setattr(suffixes, "HOT", 500)
    rng = random.Random(5)
    docs = [(i, f"{rng.getrandbits(120):x} a phrase that is common to all {rng.getrandbits(120):x}") for i in range(3000)]
    wanted = [(i, t, [~d for d in set(suffixes.anchors(np.frombuffer(t.encode(), np.uint8))[0].tolist())]) for i, t in docs]
    found = rows_of(suffixes._contexts(64)(batches(wanted, [("id", pa.int64()), ("body", pa.string()), ("digits", pa.list_(pa.int64()))], 500)))
    sizes = defaultdict(int)
    for bucket, blob, *_ in found:
        sizes[bucket] += len(suffixes.Entries([blob]).digits)
    assert len(sizes) == 64 and max(sizes.values()) < 3 * min(sizes.values())


def test_memory_of_a_bucket_with_many_contexts(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    entries = [(7, bytes(a), 20, i, i, [0]) for i, a in enumerate(rng.integers(97, 123, (20_000, 80), dtype=np.uint8))]
    blob = suffixes._pack_entries(entries)
    tracemalloc.start()
    spans = suffixes._spans_of(suffixes.Entries([blob]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not spans.of and peak < 400 << 20
