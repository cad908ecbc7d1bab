"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through their first 50 bytes, most significant digits first, and a group
that cannot hold two documents is dropped after each digit; what is left at full depth are exactly
the repeated 50-byte strings.

Sorting every suffix of a corpus would move many times its size, so the first digit is one that only
few suffixes carry.  Each 50-byte window has an anchor: the leftmost of its 20-byte strings with the
least hash.  Equal windows have equal anchors at equal places, and neighbouring windows mostly share
one, so there is one anchor to some 15 bytes.

1. First digit: 48 bits of the anchor's hash; anchors in one document only are dropped.  A map task
   sends one entry per anchor, however many documents it met it in.
2. The windows of a repeated anchor span a context, at most 80 bytes.  Contexts are dealt by anchor and
   sorted by their bytes, eight a pass; equal groups are repeated contexts, and where a document has the
   very context of a smaller one, all its windows are repeated.  A map task sends each context once.
3. Contexts of one anchor that differ are sorted window by window, eight bytes a pass, and a window in
   a smaller document removes its bytes in the others.

An anchor in more than ``HOT`` documents, such as a common phrase, would gather all its contexts in one
task; its windows are dealt by their own hash instead and sorted like contexts.  Beyond ``LEVEL``
buckets dealing takes two passes, by the leading bits first, so that what a task sends to a bucket
stays large.

Texts are shuffled once, by id, and meet what is found about them twice (the exchange is reused).
Groups travel per map task, never per document, so a line that a third of all documents share makes
no large group.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import table

DEPTH, GRAM = 50, 20
DIGIT = 48
BUCKET_BYTES = 4 << 20  # of text, to a bucket of anchors
FLUSH_ANCHORS, FLUSH_BYTES, SLICE = 3_000_000, 48 << 20, 1 << 20
HOT, LEVEL = 10_000, 1 << 14
WINDOWS = 200_000  # that are sorted at once
_BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)  # more than a slice is long


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the gram that begins at each byte, by doubling."""
    n = len(data) - gram + 1
    part, size, base, done, got = _BYTE[data], 1, _STEP, None, 0
    while True:
        if gram & size:
            here = part[got : got + n]
            done = here.copy() if done is None else done * np.uint64(base) + here
            got += size
        if size * 2 > gram:
            break
        part = part[:-size] * np.uint64(base) + part[size:]
        size, base = size * 2, base * base & (1 << 64) - 1
    done ^= done >> np.uint64(32)
    done *= np.uint64(0xD6E8FEB86659FD93)
    done ^= done >> np.uint64(32)
    return done


def anchors(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digit, place, first window, last window) of each anchor, for slices of any length."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < depth:
        return none, none, none, none
    if len(data) > SLICE + depth:
        parts = []
        for at in range(0, len(data) - depth + 1, SLICE):
            d, *rest = anchors(data[at : at + SLICE + depth - 1], depth, gram)
            parts.append((d, *(r + at for r in rest)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    digits = gram_hashes(data, gram)
    # place below, leading hash bits above: one minimum finds the least, the leftmost of equals
    least = digits & ~_PLACE | np.arange(len(digits), dtype=np.uint64)
    width, want = 1, depth - gram + 1
    while width < want:
        by = min(width, want - width)
        least = np.minimum(least[by:], least[:-by])
        width += by
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    at = place[first]
    digit = digits[at] * np.uint64(_STEP) >> np.uint64(64 - DIGIT)  # least hashes have no leading bits: mixed again
    return digit.astype(np.int64), at, first, np.append(first[1:], len(place)) - 1


# ---------------------------------------------------------------- 1: anchors in several documents


def _pack(numbers: np.ndarray, kind: str) -> bytes:
    """Byte planes, compressed."""
    wide = np.ascontiguousarray(numbers.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(wide.view(np.uint8).reshape(len(wide), -1).T.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _blob(digits: np.ndarray, order: np.ndarray, ids: np.ndarray) -> bytes:
    used, order = np.unique(order, return_inverse=True)
    parts = [_pack(np.diff(digits, prepend=0), "<u8"), _pack(order, "<u4"), _pack(np.diff(ids[used], prepend=0), "<i8")]
    return struct.pack("<III", *map(len, parts)) + b"".join(parts)


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = struct.unpack_from("<III", blob)
    digits, order, ids = (_unpack(blob[lo : lo + n], kind) for lo, n, kind in ((12, a, "<u8"), (12 + a, b, "<u4"), (12 + a + b, c, "<i8")))
    return np.cumsum(digits.astype(np.int64)), np.cumsum(ids)[order]


_FIRST = "bucket int, blob binary, id long, digit long"


def _rows(bucket: np.ndarray, blob: list | None, ids: np.ndarray | None, digit: np.ndarray | None) -> pa.RecordBatch:
    n = len(bucket)
    cols = [pa.array(bucket, type=pa.int32()), pa.array(blob, type=pa.binary()) if blob else pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()) if ids is None else pa.array(ids, type=pa.int64()), pa.nulls(n, pa.int64()) if digit is None else pa.array(digit, type=pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "blob", "id", "digit"])


def _repeated(digits: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (digit, id) pairs, and whether a pair's digit has several ids."""
    order = np.lexsort((ids, digits))
    digits, ids = digits[order], ids[order]
    fresh = np.append(True, (digits[1:] != digits[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    digits, ids = digits[fresh], ids[fresh]
    same = digits[1:] == digits[:-1]
    return digits, ids, np.append(same, False) | np.append(False, same) if len(ids) else np.zeros(0, bool)


def _first_digit(buckets: int):
    """Map side of pass 1: an entry per anchor and flush, and at once the pairs known to be repeated."""
    shift = DIGIT - buckets.bit_length() + 1

    def flush(digits: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        d, i, several = _repeated(np.concatenate(digits), np.concatenate(ids))
        for lo in range(0, int(several.sum()), 50_000):
            some = np.flatnonzero(several)[lo : lo + 50_000]
            yield _rows((d[some] >> shift).astype(np.int32), None, i[some], d[some])
        first = np.append(True, d[1:] != d[:-1])
        d, i = d[first], i[first]
        known, order = np.unique(i, return_inverse=True)
        edges = np.searchsorted(d >> shift, np.arange(buckets + 1))
        held, many, size = [], [], 0
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if lo < hi:
                many.append(b)
                held.append(_blob(d[lo:hi], order[lo:hi], known))
                size += len(held[-1])
            if size > 4 << 20 or many and b == buckets - 1:
                yield _rows(np.array(many), held, None, None)
                held, many, size = [], [], 0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, ids, n = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                d = np.unique(anchors(np.frombuffer(_bytes(t.as_py()), dtype=np.uint8))[0])
                if len(d):
                    digits.append(d)
                    ids.append(np.full(len(d), i.as_py(), dtype=np.int64))
                    n += len(d)
                if n > FLUSH_ANCHORS:
                    yield from flush(digits, ids)
                    digits, ids, n = [], [], 0
        if n:
            yield from flush(digits, ids)

    return each


def _reduce_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, blobs first, and digit to (id, digit) of anchors in several documents; the
    digit of one in more than HOT is inverted."""

    def out(ids: np.ndarray, digits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 50_000]), pa.array(digits[lo : lo + 50_000])], ["id", "digit"])

    class Bucket:
        def __init__(self) -> None:
            self.blobs: list[bytes] = []
            self.digits = self.ids = np.zeros(0, np.int64)
            self.hot: set[int] = set()
            self.digit, self.many, self.held = -1, 0, []

        def read(self) -> None:
            if self.blobs:
                parts = [_open(b) for b in self.blobs]
                self.blobs = []
                d, i, several = _repeated(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                # an entry of a blob may have been told with others of its map task
                self.digits, self.ids = d[several], i[several]

        def rows(self, ids: np.ndarray, digits: np.ndarray) -> Iterator[pa.RecordBatch]:
            self.read()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(digits)) + 1, [len(digits)]])
            run, known = np.diff(edges), np.searchsorted(self.digits, digits[edges[:-1]] + 1) - np.searchsorted(self.digits, digits[edges[:-1]])
            # the first and last digit may go on in other batches
            plain = run + known <= HOT
            plain[[0, -1]] = False
            told = np.repeat(plain, run)
            yield from out(ids[told], digits[told])
            for k in np.flatnonzero(~plain).tolist():
                lo, hi = edges[k], edges[k + 1]
                if digits[lo] != self.digit:
                    yield from self.rest()
                    self.digit, self.many = int(digits[lo]), int(known[k])
                self.many += int(hi - lo)
                self.held.append(np.stack([ids[lo:hi], digits[lo:hi]]))
                if self.many > HOT:
                    self.hot.add(self.digit)
                    hot, self.held = np.concatenate(self.held, axis=1), []
                    yield from out(hot[0], ~hot[1])

        def rest(self) -> Iterator[pa.RecordBatch]:
            if self.held:
                told, self.held = np.concatenate(self.held, axis=1), []
                yield from out(told[0], told[1])

        def close(self) -> Iterator[pa.RecordBatch]:
            self.read()
            yield from self.rest()
            if len(self.ids):
                first = np.flatnonzero(np.append(True, np.diff(self.digits) != 0))
                many = np.diff(np.append(first, len(self.digits)))
                hot = np.repeat(many > HOT, many) | np.isin(self.digits, np.array(sorted(self.hot), dtype=np.int64))
                yield from out(self.ids, np.where(hot, ~self.digits, self.digits))

    now, bucket = None, Bucket()
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if numbers[lo] != now:
                yield from bucket.close()
                now, bucket = numbers[lo], Bucket()
            some = batch.slice(lo, hi - lo)
            bucket.blobs += [b for b in some.column(1).to_pylist() if b is not None]
            done = some.filter(some.column(2).is_valid())
            if done.num_rows:
                yield from bucket.rows(done.column(2).to_numpy(), done.column(3).to_numpy())
    yield from bucket.close()


def _deal_first(buckets: int):
    """Second pass of dealing: from blobs of leading bits to blobs of all buckets, merged as they come."""
    shift = DIGIT - buckets.bit_length() + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            d, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(d, kind="stable")
            d, i = d[order], i[order]
            edges = [0, *(np.flatnonzero(np.diff(d >> shift)) + 1).tolist(), len(d)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                known, at = np.unique(i[lo:hi], return_inverse=True)
                yield _rows(np.array([d[lo] >> shift]), [_blob(d[lo:hi], at, known)], None, None)

        parts, n = [], 0
        for batch in batches:
            done = batch.filter(batch.column(2).is_valid())
            if done.num_rows:
                d = done.column(3).to_numpy()
                yield _rows((d >> shift).astype(np.int32), None, done.column(2).to_numpy(), d)
            for blob in batch.column(1).to_pylist():
                if blob is not None:
                    parts.append(_open(blob))
                    n += len(parts[-1][0])
                if n > FLUSH_ANCHORS:
                    yield from flush()
                    parts, n = [], 0
        if n:
            yield from flush()

    return each


# ---------------------------------------------------------------- 2: contexts

_SECOND = "bucket int, blob binary, id long, h long, at array<int>"
_LISTS = pa.list_(pa.int32())
Entry = tuple[int, bytes, int, int, int, list[int]]  # digit, context, place of the anchor in it, id, hash of the text, starts


def _second_rows(buckets: list[int], blobs: list[bytes] | None, docs: list[tuple[int, int]] | None = None, at: list[list[int]] | None = None) -> pa.RecordBatch:
    n = len(buckets)
    cols = [pa.array(buckets, type=pa.int32()), pa.array(blobs, type=pa.binary()) if blobs else pa.nulls(n, pa.binary())]
    cols += [pa.array([i for i, _ in docs], type=pa.int64()), pa.array([h for _, h in docs], type=pa.int64()), pa.array(at, type=_LISTS)] if docs else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, _LISTS)]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "blob", "id", "h", "at"])


def _pack_entries(entries: list[Entry]) -> bytes:
    """Entries sorted by digit, column by column, compressed."""
    digits, contexts, offs, ids, hashes, starts = zip(*entries, strict=True)
    docs = sorted(set(zip(ids, hashes, strict=True)))
    at = {d: n for n, d in enumerate(docs)}
    columns = [
        _pack(np.diff(np.array(digits, dtype=np.int64), prepend=0), "<u8"),
        zstandard.ZstdCompressor(level=3).compress(b"".join(contexts)),
        _pack(np.array([len(c) for c in contexts]), "u1"),
        _pack(np.array(offs), "u1"),
        _pack(np.array([at[d] for d in zip(ids, hashes, strict=True)]), "<u4"),
        _pack(np.array([len(x) for x in starts]), "<u4"),
        _pack(np.array([a for x in starts for a in x]), "<u4"),
        _pack(np.array([i for i, _ in docs]), "<i8"),
        _pack(np.array([h for _, h in docs]), "<i8"),
    ]
    return struct.pack("<9I", *map(len, columns)) + b"".join(columns)


class Entries:
    """Entries of one blob or several, column by column."""

    def __init__(self, blobs: list[bytes]):
        parts = [self._columns(b) for b in blobs]
        self.digits, self.lengths, self.offs, self.ids, self.hashes, self.many, self.starts = (np.concatenate([p[k] for p in parts]) for k in range(7))
        self.text = np.frombuffer(b"".join(p[7] for p in parts), dtype=np.uint8)
        self.first = np.cumsum(self.many) - self.many  # of starts

    @staticmethod
    def _columns(blob: bytes) -> tuple:
        sizes, at, parts = struct.unpack_from("<9I", blob), 36, []
        for n in sizes:
            parts.append(blob[at : at + n])
            at += n
        kinds = ("<u8", "", "u1", "u1", "<u4", "<u4", "<u4", "<i8", "<i8")
        digits, text, lengths, offs, order, many, starts, ids, hashes = (_unpack(p, k) if k else zstandard.ZstdDecompressor().decompress(p) for p, k in zip(parts, kinds, strict=True))
        return np.cumsum(digits.astype(np.int64)), lengths.astype(np.int64), offs.astype(np.int64), ids[order], hashes[order], many.astype(np.int64), starts.astype(np.int64), text

    def tuples(self) -> Iterator[Entry]:
        text, ends = self.text.tobytes(), np.cumsum(self.lengths).tolist()
        lengths, first, many = self.lengths.tolist(), self.first.tolist(), self.many.tolist()
        for k, (digit, off, i, h) in enumerate(zip(self.digits.tolist(), self.offs.tolist(), self.ids.tolist(), self.hashes.tolist(), strict=True)):
            yield digit, text[ends[k] - lengths[k] : ends[k]], off, i, h, self.starts[first[k] : first[k] + many[k]].tolist()

    def matrix(self) -> np.ndarray:
        """(entries, 2 * DEPTH - GRAM) bytes of the contexts, zeros behind them."""
        out = np.zeros((len(self.digits), 2 * DEPTH - GRAM), dtype=np.uint8)
        out[np.arange(out.shape[1]) < self.lengths[:, None]] = self.text
        return out


def _each_window(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Windows of hot anchors, each an anchor of its own."""
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        digits = gram_hashes(data[a : b + DEPTH], DEPTH) >> np.uint64(64 - DIGIT)
        yield from ((d, k, k, k) for d, k in zip(digits.tolist(), range(a, b + 1), strict=True))


def text_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


class Spans:
    """Removed spans by (id, hash of the text)."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], list[int]] = {}

    def add(self, doc: tuple[int, int], starts: list[int], length: int) -> None:
        mine = self.of.setdefault(doc, [])
        for a in starts:
            if mine and mine[-2] <= a <= mine[-1]:
                mine[-1] = max(mine[-1], a + length)
            else:
                mine += [a, a + length]


def _dealt(entries: list[Entry], shift: int) -> Iterator[pa.RecordBatch]:
    """A blob for each bucket."""
    entries.sort(key=lambda e: e[0])
    lo, held, many, size = 0, [], [], 0
    while lo < len(entries):
        bucket, hi = entries[lo][0] >> shift, lo
        while hi < len(entries) and entries[hi][0] >> shift == bucket:
            hi += 1
        many.append(bucket)
        held.append(_pack_entries(entries[lo:hi]))
        size += len(held[-1])
        lo = hi
        if size > 4 << 20 or lo == len(entries):
            yield _second_rows(many, held)
            held, many, size = [], [], 0


def _deal_second(buckets: int):
    """Second pass of dealing, as of anchors."""
    shift = DIGIT - buckets.bit_length() + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            done = batch.filter(batch.column(2).is_valid())
            if done.num_rows:
                yield done
            for blob in batch.column(1).to_pylist():
                if blob is not None:
                    some = list(Entries([blob]).tuples())
                    held += some
                    size += 250 * len(some)
                if size > FLUSH_BYTES:
                    yield from _dealt(held, shift)
                    held, size = [], 0
        if held:
            yield from _dealt(held, shift)

    return each


def _contexts(buckets: int):
    """From (id, body, digits) to a blob per flush and bucket of the distinct contexts, each with the
    smallest document that has it, and rows with the spans of the others."""
    shift = DIGIT - buckets.bit_length() + 1

    def flush(smallest: dict, others: list[Entry], spans: Spans) -> Iterator[pa.RecordBatch]:
        yield from _dealt([(digit, c, off, i, h, at) for (c, off), (i, h, at, digit) in smallest.items()] + others, shift)
        rows = list(spans.of.items())
        for lo in range(0, len(rows), 20_000):
            some = rows[lo : lo + 20_000]
            yield _second_rows([d[1] % buckets for d, _ in some], None, [d for d, _ in some], [at for _, at in some])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[tuple[bytes, int], tuple[int, int, list[int], int]] = {}
        spans, others, size = Spans(), [], 0
        for batch in batches:
            for i, t, k in zip(*batch.columns, strict=True):
                doc, data, wanted = i.as_py(), _bytes(t.as_py()), np.unique(k.values.to_numpy(zero_copy_only=False))
                h = text_hash(data)
                flat = np.frombuffer(data, dtype=np.uint8)
                found = anchors(flat)
                hit, hot = (wanted[np.minimum(np.searchsorted(wanted, d), len(wanted) - 1)] == d for d in (found[0], ~found[0]))
                for digit, p, a, b in chain(zip(*(x[hit].tolist() for x in found), strict=True), _each_window(flat, found[2][hot], found[3][hot])):
                    key = (data[a : b + DEPTH], p - a)
                    seen = smallest.get(key)
                    if seen is None:
                        smallest[key] = (doc, h, [a], digit)
                        size += 250
                    elif seen[0] == doc and seen[1] == h:
                        seen[2].append(a)
                    elif seen[0] < doc:
                        spans.add((doc, h), [a], len(key[0]))
                    elif seen[0] == doc:  # another row of the same id
                        others.append((digit, *key, doc, h, [a]))
                    else:
                        spans.add(seen[:2], seen[2], len(key[0]))
                        smallest[key] = (doc, h, [a], digit)
                if size > FLUSH_BYTES:
                    yield from flush(smallest, others, spans)
                    smallest, spans, others, size = {}, Spans(), [], 0
        yield from flush(smallest, others, spans)

    return each


def radix_groups(group: np.ndarray, data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """New numbers of groups: two rows have one if they are of one group with equal bytes.

    Most-significant digit first: each pass refines the groups by eight bytes, and a row whose group is down
    to one id is sorted no further; it has a number of its own.
    """
    digits = np.zeros((len(data), -(-data.shape[1] // 8) * 8), dtype=np.uint8)
    digits[:, : data.shape[1]] = data
    digits = digits.view(">u8").astype(np.uint64)
    out, left = -1 - np.arange(len(data)), np.arange(len(data))
    group = np.unique(group, return_inverse=True)[1]
    for k in range(digits.shape[1] + 1):
        order = np.argsort(group[left], kind="stable") if k == 0 else np.lexsort((digits[left, k - 1], group[left]))
        left = left[order]
        g = group[left]
        differs = g[1:] != g[:-1]
        if k:
            d = digits[left, k - 1]
            differs |= d[1:] != d[:-1]
        new = np.cumsum(np.append(0, differs))[: len(left)]
        group[left] = new
        edges = np.append(0, np.flatnonzero(differs) + 1)
        if len(left):
            mixed = np.maximum.reduceat(ids[left], edges) > np.minimum.reduceat(ids[left], edges)
            left = left[mixed[new]]
        if not len(left):
            break
    out[left] = group[left]
    return out


def windows_by_radix(group: np.ndarray, data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each row's string also belongs to a row of its group with a smaller id."""
    found = radix_groups(group, data, ids)
    least = np.zeros(0, dtype=ids.dtype)
    out, some = np.zeros(len(data), dtype=bool), np.flatnonzero(found >= 0)
    if len(some):
        least = np.full(int(found.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, found[some], ids[some])
        out[some] = ids[some] > least[found[some]]
    return out


def _spans_of(e: Entries) -> Spans:
    """What the documents of one bucket lose; entries are those of all map tasks."""
    spans, ids, text = Spans(), e.ids, e.matrix()

    def lose(rows: np.ndarray, inner: np.ndarray, length: np.ndarray) -> None:
        for n, k, size in zip(rows.tolist(), inner.tolist(), length.tolist(), strict=True):
            spans.add((int(ids[n]), int(e.hashes[n])), (e.starts[e.first[n] : e.first[n] + e.many[n]] + k).tolist(), size)

    digit = np.unique(e.digits, return_inverse=True)[1]
    whole = windows_by_radix((digit * 256 + e.offs) * 256 + e.lengths, text, ids)
    gone = np.flatnonzero(whole)
    lose(gone, np.zeros_like(gone), e.lengths[gone])
    # of what is left, anchors with several ids, window by window
    left = np.flatnonzero(~whole)
    left = left[np.argsort(digit[left], kind="stable")]
    if not len(left):
        return spans
    edges = np.append(0, np.flatnonzero(np.diff(digit[left])) + 1)
    mixed = np.maximum.reduceat(ids[left], edges) > np.minimum.reduceat(ids[left], edges)
    left = left[np.repeat(mixed, np.diff(np.append(edges, len(left))))]
    if not len(left):
        return spans
    slides = np.lib.stride_tricks.sliding_window_view(text, DEPTH, axis=1)
    total = np.cumsum(e.lengths[left] - DEPTH + 1)
    starts = np.append(0, np.flatnonzero(np.diff(digit[left])) + 1)
    at = 0
    while at < len(starts):  # whole anchors, about WINDOWS at a time
        before = total[starts[at] - 1] if starts[at] else 0
        after = int(np.searchsorted(np.append(total[starts[at + 1 :] - 1], total[-1]), before + WINDOWS)) + at + 1
        some = left[starts[at] : starts[after] if after < len(starts) else None]
        many = e.lengths[some] - DEPTH + 1
        whose = np.repeat(some, many)
        inner = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
        hit = windows_by_radix(digit[whose] * 256 + e.offs[whose] - inner, slides[whose, inner], ids[whose])
        lose(whose[hit], inner[hit], np.full(int(hit.sum()), DEPTH))
        at = after
    return spans


def _reduce_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket to (id, h, spans)."""

    def out(docs: list[tuple[tuple[int, int], list[int]]]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(docs), 20_000):
            some = docs[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d, _ in some], type=pa.int64()) for k in (0, 1)] + [pa.array([at for _, at in some], type=_LISTS)], ["id", "h", "at"])

    now, held = None, []
    for batch in batches:
        done = batch.filter(pa.array(np.asarray(batch.column(2).is_valid())))
        if done.num_rows:
            yield done.select(["id", "h", "at"])
        for b, blob in zip(batch.column(0), batch.column(1), strict=True):
            if blob.is_valid:
                if b.as_py() != now:
                    if held:
                        yield from out(list(_spans_of(Entries(held)).of.items()))
                    now, held = b.as_py(), []
                held.append(blob.as_py())
    if held:
        yield from out(list(_spans_of(Entries(held)).of.items()))


# ---------------------------------------------------------------- the whole


def merged(at: list[int]) -> list[tuple[int, int]]:
    """Disjoint, not touching, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(at[::2], at[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """From (id long, body) to (id, found): arrays of (h, at), the spans to remove from texts of that hash."""
    known = docs.filter("id is not null")
    total = known.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = 1 << max(4, (total // BUCKET_BYTES).bit_length())
    coarse = buckets if buckets <= LEVEL else 1 << (buckets.bit_length() // 2)
    first = known.mapInArrow(_first_digit(coarse), _FIRST).repartition("bucket")
    if coarse < buckets:
        first = first.mapInArrow(_deal_first(buckets), _FIRST).repartition("bucket")
    first = first.sortWithinPartitions("bucket", F.col("blob").isNull(), "digit")
    pairs = first.mapInArrow(_reduce_first, "id long, digit long")
    digits = pairs.groupBy("id").agg(F.collect_list("digit").alias("digits"))  # as many as a text has anchors
    again = known.join(digits.hint("shuffle_hash"), "id").select("id", "body", "digits")
    second = again.mapInArrow(_contexts(coarse), _SECOND).repartition("bucket")
    if coarse < buckets:
        second = second.mapInArrow(_deal_second(buckets), _SECOND).repartition("bucket")
    second = second.sortWithinPartitions("bucket")
    spans = second.mapInArrow(_reduce_second, "id long, h long, at array<int>")
    return spans.groupBy("id").agg(F.collect_list(F.struct("h", "at")).alias("found"))


def deduplicate(df: DataFrame, row_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(row_id, *keep, n_bytes, n_removed, n_spans, kept_sha256) per row and, if asked for, kept_text.

    Removes each byte covered by a DEPTH-byte string that also starts in a row with a smaller id; the
    id is a whole number.  A row with a null id neither loses bytes nor makes others lose any; rows of
    one id do not remove from each other; a null text is empty.  kept_text leaves out the bytes of
    characters that were cut apart.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("body"), *(F.col(c).alias(f"_k_{n}") for n, c in enumerate(keep)))
    found = repeated_spans(rows.select("id", "body"))
    joined = rows.filter("id is not null").join(found.hint("shuffle_hash"), "id", "left")
    joined = joined.unionByName(rows.filter("id is null").withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))
    kept = [f"_k_{n}" for n in range(len(keep))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some, made = batch.slice(lo, 512), []
                for t, f in zip(some.column(some.num_columns - 2), some.column(some.num_columns - 1), strict=True):
                    data, f = _bytes(t.as_py()), f.as_py()
                    h = text_hash(data) if f else 0
                    gone = merged([x for one in f or () if one["h"] == h for x in one["at"]])
                    view, parts, at = memoryview(data), [], 0
                    for a, b in gone:
                        parts.append(view[at:a])
                        at = b
                    rest = b"".join([*parts, view[at:]]) if gone else data
                    made.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
                cols = [pa.array(c, type=k) for c, k in zip(zip(*made, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)] if made else []
                if made:
                    yield pa.RecordBatch.from_arrays([*some.columns[:-2], *cols[: 5 if with_text else 4]], [*some.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])])

    head = joined.select("id", *kept, "body", "found")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head.schema[:-2])
    out = head.mapInArrow(each, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.select(F.col("id").cast(df.schema[row_id].dataType).alias(row_id), *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffixes": op7_suffixes}
ORACLES = {
    "op7_suffixes": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 runs AS (SELECT doc_id, k, regexp_extract_all(substr(x, 2 * k + 1), '.{{{2 * DEPTH}}}') AS ws FROM d, range({DEPTH}) t(k)),
 windows AS (SELECT doc_id, k + {DEPTH} * (unnest(range(1, len(ws) + 1)) - 1) AS a, unnest(ws) AS w FROM runs),
 least AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
 hits AS (SELECT doc_id, a, lag(a) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM windows JOIN least USING (w) WHERE first_id < doc_id),
 parts AS (SELECT doc_id, a, sum(CASE WHEN before IS NULL OR a > before + {DEPTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS part FROM hits),
 spans AS (SELECT doc_id, min(a) AS lo, max(a) + {DEPTH} AS hi, lag(max(a) + {DEPTH}, 1, 0) OVER (PARTITION BY doc_id ORDER BY min(a)) AS last_hi FROM parts GROUP BY doc_id, part),
 gone AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last_hi, string_agg(substr(x, 2 * last_hi + 1, 2 * (lo - last_hi)), '' ORDER BY lo) AS head FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(head || substr(x, 2 * last_hi + 1), x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
}
