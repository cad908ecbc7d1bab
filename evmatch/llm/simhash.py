"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18.  Two fingerprints at most two bits
apart agree on at least one whole segment (pigeonhole), and differ by at most two bits in each other.
The binary Golay code puts every 23-bit word within three bits of exactly one of 4096 codewords; the
codewords that a word and its 23 neighbours decode to are one to six, and two words at most two bits
apart share one of them, since a word between both is a neighbour of each.  So a fingerprint gets the
keys (intact segment, codeword index of another segment), up to 18, and whatever shares a key is
verified on all 64 bits.

Only distinct fingerprints take part, so exact copies cost one row.  A bucket emits a spanning forest
of its verified links, never its pairs.  A bucket beyond ``BUCKET`` fingerprints goes another way:
its members get the 28 keys made of six of their eight bytes, one of which two fingerprints two bits
apart must share; such a bucket can hold no more than 65,536 fingerprints and is searched through a
table of that size, by looking up the 136 words within two bits of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch, narrow_files, table
from evmatch.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
BUCKET, SLICE = 1024, 1 << 20
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code
GENERATOR = 0b101011100011


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle, repeats included, a slice of the text at a time.

    A-Z are lower-cased; fewer words than ``size`` make one shingle of all; no words, nothing.
    """
    data, at, kept, done = (text or "").encode("utf-8", "surrogatepass"), 0, [], False
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = kept + data[at:end].lower().split()
        at = end
        if len(words) >= size:
            done = True
            yield np.array([digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))], dtype=np.uint64)
        kept = words[-(size - 1) :] if len(words) >= size and size > 1 else [] if size == 1 else words
    if not done and kept:
        yield np.array([digest(b" ".join(kept), seed)], dtype=np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED, many: int = 1) -> np.ndarray:
    """``many`` fingerprints of 64 bits.  Bit k is set if it is set in over half the shingles' hashes; 0
    without words.  The first is of the hashes as they are, others of the hashes mixed further."""
    ones, n = np.zeros((many, 64), dtype=np.int64), 0
    for h in shingle_hashes(text, size, seed):
        for k in range(many):
            mixed = h if k == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(2 * k * 0x5851F42D4C957F2D + 1 & (1 << 64) - 1)
            mixed = mixed if k == 0 else mixed ^ mixed >> np.uint64(32)
            for i in range(0, len(h), 65_000):  # as far as 16 bits count
                bits = np.unpackbits(mixed[i : i + 65_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[k] += bits.sum(axis=0, dtype=np.uint16)
        n += len(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, size: int = SHINGLE, seed: int = SEED, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, fp): the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size, seed)[0] for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_id", "fp"])

    return df.select(F.col(row_id), F.col(text)).mapInArrow(each, f"_id {df.schema[row_id].dataType.simpleString()}, fp long")


class Golay:
    """Decoder of the binary [23, 12] code: 23-bit words to 12-bit codeword indices."""

    def __init__(self) -> None:
        def syndrome(w: int) -> int:
            for k in range(22, 10, -1):
                if w >> k & 1:
                    w ^= GENERATOR << (k - 11)
            return w

        unit = np.array([syndrome(1 << k) for k in range(23)], dtype=np.uint32)
        low, high = np.zeros(4096, dtype=np.uint32), np.zeros(2048, dtype=np.uint32)
        for k in range(23):
            part, bit = (low, k) if k < 12 else (high, k - 12)
            part[(np.arange(len(part)) >> bit & 1) == 1] ^= unit[k]
        self.low, self.high = low, high
        self.error = np.zeros(2048, dtype=np.uint32)
        for weight in range(1, 4):
            for at in combinations(range(23), weight):
                self.error[np.bitwise_xor.reduce(unit[list(at)])] = sum(1 << k for k in at)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): the distinct codeword indices near each word."""
        near = np.concatenate([words[:, None], words[:, None] ^ (np.uint32(1) << np.arange(23, dtype=np.uint32))], axis=1)
        found = np.sort(self.index(near), axis=1)
        fresh = np.ones(found.shape, dtype=bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(fresh)[0], found[fresh]


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the three ways to have an intact segment beside one with up to two errors."""
    a = (fps & np.uint64((1 << 23) - 1)).astype(np.uint32)
    b = (fps >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.uint32)
    c = (fps >> np.uint64(46)).astype(np.uint32)
    rows, keys = [], []
    for way, (intact, other) in enumerate(((a, b), (b, a), (c, a))):
        row, index = golay.keys(other)
        rows.append(row)
        keys.append((np.int64(way) << 36) | (intact[row].astype(np.int64) << 12) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def byte_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) with two of the eight bytes left out; the key's free bits name the pair."""
    keys = []
    for n, (i, j) in enumerate(combinations(range(8), 2)):
        rest = fps & ~np.uint64(0xFF << 8 * i | 0xFF << 8 * j)
        # the pair is mixed in so that keys of different pairs seldom meet; where they do, verification decides
        keys.append((rest ^ np.uint64(n << 8 * i)) * np.uint64(0x9E3779B97F4A7C15))
    return np.tile(np.arange(len(fps)), 28), np.concatenate(keys).view(np.int64)


def forest(fps: np.ndarray, bucket: np.ndarray, near: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (member, first of its part) from the verified pairs of rows that ``near`` yields."""
    pairs = list(near(fps, bucket))
    label = np.arange(len(fps))
    if not pairs:
        return label[:0], label[:0]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        old = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == old).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def neighbours_in_order(fps: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows of a bucket, for rows sorted by bucket; work is a bucket's size squared."""
    left, step = np.arange(len(fps)), 1
    while True:
        left = left[left + step < len(fps)]
        left = left[bucket[left] == bucket[left + step]]
        if not len(left):
            return
        close = np.bitwise_count(fps[left] ^ fps[left + step]) <= DISTANCE
        yield left[close], left[close] + step
        step += 1


def neighbours_by_lookup(fps: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs by looking up each fingerprint's near words that differ in two bytes: linear work."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(fps)], strict=True):
        if hi - lo < 2:
            continue
        some = fps[lo:hi]
        varies = int(np.bitwise_or.reduce(some ^ some[0]))
        free = [k for k in range(64) if varies >> k & 1]
        order = np.argsort(some)
        ranked = some[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        yield lo + order[np.searchsorted(ranked, ranked[again])], lo + order[again]
        for flip in [1 << k for k in free] + [1 << k | 1 << m for k, m in combinations(free, 2)] if len(free) <= 16 else []:
            want = ranked ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = (ranked[at] == want) & (ranked < want)
            yield lo + order[hit], lo + order[at[hit]]
        if len(free) > 16:  # keys of different pairs met: these few rows pair by pair
            for i, j in neighbours_in_order(some, np.zeros(len(some), dtype=np.int64)):
                yield lo + i, lo + j


def in_buckets(keyed: DataFrame, near: Callable, most: int) -> DataFrame:
    """From (key, fp, node) to links (a, b) of nodes and, of buckets beyond ``most``, (a, null, fp)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def over_full(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[1])], ["a", "b", "fp"])

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, at, n = np.unique(rows[0], return_inverse=True, return_counts=True)
            n = n[at]
            if (n > most).any():
                yield over_full(rows[:, n > most])
            rows = rows[:, (n > 1) & (n <= most)]
            if rows.shape[1]:
                a, b = forest(rows[1].view(np.uint64), rows[0], near)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[2, a]), pa.array(rows[2, b]), pa.nulls(len(a), pa.int64())], ["a", "b", "fp"])

        held, over = np.zeros((3, 0), np.int64), None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if over is not None:  # inside a bucket that is known to be too large
                same = rows[0] == over
                if same.any():
                    yield over_full(rows[:, same])
                rows = rows[:, ~same]
                if not rows.shape[1]:
                    continue
                over = None
            held = np.concatenate([held, rows], axis=1)
            full = held[0] != held[0, -1]
            yield from whole(np.ascontiguousarray(held[:, full]))
            held = np.ascontiguousarray(held[:, ~full])
            if held.shape[1] > most:
                yield over_full(held)
                over, held = held[0, 0], held[:, :0]
        yield from whole(held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(each, "a long, b long, fp long")


def links(distinct: DataFrame, files: int | None = None) -> DataFrame:
    """From (fps array, node) to links (a, b) of nodes, which connect all that have at one place of
    their arrays fingerprints within two bits.  What is written on the way goes into ``files`` files."""

    def with_keys(make: Callable) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = make()
            for batch in batches:
                nodes = batch.column(1).to_numpy()
                many = len(batch.column(0).values) // max(1, len(nodes))
                table = batch.column(0).values.to_numpy().reshape(-1, many).view(np.uint64)
                for n in range(many):
                    for lo in range(0, len(nodes), 4096):
                        some = np.ascontiguousarray(table[lo : lo + 4096, n])
                        row, key = coder(some)
                        yield pa.RecordBatch.from_arrays([pa.array(key ^ np.int64(n << 40)), pa.array(some[row].view(np.int64)), pa.array(nodes[lo + row])], ["key", "fp", "node"])

        return each

    def by_golay() -> Callable:
        golay = Golay()
        return lambda fps: golay_keys(fps, golay)

    schema = "key long, fp long, node long"
    first = Scratch(distinct.sparkSession, "simhash-links").put(in_buckets(distinct.mapInArrow(with_keys(by_golay), schema), neighbours_in_order, BUCKET), files)
    over = first.filter("b is null").select(F.array("fp").alias("fps"), F.col("a").alias("node")).distinct()
    second = in_buckets(over.mapInArrow(with_keys(lambda: byte_keys), schema), neighbours_by_lookup, 1 << 62)
    return first.filter("b is not null").select("a", "b").unionByName(second.select("a", "b")).distinct()


def near_duplicates(df: DataFrame, size: int = SHINGLE, seed: int = SEED, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row_id, fingerprint (16 hex digits), component_id.

    Links are between fingerprints at most two bits apart; component_id is the smallest row_id that
    can be reached.  Null and empty texts have fingerprint zero and link like others; rows of a null
    id are numbered in if any other member has an id, else have a null component; an empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.put(fingerprints(df, size, seed, row_id, text))
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("_id").alias("_least")))
    roots = components(links(distinct.select(F.array("fp").alias("fps"), F.col("fp").alias("node"))), "simhash-components")
    rooted = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("_root")), "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(least, "_root").select("fp", "component_id")
    out = fps.join(classes, "fp")
    return out.select(F.col("_id").alias(row_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILAR_WORDS, SIMILARITY = 5, (4, 5)
#: what tells documents apart, rows of one id too: the id and a hash of the text
KEY = "struct<id:long,text_hash:long>"
#: shingles of more documents than COMMON come last in the order, the TOP most common in each of SHARDS ranges of
#: hashes: any order gives the same links, so this bounds what is broadcast (12 MB), not what is found
COMMON, SHARDS, TOP, SIGNATURE = 100, 1024, 1024, 512


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    return np.unique(np.concatenate([*shingle_hashes(text, SIMILAR_WORDS), np.zeros(0, np.uint64)]))


def of_hashes(members: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(members), 65_000):
        ones += np.unpackbits(members[i : i + 65_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(members), bitorder="little").view("<i8")[0])


#: min-wise hashing of the shingle sets: bands of so many hashes each, and candidates of a node
BANDS, BAND, NEAREST = 24, 5, 6
_SEEDS = np.random.default_rng(SIMILAR_WORDS).integers(0, 1 << 63, BANDS * BAND).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(members: np.ndarray) -> np.ndarray:
    """A key for each band, of the least of its hashes over the set; none of an empty set."""
    if not len(members):
        return np.zeros(0, np.int64)
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 4096):
        some = members[i : i + 4096]
        least = np.minimum(least, ((some ^ some >> np.uint64(31))[None] * _SEEDS[:, None]).min(axis=1))
    mixed = least ^ least >> np.uint64(29)
    keys = (mixed * _SEEDS[::-1]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64)


def set_number(members: np.ndarray) -> int:
    """Equal of equal sets only, but for one chance in 2^64."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From (id, body) the upper halves of the hashes that are in more than COMMON rows, sorted, and their counts;
    of each of SHARDS ranges the TOP most common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
            halves, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(halves, np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(22))
            columns = [[x.tobytes() for x in np.split(y.astype(np.uint32), cuts)] for y in (halves, n)]
            return pa.RecordBatch.from_arrays([pa.array(range(SHARDS), type=pa.int32()), *(pa.array(c, type=pa.binary()) for c in columns)], ["shard", "halves", "n"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(1):
                held.append(np.unique((shingle_set(t.as_py()) >> np.uint64(32)).astype(np.uint32)))
                size += len(held[-1])
                if size > 1 << 21:
                    yield pieces(held)
                    held, size = [], 0
        if size:
            yield pieces(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            halves, n = (np.frombuffer(b"".join(x), dtype=np.uint32) for x in zip(*held, strict=True))
            found, at = np.unique(halves, return_inverse=True)
            n = np.bincount(at, n, minlength=len(found)).astype(np.int64)
            most = np.lexsort((found, -n))[:TOP]
            most = most[n[most] > COMMON]
            return pa.RecordBatch.from_arrays([pa.array(found[most].astype(np.int64)), pa.array(n[most])], ["half", "n"])

        now, held = None, []
        for batch in batches:
            for shard, halves, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and held:
                    yield often(held)
                    held = []
                now = shard
                held.append((halves, n))
        if held:
            yield often(held)

    counted = rows.mapInArrow(count, "shard int, halves binary, n binary").repartition("shard").sortWithinPartitions("shard")
    got = counted.mapInArrow(total, "half long, n long").toArrow()
    halves, n = (got.column(k).to_numpy() for k in range(2))
    order = np.argsort(halves)
    return halves[order].astype(np.uint32), n[order]


def _marks(rows: DataFrame) -> DataFrame:
    """From (id, body) to (id, node, size, fp, bands, signature, prefix): a number of the shingle set, its size,
    SimHash fingerprint and band keys, the parity of its members by the low bits of their hashes (SIGNATURE values, or more for a larger set), and
    its first members in the order of (count if common, hash), so many that similar sets share one."""
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, n = common.value
        for batch in batches:
            found = []
            for t in batch.column(1):
                s = shingle_set(t.as_py())
                half = (s >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(halves, half), max(0, len(halves) - 1))
                often = np.where(halves[at] == half, n[at], 0) if len(halves) else np.zeros(len(s), np.int64)
                first = np.lexsort((s, often))[: len(s) - (SIMILARITY[0] * len(s) + SIMILARITY[1] - 1) // SIMILARITY[1] + 1]
                bits = max(SIGNATURE, 1 << len(s).bit_length())
                parity = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                found.append((set_number(s), len(s), of_hashes(s), band_keys(s).tobytes(), np.packbits(parity.astype(np.uint8), bitorder="little").tobytes(), s[first].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, type=k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], type=k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "node", "size", "fp", "bands", "signature", "prefix"])

    return rows.mapInArrow(each, f"id {KEY}, node long, size long, fp long, bands binary, signature binary, prefix binary")


FOLDED = [f"s{k}" for k in range(4)]


def _postings(nodes: DataFrame) -> DataFrame:
    """From (node, label, size, prefix, signature) to a row (key, node, label, place, signature folded to 256
    bits) per member of the prefix; place is what is left of the set from this member on, and the set's size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                node, label, size = (batch.column(k).slice(lo, 1024).to_numpy() for k in range(3))
                sets = [np.frombuffer(p, dtype=np.int64) for p in batch.column(3).slice(lo, 1024).to_pylist()]
                folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.int64).reshape(-1, 4), axis=0) for x in batch.column(4).slice(lo, 1024).to_pylist()])
                many = np.array([len(s) for s in sets])
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                size = np.repeat(size, many)
                columns = [np.concatenate(sets), np.repeat(node, many), np.repeat(label, many), size - nth << 32 | size, *np.repeat(folded, many, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "label", "place", *FOLDED])

    kinds = "key long, node long, label long, place long, " + ", ".join(f"{c} long" for c in FOLDED)
    return nodes.select("node", "label", "size", "prefix", "signature").mapInArrow(each, kinds).repartition("key").sortWithinPartitions("key")


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets whose first common member has these (place, *folded) can be similar: by what is left of
    them, and as they differ in no fewer members than their signatures do in bits."""
    p, q = SIMILARITY
    both = (x[0] & 0xFFFFFFFF) + (y[0] & 0xFFFFFFFF)
    differ = np.bitwise_count((x[1:] ^ y[1:]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    return ((p + q) * np.minimum(x[0] >> 32, y[0] >> 32) >= p * both) & ((p + q) * differ <= (q - p) * both)


def _nearest(nodes: DataFrame) -> DataFrame:
    """(a, b): of each node b up to NEAREST others that it meets in most bands.

    In each band a node meets the first and the one before it of those with its key, so a group of any size
    gives no more than two rows a node and band.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k, dtype=np.int64) for k in batch.column(1).to_pylist()]
            for lo in range(0, len(keys), 4096):
                some = keys[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(np.repeat(batch.column(0).slice(lo, 4096).to_numpy(), [len(k) for k in some]))], ["key", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = last = None
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
            heads = found[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            if not new[0]:  # the key goes on from the batch before
                heads[: int(np.argmax(new)) if new.any() else len(new)] = head
            before = np.append(found[0] if last is None else last, found[:-1])
            key, head, last = keys[-1], heads[-1], found[-1]
            old = ~new
            a, b = np.concatenate([heads[old], before[old]]), np.tile(found[old], 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    keyed = nodes.select("node", "bands").mapInArrow(spread, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    pairs = keyed.mapInArrow(meet, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # at most two for each band
    best = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), False), 1, NEAREST).alias("best"))
    return best.select(F.explode("best.a").alias("a"), "b")


def across_labels(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of (key, node, label, place, *folded) sorted by key: all pairs of a key that have different labels and
    may be similar."""
    edges = np.flatnonzero(np.diff(rows[0])) + 1
    starts = np.append(0, edges)
    many = np.diff(np.append(starts, rows.shape[1]))
    mixed = np.maximum.reduceat(rows[2], starts) != np.minimum.reduceat(rows[2], starts)
    small = np.flatnonzero(np.repeat(mixed & (many <= 256), many))
    left, step = np.arange(len(small)), 1
    while len(left):
        left = left[left + step < len(small)]
        left = left[rows[0, small[left]] == rows[0, small[left + step]]]
        i, j = small[left], small[left + step]
        other = rows[2, i] != rows[2, j]
        i, j = i[other], j[other]
        fits = _may(rows[3:, i], rows[3:, j])
        yield i[fits], j[fits]
        step += 1
    for k in np.flatnonzero(mixed & (many > 256)):  # all with all outside the largest label, and those with its members
        lo, some = starts[k], np.ascontiguousarray(rows[2:, starts[k] : starts[k] + many[k]])
        label = some[0]
        names, n = np.unique(label, return_counts=True)
        other = label != names[np.argmax(n)]
        for i in np.flatnonzero(other):
            fits = (label != label[i]) & _may(some[1:], some[1:, i : i + 1])
            fits[:i] &= ~other[:i]
            j = np.flatnonzero(fits)
            yield np.full(len(j), lo + i), lo + j


def _pairs(postings: DataFrame, near: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(a, b, n): pairs of nodes, a < b, that ``near`` yields for n keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            order = np.lexsort(both)
            both = both[:, order]
            starts = np.flatnonzero(np.append(True, (np.diff(both, axis=1) != 0).any(axis=0))) if both.shape[1] else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0, starts]), pa.array(both[1, starts]), pa.array(np.diff(np.append(starts, both.shape[1])))], ["a", "b", "n"])

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not rows.shape[1]:
                return
            found, size = [], 0
            for i, j in near(rows):
                if len(i):
                    found.append(np.sort(np.stack([rows[1, i], rows[1, j]]), axis=0))
                    size += len(i)
                if size > 1 << 20:
                    yield told(found)
                    found, size = [], 0
            yield told(found)

        held = []
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if not rows.shape[1]:
                continue
            last = np.searchsorted(rows[0], rows[0, -1])
            if last:  # what is held, and all but the batch's last key, is whole
                yield from whole(np.concatenate([*held, rows[:, :last]], axis=1))
                held = [rows[:, last:]]
            elif held and held[-1][0, -1] != rows[0, 0]:
                yield from whole(np.concatenate(held, axis=1))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield from whole(np.concatenate(held, axis=1))

    return postings.mapInArrow(each, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _near_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets differ in no fewer members than their signatures do in bits; a longer one is folded first."""
    p, q = SIMILARITY
    for batch in batches:
        keep = []
        for n, m, *both in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            (short, x), (long, y) = sorted((8 * len(z), int.from_bytes(z, "little")) for z in both)
            while long > short:
                long //= 2
                y = (y & (1 << long) - 1) ^ y >> long
            keep.append((p + q) * (x ^ y).bit_count() <= (q - p) * (n + m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(SIMILARITY[1] * both >= SIMILARITY[0] * (len(x) + len(y) - both))
        kept = batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))
        yield kept


def _sets(df: DataFrame) -> DataFrame:
    """From (id, body) to (node, sorted distinct hashes of the five-word shingles)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py()) for t in batch.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())], ["node", "shingles"])

    return df.mapInArrow(each, "node long, shingles binary")


def similar_documents(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, text_hash, component_id) of the documents that are in a group but are not its smallest.

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of
    them.  Equal sets are one node.  Candidates come first from keys of SimHash fingerprints and of min-wise
    hashes, in numbers that grow with the nodes however large a group is, and those that hold join most of
    every group.  Then, as two similar sets sorted by one order share a member among their first fifths, all
    pairs that share such a key but are in different groups so far are met: none is missed.  Only the sets
    themselves decide.  The id is a whole number; rows with a null id are in
    no group; rows of one id with other texts, so with another xxhash64 ``text_hash``, are other documents,
    and those equal in both are one; component_id is the smallest id of the group.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(F.col(row_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash")).alias("id"), F.col(text).alias("body")).filter("id.id is not null")
    wide = Scratch(spark, "similar")
    marked = wide.put(_marks(rows))
    members = Scratch(spark, "similar-members").put(marked.select("id", "node"))
    files = narrow_files(spark, members.count())
    heads = Scratch(spark, "similar-heads").put(members.groupBy("node").agg(F.min("id").alias("id")), files)
    once = Scratch(spark, "similar-nodes")
    nodes = once.put(marked.join(heads, ["id", "node"], "left_semi").dropDuplicates(["node"]).drop("id"))
    wide.drop(1)  # the largest table: only ids and numbers of its rows are read again

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        ends = [nodes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "ab"]
        both = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "sa", "sb")
        near = Scratch(spark, f"similar-{tag}").put(both.mapInArrow(_near_signatures, "a long, b long"), files)
        wanted = heads.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        found = _sets(rows.join(wanted, "id", "left_semi").select("id", "body")).join(wanted, "node", "left_semi")
        scratch = Scratch(spark, f"similar-{tag}-sets")
        sets = scratch.put(found.dropDuplicates(["node"]))
        held = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        close = Scratch(spark, f"similar-{tag}-links").put(held.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), files)
        scratch.drop(1)
        return close

    near = links(nodes.select(F.array("fp").alias("fps"), "node"), files).unionByName(_nearest(nodes))
    first = verified(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    labels = components(first, "similar-labels", files).select(F.col("a").alias("node"), F.col("b").alias("label"))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = verified(_pairs(_postings(labelled), across_labels), "rest")
    once.drop(1)
    roots = components(first.unionByName(rest), "similar-components", files).select(F.col("a").alias("node"), F.col("b").alias("root"))
    grouped = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    grouped = members.join(grouped.select("node", "root"), "node").join(least, "root")
    gone = grouped.filter("id <> component_id")
    kind = df.schema[row_id].dataType
    return gone.select(F.col("id.id").cast(kind).alias(row_id), "id.text_hash", F.col("component_id.id").cast(kind).alias("component_id")).distinct()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
