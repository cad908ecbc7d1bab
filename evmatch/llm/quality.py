"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words, however many.  A passage is encoded by its words and
its character trigrams, both hashed into buckets, by the shares of its kinds of bytes, its word lengths
and its repetitions; a learned embedding maps that to a representation h.  Gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the weighted representation gives the
document's score.  All weights are learned from document labels.

Fitting uses at most ``SAMPLE`` labelled rows, chosen by hash, each with all its passages; a row that would bring
the passages of the rows before it beyond ``MOST`` is left out.  Only passages' numbers reach the driver, row by row.
Scoring uses every passage, in one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import one_of_each, seeded, table

#: words of a passage; passages that are scored at once
WORDS, PASSAGES = 64, 16_384
#: labelled rows that fitting uses at most, and passages of all of them
SAMPLE, MOST, SEED = 6000, 262_144, 5
HIDDEN, GATES, STEPS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4
KINDS, BUCKETS = 14, 128  # kinds of bytes; buckets of words, and of trigrams


def _kinds() -> np.ndarray:
    """Byte classes: white space, lower, upper, digit, continuation and lead bytes, and single marks."""
    kind = np.full(256, 13, dtype=np.int64)
    kind[[32, 9, 11, 12, 13]] = 0
    kind[10] = 1
    kind[97:123], kind[65:91], kind[48:58] = 2, 3, 4
    kind[128:192], kind[192:] = 5, 6
    for n, marks in enumerate((b".", b",", b"!?", b"|", b"*#$%&@", b"-_/\\:=")):
        kind[list(marks)] = 7 + n
    return kind


_KIND = _kinds()
_MIX = np.random.default_rng(SEED).integers(1, 1 << 62, 256).astype(np.uint64)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
DIMS = KINDS + 7 + 2 * BUCKETS


def encode(text: str | None) -> np.ndarray:
    """(passages, DIMS); a text without words is one passage of zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = (_KIND[data] <= 1).view(np.int8)
    starts = np.flatnonzero(np.diff(space, prepend=np.int8(1)) == -1)
    if not len(starts):
        return np.zeros((1, DIMS), dtype=np.float32)
    first = starts[::WORDS]
    sizes = np.diff([*first, len(data)])
    body = data[first[0] :]
    of = np.repeat(np.arange(len(first)), sizes)
    counts = np.bincount(of * KINDS + _KIND[body], minlength=len(first) * KINDS).reshape(-1, KINDS)
    # words: lengths, and hashes that see letters and their places
    ends = np.flatnonzero(np.diff(space, append=np.int8(1)) == 1)
    lengths = ends - starts + 1
    place = (np.arange(len(data), dtype=np.uint64) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]]))).astype(np.uint64)) * np.uint64(2) + np.uint64(1)
    hashes = np.add.reduceat(np.where(space == 0, _MIX[data] * place, np.uint64(0)), starts)
    bag = np.arange(len(starts)) // WORDS
    many = np.bincount(bag)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (bag[1:] == bag[:-1]))
    order = np.lexsort((hashes, bag))
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (bag[order][1:] != bag[order][:-1]))
    mean = np.bincount(bag, lengths) / many
    spread = np.sqrt(np.maximum(0, np.bincount(bag, lengths.astype(float) ** 2) / many - mean**2))
    kinds = np.bincount(bag * BUCKETS + (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64), minlength=len(many) * BUCKETS).reshape(-1, BUCKETS) / many[:, None]
    low = _LOWER[body]
    grams = low * np.uint32(0x9E3779B1)
    grams[:-1] += low[1:] * np.uint32(0x85EBCA6B)
    grams[:-2] += low[2:] * np.uint32(0xC2B2AE35)
    over = np.cumsum(sizes[:-1])  # a passage's last trigrams do not see the next one, as a text's last see nothing
    grams[over - 1] -= low[over] * np.uint32(0x85EBCA6B)
    two = over[over + 1 < len(low)]
    grams[over - 2] -= low[over] * np.uint32(0xC2B2AE35)
    grams[two - 1] -= low[two + 1] * np.uint32(0xC2B2AE35)
    grams = np.bincount(of * BUCKETS + (grams * np.uint32(0x27D4EB2F) >> np.uint32(25)), minlength=len(first) * BUCKETS).reshape(-1, BUCKETS) / sizes[:, None]
    extra = [np.bincount(bag, again) / many, np.bincount(bag[order], fresh) / many, np.log1p(mean), np.log1p(spread), np.log1p(many) / 4, np.bincount(bag, lengths > 20) / many, np.bincount(bag, lengths < 3) / many]
    return np.concatenate([np.sqrt(counts / sizes[:, None]), np.stack(extra, axis=1), np.sqrt(kinds), np.sqrt(grams)], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedAttention:
    """The network; bags are rows of one matrix with ``starts`` of each."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shapes = {"E": (dims, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "b": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "EVUwc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(dims, dtype=np.float32), np.ones(dims, dtype=np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags, and what their gradients need."""
        return self._scaled((x - self.mean) / self.scale, starts)

    def _scaled(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * g) @ p["w"]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        top = np.exp(raw - np.maximum.reduceat(raw, starts)[of])
        a = top / np.add.reduceat(top, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["b"]), (x, h, t, g, a, of, z)

    def long(self, x: np.ndarray) -> float:
        """The score of one bag, a slice of PASSAGES at a time."""
        p, top, weight, z = self.p, -np.inf, 0.0, np.zeros(HIDDEN)
        for lo in range(0, len(x), PASSAGES):
            h = np.tanh((x[lo : lo + PASSAGES] - self.mean) / self.scale @ p["E"] + p["e"])
            raw = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            now = max(top, raw.max())
            a, fade = np.exp(raw - now), np.exp(top - now)
            top, weight, z = now, weight * fade + a.sum(), z * fade + a @ h
        return float(_sigmoid(z / weight @ p["c"] + p["b"])[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        out, bags, size = [], [], 0

        def flush() -> None:
            if bags:
                out.append(self.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))[0])
                bags.clear()

        for t in texts:
            x = encode(t.as_py())
            if size + len(x) > PASSAGES:
                flush()
                size = 0
            if len(x) > PASSAGES:
                out.append(np.array([self.long(x)]))
            else:
                bags.append(x)
                size += len(x)
        flush()
        return np.concatenate(out)

    def gradient(self, y: np.ndarray, score: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Of the mean log loss, by parameter."""
        p, (xs, h, t, g, a, of, z) = self.p, kept
        starts = np.flatnonzero(np.append(True, np.diff(of) != 0))
        d = ((score - y) / len(y)).astype(h.dtype)
        dz = d[:, None] * p["c"]
        per = (dz[of] * h).sum(axis=1)
        draw = a * (per - np.add.reduceat(a * per, starts)[of])
        dt, dg = draw[:, None] * p["w"] * g, draw[:, None] * p["w"] * t
        dv, du = dt * (1 - t * t), dg * g * (1 - g)
        dh = a[:, None] * dz[of] + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - h * h)
        return {"E": xs.T @ de, "e": de.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ draw, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> GatedAttention:
        """Full-batch Adam on the log loss; ``x`` is overwritten."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + x.dtype.type(1e-2)
        x -= self.mean
        x /= self.scale
        xs, p = x, self.p
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            grad = self.gradient(y, *self._scaled(xs, starts))
            for k in p:
                q = grad[k] + DECAY * p[k] * (k != "b")
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
        return self


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, y, t in zip(*(batch.column(k) for k in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], type=pa.string()), pa.array([y.as_py()], type=pa.int32()), pa.array([encode(t.as_py()).astype(np.float16).tobytes()])], ["k", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, most: int = MOST) -> GatedAttention | None:
    """From labels 0 and 1 by row_id; other labels are ignored, of several for an id the least counts, and of
    several rows of an id one.

    ``sample`` bounds the labelled rows that are used, and ``most`` those whose passages would be more in all.
    Without any label of one kind there is no model.
    """
    known = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = known.orderBy(seeded(SEED, "_id"), "_id").limit(sample)
    rows = one_of_each(docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id"))  # sample ids at most
    encoded = rows.select(F.concat(seeded(SEED, "_id"), F.lit(":"), F.col("_id").cast("string")).alias("k"), "_y", "_t").mapInArrow(_flat, "k string, y int, x binary")
    got, left = [], most
    for r in encoded.orderBy("k").toLocalIterator():  # sample rows at most; the order of rows must not matter
        bag = np.frombuffer(r["x"], dtype=np.float16).reshape(-1, DIMS)
        if len(bag) <= left:
            got.append((r["y"], bag))
            left -= len(bag)
    if len({y for y, _ in got}) < 2:
        return None
    starts = np.cumsum([0, *(len(bag) for _, bag in got[:-1])])
    y, x = np.array([y for y, _ in got]), np.concatenate([bag for _, bag in got])
    got.clear()
    return GatedAttention().fit(x.astype(np.float32), starts, y)


def score(docs: DataFrame, model: GatedAttention | None, row_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, score): 0 to 1, 0.5 everywhere without a model.  Null and empty texts have a score too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                found = model.scores(some.column(0)).astype(np.float64) if model else np.full(some.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*some.columns[skip:], pa.array(found)], [*some.schema.names[skip:], "score"])

    skip = int(text not in keep)  # a kept text travels once
    rest = [c for c in (row_id, *keep) if c != text]
    kept = docs.select(F.col(text), *rest)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[skip:])
    return kept.mapInArrow(each, f"{kinds}, score double")


def held_out(row_id: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string").cast("binary")) % parts == rest, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out("doc_id", 3, 1)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
