"""Periodic runs of words: masking by repeated k-grams, then Main-Lorentz on what is left.

A run is a stretch of words with smallest period q, of at least ``least`` words and ``exponent`` periods, that no
neighbouring word extends.  It equals itself q words on over at least ``overlap`` words, whatever q is, so each of
its words lies in a k-gram of that length which the document holds again.  Words outside such k-grams cannot join
a run; the maximal stretches of the others are the segments that are searched.

A segment is halved again and again.  A run across a middle has at least half of its words on one side of it, so
for every period the words beside the middle are compared with those a period further; what agrees is extended
both ways word by word.  All middles of a level, in all segments of a group of documents, are tried at once: hashes
of word sequences say which periods cannot be, and the extension decides exactly.

Documents are independent, so nothing is shuffled, and a row's work is n log n in its words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import WORD, table

LEAST, EXPONENT = 6, 4
#: words of documents that are searched together
GROUP = 200_000
RUNS = "array<struct<start:long,length:long,period:long>>"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
Run = tuple[int, int, int]


def overlap(least: int, exponent: int) -> int:
    """The least number of words by which any run agrees with itself one period on."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _spread(x: np.ndarray) -> np.ndarray:
    """Numbers as hashes of 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Sums over prefixes from which sequences of one length are compared wherever they stand."""

    def __init__(self, words: np.ndarray):
        self.powers = _powers(_BASE, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(_spread(words) * self.powers[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, by: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from ``at`` may equal those ``by`` words on; never false for equal ones."""
        return (self.sums[at + n] - self.sums[at]) * self.powers[by] == self.sums[at + by + n] - self.sums[at + by]

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each place."""
        return (self.sums[k:] - self.sums[:-k]) * _powers(_INVERSE, len(self.sums) - k)


def segments(words: np.ndarray, bounds: np.ndarray, hashes: _Hashes, k: int) -> np.ndarray:
    """(first, end) of the maximal stretches of words in k-grams that their document holds twice or more."""
    if len(words) < k:
        return np.zeros((0, 2), dtype=np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
    _, which, many = np.unique(hashes.grams(k)[inside] + _spread(doc[inside]), return_inverse=True, return_counts=True)
    again = inside[many[which] > 1]
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + k, -1)
    held = np.cumsum(depth[:-1]) > 0
    first = held.copy()
    first[1:] &= ~held[:-1] | (doc[1:] != doc[:-1])
    last = held.copy()
    last[:-1] &= ~held[1:] | (doc[1:] != doc[:-1])
    return np.stack([np.flatnonzero(first), np.flatnonzero(last) + 1], axis=1)


def _reach(words: np.ndarray, at: int, by: int, step: int, end: int) -> int:
    """How many words from ``at`` on, or back with a step of -1, equal those ``by`` on, before ``end``."""
    found, width = 0, 32
    while (left := (end - at) * step - found) > 0:
        n = min(width, left)
        i = at + found if step > 0 else at - found - n + 1
        differ = np.flatnonzero(words[i : i + n] != words[i + by : i + by + n])
        if len(differ):
            return found + (int(differ[0]) if step > 0 else n - 1 - int(differ[-1]))
        found, width = found + n, width * 2
    return found


class _Found:
    """Runs by period; the same run is met from many middles, and under multiples of its period."""

    def __init__(self, words: np.ndarray):
        self.words, self.runs = words, {}

    def around(self, at: int, p: int, lo: int, hi: int) -> tuple[int, int]:
        """(start, end) of the stretch of period p that words ``at`` and ``at + p`` lie in, within lo and hi."""
        known = self.runs.setdefault(p, [])
        k = bisect_right(known, (at, len(self.words) + 1)) - 1
        if k >= 0 and known[k][1] >= at + p + 1:
            return known[k]
        run = (at + 1 - _reach(self.words, at, p, -1, lo - 1), at + p + _reach(self.words, at, p, 1, hi - p))
        known.insert(k + 1, run)
        return run


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of all runs of documents that lie between bounds, by start, then period."""
    hashes, found = _Hashes(words), _Found(words)
    best: dict[tuple[int, int], int] = {}
    nodes = segments(words, bounds, hashes, overlap(least, exponent))
    nodes = np.concatenate([nodes, nodes], axis=1)  # a part, and the segment that it is of
    while len(nodes := nodes[nodes[:, 1] - nodes[:, 0] >= least]):
        middle, done = (nodes[:, 0] + nodes[:, 1]) // 2, np.zeros(len(nodes), dtype=bool)
        for side in (1, -1):
            room = nodes[:, 1] - middle if side > 0 else middle - nodes[:, 0]
            many = np.where(2 * room >= least, 2 * room // exponent, 0)
            node = np.repeat(np.arange(len(nodes)), many)
            p = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + 1
            half = (np.maximum(least, exponent * p) + 1) // 2  # of a run's words, those that lie on this side at least
            at = middle[node] if side > 0 else middle[node] - half
            hit = np.flatnonzero(hashes.same(at, p, half - p))
            node, p, at, half = node[hit], p[hit], at[hit], half[hit]
            firsts = np.flatnonzero(np.diff(node, prepend=-1))
            for a, b in pairwise([*firsts.tolist(), len(node)]):
                mine, start, end = p[a:b], at[a:b], at[a:b] + half[a:b]
                lo, hi = (int(x) for x in nodes[node[a], 2:])
                left = np.ones(b - a, dtype=bool)
                while left.any():
                    k = int(np.argmax(left))
                    q = int(mine[k])
                    left[k] = False
                    if words[start[k]] != words[start[k] + q]:
                        continue
                    s, e = found.around(int(start[k]), q, lo, hi)
                    if e - s >= max(least, exponent * q):
                        best[s, e] = min(q, best.get((s, e), q))
                        # any run within would share a period and its own with this one, and so be this one
                        done[node[a]] |= exponent * q <= (exponent - 1) * least and s <= nodes[node[a], 0] and e >= nodes[node[a], 1]
                    left &= (mine % q != 0) | (start < s) | (end > e)  # multiples within say the same stretch
        nodes, middle = nodes[~done], middle[~done]
        nodes = np.concatenate([np.stack([nodes[:, 0], middle, nodes[:, 2], nodes[:, 3]], axis=1), np.stack([middle, nodes[:, 1], nodes[:, 2], nodes[:, 3]], axis=1)])
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def _searched(texts: list[str | None], least: int, exponent: int) -> Iterator[tuple[int, list[Run], bytes]]:
    """(words, runs, words that are not repeats joined by one space) of each text."""
    split = [(t or "").encode().split() for t in texts]
    known: dict[bytes, int] = {}
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)])
    words = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), dtype=np.int64, count=int(bounds[-1]))
    runs = runs_of(words, bounds, least, exponent)
    n = 0
    for ws, lo, hi in zip(split, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = []
        while n < len(runs) and runs[n][0] < hi:
            mine.append((runs[n][0] - lo, *runs[n][1:]))
            n += 1
        if mine:
            depth = np.zeros(hi - lo + 1, dtype=np.int64)
            for start, length, period in mine:
                depth[start + period] += 1
                depth[start + length] -= 1
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        yield hi - lo, mine, b" ".join(ws)


def periodic_runs(df: DataFrame, row_id: str = "doc_id", text: str | Column = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per input row: ``row_id``, ``n_words``, ``runs`` by start, then period, and ``collapsed``, the text with
    each run cut to its first period.

    Words are separated by ASCII white space and kept as they are.  ``exponent`` is at least 3.  A null or empty text
    has no words, no runs and an empty ``collapsed``; rows of one id, or of none, and repeated rows each give their
    own row; an empty table gives none; other columns are not read, whatever their names.
    """
    if exponent < 3 or least < 2:
        raise ValueError("a run has three periods and two words at least")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= 5 * GROUP):
                    size, hi = size + len(texts[hi] or ""), hi + 1
                n, runs, left = zip(*_searched(texts[lo:hi], least, exponent), strict=True)
                flat = np.array([r for mine in runs for r in mine], dtype=np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(mine) for mine in runs])]), type=pa.int32())
                inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n, type=pa.int64()), pa.ListArray.from_arrays(offsets, inner), pa.array([x.decode() for x in left], type=pa.string())], ["_id", "n_words", "runs", "collapsed"])
                lo = hi

    rows = df.select(F.col(row_id).alias("_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("_t"))
    return rows.mapInArrow(each, f"_id {rows.schema[0].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("_id", row_id)


# ---------------------------------------------------------------- the query


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def planted(row_id: Column, text: Column) -> Column:
    """The text whose words the query numbers: one in ten, by the id's checksum, is made periodic from some word on."""
    h = F.crc32(row_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    made = _bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) > 0, periodic(w)))
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, text=planted(F.col("doc_id"), F.col("text")))
    kind = "struct<start:long,length:long,period:long>"
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(kind), greater)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodicity": op11_periodicity}

#: two 5-grams that are equal q words apart begin stretches that agree with themselves q words on
ORACLES = {
    "op11_periodicity": r"""
WITH steps AS (
  WITH RECURSIVE c(i, k, v) AS (
   SELECT r::BIGINT, 0, r::BIGINT FROM range(256) g(r)
   UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8)
  SELECT list(v ORDER BY i) AS crc_table FROM c WHERE k = 8),
 numbered AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
   regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..') AS x FROM documents),
 hashed AS (SELECT d, doc_id, w, len(w)::BIGINT AS n,
   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(a >> 8, crc_table[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS h FROM numbered, steps),
 placed AS (SELECT d, doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts FROM hashed),
 docs AS (SELECT d, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1]) END AS w FROM placed),
 grams AS (SELECT d, i, n, array_to_string(w[i + 1 : i + 5], ' ') AS gram FROM docs, unnest(range(n - 4)) u(i)),
 pairs AS (SELECT a.d, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.d = b.d AND a.gram = b.gram AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n),
 islands AS (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM pairs),
 stretches AS (SELECT d, q, min(i) AS s, count(*) + 4 + q AS l FROM islands GROUP BY d, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
 runs AS (SELECT d, s, l, min(q) AS q FROM stretches GROUP BY d, s, l),
 told AS (SELECT d, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY d),
 firsts AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.d = r.d AND (o.l * r.q > r.l * o.q OR o.l * r.q = r.l * o.q AND (o.s, o.q) < (r.s, r.q)))),
 gone AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
 left_over AS (SELECT p.d, string_agg(p.word, ' ' ORDER BY p.i) AS t FROM (SELECT d, unnest(w) AS word, unnest(range(n)) AS i FROM docs) p ANTI JOIN gone g ON p.d = g.d AND p.i = g.i GROUP BY p.d)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, f.s::BIGINT AS start, f.l::BIGINT AS length, f.q::BIGINT AS period, (1000 * f.l // f.q)::BIGINT AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (d) LEFT JOIN firsts f USING (d) LEFT JOIN left_over USING (d)
"""
}
