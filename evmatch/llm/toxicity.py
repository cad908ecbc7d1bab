"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all texts.  Every span that the channel can have written
becomes a lattice: words with a look-alike or a repeated letter, and three or more single letters with
gaps between them.  Each run of characters can have come from a letter, a repeated letter, a look-alike
or, for a gap, from nothing.  Viterbi takes the source that the character model and the channel together
find likeliest, whatever the span's length, and it replaces the span; all other text has but one source,
itself.  The restored text is scored by a logistic model of its words and word beginnings, learned from
labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch, one_of_each, seeded, table
from evmatch.llm.quality import held_out

SAMPLE, SEED = 3000, 6  # labelled rows of each kind that fitting uses at most
LEAST_Z, LEAST_DOCS = 4.5, 2
STEPS, DECAY = 300, 1e-3
CUT_LETTERS = (4, 5, 6, 7, 8)

# ---------------------------------------------------------------- characters

#: fixed values: what a look-alike may stand for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SYMBOLS = 28  # a boundary, a to z, any other letter


@lru_cache(4096)
def _symbol(c: str) -> int:
    import unicodedata

    base = unicodedata.normalize("NFKD", c.lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 27 if c.isalpha() else 0


_TABLE = np.array([_symbol(chr(c)) for c in range(0x3000)], dtype=np.int64)


def symbols(text: str) -> np.ndarray:
    """Symbol of each code point; beyond U+2FFF everything is another letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 0x3000, _TABLE[np.minimum(points, 0x2FFF)], 27)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts, padded by boundaries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                s = np.concatenate([[0, 0], symbols(t.as_py() or ""), [0]])
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    out = np.zeros(SYMBOLS**3)
    for row in docs.select(F.col(text)).mapInArrow(each, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # SYMBOLS**3 rows at most
        out[row["g"]] = row["n"]
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and unigram estimates; [a, b, c]."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1
    p1 = uni / uni.sum()
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    return np.log((tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20))


# ---------------------------------------------------------------- channel

LETTER = r"[^\W\d_]"
LOOK = "".join(re.escape(c) for c in LOOKALIKES)
GAP = " .\\-_*~"
#: a run of letters and look-alikes with one of these at least; what of it is a word, ``_core`` says
MARKED = re.compile(rf"(?<!{LETTER}){LETTER}*+[{LOOK}](?:[{LOOK}]|{LETTER})*+")
#: a word with a letter twice in a row or more
DOUBLED = re.compile(rf"(?<!{LETTER}){LETTER}*?({LETTER})(?i:\1){LETTER}*")
#: single letters or look-alikes with gaps of up to GAPS characters between them
GAPS = 4
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[@$!])(?:[{GAP}]{{1,{GAPS}}}(?:[^\W_]|[@$!])){{2,}}(?![^\W_])")
#: marks that end a word as punctuation, unless letters follow
ENDS = "!|+(¡"
#: log costs of the channel's ways to write: a letter as it is, and any repeat but the first
SAME, EXTRA = 0.0, -0.3
#: habits of a writer, which hold for a whole span: the cost to have it, and those with and without it of a
#: doubled letter that means one; of a gap that means nothing, and a gap; of a look-alike, and a mark that means itself
HABITS = {"doubling": (-10.0, (-0.3,), (-9.0,)), "spelling": (-10.0, (-0.2, -3.0), (-9.0, 0.0)), "leetspeak": (-3.0, (-0.5, -9.0), (-1.5, -4.6))}


@lru_cache(16)
def habit(*has: str) -> tuple[float, ...]:
    """Costs: to have these habits, of a doubled letter, a dropped gap, a kept gap, a look-alike, a kept mark."""
    return (sum(HABITS[h][0] for h in has), *(cost for h, (_, own, other) in HABITS.items() for cost in (own if h in has else other)))


def ways(c: str, n: int, costs: tuple[float, ...]) -> list[tuple[str, float]]:
    """Sources of a run of n equal characters, in lower case, with their log costs."""
    _, double, dropped, kept, looks, mark = costs
    once = (double if n == 2 else 0.0) + EXTRA * (n - 1)
    if c.isalpha():
        return [(c, SAME + once), (c * 2, SAME + EXTRA * (n - 2))] if n > 1 else [(c, SAME)]
    found = []
    for letter in LOOKALIKES.get(c, ""):
        found.append((letter, looks + once))
        if n > 1:
            found.append((letter * 2, looks + EXTRA * (n - 2)))
    if c == " ":
        return [("", dropped), (" ", kept)]
    return [*found, (c * n, mark * (1 + (n > 1)))]


def runs_of(span: str) -> list[tuple[str, int]]:
    """Runs of equal characters in lower case; gap characters side by side are one run of spaces."""
    found: list[tuple[str, int]] = []
    for c in span.lower():
        c = " " if c in " .-_*~" else c
        if found and found[-1][0] == c:
            found[-1] = (c, found[-1][1] + 1)
        else:
            found.append((c, 1))
    return found


def decode(runs: list[tuple[str, int]], costs: tuple[float, ...], log_p: np.ndarray) -> tuple[float, str]:
    """Score and text of the likeliest source.  States are the last two symbols, so runs of any number are
    decoded as a whole."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (costs[0], None)}  # score, and what was said, last first
    for c, n in runs:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for out, cost in ways(c, n, costs):
            said = [_symbol(ch) for ch in out]
            for (a, b), (score, path) in states.items():
                x, y, total = a, b, score + cost
                for s in said:
                    total += log_p[x, y, s]
                    x, y = y, s
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, (path, out))
        states = after
    best, end = max((score + log_p[a, b, 0], (a, b)) for (a, b), (score, _) in states.items())
    path, parts = states[end][1], []
    while path:
        path, out = path
        parts.append(out)
    return best, "".join(reversed(parts))


def restore(span: str, log_p: np.ndarray) -> str:
    """The likeliest source of a span under any habit, letters in lower case; the span itself if that is
    what it says already."""
    runs = runs_of(span)
    can = {"doubling": any(n == 2 and c != " " for c, n in runs), "spelling": any(c == " " for c, _ in runs), "leetspeak": sum(n for c, n in runs if c in LOOKALIKES) > 1}
    some = [h for h, possible in can.items() if possible]
    sets = [has for k in range(len(some) + 1) for has in combinations(some, k)]  # fewer habits first, of equals
    found = max(((*decode(runs, habit(*has), log_p), -k) for k, has in enumerate(sets)), key=lambda x: (x[0], x[2]))[1]
    same = "".join(" " if c == " " else c * n for c, n in runs)
    return span if found == same else found


def _core(token: str) -> tuple[int, int]:
    """The part of a marked run that can be a word: without three or more marks at an end, or punctuation
    behind it; empty without a letter."""
    lo, hi = 0, len(token)
    while lo < hi and not token[lo].isalpha():
        lo += 1
    lo = 0 if lo <= 2 else lo
    end = hi
    while end > lo and not token[end - 1].isalpha():
        end -= 1
    hi = end if hi - end > 2 else hi
    while hi > end and token[hi - 1] in ENDS:
        hi -= 1
    return (lo, hi) if end > lo and any(c.isalpha() for c in token[lo:hi]) else (0, 0)


class Restorer:
    """Restores whole texts; sources of spans seen before are remembered, up to a bound."""

    def __init__(self, log_p: np.ndarray, most: int = 100_000):
        self.log_p, self.most, self.seen = log_p, most, {}

    def _source(self, span: str) -> str:
        found = self.seen.get(span)
        if found is None:
            found = restore(span, self.log_p)
            if len(self.seen) >= self.most:
                self.seen.clear()
            if len(span) <= 256:
                self.seen[span] = found
        return found

    def _marked(self, m: re.Match) -> str:
        token = m[0]
        lo, hi = _core(token)
        core = token[lo:hi]
        if not core or core.isalpha():
            return token
        return token[:lo] + self._source(core) + token[hi:]

    def __call__(self, text: str | None) -> str:
        text = text or ""
        text = SPACED.sub(lambda m: self._source(m[0]), text)
        text = MARKED.sub(self._marked, text)
        return DOUBLED.sub(lambda m: self._source(m[0]), text)


# ---------------------------------------------------------------- scoring

WORDS = re.compile(rf"{LETTER}+")


def features(restored: str) -> set[str]:
    """Words in lower case, and the first letters of longer ones."""
    words = set(WORDS.findall(restored.lower()))
    return words | {f"{w[:n]}*" for w in words for n in CUT_LETTERS if len(w) > n}


class Model:
    """Weights of features; a document's score is the logistic of their sum and the bias."""

    def __init__(self, log_p: np.ndarray, weights: dict[str, float], bias: float):
        self.log_p, self.weights, self.bias = log_p, weights, bias
        self.words = {w for w in weights if not w.endswith("*")}
        self.heads = {w[:-1]: v for w, v in weights.items() if w.endswith("*")}
        self.starts = {h[: CUT_LETTERS[0]] for h in self.heads}

    def score(self, restored: str) -> float:
        words = set(WORDS.findall(restored.lower()))
        n = CUT_LETTERS[0]
        cut = {w[:k] for w in words if w[:n] in self.starts for k in CUT_LETTERS if len(w) > k}
        total = self.bias + sum(self.weights[w] for w in sorted(words & self.words)) + sum(self.heads[h] for h in sorted(cut & self.heads.keys()))
        return float(0.5 * (1 + np.tanh(0.5 * total)))


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """From labels 0 and 1 by row_id; other labels are ignored, of several for an id the least counts, and of
    several rows of an id one; a label without a row teaches nothing.

    ``sample`` bounds the labelled rows of each kind.  The character model is counted over all texts.
    Features are kept whose share of toxic documents is above the others' by LEAST_Z deviations.
    """
    log_p = log_probabilities(count_trigrams(docs, text))
    known = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = None
    for kind in (0, 1):
        part = known.filter(F.col("_y") == kind).orderBy(seeded(SEED, "_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = one_of_each(docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id"))  # 2 * sample ids at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(log_p)
        for batch in batches:
            for i, y, t in zip(*batch.columns, strict=True):
                found = ["", *sorted(features(restorer(t.as_py())))]
                yield pa.RecordBatch.from_arrays([pa.array([str(i.as_py())] * len(found)), pa.array([y.as_py()] * len(found), type=pa.int32()), pa.array(found, type=pa.string())], ["doc", "y", "feature"])

    seen = Scratch(docs.sparkSession, "toxicity").put(rows.select("_id", "_y", "_t").mapInArrow(each, "doc string, y int, feature string"))
    sizes = {r["y"]: r["count"] for r in seen.filter("feature = ''").groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(log_p, {}, 0.0 if not n0 and not n1 else 4.0 if n1 else -4.0)
    counts = seen.filter("feature <> ''").groupBy("feature").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c")).withColumn("c0", F.col("c") - F.col("c1"))
    share = F.col("c") / (n0 + n1)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    best = Scratch(docs.sparkSession, "toxicity-features").put(counts.filter(F.col("c1") >= LEAST_DOCS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).select("feature"))
    names = [r["feature"] for r in best.toLocalIterator()]  # of sample documents, and far from chance
    at = {f: k for k, f in enumerate(sorted(names))}
    bags = seen.join(best.withColumn("hit", F.lit(True)), "feature", "left").groupBy("doc", "y").agg(F.collect_set(F.when(F.col("hit"), F.col("feature"))).alias("f")).toPandas()
    bags = bags.sort_values(["doc", "y"], ignore_index=True)
    y = bags["y"].to_numpy(dtype=float)
    row = np.repeat(np.arange(len(bags)), [len(f) for f in bags["f"]])
    col = np.array([at[f] for fs in bags["f"] for f in sorted(fs)], dtype=np.int64)
    weights, bias = _logistic(row, col, len(at), y)
    return Model(log_p, {f: float(weights[k]) for f, k in at.items()}, bias)


def _logistic(row: np.ndarray, col: np.ndarray, n: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by Adam for the log loss of 0/1 features; both kinds of document weigh the same."""
    if not n:
        return np.zeros(0), -1.0
    w, b = np.zeros(n + 1), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        d = b * (0.5 * (1 + np.tanh(0.5 * (np.bincount(row, w[col], len(y)) + w[n]))) - y)
        g = np.append(np.bincount(col, d[row], n), d.sum()) + DECAY / max(1, n) * np.append(w[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text", restored: str | None = None) -> DataFrame:
    """(row_id, score) and, if named, the restored text.  Null and empty texts have a score too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.log_p)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                texts = [restorer(t.as_py()) for t in some.column(1)]
                cols = [some.column(0), pa.array([model.score(t) for t in texts], type=pa.float64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, type=pa.string())] if restored else cols, [row_id, "score", *([restored] if restored else [])])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id), F.col(text)).mapInArrow(each, f"`{row_id}` {kind}, score double" + (f", `{restored}` string" if restored else ""))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
