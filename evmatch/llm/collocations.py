"""Phrases whose words come together oftener than apart, mined depth-first over position bitmaps.

Each task cuts its documents into shards of one language.  In a shard a word has a bitmap of the positions where it
stands, of which only the bytes that are not zero are kept, as (byte number, bits).  Pieces are a position apart, so
nothing crosses their borders.  The bitmap of a phrase, moved on by one position and ANDed with a word's, is that of
the phrase with the word behind it, and its population count is the number of occurrences in the shard; phrases are
extended depth-first, some first words at a time, so that few bitmaps are held.  Counts are summed over shards.

What is too rare in all shards together is not extended in any: first words, then pairs are counted, and every shard
gets back those of its own that are frequent; once words are, shards are written anew without the others.  These two
rounds count by 64-bit hashes, as two phrases with one hash can only be kept longer; the last round counts phrases as
they are.  Nothing is broadcast; a shard's size is bounded
by SHARD tokens, or by one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch, table

LEAST, LONGEST, COVER, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: tokens of a shard; shards of a partition of joins; AND operations at a time; parts that a language's ranking is dealt into
SHARD, TOGETHER, CHUNK, PARTS = 1_000_000, 4, 2_000_000, 64

_BORDER = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(b".,;:!?\n\v\f\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _BORDER * 10 + b" abcdefghijklmnopqrstuvwxyz")
_SHARDS = "shard long, lang string, n long, words array<string>, tokens binary"
_ARROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("tokens", pa.binary())])


class _Shard:
    """Documents of one language as they come: token 0 is a border, others number the shard's words."""

    def __init__(self, lang: str):
        self.lang, self.known, self.tokens, self.size = lang, {_BORDER: 0}, [], 0

    def add(self, text: str) -> None:
        found = text.encode().translate(_TABLE).replace(_BORDER, b" \xff ").split()
        found.append(_BORDER)
        known = self.known
        self.tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int32, count=len(found)))
        self.size += len(found)

    def row(self, number: int) -> dict:
        tokens = np.concatenate(self.tokens)
        tokens = tokens[(tokens > 0) | np.concatenate([[False], tokens[:-1] > 0])]  # a border after a word is enough
        words = [w.decode() for w in list(self.known)[1:]]  # all but the border
        return {"shard": number, "lang": self.lang, "n": int(np.count_nonzero(tokens)), "words": words, "tokens": tokens.tobytes()}


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, open_ = TaskContext.get().partitionId() << 32, {}

    def told(shard: _Shard) -> pa.RecordBatch:
        nonlocal number
        number += 1
        return pa.RecordBatch.from_pylist([shard.row(number)], schema=_ARROW)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                mine = open_.setdefault(lang, _Shard(lang))
                mine.add(text)
                if mine.size >= SHARD:
                    yield told(open_.pop(lang))
    for mine in open_.values():
        yield told(mine)


class _Bitmaps:
    """Bitmaps of a shard's words: bits of 8 positions a byte, by byte and word."""

    def __init__(self, tokens: np.ndarray, hashes: np.ndarray):
        at, many = np.flatnonzero(tokens), len(hashes) + 1
        key = (at >> 3).astype(np.int64) * many + tokens[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.bits = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(first) else np.zeros(0, dtype=np.uint8)
        self.byte, self.word = key[first] // many, (key[first] % many).astype(np.int32)
        self.begins = np.searchsorted(self.byte, np.arange((len(tokens) >> 3) + 3))
        self.hashes = np.concatenate([[0], hashes]).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, byte, bits), by word."""
        order = np.argsort(self.word, kind="stable")
        return self.word[order], self.byte[order], self.bits[order]

    def extend(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, word behind it, byte, bits) from (phrase, byte, bits)."""
        on, over = bits << 1, bits >> 7  # moved on by a position, the last one into the next byte
        phrase, byte, bits = (np.concatenate([x[on > 0], y[over > 0]]) for x, y in ((phrase, phrase), (byte, byte + 1), (on, over)))
        many = self.begins[byte + 1] - self.begins[byte]
        from_ = np.repeat(np.arange(len(byte)), many)
        entry = np.arange(len(from_)) - np.repeat(np.cumsum(many) - many - self.begins[byte], many)
        both = bits[from_] & self.bits[entry]
        hit = np.flatnonzero(both)
        from_, entry = from_[hit], entry[hit]
        return phrase[from_], self.word[entry], byte[from_], both[hit]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def mine(maps: _Bitmaps, longest: int, pairs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of phrases, a row each; occurrences) of 2 to ``longest`` words, from ``pairs`` alone if given (sorted)."""
    word, byte, bits = maps.entries()

    def deeper(phrases: np.ndarray, of: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Extends some phrases, whose bitmaps lie together, and then those that come of them."""
        of, behind, byte, bits = maps.extend(of, byte, bits)
        if pairs is not None and len(of):
            h = pair_hash(maps.hashes[phrases[of, -1]], maps.hashes[behind])
            near = np.minimum(np.searchsorted(pairs, h), max(len(pairs) - 1, 0))
            fine = pairs[near] == h if len(pairs) else np.zeros(len(h), dtype=bool)
            of, behind, byte, bits = of[fine], behind[fine], byte[fine], bits[fine]
        if not len(of):
            return
        keys, new = np.unique(of.astype(np.int64) << 32 | behind, return_inverse=True)
        longer = np.concatenate([phrases[keys >> 32], (keys & 0xFFFFFFFF).astype(np.int32)[:, None]], axis=1)
        yield longer, np.bincount(new, weights=np.bitwise_count(bits), minlength=len(keys)).astype(np.int64)
        if longer.shape[1] < longest:
            yield from deeper(longer, new, byte, bits)

    # chunks of first words whose bitmaps have some entries in all; a word beyond that is a chunk of its own
    ends = np.flatnonzero(np.diff(word, append=-1)) + 1
    lo = 0
    while lo < len(word):
        k = np.searchsorted(ends, lo + CHUNK // 8, side="right")
        hi = int(ends[max(k - 1, 0)]) if k and ends[k - 1] > lo else int(ends[k])
        firsts, of = np.unique(word[lo:hi], return_inverse=True)
        yield from deeper(firsts[:, None], of, byte[lo:hi], bits[lo:hi])
        lo = hi


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shards with their tokens as numbers and the hashes of their words."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names) if name not in ("frequent", "pairs")}
            given = {name: np.sort(batch.column(i)[k].values.to_numpy()) for i, name in enumerate(batch.schema.names) if name in ("frequent", "pairs")}
            yield row | given | {"tokens": np.frombuffer(row["tokens"], dtype=np.int32), "hashes": _hashes(row["lang"], row["words"])}


def _counted(shard: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), shard)), pa.array(h), pa.array(n)], ["shard", "h", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, h, n) of the words of each shard."""
    for row in _rows(batches):
        yield _counted(row["shard"], row["hashes"], np.bincount(row["tokens"], minlength=len(row["words"]) + 1)[1:])


def _without_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of frequent words alone, with a border for any others."""
    for row in _rows(batches):
        fine = np.flatnonzero(np.isin(row["hashes"], row["frequent"]))
        new = np.zeros(len(row["words"]) + 1, dtype=np.int32)
        new[fine + 1] = np.arange(1, len(fine) + 1)
        tokens = new[row["tokens"]]
        tokens = tokens[(tokens > 0) | np.concatenate([[False], tokens[:-1] > 0])]
        yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "lang": row["lang"], "n": row["n"], "words": [row["words"][k] for k in fine], "tokens": tokens.tobytes()}], schema=_ARROW)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, h, n) of the pairs of words in each shard."""
    for row in _rows(batches):
        maps = _Bitmaps(row["tokens"], row["hashes"])
        parts = [(pair_hash(maps.hashes[p[:, 0]], maps.hashes[p[:, 1]]), n) for p, n in mine(maps, 2)]
        if parts:
            yield _counted(row["shard"], *_summed(parts))


def _count_phrases(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, k, n) of words, and of phrases whose pairs are all frequent, in each shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = np.array(["", *row["words"]], dtype=object)
            alone, counts = np.unique(row["tokens"][row["tokens"] > 0], return_counts=True)
            for phrases, n in ((alone[:, None], counts), *mine(_Bitmaps(row["tokens"], row["hashes"]), longest, row["pairs"])):
                text = words[phrases[:, 0]]
                for k in range(1, phrases.shape[1]):
                    text = text + " " + words[phrases[:, k]]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(n), type=pa.string()), pa.array(text, type=pa.string()), pa.array(np.full(len(n), phrases.shape[1], dtype=np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])

    return each


def _frequent(rows: DataFrame, least: int, into: str, parts: int) -> DataFrame:
    """From (shard, h, n) to (shard, ``into``): the shard's hashes that come ``least`` times in all shards.  A hash has a
    row for each shard at most."""
    often = rows.withColumn("_all", F.sum("n").over(Window.partitionBy("h"))).filter(F.col("_all") >= least)
    return often.select("shard", "h").repartition(parts, "shard").groupBy("shard").agg(F.collect_list("h").alias(into))


def count_phrases(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of 1 to ``longest`` words that come ``least`` times in a language, and
    (lang, n) of all its words.  A null language is ``und``; a null or empty text has no words."""
    scratch = Scratch(df.sparkSession, "phrases")
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    shards = scratch.put(rows.mapInArrow(_encode, _SHARDS))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-shards.count() // TOGETHER))
    together = shards.repartition(parts, "shard")
    words = _frequent(together.mapInArrow(_count_words, "shard long, h long, n long"), least, "frequent", parts)
    sizes = scratch.put(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    shards = scratch.put(together.join(words, "shard").mapInArrow(_without_rare, _SHARDS))
    scratch.drop(1)
    pairs = _frequent(shards.mapInArrow(_count_pairs, "shard long, h long, n long"), least, "pairs", parts)
    with_pairs = shards.repartition(parts, "shard").join(pairs, "shard", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<long>")))
    told = with_pairs.mapInArrow(_count_phrases(longest), "lang string, phrase string, k int, n long")
    found = scratch.put(told.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    return found, sizes


# ---------------------------------------------------------------- scores


def _part(first: Column, many: Column) -> Column:
    return F.array_join(F.slice("_w", first, many), " ")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, k, a, l, r, n, score): each language's first ``top`` phrases of 2 words or more.

    A phrase's score is ``SCALE * a`` over the counts of its two parts, floored, at the cut where that is least.
    Phrases of which a longer one covers ``cover`` hundredths are left out.  Ties go by count, then by the phrase's
    bytes.  An empty table gives no rows; other columns are not read, and repeated rows count as often as they are.
    """
    found, sizes = count_phrases(df, lang, text, least, longest)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    phrases = found.filter("k > 1").withColumn("_w", F.split("phrase", " ", -1))
    cuts = phrases.select("lang", "phrase", "k", "_w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(F.lit(1), F.col("cut")).alias("_first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_rest"))
    parts = found.select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    named = lambda part, into: parts.withColumnsRenamed({"_part": part, "_f": into})
    scored = cuts.join(named("_first", "l"), ["lang", "_first"]).join(named("_rest", "r"), ["lang", "_rest"])
    scored = scored.withColumn("_score", F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("_score", "cut", "l", "r")).alias("_best"))
    within = phrases.filter("k > 2").select("lang", "f", "k", "_w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("_m"))
    within = within.select("lang", "f", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_m") + 1)).alias("_at"))
    covers = within.select("lang", _part(F.col("_at"), F.col("_m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (F.lit(100).cast("decimal(10,0)") * exact("_longer") < F.lit(cover).cast("decimal(10,0)") * exact("a")))
    flat = kept.select("lang", "phrase", "k", "a", "_best.l", "_best.r", F.col("_best._score").cast("long").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("_part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first ones of a language are among the first of its parts
    few = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "k", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents")).drop("k")


QUERIES = {"op12_collocations": op12_collocations}

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op12_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
 split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
 sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
 grams AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM split, range(1, {LONGEST + 1}) u(k), unnest(range(len(w) - k + 1)) v(i)),
 often AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
 cuts AS (SELECT lang, k, phrase, f AS a, c, array_to_string(w[1 : c], ' ') AS x, array_to_string(w[c + 1 : k], ' ') AS y FROM often, unnest(range(1, k)) u(c)),
 scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.c, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * c.a // (l.f::HUGEINT + r.f))::BIGINT AS score FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.x JOIN often r ON r.lang = c.lang AND r.phrase = c.y),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
 within AS (SELECT lang, array_to_string(w[s + 1 : s + m], ' ') AS phrase, max(f) AS longer FROM often, range(2, {LONGEST}) u(m), unnest(range(k - m + 1)) v(s) WHERE m < k GROUP BY ALL),
 kept AS (SELECT b.* FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.phrase = b.phrase WHERE w.longer IS NULL OR 100::HUGEINT * w.longer < {COVER}::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= {TOP}
"""
}
