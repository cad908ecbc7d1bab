"""Best-fit packing by large-item matching.

Documents are tokenized once; longer ones are cut into capacity-long pieces, the first taking the
remainder.  What is packed then is the histogram of piece lengths, which has at most ``capacity``
entries however many documents there are:

* pieces above a third of the capacity: at most two fit a bin, so the largest open one is matched
  with the largest other one that fits beside it;
* smaller pieces, longest first, go to the fullest bin that still takes them (best fit), several of
  a length to a bin at once.

Equal bins are kept as one run with a multiplicity.  The plan says for each length which ranks go to
which run; pieces get their rank within their length by a range sort, and look up bin and offset.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import materialize, table, with_rank

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.json"
KEPT_CHUNKS, LONGEST_CHUNK = 400_000, 64


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it is visible."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(hidden)}


LETTERS = _byte_letters()
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOOSE = re.compile(r" (?:\s|\Z)")


class Chunks(dict):
    """Token ids, as little-endian bytes, of text chunks that follow a space (or, with lead "", that do not).

    The vocabulary's pre-tokenizer never joins a space that precedes a visible character to what is
    before it, nor a line end between visible characters to either, so the ids of a text are the ids
    of its chunks in a row.  A chunk of letters with marks behind is its letters' and its marks'
    pre-tokens, which go to the vocabulary's model at once; any other chunk goes the long way.
    When there are too many, all are forgotten.
    """

    def __init__(self, path: str, lead: str = " ", rest: Chunks | None = None):
        super().__init__()
        if rest is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = rest.tokenizer
        self.model = self.tokenizer.model
        self.lead, self.space = lead, LETTERS[32] if lead else ""
        self.bare = self if lead == "" else Chunks(path, "", self)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        head, line, tail = chunk.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.bare["\n"] + self.bare[tail]
        word = chunk.rstrip(MARKS)
        if len(word) < len(chunk) and word.isalpha() and max(word) < "\u3000":
            found = self[word] + self.bare[chunk[len(word) :]]
        elif word and word == chunk and word.isalpha() and max(word) < "\u3000":
            spelled = self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS))
            found = np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
        else:
            found = self.ids(self.lead + chunk)
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # a special token's own string may span chunks
            return self.ids(text)
        parts = text.split(" ")
        if LOOSE.search(text):
            joined = parts[:1]
            for p in parts[1:]:
                if p and not p[0].isspace():
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            parts = joined
        return (self.bare[parts[0]] if parts[0] else b"") + b"".join(map(self.__getitem__, parts[1:]))


_CHUNKS: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """One per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, capacity: int, vocabulary: str, row_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: _id, source_row, piece, start, length, ids_crc32 and, if asked for, its ids.

    ``source_row`` numbers the input rows, so that pieces of copies can be told apart.  The vocabulary is a
    file of the driver, which Spark brings to the executors.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks(SparkFiles.get(name))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, row, value in zip(*batch.columns, strict=True):
                ids = coder.encode(value.as_py() or "") + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc.as_py(), row.as_py(), k, start, length, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]
            names = ["_id", "source_row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(made[: 7 if with_ids else 6], names[: 7 if with_ids else 6])

    kind = df.schema[row_id].dataType.simpleString()
    numbered = df.select(F.col(row_id), F.monotonically_increasing_id(), F.col(text))
    return numbered.mapInArrow(cut, f"_id {kind}, source_row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


Bin = tuple[tuple[int, int, int], ...]  # (length, how many, offset) in order


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """(how many bins, what is in each) for so many pieces of each length.

    Work and result depend on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c and 3 * n > capacity}
    sizes = sorted(left)
    open_bins: dict[int, list[tuple[int, Bin]]] = {}

    def put(gap: int, many: int, bin_: Bin) -> None:
        if gap not in open_bins:
            bisect.insort(gaps, gap)
        open_bins.setdefault(gap, []).append((many, bin_))

    gaps: list[int] = []
    while sizes:
        big = sizes[-1]
        at = bisect.bisect_right(sizes, capacity - big) - 1
        if at < 0:
            put(capacity - big, left[big], ((big, 1, 0),))
            many, used = left[big], (big,)
        else:
            mate = sizes[at]
            if mate == big and left[big] == 1:
                put(capacity - big, 1, ((big, 1, 0),))
                many, used = 1, (big,)
            else:
                many = left[big] // 2 if mate == big else min(left[big], left[mate])
                put(capacity - big - mate, many, ((big, 2, 0),) if mate == big else ((big, 1, 0), (mate, 1, big)))
                used = (big, mate)
        for n in used:
            left[n] -= many
        sizes = [n for n in sizes if left[n]] if any(not left[n] for n in used) else sizes
    for n in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        rest = counts[n]
        while rest:
            at = bisect.bisect_left(gaps, n)
            gap = gaps[at] if at < len(gaps) else capacity
            many, bin_ = open_bins[gap].pop() if at < len(gaps) else (-(-rest // (capacity // n)), ())
            if at < len(gaps) and not open_bins[gap]:
                del open_bins[gap], gaps[at]
            each = gap // n
            full, some = (many, 0) if rest >= many * each else divmod(rest, each)
            add = lambda k, b=bin_, g=gap: (*b, (n, k, capacity - g))
            if full:
                put(gap - full * 0 - each * n, full, add(each))
            if some:
                put(gap - some * n, 1, add(some))
            if (same := many - full - bool(some)) and bin_:
                put(gap, same, bin_)
            rest -= full * each + some
    return [x for gap in gaps for x in open_bins[gap]]


def lookup(bins: list[tuple[int, Bin]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, how many to a bin, offset of the first), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for many, bin_ in bins:
        for n, k, offset in bin_:
            out.setdefault(n, []).append((seen.get(n, 0), base, k, offset))
            seen[n] = seen.get(n, 0) + many * k
        base += many
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, row_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: row_id, source_row, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece that holds the end id alone; repeated rows are packed each for
    itself; an empty table gives no rows; other columns are not read.
    """
    # written first: a range sort reads its input twice, and the texts should be tokenized once
    cut = materialize(pieces(df, capacity, vocabulary, row_id, text, with_ids), "pieces")
    ranked = with_rank(cut, ["length"], ["_id", "start", "ids_crc32", "source_row"], tag="pack")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # capacity rows at most
    found = lookup(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for x in np.unique(n):
                mine, runs = n == x, found[int(x)]
                r = rank[mine]
                run = runs[np.searchsorted(runs[:, 0], r, side="right") - 1]
                seq[mine] = run[:, 1] + (r - run[:, 0]) // run[:, 2]
                off[mine] = run[:, 3] + (r - run[:, 0]) % run[:, 2] * x
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").withColumnRenamed("_id", row_id)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
