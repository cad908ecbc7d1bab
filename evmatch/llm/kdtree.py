"""Exact top-k by inner product over KD-trees, one per shard.

Shards are spatial: median splits of a bounded sample, always at the widest dimension, cut the space into
cells, and every row goes to its cell; a cell that holds too many rows, be they copies of one vector, is
dealt over several shards.  A shard's tree goes on with median splits until a leaf is small; each node
keeps the tight bounding box of its vectors and their smallest id.  It is built once, where the shard's
rows meet, and kept.  A query visits nodes best first by the highest inner product that the box allows, and
stops where that is below its k-th best score.

A query is answered in its own shard first, while the tree is built.  Its k-th score then meets the boxes
of the other shards, and it travels only to those whose bound is not below.  So vectors move twice, to
their shard and with the tree to the queries that ask it, and queries as often as shards can matter.

Shards grow with the table, from SHARD_ROWS up to FULL_ROWS rows as soon as there are FEW_SHARDS, so that
queries meet few of them, and are at most about twice MOST_SHARDS, so that the boxes that are broadcast have
a bounded size.  A shard's queries pass through its task in batches.  Vectors travel as integers of two
bytes a component where they fit.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch, table

K, SCALE, EVERY = 10, 1024, 100
SHARD_ROWS, FEW_SHARDS, FULL_ROWS, MOST_SHARDS, LEAF = 4096, 256, 1 << 18, 4096, 128
SAMPLE = 16_384  # rows, at most, that the cells' splits are taken from
NONE = (-(1 << 63), (1 << 63) - 1)  # score and id of a k-th best that is not there yet


def widest(v: np.ndarray) -> int:
    """The dimension of the largest extent, -1 if all rows are equal."""
    extent = v.max(axis=0).astype(np.int64) - v.min(axis=0)
    return int(np.argmax(extent)) if extent.any() else -1


class Cells:
    """A perfect tree of ``levels`` splits, from a sample."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.at = np.full((1 << levels) - 1, -1), np.zeros((1 << levels) - 1, dtype=np.int64)
        todo = [(0, sample)] if levels else []
        while todo:
            node, v = todo.pop()
            if len(v) < 2 or (d := widest(v)) < 0:
                continue
            # the upper of two middle values can be the largest: then the split goes below it
            cut = np.partition(v[:, d], (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if not (right := v[:, d] > cut).any():
                cut = v[v[:, d] < cut, d].max()
                right = v[:, d] > cut
            self.dim[node], self.at[node] = d, cut
            if 2 * node + 2 < len(self.dim):
                todo += [(2 * node + 1, v[~right]), (2 * node + 2, v[right])]

    def of(self, v: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
        for _ in range(self.levels):
            d = self.dim[node]
            node = 2 * node + 1 + ((d >= 0) & (v[row, np.maximum(d, 0)] > self.at[node]))
        return node - ((1 << self.levels) - 1)


class KDTree:
    """Nodes in arrays; a leaf is a run of rows, which are kept in leaf order.

    Of rows with one vector and beyond one leaf, the ``keep`` smallest ids are enough and only they are kept.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, keep: int = K + 1):
        order = np.lexsort((rows, ids))
        lo, hi, runs, kids, kept = [], [], [], [], []
        size, todo = 0, [(order, -1)]
        while todo:
            some, above = todo.pop()
            if above >= 0:
                kids[above].append(len(lo))
            v, here = vectors[some], len(lo)
            lo.append(v.min(axis=0).astype(np.int64))
            hi.append(v.max(axis=0).astype(np.int64))
            kids.append([])
            d = widest(v) if len(some) > leaf else -1
            if d < 0:
                some = some[:keep] if len(some) > leaf else some
                kept.append(some)
                runs.append((size, size + len(some)))
                size += len(some)
            else:
                by_value, half = np.argsort(v[:, d], kind="stable"), len(some) // 2
                runs.append((0, 0))
                todo += [(some[np.sort(by_value[half:])], here), (some[np.sort(by_value[:half])], here)]  # ids stay in order
        order = np.concatenate(kept)
        self._put(np.array(lo), np.array(hi), np.array(runs), np.array([k or [-1, -1] for k in kids]), ids[order], rows[order], vectors[order])

    def _put(self, lo: np.ndarray, hi: np.ndarray, runs: np.ndarray, kids: np.ndarray, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.lo, self.hi, self.runs, self.kids, self.ids, self.rows, self.vectors = lo, hi, runs, kids, ids, rows, vectors
        self.least = np.zeros(len(runs), dtype=np.int64)
        for n in range(len(runs) - 1, -1, -1):  # children come after their parent
            self.least[n] = self.least[kids[n]].min() if kids[n, 0] >= 0 else ids[runs[n, 0] : runs[n, 1]].min()
        self.most = int(max(lo.max(), -lo.min(), hi.max(), -hi.min(), 1))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, self.lo, self.hi, self.runs, self.kids, self.ids, self.rows, self.vectors)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KDTree:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as held:
            made._put(*(held[f"arr_{n}"] for n in range(7)))
        return made

    def exact(self, queries: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries and boxes as doubles where every product and sum is exact in them, else as Python's integers."""
        fits = self.most * int(max(np.abs(queries).max(initial=0), 1)) * queries.shape[1] < 1 << 53
        return tuple(x.astype(np.float64 if fits else object) for x in (queries, self.lo, self.hi))

    def search(self, queries: np.ndarray, own: np.ndarray, floors: list[tuple[int, int]], k: int) -> Iterator[list[tuple[int, int, int]]]:
        """For each query up to k (score, id, row), best first, ties to the smaller id; none worse than its
        floor, the (score, id) of its k-th best so far, and none of the query's own row."""
        asked, lo, hi = self.exact(queries)
        bounds = bound(asked, lo, hi)
        for q, row, b, (floor, last) in zip(asked, own, bounds, floors, strict=True):
            best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row)
            queue = [(-b[0], 0)]
            while queue:
                most, node = heapq.heappop(queue)
                if -most < floor:
                    break
                if -most == floor and self.least[node] > last:
                    continue
                if self.kids[node, 0] >= 0:
                    for kid in self.kids[node]:
                        if b[kid] >= floor:
                            heapq.heappush(queue, (-b[kid], int(kid)))
                    continue
                a, z = self.runs[node]
                scores = self.vectors[a:z].astype(q.dtype) @ q
                some = np.flatnonzero((scores >= floor) & (self.rows[a:z] != row))
                if len(some) > k:
                    some = some[np.lexsort((self.ids[a:z][some], -scores[some]))][:k]
                for i in some:
                    item = (int(scores[i]), -int(self.ids[a + i]), -int(self.rows[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and (best[0][0], -best[0][1]) != (floor, last) and best[0][0] >= floor:
                    floor, last = best[0][0], (-best[0][1] if best[0][0] > floor else min(last, -best[0][1]))
            yield sorted(((s, -i, -r) for s, i, r in best), key=lambda x: (-x[0], x[1], x[2]))


def bound(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The highest inner product with each box: (queries, boxes)."""
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


SQUARES = float(1 << 62)


def integers(vector: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null where the vector cannot take part.

    That is also where the squares of the integers reach SQUARES in sum, as its scores might pass 64 bits; any two
    others have scores below it.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    return F.when(fine & (squares < SQUARES), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _packed(v: np.ndarray) -> bytes:
    """The components in two, four or eight bytes each."""
    lo, hi = int(v.min()), int(v.max())
    return v.astype(next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if -most <= lo and hi < most)).tobytes()


def _matrix(cells: pa.Array, d: int) -> np.ndarray:
    """Of packed cells of d components, all as wide as the widest."""
    rows = cells.to_pylist()
    widths = np.array([len(r) // d for r in rows])
    out = np.empty((len(rows), d), dtype=f"<i{max(widths, default=2)}")
    for w in np.unique(widths):
        some = np.flatnonzero(widths == w)
        out[some] = np.frombuffer(b"".join(rows[k] for k in some.tolist()), dtype=f"<i{w}").reshape(-1, d)
    return out


SHARD = ["d", "cell", "part"]
_BUILT = "d int, cell long, part long, tree binary, lo binary, hi binary, least long, q_row long, q_id long, id long, row long, score long"
_FOUND = "q_row long, q_id long, id long, row long, score long"


def _batch(columns: list, kinds: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in kinds.split(", ")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([c.cast(of[t]) if isinstance(c, pa.Array) else pa.array(c, type=of[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of one shard each, of rows sorted by shard."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in SHARD]).astype(np.int64)
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo < hi:
                yield tuple(keys[:, lo].tolist()), batch.slice(lo, hi - lo)


def top_k(df: DataFrame, is_query: Column, k: int = K, row_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank from 1, row_id, score) of each query row's k best others, ties to the smaller id.

    Rows with a null id or vector, with a null or non-finite component, or too long for scores of 64 bits (see
    ``integers``) take no part; vectors meet only
    those of their own length; of rows that share an id each is a candidate and, if a query, has a list of
    its own, in which the others can be; a query without any other vector gives no rows; an empty table
    gives none; other columns are not read.  ``sample`` bounds the rows that cells are fitted on; every row
    is in the index and the result is exact.
    """
    spark = df.sparkSession
    fit = df.select(F.col(row_id).cast("long").alias("id"), integers(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    numbered = Scratch(spark, "topk-rows").put(fit.filter("v is not null and id is not null").withColumns({"d": F.size("v"), "row": F.monotonically_increasing_id()}))

    # cells of the lengths that most vectors have
    sizes = numbered.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(64).collect()
    total = numbered.count()
    target = max(shard_rows, min(-(-total // FEW_SHARDS), FULL_ROWS), -(-total // MOST_SHARDS))
    wanted = {r["d"]: r["n"] for r in sizes if r["n"] > target}
    cells: dict[int, Cells] = {}
    if wanted:
        share = min(1.0, sample / sum(wanted.values()))
        pick = numbered.filter(F.col("d").isin(list(wanted))).filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("d", "v").limit(sample)  # sample rows at most
        by_length: dict[int, list] = {d: [] for d in wanted}
        for r in pick.toLocalIterator():
            by_length[r["d"]].append(r["v"])
        for d, some in by_length.items():
            levels = max(0, min((wanted[d] // target).bit_length(), len(some).bit_length() - 3))
            cells[d] = Cells(np.array(some, dtype=np.int64).reshape(len(some), d), levels)
    shared = spark.sparkContext.broadcast(cells)  # MOST_SHARDS splits of two numbers, about

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, flat = batch.column("d").to_numpy(), batch.column("v").flatten().to_numpy()
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            cell = np.zeros(len(lengths), dtype=np.int64)
            for d in np.unique(lengths):
                if int(d) in known:
                    some = np.flatnonzero(lengths == d)
                    cell[some] = known[int(d)].of(flat[starts[some][:, None] + np.arange(d)])
            packed = [_packed(flat[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            yield _batch([batch.column("id"), batch.column("row"), batch.column("q"), batch.column("d"), cell, packed], "id long, row long, q boolean, d int, cell long, x binary")

    placed = Scratch(spark, "topk-cells").put(numbered.mapInArrow(place, "id long, row long, q boolean, d int, cell long, x binary"))
    parts = placed.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n")).select("d", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * target))).alias("parts"))
    dealt = placed.join(parts, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).select(*SHARD, "id", "row", "q", "x")

    def results(rows: list[tuple]) -> list[list]:
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = pa.Table.from_batches(held).combine_chunks()
            ids, rows, asks = (some.column(c).to_numpy() for c in ("id", "row", "q"))
            x = _matrix(some.column("x"), key[0])
            tree = KDTree(ids, rows, x, keep=k + 1)
            yield _batch([*([n] for n in key), [tree.dump()], [tree.lo[0].tobytes()], [tree.hi[0].tobytes()], [int(tree.least[0])], *([None] for _ in range(5))], _BUILT)
            who = np.flatnonzero(asks)
            for at in range(0, len(who), 1024):
                part = who[at : at + 1024]
                hits = tree.search(x[part].astype(np.int64), rows[part], [NONE] * len(part), k)
                found = [(int(rows[w]), int(ids[w]), i, r, s) for w, best in zip(part, hits, strict=True) for s, i, r in best]
                yield _batch([*([n] * len(found) for n in key), *([None] * len(found) for _ in range(4)), *results(found)], _BUILT)

        now, held = None, []
        for key, some in _groups(batches):
            if key != now and held:
                yield from made(now, held)
                held = []
            now = key
            held.append(some)
        if held:
            yield from made(now, held)

    scratch = Scratch(spark, "topk-trees")
    built = scratch.put(dealt.repartition(*SHARD).sortWithinPartitions(*SHARD).mapInArrow(build, _BUILT))
    at_home = built.filter("q_row is not null")
    trees = scratch.again().filter("tree is not null")
    # each query's k-th best so far, for the other shards' boxes
    kth = F.element_at(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))), -1)
    floors = at_home.groupBy("q_row").agg(F.when(F.count(F.lit(1)) >= k, kth).alias("kth")).select(F.col("q_row").alias("row"), (-F.col("kth.s")).alias("floor"), F.col("kth.i").alias("last"))
    asking = dealt.filter("q").join(floors, "row", "left").select(*SHARD, "id", "row", "x", F.coalesce("floor", F.lit(NONE[0])).alias("floor"), F.coalesce("last", F.lit(NONE[1])).alias("last"))
    boxes: dict[int, tuple] = {}
    for r in trees.select(*SHARD, "lo", "hi", "least").toLocalIterator():  # twice MOST_SHARDS, about, and one for each other length
        boxes.setdefault(r["d"], ([], [], [], []))
        for held, one in zip(boxes[r["d"]], ((r["cell"], r["part"]), r["lo"], r["hi"], r["least"]), strict=True):
            held.append(one)
    boxes = {d: (np.array(at), *(np.frombuffer(b"".join(map(bytes, x)), dtype="<i8").reshape(len(at), d) for x in (lo, hi)), np.array(least)) for d, (at, lo, hi, least) in boxes.items()}
    told = spark.sparkContext.broadcast(boxes)
    _AWAY = "d int, cell long, part long, tree binary, q_row long, q_id long, x binary, floor long, last long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                of_length = batch.filter(pa.array(lengths == d))
                at, lo, hi, least = told.value[int(d)]
                most = int(max(np.abs(lo).max(), np.abs(hi).max(), 1))
                for a in range(0, of_length.num_rows, 256):
                    some = of_length.slice(a, 256)
                    x = _matrix(some.column("x"), int(d)).astype(np.int64)
                    kind = np.float64 if most * int(max(np.abs(x).max(), 1)) * int(d) < 1 << 53 else object
                    b = bound(x.astype(kind), lo.astype(kind), hi.astype(kind))
                    floor, last, cell, part = (some.column(c).to_numpy()[:, None] for c in ("floor", "last", "cell", "part"))
                    meets = ((b > floor) | (b == floor) & (least[None] <= last)) & ((at[None, :, 0] != cell) | (at[None, :, 1] != part))
                    q, s = np.nonzero(meets)
                    yield _batch([[int(d)] * len(q), at[s, 0], at[s, 1], [None] * len(q), *(some.column(c).take(pa.array(q)) for c in ("row", "id", "x", "floor", "last"))], _AWAY)

    away = asking.mapInArrow(go, _AWAY)
    kept = trees.select(*SHARD, "tree", *(F.lit(None).cast(t).alias(c) for c, t in (("q_row", "long"), ("q_id", "long"), ("x", "binary"), ("floor", "long"), ("last", "long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's tree comes first, then its queries."""
        tree = None
        for key, some in _groups(batches):
            if some.column("tree").is_valid()[0].as_py():
                tree = KDTree.load(some.column("tree")[0].as_py())
                some = some.slice(1)
            for a in range(0, some.num_rows, 1024):
                part = some.slice(a, 1024)
                own, ids, floor, last = (part.column(c).to_pylist() for c in ("q_row", "q_id", "floor", "last"))
                hits = tree.search(_matrix(part.column("x"), key[0]).astype(np.int64), np.array(own), list(zip(floor, last, strict=True)), k)
                yield _batch(results([(q, i, c, r, s) for q, i, best in zip(own, ids, hits, strict=True) for s, c, r in best]), _FOUND)

    met = kept.unionByName(away).repartition(*SHARD).sortWithinPartitions(*SHARD, F.col("tree").isNull())
    both = at_home.select("q_row", "q_id", "id", "row", "score").unionByName(met.mapInArrow(search, _FOUND))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"), F.col("row").alias("r")))), 1, k)
    # k rows for each shard that a query meets, of a bounded number
    ranked = both.groupBy("q_row", "q_id").agg(best.alias("best")).select("q_id", F.posexplode("best"))
    kind = df.schema[row_id].dataType
    return ranked.select(F.col("q_id").cast(kind).alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.i").cast(kind).alias(row_id), (-F.col("col.s")).alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op9_topk": op9_topk}
ORACLES = {
    "op9_topk": f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r) AS n FROM scored)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= {K}
"""
}
