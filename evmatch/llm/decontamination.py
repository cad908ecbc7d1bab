"""Benchmark passages in a corpus, through a distributed positional inverted index.

``build`` stores a posting (term, document, position) for every token.  Every task writes a segment of its own
documents, sorted by the term's hash, so building moves nothing, and a term's postings stand in a row.

``phrases`` looks for windows of consecutive item words.  Terms of the items are counted in the index.  A window
starts from the postings of its rarest term, each of which puts the item at one place of a document; the list of the
second rarest, shifted by its distance, is intersected with them, which leaves few places; and then those of all other
terms of the item.  Item words met in a row, as many as a window has, are occurrences.  A window with a term that no
document has is never looked for.

``near`` finds windows whose words stand at most some words from where the rarest one puts them.

Only DataFrame functions are used.  Tables of item terms are broadcast up to a checked size, and joined by shuffle
beyond; documents that still matter are told to the scan as a bit table of fixed size, which at worst keeps too many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch, table

WIDTH = 10
#: terms as they are before lower-casing: of ASCII the digits and letters.  What separates them is named one by one, which
#: the matcher keeps as one table of bits; a range would be a test of its own for each character of a text
TERM = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: characters beyond ASCII (asked first) that have a lower case, or may have one in a Unicode version later than the matcher's
UPPER = r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{IsUppercase}\p{Cn}]]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: 64-bit entries of the table of documents that matter
SLOTS = 1 << 16


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else: ``lower`` where no other character has one."""
    return F.when(text.rlike(UPPER), F.translate(text, CAPITALS, SMALL)).otherwise(F.lower(text))


def terms(text: Column) -> Column:
    """Array of a text's terms in order; a null text has none."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _bounded(rows: DataFrame, *texts: str) -> DataFrame:
    """For a broadcast up to BROADCAST_ROWS rows and BROADCAST_BYTES, both counted first."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(64)).cast("long")
    many, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(rows) if many <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else rows


@dataclass(frozen=True)
class Index:
    """``postings`` (term, doc, pos) by hash of the term, and ``documents`` (doc, row id, n_words)."""

    postings: DataFrame
    documents: DataFrame


def build(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a table's texts.  Rows are told apart by a number of their own, so null and repeated ids, and
    repeated rows, are documents each; a null text is a document without words; other columns are not read."""
    # after its words each document has a row without a term, which tells its id and length
    numbered = df.select(F.col(row_id).alias("_id"), F.monotonically_increasing_id().alias("doc"), F.concat(terms(F.col(text).cast("string")), F.array(F.lit(None).cast("string"))).alias("_terms"))
    said = numbered.select("_id", "doc", F.posexplode("_terms").alias("pos", "term"))
    none = F.col("term").isNull()
    rows = said.select("term", "doc", "pos", F.when(none, F.col("_id")).alias("_id"))
    kept = Scratch(df.sparkSession, "postings").put(rows.sortWithinPartitions(F.xxhash64("term")))
    return Index(kept.filter("term is not null").select("term", "doc", "pos"), kept.filter("term is null").select("doc", F.col("_id").alias(row_id), F.col("pos").cast("long").alias("n_words")))


def _words(items: DataFrame) -> DataFrame:
    return items.select("item", F.size("_terms").alias("n"), F.posexplode("_terms").alias("ip", "term"))


def _of_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings beside what is asked by term."""
    return postings.join(_bounded(asked, "term"), "term")


def _of_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose ``doc`` is among the documents, and some others: those that share a bit with one."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(64 * SLOTS))
    place = {"_slot": F.floor(bit / 64).cast("int"), "_bit": (bit % 64).cast("int")}
    bits = docs.select("doc").withColumns(place).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.withColumns(place).join(F.broadcast(bits), "_slot").filter("shiftright(_bits, _bit) & 1 = 1").drop("_slot", "_bit", "_bits")


def windows(words: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(item, s, many, _rare): each window whose terms all occur, with (count, ip, term) of its two rarest words.

    An item of fewer than ``width`` words is one window.
    """
    last = F.greatest(F.lit(0), F.col("n") - width)
    counted = words.join(counts, "term", "left").withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.least(last, F.col("ip") - width + 1)), F.least(last, F.col("ip")))))
    every = counted.groupBy("item", "s").agg(F.count(F.lit(1)).alias("many"), F.count("count").alias("_met"), F.array_sort(F.collect_list(F.struct("count", "ip", "term"))).alias("_rare"))
    return every.filter("many = _met").select("item", "s", "many", F.slice("_rare", 1, 2).alias("_rare"))


class _Search:
    """One set of items against one index."""

    def __init__(self, index: Index, items: DataFrame, item_id: str, text: str, width: int):
        self.index, self.scratch = index, Scratch(items.sparkSession, "search")
        rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), terms(F.col(text).cast("string")).alias("_terms"))
        self.items = self.scratch.put(rows.filter(F.size("_terms") > 0))
        self.words = _words(self.items)
        self.asked = self.words.select("term").distinct()
        counts = self.scratch.put(_of_terms(index.postings, self.asked).groupBy("term").count())
        self.windows = self.scratch.put(windows(self.words, counts, width))

    def places(self, slop: int) -> DataFrame:
        """(item, i1, doc, off): where rarest words of windows put items, the second rarest being within ``slop``."""
        first, second = F.col("_rare")[0], F.get("_rare", F.lit(1))
        pairs = self.windows.select("item", first["term"].alias("term"), first["ip"].alias("i1"), second["term"].alias("term2"), second["ip"].alias("i2")).distinct()
        found = _of_terms(self.index.postings, pairs).select("item", "i1", "term2", "i2", "doc", (F.col("pos") - F.col("i1")).alias("off"))
        seeds = self.scratch.put(found)
        lists = _of_documents(_of_terms(self.index.postings, pairs.filter("i2 is not null").select(F.col("term2").alias("term")).distinct()), seeds)
        wanted = seeds.filter("i2 is not null").withColumn("pos", F.explode(F.sequence(F.col("off") + F.col("i2") - slop, F.col("off") + F.col("i2") + slop)))
        both = wanted.join(lists.select(F.col("term").alias("term2"), "doc", "pos"), ["doc", "pos", "term2"], "left_semi")
        return both.unionByName(seeds.filter("i2 is null"), allowMissingColumns=True).select("item", "i1", "doc", "off")

    def stretches(self, places: DataFrame, slop: int) -> DataFrame:
        """(columns of ``places``, ``a``, ``b``): item words from a to b that all stand within ``slop`` of their places."""
        places = self.scratch.put(places.distinct())
        lists = _of_documents(_of_terms(self.index.postings, self.asked), places)
        shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
        wanted = places.join(_bounded(self.words, "term"), "item").withColumn("_by", shift).withColumn("pos", F.col("off") + F.col("ip") + F.col("_by"))
        met = wanted.join(lists, ["doc", "pos", "term"]).select(*places.columns, "ip")
        met = met.distinct() if slop else met
        island = F.col("ip") - F.row_number().over(Window.partitionBy(*places.columns).orderBy("ip"))
        return met.withColumn("_island", island).groupBy(*places.columns, "_island").agg(F.min("ip").alias("a"), F.max("ip").alias("b")).drop("_island")


def phrases(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, item_id, start, length, first): every longest stretch of ``length`` document words from ``start`` that are
    the item's words from ``first`` on, of a window's words at least.

    ``doc`` is a document's number in the index.  Items without words take no part; items of one id, and repeated
    items, are looked for each; no items or no documents give no rows.
    """
    search = _Search(index, items, item_id, text, width)
    found = search.stretches(search.places(0).select("item", "doc", "off"), 0)
    sized = found.join(search.items.select("item", "item_id", F.size("_terms").alias("_n")), "item").withColumn("length", F.col("b") - F.col("a") + 1)
    return sized.filter(F.col("length") >= F.least(F.lit(width), F.col("_n"))).select("doc", "item_id", (F.col("off") + F.col("a")).alias("start"), "length", F.col("a").alias("first"))


def near(index: Index, items: DataFrame, slop: int, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, item_id, first, at): windows of item words from ``first`` on, each of which stands within ``slop`` words of
    where the window's rarest word, at ``at`` in the document, puts it."""
    search = _Search(index, items, item_id, text, width)
    found = search.stretches(search.places(slop), slop)
    rare = search.windows.select("item", F.col("_rare")[0]["ip"].alias("i1"), "s", "many")
    fits = found.join(rare, ["item", "i1"]).filter("s >= a and s + many - 1 <= b")
    return fits.join(search.items.select("item", "item_id"), "item").select("doc", "item_id", F.col("s").alias("first"), (F.col("off") + F.col("i1")).alias("at")).distinct()


def contamination(df: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: ``row_id``, ``n_words``, ``n_hit`` words in occurrences, and ``item_ids``, the sorted ids, as
    strings, of items that occur; an item without an id is told as an empty one."""
    index = build(df, row_id, text)
    found = Scratch(df.sparkSession, "found").put(phrases(index, items, item_id, item_text, width))
    spans = found.select("doc", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("_new", new).groupBy("doc").agg(F.sum("_new").alias("n_hit"))
    ids = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids"))
    out = index.documents.join(hit.join(ids, "doc"), "doc", "left")
    return out.select(row_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of ``benchmark`` in all ``documents``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op13_decontamination": op13_decontamination}

_SMALL = f"translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}')"
ORACLES = {
    "op13_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[s + 1 : s + least(len(w), {WIDTH})], ' ') AS words FROM b, unnest(range(greatest(1, len(w) - {WIDTH - 1}))) u(s) WHERE len(w) > 0),
 lengths AS (SELECT DISTINCT n FROM windows),
 grams AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS words FROM d, lengths, unnest(range(len(w) - n + 1)) u(i)),
 found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, words)),
 hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
 ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
}
