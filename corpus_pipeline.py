"""Corpus pipeline over ``documents``: five stages, each calling one operator on all that the stage
before has kept.  All but the last return the columns of ``documents``.

1. quality     rejects documents that the classifier, fitted on ``labels``, scores below one half
2. near_dedup  keeps of each group of near-duplicates the document with the smallest id
3. windows     removes repeated 50-byte strings; documents that lose all their text go
4. mixing      takes each source's documents, repeats counted, up to its share of the mixture
5. packing     packs the documents' tokens into sequences of 2048
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm import mixing, packing, quality, simhash, suffixes
from evmatch.llm.common import Scratch, materialize, release, table, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=("text", "lang", "source", "n_chars")).filter("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest id stays; rows without an id do too.  Rows of one id are told
    apart by their texts; those equal in both are one document."""
    gone = simhash.similar_documents(docs).select("doc_id", "text_hash")
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def drop_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffixes.deduplicate(docs, keep=("lang", "source"), with_text=True)
    left = kept.filter("n_removed = 0 or n_removed < n_bytes")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mixture takes it whole; rows of one id, or of none, each for themselves,
    in the order of their texts' hashes, so that another run takes the same ones."""
    numbered = materialize(docs.select(*COLUMNS).withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}), "mixing-rows")
    taken = mixing.mix(numbered, words("text"), cut="document", keep=("_text", "_row")).filter("taken > 0").select("_row", F.expr("cast(taken div size as int)").alias("_times"))
    many = numbered.join(taken, "_row")
    return many.select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_nth")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in pieces, each with its place; copies that mixing made differ in ``source_row``."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("windows", drop_windows),
    ("mixing", mix),
    ("packing", pack),
]

#: the classifier and the tokenizer are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        kept = Scratch(spark, f"pipeline-{name}")
        before = len(Scratch.made)
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = kept.put(docs)
            release(before)  # what the stage wrote on its way
    return docs
