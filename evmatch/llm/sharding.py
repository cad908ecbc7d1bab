"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source; a row's sort key is its fractional rank
``(rank + 1/2) / rows of its source``; the sorted sequence is cut into equal runs.  Any run of the
sequence holds each source in proportion, so every shard matches the mixture to a row or so, and the
law ``rows`` holds: shard counts differ by at most one.

Two range sorts of narrow rows (no text travels); no window spans a source or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import seeded, source_key, table, with_rank

SHARDS, SEED = 40, 42


def interleave(df: DataFrame, n_shards: int, seed: int = SEED, source: str = "source", row_id: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``row_id``, ``source``, the columns of ``carry``, ``shard`` and ``slot``.

    A null source is a source of its own; a null id sorts first; rows equal in all these columns
    are interchangeable; an empty table gives no rows; other columns are not read.
    """
    carry = carry or {}
    narrow = df.select(F.col(row_id).alias("_id"), F.col(source).alias("_source"), *(e.alias(f"_c_{k}") for k, e in carry.items()))
    narrow = narrow.withColumns({"_key": source_key("_source"), "_hash": seeded(seed, "_id")})
    ties = ["_id", *(f"_c_{k}" for k in carry)]
    ranked = with_rank(narrow, ["_key"], ["_hash", *ties], tag="shard-source")
    sizes = ranked.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    mixed = ranked.join(sizes, "_key").withColumn("_fraction", (F.col("rank") * 2 + 1).cast("double") / (F.col("_rows") * 2).cast("double")).drop("rank", "_rows")
    placed = with_rank(mixed, [], ["_fraction", "_hash", "_key", *ties], tag="shard-mix")
    total = placed.count()
    # exact cut: shard s starts at floor(s * total / n), so row r is in floor(((r + 1) * n - 1) / total)
    shard = F.expr(f"cast(((rank + 1) * {n_shards} - 1) div {max(1, total)} as int)")
    out = placed.withColumn("shard", shard)
    start = F.expr(f"(cast(shard as long) * {total}) div {n_shards}")
    out = out.withColumn("slot", F.col("rank") - start)
    return out.select(F.col("_id").alias(row_id), F.col("_source").alias(source), *(F.col(f"_c_{k}").alias(k) for k in carry), "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` over 40 shards under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"size": (F.octet_length(text) + F.lit(16)).cast("long"), "text_crc32": F.crc32(text.cast("binary")).cast("long")}
    out = interleave(table(spark, sf_dir, "documents"), SHARDS, carry=carry)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}

ORACLES = {
    "op3_sharding": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, substr(md5('{SEED}:' || coalesce(cast(doc_id AS varchar), '')), 1, 16) AS h FROM documents),
 steps AS (
  WITH RECURSIVE c(i, k, v) AS (
   SELECT r::BIGINT, 0, r::BIGINT FROM range(256) g(r)
   UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8)
  SELECT list(v ORDER BY i) AS crc_table FROM c WHERE k = 8),
 hexes AS (SELECT doc_id, source, h, t, hex(encode(t)) AS x FROM d),
 sums AS (
  SELECT doc_id, source, h, strlen(t) + 16 AS size,
   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda a, b: xor(a >> 8, crc_table[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexes, steps),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM sums),
 mixed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, h, source NULLS LAST, doc_id NULLS FIRST) - 1 AS g, count(*) OVER () AS total FROM ranked),
 cut AS (SELECT *, (SELECT max(s) FROM range({SHARDS}) q(s) WHERE (s * total) // {SHARDS} <= g) AS shard FROM mixed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (g - (shard * total) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
}
