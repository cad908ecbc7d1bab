"""Mixing sources to target weights.

Every document gets a hash-random key; inside each source documents are range-sorted by it, and the
exclusive prefix sum of their sizes decides what the source's budget takes: ``epochs`` whole passes
over the source, then documents in key order until the budget is used up to the word.

Targets come by water-filling: a source's share is proportional to its weight, but no more than
``most`` times its own size; what a stopped source leaves over is reshared by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evmatch.llm.common import seeded, source_key, table, with_rank, words

SEED, WEIGHTS, SHARE, MOST = 8, (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (key, source_size), one row per source, to (key, source_size, target).

    With caps sorted by cap / weight, the sources before some point stop at their caps and the rest
    share what is left at one level; the first level that stops nobody further is the answer.
    The windows run over one row per source.  Sources without words get a target of 0.
    """
    by_name, by_ratio = Window.orderBy("key"), Window.orderBy("_ratio", "key")
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    done = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = caps.withColumns({
        "_money": F.sum("source_size").over(Window.partitionBy()).cast("double") * F.lit(float(share)),
        "_spent": F.coalesce(F.sum("_cap").over(done), F.lit(0)).cast("double"),
        "_open": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = left.withColumn("_level", (F.col("_money") - F.col("_spent")) / F.col("_open"))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "key", "_level"))).over(Window.partitionBy())
    return level.withColumn("_at", first["_level"]).select("key", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


def mix(df: DataFrame, size: Column, source: str = "source", row_id: str = "doc_id", seed: int = SEED, cut: str = "word", keep: tuple[str, ...] = (), **shares) -> DataFrame:
    """One row per input row: ``row_id``, ``size``, ``source_size``, ``target`` and ``taken``.

    ``cut="word"`` ends each source exactly at its budget inside a document; ``cut="document"`` takes
    a document once more when at least half of it lies inside the budget.  ``taken`` is in the unit of
    ``size``; columns named in ``keep`` follow, and order rows of one id and size, as only they tell those apart.  A null source is one source, last; a null size counts as 0; an empty table gives no rows.
    """
    narrow = df.select(F.col(row_id).alias("_id"), source_key(source).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *([F.struct(*keep).alias("_kept")] if keep else [])).withColumn("_hash", seeded(seed, "_id"))
    ranked = with_rank(narrow, ["key"], ["_hash", "_id", "size", *(["_kept"] if keep else [])], {"_before_me": "size"}, tag="mix")
    sizes = ranked.groupBy("key").agg(F.sum("size").alias("source_size"))
    out = ranked.join(targets(sizes, **shares), "key")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_before_me")
    if cut == "word":
        more = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    else:
        more = F.when((rest > 0) & (rest * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    return out.select(F.col("_id").alias(row_id), "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"), *(F.col("_kept")[c].alias(c) for c in keep))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), words("text"))


def mixing_sql(docs: str, size: str, taken: str) -> str:
    """DuckDB SQL of the mix over a relation with doc_id, source and text."""
    return f"""
 sized AS (SELECT doc_id, source, {size} AS size, substr(md5('{SEED}:' || coalesce(cast(doc_id AS varchar), '')), 1, 16) AS h FROM {docs}),
 by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
 weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * {MOST} AS cap FROM by_source),
 prefix AS (SELECT *, cap::DOUBLE / w AS ratio, (sum(source_size) OVER ())::BIGINT::DOUBLE * {SHARE}::DOUBLE AS money,
   coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT::DOUBLE AS spent,
   sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM weighed),
 levels AS (SELECT *, (money - spent) / opened AS level FROM prefix),
 chosen AS (SELECT (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS at_level),
 targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(at_level * w, cap::DOUBLE)) AS target FROM levels, chosen),
 ordered AS (SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
   CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
   (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
   FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
 mixed AS (SELECT doc_id, size, source_size, target, (epochs * size + {taken})::BIGINT AS taken FROM ordered)"""


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"
BY_WORD_SQL = "greatest(0, least(size, budget - epochs * source_size - before))"
BY_DOCUMENT_SQL = "CASE WHEN budget - epochs * source_size - before > 0 AND (budget - epochs * source_size - before) * 2 >= size THEN size ELSE 0 END"

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": f"WITH {mixing_sql('documents', WORDS_SQL, BY_WORD_SQL)} SELECT * FROM mixed"}
