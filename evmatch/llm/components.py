"""Connected components of a link table by alternating large and small stars.

Both star steps keep the components and shorten them; the link set becomes one star per component in
a logarithmic number of rounds.  Every round is written to the shared folder, and nothing but a row
count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evmatch.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Expects a > b in every row."""
    least = links.groupBy("a").agg(F.min("b").alias("_m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(links: DataFrame, tag: str = "components", files: int | None = None) -> DataFrame:
    """From links (a, b) to (a, b) with b the smallest member of a's component, for every a but that one.

    A link with a null end or from a node to itself is ignored; no links give no rows.
    ``files`` is how many each round is written into, by default one a partition.
    """
    scratch = Scratch(links.sparkSession, tag)
    now = scratch.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    mark = size(now)
    while mark[0]:
        after = scratch.put(_small_star(_large_star(now)), files)
        scratch.drop(scratch.n - 1)
        now, before, mark = after, mark, size(after)
        if mark == before:
            break
    return now
