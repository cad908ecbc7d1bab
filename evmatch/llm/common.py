"""Helpers shared by the training-data operators.

* ``table``        reads one table of a data folder through Spark's own reader.
* ``materialize``  cuts lineage by writing a table in the shared checkpoint folder.
* ``with_rank``    positions of rows in a global order without a single-task window.
"""

from __future__ import annotations

import atexit
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evmatch.deploy import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: rows of which narrow tables take one file more
NARROW = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs an iteration again.

    Results read them lazily, so they stay until ``release`` is told that results are written, or the
    driver's Python ends.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        Scratch.made.append(self)

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Writes a table; into ``files`` files, dealt out evenly, where it is too narrow for a file a partition."""
        self.n += 1
        (df.repartition(files) if files else df).write.option("compression", "zstd").parquet(f"{self.root}/{self.n}")
        self.schema = df.schema
        return self.again()

    def again(self) -> DataFrame:
        """The last table once more, with columns of its own for a join with itself."""
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self.n}")

    def drop(self, *numbers: int) -> None:
        """Deletes tables that no later step reads."""
        for n in numbers:
            self._delete(f"/{n}")

    def _delete(self, below: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None:  # the session still runs
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}{below}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(since: int = 0) -> None:
    """Deletes the scratch tables made from the ``since``-th on; for when what reads them has been written.

    ``len(Scratch.made)`` before an operator is called is what to give after its result is written.
    """
    while len(Scratch.made) > since:
        Scratch.made.pop()._delete("")


atexit.register(release)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return Scratch(df.sparkSession, tag).put(df)


def narrow_files(spark: SparkSession, rows: int) -> int:
    """Files for a table of a few numbers for each of so many rows: they grow with the rows, not with the partitions
    of a shuffle, as on a local file system Hadoop starts two processes for each file."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // NARROW))


def words(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column | str) -> Column:
    """Never null, sorts by code point with null last."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def seeded(seed: int, *cols: str) -> Column:
    """A pseudo-random sort key that plain SQL can compute too: hex digits of an MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 16)


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of (_id, _t, _y) one row of each id, whatever the order of rows: that with the least hash of its text."""
    return rows.groupBy("_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))


def with_rank(df: DataFrame, group: list[str], order: list[str], total: dict[str, str] | None = None, tag: str = "rank") -> DataFrame:
    """Adds ``rank`` (from 0, within ``group``) and, per entry of ``total``, the exclusive running sum
    of a column under a new name.

    The rows are range-partitioned by (group, order), written once, and numbered inside their own
    partition; only one row per (partition, group) takes part in the prefix sums over partitions.
    A group that holds a third of all rows is spread over as many range partitions as its size asks for.
    """
    total = total or {}
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_pid": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    placed = materialize(placed, tag)
    here = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), *(F.sum(c).alias(f"_t_{new}") for new, c in total.items()))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0))} | {f"_b_{new}": F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)) for new in total})
    here = here.select("_pid", *group, "_first", "_before", *(f"_b_{new}" for new in total))
    out = placed.join(here, ["_pid", *group])
    out = out.withColumn("rank", F.col("_row") - F.col("_first") + F.col("_before"))
    if total:
        inside = Window.partitionBy("_pid", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({new: F.col(f"_b_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in total.items()})
    return out.drop("_pid", "_row", "_first", "_before", *(f"_b_{new}" for new in total))
