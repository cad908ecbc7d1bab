"""Events from files and streams, and matches to files.

JSON lines, gzipped or not, come as one ``event`` string per row, so that a malformed one is a row
with an error and not a failed job; Parquet and typed JSON come as columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(event, event_file, event_id); the id is unique in the result, not across reads."""
    reader = spark.readStream.format("text") if streaming else spark.read.format("text")
    lines = reader.load(path).filter(F.trim("value") != "")
    out = lines.select(F.col("value").alias("event"), F.input_file_name().alias("event_file"))
    return out if streaming else out.withColumn("event_id", F.monotonically_increasing_id())


def typed_json(spark: SparkSession, path: str, schema: T.StructType | str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, streaming: bool = False) -> DataFrame:
    if not streaming:
        return spark.read.parquet(path)
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for work that takes long a row: a small file is read by one task.

    The number given here is asked for, as a filter would else be moved before the dealing, and done by that task.
    """
    mark = "_dealt" + "_" * max((len(c) for c in df.columns if c.lower().startswith("_dealt")), default=0)
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    return dealt.withColumn(mark, F.monotonically_increasing_id()).filter(F.col(mark) >= 0).drop(mark)


def as_event(df: DataFrame, nulls: bool = False, into: str = "event") -> DataFrame:
    """Each row as one JSON event; with ``nulls`` a NULL is written, else left out."""
    return df.withColumn(into, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": str(not nulls).lower()}))


def write_matches(matches: DataFrame, path: str, by: str = "pattern_id") -> None:
    """Long-form matches, one folder per pattern."""
    matches.write.mode("overwrite").partitionBy(by).parquet(path)
