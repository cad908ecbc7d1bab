"""Matching streams: the batch transformations on an unbounded DataFrame.

Matching keeps no state between events, so there is no watermark and nothing to recover but the
source's offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evmatch.operators.registry import PatternSet


def match_stream(stream: DataFrame, patterns: PatternSet, key: list[str]) -> DataFrame:
    """(*key, pattern_id) of a stream, as appended rows.

    Few patterns are expressions; many are joins of the stream with static tables of terms, if fields without
    arrays allow it, and else expressions too.
    """
    return patterns.match_long(stream, key, plan="stream")


def match_with_current(stream: DataFrame, patterns: Callable[[], PatternSet], key: list[str], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes matches to Parquet, asking for the patterns anew for every micro-batch.

    A batch's folder is overwritten when it is tried again, so each is there exactly once.
    """

    def one(batch: DataFrame, n: int) -> None:
        patterns().match_long(batch, key).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
