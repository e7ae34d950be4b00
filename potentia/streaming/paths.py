"""Sequence operators on streams of finished paths.

A path arrives whole, in one file or one batch, so each micro-batch is worked out by the batch operators and no state is
kept between batches; results are appended to a table, which makes restarts pick up where the checkpoint ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import sequence as S


def read_paths(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of token rows from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def per_batch(stream: DataFrame, operator, to: str, checkpoint: str) -> StreamingQuery:
    """Append what a batch operator makes of each micro-batch; a batch that is run again after a failure replaces its own rows.

    For operators whose windows are keyed by path: significant drops, critical positions, chunks, profiles.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def significant_drops(tokens: DataFrame, to: str, checkpoint: str, key: str = "path_id") -> StreamingQuery:
    return per_batch(tokens, lambda batch: S.significant(batch, key), to, checkpoint)
