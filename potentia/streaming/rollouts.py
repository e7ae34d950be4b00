"""Aggregates over streams of single rollouts, kept in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R


def position_scores(rollouts: DataFrame, *keys: str, delay: str | None = None, at: str = "at") -> DataFrame:
    """AGG42 on a stream: rollouts and share of correct ones of each position so far, for output mode update (or complete).

    Rollouts that come twice (the same `rollout` of a position) count once. With `delay`, rollouts later than that behind the latest
    `at` are left out and their positions' state is given up, which bounds the state; without, it grows with the positions.
    """
    if delay:
        once = rollouts.withWatermark(at, delay).dropDuplicatesWithinWatermark([*keys, "rollout"])
    else:
        once = rollouts.dropDuplicates([*keys, "rollout"])
    return once.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if("correct") / F.count("*")).alias("score"))


def accuracy_over_time(rollouts: DataFrame, window: str, delay: str, *keys: str, at: str = "at") -> DataFrame:
    """Accuracy (AGG41) by key and time window; a window is final, and its state given up, once `delay` has passed. For output mode append."""
    per = rollouts.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), *keys)
    return per.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "accuracy")


def upsert(stream: DataFrame, to: str, checkpoint: str, keys: list[str], order: str):
    """SET1 on a stream: the row of the largest order for each key, in a table that each micro-batch replaces by a new version.

    A version is a folder of its own (version=<batch>), read together with the batch's rows to make the next; a batch that is run
    again after a failure makes the same version again. Read the largest version.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{to}/version={number - 1}").unionByName(batch)
        R.last_wins(rows, keys, order).write.mode("overwrite").parquet(f"{to}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
