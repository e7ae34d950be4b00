"""Sequence operators over long tables of tokens: one row a token, ordered by pos within key.

Every operator uses one window specification a key, so a chain of them shares its exchange and its sort. Keys are
path identifiers: a path is bounded by the model's context, so a window never holds more than one response.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import potential as P


def by_path(key: str = "path_id", pos: str = "pos"):
    return Window.partitionBy(key).orderBy(pos)


def pairs(tokens: DataFrame, key: str = "path_id") -> DataFrame:
    """SEQ1: consecutive scored positions, gaps skipped."""
    w = by_path(key)
    scored = tokens.where("score is not null").withColumns({"prev_pos": F.lag("pos").over(w), "prev_score": F.lag("score").over(w)})
    return scored.where("prev_pos is not null")


def with_k(pairs: DataFrame, n: int = P.ROLLOUTS) -> DataFrame:
    """SEQ2: both scores of a pair as successes of n."""
    return pairs.withColumns({"k_prev": P.score_to_k(F.col("prev_score"), n), "k_now": P.score_to_k(F.col("score"), n)})


def significant(tokens: DataFrame, key: str = "path_id", n: int = P.ROLLOUTS, **test) -> DataFrame:
    """SEQ3 and SEQ5: pairs whose drop passes the test."""
    return with_k(pairs(tokens, key), n).where(P.is_cliff(F.col("k_prev"), F.col("k_now"), n, **test)).withColumn("drop", F.col("prev_score") - F.col("score"))


def profile(tokens: DataFrame, *keys: str, n: int = P.ROLLOUTS) -> DataFrame:
    """A row a path in one pass: its last token, its length, and how many significant drops it has (SEQ5 counted).

    The score before is the last one that isn't null, so scored and unscored rows share one exchange and one sort.
    """
    before = F.last("score", ignorenulls=True).over(by_path(keys[0]).rowsBetween(Window.unboundedPreceding, -1))
    marked = tokens.withColumn("own_before", before)
    hit = F.col("score").isNotNull() & F.col("own_before").isNotNull() & P.is_cliff(P.score_to_k(F.col("own_before"), n), P.score_to_k(F.col("score"), n), n)
    return marked.groupBy(*keys).agg(F.max_by("token", "pos").alias("last_token"), F.max("pos").alias("total_tokens"), F.count_if(hit).alias("n"))


def first_by(df: DataFrame, key, order: str, *columns: str) -> DataFrame:
    """The row with the least order of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(order, *columns), order).alias("own"))
    return best.select(*keys, "own.*")


def boundary_grid(spark, n: int = P.ROLLOUTS) -> DataFrame:
    """SEQ6: the test on every pair of counts (a fixed grid of n + 1 by n + 1, exploded from one row)."""
    ks = F.sequence(F.lit(0), F.lit(n))
    grid = spark.range(1).select(F.explode(ks).alias("k_prev")).select("k_prev", F.explode(ks).alias("k_now"))
    return grid.withColumn("is_cliff", P.is_cliff(F.col("k_prev"), F.col("k_now"), n))


def boundary(spark, n: int = P.ROLLOUTS) -> DataFrame:
    """SEQ6: for each k_prev the least drop in k that triggers, with how many do."""
    grid = boundary_grid(spark, n)
    return grid.groupBy("k_prev").agg(F.min(F.when(F.col("is_cliff"), F.col("k_prev") - F.col("k_now"))).alias("min_drop"), F.count_if("is_cliff").alias("cliff_cells"))


def fixed_drops(tokens: DataFrame, threshold: float, key: str = "path_id") -> DataFrame:
    """SEQ7: pairs that drop by threshold or more."""
    return pairs(tokens, key).withColumn("drop", F.col("prev_score") - F.col("score")).where(F.col("drop") >= threshold)


def largest_drop(tokens: DataFrame, key: str = "path_id") -> DataFrame:
    """SEQ8: the largest positive drop of a path, the earliest of equals."""
    drops = pairs(tokens, key).withColumn("drop", F.col("prev_score") - F.col("score")).where("drop > 0")
    best = drops.groupBy(key).agg(F.max_by(F.struct("pos", "token", "drop"), F.struct("drop", -F.col("pos"))).alias("own"))
    return best.select(key, "own.*")


def critical(tokens: DataFrame, key: str = "path_id", below: float = 0.05, later: int = 10) -> DataFrame:
    """SEQ9: the first zero after which every score stays below `below`, with the next `later` scores."""
    after = by_path(key).rowsBetween(1, Window.unboundedFollowing)
    near = by_path(key).rowsBetween(1, later)
    scored = tokens.where("score is not null").withColumns({"later_max": F.max("score").over(after), "scores_after": F.collect_list("score").over(near)})
    hits = scored.where((F.col("score") == 0) & F.coalesce(F.col("later_max") < below, F.lit(True)))
    return first_by(hits, key, "pos", "token", "scores_after")


def drop_counts(tokens: DataFrame, thresholds=(0.1, 0.2, 0.3, 0.4, 0.5), key: str = "path_id") -> DataFrame:
    """SEQ10: drops of at least each threshold."""
    drop = F.col("prev_score") - F.col("score")
    return pairs(tokens, key).groupBy(key).agg(*[F.count_if(drop >= t).alias(f"n_{int(round(t * 100))}") for t in thresholds])


def stop_after_zeros(tokens: DataFrame, run: int = 20, zero: Column | None = None, key: str = "path_id") -> DataFrame:
    """SEQ11: scores after the first run of `run` zeros become 0; adds stop_pos (null where no run is that long)."""
    zero = F.col("score") == 0 if zero is None else zero
    w = by_path(key)
    islands = tokens.withColumn("own_zero", F.coalesce(zero, F.lit(False))).withColumn("own_island", F.sum(F.when(F.col("own_zero"), 0).otherwise(1)).over(w))
    counted = islands.withColumn("own_run", F.sum(F.when(F.col("own_zero"), 1).otherwise(0)).over(Window.partitionBy(key, "own_island").orderBy("pos")))
    stop = F.min(F.when(F.col("own_run") >= run, F.col("pos"))).over(Window.partitionBy(key))
    return counted.withColumn("stop_pos", stop).withColumn("score", F.when(F.col("pos") > F.col("stop_pos"), 0.0).otherwise(F.col("score"))).drop("own_zero", "own_island", "own_run")


def sampled(tokens: DataFrame, step: int) -> DataFrame:
    """SEQ12: only positions 1, 1 + step, ... keep their score."""
    return tokens.withColumn("score", F.when(F.pmod(F.col("pos") - 1, F.lit(step)) == 0, F.col("score")))


def chunk_bounds(n: Column, chunks: int = 20) -> Column:
    """SEQ14: chunks + 1 indices from 0 to n - 1, in double steps cut to integers; [0] below two scores."""
    step = (n - 1) / F.lit(float(chunks))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(chunks)), lambda i: F.when(i == chunks, n - 1).otherwise(F.floor(i * step)).cast("long"))
    return F.when(n < 2, F.array(F.lit(0).cast("long"))).otherwise(bounds)


def paths_as_arrays(tokens: DataFrame, key: str = "path_id", *more: str) -> DataFrame:
    """One row a path: scores in order of position, and their count."""
    rows = tokens.groupBy(key, *more).agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("own"))
    return rows.select(key, *more, F.transform("own", lambda x: x["score"]).alias("scores"), F.size("own").cast("long").alias("n"))


def chunks(tokens: DataFrame, number: int = 20, least: float = 0.3, key: str = "path_id") -> DataFrame:
    """SEQ15: a row a chunk: its bounds, scores there, drop, and whether it is a tangent (drop >= least; null scores give none)."""
    rows = paths_as_arrays(tokens, key).withColumn("own_b", chunk_bounds(F.col("n"), number))
    each = rows.select(key, "scores", F.posexplode(F.expr("transform(slice(own_b, 2, size(own_b)), (e, i) -> struct(own_b[i] as start_idx, e as end_idx))")).alias("chunk", "c"))
    out = each.select(key, F.col("chunk").cast("long").alias("chunk"), "c.*", F.expr("get(scores, cast(c.start_idx as int))").alias("start_score"), F.expr("get(scores, cast(c.end_idx as int))").alias("end_score"))
    return out.withColumn("drop", F.col("start_score") - F.col("end_score")).withColumn("is_tangent", F.coalesce(F.col("drop") >= least, F.lit(False)))


def cliffs_in_chunks(chunks: DataFrame, cliffs: DataFrame, key: str = "path_id") -> DataFrame:
    """J7: cliffs (their score index is pos - 1) within the closed interval of a chunk; a cliff on a bound is in two."""
    own = cliffs.select(F.col(key).alias("own_key"), F.col("pos").alias("cliff_pos"))
    inside = (F.col("cliff_pos") - 1 >= F.col("start_idx")) & (F.col("cliff_pos") - 1 <= F.col("end_idx"))
    return chunks.join(own, (F.col(key) == F.col("own_key")) & inside).drop("own_key")


def context(tokens: DataFrame, reach: int = 10, key: str = "path_id") -> DataFrame:
    """SEQ19: the tokens before and after each, joined with spaces, and all with bars."""
    w = by_path(key)
    before, after, whole = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach), w.rowsBetween(-reach, reach)
    return tokens.withColumns({"before": F.concat_ws(" ", F.collect_list("token").over(before)), "after": F.concat_ws(" ", F.collect_list("token").over(after)), "window": F.concat_ws("|", F.collect_list("token").over(whole))})


def batches(costs: DataFrame, budget: int, group: str, order: str, cost: str) -> DataFrame:
    """SEQ21: greedy batches in order within a group: a row that would overflow the budget begins a batch; one above the budget is alone.

    Each batch depends on the one before, so a group passes through one task in order, which holds the running sum and no rows. A null cost counts as 0.
    """
    rows = costs.select(group, order, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias(cost)).repartition(group).sortWithinPartitions(group, order, cost)

    def run(parts):
        begun, own, used, batch = False, None, 0, 0
        for part in parts:
            out = []
            for g, c in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if not begun or g != own:
                    begun, own, used, batch = True, g, 0, 0
                elif used > 0 and used + c > budget:
                    used, batch = 0, batch + 1
                used += c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], names=[group, order, cost, "batch"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("batch", LongType())]))
