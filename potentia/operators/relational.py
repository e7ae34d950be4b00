"""Merging, sampling and sharding of keyed tables."""

from __future__ import annotations

from heapq import heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SET1: of rows with equal keys, the one with the largest order. An aggregate, so map tasks merge first."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("own"))
    return best.select(*keys, "own.*").select(*df.columns)


def pending(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """SET3 and SET4: rows whose key isn't done yet."""
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")


def with_cache(wanted: DataFrame, cache: DataFrame, keys: list[str], compute, force: bool = False) -> DataFrame:
    """SET7: cached results, and computed ones for keys that the cache lacks (for all, with force)."""
    if force:
        return compute(wanted)
    hits = cache.join(wanted.select(*keys), keys, "left_semi")
    return hits.unionByName(compute(pending(wanted, cache, keys)).select(*hits.columns))


def draw(key: Column, seed: int) -> Column:
    """The place of a key in a seeded draw: equal in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """SMP1 and SMP3: `size` rows without replacement, or all if there are no more (top-k, so no full sort)."""
    return df.withColumn("own_d", draw(F.col(key), seed)).orderBy("own_d", key).limit(size).drop("own_d")


def sample_by(df: DataFrame, key: str, stratum: str, quotas: dict, seed: int = 42) -> DataFrame:
    """SMP2: a quota from each stratum; a stratum without one gives none. Row numbers are limited before the shuffle."""
    most = max(quotas.values())
    w = Window.partitionBy(stratum).orderBy("own_d", key)
    ranked = df.where(F.col(stratum).isin(*quotas)).withColumn("own_d", draw(F.col(key), seed)).withColumn("own_r", F.row_number().over(w)).where(F.col("own_r") <= most)
    quota = F.lit(0)
    for s, q in quotas.items():
        quota = F.when(F.col(stratum) == s, q).otherwise(quota)
    return ranked.where(F.col("own_r") <= quota).drop("own_d", "own_r")


def split(df: DataFrame, key: str, share: float, seed: int = 42, least: int = 10) -> DataFrame:
    """SMP5: adds is_eval for a share of the keys, by hash; none if there are `least` rows or fewer."""
    many = df.limit(least + 1).count() > least
    point = F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return df.withColumn("is_eval", (point < share) if many else F.lit(False))


def balanced_shards(groups: DataFrame, key: str, weight: str, shards: int, *, even_counts: bool = True) -> DataFrame:
    """SMP6 and SMP7: heaviest first to the least loaded shard, ties to the one with fewer rows (with even_counts), then the first.

    Each choice depends on all before it, so the rows pass through one task in order; it holds the shards' loads, not the rows.
    Meant for work units (files, paths of a run); data that is large is dealt by repartition() and adaptive execution instead.
    """
    rows = groups.select(key, F.col(weight).cast("long").alias(weight)).repartition(1).sortWithinPartitions(F.desc(weight), key)

    def run(batches):
        heap = [(0, 0, i) for i in range(shards)]
        for batch in batches:
            out = []
            for w in batch.column(1).to_pylist():
                load, n, i = heap[0]
                heapreplace(heap, (load + (w or 0), n + even_counts, i))
                out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[key, weight, "shard"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("shard", IntegerType())]))


def _ranges(df: DataFrame, order: tuple[str, ...], buckets: int, value: Column) -> Column:
    """The range, from 0 to buckets - 1 at most, of a value (a struct of the order). Its bounds come from 100 random rows a bucket."""
    drawn = df.select(F.struct(*order).alias("own_v")).orderBy(F.rand(42)).limit(100 * buckets).agg(F.sort_array(F.collect_list("own_v")).alias("own_s"))
    picked = drawn.select(F.expr(f"array_distinct(transform(filter(sequence(1, {buckets}), i -> i * size(own_s) >= {buckets}), i -> own_s[int(i * size(own_s) / {buckets}) - 1]))").alias("own_b"))
    fields = picked.schema["own_b"].dataType.elementType.fields
    bounds = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in picked.first()["own_b"][: buckets - 1]]

    def search(lo: int, hi: int) -> Column:  # compiled, unlike a search in an array
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(value <= bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def numbered(df: DataFrame, *order: str, buckets: int = 64) -> DataFrame:
    """PRJ11 and SMP8: row number from 0 in the given order, without one task that sorts all: ranges first, then offsets.

    Rows are split into ranges of the order; a range's offset is the sum of the counts before it. The ranges' bounds are literals, so
    that counts and rows have the same ranges: Spark's range partitioning draws its bounds anew in each branch of a plan.
    """
    valued = df.withColumn("own_v", F.struct(*order))
    ranged = valued.withColumn("own_p", _ranges(df, order, buckets, F.col("own_v"))).drop("own_v")
    local = ranged.withColumn("own_k", F.row_number().over(Window.partitionBy("own_p").orderBy(*order)))
    counts = ranged.groupBy("own_p").agg(F.count("*").alias("own_c"))  # a row a range
    before = F.coalesce(F.sum("own_c").over(Window.orderBy("own_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(counts.select("own_p", before.alias("own_b"))), "own_p").withColumn("n", F.col("own_b") + F.col("own_k") - 1).drop("own_p", "own_k", "own_b")
