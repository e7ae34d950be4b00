"""Operators over candidate tables: one row a candidate token of a position, with its log-probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SQRT_2PI = 2.5066282746310002


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def partial_entropy(cands: DataFrame, key: str = "uid") -> DataFrame:
    """DST1: entropy over the listed candidates, not renormalised; infinite log-probabilities are skipped, none left gives 0."""
    term = F.when(finite(F.col("lp")), F.exp("lp") * F.col("lp"))
    return cands.groupBy(key).agg(F.coalesce(-F.sum(term), F.lit(0.0)).alias("entropy"))


def tie_ranks(cands: DataFrame, key: str = "uid", eps: float = 1e-9) -> DataFrame:
    """DST2: competition ranks (1, 1, 3); a tier holds what is within eps of its first member. A fold over a position's top k."""
    rows = cands.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("lp")).alias("neg"), "tid"))).alias("own"))
    fold = F.expr(f"""aggregate(own, named_struct('lead', cast(null as double), 'rank', 0, 'n', 0, 'out', cast(array() as array<int>)), (s, x) ->
        if(s.lead is not null and x.neg - s.lead <= {eps}D, named_struct('lead', s.lead, 'rank', s.rank, 'n', s.n + 1, 'out', concat(s.out, array(s.rank))),
           named_struct('lead', x.neg, 'rank', s.n + 1, 'n', s.n + 1, 'out', concat(s.out, array(s.n + 1)))), s -> s.out)""")
    z = rows.select(key, F.explode(F.arrays_zip(F.col("own"), fold.alias("rank"))).alias("z"))
    return z.select(key, F.col("z.own.tid").alias("tid"), (-F.col("z.own.neg")).alias("lp"), F.col("z.rank").cast("long").alias("rank"))


def top_k(cands: DataFrame, k: int, *order: Column, key: str = "uid") -> DataFrame:
    """DST4 and DST5: the first k of a position in the given order."""
    return cands.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def masses(cands: DataFrame, key: str = "uid") -> DataFrame:
    """DST6: probability of the listed candidates, and what is left for the others."""
    return cands.groupBy(key).agg(F.sum(F.exp("lp")).alias("mass")).withColumn("tail", F.greatest(F.lit(0.0), 1 - F.col("mass")))


def at_temperature(cands: DataFrame, temperatures, key: str = "uid") -> DataFrame:
    """DST7 and J8: probabilities renormalised over the listed candidates at each temperature; 0 puts all on the first largest.

    The temperatures are a short literal list, so each row is exploded over it instead of a join.
    """
    rows = cands.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    w = Window.partitionBy(key, "temperature")
    ok = finite(F.col("lp"))
    weight = F.when(ok & (F.col("temperature") > 0), F.exp((F.col("lp") - F.max(F.when(ok, F.col("lp"))).over(w)) / F.greatest(F.col("temperature"), F.lit(1e-300)))).otherwise(0.0)
    rows = rows.withColumn("own_w", weight).withColumn("own_r", F.row_number().over(w.orderBy(F.desc_nulls_last(F.when(ok, F.col("lp"))), "tid")))
    total = F.sum("own_w").over(w)
    p = F.when(F.col("temperature") == 0, F.when((F.col("own_r") == 1) & ok, 1.0).otherwise(0.0)).otherwise(F.when(total > 0, F.col("own_w") / total).otherwise(0.0))
    return rows.withColumn("p_t", p).drop("own_w", "own_r")


def running_counts(df: DataFrame, column: str, by: str, ranges: int = 64) -> DataFrame:
    """Distinct values of each group with own_c (rows), own_upto (rows up to and with it) and own_n (rows of the group); nulls are left out.

    Values are dealt into ranges at fixed quantiles (at most `ranges` numbers that the driver reads), counted by range, and
    each range gets the count of those before it: no task holds a group, whatever its size.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("own_c"))
    marks = counts.agg(F.percentile_approx(column, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000))).first()[0] or []
    at = F.lit(0)
    for mark in sorted(set(marks)):
        at = at + (F.col(column) > mark).cast("int")
    ranged = counts.withColumn("own_r", at)
    sums = ranged.groupBy(F.col(by).alias("own_by"), F.col("own_r").alias("own_at")).agg(F.sum("own_c").alias("own_s"))  # a row a group and range
    w = Window.partitionBy("own_by")
    before = F.coalesce(F.sum("own_s").over(w.orderBy("own_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("own_by", "own_at", before.alias("own_b"), F.sum("own_s").over(w).alias("own_n"))
    local = ranged.withColumn("own_k", F.sum("own_c").over(Window.partitionBy(by, "own_r").orderBy(column)))
    joined = local.join(starts, F.col(by).eqNullSafe(F.col("own_by")) & (F.col("own_r") == F.col("own_at")))
    return joined.select(by, column, "own_c", (F.col("own_b") + F.col("own_k")).alias("own_upto"), "own_n")


def quantiles(df: DataFrame, column: str, by: str, points) -> DataFrame:
    """Exact percentiles of each group, linear between values: columns p<percent>."""
    def value(place: Column) -> Column:
        return F.max(F.when((F.col("own_upto") > place) & (F.col("own_upto") - F.col("own_c") <= place), F.col(column)))

    own = []
    for p in points:
        at = F.col("own_n") - 1
        place = F.lit(float(p)) * at
        low, high, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        own.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(f"p{round(100 * p)}"))
    return running_counts(df, column, by).groupBy(by).agg(*own)


def percentiles(df: DataFrame, column: str, by: str, points) -> DataFrame:
    """DST8 and AGG29: exact percentiles, linear between values, for each group and for all of them together."""
    return quantiles(df, column, by, points).unionByName(quantiles(df.withColumn(by, F.lit("combined")), column, by, points))


def ecdf(df: DataFrame, column: str, by: str) -> DataFrame:
    """DST9: steps of the empirical distribution: each distinct value with the share of rows up to it."""
    return running_counts(df, column, by).select(by, column, (F.col("own_upto") / F.col("own_n")).alias("share"))


def kde(df: DataFrame, column: str, by: str, points: int = 400) -> DataFrame:
    """DST10: Gaussian kernel density on a grid over each group's range, Scott's bandwidth; groups of one value or less have none."""
    stats = df.groupBy(by).agg(F.count(column).alias("own_n"), F.stddev_samp(column).alias("own_s"), F.min(column).alias("own_lo"), F.max(column).alias("own_hi")).where("own_n >= 2 and own_s >= 1e-8")
    stats = stats.withColumn("own_h", F.col("own_s") * F.pow(F.col("own_n").cast("double"), F.lit(-0.2)))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.cast("long").alias("i"), (F.col("own_lo") + (F.col("own_hi") - F.col("own_lo")) * i / (points - 1)).alias("x")))
    each = df.select(by, F.col(column).alias("own_v")).join(stats, by).select(by, "own_n", "own_h", "own_v", F.explode(grid).alias("g"))
    kernel = F.exp(-F.pow((F.col("g.x") - F.col("own_v")) / F.col("own_h"), 2) / 2) / (F.col("own_n") * F.col("own_h") * SQRT_2PI)
    return each.groupBy(by, F.col("g.i").alias("i")).agg(F.first("g.x").alias("x"), F.sum(kernel).alias("density"))


def histogram(df: DataFrame, column: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """DST11: counts in equal bins, the last one closed; values outside are left out."""
    x = F.col(column)
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """DST13: n, mean, quartiles, whiskers (the farthest values within 1.5 interquartile ranges) and the number beyond them."""
    keyed = df.withColumn("own_key", F.struct(*by))
    q = quantiles(keyed, column, "own_key", (0.25, 0.5, 0.75)).select("own_key.*", F.col("p25").alias("q25"), F.col("p50").alias("median"), F.col("p75").alias("q75"))
    x, reach = F.col(column), 1.5 * (F.col("q75") - F.col("q25"))
    inside = (x >= F.col("q25") - reach) & (x <= F.col("q75") + reach)
    return df.join(q, list(by)).groupBy(*by, "q25", "median", "q75").agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outside"))


def boundary_drop(p: Column, n: int = 64, least_drop: float = 0.1, z: float = 1.645) -> Column:
    """DST16: the least drop from p that passes the test, by bisection in 100 steps; null where none does.

    The drop passes if drop > least_drop + z * sqrt(p (1-p) / n + q (1-q) / n) with q = p - drop.
    """
    def passes(drop: Column) -> Column:
        q = p - drop
        return drop > F.lit(least_drop) + F.lit(z) * F.sqrt(F.greatest(p * (1 - p) / n + q * (1 - q) / n, F.lit(0.0)))

    start = F.struct(F.lit(0.0).alias("lo"), p.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(passes(mid), F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))

    return F.when(passes(p), F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve, lambda s: s["hi"]))
