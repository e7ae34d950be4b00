"""Queries of pass@k, avg@k and the tables made from them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import potential as P
from ..registry import query
from .surrogates import REGEN_SQL, pass_sql, regen, table

KS = (1, 2, 4, 8, 16, 32, 64)
KS_SQL = f"ks AS (SELECT unnest({list(KS)}) AS k)"


def by_k(df):
    """Rows by the grid of sample counts (seven literals, exploded)."""
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))


def mean_pass(df, c, *keys):
    """AGG12: mean pass@k. Instances with equal counts are one row first, so pass@k is worked out for at most n + 1 of them."""
    few = df.groupBy(*keys, "n", c).agg(F.count("*").alias("own_m"))
    p = P.pass_at_k(F.col("n"), F.col(c), F.col("k"))
    return by_k(few).groupBy(*keys, "k").agg((F.sum(p * F.col("own_m")) / F.sum("own_m")).alias("pass"), F.sum("own_m").alias("count"))


def methods(df):
    """Both deletion methods as rows."""
    return df.unpivot(["n", "is_correct", "model", "dataset"], ["c_del", "c_keep"], "method", "c").withColumn("method", F.substring("method", 3, 9))


M_SQL = "m AS (SELECT n, is_correct, model, dataset, 'del' AS method, c_del AS c FROM r UNION ALL SELECT n, is_correct, model, dataset, 'keep', c_keep FROM r)"


@query("AGG11", f"SELECT c, k, round({pass_sql('c', 'k')}, 9) AS pass FROM range(65) a(c), range(1, 71) b(k)")
def agg11(spark, d):
    g = spark.range(65).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(70)).cast("array<bigint>")).alias("k"))
    return g.select("c", "k", F.round(P.pass_at_k(F.lit(64), F.col("c"), F.col("k")), 9).alias("pass"))


@query("AGG12", f"WITH {REGEN_SQL}, {KS_SQL}, g AS (SELECT n, c_del, count(*) AS w FROM r GROUP BY ALL) SELECT k, round(sum(w*{pass_sql('c_del', 'k')})/sum(w), 9) AS pass FROM g, ks GROUP BY k")
def agg12(spark, d):
    return mean_pass(regen(spark, d), "c_del").select("k", F.round("pass", 9).alias("pass"))


@query("AGG13", f"WITH {REGEN_SQL} SELECT dataset, round(avg(CASE WHEN n = 0 THEN 0 ELSE c_del/n::DOUBLE END), 9) AS avg_k FROM r GROUP BY dataset")
def agg13(spark, d):
    return regen(spark, d).groupBy("dataset").agg(F.round(F.avg(F.when(F.col("n") == 0, 0.0).otherwise(F.col("c_del") / F.col("n"))), 9).alias("avg_k"))


@query("AGG14", "WITH s AS (SELECT l_returnflag AS label, l_suppkey%4 AS shard, l_suppkey AS problem, count_if(l_linenumber > 2) AS c, count(*) AS n FROM lineitem GROUP BY ALL) SELECT label, sum(c)::BIGINT AS n_correct, sum(n)::BIGINT AS n_total, round(sum(c)/sum(n)::DOUBLE, 9) AS accuracy, round(avg(c/n::DOUBLE), 9) AS avg_at_n FROM s GROUP BY label")
def agg14(spark, d):
    """Shards of evaluation counts merged."""
    shards = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), (F.col("l_suppkey") % 4).alias("shard"), "l_suppkey").agg(F.count_if(F.col("l_linenumber") > 2).alias("c"), F.count("*").alias("n"))
    return shards.groupBy("label").agg(F.sum("c").alias("n_correct"), F.sum("n").alias("n_total"), F.round(F.sum("c") / F.sum("n"), 9).alias("accuracy"), F.round(F.avg(F.col("c") / F.col("n")), 9).alias("avg_at_n"))


LINES = f"{REGEN_SQL}, {M_SQL}, {KS_SQL}, g AS (SELECT method, is_correct, n, c, count(*) AS w FROM m GROUP BY ALL), ln AS (SELECT is_correct, method, k, sum(w*{pass_sql('c', 'k')})/sum(w) AS pass FROM g, ks GROUP BY ALL)"


@query("AGG15", f"WITH {LINES} SELECT is_correct, k, round(max(pass) FILTER (method='del'), 9) AS p_del, round(max(pass) FILTER (method='keep'), 9) AS p_keep, abs(max(pass) FILTER (method='del')-max(pass) FILTER (method='keep')) >= 0.005::DOUBLE AS gap FROM ln GROUP BY ALL")
def agg15(spark, d):
    wide = mean_pass(methods(regen(spark, d)), "c", "is_correct", "method").groupBy("is_correct", "k").pivot("method", ["del", "keep"]).agg(F.max("pass"))
    return wide.select("is_correct", "k", F.round("del", 9).alias("p_del"), F.round("keep", 9).alias("p_keep"), (F.abs(F.col("del") - F.col("keep")) >= 0.005).alias("gap"))


# Four methods with stub rows for what was not run (J9).


def _with_stubs(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("path_id"))
    each = o.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("cliff", "critical", "tangent", "random")])))
    size = F.when(F.col("method") == "cliff", 2).when(F.col("method") == "critical", 3).when(F.col("method") == "tangent", 5).otherwise(1)
    results = each.where(F.col("path_id") % size == 0).withColumns({"c": (F.col("path_id") % 65).cast("int"), "_stub": F.lit(False)})
    missing = each.join(results, ["path_id", "method"], "left_anti").withColumns({"c": F.lit(0), "_stub": F.lit(True)})
    return results.unionByName(missing).withColumn("n", F.lit(64))


STUBS = "po AS (SELECT o_orderkey AS path_id FROM orders WHERE o_orderstatus <> 'O'), st AS (SELECT path_id, method, CASE WHEN path_id % z = 0 THEN (path_id%65)::INTEGER ELSE 0 END AS c, path_id % z <> 0 AS _stub, 64 AS n FROM po, (SELECT unnest(['cliff', 'critical', 'tangent', 'random']) AS method, unnest([2, 3, 5, 1]) AS z))"


@query("J9", f"WITH {STUBS} SELECT path_id, method, c, _stub FROM st")
def j9(spark, d):
    return _with_stubs(spark, d).select("path_id", "method", "c", "_stub")


@query("AGG16", f"WITH {STUBS}, {KS_SQL}, g AS (SELECT method, n, c, count(*) AS w, count_if(NOT _stub) AS own FROM st GROUP BY ALL) SELECT method, k, round(sum(w*{pass_sql('c', 'k')})/sum(w), 9) AS pass, sum(w)::BIGINT AS n_paths, round(sum(own)/sum(w)::DOUBLE, 9) AS upper_bound, round(sum(w*c)/sum(w*n)::DOUBLE, 9) AS avg_k FROM g, ks GROUP BY ALL")
def agg16(spark, d):
    few = _with_stubs(spark, d).groupBy("method", "n", "c").agg(F.count("*").alias("w"), F.count_if(~F.col("_stub")).alias("own"))
    p = P.pass_at_k(F.col("n"), F.col("c"), F.col("k"))
    return by_k(few).groupBy("method", "k").agg(F.round(F.sum(p * F.col("w")) / F.sum("w"), 9).alias("pass"), F.sum("w").alias("n_paths"), F.round(F.sum("own") / F.sum("w"), 9).alias("upper_bound"), F.round(F.sum(F.col("w") * F.col("c")) / F.sum(F.col("w") * F.col("n")), 9).alias("avg_k"))


@query("AGG18", f"WITH {REGEN_SQL}, g AS (SELECT model, dataset, n, c_del, count(*) AS w FROM r GROUP BY ALL) SELECT model, coalesce(dataset, 'all') AS dataset, sum(w)::BIGINT AS n, round(sum(w*{pass_sql('c_del', '1')})/sum(w), 3) AS pass_1, round(sum(w*{pass_sql('c_del', '64')})/sum(w), 3) AS pass_64 FROM g GROUP BY GROUPING SETS ((model), (model, dataset))")
def agg18(spark, d):
    few = regen(spark, d).groupBy("model", "dataset", "n", "c_del").agg(F.count("*").alias("w"))
    one = few.withColumns({f"p{k}": P.pass_at_k(F.col("n"), F.col("c_del"), F.lit(k)) for k in (1, 64)})
    mean = lambda c: F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 3)
    both = one.groupingSets([[F.col("model")], [F.col("model"), F.col("dataset")]], "model", "dataset").agg(F.sum("w").alias("n"), mean("p1").alias("pass_1"), mean("p64").alias("pass_64"))
    return both.select("model", F.coalesce("dataset", F.lit("all")).alias("dataset"), "n", "pass_1", "pass_64")


@query("AGG19", f"WITH {REGEN_SQL}, sp AS (SELECT * FROM (SELECT unnest(['O', 'F', 'X']) AS model), (SELECT unnest(['A', 'N', 'R']) AS dataset)), g AS (SELECT model, dataset, count(*) AS n, count_if(NOT is_correct) AS f, avg(c_del/64::DOUBLE) FILTER (NOT is_correct) AS p FROM r GROUP BY ALL) SELECT sp.model, sp.dataset, CASE WHEN sp.model = 'X' THEN 'no_rollout' WHEN n IS NULL THEN 'no_cliffs' WHEN f = 0 THEN 'no_failures' ELSE 'ok' END AS status, CASE WHEN f > 0 THEN round(p, 9) END AS pass_1 FROM sp LEFT JOIN g ON g.model = sp.model AND g.dataset = sp.dataset")
def agg19(spark, d):
    """A grid of models and datasets with what each cell lacks."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, "OFX"))).alias("model")).select("model", F.explode(F.array(*map(F.lit, "ANR"))).alias("dataset"))
    fail = ~F.col("is_correct")
    g = regen(spark, d).groupBy("model", "dataset").agg(F.count("*").alias("n"), F.count_if(fail).alias("f"), F.avg(F.when(fail, F.col("c_del") / 64)).alias("p"))
    status = F.when(F.col("model") == "X", "no_rollout").when(F.col("n").isNull(), "no_cliffs").when(F.col("f") == 0, "no_failures").otherwise("ok")
    return one.join(g, ["model", "dataset"], "left").select("model", "dataset", status.alias("status"), F.when(F.col("f") > 0, F.round("p", 9)).alias("pass_1"))


@query("AGG20", f"WITH {STUBS}, {KS_SQL}, g AS (SELECT method, n, c, count(*) AS w FROM st GROUP BY ALL), p AS (SELECT method, k, sum(w*{pass_sql('c', 'k')})/sum(w) AS pass, sum(w) AS w FROM g, ks GROUP BY ALL) SELECT k, " + ", ".join(f"round(max(pass) FILTER (method='{m}'), 9) AS {m}" for m in ("cliff", "critical", "tangent", "random")) + ", max(w)::BIGINT AS n_paths FROM p GROUP BY k")
def agg20(spark, d):
    long = mean_pass(_with_stubs(spark, d), "c", "method")
    names = ["cliff", "critical", "tangent", "random"]
    wide = long.groupBy("k").pivot("method", names).agg(F.max("pass"))
    return wide.join(long.groupBy("k").agg(F.max("count").alias("n_paths")), "k").select("k", *[F.round(m, 9).alias(m) for m in names], "n_paths")


@query("AGG46", f"WITH {LINES} SELECT method, is_correct, round(max(pass) FILTER (k=1), 9) AS pass_1, round(max(pass) FILTER (k=64), 9) AS pass_64 FROM ln GROUP BY ALL")
def agg46(spark, d):
    p = mean_pass(methods(regen(spark, d)), "c", "method", "is_correct")
    return p.where("k in (1, 64)").groupBy("method", "is_correct").pivot("k", [1, 64]).agg(F.max("pass")).select("method", "is_correct", F.round("1", 9).alias("pass_1"), F.round("64", 9).alias("pass_64"))


@query("AGG43", f"WITH {LINES} SELECT method, is_correct, k, round(pass, 6) AS pass FROM ln")
def agg43(spark, d):
    """A map from k to pass@k a row, as stored, made long again."""
    p = mean_pass(methods(regen(spark, d)), "c", "method", "is_correct")
    nested = p.groupBy("method", "is_correct").agg(F.map_from_entries(F.collect_list(F.struct("k", "pass"))).alias("curve"))
    return nested.select("method", "is_correct", F.explode("curve").alias("k", "pass")).withColumn("pass", F.round("pass", 6))


ACC = "a AS (SELECT 't'||(o_orderkey%3) AS temperature, 'm'||(o_custkey%3) AS model, o_orderpriority AS dataset, (o_orderkey%5 < 3) AS ok, o_totalprice AS len FROM orders)"


def _acc(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("t"), F.col("o_orderkey") % 3).alias("temperature"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"), F.col("o_orderpriority").alias("dataset"), (F.col("o_orderkey") % 5 < 3).alias("ok"), F.col("o_totalprice").alias("len"))


MODELS = ("m0", "m1", "m2")


@query("AGG40", f"WITH {ACC} SELECT temperature, dataset, " + ", ".join(f"round(avg(ok::INTEGER) FILTER (model='{m}'), 9) AS {m}" for m in MODELS) + " FROM a GROUP BY ALL")
def agg40(spark, d):
    wide = _acc(spark, d).groupBy("temperature", "dataset").pivot("model", list(MODELS)).agg(F.avg(F.col("ok").cast("int")))
    return wide.select("temperature", "dataset", *[F.round(m, 9).alias(m) for m in MODELS])


@query("AGG41", f"WITH {ACC} SELECT model, dataset, count(*) AS n, round(avg(ok::INTEGER), 9) AS accuracy, round(avg(len), 4) AS mean_length FROM a GROUP BY ALL")
def agg41(spark, d):
    return _acc(spark, d).groupBy("model", "dataset").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("accuracy"), F.round(F.avg("len"), 4).alias("mean_length"))


@query("AGG45", f"WITH {ACC}, g AS (SELECT dataset, model, avg(ok::INTEGER) AS p FROM a GROUP BY ALL) SELECT dataset, round(max(p) FILTER (model='m0'), 9) AS baseline, round(max(p) FILTER (model='m1')-max(p) FILTER (model='m0'), 9) AS m1_gain, round(max(p) FILTER (model='m2')-max(p) FILTER (model='m0'), 9) AS m2_gain FROM g GROUP BY dataset")
def agg45(spark, d):
    """Labels against the baseline on each dataset."""
    wide = _acc(spark, d).groupBy("dataset").pivot("model", list(MODELS)).agg(F.avg(F.col("ok").cast("int")))
    return wide.select("dataset", F.round("m0", 9).alias("baseline"), *[F.round(F.col(m) - F.col("m0"), 9).alias(f"{m}_gain") for m in MODELS[1:]])


ACCURACIES = """v AS (SELECT 'm'||(o_custkey%4) AS model, CASE o_orderkey%7 WHEN 0 THEN 'GSM1K' WHEN 1 THEN 'MATH500' WHEN 2 THEN 'AIME24' WHEN 3 THEN 'AIME25' WHEN 4 THEN 'AIME25_SE' WHEN 5 THEN 'GSM1K_n' ELSE 'MATH500_SE' END AS dataset, max(o_orderkey%1000)::VARCHAR AS value
  FROM orders WHERE NOT (o_custkey%4 = 1 AND o_orderkey%7 IN (1, 4)) AND NOT (o_custkey%4 = 2 AND o_orderkey%7 IN (0, 2, 3)) AND o_custkey%4 < 3 GROUP BY ALL)"""


@query("J16", f"""WITH {ACCURACIES}, m AS (SELECT 'm'||(o_custkey%4) AS model, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT model, max_by(value, dataset) AS a FROM v WHERE starts_with(dataset, 'AIME') AND NOT ends_with(dataset, '_SE') GROUP BY model),
  e AS (SELECT model, max_by(value, dataset) AS e FROM v WHERE starts_with(dataset, 'AIME') AND ends_with(dataset, '_SE') GROUP BY model)
  SELECT m.model, n, coalesce((SELECT value FROM v WHERE v.model = m.model AND dataset = 'GSM1K'), '-') AS gsm1k, coalesce((SELECT value FROM v WHERE v.model = m.model AND dataset = 'MATH500'), '-') AS math500,
    CASE WHEN a IS NULL THEN '-' WHEN e IS NULL THEN a ELSE a||'('||e||')' END AS aime FROM m LEFT JOIN a ON a.model = m.model LEFT JOIN e ON e.model = m.model""")
def j16(spark, d):
    """Accuracies looked up for a summary, with their standard errors; a dash where there is none."""
    from ..operators import summary

    o = table(spark, d, "orders").select(F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("model"), (F.col("o_custkey") % 4).alias("c"), (F.col("o_orderkey") % 7).alias("k"), "o_orderkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("GSM1K", "MATH500", "AIME24", "AIME25", "AIME25_SE", "GSM1K_n", "MATH500_SE")]), (F.col("k") + 1).cast("int"))
    kept = o.where("not (c = 1 and k in (1, 4)) and not (c = 2 and k in (0, 2, 3)) and c < 3")
    found = kept.groupBy("model", name.alias("dataset")).agg(F.max(F.col("o_orderkey") % 1000).cast("string").alias("value"))
    return summary.accuracy_cells(o.groupBy("model").agg(F.count("*").alias("n")), found)


@query("TOP8", "SELECT l_orderkey, l_linenumber, min(l_suppkey) FILTER (l_suppkey % 3 = 0) AS first_correct FROM lineitem GROUP BY ALL HAVING count_if(l_suppkey % 3 = 0) > 0")
def top8(spark, d):
    """First correct response of each key: in an array of (response, correct), the first that is."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("l_suppkey", (F.col("l_suppkey") % 3 == 0).alias("ok")))).alias("own"))
    return rows.select("l_orderkey", "l_linenumber", F.expr("get(filter(own, x -> x.ok), 0).l_suppkey").alias("first_correct")).where("first_correct is not null")


@query("PRJ1", "SELECT coalesce(q = 1, false) AS as_incorrect, coalesce(q = 1, true) AS as_correct, count(*) AS n FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL")
def prj1(spark, d):
    """Missing correctness counts as incorrect in one filter and as correct in the other; both defaults."""
    q = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("q")), "doc_id", "left")
    return q.groupBy(F.coalesce("q", F.lit(False)).alias("as_incorrect"), F.coalesce("q", F.lit(True)).alias("as_correct")).agg(F.count("*").alias("n"))


@query("SNK2", f"WITH {REGEN_SQL} SELECT CASE WHEN is_correct THEN 'success' ELSE 'failure' END AS split, count(*) AS n, sum(c_del)::BIGINT AS total FROM r GROUP BY ALL")
def snk2(spark, d):
    """One dataset partitioned by outcome, written and read again."""
    from ..sources import files

    at = files.scratch(spark, "split")
    files.write_split(regen(spark, d), at)
    back = spark.read.parquet(at)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("c_del").alias("total"))


@query("SNK5", f"WITH {REGEN_SQL} SELECT model, " + ", ".join(f"round(avg(c_del) FILTER (dataset='{x}' AND is_correct={b}), 6) AS {x}_{b}" for x in "ANR" for b in ("true", "false")) + " FROM r GROUP BY model")
def snk5(spark, d):
    """A wide table of two levels."""
    r = regen(spark, d)
    return r.groupBy("model").agg(*[F.round(F.avg(F.when((F.col("dataset") == x) & (F.col("is_correct") == (b == "true")), F.col("c_del"))), 6).alias(f"{x}_{b}") for x in "ANR" for b in ("true", "false")])


@query("DST15", "SELECT l_quantity-l_linenumber AS distance, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(l_orderkey), l_quantity-l_linenumber) AS place FROM lineitem GROUP BY 1")
def dst15(spark, d):
    """Values by count, first seen first among equals."""
    from ..operators import summary

    return summary.value_counts(table(spark, d, "lineitem").select((F.col("l_quantity") - F.col("l_linenumber")).alias("distance"), "l_orderkey"), "distance", "l_orderkey")
