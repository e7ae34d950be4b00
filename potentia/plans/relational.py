"""Queries of merges, sets, samples, shards and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from ..registry import query
from .surrogates import table


@query("SET1", "SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL")
def set1(spark, d):
    return R.last_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_suppkey").alias("shard")), ["l_orderkey", "l_linenumber"], "shard").drop("shard")


@query("SET2", "SELECT o_orderkey AS key, 'orders' AS run FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem")
def set2(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit("orders").alias("run"))
    return a.unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("lineitem").alias("run")))


@query("SET3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set3(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SET4", "SELECT DISTINCT p_brand, p_size FROM part WHERE (p_brand, p_size) NOT IN (SELECT p_brand, p_size FROM part WHERE p_retailprice > 1000)")
def set4(spark, d):
    p = table(spark, d, "part")
    return R.pending(p.select("p_brand", "p_size").distinct(), p.where("p_retailprice > 1000"), ["p_brand", "p_size"])


@query("SET5", "SELECT n_name FROM nation EXCEPT ALL SELECT n_name FROM nation WHERE n_regionkey IN (0, 2)")
def set5(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_name").exceptAll(n.where(F.col("n_regionkey").isin(0, 2)).select("n_name"))


@query("SET6", "SELECT c_mktsegment AS name FROM customer UNION SELECT o_orderpriority FROM orders")
def set6(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).union(table(spark, d, "orders").select("o_orderpriority")).distinct()


@query("SET7", "SELECT c_custkey, c_custkey % 3 = 0 AS cached, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS value FROM customer")
def set7(spark, d):
    c = table(spark, d, "customer")
    cache = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(True).alias("cached"), F.col("c_acctbal").alias("value"))
    return R.with_cache(c, cache, ["c_custkey"], lambda rows: rows.select("c_custkey", F.lit(False).alias("cached"), (F.col("c_acctbal") + 1).alias("value")))


@query("SMP1", "SELECT p_partkey FROM part ORDER BY md5('42:'||p_partkey), p_partkey LIMIT 150")
def smp1(spark, d):
    return R.sample(table(spark, d, "part").select("p_partkey"), "p_partkey", 150)


@query("SMP3", "SELECT o_orderkey FROM orders ORDER BY md5('42:'||o_orderkey), o_orderkey LIMIT 100")
def smp3(spark, d):
    return R.sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


QUOTAS = {1: 8, 2: 18, 3: 21, 4: 26, 5: 27}


@query("SMP2", "WITH p AS (SELECT p_partkey AS id, 1+p_size%5 AS level FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('42:'||id), id) AS r FROM p) SELECT id, level FROM q WHERE r <= CASE level WHEN 1 THEN 8 WHEN 2 THEN 18 WHEN 3 THEN 21 WHEN 4 THEN 26 ELSE 27 END")
def smp2(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (1 + F.col("p_size") % 5).alias("level"))
    return R.sample_by(p, "id", "level", QUOTAS)


@query("SMP5", "SELECT o_orderkey, ('0x'||substr(md5('42:'||o_orderkey), 1, 8))::BIGINT/4294967296::DOUBLE < 0.1::DOUBLE AS is_eval FROM orders")
def smp5(spark, d):
    return R.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


def _units(spark, d):
    """Work units: a source's documents in a language, weighed by size."""
    return table(spark, d, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("unit")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def _lpt_sql(weight: str, tie: str) -> str:
    """Heaviest first to the shard of the least (load, tie, number), a unit a step."""
    pick = f"list_min(list_transform(range(8), lambda j: (l.load[j + 1] * 1000 + {tie}) * 10 + j)) % 10"
    return f"""WITH RECURSIVE u AS (SELECT concat_ws('/', source, lang) AS unit, {weight} AS weight FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, unit) AS k FROM u),
  l AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS unit, 0::BIGINT AS weight, list_transform(range(8), lambda j: 0::BIGINT) AS load, list_transform(range(8), lambda j: 0::BIGINT) AS n, 0::BIGINT AS shard
    UNION ALL SELECT k, unit, weight, list_transform(load, lambda x, i: CASE WHEN i - 1 = p THEN x + weight ELSE x END), list_transform(n, lambda x, i: CASE WHEN i - 1 = p THEN x + 1 ELSE x END), p
      FROM (SELECT r.k, r.unit, r.weight, l.load, l.n, {pick} AS p FROM l JOIN r ON r.k = l.k + 1))"""


@query("SMP6", _lpt_sql("(count(*)*20+1)::BIGINT", "l.n[j + 1]") + " SELECT unit, weight, shard::INTEGER AS shard FROM l WHERE k > 0")
def smp6(spark, d):
    return R.balanced_shards(_units(spark, d).withColumn("weight", F.col("docs") * 20 + 1), "unit", "weight", 8)


@query("SMP7", _lpt_sql("sum(n_chars)::BIGINT", "0") + " SELECT unit, weight AS chars, shard::INTEGER AS shard FROM l WHERE k > 0")
def smp7(spark, d):
    return R.balanced_shards(_units(spark, d), "unit", "chars", 8, even_counts=False)


@query("SMP8", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey)-1) % 8 AS shard FROM orders")
def smp8(spark, d):
    return R.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", (F.col("n") % 8).cast("long").alias("shard"))


@query("PRJ11", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS n FROM orders) WHERE n % 7 = 3 OR n < 10")
def prj11(spark, d):
    """A stride and a prefix of the ordered rows."""
    return R.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("n % 7 = 3 or n < 10").select("o_orderkey")


@query("SMP9", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:'||event_id), event_id) AS r FROM events) WHERE r <= 500")
def smp9(spark, d):
    """At most 500 of each type, for a density plot."""
    e = table(spark, d, "events").select("event_type", "event_id").withColumn("own_d", R.draw(F.col("event_id"), 42))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("own_d", "event_id"))).where("r <= 500").select("event_type", "event_id")


@query("J15", "SELECT a.r_name AS source, b.r_name AS eval, n.n_name AS dataset FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey JOIN nation n ON n.n_regionkey = a.r_regionkey")
def j15(spark, d):
    """All pairs of different models on the source's datasets. The regions are five rows, collected in one array a nation's key."""
    r = table(spark, d, "region")
    names = r.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))).alias("all")).withColumn("one", F.lit(1))
    pairs = r.withColumn("one", F.lit(1)).join(F.broadcast(names), "one").select(F.col("r_regionkey"), F.col("r_name").alias("source"), F.explode("all").alias("e")).where("e.k <> r_regionkey")
    return pairs.join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("source", F.col("e.n").alias("eval"), F.col("n_name").alias("dataset"))


@query("TOP5", "SELECT c_mktsegment, row_number() OVER (ORDER BY coalesce(list_position(['MACHINERY', 'BUILDING'], c_mktsegment), 999), c_mktsegment) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def top5(spark, d):
    """A given display order; names that it lacks follow, sorted. One row a name is ordered."""
    order = F.coalesce(F.nullif(F.array_position(F.array(F.lit("MACHINERY"), F.lit("BUILDING")), F.col("c_mktsegment")), F.lit(0)), F.lit(999))
    names = table(spark, d, "customer").select("c_mktsegment").distinct()
    return names.select("c_mktsegment", F.row_number().over(Window.orderBy(order, "c_mktsegment")).cast("long").alias("place"))


@query("TOP7", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id)-1 AS place FROM documents")
def top7(spark, d):
    """Requests by length."""
    return R.numbered(table(spark, d, "documents").select("n_chars", "doc_id"), "n_chars", "doc_id").select("doc_id", F.col("n").cast("long").alias("place"))


@query("TOP9", "SELECT ab, o_orderkey FROM (SELECT CASE WHEN o_totalprice < 150000 THEN 'A' ELSE 'B' END AS ab, o_orderkey, row_number() OVER (PARTITION BY CASE WHEN o_totalprice < 150000 THEN 'A' ELSE 'B' END ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5")
def top9(spark, d):
    """The first examples of each case."""
    ab = F.when(F.col("o_totalprice") < 150000, "A").otherwise("B")
    o = table(spark, d, "orders").select(ab.alias("ab"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(Window.partitionBy("ab").orderBy("o_orderkey"))).where("r <= 5").drop("r")
