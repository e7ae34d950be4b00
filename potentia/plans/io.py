"""Queries that write trace files to the shared scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query
from ..sources import files
from .surrogates import table


def _lines(spark, d, broken=False):
    """Customers as JSON lines, a blank line after each; broken adds lines without key and lines cut short."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", "c_name").alias("tags"))
    j = F.to_json(F.struct("c_custkey", "c_name", "tags"))
    lines = [j, F.lit("")] + ([F.to_json(F.struct("c_name")), F.left(j, F.lit(9))] if broken else [])
    at = files.scratch(spark, "jsonl")
    c.select(F.explode(F.array(*lines)).alias("value")).write.text(at)
    return at


SCHEMA = "c_custkey long, c_name string, tags array<string>"
CUSTOMERS = "SELECT c_custkey, c_name, [c_mktsegment, c_name] AS tags FROM customer"


@query("SRC1", CUSTOMERS)
def src1(spark, d):
    return files.scan_jsonl(spark, _lines(spark, d), SCHEMA)


@query("SRC2", CUSTOMERS)
def src2(spark, d):
    """Arrays of customers, one file a group of keys."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", "c_name").alias("tags"))
    at = files.scratch(spark, "json")
    groups = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("g")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "tags"))).alias("value"))
    groups.withColumn("part", F.col("g")).select("value", "part").write.partitionBy("part").text(at)
    return files.scan_json_array(spark, at, SCHEMA).select("c_custkey", "c_name", "tags")


@query("SRC3", CUSTOMERS)
def src3(spark, d):
    return files.scan_jsonl_tolerant(spark, _lines(spark, d, True), SCHEMA, "c_custkey")


@query("SRC4", "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 0::DOUBLE ELSE o_totalprice END AS price, o_orderkey%2=0 AS flag, CASE WHEN o_orderkey%5=0 THEN -1 ELSE o_custkey::INTEGER END AS cust FROM orders")
def src4(spark, d):
    at = files.scratch(spark, "csv")
    flag = F.when(F.col("o_orderkey") % 2 == 0, F.element_at(F.array(*map(F.lit, ("1", "true", " T ", "Yes", "y"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).otherwise("no")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price"), flag.alias("flag"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")).alias("cust"))
    files.write_csv(o, at)
    return files.scan_csv(spark, at, {"o_orderkey": ("bigint", 0), "price": ("double", 0.0), "flag": ("boolean", False), "cust": ("int", -1)})


def _runs(spark, d):
    at = files.scratch(spark, "runs")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"), F.concat(F.lit("d"), F.col("o_custkey") % 2).alias("dataset"), F.concat(F.lit("2026010"), F.col("o_orderkey") % 4).alias("run"))
    o.select("o_orderkey", F.concat_ws("__", "model", "dataset", "run").alias("name")).write.partitionBy("name").parquet(at)
    return files.discover_runs(spark.read.parquet(at), r"name=(\w+?)__(\w+?)__(\d+)", ["model", "dataset", "run"])


@query("SRC5", "SELECT o_orderkey, 'm'||(o_custkey%3) AS model, 'd'||(o_custkey%2) AS dataset, '2026010'||(o_orderkey%4) AS run FROM orders")
def src5(spark, d):
    return _runs(spark, d).select("o_orderkey", "model", "dataset", "run")


@query("SRC6", "SELECT o_orderkey, 'm'||(o_custkey%3) AS model, '20260103' AS run FROM orders WHERE o_orderkey%4 = 3")
def src6(spark, d):
    return files.latest(_runs(spark, d), ["model"], "run").select("o_orderkey", "model", "run")


@query("SRC8", "SELECT o_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def src8(spark, d):
    """Nested rows kept as JSON text, and built up again."""
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("cached"))
    rows = nested.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", F.from_json("cached", "array<struct<l_partkey: long, l_quantity: double>>").alias("a"))
    return rows.select("o_orderkey", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["l_partkey"]).alias("total"))


@query("SRC11", "SELECT label, count(*) AS n, round(sum(list_sum(embedding)), 3) AS total FROM embeddings GROUP BY label")
def src11(spark, d):
    """A column store of arrays, written and read."""
    at = files.scratch(spark, "arrays")
    table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).write.parquet(at)
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return spark.read.parquet(at).groupBy("label").agg(F.count("*").alias("n"), F.round(total, 3).alias("total"))


@query("SNK1", "SELECT 'rows' AS kind, p_partkey, p_name FROM part")
def snk1(spark, d):
    """Written as CSV and read; an empty table still has its header."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    full, empty = files.scratch(spark, "csv"), files.scratch(spark, "csv")
    files.write_csv(p, full)
    files.write_csv(p.where("p_partkey < 0"), empty)
    assert spark.read.option("header", True).csv(empty).columns == p.columns
    return spark.read.option("header", True).schema("p_partkey long, p_name string").csv(full).select(F.lit("rows").alias("kind"), "p_partkey", "p_name")


@query("SNK3", "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 1 ELSE 2 END AS attempt FROM orders")
def snk3(spark, d):
    """A run that stopped after a third of the keys, resumed: the checkpoint has every key once."""
    at = files.scratch(spark, "checkpoint")
    o = table(spark, d, "orders").select("o_orderkey")
    files.append_checkpoint(o.where("o_orderkey % 3 = 0").withColumn("attempt", F.lit(1)), at)
    files.append_checkpoint(R.pending(o, spark.read.parquet(at), ["o_orderkey"]).withColumn("attempt", F.lit(2)), at)
    return spark.read.parquet(at)


@query("SNK4", "SELECT s_suppkey::VARCHAR AS key, s_name AS name, '' AS brand FROM supplier UNION ALL SELECT p_partkey::VARCHAR, '', p_brand FROM part")
def snk4(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return files.union_of_keys(["key"], s, table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")))
