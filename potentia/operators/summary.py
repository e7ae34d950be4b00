"""Lookups and layouts of summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import numbered


def accuracy_cells(rows: DataFrame, accuracies: DataFrame) -> DataFrame:
    """J16: rows (model) with the columns gsm1k, math500 and aime from accuracies (model, dataset, value: text).

    aime is the value of the last dataset (by name) that begins with AIME, with that of the last AIME..._SE in parentheses if there is
    one. What there is no value for is a dash.
    """
    name = F.col("dataset")
    aime, se = F.startswith(name, F.lit("AIME")), F.endswith(name, F.lit("_SE"))
    pick = lambda where: F.max_by(F.when(where, F.col("value")), F.when(where & F.col("value").isNotNull(), name))
    own = accuracies.groupBy("model").agg(pick(name == "GSM1K").alias("gsm1k"), pick(name == "MATH500").alias("math500"), pick(aime & ~se).alias("own_a"), pick(aime & se).alias("own_se"))
    cell = F.concat("own_a", F.coalesce(F.concat(F.lit("("), "own_se", F.lit(")")), F.lit("")))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return rows.join(own, "model", "left").withColumns({"gsm1k": dash(F.col("gsm1k")), "math500": dash(F.col("math500")), "aime": dash(cell)}).drop("own_a", "own_se")


def accuracy_rows(wide: DataFrame, key: str = "model") -> DataFrame:
    """SRC12: a wide table of accuracies (text) made long: model, dataset, accuracy; count columns (_n, _n_problems) and dashes are left out."""
    names = [c for c in wide.columns if c != key and not c.endswith(("_n", "_n_problems"))]
    return wide.unpivot([key], names, "dataset", "accuracy").where("accuracy <> '-'").withColumn("accuracy", F.col("accuracy").cast("double"))


def value_counts(df: DataFrame, column: str, seen: str) -> DataFrame:
    """DST15: distinct values with n, and their place from 1: by n, among equals the one seen first; ranked in ranges, not in one task."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"), F.min(seen).alias("own_seen")).withColumn("own_less", -F.col("n")).withColumnRenamed("n", "own_n")
    return numbered(counted, "own_less", "own_seen", column).select(column, F.col("own_n").alias("n"), (F.col("n") + 1).cast("long").alias("place"))
