"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, best_fit, exact_dedup, licenses, link_trust, mixing, ngram_join, packing, quality, secrets
from .common import table


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mix: doc_id, source, and the schedule's columns."""
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_packing, op2_one_bit_codes, op3_rule_ensemble, op4_guess_cost, op5_ngram_join, op6_link_trust, op7_best_fit_packing, op8_exact_dedup, op9_pfair_mixing, op10_rare_token_licenses)}


def oracle_sql() -> dict[str, str]:
    return {"op2_one_bit_codes": ann.ORACLE, "op4_guess_cost": secrets.oracle(), "op5_ngram_join": ngram_join.ORACLE, "op6_link_trust": link_trust.oracle(), "op8_exact_dedup": exact_dedup.ORACLE, "op9_pfair_mixing": mixing.oracle(), "op10_rare_token_licenses": licenses.oracle()}
