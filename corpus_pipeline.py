"""A training-data pipeline: quality filter, exact and near duplicates, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potentia.llm import best_fit, exact_dedup, mixing, ngram_join, quality
from potentia.llm.common import ensure_checkpoint_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones among them, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the packed sequences, which follow the order of the mix: of files, and rows in them."""
    return best_fit.pack(docs.withColumns({"own_file": F.col("_metadata.file_name"), "own_row": F.col("_metadata.row_index")}))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's score and the packing can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared checkpoint folder and read by the next."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark._jvm, spark.sparkContext
    at = f"{sc._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        here = jvm.org.apache.hadoop.fs.Path(f"{at}-{k}")
        stage(spark, docs, sf_dir).write.parquet(here.toString())
        docs = spark.read.parquet(here.toString())
        fs = here.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.deleteOnExit(here)
        if before is not None:
            fs.delete(before, True)
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
