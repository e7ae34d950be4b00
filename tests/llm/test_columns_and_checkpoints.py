"""Columns of the caller's that have the operators' own names, and what is left in the checkpoint folder."""

import gc
import os
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from potentia.llm import best_fit, exact_dedup, mixing, ngram_join, packing, quality
from potentia.llm import common

LLM = Path(common.__file__).parent


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column for every name that the operators give to columns of their own, and a map."""
    names = sorted({n for f in LLM.glob("*.py") for n in re.findall(r"\b(?:own|mix)_\w+", f.read_text())} | {"class", "copies", "key", "n", "w", "hash", "fp", "score", "text_key", "cell", "weight", "rows"})
    names = [n for n in names if n not in ("own_file", "own_row")]
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(30)) + ".") for k in range(40)]
    docs += [(k, docs[k - 40][1]) for k in range(40, 50)] + [(3, docs[3][1]), (60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    df = df.withColumns({"source": F.concat(F.lit("s"), F.col("doc_id") % 3), "m": F.create_map(F.lit("a"), F.col("doc_id"))})
    return df, names


def unchanged(found, df, names):
    assert found.columns == df.columns
    for r in found.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r.m == {"a": r.doc_id}
    return found.count()


def test_clashing_columns(spark, clashing):
    df, names = clashing
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert unchanged(quality.keep_good(df, labels, threshold=0.0), df, names) == 53
    for options in ({}, {"broadcast_rows": 0}):
        assert unchanged(exact_dedup.drop_duplicates(df, **options), df, names) == 41
        assert unchanged(ngram_join.drop_near_duplicates(df, **options), df, names) == 42
    assert unchanged(mixing.mix(df), df, names) == 53
    planned = mixing.schedule(df)
    assert planned.columns == [c for c in df.columns if c not in mixing.ADDED] + list(mixing.ADDED) and planned.count() == 53
    assert "own_s" in quality.classify(df, labels).columns
    assert best_fit.pack(df).count() == 53 and packing.pack(df).count() > 0
    assert exact_dedup.report(df).count() == 53 == ngram_join.report(df).count()


def test_names_without_clashes():
    assert common.fresh(["A", "own_n", "own_n_"], "a", "own_n", "b", "b") == ["a_", "own_n__", "b", "b_"]


def test_checkpoints_are_removed(spark):
    docs = spark.createDataFrame([(k, f"some words of document number {k % 7}") for k in range(30)], "doc_id long, text string")
    common.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")

    def files():
        return {os.path.join(at, f) for at, _, found in os.walk(folder) for f in found}

    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before = files()
    found = [ngram_join.report(docs), exact_dedup.drop_duplicates(docs), best_fit.pack(docs), packing.pack(docs)]
    assert all(f.count() for f in found) and files() - before
    del found
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
        if not files() - before:
            break
    assert not files() - before
