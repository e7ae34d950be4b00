"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless the path or folder that they inherit has it."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    inherited = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if root in inherited or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/potentia", "zip", root, "potentia"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (the folder may be in any store that Spark reads)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; choose a folder only where none is set.

    A local master gets a temporary folder; any other master gets a folder in the warehouse,
    which all executors share.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if sc.master.startswith("local[") or sc.master == "local":
            at = tempfile.mkdtemp(prefix="potentia-checkpoint-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(at)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, keep it in the shared checkpoint folder, and go on from there.

    Spark's cleaner removes the files once no plan refers to them and the driver's garbage has been collected. It does so for
    checkpoints written while spark.cleaner.referenceTracking.cleanCheckpoints is set, which is why this sets it, unless the
    session says otherwise.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.cleaner.referenceTracking.cleanCheckpoints"
    if not conf.contains(key):
        conf.set(key, "true")
    return df.checkpoint(eager=True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until it is no column's (column names don't tell cases apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(col):
    """Lower-case A-Z only. Texts of one byte a character take the fast path, which is the same for them."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
