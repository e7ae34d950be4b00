"""Readers and writers of the trace files: JSON lines, JSON arrays, CSV with defaults, runs in folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in the warehouse, or locally in a temporary folder, where that is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        at = tempfile.mkdtemp(prefix="potentia-") if sc.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    out = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def scan_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """SRC1: JSON lines, blank lines skipped; a line that isn't JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """SRC2: files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """SRC3: JSON lines; lines that can't be read, or that lack the key, are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")


def as_bool(c: Column) -> Column:
    """True for 1, true, t, yes and y in any case, with blanks around."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def scan_csv(spark: SparkSession, path: str, types: dict[str, tuple[str, object]]) -> DataFrame:
    """SRC4: CSV with a header; each column cast to its type, with its default where that fails."""
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in types)).csv(path)
    cast = lambda c, kind, default: as_bool(F.col(c)) if kind == "boolean" else F.coalesce(F.col(c).try_cast(kind), F.lit(default).cast(kind))
    return raw.select(*[cast(c, kind, default).alias(c) for c, (kind, default) in types.items()])


def discover_runs(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """SRC5: values parsed from each row's file name by a pattern with one group a name."""
    file = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(file, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def latest(df: DataFrame, keys: list[str], run: str) -> DataFrame:
    """SRC6: rows of each key's last run by name."""
    last = df.groupBy(*keys).agg(F.max(run).alias("own_last"))
    return df.join(last, keys).where(F.col(run) == F.col("own_last")).drop("own_last")


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1: CSV with a header; without rows there is still a file with the header."""
    if df.limit(1).count():
        df.write.option("header", True).csv(path)
    else:
        df.repartition(1).write.option("header", True).csv(path)


def write_split(df: DataFrame, path: str) -> None:
    """SNK2: one dataset, partitioned into success and failure."""
    df.withColumn("split", F.when(F.coalesce("is_correct", F.lit(False)), "success").otherwise("failure")).write.partitionBy("split").parquet(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """SNK3: add finished rows to the checkpoint."""
    df.write.mode("append").parquet(path)


def union_of_keys(first: list[str], *frames: DataFrame) -> DataFrame:
    """SNK4: all rows with all columns as strings, the given ones first; what a frame lacks is empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in first]
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*first, *rest]])
