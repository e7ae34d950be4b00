"""Op 8: exact duplicates by progressive refinement.

Texts are equal when they are identical after lower-casing A-Z. Groups are refined in three passes over
the documents: by length in bytes; then, for lengths that occur again, by a hash of the first characters;
then, for pairs of length and prefix that occur again, by SHA-256 of the whole text. A group that has one
row left is done. Each pass hands over counts only, aggregated before they are shuffled, so copies by
the million cost one row a task. The surviving keys are broadcast only up to `broadcast_rows` of them;
beyond that the narrow rows (never the texts) are shuffled instead.

Defined cases: a null text counts as empty, and empty texts are equal; the largest doc_id of a group
stays, null being the smallest; of rows that repeat both doc_id and text one stays; an empty table gives
no rows; other columns, whatever their names, are only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lower_ascii

PREFIX_CHARS = 256


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def full_hash() -> Column:
    """SHA-256 of the normalised text, in lower-case hex."""
    return F.sha2(lower_ascii(_text()).cast("binary"), 256)


def _few(keys: DataFrame, bound: int) -> bool:
    return keys.limit(bound + 1).count() <= bound


def _among(rows: DataFrame, keys: DataFrame, on: list[str], bound: int) -> DataFrame:
    """Rows whose key is among keys; broadcast if there are at most bound of them."""
    return rows.join(F.broadcast(keys) if _few(keys, bound) else keys, on, "left_semi")


def _sizes(prefix_chars: int) -> tuple[Column, Column]:
    """Length in bytes, and a hash of the first characters."""
    return F.octet_length(_text()).alias("own_n"), F.xxhash64(lower_ascii(F.substring(_text(), 1, prefix_chars))).alias("own_prefix")


def survivors(docs: DataFrame, *, prefix_chars: int = PREFIX_CHARS, broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs of length and prefix that occur again: own_n, own_prefix. Only rows that have them are read in full."""
    length, prefix = _sizes(prefix_chars)
    again = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("own_c")).where("own_c > 1").select(*keys)
    lengths = again(docs.select(length), "own_n")
    return cut(again(_among(docs.select(length, prefix), lengths, ["own_n"], broadcast_rows), "own_n", "own_prefix"))


def groups(docs: DataFrame, keys: DataFrame, *, prefix_chars: int = PREFIX_CHARS, broadcast_rows: int = 200_000) -> DataFrame:
    """Groups of at least two rows: text_sha256, keep_id, group_size, keep_rows (rows that have the doc_id which stays)."""
    length, prefix = _sizes(prefix_chars)
    rows = _among(docs.select(length, prefix, "doc_id", full_hash().alias("text_sha256")), keys, ["own_n", "own_prefix"], broadcast_rows)
    by_id = rows.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("own_c"))
    found = by_id.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "own_c")).alias("own_top"), F.sum("own_c").alias("group_size"))
    return cut(found.where("group_size > 1").select("text_sha256", F.col("own_top.doc_id").alias("keep_id"), "group_size", F.col("own_top.own_c").alias("keep_rows")))


def report(docs: DataFrame, *, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat doc_id and text are counted before the join, and come out again as often as they
    came in, one of them kept.
    """
    docs = docs.select("doc_id", "text")
    found = groups(docs, survivors(docs, broadcast_rows=broadcast_rows, **options), broadcast_rows=broadcast_rows, **options).withColumnRenamed("text_sha256", "own_sha")
    by_id = docs.select("doc_id", full_hash().alias("text_sha256")).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("own_c"))
    joined = by_id.join(F.broadcast(found) if _few(found, broadcast_rows) else found, F.col("text_sha256") == F.col("own_sha"), "left")
    keep = F.when(F.col("own_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("own_c"))).alias("own_k"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_k") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, *, prefix_chars: int = PREFIX_CHARS, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows that stay, with all their columns. Only rows whose length and prefix occur again are hashed in full, unless these pairs are too many to broadcast."""
    n, prefix, again, full, sha, keep, rows = fresh(docs.columns, "own_n", "own_prefix", "own_again", "own_full", "own_sha", "own_keep", "own_rows")
    keys = survivors(docs, prefix_chars=prefix_chars, broadcast_rows=broadcast_rows)
    found = groups(docs, keys, prefix_chars=prefix_chars, broadcast_rows=broadcast_rows).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows))
    # a row that is alone has a key of its own, so that no such rows meet in one task
    hashed = full_hash()
    tagged = docs
    if _few(keys, broadcast_rows):
        tagged = docs.withColumns(dict(zip((n, prefix), _sizes(prefix_chars)))).join(F.broadcast(keys.select(F.col("own_n").alias(n), F.col("own_prefix").alias(prefix), F.lit(True).alias(again))), [n, prefix], "left")
        hashed = F.when(F.col(again), hashed).otherwise(F.xxhash64("text").cast("string"))
    joined = tagged.withColumn(full, hashed).join(F.broadcast(found) if _few(found, broadcast_rows) else found, F.col(full) == F.col(sha), "left")
    staying = joined.where(F.col(sha).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)))
    repeated = F.coalesce(F.col(rows), F.lit(1)) > 1
    once = staying.where(~repeated).select(*docs.columns)
    if not found.where(F.col(rows) > 1).limit(1).count():
        return once
    return once.unionByName(staying.where(repeated).dropDuplicates([full]).select(*docs.columns))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), n AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS k
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND k = 1 AS kept, sha256(t) AS text_sha256 FROM n
"""
