"""Op 1: packed token-id matrices by best fit decreasing.

Every task turns its documents into token ids (an end-of-text id follows each document), cuts those
longer than a row losslessly into pieces, and packs a bounded window of pieces at a time: longest first,
each into the open row that it leaves with the least room, found in a segment tree of capacities.
Rows filled well are final. The pieces of the others meet in a second round, in groups of bounded size
dealt out by hash, so that windows and partitions cost next to nothing. No shuffle carries the pieces of
final rows; every group is bounded, whatever the input.

A row of the result is one line of the id matrix:
  sequence_id long      unique
  n_tokens int          ids in use; the rest of the line is pad ids
  ids binary            `capacity` little-endian ids of `id_bytes` bytes each
  cu_seqlens array<int> 0 and the running ends of the line's pieces
  position_resets array<int>  where the position goes back to 0: the piece starts
  doc_ids, pieces, starts     for each piece its document, its number there, and the document's ids before it

Defined cases: a null or empty text is the end-of-text id alone; a null doc_id stays null; repeated rows
are packed once for each row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import best_fit_decreasing
from .common import cut
from .tokens import cut_pieces, encoder, vocabulary

FIRST = "sequence_id long, final boolean, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, data binary"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("final", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("data", pa.binary())])


def token_pieces(batches, path: str, capacity: int, eos: int) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, piece, start, ids) of every document in Arrow batches of doc_id and text."""
    encode, end = encoder(path), np.array([eos], "<u4")
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.concatenate([encode(text.as_py()), end])
            for piece, (start, n) in enumerate(cut_pieces(len(ids), capacity)):
                yield doc_id, piece, start, ids[start : start + n]


def width_of_ids(path: str, eos: int, pad: int, id_bytes: int | None = None) -> int:
    """Bytes an id: 2 where every id fits, else 4; a narrower choice is refused."""
    largest = max(encoder(path).largest_id(), eos, pad)
    needed = 2 if largest < 1 << 16 else 4
    if min(eos, pad) < 0 or largest >= 1 << 32 or (id_bytes or 4) < needed:
        raise ValueError(f"ids up to {largest} don't fit in {id_bytes or 4} bytes")
    return id_bytes or needed


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, eos: int = 0, pad: int = 0, id_bytes: int | None = None, window_tokens: int = 4_000_000, least_fill: float = 1 - 1 / 128) -> DataFrame:
    """Pack documents (doc_id, text) into lines of `capacity` ids; see the module's text.

    id_bytes is 2 or 4, by default as the vocabulary needs. window_tokens bounds what a task or a group holds at a time; rows filled to least_fill are final
    in the first round.
    """
    path = path or vocabulary()
    id_bytes = width_of_ids(path, eos, pad, id_bytes)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def rows(items: list, task: int, count: int, last: bool) -> tuple[list[tuple], int]:
        out = []
        for own in best_fit_decreasing([len(x[3]) for x in items], capacity):
            used = sum(len(items[i][3]) for i in own)
            groups, final = ([own], True) if last or used >= least_fill * capacity else ([[i] for i in own], False)
            for g in groups:
                out.append((task << 32 | count, final, [items[i][0] for i in g], [items[i][1] for i in g], [items[i][2] for i in g], [len(items[i][3]) for i in g], np.concatenate([items[i][3] for i in g]).astype(kind).tobytes()))
                count += 1
        return out, count

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    def first(batches):
        task, count, items, held = TaskContext.get().partitionId(), 0, [], 0
        for item in token_pieces(batches, path, capacity, eos):
            items.append(item)
            held += len(item[3])
            if held >= window_tokens:
                out, count = rows(items, task, count, False)
                yield from (batch(out[i : i + 2000]) for i in range(0, len(out), 2000))
                items, held = [], 0
        if items:
            out, count = rows(items, task, count, False)
            yield from (batch(out[i : i + 2000]) for i in range(0, len(out), 2000))

    def second(key, group: pd.DataFrame) -> pd.DataFrame:
        items = [(None if pd.isna(d[0]) else int(d[0]), p[0], s[0], np.frombuffer(x, kind)) for d, p, s, x in zip(group.doc_ids, group.pieces, group.starts, group.data)]
        out, _ = rows(items, 1 << 29 | int(key[0]), 0, True)
        return pd.DataFrame(out, columns=_ARROW.names)

    once = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, FIRST))
    left = once.where(~F.col("final"))
    total = left.agg(F.sum(F.element_at("lengths", 1))).first()[0] or 0
    groups = max(1, math.ceil(total / window_tokens))
    again = left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("own_group")).applyInPandas(second, FIRST)
    packed = once.where("final").unionByName(again)
    used = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    padded = F.expr(f"concat(data, unhex(repeat('{np.array([pad], kind).tobytes().hex()}', {capacity} - n_tokens)))")
    return (
        packed.withColumn("n_tokens", used)
        .withColumn("cu_seqlens", ends)
        .select("sequence_id", "n_tokens", padded.alias("ids"), "cu_seqlens", F.expr("slice(cu_seqlens, 1, size(lengths))").alias("position_resets"), "doc_ids", "pieces", "starts")
    )


def position_ids(packed: DataFrame) -> DataFrame:
    """Add position_ids: for each id in use its place in its piece."""
    return packed.withColumn("position_ids", F.expr("flatten(transform(position_resets, (s, i) -> sequence(0, cu_seqlens[i + 1] - s - 1)))"))


def unpack(packed: DataFrame, *, id_bytes: int = 2) -> DataFrame:
    """The pieces again: doc_id, piece, start, ids (binary, as packed)."""
    one = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("at", "p"))
    width = F.lit(id_bytes)
    begin, end = F.expr("cu_seqlens[at]"), F.expr("cu_seqlens[at + 1]")
    return one.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.substring(F.col("ids"), begin * width + 1, (end - begin) * width).alias("ids"))


def write_packed(packed: DataFrame, to: str) -> None:
    """Write lines as Parquet: ids, cu_seqlens and position_resets as the columns of a row of the matrix."""
    packed.write.mode("overwrite").parquet(to)
