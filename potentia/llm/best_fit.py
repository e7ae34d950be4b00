"""Op 7: best-fit packing by bin completion.

Documents become token ids (an end-of-text id follows each), only those longer than a sequence are cut,
and the pieces' lengths are packed by branch and bound: fillings around the longest piece left that no
other filling dominates, pruned by how much one sequence less could waste, with best fit decreasing as
the first incumbent (bins.bin_completion). Full pieces are sequences of their own. Ranges of `group_pieces`
pieces that follow one another in the order of the documents are groups, each packed by itself, so no task
grows with the input. Sequences are numbered by range, and within a range by the place of their longest piece:
a mix of sources that the order of the documents holds, the order of the sequences holds as well.

The order is that of the partitions and their rows, or is given by two columns, own_file (string) and own_row
(long; within a file); a file's pieces are numbered in one task.

Defined cases: a null or empty text is the end-of-text id alone; a null doc_id stays null; repeated rows
are packed once for each row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bins import bin_completion
from .common import cut
from .packing import token_pieces
from .tokens import vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, own_file string, own_row long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, eos: int = 0) -> DataFrame:
    """One row a piece: lengths and checksums only, so that no later step carries text or ids."""
    path, ordered = path or vocabulary(), {"own_file", "own_row"} <= set(docs.columns)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("own_file", pa.string()), ("own_row", pa.int64())])

    def run(batches):
        task, seq, rows, places = f"{TaskContext.get().partitionId():010d}", -1, [], deque()

        def seen():
            for batch in batches:
                if ordered:
                    places.extend(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
                yield batch

        for doc_id, piece, start, ids in token_pieces(seen(), path, capacity, eos):
            if not piece:
                seq += 1
                place = places.popleft() if ordered else (task, seq)
            rows.append((doc_id, piece, start, len(ids), zlib.crc32(ids.tobytes()), *place))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["own_file", "own_row"] if ordered else [])).mapInArrow(run, PIECES)


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, eos: int = 0, group_pieces: int = 16_384, nodes: int = 50_000) -> DataFrame:
    """Where each piece lies: sequence_id (unique, else any number) and offset, gapless from 0."""
    once = cut(pieces(docs, path=path, capacity=capacity, eos=eos))
    files = once.groupBy("own_file").agg(F.count("*").alias("own_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("own_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("own_file", F.coalesce(F.sum("own_c").over(before), F.lit(0)).alias("own_start"))
    in_file = Window.partitionBy("own_file").orderBy("own_row", "piece")
    placed = once.withColumn("own_k", F.row_number().over(in_file)).join(starts, "own_file").withColumn("own_place", F.col("own_start") + F.col("own_k") - 1)
    placed = placed.withColumn("own_group", F.expr(f"own_place div {group_pieces}")).drop("own_file", "own_row", "own_start", "own_k")

    def solve(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("own_place", ignore_index=True)
        lengths = group.length.tolist()
        where, offset = [0] * len(lengths), [0] * len(lengths)
        packed = bin_completion(lengths, capacity, nodes)
        for own in packed:
            lead, at = min(own, key=lambda i: (-lengths[i], i)), 0
            for i in own:
                where[i], offset[i] = int(key[0]) << 31 | lead, at
                at += lengths[i]
        return group.assign(sequence_id=where, offset=offset)[[x.split()[0] for x in PACKED.split(", ")]]

    return placed.groupBy("own_group").applyInPandas(solve, PACKED)
