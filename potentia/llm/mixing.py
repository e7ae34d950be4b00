"""Op 9: mixing sources to target weights by Pfair scheduling, in DataFrame operations and a bounded loop over blocks.

A source's documents are dealt into blocks of `block_docs` (more where there would be over `most_blocks` blocks else: a block
is then that fraction of the corpus). With weight w (a share of all slots, one slot
a block) block i of a source, from 0, is released at slot floor(i / w) and is due before slot
ceil((i + 1) / w); among the released blocks the one due first gets the slot. So at any slot each source
has had its share to within less than a block, as long as it has blocks left.

Weights are whole parts of `cycle_slots`, 2^32 by default, so what rounding them moves stays below one block for
some 2^32 slots, which no schedule reaches. The driver deals the slots from one row a source, in a loop with a step a block, so at
most `most_blocks` and one a source, whatever the corpus; the slots go back as one row a source and are joined with the documents,
by broadcast up to `broadcast_rows` blocks. Positions
within a source are those of the rows' hashes; they come from counts of hash ranges and their running sums, so a source that holds a third
of all rows is spread over as many tasks as any. When a source has run out, other blocks that are released
may have its slots, and where there is none they stay vacant. No row is dropped or repeated.

Defined cases: a null source is a source; rows with equal columns, doc_id included, follow one another in
any order; an empty table gives no rows; texts may be null; other columns, whatever their names and types, are only carried, but for
those that `schedule` adds, which give way to its own. The table is read more than once and must give the same rows each time, as
files do. Target weights default to each source's row
count to the power `alpha`, over all rows; others can be given, and a source without one is refused.
"""

from __future__ import annotations

import json
import math
from array import array
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

ADDED = ("mix_block", "mix_slot", "mix_place", "mix_release", "mix_deadline")
HASH_BITS = 62


def shares(docs: DataFrame, *, alpha: float = 0.7, cycle_slots: int = 2**32, weights: dict[str | None, float] | None = None) -> DataFrame:
    """For each source its weight in parts of cycle_slots: own_source (the source in JSON, so that null is a value), share, rows."""
    counts = docs.groupBy(F.to_json(F.struct("source")).alias("own_source"), "source").agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(alpha)))
    else:
        if any(not w > 0 for w in weights.values()):
            raise ValueError("weights must be above 0")
        weight = F.lit(None).cast("double")
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
        weight = F.when(weight.isNull(), F.raise_error(F.lit("a source has no weight"))).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))  # one row a source
    share = F.greatest(F.lit(1), F.round(F.col("weight") / total * cycle_slots)).cast("long")
    return weighted.select("own_source", share.alias("share"), "rows")


def deal(shares: list[tuple[int, int]]) -> list[array]:
    """The slots of each source's blocks, in their order. shares: (share, blocks) of each source."""
    length, out = sum(x for x, _ in shares), [array("q") for _ in shares]
    waiting, ready = [(0, i, 0) for i, (_, n) in enumerate(shares) if n], []  # (release or deadline, source, block)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heappop(waiting)
            heappush(ready, (-(-(k + 1) * length // shares[i][0]), i, k))
        _, i, k = heappop(ready)
        out[i].append(slot)
        if k + 1 < shares[i][1]:
            heappush(waiting, ((k + 1) * length // shares[i][0], i, k + 1))
        slot += 1
    return out


def _hash(docs: DataFrame) -> Column:
    """62 bits of a hash of all columns; those that hold maps or variants, which can't be hashed, as JSON."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    column = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    hashed = F.xxhash64(*[column(f) if plain(f) else F.to_json(F.struct(column(f))) for f in docs.schema])
    return hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _source() -> Column:
    return F.to_json(F.struct("source"))


class _Deal:
    """The slots of every block, from one row a source: sources, blocks (of each), slots (of each), block_docs, buckets (as bits)."""

    def __init__(self, docs: DataFrame, block_docs: int, most_blocks: int, bucket_rows: int, targets: dict):
        self.sources = shares(docs, **targets).orderBy("own_source").collect()
        self.block_docs = max(block_docs, math.ceil(sum(r.rows for r in self.sources) / most_blocks))
        self.blocks = [-(-r.rows // self.block_docs) for r in self.sources]
        self.slots = deal([(r.share, k) for r, k in zip(self.sources, self.blocks)])
        self.length = sum(r.share for r in self.sources)
        self.bits = max(0, max((r.rows for r in self.sources), default=0) // bucket_rows).bit_length()

    def plan(self, spark: SparkSession) -> DataFrame:
        """own_source, share, mix_block, mix_slot of every block."""
        rows = [{"source": r.own_source, "share": r.share, "slots": own.tolist()} for r, own in zip(self.sources, self.slots)]
        one = _inlined(spark, rows, "source:string, share:long, slots:array<long>")
        plan = one.select(F.col("source").alias("own_source"), "share", F.posexplode("slots").alias("mix_block", "mix_slot"))
        return cut(plan.withColumn("mix_block", F.col("mix_block").cast("long")))  # so that the slots stand in one plan only

    def files(self, count: int) -> list[list[tuple[int, int]]]:
        """For each source where `count` files of like numbers of blocks begin, in the slots' order: (file, its first row of the source)."""
        order = sorted((slot, i) for i, own in enumerate(self.slots) for slot in own)
        begins, block = [[] for _ in self.sources], [0] * len(self.sources)
        for k, (_, i) in enumerate(order):
            file = k * count // len(order)
            if not begins[i] or begins[i][-1][0] != file:
                begins[i].append((file, block[i] * self.block_docs))
            block[i] += 1
        return begins


def _inlined(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the driver holds, as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _ranked(keyed: DataFrame, bits: int, source: str, hashed: str, n: str, *ranks: tuple[str, Column]) -> DataFrame:
    """keyed with n, a row's place in its source by hash, from 0, and other ranks of that order."""
    bucket, count, start = fresh([*keyed.columns, n, *(x for x, _ in ranks)], "own_bucket", "own_c", "own_start")
    keyed = keyed.withColumn(bucket, F.shiftright(hashed, HASH_BITS - bits))
    in_source = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(source, bucket).agg(F.count("*").alias(count)).select(source, bucket, F.coalesce(F.sum(count).over(in_source), F.lit(0)).alias(start))
    in_bucket = Window.partitionBy(source, bucket).orderBy(hashed)
    added = [(n, F.row_number()), *ranks]
    found = keyed.withColumns({x: r.over(in_bucket) - 1 for x, r in added}).join(starts, [source, bucket])
    return found.withColumns({x: F.col(start) + F.col(x) for x, _ in added}).drop(bucket, start)


def _slotted(numbered: DataFrame, columns: list[str], dealt: _Deal, source: str, n: str, broadcast_rows: int) -> DataFrame:
    """The columns and ADDED of rows that have n, their place in their source."""
    share = fresh([*numbered.columns, *ADDED], "own_share")[0]
    plan = dealt.plan(numbered.sparkSession).select(F.col("own_source").alias(source), F.col("share").alias(share), "mix_block", "mix_slot")
    placed = numbered.withColumns({"mix_block": F.expr(f"{n} div {dealt.block_docs}"), "mix_place": F.col(n) % dealt.block_docs})
    found = placed.join(F.broadcast(plan) if sum(dealt.blocks) <= broadcast_rows else plan, [source, "mix_block"])
    release = F.expr(f"mix_block * {dealt.length} div {share}")
    due = F.expr(f"((mix_block + 1) * {dealt.length} + {share} - 1) div {share}")
    return found.select(*columns, "mix_block", "mix_slot", "mix_place", release.alias("mix_release"), due.alias("mix_deadline"))


def schedule(docs: DataFrame, *, block_docs: int = 32, most_blocks: int = 1 << 18, bucket_rows: int = 256, broadcast_rows: int = 1 << 19, **targets) -> DataFrame:
    """All rows and columns of docs, with mix_block, mix_slot, mix_place, mix_release and mix_deadline; sort by mix_slot, mix_place."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    source, hashed, n = fresh([*docs.columns, *ADDED], "own_source", "own_hash", "own_n")
    dealt = _Deal(docs, block_docs, most_blocks, bucket_rows, targets)
    keyed = docs.withColumns({source: _source(), hashed: _hash(docs)})
    return _slotted(_ranked(keyed, dealt.bits, source, hashed, n), docs.columns, dealt, source, n, broadcast_rows)


def _directory(spark: SparkSession, keys: DataFrame, dealt: _Deal, files: int) -> DataFrame:
    """For each source, where its rows of each file begin: own_source, bits, and by the first `bits` bits of a hash the
    begins (from, file, before) among which the last one at or below the hash is the row's; before counts the source's rows below it."""
    begins = dealt.files(files)
    asked = [{"source": r.own_source, "n": n, "file": file} for r, own in zip(dealt.sources, begins) for file, n in own if n]
    found = {r.own_source: [(0, own[0][0], 0)] for r, own in zip(dealt.sources, begins)}
    if asked:
        asked_rows = _inlined(spark, asked, "source:string, n:long, file:int").withColumnRenamed("source", "own_source")
        ranked = _ranked(keys, dealt.bits, "own_source", "own_hash", "own_n", ("own_before", F.rank()))
        at = ranked.withColumnRenamed("own_n", "n").join(F.broadcast(asked_rows), ["own_source", "n"])  # at most one a block
        for r in at.orderBy("own_source", "n").collect():
            own = found[r.own_source]
            if own[-1][0] == r.own_hash:
                own.pop()  # equal rows lie across the border
            own.append((r.own_hash, r.file, r.own_before))
    rows = []
    for source, own in found.items():
        bits = len(own).bit_length() - 1
        cells = [[] for _ in range(1 << bits)]
        k = 0
        for c, cell in enumerate(cells):
            low, high = c << (HASH_BITS - bits), (c + 1) << (HASH_BITS - bits)
            while k + 1 < len(own) and own[k + 1][0] <= low:
                k += 1
            while True:
                cell.append({"from": own[k][0], "file": own[k][1], "before": own[k][2]})
                if k + 1 == len(own) or own[k + 1][0] >= high:
                    break
                k += 1
        rows.append({"source": source, "bits": bits, "cells": cells})
    return cut(_inlined(spark, rows, "source:string, bits:int, cells:array<array<struct<from:long, file:int, before:long>>>"))


def mix(docs: DataFrame, *, block_docs: int = 32, most_blocks: int = 1 << 18, bucket_rows: int = 256, broadcast_rows: int = 1 << 19, file_docs: int = 1 << 15, **targets) -> DataFrame:
    """The rows of docs in the schedule's order: partition after partition, row after row.

    A first pass keeps source and hash of each row. From them come the hashes at which each source's rows go on to the next
    partition, at most one a block, so that the second pass sends each text to its partition at once, in the only shuffle of texts.
    Partitions hold about `file_docs` documents, or as few as fill the session's shuffle partitions. Rows that are equal in all
    columns and lie across a border stay together, behind it.
    """
    spark, columns = docs.sparkSession, docs.columns
    kept = dict(zip(ADDED, fresh(columns, *(f"own_{c}" for c in ADDED))))
    back = {kept[c.lower()]: c for c in columns if c.lower() in kept}
    docs = docs.withColumnsRenamed({c: k for k, c in back.items()})
    source, hashed, n, at, file = fresh([*docs.columns, *ADDED], "own_source", "own_hash", "own_n", "own_at", "own_file")
    keys = cut(docs.select("source", _source().alias("own_source"), _hash(docs).alias("own_hash")))
    dealt = _Deal(keys, block_docs, most_blocks, bucket_rows, targets)
    rows, blocks = sum(r.rows for r in dealt.sources), sum(dealt.blocks)
    files = max(1, min(blocks, max(-(-rows // file_docs), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cells, bits = fresh([*docs.columns, *ADDED], "own_cells", "own_bits")
    directory = _directory(spark, keys.drop("source"), dealt, files).toDF(source, bits, cells)
    keyed = docs.withColumns({source: _source(), hashed: _hash(docs)}).join(F.broadcast(directory) if blocks <= broadcast_rows else directory, source)
    last = F.expr(f"element_at(filter({cells}[cast(shiftright({hashed}, {HASH_BITS} - {bits}) as int)], own_x -> own_x.from <= {hashed}), -1)")
    sent = keyed.withColumn(at, last).select(*docs.columns, source, hashed, F.col(f"{at}.file").alias(file), F.col(f"{at}.before").alias(n)).repartitionById(files, file)
    in_file = Window.partitionBy(file, source).orderBy(hashed)
    numbered = sent.withColumn(n, F.col(n) + F.row_number().over(in_file) - 1)
    planned = _slotted(numbered, docs.columns, dealt, source, n, broadcast_rows).sortWithinPartitions("mix_slot", "mix_place").drop(*ADDED)
    return planned.withColumnsRenamed(back).select(*columns)


#: The multipliers of the 64-bit hash that Spark's xxhash64 works out, and its seed.
XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
XX_SEED = 42


def oracle(*, alpha: float = 0.7, cycle_slots: int = 2**32, block_docs: int = 32, most_blocks: int = 1 << 18) -> str:
    """SQL of schedule over doc_id and source of the table documents, for sources with names below 32 bytes.

    Hashes are worked out in 128 bits modulo 2^64; the deal is a recursion with a step a block.
    """
    whole = f"{1 << 64}::uhugeint"
    p1, p2, p3, p4, p5 = (f"{x}::uhugeint" for x in XX)
    times = "(({0}) * {1} % {2})".format
    turned = lambda x, k: f"(({x}) * {1 << k}::uhugeint % {whole} + ({x}) // {1 << (64 - k)}::uhugeint)"
    mixed = lambda h, x: f"xor({h}, {x})"

    steps = [("long_0", f"select *, {XX_SEED}::uhugeint + {p5} + 8 as h, case when doc_id < 0 then {whole} - (-(doc_id::hugeint))::uhugeint else doc_id::uhugeint end as x from documents")]

    def then(to: str, where: str = "true") -> None:
        steps.append((f"step_{len(steps)}", f"select * exclude (h), case when {where} then {to} else h end as h from {steps[-1][0]}"))

    def part(x: str) -> str:
        steps.append((f"step_{len(steps)}", f"select * exclude (x), {x} as x from {steps[-1][0]}"))

    def word(where: str) -> None:
        part(times("x", p2, whole))
        part(times(turned("x", 31), p1, whole))
        then(mixed("h", "x"), where)
        then(f"({times(turned('h', 27), p1, whole)} + {p4}) % {whole}", where)

    def finish(where: str) -> None:
        for shift, factor in ((33, p2), (29, p3), (32, None)):
            then(mixed("h", f"h // {1 << shift}::uhugeint"), where)
            if factor:
                then(times("h", factor, whole), where)

    word("doc_id is not null")
    finish("doc_id is not null")
    then(f"{XX_SEED}::uhugeint", "doc_id is null")
    steps.append(("named", f"select *, coalesce(hex(encode(source)), '') as bytes, coalesce(octet_length(encode(source)), 0) as size from {steps[-1][0]}"))
    then(f"(h + {p5} + size::uhugeint) % {whole}", "source is not null")
    little = lambda at, n: "('0x' || " + " || ".join(f"substr(bytes, {at} * 2 + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::ubigint::uhugeint"
    for k in range(3):
        there = f"size >= {8 * k + 8}"
        part(f"case when {there} then {little(8 * k, 8)} else 0::uhugeint end")
        word(there)
    rest, there = "(size - size % 8)", "size % 8 >= 4"
    part(f"case when {there} then {little(rest, 4)} else 0::uhugeint end")
    then(mixed("h", times("x", p1, whole)), there)
    then(f"({times(turned('h', 23), p2, whole)} + {p3}) % {whole}", there)
    for k in range(3):
        there = f"size % 4 > {k}"
        part(f"case when {there} then {little(f'(size - size % 4 + {k})', 1)} else 0::uhugeint end")
        then(mixed("h", times("x", p5, whole)), there)
        then(times(turned("h", 11), p1, whole), there)
    finish("source is not null")
    hashing = ",\n".join(f"{name} as ({sql})" for name, sql in steps)
    return f"""
    with recursive {hashing},
    keyed as (
        select doc_id, source, row_number() over (partition by source order by h % {1 << HASH_BITS}::uhugeint) - 1 as n,
            case when source is null then '{{}}' else '{{"source":' || to_json(source) || '}}' end as name
        from {steps[-1][0]}),
    counts as (select name, count(*) as rows from keyed group by name),
    sized as (select *, greatest({block_docs}, ceil(sum(rows) over () / {most_blocks}))::bigint as size, pow(rows, {alpha}) / sum(pow(rows, {alpha})) over () as weight from counts),
    sources as (
        select name, size, row_number() over (order by name) as i, greatest(1, round(weight * {cycle_slots}))::bigint as share, (rows + size - 1) // size as blocks
        from sized),
    every as (select list(share order by i) as shares, list(blocks order by i) as blocks, sum(share)::bigint as length from sources),
    deal as (
        select 0::bigint as slot, list_transform(blocks, lambda x: 0::bigint) as following, 0::bigint as dealt, -1::bigint as given, -1::bigint as block from every
        union all
        select given + 1, list_transform(following, lambda x, j: case when j = pick.i then x + 1 else x end), pick.i, given, following[pick.i]
        from (
            select *, list_min(list_transform(list_filter(released, lambda x: x.slot <= given), lambda x: {{'due': x.due, 'i': x.i}})) as pick
            from (
                select *, greatest(slot, list_min(list_transform(released, lambda x: x.slot))) as given
                from (
                    select slot, following, list_filter(list_transform(following, lambda x, j: {{
                        'slot': x * length // shares[j], 'due': ((x + 1) * length + shares[j] - 1) // shares[j], 'i': j::bigint, 'left': x < blocks[j]}}), lambda x: x.left) as released
                    from deal, every)
                where len(released) > 0))),
    placed as (select doc_id, source, i, share, n // size as mix_block, n % size as mix_place from keyed join sources using (name))
    select doc_id, source, mix_block, given as mix_slot, mix_place, mix_block * length // share as mix_release, ((mix_block + 1) * length + share - 1) // share as mix_deadline
    from placed join deal on dealt = i and block = mix_block, every"""
