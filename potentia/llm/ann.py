"""Op 2: nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean and scaled to length 1, is rotated at random (into `bits` dimensions, eight for each of
its own; with four, three times as many vectors have to be read) and kept as its signs, packed in 64-bit words, with two scalars: its distance to the mean and its inner product with
its own code. A rotated query is rounded to QUERY_BITS bits a dimension; its inner product with a code is then counted: for
each bit plane of the query the set bits that it shares with the code. Divided by the code's scalar, that
estimates the cosine without bias; its error is below `eps` standard deviations but for a few in a hundred, and each vector gets a lower and
an upper bound of its squared distance. Only vectors whose lower bound does not exceed the k-th smallest
upper bound are read in full and ranked by the exact distance.

Every row is indexed. Codes are kept apart from the vectors, in blocks; blocks of codes meet blocks of queries, and each pair of
a query block and a share of the code blocks is a task of its own, however many of either there are. In a first pass a task hands
over the k + 1 smallest upper bounds of each query; those of all tasks give its limit, and a second pass over the codes the ids that stay
below it, some hundred a query, which are joined with the vectors. Equal vectors are searched once: at most
k + 1 of them, those of the smallest ids, can be among the k nearest of any query, so a group of copies of
any size costs k + 1 rows.

Defined cases: vectors that are null, zero, of another length than most (the shorter, in a tie), or that hold
null or non-finite components take no part, nor do rows without vec_id; of rows that share a vec_id the one with the
smallest vector (compared component by component) takes part; a query is never its own neighbour; fewer candidates than k
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

INDEX = "ids binary, codes binary, norms binary, ips binary, n int"
LIMITS, SURVIVORS = "q long, uppers array<double>", "q long, vec_id long"
BLOCK_ROWS, QUERY_ROWS, QUERY_BITS = 2048, 4096, 4
#: Pairs of a code and a query that a task compares, about; and tasks at most.
TASK_PAIRS, MOST_TASKS = 1 << 22, 20_000


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows that take part, one a vec_id: vec_id and v (array<double>)."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top.n if top else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _turned(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the centre, and rotated directions from there."""
    o = x - centre
    norms = np.linalg.norm(o, axis=1)
    return norms, (o / np.where(norms > 0, norms, 1)[:, None]) @ rotation.T


def encode(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows by 64-bit words), distances to the centre, inner products with the own code."""
    norms, z = _turned(x, centre, rotation)
    ips = np.abs(z).sum(1) / np.sqrt(len(rotation))
    return np.packbits(z >= 0, axis=1).view("<u8"), norms, np.where(norms > 0, ips, 1)


def index(vectors: DataFrame, centre: np.ndarray, rotation: np.ndarray) -> DataFrame:
    """Blocks of the codes of vectors (vec_id, v); the vectors themselves stay where they are."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.binary()] * 4 + [pa.int32()]

    def build(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                codes, norms, ips = encode(_matrix(batch.column(1)), centre, rotation)
                row = (np.asarray(batch.column(0), np.int64), np.ascontiguousarray(codes.T), norms, ips)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*(a.tobytes() for a in row), batch.num_rows], kinds)], names=names)

    return vectors.mapInArrow(build, INDEX)


class Queries:
    """Rotated queries as bit planes."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, rotation: np.ndarray):
        self.bits = len(rotation)
        self.norms, z = _turned(q, centre, rotation)
        self.low, top = z.min(1), (1 << QUERY_BITS) - 1
        self.step = np.maximum((z.max(1) - self.low) / top, 1e-12)
        steps = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.sums = self.low * self.bits + self.step * steps.sum(1, dtype=np.int64)
        self.planes = [np.packbits((steps >> p) & 1, axis=1).view("<u8") for p in range(QUERY_BITS)]

    def bounds(self, i: int, codes: np.ndarray, norms: np.ndarray, ips: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of query i; codes are words by rows."""
        shared, ones = np.zeros(codes.shape[1], np.uint32), np.zeros(codes.shape[1], np.uint32)
        for w, word in enumerate(codes):
            ones += np.bitwise_count(word)
            for p, plane in enumerate(self.planes):
                shared += np.bitwise_count(word & plane[i, w]).astype(np.uint32) << np.uint32(p)
        # the code's components are 1 and -1 over sqrt(bits); the query's are low + step * (its planes)
        inner = (2 * (self.low[i] * ones + self.step[i] * shared) - self.sums[i]) / math.sqrt(self.bits)
        off = eps * np.sqrt(np.maximum(0, 1 - ips**2) / (self.bits - 1) + self.step[i] ** 2 / 12) / ips + 1e-6
        length = self.norms[i]
        middle, slack = norms**2 + length**2 - 2 * norms * length * inner / ips, 2 * norms * length * off + 1e-9
        return middle - slack, middle + slack


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, bits: int | None = None, eps: float = 2.0, seed: int = 7, broadcast_rows: int = 500_000, **names) -> DataFrame:
    """The k nearest other vectors of each query row: query_id, rank, vec_id, score (Euclidean distance, double)."""
    rows = cut(usable(vectors, **names))
    first = rows.select(F.size("v").alias("d")).first()
    d = first.d if first else 1
    bits = max(bits or 8 * d, d)
    bits += -bits % 64
    means = rows.agg(F.count("*"), *[F.avg(F.col("v")[i]) for i in range(d)]).first()
    centre = np.array([x or 0.0 for x in means[1:]])
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, d)))[0]

    ranked = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("own_r", F.row_number().over(ranked)).where(F.col("own_r") <= k + 1).drop("own_r")
    queries = rows.where(is_query)
    asked = cut(queries.groupBy("v").agg(F.min("vec_id").alias("q")))
    n_asked = asked.count()
    blocks = max(1, math.ceil(n_asked / QUERY_ROWS))
    shares = min(max(1, MOST_TASKS // blocks), max(1, math.ceil(means[0] * n_asked / TASK_PAIRS / blocks)))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("own_b")
    coded = cut(index(candidates, centre, rotation).withColumn("own_s", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")))

    def met(some: DataFrame) -> DataFrame:
        """Blocks of codes, each with the rows of a block of queries; as many tasks as there are pairs of query blocks and shares."""
        packed = some.groupBy(block).agg(F.collect_list(F.struct(*some.columns)).alias("asked"))  # about QUERY_ROWS in each
        packed = packed.withColumn("own_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(blocks * shares, "own_b", "own_s")
        spread = coded.withColumn("own_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks * shares, "own_b", "own_s")
        return spread.join(packed, ["own_b", "own_s"]).select("own_b", "ids", "codes", "norms", "ips", "asked")

    def rows_met(batches):
        """(whether the queries are new, their rows, the queries, ids, codes, norms, ips) of each block of codes; one block of queries at a time."""
        at, some, q = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("own_b")[r].as_py()
                new = at != own
                if new:
                    at, some = own, batch.column("asked")[r].as_py()
                    q = Queries(np.array([x["v"] for x in some]), centre, rotation)
                ids, norms, ips = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("ids", np.int64), ("norms", float), ("ips", float)))
                yield new, some, q, ids, np.frombuffer(batch.column("codes")[r].as_py(), "<u8").reshape(-1, len(ids)), norms, ips

    def limits(batches):
        some, least = [], None
        for new, now, q, _, codes, norms, ips in rows_met(batches):
            if new:
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in some], pa.int64()), pa.array([x[np.isfinite(x)] for x in least])], names=["q", "uppers"])
                some, least = now, np.full((len(now), k + 1), np.inf)
            for i in range(len(some)):
                upper = q.bounds(i, codes, norms, ips, eps)[1]
                near = np.concatenate([least[i], upper[upper < least[i, k]]])
                least[i] = np.sort(np.partition(near, k)[: k + 1])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in some], pa.int64()), pa.array([x[np.isfinite(x)] for x in least])], names=["q", "uppers"])

    def likely(batches):
        for _, some, q, ids, codes, norms, ips in rows_met(batches):
            near = [np.flatnonzero(q.bounds(i, codes, norms, ips, eps)[0] <= x["own_limit"]) for i, x in enumerate(some)]
            keys = np.repeat([x["q"] for x in some], [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids[np.concatenate(near)], pa.int64())], names=["q", "vec_id"])

    uppers = met(asked.select("q", "v")).mapInArrow(limits, LIMITS).groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("uppers"))).alias("own_u"))  # k + 1 a share
    limited = cut(asked.join(uppers.select("q", F.coalesce(F.get("own_u", F.lit(k)), F.array_max("own_u")).alias("own_limit")), "q").select("q", "v", "own_limit"))
    left = cut(met(limited).mapInArrow(likely, SURVIVORS))
    few = left.limit(broadcast_rows + 1).count() <= broadcast_rows
    read = candidates.join(F.broadcast(left) if few else left, "vec_id")
    squares = F.zip_with("v", "own_q", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))  # one component after the other, so that the sum's order is fixed
    scored = read.join(asked.select("q", F.col("v").alias("own_q")), "q").select("q", "vec_id", score.alias("score"))
    by_query = Window.partitionBy("q").orderBy("score", "vec_id")
    best = scored.withColumn("own_r", F.row_number().over(by_query)).where(F.col("own_r") <= k + 1).select("q", "vec_id", "score")
    who = queries.join(asked, "v").select(F.col("vec_id").alias("query_id"), "q")
    others = who.join(best, "q").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return others.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(c.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
