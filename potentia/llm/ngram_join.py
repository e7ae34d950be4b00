"""Op 5: near duplicates by an n-gram Jaccard join with MinHash banding.

Two documents are linked when the sets of their five-word shingles (words are runs of letters, digits and
underscores, lower-cased) have a Jaccard similarity of 0.8 or more.

1. Every text gets a 128-bit fingerprint of its shingle set, MinHash values and band hashes (choose_bands: as many rows a
   band as the hashes allow for the target recall). Texts with equal sets form one class; only one text of a class goes on.
2. Classes are shuffled on their band hashes, as 16-bit MinHash values. Within a bucket they are compared by these
   values; only pairs that agree on far fewer than the similarity demands are left out (six standard deviations).
   A bucket hands over the edges of a spanning forest, never its pairs; one above `bucket` members isn't compared but
   joined to its first member as a whole, so the work on buckets is linear in their members (step 3 tells apart what has no links).
3. Connected classes are read again and verified on their full shingle sets, in blocks of at most about `block` texts and
   `block_shingles` shingles that meet pairwise. A block pair hands over each class's number of links and a spanning forest of
   verified links.
4. Verified links give each document its class id (the smallest fingerprint that it is connected to) and its number
   of links, copies included.

So links within a group of copies are counted, not listed, and no group is collected by any task. The narrow
tables between the steps go to the checkpoint folder.

Defined cases: a text of fewer than five words has one shingle, all its words; a text without words (null and empty ones too)
has none, is a class of its own and has no links; rows that repeat are copies of one another; a null doc_id stays
null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

NGRAM, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 160
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band whose 1 - (1 - s^rows)^bands reaches the recall with max_hashes at most."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts. Word hashes are kept in a bounded dictionary."""

    def __init__(self, n: int = NGRAM, kept_words: int = 400_000):
        self.n, self.kept, self.words = n, kept_words, {}
        self.powers = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.kept:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * self.powers[k]
        return np.unique(_mixed(total + np.uint64(n)))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set: two sums that don't depend on order."""
    with np.errstate(over="ignore"):
        return np.array([_mixed(shingles + _MIX).sum(dtype=np.uint64), _mixed(shingles ^ _MIX).sum(dtype=np.uint64)], "<u8").tobytes()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.uint64(2**64 - 1))
        for some in (shingles[k : k + 65_536] for k in range(0, len(shingles), 65_536)):  # so that a very long text takes no more memory
            for at in range(0, len(self.a), 16):
                own = (some[None, :] * self.a[at : at + 16, None] + self.b[at : at + 16, None]).min(axis=1)
                out[at : at + 16] = np.minimum(out[at : at + 16], own)
        return _mixed(out)

    def band_hashes(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            weights = _mixed(np.arange(1, self.rows + 1, dtype=np.uint64)) | np.uint64(1)
            return _mixed((values.reshape(self.bands, self.rows) * weights).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


SIGNED = "doc_id long, text_key long, n int, fp binary, small binary, bands array<long>"


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Fingerprints, MinHash values cut to 16 bits, and band hashes; fp is null for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("fp", pa.binary()), ("small", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        shingle, hashes = Shingler(), MinHash(bands, rows)
        for batch in batches:
            out = []
            for text in batch.column(2):
                s = shingle(text.as_py())
                if len(s):
                    values = hashes(s)
                    out.append((len(s), fingerprint(s), (values & np.uint64(0xFFFF)).astype("<u2").tobytes(), hashes.band_hashes(values)))
                else:
                    out.append((0, None, None, None))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:]))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SIGNED)


def blocked(members: DataFrame, by: str) -> DataFrame:
    """members with own_x, own_i, own_j: a group is dealt into own_k blocks by the hash of `by`, and they meet pairwise."""
    dealt = members.withColumn("own_x", F.pmod(F.xxhash64(by), F.col("own_k")).cast("int"))
    cells = F.explode(F.expr("transform(sequence(0, own_k - 1), y -> struct(least(own_x, y) as i, greatest(own_x, y) as j))"))
    return dealt.withColumn("own_cell", cells).withColumns({"own_i": F.col("own_cell.i"), "own_j": F.col("own_cell.j")}).drop("own_cell", "own_k")


def _grouped(batches, key: str):
    """Rows (dicts of columns as lists) of each run of equal keys."""
    held: dict | None = None
    for batch in batches:
        cols = batch.to_pydict()
        keys = cols[key]
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            part = {c: v[at:end] for c, v in cols.items()}
            if held is not None and held[key][0] == keys[at]:
                for c in held:
                    held[c] += part[c]
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held


EDGES = "a long, b long"


def bucket_edges(representatives: DataFrame, rows_all: int, similarity: float, bucket: int) -> DataFrame:
    """Spanning forests of the likely pairs in every bucket, as pairs of keys. representatives: key, small, n, bands.

    Two texts that share a key are one node here, which adds comparisons and loses none.
    """
    least = math.floor(rows_all * similarity - 6 * math.sqrt(rows_all * similarity * (1 - similarity)))
    banded = representatives.select("key", F.explode("bands").alias("hash"))
    sizes = cut(banded.groupBy("hash").agg(F.count("*").alias("own_m"), F.min("key").alias("own_first")).where("own_m > 1"))
    shared = banded.join(sizes, "hash")
    whole = shared.where(F.col("own_m") > bucket).select(F.col("own_first").alias("a"), F.col("key").alias("b")).where("a <> b")
    cells = shared.where(F.col("own_m") <= bucket).select("key", F.col("hash").alias("cell")).join(representatives.select("key", "small", "n"), "key")

    def run(batches):
        for g in _grouped(batches, "cell"):
            key, n = g["key"], np.array(g["n"])
            small = np.frombuffer(b"".join(g["small"]), "<u2").reshape(len(key), -1)
            left, edges = np.arange(len(key)), []
            while len(left) > 1:  # grow a component from the first that is left; compare each member with those not reached yet
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = ((small[left] == small[x]).sum(axis=1) >= least) & (np.minimum(n[left], n[x]) >= similarity * np.maximum(n[left], n[x]))
                    edges += [(key[x], key[y]) for y in left[near]]
                    queue += left[near].tolist()
                    left = left[~near]
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    compared = cells.repartition("cell").sortWithinPartitions("cell").select("key", "small", "n", "cell").mapInArrow(run, EDGES)
    return compared.unionByName(whole).distinct()


def components(edges: DataFrame, *, steps: int = 50, file_rows: int = 100_000) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of edges (a, b).

    Each step points every node's neighbours, and then the node, to the smallest of them (alternating large and small stars), with
    aggregates and joins only; edges between a root and its members are left when nothing changes. No step adds edges, so their
    number bounds the files that a step's tables need at about `file_rows` rows each, however many partitions a shuffle has.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, files = None, lambda rows: max(1, math.ceil(rows / file_rows))
    most = edges.count()
    for _ in range(steps):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = cut(least.coalesce(files(2 * most)))  # so that the join's skewed side can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct().coalesce(files(most)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, most = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


VERIFIED = "fp binary, links long, other binary"


def verify(members: DataFrame, similarity: float) -> DataFrame:
    """Links on full shingle sets. members: fp, copies, shingles, x (block), i, j, cell. Rows are (fp, links, null) or edges (fp, 0, other)."""

    def run(batches):
        for g in _grouped(batches, "cell"):
            sets = [np.frombuffer(x, "<u8") for x in g["shingles"]]
            order = np.argsort([len(x) for x in sets], kind="stable")  # by size, so that what can be similar lies side by side
            sets, fp = [sets[k] for k in order], [g["fp"][k] for k in order]
            copies, x = np.array(g["copies"], np.int64)[order], np.array(g["x"])[order]
            sizes, across = np.array([len(s) for s in sets]), g["i"][0] != g["j"][0]
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            links, pairs, flag = np.zeros(len(fp), np.int64), [], np.zeros(int(ids.max()) + 1, np.int32)
            root = np.arange(len(fp))  # for a spanning forest of the links
            for a in range(len(fp) - 1):
                last = int(np.searchsorted(sizes, sizes[a] / similarity + 1e-9, "right"))
                if last <= a + 1:
                    continue
                others = np.arange(a + 1, last)
                flag[ids[starts[a] : ends[a]]] = 1
                common = np.add.reduceat(flag[ids[ends[a] : ends[last - 1]]], starts[others] - ends[a])
                flag[ids[starts[a] : ends[a]]] = 0
                linked = common >= similarity * (sizes[a] + sizes[others] - common) - 1e-9
                near = others[linked & (x[others] != x[a])] if across else others[linked]
                links[a] += copies[near].sum()
                links[near] += copies[a]
                fresh = near[root[near] != root[a]]
                joined, at = np.unique(root[fresh], return_index=True)
                pairs += [(a, int(o)) for o in fresh[at]]
                if len(joined):
                    root[np.isin(root, joined)] = root[a]
            rows = [(fp[k], int(links[k]), None) for k in np.flatnonzero(links)] + [(fp[a], 0, fp[b]) for a, b in pairs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["fp", "links", "other"])

    return members.repartition("cell").sortWithinPartitions("cell").select("fp", "copies", "shingles", "x", "i", "j", "cell").mapInArrow(run, VERIFIED)


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp binary, shingles binary")


def join(docs: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES, bucket: int = 256, block: int = 512, block_shingles: int = 4_000_000, broadcast_rows: int = 300_000) -> DataFrame:
    """signed documents (doc_id, text_key, fp, n) with class (fp of the class, null without links) and links to other texts and copies."""
    bands, rows = choose_bands(similarity, recall, max_hashes)
    signed = cut(sign(docs, bands, rows))
    classes = signed.where("fp is not null").groupBy("fp").agg(F.min(F.struct("text_key", "doc_id", "n", "small", "bands")).alias("own"), F.count("*").alias("copies"))
    short = F.expr("cast(conv(hex(substring(fp, 1, 7)), 16, 10) as bigint)")
    representatives = cut(classes.select("fp", short.alias("key"), "copies", "own.*"))
    likely = components(bucket_edges(representatives, bands * rows, similarity, bucket))
    groups = cut(likely.withColumnsRenamed({"node": "key", "root": "own_root"}).join(representatives.select("key", "fp", "copies", "text_key", "doc_id", "n"), "key"))
    wanted = groups.select(F.col("text_key").alias("own_key"), F.col("doc_id").alias("own_id"))
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    keyed = docs.select("text", F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"))
    read = keyed.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
    sets = _shingle_sets(read)
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int")
    sizes = groups.groupBy("own_root").agg(blocks.alias("own_k"))
    dealt = blocked(groups.select("fp", "copies", "own_root").join(sizes, "own_root"), "fp")
    cells = dealt.select("fp", "copies", F.col("own_x").alias("x"), F.col("own_i").alias("i"), F.col("own_j").alias("j"), F.xxhash64("own_root", "own_i", "own_j").alias("cell"))
    verified = cut(verify(cells.join(sets.dropDuplicates(["fp"]), "fp"), similarity))
    found = components(verified.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    links = verified.where("other is null").groupBy("fp").agg(F.sum("links").alias("links"))
    copies = representatives.select("fp", "copies")
    per_class = copies.where("copies > 1").join(links, "fp", "full_outer").join(found.withColumnRenamed("node", "fp"), "fp", "left")
    per_class = cut(per_class.select(F.col("fp").alias("own_fp"), F.coalesce("root", "fp").alias("class"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    few = per_class.limit(broadcast_rows + 1).count() <= broadcast_rows
    return signed.select("doc_id", "text_key", "fp", "n").join(F.broadcast(per_class) if few else per_class, F.col("fp") == F.col("own_fp"), "left").drop("own_fp")


#: DuckDB's rows of report(), pair by pair; its \w is narrower than Python's, hence the class.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(greatest(1, len(ws) - 4)), lambda k: array_to_string(ws[k + 1 : k + 5], ' ')) END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT a AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY a),
m AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, coalesce(least(k.least, doc_id), doc_id) AS class_id, coalesce(m.n, 0)::BIGINT AS n_links FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN m ON m.r = d.r
"""


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of the class), n_links (other documents at 0.8 or more)."""
    joined = join(docs, **options)
    least = joined.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    least = least.withColumnRenamed("class", "own_class")
    broadcast_rows = options.get("broadcast_rows", 300_000)
    few = least.limit(broadcast_rows + 1).count() <= broadcast_rows
    named = joined.join(F.broadcast(least) if few else least, F.col("class") == F.col("own_class"), "left")
    return named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, *, broadcast_rows: int = 300_000, **options) -> DataFrame:
    """One document of each class, that with the smallest doc_id, and all documents without links; with all columns."""
    joined = cut(join(docs, broadcast_rows=broadcast_rows, **options).where("class is not null").select("class", "doc_id", "text_key"))
    keep = joined.groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "text_key", "doc_id")).alias("k")).select("k.doc_id", "k.text_key")
    # every linked row is dropped, but for the one to keep of its class
    marked = joined.groupBy("doc_id", "text_key").agg(F.count("*").alias("own_c")).join(keep.withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"}), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    marked = cut(marked.select(F.col("doc_id").alias("own_doc"), F.col("text_key").alias("own_text"), "own_c", F.col("own_key").isNotNull().alias("own_keep")))
    few = marked.limit(broadcast_rows + 1).count() <= broadcast_rows
    key, doc, text, n, keep = fresh(docs.columns, "own_key", "own_doc", "own_text", "own_c", "own_keep")
    marked = marked.toDF(doc, text, n, keep)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    tagged = keyed.join(F.broadcast(marked) if few else marked, (F.col(key) == F.col(text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    once = tagged.where(F.col(text).isNull() | (F.col(keep) & (F.col(n) == 1))).select(*docs.columns)
    if not marked.where(F.col(keep) & (F.col(n) > 1)).limit(1).count():
        return once
    return once.unionByName(tagged.where(F.col(keep) & (F.col(n) > 1)).dropDuplicates([key, doc]).select(*docs.columns))
