import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from potentia.llm import best_fit, bins, exact_dedup, mixing, packing, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own_n string, file string"
ODD = [(1, "One two three."), (1, "One two three."), (2, "ONE TWO THREE."), (3, None), (4, ""), (None, "one two three."), (5, "Été à " * 5000), (5, "été À"), (6, "a <|endoftext|> b   c\n\n d"), (7, "漢字 テスト " * 900)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i == 3 else f"s{(i or 0) % 2}", None, "x", "y") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_ids(text):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.vocabulary())
    return slow.encode(text or "", add_special_tokens=False).ids + [0]


def test_bins_against_exhaustive_search():
    def fewest(lengths, capacity):
        best = len(lengths)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for room in sorted({r for r in rooms if r >= lengths[i]}):
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
            go(i + 1, [*rooms, capacity - lengths[i]])

        go(0, [])
        return best

    rng = random.Random(3)
    for count, capacity, times in ((9, 20, 60), (12, 100, 40), (13, 200, 20), (15, 50, 10)):
        for _ in range(times):
            lengths = sorted((rng.randint(1, capacity * 3 // 4) for _ in range(count)), reverse=True)
            best = fewest(lengths, capacity)
            assert bins.lower_bound(lengths, capacity) <= best
            for how in (bins.best_fit_decreasing, bins.bin_completion):
                found = how(lengths, capacity)
                assert sorted(i for b in found for i in b) == list(range(count))
                assert all(sum(lengths[i] for i in b) <= capacity for b in found)
            assert len(bins.bin_completion(lengths, capacity)) == best


@pytest.mark.parametrize("count,pieces,times", [(3, (3, 4), 700), (3, (5, 6), 500), (30, (4,), 15), (30, (5,), 10), (30, (8,), 10), (300, (4,), 2)])
def test_bins_that_are_full(count, pieces, times):
    rng = random.Random(1)
    for _ in range(times):
        lengths = []
        for _ in range(count):
            cuts = sorted(rng.sample(range(1, 2048), rng.choice(pieces) - 1))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 2048])]
        rng.shuffle(lengths)
        assert len(bins.bin_completion(lengths, 2048)) == count


@pytest.mark.parametrize("pieces", range(5, 11))
def test_bins_of_many_pieces(pieces):
    rng, lengths, mean = random.Random(pieces), [], 2048 // pieces
    while len(lengths) < 400 * pieces:  # 400 bins that are full
        own = [rng.randint(mean * 4 // 5, mean * 5 // 4) for _ in range(pieces - 1)]
        if mean * 4 // 5 <= 2048 - sum(own) <= mean * 5 // 4:
            lengths += [*own, 2048 - sum(own)]
    found = bins.bin_completion(lengths, 2048)
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in found)
    assert len(found) <= 410 < len(bins.best_fit_decreasing(lengths, 2048))


def test_segment_tree_finds_the_least_room():
    rng = random.Random(5)
    tree, rooms = bins.CapacityTree(50), Counter()
    for _ in range(500):
        room = rng.randint(1, 50)
        tree.add(room, 1)
        rooms[room] += 1
        want = rng.randint(1, 50)
        found = min((r for r in rooms if rooms[r] and r >= want), default=None)
        assert tree.least(want) == found
        if found:
            tree.add(found, -1)
            rooms[found] -= 1


def test_packing_is_an_exact_round_trip(odd, none):
    packed = packing.pack(odd, capacity=64, window_tokens=500)
    rows = packed.collect()
    assert all(r.cu_seqlens[-1] == r.n_tokens <= 64 and len(r.ids) == 128 and r.cu_seqlens[:-1] == r.position_resets for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = defaultdict(list)
    for r in packing.unpack(packed).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    for doc_id in {i for i, _ in ODD}:
        texts = [reference_ids(t) for i, t in ODD if i == doc_id]
        assert sum(len(ids) for _, ids in got[doc_id]) == sum(map(len, texts))
        for start, ids in got[doc_id]:
            assert any(t[start : start + len(ids)] == ids for t in texts)
    positions = packing.position_ids(packed).collect()
    assert all(p.position_ids == [k for s, e in zip(p.cu_seqlens, p.cu_seqlens[1:]) for k in range(e - s)] for p in positions)
    assert packing.pack(none).count() == 0


def test_packing_fills_like_best_fit_of_everything(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randint(1, 150)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lengths = [n for _, t in rows for _, n in tokens.cut_pieces(len(reference_ids(t)), 128)]
    assert packing.pack(docs, capacity=128, least_fill=1.0).count() <= len(bins.best_fit_decreasing(lengths, 128)) * 1.01 + 1
    assert packing.pack(docs.repartition(4), capacity=128, window_tokens=4000).count() <= len(bins.best_fit_decreasing(lengths, 128)) * 1.03 + 1


def test_ids_that_do_not_fit_are_refused(odd, monkeypatch):
    assert packing.width_of_ids(tokens.vocabulary(), 0, 0) == 2
    with pytest.raises(ValueError):
        packing.pack(odd, eos=70_000, id_bytes=2)
    wide = packing.pack(odd, capacity=64, eos=70_000)
    assert all(len(r.ids) == 256 for r in wide.collect())
    assert any(70_000 in np.frombuffer(r.ids, "<u4") for r in packing.unpack(wide, id_bytes=4).collect())


def test_best_fit_pieces(odd, none):
    rows = best_fit.pack(odd, capacity=64).collect()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(reference_ids(t))
    for r in rows:
        assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(t) for x in texts.values() for t in x)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert r.length == 64 or r.piece == 0
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert best_fit.pack(none).count() == 0


def test_sequences_follow_the_mix(spark, tmp_path):
    """Sources whose documents differ in length keep their shares in every range of sequences."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["one", "two", "three"]) for _ in range({"a": 20, "b": 9, "c": 4}[s] + rng.randint(0, 5))), s) for k in range(4000) for s in [rng.choice("aaaabbbc")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.mix(docs, block_docs=4, weights={"a": 4, "b": 3, "c": 1}).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed").withColumns({"own_file": F.col("_metadata.file_name"), "own_row": F.col("_metadata.row_index")})
    order = [r.doc_id for r in mixed.orderBy("own_file", "own_row").collect()]
    packed = sorted(best_fit.pack(mixed, capacity=64, group_pieces=400).collect(), key=lambda r: r.sequence_id)
    assert sorted(r.doc_id for r in packed) == sorted(order)
    for k in range(0, 4000, 400):  # each range of sequences holds a range of the mix, and so its shares
        assert {r.doc_id for r in packed[k : k + 400]} == set(order[k : k + 400])
    source = {k: s for k, _, s in rows}
    for k in range(0, 3200, 400):
        had = Counter(source[r.doc_id] for r in packed[k : k + 400])
        assert all(abs(had[s] - 400 * w / 8) <= 12 for s, w in {"a": 4, "b": 3, "c": 1}.items())


def test_exact_dedup(odd, none):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    by = defaultdict(list)
    for i, t in ODD:
        by[low(t)].append(i)
    for bound in (0, 200_000):
        rows = exact_dedup.report(odd, broadcast_rows=bound).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
        for t, ids in by.items():
            own = [r for r in rows if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            keep = max((i for i in ids if i is not None), default=None)
            assert len(own) == len(ids) and all(r.keep_id == keep and r.group_size == len(ids) for r in own)
            assert [r.doc_id for r in own if r.kept] == [keep]
        staying = exact_dedup.drop_duplicates(odd, broadcast_rows=bound)
        assert staying.columns == odd.columns and sorted(low(r.text) for r in staying.collect()) == sorted(by)
    assert exact_dedup.report(none).count() == 0 == exact_dedup.drop_duplicates(none).count()


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3, None: 0.5, "c": 5.5}])
def test_mixing_keeps_each_source_within_a_block(spark, none, weights):
    rng = random.Random(7)
    data = [(k, rng.choice(["a"] * 9 + ["b"] * 4 + ["c"] * 3 + [None])) for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    rows = mixing.schedule(docs, block_docs=5, bucket_rows=100, cycle_slots=100, **({"weights": weights} if weights else {})).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    slots = {}
    for r in rows:
        slots.setdefault(r.mix_slot, (r.source, r.mix_block))
        assert slots[r.mix_slot] == (r.source, r.mix_block) and r.mix_release <= r.mix_slot < r.mix_deadline
    share = {r.own_source: r.share for r in mixing.shares(docs, cycle_slots=100, weights=weights).collect()}
    length = sum(share.values())
    import json

    name = lambda s: json.dumps({"source": s} if s is not None else {}, separators=(",", ":"))
    last = min(max(t for t, (s, _) in slots.items() if s == own) for own in ("a", "b", "c", None))
    had = Counter()
    for t in range(last + 1):  # until a source runs out
        had[name(slots[t][0])] += 1
        assert all(abs(had[s] - share[s] / length * (t + 1)) < 1 for s in share)
    assert mixing.schedule(none).count() == 0
    ordered = mixing.mix(docs, block_docs=5, bucket_rows=100).collect()
    assert sorted(r.doc_id for r in ordered) == list(range(3000))


def test_mixing_keeps_to_unrounded_weights(spark):
    weights = {"a": 1.23456, "b": 0.00004, **{f"s{k}": 0.0007 for k in range(100)}}  # b and each s are less than a thousandth or near it
    docs = spark.range(6000).selectExpr("id doc_id", "case when id < 5500 then 'a' when id < 5510 then 'b' else concat('s', id % 100) end source")
    rows = mixing.schedule(docs, block_docs=1, weights=weights).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    total, slots = sum(weights.values()), {r.mix_slot: r.source for r in rows}
    assert len(slots) == 6000 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    had, counts = Counter(), Counter(r.source for r in rows)
    for t in range(max(slots) + 1):
        had[slots.get(t)] += 1
        for s, w in weights.items():
            assert had[s] == counts[s] or abs(had[s] - w / total * (t + 1)) < 1 + 1e-6
        if all(had[s] == counts[s] for s in weights if s != "b"):
            break


def test_mixing_deals_a_large_source_among_many_small_ones():
    shares = [(int(0.045 * 2**32), 15_000)] + [(int(0.955 / 5000 * 2**32), 2)] * 5000
    slots = mixing.deal(shares)
    length = sum(w for w, _ in shares)
    assert len({t for own in slots for t in own}) == sum(map(len, slots)) == 25_000
    assert all(k * length // w <= t < -(-(k + 1) * length // w) for (w, _), own in zip(shares, slots) for k, t in enumerate(own))
    first = sorted((t, i) for i, own in enumerate(slots) for t in own)[:10_000]
    assert abs(sum(not i for _, i in first) - 450) <= 1


def test_schedule_of_many_slots_keeps_to_the_given_weights():
    """200,000 slots and weights that no short cycle holds: after every slot each source is within a block of its given weight's share."""
    weights = [2**0.5, 3.14159265, 1 / 3, 0.0001, 0.77777, 2.0]
    total, cycle, slots = sum(weights), 2**32, 200_000
    shares = [(max(1, round(w / total * cycle)), int(w / total * slots) + 2) for w in weights]
    dealt = mixing.deal(shares)
    owner = np.full(max(max(x) for x in dealt) + 1, -1)
    for i, own in enumerate(dealt):
        owner[np.array(own)] = i
    until = min(own[-1] for i, own in enumerate(dealt) if i != 3)
    assert until > 199_000
    at = np.arange(1, until + 1)
    for i, w in enumerate(weights):
        had = np.cumsum(owner[:until] == i)
        if i == 3:
            had = had[: dealt[3][-1]]
        assert np.abs(had - w / total * at[: len(had)]).max() < 1 + 1e-3


def test_ten_thousand_sources_and_bounded_blocks(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "case when id < 10000 then 'hot' else concat('s', id % 10000) end source")
    rows = mixing.schedule(docs, block_docs=1).collect()
    assert len(rows) == 30_000 == len({r.mix_slot for r in rows}) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    few = mixing.schedule(docs.where("source = 'hot' or doc_id % 100 = 7"), block_docs=1, most_blocks=500).collect()
    counts = Counter((r.source, r.mix_block) for r in few)
    assert sorted(r.doc_id for r in few) == sorted([*range(10_000), *(k for k in range(10_000, 30_000) if k % 100 == 7)])
    assert max(counts.values()) == -(-len(few) // 500) and len(counts) <= 500 + len({r.source for r in few})


@pytest.mark.parametrize("options", [{}, {"block_docs": 3, "bucket_rows": 16}, {"block_docs": 1, "file_docs": 50, "weights": {"hot": 1, "b": 2, None: 3}}])
def test_mix_is_in_the_schedules_order(spark, options):
    """Read partition after partition, the mix is the schedule sorted by slot and place; equal rows across a border move behind it."""
    docs = spark.range(3000).selectExpr("id doc_id", "concat('text ', id) text", "case when id % 3 = 0 then 'hot' when id % 7 > 0 then 'b' end source").repartition(5)
    got = [r.doc_id for r in mixing.mix(docs, **options).collect()]
    schedule = mixing.schedule(docs, **{k: v for k, v in options.items() if k != "file_docs"})
    assert got == [r.doc_id for r in schedule.orderBy("mix_slot", "mix_place").collect()]
    repeated = docs.unionByName(spark.range(2000).selectExpr("7L doc_id", "'same' text", "'hot' source"))
    mixed = mixing.mix(repeated, **options)
    assert Counter(mixed.collect()) == Counter(repeated.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_in_sql(spark):
    """DuckDB's rows are equal, with null, empty, long and accented source names, and doc_ids that are null, negative or repeated."""
    rng, names = random.Random(12), [None, "", "a", "ab", "four", "seven77", "eight888", "été", "thirteen-char", "thirty-one-bytes-make-this-name", 'quo"te']
    data = [(rng.choice([None, -5, -(1 << 63), (1 << 63) - 1, *range(900)]), rng.choice([*names, "hot", "hot", "hot"])) for _ in range(1500)]
    rows = mixing.schedule(spark.createDataFrame(data, "doc_id long, source string"), block_docs=3).collect()
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, source varchar)")
    duck.executemany("insert into documents values (?, ?)", data)
    found = duck.execute(mixing.oracle(block_docs=3))
    assert [x[0] for x in found.description] == list(rows[0].asDict())
    assert sorted(found.fetchall(), key=repr) == sorted(map(tuple, rows), key=repr) and len(rows) == 1500
    duck.execute("delete from documents")
    assert duck.execute(mixing.oracle()).fetchall() == []
