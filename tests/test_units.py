"""Literal edge cases of the operators, and figures of the published data, typed in."""

import math

import pytest
from pyspark.sql import functions as F

from potentia.functions import answers, names
from potentia.functions import potential as P
from potentia.functions import text as T
from potentia.operators import distribution as D
from potentia.operators import relational as R
from potentia.operators import sequence as S
from potentia.sources import problems


def path(spark, *scores, key=1):
    return spark.createDataFrame([(key, i + 1, f"t{i + 1}", s) for i, s in enumerate(scores)] or [], "path_id long, pos long, token string, score double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("scores", [[], [0.5], [None, None]])
def test_no_pairs(spark, scores):
    assert S.pairs(path(spark, *scores)).count() == 0 == S.significant(path(spark, *scores)).count()


def test_gap_tolerant_pair(spark):
    rows = S.significant(path(spark, 0.5, None, None, 0.1)).collect()
    assert [(r.prev_pos, r.pos, r.k_prev, r.k_now) for r in rows] == [(1, 4, 32, 6)]


def test_profile_counts_the_same_drops(spark):
    df = path(spark, 0.9, None, 0.3, 0.8, None, None, 0.1, 0.1).unionByName(path(spark, None, 0.5, 0.6, key=2))
    counts = {r.path_id: r["count"] for r in S.significant(df).groupBy("path_id").count().collect()}
    assert {r.path_id: (r.n, r.total_tokens, r.last_token) for r in S.profile(df, "path_id").collect()} == {1: (counts[1], 8, "t8"), 2: (0, 3, "t3")}


def test_published_drops_pass(spark):
    drops = [(60, 44), (59, 37), (41, 23), (41, 12), (32, 9), (49, 33), (64, 7), (52, 16), (18, 3)]
    df = spark.createDataFrame([*drops, (0, 0), (12, 0), (11, 0), (64, 53)], "a int, b int").select("a", "b", P.is_cliff(F.col("a"), F.col("b")).alias("x"))
    got = {(r.a, r.b): r.x for r in df.collect()}
    assert all(got[x] for x in drops) and got[12, 0] and not got[0, 0] and not got[11, 0] and not got[64, 53]


def test_boundary_matches_the_published_grid(spark):
    rows = {r.k_prev: r for r in S.boundary(spark).collect()}
    assert sum(r.cliff_cells for r in rows.values()) == 1283
    assert min(k for k, r in rows.items() if r.cliff_cells) == 12
    assert {k: rows[k].min_drop for k in (13, 14, 15, 16, 20, 32, 48, 60, 64)} == {13: 12, 14: 13, 15: 13, 16: 13, 20: 14, 32: 16, 48: 16, 60: 14, 64: 12}


def test_binary_entropy():
    assert [round(P.binary_entropy(p), 10) for p in P.ENTROPY_AT] == [0.0560015344, 0.1985152433, 0.3250829734]


def test_critical_bounds(spark):
    last = S.critical(path(spark, 0.5, 0.3, 0.0)).collect()
    assert [(r.pos, r.scores_after) for r in last] == [(3, [])]
    assert S.critical(path(spark, 0.5, 0.0, 0.05)).count() == 0
    assert S.critical(path(spark, 0.5, 0.0, 0.04)).first().pos == 2


def test_largest_drop_takes_the_earliest(spark):
    assert S.largest_drop(path(spark, 0.75, 0.5, 0.75, 0.5)).first().pos == 2


def test_half_even(spark):
    assert one(spark, P.score_to_k(F.lit(0.5), 5)) == 2
    assert one(spark, P.score_to_k(F.lit(None).cast("double"))) == -1


@pytest.mark.parametrize("n,c,k,want", [(64, 0, 8, 0.0), (64, 64, 8, 1.0), (64, 60, 8, 1.0), (64, 1, 70, 1.0), (64, 1, 1, 1 / 64), (10, 3, 2, 1 - (7 * 6) / (10 * 9))])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, P.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want)


def test_pass_at_k_grows_with_k(spark):
    df = spark.range(1, 65).select("id", P.pass_at_k(F.lit(64), F.lit(5), F.col("id")).alias("x")).orderBy("id")
    xs = [r.x for r in df.collect()]
    assert xs == sorted(xs)


def test_tie_ranks_and_infinities(spark):
    c = spark.createDataFrame([(1, 0, -1.0), (1, 1, -1.0 - 5e-10), (1, 2, -2.0), (2, 0, -math.inf), (3, 0, math.log(0.5)), (3, 1, -math.inf)], "uid long, tid long, lp double")
    assert [r.rank for r in D.tie_ranks(c.where("uid = 1")).orderBy("tid").collect()] == [1, 1, 3]
    assert {r.uid: round(r.entropy, 6) for r in D.partial_entropy(c.where("uid > 1")).collect()} == {2: 0.0, 3: round(0.5 * math.log(2), 6)}


def test_temperature_zero_and_no_finite(spark):
    c = spark.createDataFrame([(1, 0, -1.0), (1, 1, -1.0), (2, 0, -math.inf), (2, 1, -math.inf)], "uid long, tid long, lp double")
    got = {(r.uid, r.temperature, r.tid): r.p_t for r in D.at_temperature(c, (0, 1)).collect()}
    assert got[1, 0.0, 0] == 1.0 and got[1, 0.0, 1] == 0.0 and got[1, 1.0, 0] == 0.5
    assert all(got[2, t, i] == 0.0 for t in (0.0, 1.0) for i in (0, 1))


def test_chunk_bounds(spark):
    assert one(spark, S.chunk_bounds(F.lit(165)))[15] == 122
    assert one(spark, S.chunk_bounds(F.lit(1))) == [0]
    assert len(one(spark, S.chunk_bounds(F.lit(10)))) == 21


def test_zero_runs_stop(spark):
    rows = S.stop_after_zeros(path(spark, 0.5, 0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.9), 3).orderBy("pos").collect()
    assert [r.score for r in rows] == [0.5, 0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.0] and rows[0].stop_pos == 7


def test_budget_batches(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 5, 20, 1, 9])], "g long, o long, c long")
    assert [r.batch for r in S.batches(df, 10, "g", "o", "c").orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]


def test_light_grades(spark):
    cases = {
        (r"\boxed{1,234}", "1234"): True, (r"\boxed{12.00}", "12"): True, (r"\boxed{50\%}", "50"): True, (r"\boxed{x}", "5"): None,
        (r"\boxed{3} and \boxed{7}", "7"): True, (r"\boxed{7", "7"): None, ("no answer", "7"): None, (r"\boxed{8}", "7"): False,
        (r"\boxed{8}", "x=8"): None, ("So the answer is $42.", "42"): True, (r"\boxed{\frac{1}{2}}", "2"): None,
    }
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(cases)], "r string, g string, i int").select("i", T.light_grade(F.col("r"), F.array("g")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == list(cases.values())
    assert one(spark, T.balanced_box(F.lit(r"a \boxed{\frac{1}{2}} b"))) == r"\frac{1}{2}"


def test_token_types(spark):
    want = {"**": "formatting", "+": "math_operator", "()": "math_symbol", "3.5": "number", "\\frac": "latex_command", "However": "transition", "the": "function_word", "sum": "math_keyword", "x": "variable", ".": "punctuation", "'s": "subword", "word": "word", " ": "whitespace"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.token_type(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == want


def test_boundary_drop_by_bisection(spark):
    rows = spark.createDataFrame([(p,) for p in (0.05, 0.25, 0.5, 0.9, 1.0)], "p double").select("p", D.boundary_drop(F.col("p")).alias("x")).collect()
    for r in rows:
        def passes(x, p=r.p):
            q = p - x
            return x > 0.1 and x > 0.1 + 1.645 * math.sqrt(max(0.0, p * (1 - p) / 64 + q * (1 - q) / 64))

        steps = [i / 100000 * r.p for i in range(100001)]
        least = next((x for x in steps if passes(x)), None)
        assert (r.x is None) == (least is None) and (least is None or abs(r.x - least) < 2e-5)


def test_shards_are_balanced(spark):
    df = spark.createDataFrame([(f"k{i}", w) for i, w in enumerate([9, 7, 6, 5, 5, 4, 3, 1])], "k string, w long")
    rows = R.balanced_shards(df, "k", "w", 3).collect()
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.w
    assert len(rows) == 8 and sorted(loads.values()) == [13, 13, 14]


def test_numbering_without_a_single_task(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k long")
    assert [(r.k, r.n) for r in R.numbered(df, "k", buckets=5).orderBy("k").collect()] == [(i, i) for i in range(100)]


def test_numbering_of_more_rows_than_bounds_are_drawn_from(spark):
    df = spark.range(150_000, numPartitions=2).select((F.col("id") * 7919 % 150_000).alias("k"), F.col("id").alias("more"))
    rows = R.numbered(df, "k").select("k", "more", "n").toPandas()
    assert (rows.n == rows.k).all() and (rows.more * 7919 % 150_000 == rows.k).all()


def test_numbering_of_odd_orders(spark):
    import datetime
    from decimal import Decimal

    day = datetime.datetime(2024, 10, 27, 2, 30)
    data = [(k, x, t, d) for k in ("", "a", "é", None) for x in (float("nan"), -0.5, None, 7.0) for t in (day, None) for d in (Decimal("1.10"), None)]
    df = spark.createDataFrame(data, "k string, x double, t timestamp, d decimal(9,2)").repartition(3)
    for order in (["k", "x", "t", "d"], ["t", "d", "x", "k"]):
        want = [tuple(map(str, r)) for r in df.coalesce(1).sortWithinPartitions(*order).collect()]
        rows = sorted(R.numbered(df, *order, buckets=9).collect(), key=lambda r: r.n)
        assert [r.n for r in rows] == list(range(64)) and [tuple(map(str, r[:4])) for r in rows] == want
    assert sorted(r.n for r in R.numbered(df.select(F.lit(1).alias("k")), "k").collect()) == list(range(64))
    assert R.numbered(df.limit(0), "k").count() == 0


SAME = [
    (r"\frac{1}{2}", "0.5"), (r"\dfrac12", "1/2"), ("50\\%", "50"), (r"3\frac{1}{4}", "13/4"), (r"2\sqrt{2}", r"\sqrt{8}"), (r"\frac{\sqrt{3}}{2}", r"\frac{3}{2\sqrt{3}}"), (r"\sqrt[3]{8}", "2"), (r"(1,\,2)", r"\left( 1, 2.0\right)"),
    (r"\{2,1\}", "1, 2"), (r"[0, \frac{1}{2})", "[0,0.5)"), (r"x=5", "5"), (r"90^\circ", "90"), (r"1,000,000", "1000000"), (r"\text{B}", "B"), (r"2^{3}", "8"), (r"-\frac{\pi}{2}", r"\frac{-1}{2}\pi"), ("\\$5", "5."), (r"3\times10^{-2}", "0.03"), (r"x^2 + 1", "x^2+1"),
]
UNLIKE = [("1/2", "2"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), (r"\{1,2\}", r"\{1,2,2\}"), ("x", "y"), ("", "0"), (r"\sqrt{2}", "1.414"), ("1/0", "2/0"), ("i", "1"), (None, "1")]


def test_answers_in_normal_form(spark):
    rows = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(b, a, True) for a, b in SAME] + [(a, b, False) for a, b in UNLIKE], "a string, b string, want boolean")
    for r in rows.select("a", "b", "want", answers.equal(F.col("a"), F.array(F.lit("none"), F.col("b"))).alias("got")).collect():
        assert r.got == r.want, r
    boxed = spark.sql(r"select 'thus \\boxed{1} or \\boxed{\\frac{1}{2}}' r").select(answers.graded(F.col("r"), F.array(F.lit("0.5"))).alias("x")).first()
    assert boxed.x


def test_names(spark):
    aliases, known = {"A": "o/a1", "b": "o/b1"}, ["o/X", "p/Y", "q/Y"]
    want = {"A": "o/a1", "B": "o/b1", " b ": "o/b1", "a": "a", "o/x//": "o/X", "x": "o/X", "/data/X/": "o/X", "y": "y", " z ": " z ", "  ": "", "p/y": "p/Y"}
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "n string").select("n", names.resolve_model(F.col("n"), aliases, known).alias("got")).collect()
    assert {r.n: r.got for r in rows} == {**want, None: None}
    assert spark.range(1).select(names.resolve_model(F.lit("q"), {}, []).alias("x")).first().x == "q"


def test_problem_sets(spark):
    raw = spark.createDataFrame([(2, " q2\n", "work #### 7 ####  8 "), (1, "q1", " 9"), (3, None, None)], "k int, question string, answer string")
    rows = problems.normalise(raw, "gsm8k", "k").orderBy("n").collect()
    assert [(r.id, r.question, r.answer) for r in rows] == [("GSM8K_0", "q1", ["9"]), ("GSM8K_1", "q2", ["8"]), ("GSM8K_2", None, [None])]
    years = spark.createDataFrame([(1, None, "p", "007"), (2, "0", "p", "x"), (3, "id3", "p", "000")], "k int, id string, problem string, answer string")
    assert [(r.id, r.answer[0]) for r in problems.normalise(years, "aime24", "k").orderBy("n").collect()] == [("AIME24_0", "7"), ("AIME24_1", "x"), ("id3", "0")]
    files = spark.range(7473).groupBy(problems.training_file(F.col("id")).alias("f")).count().collect()
    assert {r.f: r["count"] for r in files} == {1: 2500, 2: 2500, 3: 2473}


def test_quantiles_in_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.normal(size=999).round(2)] + [("b", 1.0)] * 5 + [("c", None), ("c", 2.0), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    groups = {g: [x for h, x in data if h == g and x is not None] for g in ("a", "b", "c", None)}
    for r in D.quantiles(df, "x", "g", (0.0, 0.25, 0.5, 0.9, 1.0)).collect():
        assert [r.p0, r.p25, r.p50, r.p90, r.p100] == pytest.approx(np.percentile(groups[r.g], [0, 25, 50, 90, 100]).tolist())
    steps = D.ecdf(df, "x", "g").collect()
    for r in steps:
        assert r.share == pytest.approx(sum(x <= r.x for x in groups[r.g]) / len(groups[r.g]))
    assert D.quantiles(df.limit(0), "x", "g", (0.5,)).count() == 0 == D.ecdf(df.limit(0), "x", "g").count()


def test_batches_and_shards_of_odd_rows(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 3, 6), ("a", 4, 50), ("a", 5, 1), (None, 1, 10), (None, 2, 1)]
    got = S.batches(spark.createDataFrame(rows, "g string, o long, c long"), 10, "g", "o", "c").collect()
    assert sorted(((r.g or "", r.o), r.batch) for r in got) == [(("", 1), 0), (("", 2), 1), (("a", 1), 0), (("a", 2), 0), (("a", 3), 1), (("a", 4), 2), (("a", 5), 3)]
    units = spark.createDataFrame([("u", 0), ("v", 0), ("w", 0), ("x", 3)], "k string, w long")
    shard = lambda **o: {r.k: r.shard for r in R.balanced_shards(units, "k", "w", 2, **o).collect()}
    assert shard() == {"x": 0, "u": 1, "v": 1, "w": 1} and shard(even_counts=False) == {"x": 0, "u": 1, "v": 1, "w": 1}
    assert R.balanced_shards(units.limit(0), "k", "w", 2).count() == 0
