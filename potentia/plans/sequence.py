"""Queries of the sequence operators and of the aggregates over their results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import potential as P
from ..operators import sequence as S
from ..registry import query
from .surrogates import cliffs_sql, path_ok, path_ok_sql, tokens, tokens_sql, z_sql

PAIRS = "p AS (SELECT * FROM (SELECT *, lag(pos) OVER w AS prev_pos, lag(score) OVER w AS prev_score FROM t WHERE score IS NOT NULL WINDOW w AS (PARTITION BY path_id ORDER BY pos)) WHERE prev_pos IS NOT NULL)"


@query("SEQ1", f"WITH {tokens_sql('sparse')}, {PAIRS} SELECT path_id, prev_pos, pos, prev_score, score FROM p")
def seq1(spark, d):
    return S.pairs(tokens(spark, d, "sparse")).select("path_id", "prev_pos", "pos", "prev_score", "score")


@query("PRJ2", f"WITH {tokens_sql('sparse')} SELECT path_id, pos, score FROM t WHERE score IS NOT NULL")
def prj2(spark, d):
    return tokens(spark, d, "sparse").where("score is not null").select("path_id", "pos", "score")


@query("SEQ2", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE greatest(0, least(5, round_even(least(1, value/200)*5, 0)::INTEGER)) END AS k FROM events")
def seq2(spark, d):
    score = F.when(F.col("event_type") != "error", F.least(F.lit(1.0), F.col("value") / 200))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", P.score_to_k(score, 5).alias("k"))


@query("SEQ3", f"WITH {tokens_sql('sparse')}, {PAIRS} SELECT path_id, pos, (prev_score*64)::INTEGER AS k_prev, (score*64)::INTEGER AS k_now, {z_sql('(prev_score*64)::BIGINT', '(score*64)::BIGINT')} AS is_cliff FROM p")
def seq3(spark, d):
    return S.with_k(S.pairs(tokens(spark, d, "sparse"))).select("path_id", "pos", "k_prev", "k_now", P.is_cliff(F.col("k_prev"), F.col("k_now")).alias("is_cliff"))


@query("SEQ4", f"WITH {cliffs_sql('sparse')} SELECT path_id, pos, k_prev, k_now FROM c")
def seq4(spark, d):
    """By lookup in the boundary table (65 rows, broadcast) instead of the expression."""
    table = S.boundary(spark).where("min_drop is not null").select("k_prev", "min_drop")
    found = S.with_k(S.pairs(tokens(spark, d, "sparse"))).join(F.broadcast(table), "k_prev").where("k_prev - k_now >= min_drop")
    return found.select("path_id", "pos", F.col("k_prev").cast("long").alias("k_prev"), F.col("k_now").cast("long").alias("k_now"))


@query("SEQ5", f"WITH {cliffs_sql('sparse')} SELECT path_id, pos, token, prev_score, score, \"drop\", pos = min(pos) OVER (PARTITION BY path_id) AS is_first FROM c")
def seq5(spark, d):
    c = S.significant(tokens(spark, d, "sparse"))
    return c.select("path_id", "pos", "token", "prev_score", "score", "drop", (F.col("pos") == F.min("pos").over(Window.partitionBy("path_id"))).alias("is_first"))


GRID = f"g AS (SELECT a AS k_prev, b AS k_now, {z_sql('a', 'b')} AS is_cliff FROM range(65) x(a), range(65) y(b))"


@query("SEQ6", f"WITH {GRID} SELECT k_prev::INTEGER AS k_prev, min(CASE WHEN is_cliff THEN k_prev-k_now END)::INTEGER AS min_drop, count_if(is_cliff)::BIGINT AS cliff_cells FROM g GROUP BY k_prev")
def seq6(spark, d):
    return S.boundary(spark)


@query("SNK7", f"WITH {GRID} SELECT count(*) AS cells, count_if(is_cliff)::BIGINT AS cliff_cells, min(CASE WHEN is_cliff THEN k_prev END)::INTEGER AS least_k_prev, 64 AS n FROM g")
def snk7(spark, d):
    """The saved matrix's summary."""
    return S.boundary_grid(spark).agg(F.count("*").alias("cells"), F.count_if("is_cliff").alias("cliff_cells"), F.min(F.when(F.col("is_cliff"), F.col("k_prev"))).alias("least_k_prev"), F.lit(64).alias("n"))


@query("SEQ7", f"WITH {tokens_sql('sparse')}, {PAIRS}, q AS (SELECT path_id, pos, prev_score-score AS \"drop\" FROM p WHERE prev_score-score >= 0.3::DOUBLE) SELECT path_id, count(*) AS n, min(pos) AS first_pos, max(\"drop\") AS max_drop FROM q GROUP BY path_id")
def seq7(spark, d):
    return S.fixed_drops(tokens(spark, d, "sparse"), 0.3).groupBy("path_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("drop").alias("max_drop"))


@query("SEQ8", f"WITH {tokens_sql('sparse')}, {PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY prev_score-score DESC, pos) AS r FROM p WHERE prev_score > score) SELECT path_id, pos, token, prev_score-score AS \"drop\" FROM q WHERE r = 1")
def seq8(spark, d):
    return S.largest_drop(tokens(spark, d, "sparse"))


CRITICAL = """a AS (SELECT *, max(score) OVER w AS later_max, list(score) OVER v AS scores_after FROM t WHERE score IS NOT NULL
  WINDOW w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), v AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
  b AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS r FROM a WHERE score = 0 AND coalesce(later_max < 0.05::DOUBLE, true)),
  cr AS (SELECT path_id, pos, token, coalesce(scores_after, []) AS scores_after FROM b WHERE r = 1)"""


@query("SEQ9", f"WITH {tokens_sql('critical')}, {CRITICAL} SELECT path_id, pos, token, len(scores_after)::INTEGER AS n_after, round(list_sum(scores_after), 6) AS sum_after FROM cr")
def seq9(spark, d):
    c = S.critical(tokens(spark, d, "critical"))
    total = F.when(F.size("scores_after") > 0, F.round(F.aggregate("scores_after", F.lit(0.0), lambda a, x: a + x), 6))
    return c.select("path_id", "pos", "token", F.size("scores_after").alias("n_after"), total.alias("sum_after"))


@query("SEQ10", f"WITH {tokens_sql()}, {PAIRS} SELECT path_id, " + ", ".join(f"count_if(prev_score-score >= {x/10}::DOUBLE)::BIGINT AS n_{x}0" for x in range(1, 6)) + " FROM p GROUP BY path_id")
def seq10(spark, d):
    return S.drop_counts(tokens(spark, d))


@query("SEQ11", f"""WITH {tokens_sql('zeros')}, i AS (SELECT *, sum(CASE WHEN score = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY path_id ORDER BY pos) AS g FROM t),
  j AS (SELECT *, sum(CASE WHEN score = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id, g ORDER BY pos) AS run FROM i),
  k AS (SELECT *, min(CASE WHEN run >= 5 THEN pos END) OVER (PARTITION BY path_id) AS stop_pos FROM j)
  SELECT path_id, pos, CASE WHEN pos > stop_pos THEN 0 ELSE score END AS score, stop_pos FROM k""")
def seq11(spark, d):
    return S.stop_after_zeros(tokens(spark, d, "zeros"), 5).select("path_id", "pos", "score", "stop_pos")


@query("SEQ12", f"WITH {tokens_sql()} SELECT path_id, pos, CASE WHEN (pos-1) % 4 = 0 THEN score END AS score FROM t")
def seq12(spark, d):
    return S.sampled(tokens(spark, d), 4).select("path_id", "pos", "score")


@query("SEQ13", f"""WITH {cliffs_sql('short')}, {path_ok_sql()}
  SELECT path_id, count(c.pos) AS n_cliffs, count(c.pos)/max(total_tokens)::DOUBLE AS density, avg(c.pos/total_tokens::DOUBLE) AS mean_position FROM ok LEFT JOIN c USING (path_id) GROUP BY path_id""".replace("density,", "density,").replace("count(c.pos)/max(total_tokens)::DOUBLE", "round(count(c.pos)/max(total_tokens)::DOUBLE, 9)").replace("avg(c.pos/total_tokens::DOUBLE)", "round(avg(c.pos/total_tokens::DOUBLE), 9)"))
def seq13(spark, d):
    c = S.significant(tokens(spark, d, "short")).select("path_id", "pos")
    j = path_ok(spark, d, True).join(c, "path_id", "left")
    return j.groupBy("path_id").agg(F.count("pos").alias("n_cliffs"), F.round(F.count("pos") / F.max("total_tokens"), 9).alias("density"), F.round(F.avg(F.col("pos") / F.col("total_tokens")), 9).alias("mean_position"))


@query("PRJ5", f"""WITH {cliffs_sql()}, {path_ok_sql()} SELECT path_id, pos, CASE WHEN pos/total_tokens::DOUBLE < 1/3::DOUBLE THEN 'early' WHEN pos/total_tokens::DOUBLE < 1/3::DOUBLE*2 THEN 'middle' ELSE 'late' END AS region FROM c JOIN ok USING (path_id)""")
def prj5(spark, d):
    return S.significant(tokens(spark, d)).join(path_ok(spark, d).select("path_id", "total_tokens"), "path_id").select("path_id", "pos", P.region(F.col("pos"), F.col("total_tokens")).alias("region"))


BOUNDS = """pa AS (SELECT path_id, list(score ORDER BY pos) AS scores, count(*) AS n FROM t GROUP BY path_id),
  bo AS (SELECT path_id, scores, n, unnest(range(20)) AS chunk, CASE WHEN n < 2 THEN NULL ELSE list_transform(range(21), lambda i: CASE WHEN i = 20 THEN n-1 ELSE floor(i*((n-1)/20::DOUBLE))::BIGINT END) END AS b FROM pa),
  ch AS (SELECT path_id, chunk, b[chunk+1] AS start_idx, b[chunk+2] AS end_idx, scores[b[chunk+1]+1] AS start_score, scores[b[chunk+2]+1] AS end_score FROM bo WHERE n >= 2),
  cx AS (SELECT *, start_score-end_score AS "drop", coalesce(start_score-end_score >= 0.3::DOUBLE, false) AS is_tangent FROM ch)"""


@query("SEQ14", "SELECT n, CASE WHEN n < 2 THEN 1 ELSE 21 END AS n_bounds, CASE WHEN n < 2 THEN 0 ELSE list_sum(list_transform(range(21), lambda i: CASE WHEN i = 20 THEN n-1 ELSE floor(i*((n-1)/20::DOUBLE))::BIGINT END))::BIGINT END AS total FROM range(1, 3000) r(n)")
def seq14(spark, d):
    b = spark.range(1, 3000).select(F.col("id").alias("n"), S.chunk_bounds(F.col("id")).alias("b"))
    return b.select("n", F.size("b").alias("n_bounds"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SEQ15", f"WITH {tokens_sql()}, {BOUNDS} SELECT path_id, chunk, start_idx, end_idx, start_score, end_score, \"drop\", is_tangent FROM cx")
def seq15(spark, d):
    return S.chunks(tokens(spark, d))


@query("SEQ16", f"WITH {tokens_sql()}, {BOUNDS} SELECT path_id, min_by(start_idx, chunk) AS start_idx, min(chunk) AS chunk FROM cx WHERE is_tangent GROUP BY path_id")
def seq16(spark, d):
    return S.chunks(tokens(spark, d)).where("is_tangent").groupBy("path_id").agg(F.min_by("start_idx", "chunk").alias("start_idx"), F.min("chunk").alias("chunk"))


INSIDE = f"{cliffs_sql()}, {BOUNDS}, ins AS (SELECT cx.*, c.pos AS cliff_pos FROM cx JOIN c ON cx.path_id = c.path_id AND c.pos-1 BETWEEN start_idx AND end_idx)"


@query("J7", f"WITH {INSIDE} SELECT path_id, chunk, cliff_pos, is_tangent FROM ins")
def j7(spark, d):
    t = tokens(spark, d)
    return S.cliffs_in_chunks(S.chunks(t), S.significant(t)).select("path_id", "chunk", "cliff_pos", "is_tangent")


FIRSTS = f"""{tokens_sql('critical')}, {PAIRS}, cl AS (SELECT * FROM p WHERE {z_sql('(prev_score*64)::BIGINT', '(score*64)::BIGINT')}), {CRITICAL},
  fc AS (SELECT path_id, min(pos) AS cliff_pos FROM cl GROUP BY path_id)"""


def _firsts(spark, d):
    t = tokens(spark, d, "critical")
    cliffs = S.significant(t)
    return t, cliffs, cliffs.groupBy("path_id").agg(F.min("pos").alias("cliff_pos")), S.critical(t).select("path_id", F.col("pos").alias("critical_pos"))


def _category(x="distance"):
    return F.when(F.col(x) < 0, "before").when(F.col(x) == 0, "same").otherwise("after")


@query("SEQ17", f"WITH {FIRSTS} SELECT path_id, cliff_pos, cr.pos AS critical_pos, cliff_pos-cr.pos AS distance, CASE WHEN cliff_pos < cr.pos THEN 'before' WHEN cliff_pos = cr.pos THEN 'same' ELSE 'after' END AS category FROM fc JOIN cr USING (path_id)")
def seq17(spark, d):
    _, _, first, crit = _firsts(spark, d)
    return first.join(crit, "path_id").withColumn("distance", F.col("cliff_pos") - F.col("critical_pos")).withColumn("category", _category())


@query("SEQ18", f"WITH {FIRSTS} SELECT cl.path_id, cl.pos, cl.pos-cr.pos AS distance, CASE WHEN cl.pos <= cr.pos THEN cl.pos/cr.pos::DOUBLE END AS ratio, cl.pos > cr.pos AS excluded FROM cl JOIN cr ON cl.path_id = cr.path_id")
def seq18(spark, d):
    _, cliffs, _, crit = _firsts(spark, d)
    j = cliffs.select("path_id", "pos").join(crit, "path_id")
    past = F.col("pos") > F.col("critical_pos")
    return j.select("path_id", "pos", (F.col("pos") - F.col("critical_pos")).alias("distance"), F.when(~past, F.col("pos") / F.col("critical_pos")).alias("ratio"), past.alias("excluded"))


@query("SEQ19", f"""WITH {cliffs_sql()}, x AS (SELECT path_id, pos, array_to_string(list(token) OVER b, ' ') AS before, array_to_string(list(token) OVER a, ' ') AS after, array_to_string(list(token) OVER w, '|') AS window_ FROM t
  WINDOW b AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
  SELECT path_id, pos, coalesce(before, '') AS before, coalesce(after, '') AS after, window_ AS "window" FROM x JOIN c USING (path_id, pos)""")
def seq19(spark, d):
    t = tokens(spark, d)
    return S.context(t).join(S.significant(t).select("path_id", "pos"), ["path_id", "pos"]).select("path_id", "pos", "before", "after", "window")


@query("SEQ20", f"""WITH {cliffs_sql('sparse')}, o AS (SELECT path_id, pos+1 AS pos, score AS own FROM t)
  SELECT c.path_id, c.pos, coalesce(own, prev_score) AS before_or_prev, coalesce(own, 0) AS before_or_zero, score AS at FROM c LEFT JOIN o ON c.path_id = o.path_id AND c.pos = o.pos""")
def seq20(spark, d):
    t = tokens(spark, d, "sparse")
    own = t.select("path_id", (F.col("pos") + 1).alias("pos"), F.col("score").alias("own"))
    return S.significant(t).join(own, ["path_id", "pos"], "left").select("path_id", "pos", F.coalesce("own", "prev_score").alias("before_or_prev"), F.coalesce("own", F.lit(0.0)).alias("before_or_zero"), F.col("score").alias("at"))


@query("SEQ21", """WITH RECURSIVE r AS (SELECT source, doc_id, coalesce(n_chars, 0)::BIGINT AS n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id, n_chars) AS k FROM documents),
  b AS (SELECT source, doc_id, n_chars, k, n_chars AS used, 0::BIGINT AS batch FROM r WHERE k = 1
    UNION ALL SELECT r.source, r.doc_id, r.n_chars, r.k, CASE WHEN b.used > 0 AND b.used + r.n_chars > 16384 THEN r.n_chars ELSE b.used + r.n_chars END, CASE WHEN b.used > 0 AND b.used + r.n_chars > 16384 THEN b.batch + 1 ELSE b.batch END
      FROM b JOIN r ON r.source = b.source AND r.k = b.k + 1)
  SELECT source, doc_id, n_chars, batch FROM b""")
def seq21(spark, d):
    """Greedy batches of documents within a source by size."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "n_chars")
    return S.batches(docs, 16384, "source", "doc_id", "n_chars")


# Aggregates over drops.

RATE = f"""{cliffs_sql('short')}, {path_ok_sql()}, per AS (SELECT ok.path_id, ok.model, ok.dataset, is_correct, total_tokens, count(c.pos) AS n FROM ok LEFT JOIN c ON c.path_id = ok.path_id GROUP BY ALL)"""


def _per_path(spark, d):
    return S.profile(tokens(spark, d, "short"), "path_id", "model", "dataset").withColumn("is_correct", F.col("last_token").isin("purchase", "view"))


@query("AGG3", f"WITH {RATE} SELECT model, is_correct, count(*) AS n_paths, count_if(n > 0)::BIGINT AS with_cliff, round(100*count_if(n > 0)/count(*)::DOUBLE, 6) AS rate FROM per GROUP BY model, is_correct")
def agg3(spark, d):
    has = F.count_if(F.col("n") > 0)
    return _per_path(spark, d).groupBy("model", "is_correct").agg(F.count("*").alias("n_paths"), has.alias("with_cliff"), F.round(100 * has / F.count("*"), 6).alias("rate"))


@query("AGG1", f"""WITH {RATE}, reg AS (SELECT ok.model, ok.is_correct, CASE WHEN pos/total_tokens::DOUBLE < 1/3::DOUBLE THEN 'early' WHEN pos/total_tokens::DOUBLE < 1/3::DOUBLE*2 THEN 'middle' ELSE 'late' END AS r FROM c JOIN ok USING (path_id)),
  rc AS (SELECT model, is_correct, count_if(r='early')::BIGINT AS early, count_if(r='middle')::BIGINT AS middle, count_if(r='late')::BIGINT AS late FROM reg GROUP BY ALL)
  SELECT per.model, per.is_correct, count(*) AS n_paths, count_if(n > 0)::BIGINT AS with_cliff, round(avg(n), 6) AS mean_cliffs, round(avg(n/total_tokens::DOUBLE), 9) AS mean_density, coalesce(max(early), 0) AS early, coalesce(max(middle), 0) AS middle, coalesce(max(late), 0) AS late
  FROM per LEFT JOIN rc ON per.model = rc.model AND per.is_correct = rc.is_correct GROUP BY per.model, per.is_correct""")
def agg1(spark, d):
    paths = path_ok(spark, d, True)
    c = S.significant(tokens(spark, d, "short")).select("path_id", "pos")
    where = P.region(F.col("pos"), F.col("total_tokens"))
    per = paths.join(c, "path_id", "left").groupBy("path_id", "model", "is_correct", "total_tokens").agg(F.count("pos").alias("n"), *[F.count_if(F.col("pos").isNotNull() & (where == r)).alias(r) for r in ("early", "middle", "late")])
    return per.groupBy("model", "is_correct").agg(F.count("*").alias("n_paths"), F.count_if(F.col("n") > 0).alias("with_cliff"), F.round(F.avg("n"), 6).alias("mean_cliffs"), F.round(F.avg(F.col("n") / F.col("total_tokens")), 9).alias("mean_density"), *[F.sum(r).alias(r) for r in ("early", "middle", "late")])


@query("AGG2", f"""WITH {tokens_sql('short')}, {path_ok_sql()}, {PAIRS}, m AS (SELECT path_id, max(prev_score-score) AS m FROM p GROUP BY path_id), th AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS threshold)
  SELECT model, threshold, is_correct, count(*) AS n_paths, round(100*count_if(coalesce(m >= threshold, false))/count(*)::DOUBLE, 6) AS rate FROM ok LEFT JOIN m USING (path_id), th GROUP BY ALL""")
def agg2(spark, d):
    most = S.pairs(tokens(spark, d, "short")).groupBy("path_id").agg(F.max(F.col("prev_score") - F.col("score")).alias("m"))
    rows = path_ok(spark, d, True).join(most, "path_id", "left").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])))
    hit = F.coalesce(F.col("m") >= F.col("threshold"), F.lit(False))
    return rows.groupBy("model", "threshold", "is_correct").agg(F.count("*").alias("n_paths"), F.round(100 * F.count_if(hit) / F.count("*"), 6).alias("rate"))


@query("AGG4", f"""WITH {RATE} SELECT model, round(avg(n) FILTER (is_correct), 6) AS cliffs_success, round(avg(n) FILTER (NOT is_correct), 6) AS cliffs_failure, count_if(is_correct)::BIGINT AS n_success, count_if(NOT is_correct)::BIGINT AS n_failure, round(100*count_if(is_correct)/count(*)::DOUBLE, 6) AS accuracy FROM per GROUP BY model""")
def agg4(spark, d):
    ok = F.col("is_correct")
    return _per_path(spark, d).groupBy("model").agg(F.round(F.avg(F.when(ok, F.col("n"))), 6).alias("cliffs_success"), F.round(F.avg(F.when(~ok, F.col("n"))), 6).alias("cliffs_failure"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failure"), F.round(100 * F.count_if(ok) / F.count("*"), 6).alias("accuracy"))


@query("AGG5", f"""WITH {tokens_sql()}, {path_ok_sql()}, {PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY prev_score-score DESC, pos) AS r FROM p WHERE prev_score > score)
  SELECT q.path_id, ok.model, q.pos, prev_score-score AS "drop" FROM q JOIN ok ON q.path_id = ok.path_id WHERE r = 1 AND NOT is_correct AND prev_score-score >= 0.5::DOUBLE""")
def agg5(spark, d):
    failed = path_ok(spark, d).where("not is_correct").select("path_id", "model")
    return S.largest_drop(tokens(spark, d)).where("drop >= 0.5").join(failed, "path_id").select("path_id", "model", "pos", "drop")


@query("AGG6", f"""WITH {FIRSTS}, al AS (SELECT DISTINCT path_id FROM t), z AS (SELECT fc.path_id IS NOT NULL AS c, cr.path_id IS NOT NULL AS k FROM al LEFT JOIN fc ON fc.path_id = al.path_id LEFT JOIN cr ON cr.path_id = al.path_id)
  SELECT count_if(c AND k)::BIGINT AS both_found, count_if(c AND NOT k)::BIGINT AS cliff_only, count_if(k AND NOT c)::BIGINT AS critical_only, count_if(NOT c AND NOT k)::BIGINT AS neither FROM z""")
def agg6(spark, d):
    t, _, first, crit = _firsts(spark, d)
    z = t.select("path_id").distinct().join(first, "path_id", "left").join(crit, "path_id", "left")
    c, k = F.col("cliff_pos").isNotNull(), F.col("critical_pos").isNotNull()
    return z.agg(F.count_if(c & k).alias("both_found"), F.count_if(c & ~k).alias("cliff_only"), F.count_if(k & ~c).alias("critical_only"), F.count_if(~c & ~k).alias("neither"))


@query("AGG7", f"""WITH {INSIDE}, x AS (SELECT c.model, c.path_id, c.pos, coalesce(bool_or(ins.is_tangent), false) AS inside FROM c LEFT JOIN ins ON ins.path_id = c.path_id AND ins.cliff_pos = c.pos GROUP BY ALL)
  SELECT coalesce(model, 'all') AS model, count(*) AS n, count_if(inside)::BIGINT AS inside, round(100*count_if(inside)/count(*)::DOUBLE, 6) AS rate FROM x GROUP BY ROLLUP(model)""")
def agg7(spark, d):
    t = tokens(spark, d)
    cliffs = S.significant(t)
    hit = S.cliffs_in_chunks(S.chunks(t).where("is_tangent"), cliffs).select("path_id", F.col("cliff_pos").alias("pos")).distinct().withColumn("inside", F.lit(True))
    rows = cliffs.select("model", "path_id", "pos").join(hit, ["path_id", "pos"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return rows.rollup("model").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"), F.round(100 * F.count_if("inside") / F.count("*"), 6).alias("rate")).withColumn("model", F.coalesce("model", F.lit("all")))


@query("AGG8", f"""WITH {FIRSTS}, x AS (SELECT CASE WHEN cl.pos < cr.pos THEN 'before' WHEN cl.pos = cr.pos THEN 'same' ELSE 'after' END AS category FROM cl JOIN cr ON cl.path_id = cr.path_id)
  SELECT category, count(*) AS n, round(100*count(*)/sum(count(*)) OVER ()::DOUBLE, 6) AS pct FROM x GROUP BY category""")
def agg8(spark, d):
    _, cliffs, _, crit = _firsts(spark, d)
    n = cliffs.select("path_id", "pos").join(crit, "path_id").withColumn("distance", F.col("pos") - F.col("critical_pos")).groupBy(_category().alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("AGG9", f"""WITH {INSIDE}, a AS (SELECT 'tangent_has_cliff' AS direction, count(*) AS n, count_if(hit)::BIGINT AS overlap FROM (SELECT cx.path_id, cx.chunk, bool_or(ins.cliff_pos IS NOT NULL) AS hit FROM cx LEFT JOIN ins ON ins.path_id = cx.path_id AND ins.chunk = cx.chunk WHERE cx.is_tangent GROUP BY ALL)),
  b AS (SELECT 'cliff_in_tangent' AS direction, count(*) AS n, count_if(hit)::BIGINT AS overlap FROM (SELECT c.path_id, c.pos, coalesce(bool_or(ins.is_tangent), false) AS hit FROM c LEFT JOIN ins ON ins.path_id = c.path_id AND ins.cliff_pos = c.pos GROUP BY ALL)) SELECT * FROM a UNION ALL SELECT * FROM b""")
def agg9(spark, d):
    t = tokens(spark, d)
    cliffs, tangents = S.significant(t), S.chunks(t).where("is_tangent")
    hits = S.cliffs_in_chunks(tangents, cliffs)
    count = lambda df, hit, name: df.agg(F.lit(name).alias("direction"), F.count("*").alias("n"), F.count_if(hit).alias("overlap"))
    a = tangents.select("path_id", "chunk").join(hits.select("path_id", "chunk", F.lit(True).alias("hit")).distinct(), ["path_id", "chunk"], "left")
    b = cliffs.select("path_id", "pos").join(hits.select("path_id", F.col("cliff_pos").alias("pos"), F.lit(True).alias("hit")).distinct(), ["path_id", "pos"], "left")
    hit = F.col("hit").isNotNull()
    return count(a, hit, "tangent_has_cliff").unionByName(count(b, hit, "cliff_in_tangent"))


@query("AGG10", f"""WITH {INSIDE}, x AS (SELECT c.path_id, c.pos, coalesce(bool_or(ins.is_tangent), false) AS hit FROM c LEFT JOIN ins ON ins.path_id = c.path_id AND ins.cliff_pos = c.pos GROUP BY ALL)
  SELECT path_id, count_if(hit)::BIGINT AS inside, count_if(NOT hit)::BIGINT AS outside FROM x GROUP BY path_id HAVING count_if(hit) > 0 AND count_if(NOT hit) > 0""")
def agg10(spark, d):
    t = tokens(spark, d)
    cliffs = S.significant(t)
    hit = S.cliffs_in_chunks(S.chunks(t).where("is_tangent"), cliffs).select("path_id", F.col("cliff_pos").alias("pos"), F.lit(True).alias("hit")).distinct()
    rows = cliffs.select("path_id", "pos").join(hit, ["path_id", "pos"], "left").groupBy("path_id").agg(F.count_if(F.col("hit").isNotNull()).alias("inside"), F.count_if(F.col("hit").isNull()).alias("outside"))
    return rows.where("inside > 0 and outside > 0")


@query("AGG42", f"WITH {tokens_sql()}, b AS (SELECT path_id, pos, unnest(range(64)) < k AS correct FROM t) SELECT path_id, pos, count(*) AS n, count_if(correct)/count(*)::DOUBLE AS score FROM b GROUP BY path_id, pos")
def agg42(spark, d):
    """Scores again from single rollouts: correct of all."""
    rollouts = tokens(spark, d).select("path_id", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i < F.col("k"))).alias("correct"))
    return rollouts.groupBy("path_id", "pos").agg(F.count("*").alias("n"), (F.count_if("correct") / F.count("*")).alias("score"))


@query("TOP6", f"WITH {cliffs_sql()} SELECT path_id, min(pos) AS first_pos, min_by(pos, md5('42:'||path_id||':'||pos)) AS random_pos FROM c GROUP BY path_id")
def top6(spark, d):
    order = F.md5(F.concat(F.lit("42:"), F.col("path_id"), F.lit(":"), F.col("pos")).cast("binary"))
    return S.significant(tokens(spark, d)).groupBy("path_id").agg(F.min("pos").alias("first_pos"), F.min_by("pos", order).alias("random_pos"))


@query("SMP4", f"WITH {tokens_sql()}, n AS (SELECT path_id, max(pos) AS n FROM t GROUP BY path_id) SELECT path_id, 1 + ('0x'||substr(md5('42:'||path_id), 1, 8))::BIGINT % (n-1) AS position FROM n WHERE n >= 2")
def smp4(spark, d):
    n = tokens(spark, d).groupBy("path_id").agg(F.max("pos").alias("n")).where("n >= 2")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("path_id")).cast("binary")), 1, 8), 16, 10).cast("long")
    return n.select("path_id", (1 + h % (F.col("n") - 1)).alias("position"))


@query("SRC7", f"WITH {tokens_sql('sparse')} SELECT path_id, count(score) AS n_scores FROM t GROUP BY path_id HAVING count(score) > 0")
def src7(spark, d):
    return tokens(spark, d, "sparse").groupBy("path_id").agg(F.count("score").alias("n_scores")).where("n_scores > 0")


@query("SRC15", f"WITH {tokens_sql('sparse')} SELECT model, dataset, path_id, pos, token, score FROM t")
def src15(spark, d):
    """Arrays a path, zipped (the shorter padded with nulls) and flattened again."""
    rows = tokens(spark, d, "sparse").groupBy("path_id", "model", "dataset").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "score"))).alias("own"))
    arrays = rows.select("path_id", "model", "dataset", F.transform("own", lambda x: x["token"]).alias("tokens"), F.transform("own", lambda x: x["score"]).alias("scores"))
    flat = arrays.select("model", "dataset", "path_id", F.posexplode(F.arrays_zip("tokens", "scores")).alias("pos", "z"))
    return flat.select("model", "dataset", "path_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("z.tokens").alias("token"), F.col("z.scores").alias("score"))


@query("J1", f"WITH {cliffs_sql()}, {path_ok_sql()} SELECT c.path_id, c.pos, ok.is_correct, total_tokens FROM c JOIN (SELECT * FROM ok WHERE total_tokens % 2 = 0) ok ON c.path_id = ok.path_id")
def j1(spark, d):
    paths = path_ok(spark, d).where("total_tokens % 2 = 0").select("path_id", "is_correct", "total_tokens")
    return S.significant(tokens(spark, d)).select("path_id", "pos").join(paths, "path_id")


@query("J10", f"WITH {cliffs_sql()}, {path_ok_sql()} SELECT c.path_id, c.pos, coalesce(CASE WHEN c.pos % 2 = 0 THEN false END, ok.is_correct, false) AS path_is_correct FROM c LEFT JOIN (SELECT * FROM ok WHERE path_id % 3 <> 0) ok ON c.path_id = ok.path_id")
def j10(spark, d):
    """Correctness, where a row lacks it, from the paths; false where they lack it too."""
    rows = S.significant(tokens(spark, d)).select("path_id", "pos", F.when(F.col("pos") % 2 == 0, F.lit(False)).alias("own"))
    paths = path_ok(spark, d).where("path_id % 3 <> 0").select("path_id", "is_correct")
    return rows.join(paths, "path_id", "left").select("path_id", "pos", F.coalesce("own", "is_correct", F.lit(False)).alias("path_is_correct"))


@query("J14", f"WITH {tokens_sql('sparse')} SELECT path_id, pos, score, k FROM t WHERE score IS NOT NULL AND k > 2")
def j14(spark, d):
    """Two parallel arrays zipped; rows where either is missing fall out."""
    rows = tokens(spark, d, "sparse").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("pos", "score", F.when(F.col("k") > 2, F.col("k")).alias("k")))).alias("own"))
    z = rows.select("path_id", F.posexplode(F.arrays_zip(F.transform("own", lambda x: x["score"]).alias("score"), F.transform("own", lambda x: x["k"]).alias("k"))).alias("pos", "z"))
    return z.where("z.score is not null and z.k is not null").select("path_id", (F.col("pos") + 1).cast("long").alias("pos"), "z.score", "z.k")


@query("AGG17", f"""WITH {FIRSTS}, {path_ok_sql()}, {BOUNDS}, f AS (SELECT path_id FROM ok WHERE NOT is_correct), tg AS (SELECT DISTINCT path_id FROM cx WHERE is_tangent)
  SELECT 'all_failure' AS population, path_id FROM f UNION ALL SELECT 'cliff_first', path_id FROM f WHERE path_id IN (SELECT path_id FROM fc)
  UNION ALL SELECT 'population_tangent', path_id FROM f WHERE path_id IN (SELECT path_id FROM fc) AND path_id IN (SELECT path_id FROM cr) AND path_id IN (SELECT path_id FROM tg)""")
def agg17(spark, d):
    t, _, first, crit = _firsts(spark, d)
    failed = t.groupBy("path_id").agg(F.max_by("token", "pos").alias("last")).where(~F.col("last").isin("purchase", "view")).select("path_id")
    tangent = S.chunks(t).where("is_tangent").select("path_id")
    with_cliff = failed.join(first, "path_id", "left_semi")
    all_three = with_cliff.join(crit, "path_id", "left_semi").join(tangent, "path_id", "left_semi")
    named = lambda df, name: df.select(F.lit(name).alias("population"), "path_id")
    return named(failed, "all_failure").unionByName(named(with_cliff, "cliff_first")).unionByName(named(all_three, "population_tangent"))
