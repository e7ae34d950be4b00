"""Queries of distributions, taxonomies and candidate sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import potential as P
from ..operators import distribution as D
from ..registry import query
from .surrogates import BOUND, candidates, candidates_sql, cliff_instances, instances_sql, table

CANDS = candidates_sql()
INST = f"{CANDS}, {instances_sql()}"
SHIFT = f"{CANDS}, {candidates_sql(15.0, 'v', 20, True)}"


@query("DST1", f"WITH {CANDS} SELECT uid, round(-sum(exp(lp)*lp), 9) AS entropy FROM s GROUP BY uid")
def dst1(spark, d):
    return D.partial_entropy(candidates(spark, d)).withColumn("entropy", F.round("entropy", 9))


@query("DST2", f"WITH {CANDS} SELECT uid, tid, rank FROM s")
def dst2(spark, d):
    return D.tie_ranks(candidates(spark, d).select("uid", "tid", "lp")).select("uid", "tid", "rank")


@query("DST3", "SELECT p, round(-(p*ln(p)+(1-p)*ln(1-p)), 9) AS h FROM (SELECT unnest([0.99, 0.95, 0.90])::DOUBLE AS p)")
def dst3(spark, d):
    ps = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in P.ENTROPY_AT])).alias("p"))
    return ps.select("p", F.round(P.binary_entropy_col(F.col("p")), 9).alias("h"))


@query("DST4", f"WITH {CANDS} SELECT uid, tid, place FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY prob DESC, tid) AS place FROM s) WHERE place <= 10")
def dst4(spark, d):
    return D.top_k(candidates(spark, d), 10, F.desc("prob"), F.col("tid")).select("uid", "tid", "place")


@query("DST5", f"WITH {candidates_sql(15.0, 's', 20, True)} SELECT uid, tid, place FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rank, tid) AS place FROM s) WHERE place <= 20")
def dst5(spark, d):
    return D.top_k(candidates(spark, d, 15.0, 20, True), 20, F.col("rank"), F.col("tid")).select("uid", "tid", "place")


@query("DST6", f"WITH {CANDS} SELECT uid, round(sum(exp(lp)), 9) AS mass, round(greatest(0, 1-sum(exp(lp))), 9) AS tail FROM s GROUP BY uid")
def dst6(spark, d):
    return D.masses(candidates(spark, d)).select("uid", F.round("mass", 9).alias("mass"), F.round("tail", 9).alias("tail"))


def temperature_sql(values) -> str:
    return f"""th AS (SELECT unnest({list(values)})::DOUBLE AS temperature), w0 AS (SELECT s.*, temperature, max(lp) OVER z AS m, row_number() OVER (PARTITION BY uid, temperature ORDER BY lp DESC, tid) AS rr FROM s, th WINDOW z AS (PARTITION BY uid, temperature)),
      w1 AS (SELECT *, CASE WHEN temperature > 0 THEN exp((lp-m)/temperature) ELSE 0 END AS w FROM w0),
      w AS (SELECT *, CASE WHEN temperature = 0 THEN CASE WHEN rr = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE w/sum(w) OVER (PARTITION BY uid, temperature) END AS p_t FROM w1)"""


@query("DST7", f"WITH {CANDS}, {temperature_sql([0.0, 0.7, 1.0, 2.0, 5.0])} SELECT uid, tid, temperature, round(p_t, 9) AS p_t FROM w")
def dst7(spark, d):
    return D.at_temperature(candidates(spark, d), (0, 0.7, 1, 2, 5)).select("uid", "tid", "temperature", F.round("p_t", 9).alias("p_t"))


@query("J8", f"WITH {CANDS}, k AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS k) SELECT uid, tid, k FROM s, k WHERE selected")
def j8(spark, d):
    """Rows by a short literal grid: exploded, so no join."""
    return candidates(spark, d).where("selected").select("uid", "tid", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8, 16, 32, 64)])).alias("k"))


PCT = ", ".join(f"round(quantile_cont(entropy, {p/100}), 9) AS p{p}" for p in (60, 70, 80, 90))


def _pct(spark, d):
    out = D.percentiles(cliff_instances(spark, d), "entropy", "dataset", (0.6, 0.7, 0.8, 0.9))
    return out.select("dataset", *[F.round(c, 9).alias(c) for c in ("p60", "p70", "p80", "p90")])


@query("DST8", f"WITH {INST} SELECT coalesce(dataset, 'combined') AS dataset, {PCT} FROM ci GROUP BY ROLLUP(dataset)")
def dst8(spark, d):
    return _pct(spark, d)


@query("AGG29", f"WITH {INST} SELECT dataset, round(p90 - max(CASE WHEN dataset = 'combined' THEN p90 END) OVER (), 9) AS p90_gap FROM (SELECT coalesce(dataset, 'combined') AS dataset, quantile_cont(entropy, 0.9) AS p90 FROM ci GROUP BY ROLLUP(dataset))")
def agg29(spark, d):
    """Each dataset's 90th percentile against that of all."""
    out = D.percentiles(cliff_instances(spark, d), "entropy", "dataset", (0.9,))
    combined = F.max(F.when(F.col("dataset") == "combined", F.col("p90"))).over(Window.partitionBy(F.lit(0)))  # a row a dataset
    return out.select("dataset", F.round(F.col("p90") - combined, 9).alias("p90_gap"))


@query("DST9", "WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, value, round(sum(n) OVER (PARTITION BY event_type ORDER BY value)/sum(n) OVER (PARTITION BY event_type)::DOUBLE, 9) AS share FROM c")
def dst9(spark, d):
    return D.ecdf(table(spark, d, "events"), "value", "event_type").select("event_type", "value", F.round("share", 9).alias("share"))


@query("DST10", f"""WITH {INST}, st AS (SELECT dataset, count(*) AS n, stddev_samp(entropy) AS sd, min(entropy) AS lo, max(entropy) AS hi FROM ci GROUP BY dataset HAVING count(*) >= 2 AND stddev_samp(entropy) >= 1e-8),
  g AS (SELECT *, sd*pow(n::DOUBLE, -0.2::DOUBLE) AS h, unnest(range(400)) AS i FROM st), gx AS (SELECT *, lo+(hi-lo)*i/399 AS x FROM g)
  SELECT gx.dataset, i, round(x, 9) AS x, round(sum(exp(-pow((x-entropy)/h, 2)/2)/(n*h*{D.SQRT_2PI}::DOUBLE)), 6) AS density FROM gx JOIN ci ON ci.dataset = gx.dataset GROUP BY gx.dataset, i, x""")
def dst10(spark, d):
    return D.kde(cliff_instances(spark, d).select("dataset", "entropy"), "entropy", "dataset").select("dataset", "i", F.round("x", 9).alias("x"), F.round("density", 6).alias("density"))


@query("DST11", f"WITH {CANDS} SELECT least(floor(potential/(1/20::DOUBLE)), 19)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def dst11(spark, d):
    return D.histogram(candidates(spark, d), "potential", 20)


@query("DST12", f"WITH {SHIFT} SELECT s.rank AS source_rank, coalesce(v.rank, 21) AS eval_rank, count(*) AS n FROM s LEFT JOIN v USING (uid, tid) GROUP BY 1, 2")
def dst12(spark, d):
    return _shift(spark, d).groupBy("source_rank", "eval_rank").agg(F.count("*").alias("n"))


def _shift(spark, d):
    v = candidates(spark, d, 15.0, 20, True).select("uid", "tid", F.col("rank").alias("vr"), F.col("lp").alias("vl"), F.col("prob").alias("vp"))
    j = candidates(spark, d).join(v, ["uid", "tid"], "left")
    return j.select("uid", "tid", "selected", "potential", F.col("rank").alias("source_rank"), F.col("prob").alias("source_prob"), F.coalesce("vr", F.lit(21)).cast("long").alias("eval_rank"), F.coalesce("vl", F.lit(-1e9)).alias("eval_lp"), F.coalesce("vp", F.lit(0.0)).alias("eval_prob"))


@query("J4", f"WITH {SHIFT} SELECT uid, tid, s.rank AS source_rank, coalesce(v.rank, 21) AS eval_rank, round(coalesce(v.lp, -1e9), 6) AS eval_lp, round(coalesce(v.prob, 0), 9) AS eval_prob FROM s LEFT JOIN v USING (uid, tid)")
def j4(spark, d):
    return _shift(spark, d).select("uid", "tid", "source_rank", "eval_rank", F.round("eval_lp", 6).alias("eval_lp"), F.round("eval_prob", 9).alias("eval_prob"))


FLAGGED = "(s.potential < 0.3::DOUBLE OR s.selected)"
CPM = f"{SHIFT}, {instances_sql()}, cs AS (SELECT uid, sum(prob) AS cpm_source, count(*) AS n_tokens FROM s WHERE {FLAGGED} GROUP BY uid), ce AS (SELECT v.uid, sum(v.prob) AS cpm_eval FROM v SEMI JOIN (SELECT uid, tid FROM s WHERE {FLAGGED}) f ON v.uid = f.uid AND v.tid = f.tid GROUP BY v.uid), cpm AS (SELECT ci.uid, ci.kind, ci.dataset, cpm_source, coalesce(cpm_eval, 0) AS cpm_eval, n_tokens FROM cs JOIN ci USING (uid) LEFT JOIN ce USING (uid))"


def _cpm(spark, d):
    s, v = candidates(spark, d), candidates(spark, d, 15.0, 20, True)
    flagged = s.where("potential < 0.3 or selected")
    source = flagged.groupBy("uid").agg(F.sum("prob").alias("cpm_source"), F.count("*").alias("n_tokens"))
    eval_ = v.join(flagged.select("uid", "tid"), ["uid", "tid"], "left_semi").groupBy("uid").agg(F.sum("prob").alias("cpm_eval"))
    j = source.join(cliff_instances(spark, d).select("uid", "kind", "dataset"), "uid").join(eval_, "uid", "left")
    return j.withColumn("cpm_eval", F.coalesce("cpm_eval", F.lit(0.0)))


@query("J5", f"WITH {CPM} SELECT uid, round(cpm_eval, 9) AS cpm_eval FROM cpm")
def j5(spark, d):
    return _cpm(spark, d).select("uid", F.round("cpm_eval", 9).alias("cpm_eval"))


@query("J6", f"WITH {SHIFT} SELECT s.uid, s.tid, s.rank FROM s SEMI JOIN (SELECT uid, tid FROM v WHERE selected) k ON s.uid = k.uid AND s.tid = k.tid")
def j6(spark, d):
    keys = candidates(spark, d, 15.0, 20, True).where("selected").select("uid", "tid")
    s = candidates(spark, d)
    return (s.join(keys, ["uid", "tid"], "left_semi") if keys.limit(1).count() else s).select("uid", "tid", "rank")


@query("AGG37", f"""WITH {CPM} SELECT coalesce(dataset, 'all') AS dataset, kind, count(*) AS n, round(avg(cpm_eval-cpm_source), 9) AS mean_delta, round(quantile_cont(cpm_eval-cpm_source, 0.5), 9) AS median_delta FROM cpm GROUP BY GROUPING SETS ((dataset, kind), (kind))""")
def agg37(spark, d):
    c = _cpm(spark, d).withColumn("delta", F.col("cpm_eval") - F.col("cpm_source"))
    both = c.groupingSets([[F.col("dataset"), F.col("kind")], [F.col("kind")]], "dataset", "kind").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 9).alias("mean_delta"), F.round(F.percentile("delta", F.lit(0.5)), 9).alias("median_delta"))
    return both.select(F.coalesce("dataset", F.lit("all")).alias("dataset"), "kind", "n", "mean_delta", "median_delta")


@query("DST14", f"WITH {CPM} SELECT kind, round(avg(cpm_eval-cpm_source), 9) AS mean, round(quantile_cont(cpm_eval-cpm_source, 0.5), 9) AS median, round(quantile_cont(cpm_eval-cpm_source, 0.25), 9) AS q25, round(quantile_cont(cpm_eval-cpm_source, 0.75), 9) AS q75 FROM cpm GROUP BY kind")
def dst14(spark, d):
    c = _cpm(spark, d).withColumn("delta", F.col("cpm_eval") - F.col("cpm_source"))
    p = lambda x: F.round(F.percentile("delta", F.lit(x)), 9)
    return c.groupBy("kind").agg(F.round(F.avg("delta"), 9).alias("mean"), p(0.5).alias("median"), p(0.25).alias("q25"), p(0.75).alias("q75"))


@query("AGG38", f"WITH {SHIFT}, {instances_sql()} SELECT uid, tid, CASE WHEN kind IN ('deterministic', 'uncertain') AND s.rank <> 1 THEN 1 WHEN kind = 'sampled_off' AND s.rank = 1 THEN 2 ELSE s.rank END AS source_rank FROM s JOIN ci USING (uid) WHERE selected")
def agg38(spark, d):
    j = candidates(spark, d).where("selected").join(cliff_instances(spark, d), "uid")
    fixed = F.when(F.col("kind").isin("deterministic", "uncertain") & (F.col("rank") != 1), 1).when((F.col("kind") == "sampled_off") & (F.col("rank") == 1), 2).otherwise(F.col("rank"))
    return j.select("uid", "tid", fixed.alias("source_rank"))


BOX = f"{INST}, bx AS (SELECT kind, quantile_cont(entropy, 0.25) AS q25, quantile_cont(entropy, 0.5) AS median, quantile_cont(entropy, 0.75) AS q75 FROM ci GROUP BY kind)"


@query("DST13", f"""WITH {BOX}, y AS (SELECT ci.kind, entropy, q25, median, q75, entropy BETWEEN q25-1.5::DOUBLE*(q75-q25) AND q75+1.5::DOUBLE*(q75-q25) AS ok FROM ci JOIN bx ON ci.kind = bx.kind)
  SELECT kind, count(*) AS n, round(avg(entropy), 9) AS mean, round(q25, 9) AS q25, round(median, 9) AS median, round(q75, 9) AS q75, round(min(entropy) FILTER (ok), 9) AS low, round(max(entropy) FILTER (ok), 9) AS high, count_if(NOT ok)::BIGINT AS outside FROM y GROUP BY kind, q25, median, q75""")
def dst13(spark, d):
    out = D.box_stats(cliff_instances(spark, d), "entropy", "kind")
    return out.select("kind", "n", *[F.round(c, 9).alias(c) for c in ("mean", "q25", "median", "q75", "low", "high")], "outside")


@query("DST16", """WITH RECURSIVE p AS (SELECT 0.001::DOUBLE + i*(0.999::DOUBLE/999) AS p FROM range(1000) t(i)),
  h AS (SELECT p, 0 AS step, 0::DOUBLE AS lo, p AS hi FROM p WHERE p > 0.1::DOUBLE + 1.645::DOUBLE*sqrt(greatest(p*(1-p)/64, 0))
    UNION ALL SELECT p, step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
      FROM (SELECT *, mid > 0.1::DOUBLE + 1.645::DOUBLE*sqrt(greatest(p*(1-p)/64 + (p-mid)*(1-(p-mid))/64, 0)) AS ok FROM (SELECT *, (lo+hi)/2 AS mid FROM h WHERE step < 100)))
  SELECT round(p.p, 9) AS p, round(h.hi, 9) AS min_drop FROM p LEFT JOIN h ON h.p = p.p AND h.step = 100""")
def dst16(spark, d):
    p = spark.range(1000).select((0.001 + F.col("id") * (0.999 / 999)).alias("p"))
    return p.select(F.round("p", 9).alias("p"), F.round(D.boundary_drop(F.col("p")), 9).alias("min_drop"))


@query("PRJ3", f"WITH {INST} SELECT uid, cell, kind FROM ci")
def prj3(spark, d):
    return cliff_instances(spark, d).select("uid", "cell", "kind")


@query("PRJ7", f"WITH {INST} SELECT uid, cell FROM ci WHERE cell IN ('high-H + greedy', 'high-H + non-greedy')")
def prj7(spark, d):
    return cliff_instances(spark, d).where(F.col("cell").isin("high-H + greedy", "high-H + non-greedy")).select("uid", "cell")


@query("PRJ8", f"WITH {INST} SELECT 1 AS view, uid FROM ci WHERE kind = 'sampled_off' UNION ALL SELECT 2, uid FROM ci WHERE kind = 'uncertain' UNION ALL SELECT 3, uid FROM ci WHERE kind = 'deterministic'")
def prj8(spark, d):
    ci = cliff_instances(spark, d)
    view = F.when(F.col("kind") == "sampled_off", 1).when(F.col("kind") == "uncertain", 2).when(F.col("kind") == "deterministic", 3)
    return ci.select(view.alias("view"), "uid").where("view is not null")


@query("PRJ10", f"WITH {INST} SELECT 'all' AS variant, uid FROM ci WHERE kind <> 'other' UNION ALL SELECT kind, uid FROM ci WHERE kind <> 'other' UNION ALL SELECT 'uncertain_or_sampled_off', uid FROM ci WHERE kind IN ('uncertain', 'sampled_off')")
def prj10(spark, d):
    """One row for each variant that a row belongs to."""
    mixed = F.when(F.col("kind").isin("uncertain", "sampled_off"), F.lit("uncertain_or_sampled_off"))
    return cliff_instances(spark, d).where("kind <> 'other'").select(F.explode(F.array_compact(F.array(F.lit("all"), F.col("kind"), mixed))).alias("variant"), "uid")


@query("J2", f"WITH {INST} SELECT ci.uid, coalesce(count(f.tid), 0) AS n, round(coalesce(sum(f.prob), 0), 9) AS mass FROM ci LEFT JOIN (SELECT * FROM s WHERE potential < 0.05::DOUBLE) f USING (uid) GROUP BY ci.uid")
def j2(spark, d):
    weak = candidates(spark, d).where("potential < 0.05").groupBy("uid").agg(F.count("*").alias("n"), F.sum("prob").alias("mass"))
    return cliff_instances(spark, d).select("uid").join(weak, "uid", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mass", F.lit(0.0)), 9).alias("mass"))


METRICS = f"{INST}, mt AS (SELECT uid, sum(prob) FILTER (potential < 0.3::DOUBLE OR selected) AS cliff_mass, sum(prob) FILTER (NOT (potential < 0.3::DOUBLE OR selected)) AS other_mass, count_if(potential < 0.3::DOUBLE OR selected)::BIGINT AS n_cliff, sum(prob) AS mass FROM s GROUP BY uid)"


def metrics(spark, d, prob="prob", extra=()):
    flag = (F.col("potential") < 0.3) | F.col("selected")
    c = candidates(spark, d) if prob == "prob" else D.at_temperature(candidates(spark, d), extra)
    keys = ["uid"] if prob == "prob" else ["uid", "temperature"]
    return c.groupBy(*keys).agg(F.sum(F.when(flag, F.col(prob)).otherwise(0.0)).alias("cliff_mass"), F.sum(F.when(~flag, F.col(prob)).otherwise(0.0)).alias("other_mass"), F.count_if(flag).alias("n_cliff"), F.sum(prob).alias("mass"))


@query("AGG30", f"WITH {METRICS} SELECT uid, round(coalesce(cliff_mass, 0), 9) AS cliff_mass, round(coalesce(other_mass, 0), 9) AS other_mass, n_cliff FROM mt")
def agg30(spark, d):
    return metrics(spark, d).select("uid", F.round("cliff_mass", 9).alias("cliff_mass"), F.round("other_mass", 9).alias("other_mass"), "n_cliff")


@query("J3", f"WITH {METRICS} SELECT ci.uid, ci.kind, n_cliff FROM ci JOIN mt USING (uid) WHERE kind <> 'other'")
def j3(spark, d):
    return cliff_instances(spark, d).where("kind <> 'other'").select("uid", "kind").join(metrics(spark, d).select("uid", "n_cliff"), "uid")


SPINE = "sp AS (SELECT unnest(['deterministic', 'uncertain', 'sampled_off', 'none_such']) AS kind)"


@query("AGG31", f"WITH {METRICS}, {SPINE} SELECT sp.kind, count(ci.uid) AS n, round(coalesce(avg(coalesce(cliff_mass, 0)) FILTER (ci.uid IS NOT NULL), 0), 9) AS mean_mass, round(coalesce(avg(n_cliff), 0), 9) AS mean_tokens, round(coalesce(avg(entropy), 0), 9) AS mean_entropy FROM sp LEFT JOIN ci ON ci.kind = sp.kind LEFT JOIN mt ON mt.uid = ci.uid GROUP BY sp.kind")
def agg31(spark, d):
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("deterministic", "uncertain", "sampled_off", "none_such")])).alias("kind"))
    own = cliff_instances(spark, d).join(metrics(spark, d), "uid").groupBy("kind").agg(F.count("*").alias("n"), F.avg("cliff_mass").alias("mean_mass"), F.avg("n_cliff").alias("mean_tokens"), F.avg("entropy").alias("mean_entropy"))
    return spine.join(own, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("mean_mass", "mean_tokens", "mean_entropy")])


SWEEP = (0.0, 0.7, 1.0, 2.0, 5.0)


@query("AGG32", f"WITH {INST}, {temperature_sql(SWEEP)}, q AS (SELECT uid, temperature, coalesce(sum(p_t) FILTER (potential < 0.3::DOUBLE OR selected), 0) AS m FROM w GROUP BY ALL) SELECT kind, " + ", ".join(f"round(avg(m) FILTER (temperature = {t}::DOUBLE), 9) AS t{str(t).replace('.0', '').replace('.', 'p')}" for t in SWEEP) + " FROM q JOIN ci USING (uid) GROUP BY kind")
def agg32(spark, d):
    m = metrics(spark, d, "p_t", SWEEP).join(cliff_instances(spark, d).select("uid", "kind"), "uid")
    wide = m.groupBy("kind").pivot("temperature", list(SWEEP)).agg(F.avg("cliff_mass"))
    return wide.select("kind", *[F.round(F.col(f"`{t}`"), 9).alias("t" + str(t).replace(".0", "").replace(".", "p")) for t in SWEEP])


@query("AGG33", f"WITH {METRICS}, x AS (SELECT uid, abs(mass - (SELECT sum(prob) FROM s WHERE s.uid = mt.uid AND s.rank <= 19)) AS e FROM mt) SELECT round(avg(e), 9) AS mean_error, round(max(e), 9) AS max_error, round(sqrt(avg(e*e)), 9) AS rms_error FROM x")
def agg33(spark, d):
    """Listed mass against the mass of the first 19 ranks."""
    c = candidates(spark, d).groupBy("uid").agg(F.abs(F.sum("prob") - F.sum(F.when(F.col("rank") <= 19, F.col("prob")))).alias("e"))
    return c.agg(F.round(F.avg("e"), 9).alias("mean_error"), F.round(F.max("e"), 9).alias("max_error"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("rms_error"))


PICKS = f"{INST}, pk AS (SELECT uid, max(potential) FILTER (selected) AS sel_pot, max(rank) FILTER (selected) AS sel_rank, max_by(potential, prob) FILTER (rank = 1) AS greedy_pot FROM s GROUP BY uid)"


def _picks(spark, d):
    sel, top = F.col("selected"), F.col("rank") == 1
    first = lambda flag, c: F.min_by(F.when(flag, F.col(c)), F.when(flag, F.struct("rank", -F.col("prob"))))
    return candidates(spark, d).groupBy("uid").agg(first(sel, "potential").alias("sel_pot"), first(sel, "rank").alias("sel_rank"), first(top, "potential").alias("greedy_pot"))


@query("TOP2", f"WITH {PICKS} SELECT uid, sel_rank, sel_pot, greedy_pot FROM pk")
def top2(spark, d):
    return _picks(spark, d).select("uid", "sel_rank", "sel_pot", "greedy_pot")


@query("AGG34", f"WITH {PICKS}, g AS (SELECT greedy_pot-sel_pot AS gap FROM pk JOIN ci USING (uid) WHERE kind = 'sampled_off' AND sel_pot IS NOT NULL) SELECT count(*) AS n, round(avg(gap), 9) AS mean_gap, round(quantile_cont(gap, 0.5), 9) AS median_gap, round(100*count_if(gap > 0)/count(*)::DOUBLE, 6) AS better_pct FROM g")
def agg34(spark, d):
    g = _picks(spark, d).where("sel_pot is not null").join(cliff_instances(spark, d).where("kind = 'sampled_off'").select("uid"), "uid").withColumn("gap", F.col("greedy_pot") - F.col("sel_pot"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("gap"), 9).alias("mean_gap"), F.round(F.percentile("gap", F.lit(0.5)), 9).alias("median_gap"), F.round(100 * F.count_if(F.col("gap") > 0) / F.count("*"), 6).alias("better_pct"))


@query("TOP3", f"WITH {CANDS} SELECT uid, list(tid ORDER BY coalesce(CASE WHEN rank < 15 THEN rank END, 1000000000), -prob, tid)[1:5] AS tids FROM s GROUP BY uid")
def top3(spark, d):
    """First five by rank (missing ranks last), then probability."""
    order = F.struct(F.coalesce(F.when(F.col("rank") < 15, F.col("rank")), F.lit(1000000000)).alias("r"), (-F.col("prob")).alias("p"), "tid")
    return candidates(spark, d).groupBy("uid").agg(F.transform(F.slice(F.sort_array(F.collect_list(order)), 1, 5), lambda x: x["tid"]).alias("tids"))


@query("TOP4", f"WITH {INST} SELECT uid, dataset, row_number() OVER (PARTITION BY dataset ORDER BY uid) AS place FROM ci")
def top4(spark, d):
    """The merged order: dataset, then key; as a place within the dataset."""
    return cliff_instances(spark, d).select("uid", "dataset", F.row_number().over(Window.partitionBy("dataset").orderBy("uid")).cast("long").alias("place"))


@query("TOP1", f"""WITH {PICKS}, x AS (SELECT s.uid, max(prob) FILTER (rank = 1) AS p1, max(prob) FILTER (rank > 1) AS p2 FROM s GROUP BY s.uid),
  a AS (SELECT uid, potential, row_number() OVER (PARTITION BY uid ORDER BY rank, prob DESC, tid) AS r FROM s WHERE NOT selected), b AS (SELECT uid, max(potential) AS alt FROM a WHERE r <= 3 GROUP BY uid),
  sc AS (SELECT ci.uid, ci.kind, CASE kind WHEN 'deterministic' THEN (coalesce(p1, 0)-coalesce(p2, p1, 0))+(1-coalesce(sel_pot, 0)) WHEN 'uncertain' THEN coalesce(alt-coalesce(sel_pot, 0), -1e9) ELSE coalesce(greedy_pot-coalesce(sel_pot, 0), -1e9) END AS score
    FROM ci JOIN x USING (uid) JOIN pk USING (uid) LEFT JOIN b USING (uid) WHERE kind <> 'other')
  SELECT kind, uid, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, uid) AS place FROM sc) WHERE place <= 3""")
def top1(spark, d):
    """Three representatives of each type, by the score of the type."""
    c = candidates(spark, d)
    tiers = c.groupBy("uid").agg(F.max(F.when(F.col("rank") == 1, F.col("prob"))).alias("p1"), F.max(F.when(F.col("rank") > 1, F.col("prob"))).alias("p2"))
    alt = D.top_k(c.where("not selected"), 3, F.col("rank"), F.desc("prob"), F.col("tid")).groupBy("uid").agg(F.max("potential").alias("alt"))
    j = cliff_instances(spark, d).where("kind <> 'other'").join(tiers, "uid").join(_picks(spark, d), "uid").join(alt, "uid", "left")
    sel, none = F.coalesce("sel_pot", F.lit(0.0)), F.lit(-1e9)
    gap = F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", "p1", F.lit(0.0)) + (1 - sel)
    score = F.when(F.col("kind") == "deterministic", gap).when(F.col("kind") == "uncertain", F.coalesce(F.col("alt") - sel, none)).otherwise(F.coalesce(F.col("greedy_pot") - sel, none))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "uid")
    return j.select("kind", "uid", F.round(score, 9).alias("score")).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@query("AGG35", f"WITH {METRICS}, c4 AS (SELECT unnest(['low-H + greedy', 'low-H + non-greedy', 'high-H + greedy', 'high-H + non-greedy']) AS cell) SELECT c4.cell, count(ci.uid) AS n, coalesce(sum(n_cliff), 0)::BIGINT AS n_tokens, round(coalesce(avg(cliff_mass), 0), 9) AS mean_mass FROM c4 LEFT JOIN ci ON ci.cell = c4.cell LEFT JOIN (SELECT uid, n_cliff, coalesce(cliff_mass, 0) AS cliff_mass FROM mt) mt ON mt.uid = ci.uid GROUP BY c4.cell")
def agg35(spark, d):
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(f"{h} + {g}") for h in ("low-H", "high-H") for g in ("greedy", "non-greedy")])).alias("cell"))
    own = cliff_instances(spark, d).join(metrics(spark, d), "uid").groupBy("cell").agg(F.count("*").alias("n"), F.sum("n_cliff").alias("n_tokens"), F.avg("cliff_mass").alias("mean_mass"))
    return spine.join(own, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.round(F.coalesce("mean_mass", F.lit(0.0)), 9).alias("mean_mass"))


@query("AGG36", f"WITH {CANDS} SELECT count(*) AS observed, (SELECT count(*)*20 FROM embeddings) AS expected, count_if(rank < 1 OR rank > 20)::BIGINT AS bad_rank, count_if(abs(potential*64-round(potential*64)) > 1e-9)::BIGINT AS off_grid FROM s")
def agg36(spark, d):
    expected = table(spark, d, "embeddings").agg((F.count("*") * 20).alias("expected"))
    own = candidates(spark, d).agg(F.count("*").alias("observed"), F.count_if((F.col("rank") < 1) | (F.col("rank") > 20)).alias("bad_rank"), F.count_if(F.abs(F.col("potential") * 64 - F.round(F.col("potential") * 64)) > 1e-9).alias("off_grid"))
    return own.withColumn("one", F.lit(1)).join(expected.withColumn("one", F.lit(1)), "one").drop("one")


@query("J12", f"WITH {INST}, a AS (SELECT cell, count(*) AS cliffs FROM ci GROUP BY cell), b AS (SELECT cell, count(*) AS cands FROM s JOIN ci USING (uid) WHERE s.rank <= 3 AND s.uid % 7 <> 0 GROUP BY cell) SELECT coalesce(a.cell, b.cell) AS cell, coalesce(cliffs, 0) AS cliffs, coalesce(cands, 0) AS cands FROM a FULL JOIN b ON a.cell = b.cell")
def j12(spark, d):
    ci = cliff_instances(spark, d)
    a = ci.groupBy("cell").agg(F.count("*").alias("cliffs"))
    b = candidates(spark, d).where("rank <= 3 and uid % 7 <> 0").join(ci.select("uid", "cell"), "uid").groupBy("cell").agg(F.count("*").alias("cands"))
    return a.join(b, "cell", "full_outer").select("cell", F.coalesce("cliffs", F.lit(0)).alias("cliffs"), F.coalesce("cands", F.lit(0)).alias("cands"))


@query("J11", f"WITH {INST} SELECT count(*) AS n, count_if(abs(a.entropy-b.entropy) > 1e-6)::BIGINT AS entropy_off, count_if(a.is_greedy <> b.is_greedy)::BIGINT AS flag_off FROM ci a JOIN (SELECT uid, entropy + CASE WHEN uid%10=0 THEN 1e-3 ELSE 0 END AS entropy, is_greedy <> (uid%25=0) AS is_greedy FROM ci) b USING (uid)")
def j11(spark, d):
    a = cliff_instances(spark, d)
    b = a.select("uid", (F.col("entropy") + F.when(F.col("uid") % 10 == 0, 1e-3).otherwise(0.0)).alias("e2"), (F.col("is_greedy") != (F.col("uid") % 25 == 0)).alias("g2"))
    return a.join(b, "uid").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("entropy") - F.col("e2")) > 1e-6).alias("entropy_off"), F.count_if(F.col("is_greedy") != F.col("g2")).alias("flag_off"))


@query("AGG24", f"WITH {INST}, a AS (SELECT dataset, avg(is_greedy::INTEGER) AS cliff_ratio FROM ci GROUP BY dataset), b AS (SELECT 'd'||(uid%2) AS dataset, avg((rank = 1)::INTEGER) AS base_ratio FROM s GROUP BY 1) SELECT coalesce(a.dataset, b.dataset) AS dataset, round(cliff_ratio, 9) AS cliff_ratio, round(base_ratio, 9) AS base_ratio FROM a FULL JOIN b ON a.dataset = b.dataset")
def agg24(spark, d):
    a = cliff_instances(spark, d).groupBy("dataset").agg(F.round(F.avg(F.col("is_greedy").cast("int")), 9).alias("cliff_ratio"))
    b = candidates(spark, d).groupBy(F.concat(F.lit("d"), F.col("uid") % 2).alias("dataset")).agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 9).alias("base_ratio"))
    return a.join(b, "dataset", "full_outer")


@query("AGG25", f"WITH {INST}, a AS (SELECT cell, count(*)/sum(count(*)) OVER ()::DOUBLE AS a FROM ci WHERE is_greedy OR uid%2=0 GROUP BY cell), b AS (SELECT cell, count(*)/sum(count(*)) OVER ()::DOUBLE AS b FROM ci GROUP BY cell) SELECT b.cell, round(100*coalesce(a, 0), 6) AS cliff_pct, round(100*b, 6) AS base_pct, round(coalesce(a, 0)/b, 6) AS ratio FROM b LEFT JOIN a ON a.cell = b.cell")
def agg25(spark, d):
    ci = cliff_instances(spark, d)
    all_rows = Window.partitionBy(F.lit(0))  # a row a cell
    own = lambda df, name: df.groupBy("cell").agg(F.count("*").alias("n")).select("cell", (F.col("n") / F.sum("n").over(all_rows)).alias(name))
    j = own(ci, "b").join(own(ci.where("is_greedy or uid % 2 = 0"), "a"), "cell", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    return j.select("cell", F.round(100 * F.col("a"), 6).alias("cliff_pct"), F.round(100 * F.col("b"), 6).alias("base_pct"), F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query("AGG26", f"WITH {INST} SELECT coalesce((entropy <= {BOUND}::DOUBLE)::VARCHAR, 'all') AS is_low, coalesce(is_greedy::VARCHAR, 'all') AS is_eq, count(*) AS n FROM ci GROUP BY CUBE(entropy <= {BOUND}::DOUBLE, is_greedy)")
def agg26(spark, d):
    c = cliff_instances(spark, d).select((F.col("entropy") <= BOUND).alias("is_low"), F.col("is_greedy").alias("is_eq")).cube("is_low", "is_eq").agg(F.count("*").alias("n"))
    return c.select(*[F.coalesce(F.col(x).cast("string"), F.lit("all")).alias(x) for x in ("is_low", "is_eq")], "n")


@query("AGG27", f"WITH {PICKS} SELECT dataset, count(*) AS n, round(100*avg(is_greedy::INTEGER), 6) AS eq_pct, round(100*avg((greedy_pot-coalesce(sel_pot, 0) < 0.2::DOUBLE)::INTEGER), 6) AS a_pct, round(100*avg((greedy_pot-coalesce(sel_pot, 0) >= 0.2::DOUBLE)::INTEGER), 6) AS b_pct FROM ci JOIN pk USING (uid) GROUP BY dataset")
def agg27(spark, d):
    j = cliff_instances(spark, d).join(_picks(spark, d), "uid").withColumn("delta", F.col("greedy_pot") - F.coalesce("sel_pot", F.lit(0.0)))
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return j.groupBy("dataset").agg(F.count("*").alias("n"), pct(F.col("is_greedy")).alias("eq_pct"), pct(F.col("delta") < 0.2).alias("a_pct"), pct(F.col("delta") >= 0.2).alias("b_pct"))


@query("PRJ4", f"WITH {PICKS} SELECT uid, CASE WHEN greedy_pot-coalesce(sel_pot, 0) < 0.2::DOUBLE THEN 'A' ELSE 'B' END AS kind_ab FROM pk")
def prj4(spark, d):
    return _picks(spark, d).select("uid", F.when(F.col("greedy_pot") - F.coalesce("sel_pot", F.lit(0.0)) < 0.20, "A").otherwise("B").alias("kind_ab"))


@query("AGG44", f"WITH {PICKS} SELECT count(*) AS found, count_if(is_greedy)::BIGINT AS n_eq, count_if(greedy_pot-coalesce(sel_pot, 0) < 0.2::DOUBLE)::BIGINT AS n_a, count_if(greedy_pot-coalesce(sel_pot, 0) >= 0.2::DOUBLE)::BIGINT AS n_b FROM ci JOIN pk USING (uid)")
def agg44(spark, d):
    j = cliff_instances(spark, d).join(_picks(spark, d), "uid").withColumn("delta", F.col("greedy_pot") - F.coalesce("sel_pot", F.lit(0.0)))
    return j.agg(F.count("*").alias("found"), F.count_if("is_greedy").alias("n_eq"), F.count_if(F.col("delta") < 0.2).alias("n_a"), F.count_if(F.col("delta") >= 0.2).alias("n_b"))


@query("PRJ13", f"WITH {PICKS} SELECT uid, round(CASE WHEN 0.9::DOUBLE-coalesce(sel_pot, 0) > 0 THEN (greedy_pot-coalesce(sel_pot, 0))/(0.9::DOUBLE-coalesce(sel_pot, 0)) ELSE 0 END, 9) AS recovery FROM pk")
def prj13(spark, d):
    return _picks(spark, d).select("uid", F.round(P.recovery_rate(F.col("greedy_pot"), F.coalesce("sel_pot", F.lit(0.0)), F.lit(0.9)), 9).alias("recovery"))


@query("PRJ9", f"WITH {PICKS} SELECT is_greedy, entropy >= {BOUND}::DOUBLE AS is_high, count(*) AS n FROM ci JOIN pk USING (uid) WHERE greedy_pot >= 0.25::DOUBLE GROUP BY ALL")
def prj9(spark, d):
    j = cliff_instances(spark, d).join(_picks(spark, d), "uid").where("greedy_pot >= 0.25")
    return j.groupBy("is_greedy", (F.col("entropy") >= BOUND).alias("is_high")).agg(F.count("*").alias("n"))


@query("AGG28", f"WITH {INST}, th AS (SELECT unnest([60, 70, 80, 90]) AS pct, unnest([quantile_cont(entropy, 0.6), quantile_cont(entropy, 0.7), quantile_cont(entropy, 0.8), quantile_cont(entropy, 0.9)]) AS v FROM ci) SELECT pct, entropy >= v AS is_high, is_greedy, count(*) AS n FROM ci, th GROUP BY ALL")
def agg28(spark, d):
    """The 2 x 2 table at each percentile; four thresholds, so rows are exploded over them."""
    ci = cliff_instances(spark, d)
    at = ci.agg(F.percentile("entropy", F.array(*[F.lit(x / 100) for x in (60, 70, 80, 90)])).alias("v")).first().v or [None] * 4
    rows = ci.select("entropy", "is_greedy", F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.lit(v).cast("double").alias("v")) for p, v in zip((60, 70, 80, 90), at)])).alias("t"))
    return rows.groupBy(F.col("t.pct").alias("pct"), (F.col("entropy") >= F.col("t.v")).alias("is_high"), "is_greedy").agg(F.count("*").alias("n"))


@query("AGG39", f"WITH {INST}, {SPINE}, n AS (SELECT count(*) AS paths, 20*count(*) AS toks FROM embeddings) SELECT sp.kind, count(ci.uid) AS n, round(count(ci.uid)/max(paths)::DOUBLE, 9) AS per_path, round(1000*count(ci.uid)/max(toks)::DOUBLE, 9) AS per_1k FROM sp LEFT JOIN ci ON ci.kind = sp.kind, n GROUP BY sp.kind")
def agg39(spark, d):
    ci = cliff_instances(spark, d)
    spine = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("deterministic", "uncertain", "sampled_off", "none_such")])).alias("kind"))
    paths = table(spark, d, "embeddings").count()
    own = ci.groupBy("kind").agg(F.count("*").alias("n"))
    return spine.join(own, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n")).select("kind", "n", F.round(F.col("n") / paths, 9).alias("per_path"), F.round(1000 * F.col("n") / (20 * paths), 9).alias("per_1k"))


# Preference pairs.

DPO = f"{CANDS}, pv AS (SELECT uid, max(potential) AS prev FROM s GROUP BY uid), rj AS (SELECT uid, arg_max(tid, tid) AS rejected FROM s WHERE selected GROUP BY uid)"


def _pairs(spark, d, hard):
    c = candidates(spark, d)
    prev = c.groupBy("uid").agg(F.max("potential").alias("prev"), F.max(F.when(F.col("selected"), F.col("tid"))).alias("rejected")).where("rejected is not null")
    cliff = P.is_cliff(P.score_to_k(F.col("prev")), P.score_to_k(F.col("potential")))
    rows = c.where("not selected").join(prev, "uid").where((F.col("potential") >= 0) & ~cliff)
    return (rows.where("potential >= prev") if hard else rows).select("uid", F.col("tid").alias("chosen"), "rejected")


def _dpo_sql(hard: bool) -> str:
    from .surrogates import z_sql

    return f"WITH {DPO} SELECT s.uid, s.tid AS chosen, rejected FROM s JOIN pv ON pv.uid = s.uid JOIN rj ON rj.uid = s.uid WHERE NOT selected AND potential >= 0 AND NOT {z_sql('(prev*64)::BIGINT', '(potential*64)::BIGINT')}" + (" AND potential >= prev" if hard else "")


@query("DPO1", _dpo_sql(False))
def dpo1(spark, d):
    """Chosen: candidates that don't drop significantly from the score before; rejected: the selected token."""
    return _pairs(spark, d, False)


@query("DPO2", _dpo_sql(True))
def dpo2(spark, d):
    return _pairs(spark, d, True)


@query("DPO3", f"WITH p AS ({_dpo_sql(True)}), {INST} SELECT variant, count(*) AS n FROM (SELECT unnest(list_filter(['all', kind, CASE WHEN kind IN ('uncertain', 'sampled_off') THEN 'uncertain_or_sampled_off' END], lambda x: x IS NOT NULL)) AS variant FROM p JOIN ci USING (uid) WHERE kind <> 'other') GROUP BY variant")
def dpo3(spark, d):
    """Pairs by variant; an empty variant has no row."""
    return _pairs(spark, d, True).join(prj10(spark, d), "uid").groupBy("variant").agg(F.count("*").alias("n"))


@query("DPO4", f"WITH {CANDS} SELECT uid, tid, CASE WHEN selected THEN 0.25::DOUBLE WHEN tid % 5 = 0 THEN -1::DOUBLE ELSE potential END AS potential FROM s")
def dpo4(spark, d):
    """The selected token keeps the path's score; others are -1 until evaluated."""
    done = candidates(spark, d).where("tid % 5 <> 0").select("uid", "tid", F.col("potential").alias("own"))
    base = candidates(spark, d).drop("potential").join(done, ["uid", "tid"], "left")
    return base.select("uid", "tid", F.when(F.col("selected"), F.lit(0.25)).otherwise(F.coalesce("own", F.lit(-1.0))).alias("potential"))
