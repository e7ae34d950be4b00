"""Stand-ins for rollout traces, derived from the driver's tables; each also as SQL (WITH parts) for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(spark: SparkSession, d: str, kind: str = "dense") -> DataFrame:
    """path_id, model, dataset, pos, token, k, score from events. kind: dense, sparse (no score on errors), short (paths of
    three days), critical (low scores late), or zeros (score 0 where the value is below 60)."""
    e = table(spark, d, "events")
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 259200)
    path = F.concat_ws("_", F.col("user_id"), bucket) if kind == "short" else F.col("user_id")
    rows = e.select(path.alias("path_id"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.concat(F.lit("d"), F.col("user_id") % 2).alias("dataset"), "user_id", "ts", "event_id", "value", F.col("event_type").alias("token"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("path_id").orderBy("ts", "event_id")).cast("long"))
    k = F.least(F.lit(64), F.floor(F.col("value") / 4)).cast("long")
    if kind == "critical":
        k = F.when(F.col("pos") > 10 + F.col("user_id") % 40, (F.floor("value") % 5).cast("long")).otherwise(k)
    if kind == "zeros":
        k = F.when(F.col("value") < 60, F.lit(0).cast("long")).otherwise(k)
    score = k / F.lit(64.0)
    if kind == "sparse":
        score = F.when(F.col("token") != "error", score)
    return rows.select("path_id", "model", "dataset", "pos", "token", k.alias("k"), score.alias("score"))


def tokens_sql(kind: str = "dense", name: str = "t") -> str:
    path = "concat_ws('_', user_id, floor(epoch(ts)/259200)::BIGINT)" if kind == "short" else "user_id"
    k = "least(64, floor(value/4))::BIGINT"
    if kind == "critical":
        k = f"CASE WHEN pos > 10 + user_id % 40 THEN (floor(value)::BIGINT % 5) ELSE {k} END"
    if kind == "zeros":
        k = f"CASE WHEN value < 60 THEN 0 ELSE {k} END"
    score = "CASE WHEN token <> 'error' THEN k/64::DOUBLE END" if kind == "sparse" else "k/64::DOUBLE"
    return f"""{name}0 AS (SELECT {path} AS path_id, 'm'||(user_id%3) AS model, 'd'||(user_id%2) AS dataset, user_id, value, event_type AS token,
        row_number() OVER (PARTITION BY {path} ORDER BY ts, event_id) AS pos FROM events),
    {name}1 AS (SELECT path_id, model, dataset, pos, token, {k} AS k FROM {name}0),
    {name} AS (SELECT path_id, model, dataset, pos, token, k, {score} AS score FROM {name}1)"""


def z_sql(kp: str = "kp", kc: str = "kc", n: int = 64) -> str:
    p, q = f"(({kp})/{n}::DOUBLE)", f"(({kc})/{n}::DOUBLE)"
    return f"(({kp}) > 0 AND ({kc}) >= 0 AND ({kp}) <= {n} AND ({kc}) <= {n} AND {p}-{q} > 0.1::DOUBLE AND {p}-{q} > 0.1::DOUBLE + 1.645::DOUBLE*sqrt({p}*(1-{p})/{n} + {q}*(1-{q})/{n}))"


def cliffs_sql(kind: str = "dense", name: str = "c") -> str:
    """WITH parts up to `name`: significant drops of tokens `t`."""
    return f"""{tokens_sql(kind)},
    {name}p AS (SELECT *, lag(pos) OVER w AS prev_pos, lag(score) OVER w AS prev_score FROM t WHERE score IS NOT NULL WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
    {name} AS (SELECT path_id, model, dataset, prev_pos, pos, token, prev_score, score, (prev_score*64)::BIGINT AS k_prev, (score*64)::BIGINT AS k_now, prev_score-score AS "drop"
      FROM {name}p WHERE prev_pos IS NOT NULL AND {z_sql('(prev_score*64)::BIGINT', '(score*64)::BIGINT')})"""


def path_ok(spark: SparkSession, d: str, short: bool = False) -> DataFrame:
    """path_id, model, dataset, is_correct, total_tokens: the last event decides."""
    t = tokens(spark, d, "short" if short else "dense")
    return t.groupBy("path_id", "model", "dataset").agg(F.max_by("token", "pos").isin("purchase", "view").alias("is_correct"), F.max("pos").alias("total_tokens"))


def path_ok_sql(name: str = "ok") -> str:
    """Needs t."""
    return f"{name} AS (SELECT path_id, model, dataset, max_by(token, pos) IN ('purchase','view') AS is_correct, max(pos) AS total_tokens FROM t GROUP BY ALL)"


def candidates(spark: SparkSession, d: str, scale: float = 20.0, top: int = 20, shift: bool = False) -> DataFrame:
    """uid, tid, lp, prob, rank, potential, selected: the top of a softmax over the components of each vector, by (lp desc, tid)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), "label", F.transform("embedding", lambda x, i: x.cast("double") * scale + (F.pmod(i * 7 + F.col("vec_id"), F.lit(5)) * 0.01 if shift else F.lit(0.0))).alias("l"))
    total = F.log(F.aggregate(F.transform("l", F.exp), F.lit(0.0), lambda a, x: a + x))
    each = e.select("uid", "label", F.posexplode(F.transform("l", lambda x: x - total)).alias("tid", "lp"))
    w = Window.partitionBy("uid").orderBy(F.desc("lp"), "tid")
    ranked = each.withColumn("own_r", F.row_number().over(w)).where(F.col("own_r") <= top).withColumn("rank", F.rank().over(Window.partitionBy("uid").orderBy(F.desc("lp"))).cast("long"))
    return ranked.select("uid", F.col("tid").cast("long").alias("tid"), "lp", F.exp("lp").alias("prob"), "rank", (F.pmod(F.col("tid") * 7 + F.col("uid"), F.lit(65)) / F.lit(64.0)).alias("potential"), (F.col("tid") == F.col("label")).alias("selected"))


def candidates_sql(scale: float = 20.0, name: str = "s", top: int = 20, shift: bool = False) -> str:
    add = " + ((i-1)*7 + vec_id) % 5 * 0.01::DOUBLE" if shift else ""
    return f"""{name}0 AS (SELECT vec_id AS uid, label, unnest(list_transform(embedding, lambda x, i: x::DOUBLE*{scale}::DOUBLE{add})) AS l, unnest(range(len(embedding))) AS tid FROM embeddings),
    {name}1 AS (SELECT uid, label, tid, l - ln(sum(exp(l)) OVER (PARTITION BY uid)) AS lp FROM {name}0),
    {name}2 AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lp DESC, tid) AS r, rank() OVER (PARTITION BY uid ORDER BY lp DESC) AS rank FROM {name}1),
    {name} AS (SELECT uid, tid::BIGINT AS tid, lp, exp(lp) AS prob, rank, ((tid*7+uid)%65)/64::DOUBLE AS potential, tid = label AS selected FROM {name}2 WHERE r <= {top})"""


def cliff_instances(spark: SparkSession, d: str) -> DataFrame:
    """A row a vector: uid, dataset, entropy (partial, top 20), is_greedy (the selected token has rank 1), cell, type."""
    from ..functions import potential as P

    c = candidates(spark, d)
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), "label")
    per = c.groupBy("uid").agg((-F.sum(F.exp("lp") * F.col("lp"))).alias("entropy"), F.coalesce(F.max(F.col("selected") & (F.col("rank") == 1)), F.lit(False)).alias("sel_top"))
    rows = per.join(label, "uid").select("uid", F.concat(F.lit("d"), F.col("label") % 2).alias("dataset"), "entropy", (F.col("sel_top") | (F.col("uid") % 3 == 0)).alias("is_greedy"))
    return rows.withColumns({"cell": P.cell_label(F.col("entropy"), F.col("is_greedy"), BOUND), "kind": P.taxonomy(F.col("entropy"), F.col("is_greedy"), BOUND)})


#: The vectors' distributions are flat, so the surrogate splits low from high entropy here.
BOUND = 1.9


def instances_sql(name: str = "ci") -> str:
    """Needs s."""
    return f"""{name}0 AS (SELECT uid, -sum(exp(lp)*lp) AS entropy, coalesce(bool_or(selected AND rank = 1), false) AS sel_top FROM s GROUP BY uid),
    {name} AS (SELECT uid, 'd'||(label%2) AS dataset, entropy, (sel_top OR uid%3=0) AS is_greedy,
      (CASE WHEN entropy <= {BOUND}::DOUBLE THEN 'low-H' ELSE 'high-H' END)||' + '||(CASE WHEN sel_top OR uid%3=0 THEN 'greedy' ELSE 'non-greedy' END) AS cell,
      CASE WHEN entropy <= {BOUND}::DOUBLE AND (sel_top OR uid%3=0) THEN 'deterministic' WHEN entropy > {BOUND}::DOUBLE AND (sel_top OR uid%3=0) THEN 'uncertain' WHEN entropy > {BOUND}::DOUBLE THEN 'sampled_off' ELSE 'other' END AS kind
      FROM {name}0 JOIN embeddings e ON e.vec_id = {name}0.uid)"""


def regen(spark: SparkSession, d: str) -> DataFrame:
    """n, c_del, c_keep, is_correct, model, dataset from lineitem."""
    l = table(spark, d, "lineitem")  # noqa: E741
    c = F.col("l_quantity").cast("int")
    return l.select(F.lit(64).alias("n"), c.alias("c_del"), F.least(c, F.col("l_linenumber") * 5).alias("c_keep"), (F.col("l_returnflag") == "N").alias("is_correct"), F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("dataset"))


REGEN_SQL = "r AS (SELECT 64 AS n, l_quantity::INTEGER AS c_del, least(l_quantity::INTEGER, l_linenumber*5) AS c_keep, l_returnflag = 'N' AS is_correct, l_linestatus AS model, l_returnflag AS dataset FROM lineitem)"


def pass_sql(c: str, k: str, n: str = "64") -> str:
    return f"(CASE WHEN {c} <= 0 THEN 0::DOUBLE WHEN {c} >= {n} OR {n}-{c} < {k} THEN 1::DOUBLE ELSE 1 - list_reduce(list_transform(range(({k})::BIGINT), lambda i: ({n}-{c}-i)/({n}-i)::DOUBLE), lambda a, b: a*b) END)"


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, token, is_correct from the labelled documents."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_correct")), "doc_id")
    return docs.select("doc_id", "is_correct", F.posexplode(F.split("text", r"[ \n\t]+")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


TEXT_SQL = r"""x0 AS (SELECT doc_id, quality = 1 AS is_correct, regexp_split_to_array(text, '[ \n\t]+') AS w FROM documents JOIN labels USING (doc_id)),
x AS (SELECT doc_id, is_correct, unnest(w) AS token, unnest(range(len(w))) AS pos FROM x0)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """id, response, gold, dataset from orders: boxed integers, with commas or decimals, wrong, nested, in words, or none."""
    o = table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("so \\boxed{"), key, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("thus \\boxed{1} then \\boxed{"), key, F.lit(".00}")))
        .when(kind == 2, F.concat(F.lit("\\boxed{"), (F.col("o_custkey") + 1).cast("string"), F.lit("}")))
        .when(kind == 3, F.concat(F.lit("\\boxed{\\text{"), key, F.lit("}}")))
        .when(kind == 4, F.concat(F.lit("The answer is $"), key, F.lit(".")))
        .otherwise(F.lit("I do not know"))
    )
    data = F.when(F.col("o_orderkey") % 2 == 0, "gsm1k").otherwise("math500")
    return o.select(F.col("o_orderkey").alias("id"), text.alias("response"), key.alias("gold"), data.alias("dataset"))


RESPONSES_SQL = r"""q AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'so \boxed{'||o_custkey||'}' WHEN 1 THEN 'thus \boxed{1} then \boxed{'||o_custkey||'.00}'
  WHEN 2 THEN '\boxed{'||(o_custkey+1)||'}' WHEN 3 THEN '\boxed{\text{'||o_custkey||'}}' WHEN 4 THEN 'The answer is $'||o_custkey||'.' ELSE 'I do not know' END AS response,
  o_custkey::VARCHAR AS gold, CASE WHEN o_orderkey % 2 = 0 THEN 'gsm1k' ELSE 'math500' END AS dataset FROM orders)"""
