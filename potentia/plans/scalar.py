"""Queries of scalar functions, and of the token tables made with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A
from ..functions import names as N
from ..functions import text as T
from ..registry import query
from .surrogates import RESPONSES_SQL, TEXT_SQL, cliffs_sql, path_ok, path_ok_sql, responses, table, text_tokens, tokens


@query("FN1", f"WITH {RESPONSES_SQL} SELECT id, CASE WHEN contains(response, '\\boxed') THEN '\\boxed'||list_last(string_split(response, '\\boxed')) WHEN contains(response, 'he answer is') THEN trim(list_last(string_split(response, 'he answer is'))) ELSE response END AS answer FROM q")
def fn1(spark, d):
    return responses(spark, d).select("id", T.extract_answer(F.col("response")).alias("answer"))


LIGHT = r"""a0 AS (SELECT *, CASE WHEN contains(response, '\boxed') THEN regexp_extract('\boxed'||list_last(string_split(response, '\boxed')), '^\\boxed\{([^{}]*)\}', 1)
    WHEN contains(response, 'he answer is') THEN regexp_replace(trim(list_last(string_split(response, 'he answer is'))), '\.+$', '') ELSE '' END AS p FROM q),
  a1 AS (SELECT *, regexp_replace(regexp_replace(trim(replace(p, ',', '')), '^[\\$]+|[\\$]+$', '', 'g'), '\.00?$', '') AS n FROM a0),
  lg AS (SELECT id, response, gold, dataset, CASE WHEN regexp_matches(n, '^[+-]?[0-9]+$') THEN n::BIGINT = gold::BIGINT END AS light FROM a1)"""


@query("FN2", f"WITH {RESPONSES_SQL}, {LIGHT} SELECT id, light FROM lg")
def fn2(spark, d):
    return responses(spark, d).select("id", T.light_grade(F.col("response"), F.array("gold")).alias("light"))


@query("FN3", f"WITH {RESPONSES_SQL}, {LIGHT} SELECT id, dataset, coalesce(light, dataset = 'math500' AND contains(response, '\\text{{'||gold||'}}'), false) AS graded FROM lg")
def fn3(spark, d):
    """Integers first; what is undecided is false on integer datasets, and compared in normal form elsewhere."""
    r = responses(spark, d)
    light = T.light_grade(F.col("response"), F.array("gold"))
    whole = F.lower("dataset").startswith("gsm") | F.lower("dataset").startswith("aime")
    return r.select("id", "dataset", F.coalesce(light, F.when(whole, False).otherwise(A.graded(F.col("response"), F.array("gold")))).alias("graded"))


#: Responses and gold answers that are spelled differently ({k}: the customer's key), and whether they are the same.
ANSWERS = (
    (r"\boxed{\dfrac{{k}}{4}}", "{k}/4", True), (r"so \boxed{2\frac12}", "5/2", True), (r"\boxed{{k}\sqrt{8}}", r"$2\cdot{k}$", False), (r"\boxed{{k}\sqrt{9}}", r"\sqrt[3]{27}\times{k}", False),
    (r"\boxed{\sqrt[3]{27}}", "3", True), (r"\boxed{({k}, -1)}", r"\left({k},-1\right)", True), (r"\boxed{[{k}, 1)}", "({k},1)", False), (r"\boxed{\{1, {k}/2, 0.5\}}", r"\{\frac{{k}}{2}, 1, \frac{1}{2}\}", True),
    (r"\boxed{{k}\%}", "{k}", True), (r"\boxed{x = {k}.0}", "{k}", True), (r"\boxed{\frac{\pi}{{k}}}", r"\frac{2\pi}{2{k}}", None), (r"\boxed{\frac{6\pi}{4}}", r"\frac{3}{2}\pi", True), (r"\boxed{(-3, {k})}", "({k},-3)", False),
    ("The answer is {k}.", "{k}1", False), (r"\boxed{\text{Evelyn}}", "Evelyn", True), ("I do not know", "{k}", False), (r"\boxed{3, 1, 2}", "1,2,3", True), (r"\boxed{2^{10}}", "1,024", True), (r"\boxed{1.5\times10^{3}}", "1500", True), (r"\boxed{-\frac{{k}}{3}}", "-{k}/3", True),
)


@query("FN4", f"SELECT o_orderkey AS id, CASE o_orderkey%{len(ANSWERS)} " + " ".join(f"WHEN {i} THEN {str(bool(same)).lower()}" for i, (_, _, same) in enumerate(ANSWERS)) + " END AS equal FROM orders")
def fn4(spark, d):
    """Answers in normal form."""
    at = (F.col("o_orderkey") % len(ANSWERS)).cast("int")
    pick = lambda k: F.replace(F.get(F.array(*[F.lit(a[k]) for a in ANSWERS]), at), F.lit("{k}"), F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pick(0).alias("response"), pick(1).alias("gold"))
    return rows.select("id", A.graded(F.col("response"), F.array("gold")).alias("equal"))


def _words(ws) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ws)


TYPE = rf"""CASE WHEN t = '' THEN 'whitespace' WHEN t IN ({_words(T.MARKS)}) THEN 'formatting' WHEN contains('+-*/=<>^%', t) THEN 'math_operator'
  WHEN regexp_matches(t, '^[{{}}()\[\]$]+$') THEN 'math_symbol' WHEN regexp_matches(t, '^[-.,]*[0-9][-.,0-9]*$') THEN 'number' WHEN starts_with(t, '\') OR t IN ({_words(T.LATEX)}) THEN 'latex_command'
  WHEN t IN ({_words(T.TRANSITION)}) THEN 'transition' WHEN t IN ({_words(T.FUNCTION)}) THEN 'function_word' WHEN t IN ({_words(T.MATH)}) THEN 'math_keyword'
  WHEN regexp_matches(t, '^\p{{L}}$') THEN 'variable' WHEN contains('.,;:!?\', t) THEN 'punctuation' WHEN starts_with(t, '<') THEN 'formatting'
  WHEN starts_with(t, '''') OR starts_with(t, '-') OR regexp_matches(t, '^\p{{L}}{{1,3}}$') THEN 'subword' ELSE 'word' END"""
TYPED = f"{TEXT_SQL}, y AS (SELECT doc_id, pos, token, is_correct, lower(token) AS t FROM x), z AS (SELECT doc_id, pos, token, is_correct, {TYPE} AS kind FROM y)"


@query("FN5", f"WITH {TYPED} SELECT token, kind, count(*) AS n FROM z GROUP BY ALL")
def fn5(spark, d):
    return text_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")).select("token", T.token_type(F.col("token")).alias("kind"), "n")


def _kinds(spark, d):
    """Counts by token and outcome first, so that each distinct token is classified once."""
    return text_tokens(spark, d).groupBy("token", "is_correct").agg(F.count("*").alias("n")).withColumn("kind", T.token_type(F.col("token")))


@query("PRJ6", f"WITH {TYPED} SELECT CASE WHEN kind IN ({_words(T.MATH_TYPES)}) THEN 'math' ELSE 'non-math' END AS side, count(*) AS n FROM z GROUP BY 1")
def prj6(spark, d):
    return _kinds(spark, d).groupBy(T.is_math(F.col("kind")).alias("side")).agg(F.sum("n").alias("n"))


@query("AGG21", f"WITH {TYPED}, c AS (SELECT is_correct, token, kind, count(*) AS n FROM z GROUP BY ALL), r AS (SELECT *, round(100*n/sum(n) OVER (PARTITION BY is_correct)::DOUBLE, 6) AS pct, row_number() OVER (PARTITION BY is_correct ORDER BY n DESC, token) AS place FROM c) SELECT is_correct, token, kind, n, pct, place FROM r WHERE place <= 30")
def agg21(spark, d):
    """The thirty most frequent tokens of each outcome."""
    c = _kinds(spark, d)
    total = c.groupBy("is_correct").agg(F.sum("n").alias("total"))
    ranked = c.withColumn("place", F.row_number().over(Window.partitionBy("is_correct").orderBy(F.desc("n"), "token")).cast("long")).where("place <= 30")
    return ranked.join(F.broadcast(total), "is_correct").select("is_correct", "token", "kind", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"), "place")


@query("AGG22", f"WITH {TYPED}, u AS (SELECT 'm'||(doc_id%3) AS model, 'd'||(doc_id%2) AS dataset, kind FROM z) SELECT model, dataset, kind, count(*) AS n FROM u GROUP BY ALL")
def agg22(spark, d):
    """Runs of several models, united and counted by type."""
    t = text_tokens(spark, d).select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), F.concat(F.lit("d"), F.col("doc_id") % 2).alias("dataset"), "token")
    return t.groupBy("model", "dataset", "token").agg(F.count("*").alias("n")).groupBy("model", "dataset", T.token_type(F.col("token")).alias("kind")).agg(F.sum("n").alias("n"))


@query("AGG23", f"WITH {cliffs_sql()}, {path_ok_sql()} SELECT c.path_id, c.pos, (c.k_now % 7)::BIGINT AS first_success FROM c JOIN ok ON ok.path_id = c.path_id WHERE NOT is_correct AND c.k_now % 7 < 4")
def agg23(spark, d):
    """Contexts of failures that some regeneration solves, with the first that does (of four samples)."""
    from ..operators import sequence as S

    solved = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("i"), (i == F.col("k_now") % 7).alias("ok")))
    rows = S.significant(tokens(spark, d)).join(path_ok(spark, d).where("not is_correct").select("path_id"), "path_id", "left_semi")
    return rows.select("path_id", "pos", F.get(F.filter(solved, lambda x: x["ok"]), F.lit(0))["i"].cast("long").alias("first_success")).where("first_success is not null")


@query("PRJ12", "SELECT doc_id, contains(text, 'License') AS has_boxed, contains(text, chr(10)) AS has_think, greatest(instr(text, chr(10))-1, 0)::BIGINT AS think_chars, right(text, 500) AS tail, left(text, 200) AS head FROM documents")
def prj12(spark, d):
    """Flags and excerpts of responses (here: a licence for the box, a line break for the end of thinking)."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.contains(t, F.lit("License")).alias("has_boxed"), F.contains(t, F.lit("\n")).alias("has_think"), F.greatest(F.instr(t, "\n") - 1, F.lit(0)).cast("long").alias("think_chars"), F.right(t, F.lit(500)).alias("tail"), F.left(t, F.lit(200)).alias("head"))


@query("PRJ14", r"SELECT page_id, left(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 180) AS name FROM pages")
def prj14(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


@query("PRJ15", "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_concat(list_concat([1, 2], ids[1:2]), [l_orderkey]) AS prefix FROM a")
def prj15(spark, d):
    """Prompt ids, the response up to before position 3, and a candidate."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("own"))
    ids = F.transform("own", lambda x: x["l_partkey"])
    return a.select("l_orderkey", F.concat(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.slice(ids, 1, 2), F.array("l_orderkey")).alias("prefix"))


SYSTEM, SHOTS, DIRECT = "Think step by step.", "Problem: 1+1\nSolution: 2\n\n", "Answer only."


@query("FN6", f"SELECT item_id, prompt_type, CASE prompt_type WHEN 'zeroshot' THEN '{SYSTEM}'||chr(10)||chr(10)||text WHEN 'direct' THEN '{DIRECT}'||chr(10)||chr(10)||'{SHOTS}'||'Q: '||text||chr(10)||'A:' ELSE '{SHOTS}'||'Problem: '||text||chr(10)||'Solution:' END AS prompt FROM benchmark, (SELECT unnest(['zeroshot', 'direct', 'fewshot']) AS prompt_type)".replace("\n", "'||chr(10)||'"))
def fn6(spark, d):
    """Prompts of the three kinds, without a chat template."""
    q = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(x) for x in ("zeroshot", "direct", "fewshot")])).alias("prompt_type"))
    p = F.when(F.col("prompt_type") == "zeroshot", F.concat(F.lit(SYSTEM + "\n\n"), "text")).when(F.col("prompt_type") == "direct", F.concat(F.lit(DIRECT + "\n\n" + SHOTS + "Q: "), "text", F.lit("\nA:"))).otherwise(F.concat(F.lit(SHOTS + "Problem: "), "text", F.lit("\nSolution:")))
    return q.select("item_id", "prompt_type", p.alias("prompt"))


@query("FN7", "SELECT o_orderkey||'_path_'||(o_custkey%4) AS path_id, o_orderpriority||'::'||o_orderkey||'::'||o_custkey AS uid, o_orderkey||'_'||o_custkey AS short_id FROM orders")
def fn7(spark, d):
    return table(spark, d, "orders").select(F.concat_ws("_path_", "o_orderkey", F.col("o_custkey") % 4).alias("path_id"), F.concat_ws("::", "o_orderpriority", "o_orderkey", "o_custkey").alias("uid"), F.concat_ws("_", "o_orderkey", "o_custkey").alias("short_id"))


@query("FN8", "SELECT DISTINCT replace(regexp_replace(printf('%.6f', l_discount), '\\.?0+$', ''), '.', 'p') AS tag, printf('%.2f', 100*l_discount) AS pct FROM lineitem")
def fn8(spark, d):
    return table(spark, d, "lineitem").select("l_discount").distinct().select(T.temperature_tag(F.col("l_discount")).alias("tag"), F.format_string("%.2f", 100 * F.col("l_discount")).alias("pct"))


@query("FN9", "SELECT p_partkey, p_size::DOUBLE AS source_size, (p_size%7+0.5)::DOUBLE AS eval_size, CASE WHEN p_size < p_size%7+0.5 THEN 'small_to_big' ELSE 'big_to_small' END AS direction FROM part")
def fn9(spark, d):
    """Sizes read from model names, and the direction between them."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Model-"), "p_size", F.lit("B-it")).alias("a"), F.concat(F.lit("model_"), F.col("p_size") % 7, F.lit(".5b")).alias("b"))
    s = p.select("p_partkey", T.model_size(F.col("a")).alias("source_size"), T.model_size(F.col("b")).alias("eval_size"))
    return s.withColumn("direction", F.when(F.col("source_size") < F.col("eval_size"), "small_to_big").otherwise("big_to_small"))


@query("FN10", "SELECT event_id, round(exp(-value/100), 9) AS e, round(ln(value+1), 9) AS l, round(sqrt(value), 9) AS s, abs(value-50) AS a, least(value, 10) AS lo, greatest(value, 10) AS hi, isfinite(value) AS ok FROM events")
def fn10(spark, d):
    v = F.col("value")
    ok = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return table(spark, d, "events").select("event_id", F.round(F.exp(-v / 100), 9).alias("e"), F.round(F.log(v + 1), 9).alias("l"), F.round(F.sqrt(v), 9).alias("s"), F.abs(v - 50).alias("a"), F.least(v, F.lit(10.0)).alias("lo"), F.greatest(v, F.lit(10.0)).alias("hi"), ok.alias("ok"))


@query("FN11", "SELECT vec_id, embedding[1:3] AS head, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_pos, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS any_large FROM embeddings")
def fn11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("head"), F.size("embedding").cast("long").alias("n"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_pos"), F.exists("embedding", lambda x: x > 0.3).alias("any_large"))


@query("FN12", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def fn12(spark, d):
    """JSON text parsed, written and parsed again."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.from_json(F.to_json("p"), "k bigint")["k"].alias("k"))


@query("FN14", "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey), a1 AS (SELECT l_orderkey, CASE WHEN ids[1] = 1 THEN ids ELSE list_concat([1], ids) END AS p0 FROM a), b AS (SELECT l_orderkey, CASE WHEN len(p0)+2 > 6 THEN list_concat([1], p0[-2:]) ELSE p0 END AS p FROM a1) SELECT l_orderkey, list_concat(p, [l_orderkey, 2]) AS input_ids, list_concat(list_transform(p, lambda x: -100), [l_orderkey, 2]) AS labels FROM b")
def fn14(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("own"))
    ids = F.transform("own", lambda x: x["l_partkey"])
    row = T.preference_row(ids, F.col("l_orderkey"), 1, 2, 6, 3)
    return a.select("l_orderkey", row.alias("r")).select("l_orderkey", F.col("r.input_ids").cast("array<bigint>").alias("input_ids"), F.col("r.labels").cast("array<bigint>").alias("labels"))


#: Default sampling parameters by mode.
DEFAULTS = {"thinking": (0.6, 0.95, 32768), "non_thinking": (0.7, 0.9, 8192)}


@query("FN15", "SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE CASE WHEN o_custkey%2=0 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END END AS temperature, CASE WHEN o_orderkey%4=0 THEN 1::DOUBLE WHEN o_custkey%2=0 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS top_p, CASE WHEN o_custkey%2=0 THEN 32768 ELSE 8192 END AS max_tokens FROM orders")
def fn15(spark, d):
    """Sampling parameters of a request's mode, with its own temperature if it has one; temperature 0 takes top_p 1."""
    dim = spark.createDataFrame([(m, *v) for m, v in DEFAULTS.items()], "mode string, t double, p double, max_tokens int")
    own = F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.0)).when(F.col("o_orderkey") % 4 == 1, F.lit(0.3))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "thinking").otherwise("non_thinking").alias("mode"), own.alias("own"))
    return o.join(F.broadcast(dim), "mode").select("o_orderkey", F.coalesce("own", "t").alias("temperature"), F.when(F.col("own") == 0, 1.0).otherwise(F.col("p")).alias("top_p"), "max_tokens")


FORM_KEYS = ("gsm1k", "math500", "aime24", "aime25", "gsm8k")
#: Raw problems from orders: a set a priority, blanks around questions, ids that lack or are 0, answers of several kinds.
RAW = r"""o AS (SELECT o_orderkey AS k, left(o_orderpriority, 1)::BIGINT AS f, ' '||o_orderpriority||chr(10) AS q, CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '' ELSE 'u'||o_custkey END AS uid,
    CASE WHEN o_orderkey%3 = 0 THEN ' 0'||(o_custkey%100)||' ' WHEN o_orderkey%3 = 1 THEN 'work #### '||o_custkey||' #### '||(o_custkey+1)||chr(10) ELSE 'x^'||o_custkey END AS a FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k)-1 AS i, regexp_replace(a, '^\s+|\s+$', '', 'g') AS s FROM o)"""


@query("SRC10", f"""WITH {RAW} SELECT CASE f WHEN 1 THEN 'gsm1k' WHEN 2 THEN 'math500' WHEN 3 THEN 'aime24' WHEN 4 THEN 'aime25' ELSE 'gsm8k' END AS problem_set,
  CASE WHEN f IN (2, 3, 4) AND uid LIKE 'u%' THEN uid ELSE CASE f WHEN 1 THEN 'GSM1K_' WHEN 2 THEN 'MATH_' WHEN 3 THEN 'AIME24_' WHEN 4 THEN 'AIME25_' ELSE 'GSM8K_' END||i END AS id, trim(q, ' '||chr(10)) AS question,
  [CASE WHEN f = 3 AND regexp_matches(s, '^[0-9]+$') THEN s::BIGINT::VARCHAR WHEN f = 5 AND contains(a, '####') THEN trim(string_split(a, '####')[-1], ' '||chr(10)) ELSE s END] AS answer,
  CASE WHEN f = 2 THEN CASE WHEN k%5 = 0 THEN '' ELSE 'level'||k%5 END END AS "level", CASE WHEN f = 5 THEN CASE WHEN i < 2500 THEN 1 WHEN i < 5000 THEN 2 ELSE 3 END END::BIGINT AS file FROM n""")
def src10(spark, d):
    """Raw problem sets in one form, each by its own rules; gsm8k's training problems in three files."""
    from ..sources import problems

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    answer = F.when(k % 3 == 0, F.concat(F.lit(" 0"), c % 100, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("work #### "), c, F.lit(" #### "), c + 1, F.lit("\n"))).otherwise(F.concat(F.lit("x^"), c))
    uid = F.when(k % 4 == 1, "0").when(k % 4 == 2, "").when(k % 4 == 3, F.concat(F.lit("u"), c))
    raw = table(spark, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("f"), F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")).alias("text"), uid.alias("uid"), answer.alias("answer"), F.when(k % 5 != 0, F.concat(F.lit("level"), k % 5)).alias("level"), F.lit(None).cast("string").alias("subject"))
    sets = []
    for f, form in enumerate(FORM_KEYS, 1):
        question, key, _, more = problems.FORMS[form]
        own = raw.where(F.col("f") == str(f)).withColumnsRenamed({"text": question, "uid": key or "uid"})
        out = problems.normalise(own, form, "o_orderkey")
        file = problems.training_file(F.col("n")) if form == "gsm8k" else F.lit(None).cast("long")
        sets.append(out.select(F.lit(form).alias("problem_set"), "id", "question", "answer", (F.col("level") if "level" in more else F.lit(None).cast("string")).alias("level"), file.alias("file")))
    return reduce(lambda a, b: a.unionByName(b), sets)


MOST_DATASETS = 1000


@query("SRC12", "SELECT o_custkey%9 AS model, o_orderpriority AS dataset, round(avg(o_orderkey%2), 6) AS accuracy FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1, 2")
def src12(spark, d):
    """A wide accuracy table made long; count columns and dashes are left out."""
    from ..operators import summary

    o = table(spark, d, "orders")
    names = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(MOST_DATASETS + 1).collect()]  # one row a dataset
    if len(names) > MOST_DATASETS:
        raise ValueError(f"a wide table takes {MOST_DATASETS} datasets at most")
    wide = o.groupBy((F.col("o_custkey") % 9).alias("model")).agg(*[F.coalesce(F.when(F.lit(not n.startswith("5")), F.round(F.avg(F.when(F.col("o_orderpriority") == n, F.col("o_orderkey") % 2)), 6)).cast("string"), F.lit("-")).alias(n) for n in names], F.count("*").cast("string").alias("all_n"))
    return summary.accuracy_rows(wide)


ALIASES = {"Auto-1": "org/Auto", "auto-2": "org/Auto-Big", "build": "org/Building"}
KNOWN = ["org/Auto", "org/Building", "other/Building", "lab/Machinery", "lab/Household/"]


@query("SRC13", """WITH c AS (SELECT c_custkey, CASE c_custkey%14 WHEN 0 THEN 'Auto-1' WHEN 1 THEN 'auto-1' WHEN 2 THEN ' AUTO-2 ' WHEN 3 THEN 'BUILD' WHEN 4 THEN 'org/Auto' WHEN 5 THEN 'org/Auto//' WHEN 6 THEN 'ORG/AUTO/' WHEN 7 THEN 'machinery'
    WHEN 8 THEN '/local/Machinery/' WHEN 9 THEN 'building' WHEN 10 THEN 'HOUSEHOLD' WHEN 11 THEN '  ' WHEN 12 THEN NULL ELSE ' '||c_mktsegment||'-x' END AS name FROM customer)
  SELECT c_custkey, CASE c_custkey%14 WHEN 0 THEN 'org/Auto' WHEN 1 THEN 'auto-1' WHEN 2 THEN 'org/Auto-Big' WHEN 3 THEN 'org/Building' WHEN 4 THEN 'org/Auto' WHEN 5 THEN 'org/Auto' WHEN 6 THEN 'org/Auto' WHEN 7 THEN 'lab/Machinery'
    WHEN 8 THEN 'lab/Machinery' WHEN 9 THEN 'building' WHEN 10 THEN 'lab/Household/' WHEN 11 THEN '' WHEN 12 THEN NULL ELSE name END AS model FROM c""")
def src13(spark, d):
    """Names resolved by alias, known name or last part, whatever their case; others stay."""
    forms = ["Auto-1", "auto-1", " AUTO-2 ", "BUILD", "org/Auto", "org/Auto//", "ORG/AUTO/", "machinery", "/local/Machinery/", "building", "HOUSEHOLD", "  ", None]
    own = F.coalesce(F.get(F.array(*[F.lit(x) for x in forms]), (F.col("c_custkey") % 14).cast("int")), F.when(F.col("c_custkey") % 14 == 13, F.concat(F.lit(" "), "c_mktsegment", F.lit("-x"))))
    return table(spark, d, "customer").select("c_custkey", own.alias("name")).select("c_custkey", N.resolve_model(F.col("name"), ALIASES, KNOWN).alias("model"))


@query("SRC14", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'MATH' WHEN o_orderpriority LIKE '2%' THEN 'GSM1K' WHEN o_orderpriority LIKE '3%' THEN 'AIME' ELSE ds END AS source, CASE WHEN o_orderpriority LIKE '1%' THEN 2048 WHEN o_orderpriority LIKE '2%' THEN 1024 ELSE 4096 END AS max_tokens FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 'math500_'||o_orderkey%3 WHEN o_orderpriority LIKE '2%' THEN 'GSM1K_shard'||o_orderkey%3 WHEN o_orderpriority LIKE '3%' THEN 'aime25' ELSE 'other' END AS ds FROM orders)")
def src14(spark, d):
    """Source name and token limit of a dataset: by the longest known name that begins its own, in any case; else itself and the default."""
    p = F.left("o_orderpriority", F.lit(1))
    ds = F.when(p == "1", F.concat(F.lit("math500_"), F.col("o_orderkey") % 3)).when(p == "2", F.concat(F.lit("GSM1K_shard"), F.col("o_orderkey") % 3)).when(p == "3", "aime25").otherwise("other")
    source, most = N.by_prefix(F.col("dataset"), {"math": ("MATH", 2048), "gsm1k": ("GSM1K", 1024), "aime": ("AIME", 4096)}, (None, 4096))
    return table(spark, d, "orders").select("o_orderkey", ds.alias("dataset")).select("o_orderkey", source.alias("source"), most.alias("max_tokens"))
