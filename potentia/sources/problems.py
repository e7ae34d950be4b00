"""Problem sets in one form: id, question, answer (array), and what else a set has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered

#: The question's column and the id's, the prefix of missing ids, and further columns, by problem set.
FORMS = {
    "gsm1k": ("question", None, "GSM1K_", ()),
    "math500": ("problem", "unique_id", "MATH_", ("level", "subject")),
    "aime24": ("problem", "id", "AIME24_", ()),
    "aime25": ("problem", "problem_idx", "AIME25_", ()),
    "gsm8k": ("question", None, "GSM8K_", ()),
    "gsm8k_test": ("question", None, "GSM8K_test_", ()),
}
#: Rows of the first two training files of gsm8k; the third has the rest.
SHARD_ROWS = 2500


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(raw: DataFrame, form: str, order: str) -> DataFrame:
    """SRC10: id, question, answer (and level, subject) of a raw problem set; its rows are numbered from 0 by `order` for ids that lack.

    An empty or zero id counts as missing. aime24 answers of digits lose their leading zeros; gsm8k answers are what follows the
    last ####; all are stripped. A null question stays null; null level or subject is empty.
    """
    question, key, prefix, more = FORMS[form]
    rows = numbered(raw, order)
    made = F.concat(F.lit(prefix), F.col("n").cast("string"))
    own = F.col(key).cast("string") if key else F.lit(None).cast("string")
    answer = F.col("answer").cast("string")
    if form.startswith("gsm8k"):
        answer = F.element_at(F.split(answer, "####"), -1)
    answer = strip(answer)
    if form == "aime24":
        answer = F.when(F.rlike(answer, F.lit("^[0-9]+$")), F.regexp_replace(answer, "^0+(?=[0-9])", "")).otherwise(answer)
    return rows.select(F.coalesce(F.when(~own.isin("", "0"), own), made).alias("id"), strip(F.col(question)).alias("question"), F.array(answer).alias("answer"), *[F.coalesce(c, F.lit("")).alias(c) for c in more], "n")


def training_file(n: Column) -> Column:
    """The file, from 1 to 3, of a numbered training problem of gsm8k."""
    return (F.least(F.floor(n / SHARD_ROWS), F.lit(2)) + 1).cast("long")
