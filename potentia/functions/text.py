"""Expressions on response texts and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word classes of the token classifier.
TRANSITION = """however but instead therefore thus hence so then since because although yet actually wait no let now first
next finally alternatively note after before while when if not this that here also still""".split()
FUNCTION = """the a an is are was were be to of in for on with at by and or as from into each per we she he it they her his
has have had do does did can will would could should""".split()
MATH = """equation solve calculate compute find substitute simplify factor expand multiply divide add subtract equals total
number sum difference product remainder frac sqrt log sin cos tan hours hour minutes days points miles regular possible
remaining currently""".split()
MARKS, LATEX = ("**", "***", "###", "##", "#", "---"), ("frac", "sqrt", "boxed", "cdot", "times")
MATH_TYPES = ("number", "math_symbol", "math_operator", "math_keyword", "latex_command", "variable")


def extract_answer(response: Column) -> Column:
    """FN1: from the last \\boxed on; else what follows the last "he answer is", trimmed; else all of it."""
    boxed = F.concat(F.lit("\\boxed"), F.substring_index(response, "\\boxed", -1))
    said = F.trim(F.substring_index(response, "he answer is", -1))
    return F.when(F.contains(response, F.lit("\\boxed")), boxed).when(F.contains(response, F.lit("he answer is")), said).otherwise(response)


def balanced_box(response: Column) -> Column:
    """What stands in the braces of the last \\boxed, nested braces included; null where they don't close or none follow.

    Depths are running sums over the characters after the box; the fold keeps only the depth and the place where it gets to 0.
    """
    after = F.substring_index(response, "\\boxed", -1)
    braces = F.regexp_extract_all(after, F.lit(r"([{}]|[^{}]+)"), 1)
    fold = F.aggregate(
        braces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end")),
        lambda s, x: F.when(s["end"] >= 0, s).otherwise(
            F.struct(
                (s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"),
                (s["at"] + F.length(x)).alias("at"),
                F.when((x == "}") & (s["depth"] == 1), s["at"]).otherwise(-1).alias("end"),
            )
        ),
        lambda s: s["end"],
    )
    return F.when(F.contains(response, F.lit("\\boxed")) & F.startswith(after, F.lit("{")), F.when(fold >= 0, F.substring(after, F.lit(2), fold - 1)))


def as_integer(c: Column) -> Column:
    """An integer as text, with blanks around, a sign and single underscores between digits; else null. Up to 18 digits."""
    t = F.trim(c)
    return F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$")), F.regexp_replace(t, "_", "").try_cast("bigint"))


def normalise_answer(c: Column) -> Column:
    """Without thousands separators, currency and percent signs, and .00 or .0 at the end."""
    t = F.replace(F.replace(c, F.lit(",")), F.lit("\\,"))
    t = F.trim(F.regexp_replace(t, r"^[\\$]+|[\\$]+$", ""))
    t = F.trim(F.regexp_replace(t, r"[\\%]+$", ""))
    return F.regexp_replace(t, r"\.00?$", "")


def light_grade(response: Column, golds: Column) -> Column:
    """FN2: the answer as an integer against the gold answers: true, false where some gold is an integer, null where undecided."""
    said = F.when(F.contains(response, F.lit("he answer is")), F.trim(F.regexp_replace(F.trim(F.substring_index(response, "he answer is", -1)), r"\.+$", "")))
    answer = as_integer(normalise_answer(F.when(F.contains(response, F.lit("\\boxed")), F.trim(balanced_box(response))).otherwise(said)))
    whole = F.filter(F.transform(golds, as_integer), lambda g: g.isNotNull())
    return F.when(answer.isNull() | (F.size(whole) == 0), F.lit(None).cast("boolean")).otherwise(F.array_contains(whole, answer))


def token_type(token: Column) -> Column:
    """FN5: the first of fourteen rules that fits."""
    t = F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))
    within = lambda chars: F.instr(F.lit(chars), t) > 0
    return (
        F.when(t == "", "whitespace")
        .when(t.isin(*MARKS), "formatting")
        .when(within("+-*/=<>^%"), "math_operator")
        .when(F.rlike(t, F.lit(r"^[{}()\[\]$]+$")), "math_symbol")
        .when(F.rlike(t, F.lit(r"^[-.,]*[0-9][-.,0-9]*$")), "number")
        .when(F.startswith(t, F.lit("\\")) | t.isin(*LATEX), "latex_command")
        .when(t.isin(*TRANSITION), "transition")
        .when(t.isin(*FUNCTION), "function_word")
        .when(t.isin(*MATH), "math_keyword")
        .when(F.rlike(t, F.lit(r"^\p{L}$")), "variable")
        .when(within(".,;:!?\\"), "punctuation")
        .when(F.contains(token, F.lit("\n")) | F.startswith(t, F.lit("<")), "formatting")
        .when(F.startswith(t, F.lit("'")) | F.startswith(t, F.lit("-")) | F.rlike(t, F.lit(r"^\p{L}{1,3}$")), "subword")
        .otherwise("word")
    )


def is_math(kind: Column) -> Column:
    return F.when(kind.isin(*MATH_TYPES), "math").otherwise("non-math")


def file_name(c: Column) -> Column:
    """PRJ14: other than letters, digits, - and _ become _; at most 180 characters."""
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), F.lit(180))


def temperature_tag(t: Column) -> Column:
    """FN8: shortest form with p for the point."""
    return F.replace(F.regexp_replace(F.format_string("%.6f", t), r"\.?0+$", ""), F.lit("."), F.lit("p"))


def model_size(name: Column) -> Column:
    """FN9: billions of parameters as the name has them; null without."""
    return F.nullif(F.regexp_extract(F.lower(name), r"(\d+(\.\d+)?)\s*b\b", 1), F.lit("")).cast("double")


def preference_row(prompt: Column, chosen: Column, bos: int | None, eos: int | None, max_length: int, max_prompt: int, keep_start: bool = False, pad: int = -100) -> Column:
    """FN14: prompt ids, input ids, attention mask and labels of one response token; the prompt is masked in the labels.

    A missing begin id is added; a prompt too long for the row is cut to max_prompt ids (its end, unless keep_start), and then begins with the begin id again.
    """
    p = prompt if bos is None else F.when(F.coalesce(F.get(prompt, F.lit(0)) == bos, F.lit(False)), prompt).otherwise(F.concat(F.array(F.lit(bos)), prompt))
    part = F.slice(p, 1, max_prompt) if keep_start else F.slice(p, F.greatest(F.lit(1), F.size(p) - max_prompt + 1), F.lit(max_prompt))
    if bos is not None:
        part = F.when(F.get(part, F.lit(0)) == bos, part).otherwise(F.concat(F.array(F.lit(bos)), F.slice(part, 2, max_prompt)))
    p = F.when(F.size(p) + 2 > max_length, part).otherwise(p)
    answer = F.array(chosen) if eos is None else F.array(chosen, F.lit(eos))
    ids = F.concat(p, answer)
    return F.struct(p.alias("prompt_input_ids"), ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), F.concat(F.array_repeat(F.lit(pad), F.size(p)), answer).alias("labels"))
