"""FN4: equality of mathematical answers, by normal forms that need no algebra library.

An answer is brought to one spelling (spaces, $, \\left and \\right, \\text, kinds of \\frac, degrees, percent signs and thousands
separators dropped, what stands before an equals sign as well). Its value is then read where it is a number, a fraction, a mixed
fraction, a power, or a product of a number, a root and pi, also over another such product. Tuples and intervals are compared element by element, with their
brackets; sets and bare lists in any order. Elements are equal if they are spelled alike or their values agree to nine digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import balanced_box, extract_answer

_NUM = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_TERM = rf"({_NUM})?\*?(?:\\sqrt(?:\[([0-9]+)\])?\{{({_NUM})\}})?\*?(\\pi)?"
_PLAIN = rf"^([+-]?){_TERM}$"
_SLASH = rf"^([+-]?){_TERM}/{_TERM}$"
_FRAC = rf"^([+-]?)([0-9]+)?\\frac\{{([+-]?){_TERM}\}}\{{{_TERM}\}}{_TERM.replace(f'({_NUM})?', '()', 1)}$"
_POWER = rf"^([+-]?)({_NUM})\^\{{?([+-]?{_NUM})\}}?$"
_TENS = rf"^([+-]?)({_NUM})\*10\^\{{?([+-]?[0-9]+)\}}?$"


def spelled(c: Column) -> Column:
    """One spelling of an answer."""
    for pattern, by in (
        (r"\\(?:left|right|\$|displaystyle|!|,|;|:|quad)|[$\s]|\\ |~", ""), (r"\\(?:text|mathrm|mathbf|textbf|mbox)\{([^{}]*)\}", "$1"), (r"\\[dtc]frac", r"\\frac"), (r"\\(?:cdot|times)", "*"),
        (r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}"), (r"\\frac([0-9])\{", r"\\frac{$1}{"), (r"\\sqrt([0-9])", r"\\sqrt{$1}"), (r"\^\{?\\circ\}?|\\?%", ""), (r"^[A-Za-z]\w*=(?!=)", ""), (r"\.$", ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    return F.when(F.rlike(c, F.lit(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")), F.replace(c, F.lit(","))).otherwise(c)


def _sign(t: Column, pattern: str, group: int) -> Column:
    return F.when(F.regexp_extract(t, pattern, group) == "-", -1.0).otherwise(1.0)


def _term(t: Column, pattern: str, first: int) -> Column:
    """The product of the term whose four groups begin at `first`; 1 where it is empty."""
    number, degree, under, pi = (F.nullif(F.regexp_extract(t, pattern, first + k), F.lit("")) for k in range(4))
    root = F.pow(under.try_cast("double"), 1 / F.coalesce(degree.try_cast("double"), F.lit(2.0)))
    return F.coalesce(number.try_cast("double"), F.lit(1.0)) * F.coalesce(root, F.lit(1.0)) * F.when(pi.isNotNull(), math.pi).otherwise(1.0)


def value(t: Column) -> Column:
    """The value of a spelled answer; null where it has none here, or divides by zero."""
    fits = lambda pattern: F.rlike(t, F.lit(pattern))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("double")
    over = F.try_divide(_term(t, _FRAC, 4), _term(t, _FRAC, 8))
    whole = F.coalesce(part(_FRAC, 2), F.lit(0.0))
    return (
        F.when(~F.rlike(t, F.lit(r"[0-9]|\\pi")), F.lit(None).cast("double"))
        .when(fits(_PLAIN), _sign(t, _PLAIN, 1) * _term(t, _PLAIN, 2))
        .when(fits(_SLASH), _sign(t, _SLASH, 1) * F.try_divide(_term(t, _SLASH, 2), _term(t, _SLASH, 6)))
        .when(fits(_FRAC), _sign(t, _FRAC, 1) * (whole + _sign(t, _FRAC, 3) * over) * _term(t, _FRAC, 12))
        .when(fits(_POWER), _sign(t, _POWER, 1) * F.pow(part(_POWER, 2), part(_POWER, 3)))
        .when(fits(_TENS), _sign(t, _TENS, 1) * part(_TENS, 2) * F.pow(F.lit(10.0), part(_TENS, 3)))
    )


def _let(c: Column, use) -> Column:
    """use(c), with c worked out once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _form(answer: Column) -> Column:
    """Of a spelled answer its text, its brackets ("{}" for sets and bare lists, empty for single values) and its elements (value, text)."""
    closed = F.rlike(answer, F.lit(r"^[\(\[].*,.*[\)\]]$"))
    braced = F.rlike(answer, F.lit(r"^\\\{.*\\\}$"))
    kind = F.when(closed, F.concat(F.left(answer, F.lit(1)), F.right(answer, F.lit(1)))).when(braced | F.contains(answer, F.lit(",")), "{}").otherwise("")
    inner = F.when(closed, F.regexp_replace(answer, r"^.|.$", "")).when(braced, F.regexp_replace(answer, r"^\\\{|\\\}$", "")).otherwise(answer)
    each = F.transform(F.split(inner, ","), lambda x: F.struct(value(x).alias("v"), x.alias("s")))
    return F.struct(answer.alias("text"), kind.alias("kind"), F.when(kind == "{}", F.sort_array(each)).otherwise(each).alias("own"))


def _same(a: Column, b: Column) -> Column:
    near = F.zip_with(a["own"], b["own"], lambda x, y: (x["s"] == y["s"]) | F.coalesce(F.abs(x["v"] - y["v"]) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x["v"])), F.lit(False)))
    return (a["text"] == b["text"]) | ((a["kind"] == b["kind"]) & (F.size(a["own"]) == F.size(b["own"])) & F.forall(near, lambda x: x))


def equal(answer: Column, golds: Column) -> Column:
    """Whether an answer is the same as one of the golds; null counts as unlike all."""
    forms = F.transform(F.transform(golds, spelled), _form)
    return F.coalesce(_let(spelled(answer), lambda t: _let(_form(t), lambda a: F.exists(forms, lambda b: _same(a, b)))), F.lit(False))


def graded(response: Column, golds: Column) -> Column:
    """Whether a response's answer is one of the golds: what the last \\boxed holds, else what is said to be the answer, else all of it."""
    return equal(F.coalesce(balanced_box(response), extract_answer(response)), golds)
