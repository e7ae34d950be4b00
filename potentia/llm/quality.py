"""Op 3: a quality classifier as a sparse rule ensemble.

Statistics of the whole text (shares of letters, signs, lines, words; STATISTICS) are Spark expressions.
From a bounded sample of labelled rows a seeded forest of shallow trees is grown; every path from a root
to a node becomes a rule, a conjunction of thresholds on statistics. Logistic regression with a lasso
penalty keeps a few of the rules, and the fitted score is compiled into one Spark column expression, so
scoring is a projection: no shuffle, no Python.

Defined cases: null text counts as empty, whose statistics are 0; a null doc_id is never held out nor
learned from; labels that are null are ignored; rows that repeat count once each; without both classes
among the labels the score is the share of label 1 (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Labelled rows to learn from at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 12_000

#: Statistics as SQL over t (the text), n (its length), w (its words), l (its lines); n, w and l count at least 1.
STATISTICS = {
    "chars": "length(t)",
    "upper": "regexp_count(t, '\\\\p{Lu}') / n",
    "signs": "regexp_count(t, '[^\\\\p{L}\\\\p{N}\\\\s]') / n",
    "digits": "regexp_count(t, '[0-9]') / n",
    "bangs": "regexp_count(t, '[!?]') / n",
    "bars": "regexp_count(t, '[|]') / n",
    "marks": "regexp_count(t, '[#$%&*<>=_~^@]') / n",
    "stops": "regexp_count(t, '[.!?](?=\\\\s|$)') / size(w)",
    "word_length": "n / size(w)",
    "distinct_words": "size(array_distinct(w)) / size(w)",
    "line_length": "n / size(l)",
    "distinct_lines": "size(array_distinct(l)) / size(l)",
    "full_lines": "size(filter(l, x -> right(x, 1) in ('.', '!', '?'))) / size(l)",
}


def statistics(docs: DataFrame, own_s: str = "own_s") -> DataFrame:
    """docs with a struct own_s of STATISTICS (a name that no column has)."""
    t, n, w, l = fresh([*docs.columns, own_s], "own_t", "own_n", "own_w", "own_l")  # noqa: E741
    parts = docs.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    parts = parts.withColumns({w: F.split(t, r"\s+"), l: F.split(t, "\n"), n: F.greatest(F.length(t), F.lit(1))})
    names = {"t": t, "n": n, "w": w, "l": l}
    own = lambda sql: F.expr(re.sub(r"\b(t|n|w|l)\b(?![(}'])(?=[,) ]|$)", lambda m: f"`{names[m[1]]}`", sql)).cast("double")
    return parts.withColumn(own_s, F.struct(*[own(sql).alias(name) for name, sql in STATISTICS.items()])).drop(t, n, w, l)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rng, least: int, rules: set) -> None:
    """Split rows on the threshold of the largest Gini gain among some statistics; keep each node's path."""
    if path:
        rules.add(frozenset(path))
    if depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
        return
    best = None
    for j in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        v, ones = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(np.diff(v) > 0)
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if not len(cut):
            continue
        left, total = cut + 1.0, ones[-1]
        right = len(v) - left
        impurity = ones[cut] * (left - ones[cut]) / left + (total - ones[cut]) * (right - total + ones[cut]) / right
        at = int(np.argmin(impurity))
        if best is None or impurity[at] < best[0]:
            best = (impurity[at], int(j), float((v[cut[at]] + v[cut[at] + 1]) / 2))
    if best is None:
        return
    _, j, t = best
    t = float(f"{t:.6g}")
    low = x[rows, j] <= t
    for below in (True, False):
        _grow(x, y, rows[low == below], (*path, (j, below, t)), depth - 1, rng, least, rules)


def extract_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, seed: int = 11) -> list[frozenset]:
    """Rules of a seeded forest, each tree on its own half of the rows."""
    rng, rules = np.random.default_rng(seed), set()
    least = max(5, len(y) // 400)
    for _ in range(trees):
        rows = rng.choice(len(y), size=max(2, len(y) // 2), replace=False)
        _grow(x, y, np.sort(rows), (), depth, rng, least, rules)
    return sorted(rules, key=lambda r: (len(r), sorted(r)))


def holds(rule: frozenset, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, t in rule:
        out &= (x[:, j] <= t) == below
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, *, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by proximal gradient steps with momentum; the intercept has no penalty."""
    n = len(y)
    z1 = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / max(np.linalg.norm(z1, 2) ** 2, 1e-12)
    w = np.zeros(z1.shape[1])
    w[0] = np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ ahead, -30, 30)))
        new = ahead - rate * (z1.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class RuleEnsemble:
    """Rules with weights; score() is the Spark expression over own_s."""

    def __init__(self, intercept: float, rules: list[tuple[float, frozenset]]):
        self.intercept, self.rules = intercept, rules

    def score(self, own_s: str = "own_s") -> Column:
        names = list(STATISTICS)
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds_here = F.lit(True)
            for j, below, t in sorted(rule):
                value = F.col(own_s)[names[j]]
                holds_here = holds_here & ((value <= t) if below else (value > t))
            total = total + F.when(holds_here, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", penalty: float = 0.002, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from at most sample_rows labelled rows that aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("own_y")).where(F.col("own_y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "own_y").limit(sample_rows)  # bounded, so it can be broadcast
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("doc_id", "own_y", "own_s.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    y = rows.own_y.to_numpy(float)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    x = rows[list(STATISTICS)].to_numpy(float)
    masks: dict[bytes, frozenset] = {}
    for rule in extract_rules(x, y):
        mask = holds(rule, x)
        if 0 < mask.sum() < len(y):
            masks.setdefault(np.packbits(mask).tobytes(), rule)  # rules that agree on all rows count once
    rules = list(masks.values())
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, w = lasso_logistic(z, y, penalty)
    return RuleEnsemble(intercept, [(float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from threshold on); columns of docs with these names give way."""
    model = fit(docs, labels, **options)
    own_s, own_score = fresh(docs.columns, "own_s", "own_score")
    scored = statistics(docs, own_s).withColumn(own_score, model.score(own_s))
    return scored.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")], held_out(F.col("doc_id")).alias("held_out"), F.col(own_score).alias("score"), (F.col(own_score) >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    model = fit(docs, labels, **options)
    (own_s,) = fresh(docs.columns, "own_s")
    return statistics(docs, own_s).where(model.score(own_s) >= threshold).select(*docs.columns)
