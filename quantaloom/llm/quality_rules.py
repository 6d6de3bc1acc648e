"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Statistics of a text (densities of symbols, capitals, digits; shares of distinct words and lines; lengths) are Spark columns.
Boosted trees of small depth are grown on a bounded sample of labelled texts; every path from a root is a
rule, a conjunction of comparisons.  A logistic model with an L1 penalty weighs the rules, most weights are exactly zero,
and what is left becomes one column expression: scoring runs in the JVM, in the scan's stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .workspace import table

#: Labelled texts that the model is fitted on at most, drawn by a hash of the id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RULES = 40, 3, 48, 64
STATISTICS = ("symbols", "capitals", "digits", "bars", "stops", "distinct_words", "distinct_lines", "word_length", "words", "line_words")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text by name; a null text counts as empty, for which all are 0."""
    t = F.coalesce(text, F.lit(""))
    n, words, lines = F.char_length(t), F.regexp_count(t, F.lit(r"\S+")), F.split(t, "\n")

    def per(x: Column, y: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0)), 6)

    return {
        "symbols": per(F.regexp_count(t, F.lit(r"[*&%$#!<>{}\[\]=~^_\\@+]")), n),
        "capitals": per(F.regexp_count(t, F.lit(r"\p{Lu}")), n),
        "digits": per(F.regexp_count(t, F.lit("[0-9]")), n),
        "bars": per(n - F.char_length(F.replace(t, F.lit("|"), F.lit(""))), n),
        "stops": per(F.regexp_count(t, F.lit("[.?!]")), words),
        "distinct_words": per(F.size(F.array_distinct(F.split(t, r"\s+"))), words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "word_length": per(n - F.regexp_count(t, F.lit(r"\s")), words),
        "words": words.cast("double"),
        "line_words": per(words, F.size(lines)),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (statistic, upper, value): statistic <= value if upper, else statistic > value."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, upper, value in self.tests:
            out &= (x[name] <= value) == upper
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, upper, value in self.tests:
            out = out & (F.col(name) <= value if upper else F.col(name) > value)
        return out


@dataclass(frozen=True)
class RuleModel:
    """Probability of label 1: the logistic function of ``intercept`` plus the weights of the rules that hold."""

    intercept: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(x: dict[str, np.ndarray], target: np.ndarray, weight: np.ndarray, edges: dict[str, np.ndarray], depth: int) -> tuple[list[tuple], np.ndarray]:
    """Grow one regression tree; the tests on the way to each of its nodes, and its predictions."""
    out, fitted = [], np.zeros(len(target))
    todo = [((), np.arange(len(target)))]
    while todo:
        tests, rows = todo.pop()
        if tests:
            out.append(tests)
        g, h = target[rows], weight[rows]
        fitted[rows] = g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        if len(tests) < depth and len(rows) >= 40:
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for name, cut in edges.items():
                b = np.searchsorted(cut, x[name][rows])
                gs, hs, n = (np.cumsum(np.bincount(b, v, len(cut) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
                gain[(n < 20) | (len(rows) - n < 20)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), name, float(cut[int(gain.argmax())]))
        if best[1]:
            low = x[best[1]][rows] <= best[2]
            todo += [((*tests, (best[1], True, best[2])), rows[low]), ((*tests, (best[1], False, best[2])), rows[~low])]
    return out, fitted


def extract_rules(x: dict[str, np.ndarray], y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = 3) -> list[Rule]:
    """Rules of a boosted ensemble, without those that hold for the same rows as an earlier one or its complement."""
    rng = np.random.default_rng(seed)
    edges = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for k, v in x.items()}
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[bytes, Rule] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        use = rng.random(len(y)) < 0.6
        tests, fitted = _paths(x, np.where(use, y - p, 0), np.where(use, p * (1 - p), 0), edges, depth)
        z += 0.2 * fitted
        for t in tests:
            rule = Rule(t)
            holds = rule.holds(x)
            found.setdefault(np.packbits(holds if holds[0] else ~holds).tobytes(), rule)
    return list(found.values())


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    w, b, v, c, t = np.zeros(k), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.zeros(k), 0.0, 1.0
    c = b
    u = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(12):  # the largest eigenvalue of the second moments bounds the curvature
        s = z @ u[:k].astype(z.dtype) + u[k]
        u = np.r_[z.T @ s.astype(z.dtype), s.sum()].astype(float)
        size = np.linalg.norm(u)
        u /= size
    step = 4 * n / (size * 1.05)
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(z @ v.astype(z.dtype) + c))) - y) / n
        w2 = v - step * (z.T @ r.astype(z.dtype))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * r.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, *, most: int = RULES, seed: int = 3) -> RuleModel:
    """The model of statistics ``x`` and labels ``y`` (0 or 1): the weakest penalty of a path that keeps at most ``most`` rules.

    Without labels the probability is 0.5; with one class alone it is nearly that class.
    """
    if not len(y):
        return RuleModel(0.0, ())
    y = y.astype(float)
    if y.min() == y.max():
        return RuleModel(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), ())
    rules = extract_rules(x, y, seed=seed)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float32)
    penalty = 2e-4
    while True:
        b, w = lasso(z, y, penalty)
        kept = np.flatnonzero(np.abs(w) > 1e-3)
        if len(kept) <= most:
            return RuleModel(b, tuple(Rule(rules[i].tests, float(w[i])) for i in kept))
        penalty *= 2


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> RuleModel:
    """Learn from at most ``rows`` rows of ``labels`` (id, label 0/1), drawn by a hash of the id, and the texts of these.

    Null ids and labels teach nothing; an id labelled twice counts twice, at most.
    """
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y")).where("__id is not null and __y is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("__id", F.lit(17)), "__id", "__y").limit(rows)  # at most ``rows`` rows, so it may be broadcast
    known = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__y", *[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    got = known.toPandas()
    return fit_rules({k: got[k].to_numpy(float) for k in STATISTICS}, got["__y"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) per row of ``docs``: probability of label 1, and 1 if it reaches the threshold.

    Empty and null texts are scored as texts of statistics 0.  Rows are independent; other columns are ignored.
    """
    stats = docs.select(F.col(id_col), *[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    scored = stats.select(F.col(id_col), model.column().alias("score"))
    return scored.select(F.col(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
