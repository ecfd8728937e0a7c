"""A quality classifier as a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark columns. On a bounded sample of labelled
documents, shallow boosted trees are grown; every path from a root is a rule, a
conjunction of comparisons. A logistic regression with an L1 penalty over all rules
keeps a few. They are compiled to one Spark column, so scoring is a projection: no
shuffle, no Python on executors, no model file.

Labels are learned only from rows outside the held-out part (crc32 of the id as text,
modulo 5, is 0), at most ``MOST_ROWS`` of them, chosen by a hash of the id. Labels,
language, source and ids are never statistics.

Null text scores like empty text; documents without an id are held out; repeated
labels of a document are averaged; without labels of both kinds every score is the
smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.text import SPACE, bind, words

#: The bound of the training sample.
MOST_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, CUTS, RATE = 40, 3, 10, 24, 0.3
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)


def statistics(text: Column) -> Column:
    """A struct of double statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")

    def of(w: Column) -> Column:
        n = F.size(w).cast("double")
        per_word = lambda x: x / F.greatest(n, F.lit(1.0))
        per_char = lambda x: x / F.greatest(F.length(text), F.lit(1)).cast("double")
        lines = F.filter(F.split(text, "\n"), lambda x: x != "")
        return F.struct(
            F.ln(1 + n).alias("log_words"),
            per_word(F.length(F.array_join(w, "")).cast("double")).alias("word_length"),
            per_word(F.size(F.array_distinct(w)).cast("double")).alias("distinct_words"),
            per_char(count(r"\p{Lu}")).alias("upper"),
            per_char(count(r"\p{Ll}")).alias("lower"),
            per_char(count(r"0-9")).alias("digits"),
            per_char(count(r"#*$%&|<>")).alias("symbols"),
            per_char(count(r"!?")).alias("shouts"),
            per_char(count(r"|")).alias("bars"),
            per_word(count(r".")).alias("stops"),
            per_word(count(r"\n")).alias("breaks"),
            F.coalesce(1 - F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0)).alias("repeated_lines"),
        )

    return bind(words(text), of)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, is_above, cut)``, with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.terms:
            out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for k, above, cut in self.terms:
            out &= (F.col(names[k]) > F.lit(cut)) if above else (F.col(names[k]) <= F.lit(cut))
        return out


@dataclass(frozen=True)
class Ensemble:
    names: list[str]
    rules: tuple[Rule, ...]
    bias: float

    def score(self) -> Column:
        """The score over columns named like the statistics."""
        z = F.lit(self.bias)
        for rule in self.rules:
            z += F.when(rule.column(self.names), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, terms: tuple, out: list, fit: np.ndarray) -> None:
    """Split rows by the cut that lowers the squared residual most; collect each path as a rule."""
    if terms:
        out.append(Rule(terms))
    best = None
    if len(terms) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        total = residual[rows].sum()
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            n = np.bincount(binned[rows, k], minlength=len(edges) + 1).cumsum()[:-1]
            s = np.bincount(binned[rows, k], weights=residual[rows], minlength=len(edges) + 1).cumsum()[:-1]
            fits = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
            gain = np.where(fits, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -1)
            at = int(gain.argmax())
            if gain[at] > total**2 / len(rows) + 1e-9 and (best is None or gain[at] > best[0]):
                best = (gain[at], k, at)
    if best is None:
        fit[rows] = residual[rows].mean() if len(rows) else 0.0
        return
    _, k, at = best
    below = binned[rows, k] <= at
    cut = float(cuts[k][at])
    _grow(x, binned, cuts, residual, rows[below], (*terms, (k, False, cut)), out, fit)
    _grow(x, binned, cuts, residual, rows[~below], (*terms, (k, True, cut)), out, fit)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each rule once."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-z))
        fit = np.zeros(len(y))
        _grow(x, binned, cuts, residual, np.sort(rng.permutation(len(y))[: max(2 * LEAST_LEAF, len(y) * 3 // 4)]), (), rules, fit)
        z += RATE * 4 * fit
    return list(dict.fromkeys(rules))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, bias: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights by accelerated proximal gradient steps, from a warm start; the bias isn't penalised."""
    lipschitz = 0.25 * (np.linalg.norm(np.c_[r, np.ones(len(r))], 2) ** 2) / len(r)
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(r @ v + vb))) - y
        step = v - (r.T @ error) / len(y) / lipschitz
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / lipschitz, 0)
        new_bias = vb - error.mean() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, bias


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Rules and weights from a sample; the penalty is the one that does best on a fifth of it, set aside."""
    prior = (y.sum() + 1) / (len(y) + 2)
    constant = Ensemble(names, (), float(np.log(prior / (1 - prior))))
    aside = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[~aside])) < 2:
        return constant
    rules = extract_rules(x[~aside], y[~aside])
    if not rules:
        return constant
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float)
    best, w, bias = (np.inf, PENALTIES[0]), np.zeros(len(rules)), constant.bias
    for penalty in PENALTIES:
        w, bias = lasso_logistic(r[~aside], y[~aside], penalty, w, bias)
        p = np.clip(1 / (1 + np.exp(-(r[aside] @ w + bias))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p))
        best = min(best, (loss, penalty))
    w, bias = np.zeros(len(rules)), constant.bias
    for penalty in [p for p in PENALTIES if p >= best[1]]:
        w, bias = lasso_logistic(r, y, penalty, w, bias)
    kept = [Rule(rule.terms, float(weight)) for rule, weight in zip(rules, w) if abs(weight) > 1e-6]
    return Ensemble(names, tuple(kept), float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """Fit on at most ``MOST_ROWS`` labelled documents; only that sample reaches the driver.

    Of several texts with one id the one with the least hash is learned from, so reruns agree.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
    # The sample has MOST_ROWS ids at most, so it may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("hash"), "y", statistics(F.col("text")).alias("s")).alias("row"))
    rows = sample.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.y", "row.s.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    names = list(rows.columns[2:])
    return fit_rules(rows[names].to_numpy(float), (rows["y"].to_numpy(float) >= 0.5).astype(float), names)


def scored(docs: DataFrame, model: Ensemble, score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), statistics(F.col("text")).alias("__s"))
    inner = inner.select("__row", "__s.*").withColumn("__score", model.score())
    return inner.select("__row.*", F.col("__score").alias(score))
