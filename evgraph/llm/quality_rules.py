"""Quality classifier: a sparse rule ensemble.

1. Statistics of each whole text are Spark columns (shares of capitals, symbols, repeated words, ...).
2. Boosted shallow trees are grown on a bounded sample of labelled rows (`sample_rows`, chosen by hash); the path to each of their
   nodes is a conjunctive rule.
3. A lasso logistic regression (proximal gradient) over the rules keeps few of them with a weight.
4. The kept rules are compiled into one Spark column expression, so scoring is one projection that measures each text once.

Only the sample is measured for the fit, and only it reaches the driver. labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null or empty text has all statistics zero and is scored like any other; labels of null count for nothing, several labels of a
document as the larger; without two classes in the sample the score is the smoothed share of label 1; every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, let
from evgraph.session import stored

SAMPLE_ROWS, TREES, DEPTH, BINS, LEAF, RATE, LASSO = 20_000, 24, 3, 32, 20, 0.3, 0.002
FOLDS, HELD_OUT = 3, 1


def statistics(text: Column) -> Column:
    """The classifier's inputs, one struct of doubles, of a text column."""
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    sizes = lambda t: F.struct(t.alias("t"), F.char_length(t).alias("chars"), count(t, r"[^\x20\x09-\x0D]+").alias("words"))

    def measured(v: Column) -> Column:
        t, chars, words = v["t"], v["chars"], v["words"]
        per_char = lambda n: F.when(chars > 0, n / chars).otherwise(F.lit(0.0))
        per_word = lambda n: F.when(words > 0, n / words).otherwise(F.lit(0.0))
        found = {
            "words": words,
            "word_chars": per_word(chars),
            "line_words": words / F.size(F.split(t, "\n")),
            "capitals": per_char(count(t, r"\p{Lu}")),
            "symbols": per_char(count(t, r"[#*$%&|<>]")),
            "marks": per_char(count(t, r"[!?]")),
            "digits": per_char(count(t, r"[0-9]")),
            "stops": per_word(count(t, r"[.:;]")),
            "distinct": per_word(F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+")))),
            "echoes": per_word(count(t, r"(?<![^ \n])([^ \n]++) \1(?![^ \n])")),
            "short_words": per_word(count(t, r"(?<![^ \n])[^ \n]{1,2}(?![^ \n])")),
        }
        return F.struct(*[x.cast("double").alias(f"q_{name}") for name, x in found.items()])

    return let(let(F.coalesce(text, F.lit("")), sizes), measured)


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold))); a rule is ((statistic, above, threshold), ...)."""

    bias: float
    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]

    def column(self, values: Column) -> Column:
        """The score of a struct of statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            holds = reduce(lambda a, b: a & b, [values[n] > t if above else values[n] <= t for n, above, t in rule])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, leaf: int) -> tuple[list, np.ndarray]:
    """(paths of all nodes as ((column, above, bin), ...), the step of every row)."""
    paths, step = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple) -> None:
        g, h = grad[rows], hess[rows]
        step[rows] = -g.sum() / (h.sum() + 1.0)
        if len(path) == depth or len(rows) < 2 * leaf:
            return
        best = (1e-6, -1, -1)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for c in range(binned.shape[1]):
            b = binned[rows, c]
            n, gs, hs = (np.cumsum(np.bincount(b, w, BINS + 1)) for w in (None, g, h))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(n < leaf) | (len(rows) - n < leaf)] = -1.0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), c, k)
        if best[1] < 0:
            return
        _, c, k = best
        for above in (False, True):
            side = (c, above, k)
            paths.append((*path, side))
            grow(rows[(binned[rows, c] > k) == above], (*path, side))

    grow(np.arange(len(grad)), ())
    return paths, step


def _lasso(active: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias isn't penalised."""
    n, m = active.shape
    a = np.hstack([np.ones((n, 1), np.float32), active.astype(np.float32)])
    v = np.ones(m + 1, np.float32)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4.0 * n / float(np.linalg.norm(a @ v) ** 2)
    w = look = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(a @ look.astype(np.float32))))
        new = look - rate * (a.T @ (p - y)).astype(float) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = new + (before - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO) -> RuleModel:
    """Trees -> rules -> lasso weights, from a bounded sample."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 4 * LEAF or y.min() == y.max():
        return RuleModel(bias, (), ())
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cut, x[:, c], side="left") for c, cut in enumerate(cuts)], axis=1)
    score, found = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        paths, step = _tree(binned, p - y, p * (1 - p), depth, LEAF)
        score += RATE * step
        for path in paths:
            tight: dict[tuple[int, bool], int] = {}
            for c, above, k in path:
                tight[c, above] = (max if above else min)(tight.get((c, above), k), k)
            found.setdefault(tuple(sorted((c, above, k) for (c, above), k in tight.items())))
    holds = {rule: np.logical_and.reduce([(binned[:, c] > k) == above for c, above, k in rule]) for rule in found}
    unlike: dict[bytes, tuple] = {}
    for rule, on in holds.items():  # of rules that hold for the same rows, the first
        unlike.setdefault(np.packbits(on).tobytes(), rule)
    rules = list(unlike.values())
    if not rules:
        return RuleModel(bias, (), ())
    bias, weights = _lasso(np.stack([holds[r] for r in rules], axis=1), y, penalty)
    kept = [k for k in np.argsort(-np.abs(weights)) if abs(weights[k]) > 1e-4]
    named = tuple(tuple((names[c], above, float(cuts[c][k])) for c, above, k in rules[k_]) for k_ in kept)
    return RuleModel(bias, named, tuple(float(weights[k]) for k in kept))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS


def train(
    docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    measure: Callable[[Column], Column] = statistics,
) -> RuleModel:
    """A model from docs and the labels outside the held-out fold; only the texts of a sample of labelled ids are measured."""
    known = labels.select(column(id_col).alias("label_id"), column(target).cast("double").alias("y")).where("y is not null AND label_id is not null")
    known = known.where(fold(F.col("label_id")) != HELD_OUT).groupBy("label_id").agg(F.max("y").alias("y"))
    share = sample_rows / max(1, known.count())
    if share < 0.5:  # thin out by hash before the exact cut, so that no task sends sample_rows rows of its own
        known = known.where(F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(1_000_000)) < int(1_500_000 * share) + 1)
    known = stored(known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows), "quality-labels")
    texts = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    both = texts.join(F.broadcast(known), texts["doc_id"] == known["label_id"])  # sample_rows rows at most
    both = stored(both.select("doc_id", measure(F.col("text")).alias("q"), "y"), "quality-labelled")
    rows = both.orderBy(F.xxhash64("doc_id"), "q").limit(sample_rows).select("q.*", "y").toPandas()  # repeated rows of an id count to sample_rows too
    names = [c for c in rows.columns if c != "y"]
    return fit(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(column(id_col).alias("doc_id"), let(statistics(column(text_col)), model.column).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with their own columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(let(statistics(column(text_col)), model.column) >= least)
