"""Quality classifier: a sparse rule ensemble compiled into Spark columns (operator 10).

1. *Statistics.* Tasks compute ``STATISTICS`` (shares and means over the whole
   text) for each document; nothing else about it enters a score.
2. *Rules.* On ``TRAIN_ROWS`` labelled rows at most, gradient boosting grows small
   trees over the statistics. Every path from a root to a node is a conjunctive
   rule ("upper_share > 0.21 AND again_share <= 0.02").
3. *Weights.* A logistic regression with an L1 penalty (accelerated proximal
   gradient) keeps the rules that matter, as a rule for each side of its split.
4. *Compilation.* Each kept rule becomes a boolean column expression over the
   statistics; the score is the logistic function of the weighted sum, evaluated
   by Spark in generated code, without a further pass through Python.

Rows are independent; the only shuffle is the join of the sample with its texts.
NULL and empty texts have statistics zero and get a score like any other. Repeated
rows get equal results, further columns are ignored, an empty table gives an empty
result. Without labels of both kinds every score is the share of label 1 (1.0 if
there is no label at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.arrow import text_slices
from shoplens.llm.labelled import fold, training_rows
from shoplens.llm.stats import STATISTICS, Slice
from shoplens.llm.store import unwrapped, wrapped

TRAIN_ROWS = 12_000
FOLDS, HELD_OUT = 5, 0
PREDICT_AT = 0.3
TREES, DEPTH, BINS, LEAF = 30, 3, 64, 20
PENALTY = 2e-3

Rule = tuple[tuple[int, bool, float], ...]             # (statistic, above, threshold), all of which must hold


def with_statistics(docs: DataFrame, text_col: str = "text", within: str | None = None) -> DataFrame:
    """``docs``, all columns, and a struct ``__s`` of the statistics of each text; ``within`` names a struct column that holds the text."""
    kind = pa.struct([(c, pa.float64()) for c in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, data, off in text_slices(batches, text=text_col, within=within):
            got = Slice(data, off).statistics()
            s = pa.StructArray.from_arrays([pa.array(got[c]) for c in STATISTICS], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*rb.columns, s], [*rb.schema.names, "__s"])

    struct = T.StructType([T.StructField(c, T.DoubleType()) for c in STATISTICS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__s", struct)]))


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct node paths of boosted trees on the logistic loss, in order of growth."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T)]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    z, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        stack: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        while stack:
            rows, path = stack.pop()
            best = None
            if len(path) < DEPTH and len(rows) >= 2 * LEAF:
                all_g, all_h = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = bins[rows, f]
                    n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    lg, lh = (np.cumsum(np.bincount(b, w[rows], len(c) + 1))[:-1] for w in (g, h))
                    gain = lg ** 2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g ** 2 / (all_h + 1)
                    gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k)
            if best is None:
                z[rows] += 0.3 * g[rows].sum() / (h[rows].sum() + 1)
                continue
            _, f, k = best
            low = bins[rows, f] <= k                   # the cut lies midway between the values that it parts
            t = float(x[rows[low], f].max() + x[rows[~low], f].min()) / 2
            for above in (False, True):
                child = (*path, (f, above, t))
                rules.setdefault(tuple(sorted(child)), child)
                stack.append((rows[(bins[rows, f] > k) == above], child))
    return list(rules.values())


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in rule])


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Sparse logistic weights by accelerated proximal gradient steps."""
    n, k = r.shape
    a = np.concatenate([r, np.ones((n, 1))], 1)
    v = np.ones(k + 1)
    for _ in range(20):                                # the largest curvature, by power iteration
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / (v @ (a.T @ (a @ v)) * 1.05)
    w = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ u, -30, 30))) - y) / n
        new = u - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Kept rules with their weights, and the intercept."""
    if not len(y):
        return [], 30.0
    if y.min() == y.max():
        return [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules = grow_rules(x, y)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    w, b = fit_lasso(np.stack([fires(r, x) for r in rules], 1).astype(np.float64), y)
    return [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4], b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, most)
    got = sorted(with_statistics(rows).select("doc_id", "label", "__s.*").collect())
    x = np.array([r[2:] for r in got], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.label for r in got], np.float64))


def compile_rules(rules: list[tuple[Rule, float]], intercept: float, of: str = "__s") -> Column:
    """The score as one column expression over the struct of statistics."""
    def holds(rule: Rule) -> Column:
        return reduce(Column.__and__, [(c > t) if above else (c <= t) for f, above, t in rule for c in (F.col(f"{of}.{STATISTICS[f]}"),)])

    total = reduce(Column.__add__, [F.when(holds(r), w).otherwise(0.0) for r, w in rules], F.lit(float(intercept)))
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], text_col: str = "text", within: str | None = None) -> DataFrame:
    """``docs``, all columns, and ``__score``."""
    return with_statistics(docs, text_col, within).withColumn("__score", compile_rules(*model)).drop("__s")


def keep(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], text_col: str = "text", predict_at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names, with a score of ``predict_at`` or more."""
    return unwrapped(scored(wrapped(docs), model, text_col, "row").where(F.col("__score") >= predict_at), docs.columns)


def classify(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], id_col: str = "doc_id", text_col: str = "text",
             predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(own, model).select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                                     F.col("__score").alias("score"), (F.col("__score") >= predict_at).cast("int").alias("predicted"))
