"""Quality rules: hashed n-gram logistic regression behind fixed counts (operator 2).

*Counts.* Words are ``[^\\x20\\x09-\\x0D]+``. Per whole text: words, code points in
words, symbols of ``#*$%&|<>``, lines with a word that equal an earlier line, and
words inside 8-word windows that occur twice or more. A text fails outright with
fewer than 20 words, or over 30 % of its words in repeated windows.

*Model.* Words, word pairs and 3- and 4-grams of characters (code points) are hashed into ``BUCKETS``
slots a kind; a text's score is the intercept plus, for each kind, the mean weight
of its n-grams. The weights are fitted by logistic regression on ``TRAIN_ROWS``
labelled rows at most; a fifth of those is kept apart to calibrate the scores to
probabilities (Platt). Tasks score Arrow batches; a text stays if its calibrated
probability of good quality is ``KEEP_AT`` or more.

Rows are independent: no shuffle but the join with the labels of the sample. The
broadcast weights have a fixed size. NULL and empty texts have no words and fail.
Repeated rows get equal results; further columns are ignored; an empty table
gives an empty result. Without labels of both kinds nothing but the outright rules
rejects a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import text_slices
from shoplens.llm.labelled import training_rows
from shoplens.llm.stats import Slice, doc_sums

BUCKETS = 1 << 16
KINDS = ("word", "pair", "tri", "four")
TRAIN_ROWS = 1_500
MIN_WORDS = 20
REPEAT_PERCENT = 30
KEEP_AT = 0.3
#: The same documents are held out as for the quality classifier, so that the accuracy can be measured.
FOLDS, HELD_OUT = 5, 0

_SHIFT = np.uint64(64 - 16)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _grams(sl: Slice) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each kind: the slot of every n-gram, and where each document's begin (n + 1 places)."""
    def slot(x: np.ndarray) -> np.ndarray:
        return ((x * _STEP) >> _SHIFT).astype(np.int32)

    w, first, off = sl.words, sl.first, sl.off
    yield "word", slot(w), first
    inner = np.ones(max(0, len(w) - 1), bool)
    cut = first[1:-1]
    inner[cut[(cut > 0) & (cut < len(w))] - 1] = False
    if len(w) > 1:
        pair = (w[:-1] * np.uint64(3) + (w[1:] ^ (w[1:] >> np.uint64(7))))[inner]
    else:
        pair = np.zeros(0, np.uint64)
    yield "pair", slot(pair), np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 0))])
    chars = np.frombuffer(sl.raw.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(sl.data & 0xC0 != 0x80)])[off]           # each document's first character
    for kind, k in (("tri", 3), ("four", 4)):
        n = max(0, len(chars) - k + 1)
        code = np.zeros(n, np.uint64)
        for i in range(k):
            code = code * _BASE + chars[i:i + n]
        ok = np.ones(n, bool)
        for i in range(1, k):
            at = ends[1:-1] - i
            at = at[(at >= 0) & (at < n)]
            ok[at] = False
        # A text shorter than k characters has no gram; the cuts above cover every place that would cross an end.
        yield kind, slot(code[ok] + np.uint64(k)), np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - k + 1, 0))])


def score(sl: Slice, weights: dict[str, np.ndarray], intercept: float) -> np.ndarray:
    z = np.full(len(sl.off) - 1, intercept)
    for kind, slots, first in _grams(sl):
        z += doc_sums(weights[kind][slots], first) / np.maximum(np.diff(first), 1)
    return z


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled text the slots it uses (kinds side by side) and their mean counts."""
    for rb, data, off in text_slices(batches):
        idx: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
        val: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
        for k, (_, slots, first) in enumerate(_grams(Slice(data, off))):
            for d in range(len(off) - 1):
                own, n = np.unique(slots[first[d]:first[d + 1]], return_counts=True)
                idx[d].append(own.astype("<i4") + k * BUCKETS)
                val[d].append((n / max(1, first[d + 1] - first[d])).astype("<f4"))
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("label"), pa.array([np.concatenate(x).tobytes() for x in idx], pa.binary()),
                                          pa.array([np.concatenate(x).tobytes() for x in val], pa.binary())], ["doc_id", "label", "idx", "val"])


def fit_logistic(rows: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, use: np.ndarray, steps: int = 100,
                 rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss of the sparse rows in ``use``, both classes weighted alike."""
    w, b, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    share = use * np.where(y > 0, 0.5 / max(1, (use & (y > 0)).sum()), 0.5 / max(1, (use & (y == 0)).sum()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, val * w[idx], len(y)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, gb = np.bincount(idx, val * r[rows], size) + decay * w / size, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= 0.1 * rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a z + b))) fits the labels, by damped Newton steps."""
    top, low = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (top + 1) / (top + 2), 1 / (low + 2))       # Platt's softened targets
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(h, x.T @ (p - t))
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> dict | None:
    """Weights per kind, intercept and calibration; None without labels of both kinds."""
    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, most)
    got = sorted(rows.mapInArrow(_features, "doc_id long, label int, idx binary, val binary").collect(), key=lambda r: (r.doc_id, r.label))
    y = np.array([r.label for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    n = np.array([len(r.idx) // 4 for r in got])
    row = np.repeat(np.arange(len(got), dtype=np.int32), n)
    idx = np.concatenate([np.frombuffer(r.idx, "<i4") for r in got])
    val = np.concatenate([np.frombuffer(r.val, "<f4") for r in got])
    # Rows held for the calibration get no weight in the fit.
    w, b = fit_logistic(row, idx, val, y, len(KINDS) * BUCKETS, ~held)
    z = np.bincount(row, val * w[idx], len(got)) + b
    fit = held if held.any() else ~held
    a, c = platt(z[fit], y[fit])
    return {"weights": {k: w[i * BUCKETS:(i + 1) * BUCKETS] for i, k in enumerate(KINDS)}, "intercept": b, "a": a, "c": c}


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb, data, off in text_slices(batches):
            sl = Slice(data, off)
            c = sl.counts()
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            p = np.ones(len(failed)) if m is None else 1 / (1 + np.exp(-np.clip(m["a"] * score(sl, m["weights"], m["intercept"]) + m["c"], -700, 700)))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *[pa.array(c[k]) for k in COLUMNS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))],
                                             ["doc_id", *COLUMNS, "base_failed", "probability", "kept"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, probability double, kept boolean")
