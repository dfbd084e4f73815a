"""Language spans of mixed-language text: script ranges, word scores, Viterbi (operator 8).

*Words* are runs of ASCII letters and non-ASCII characters; ASCII letters and those of
Latin-1 are lower-cased. *Scripts*: a word's first character lies in one of
``SCRIPTS``; only languages that had at least 1 % of their words in that script are
candidates for it (all, if none had). *Scores*: a word's score for a language is the sum
of log probabilities of its byte trigrams, word ends included, in hashed tables of
fixed size, relative to the best candidate and at least ``-CLIP``. *Viterbi*: the path
of languages over a text's words with the greatest sum of scores, less ``SWITCH`` for
each change of language, labels every word; runs of one label are the spans. The
text's language is that of most words (the lesser name on a tie), and its score
the share of words so labelled.

The path is found in numpy for all texts of a slice at once: chunks of ``CHUNK``
words are reduced to transfer matrices, the matrices are chained per text, then
each chunk is traced back from its known ends. That is the exact best path.

Trained on ``TRAIN_ROWS`` rows at most with a language and an id outside the
held-out fold; the model (languages x slots) is broadcast, its size fixed by the
number of languages. Rows are independent, nothing is shuffled but the model's
counts. NULL texts and texts without a letter get ``und`` and score 0; so do all
if nothing was learned. Repeated rows get equal results, further columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.arrow import mix64, text_slices, word_bounds
from shoplens.llm.labelled import fold, sampled

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
SLOT_BITS = 16
SWITCH = 8.0
CLIP = 12.0
CHUNK = 64
UNDETERMINED = "und"

# FIXED VALUES: first code points of script ranges (public Unicode blocks) and the scripts that start there.
SCRIPTS = ((0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
           (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"))
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.int64)
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int64)

_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = [c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)]


class Words:
    """Words of a slice of texts: bounds, first words per text, scripts, trigram slots."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n, docs = len(data), len(off) - 1
        b = np.full(n + docs + 1, 32, np.uint8)        # a separator before, between and after the texts
        at = np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(off))
        b[at] = _MAP[data]
        upper = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[upper] += 0x20
        self.starts, self.ends, _ = word_bounds(b, np.array([0, len(b)]))
        places = off + np.arange(docs + 1)             # before each text's first byte
        self.first = np.searchsorted(self.starts, places)
        self.off, self.bytes = off, b
        inside = np.flatnonzero(b != 32)
        code = b[inside - 1].astype(np.uint64) << np.uint64(16) | b[inside].astype(np.uint64) << np.uint64(8) | b[inside + 1].astype(np.uint64)
        self.slots = (mix64(code) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        self.begin = np.searchsorted(inside, self.starts)
        self.scripts = _SCRIPT[np.searchsorted(_STARTS, self._first_chars(), "right") - 1]

    def _first_chars(self) -> np.ndarray:
        b = np.concatenate([self.bytes, np.zeros(4, np.uint8)]).astype(np.int64)
        s = self.starts
        c = b[s]
        two, three, four = ((b[s + k] & 0x3F) for k in (1, 2, 3))
        return np.where(c < 0x80, c, np.where(c < 0xE0, (c & 0x1F) << 6 | two, np.where(c < 0xF0, (c & 0x0F) << 12 | two << 6 | three,
                                                                                       (c & 0x07) << 18 | two << 12 | three << 6 | four)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, kind, slot, n); kind 0: trigrams, 1: words by script."""
    size = (1 << SLOT_BITS) + len(NAMES)
    counts: dict[str, np.ndarray] = {}
    for rb, data, off in text_slices(batches):
        langs = np.array(rb.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            w = Words(*_picked(data, off, rows))
            held = counts.setdefault(lang, np.zeros(size, np.int64))
            held[:1 << SLOT_BITS] += np.bincount(w.slots, minlength=1 << SLOT_BITS)
            held[1 << SLOT_BITS:] += np.bincount(w.scripts, minlength=len(NAMES))
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "slot", "n"])


def _picked(data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [data[off[r]:off[r + 1]] for r in rows]
    return np.concatenate(parts) if parts else data[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> dict | None:
    """Languages, log probabilities (slots x languages) and scripts; None if no row is labelled."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    rows = sampled(own, "doc_id", most, own.count()).select("text", "lang")
    got = rows.mapInArrow(_learn, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    if not langs:
        return None
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros(((1 << SLOT_BITS) + len(NAMES), len(langs)))
    for r in got:
        counts[r.slot, place[r.lang]] = r.n
    tri, scripts = counts[:1 << SLOT_BITS], counts[1 << SLOT_BITS:]
    logp = np.log((tri + 0.5) / (tri.sum(0) + 0.5 * len(tri)))
    seen = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    seen[~seen.any(1)] = True
    return {"langs": langs, "logp": logp.astype(np.float32), "seen": seen}


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Words x languages, relative to the best candidate; non-candidates get the least score."""
    s = np.zeros((len(w.starts), len(model["langs"])))
    if len(s):
        s = np.add.reduceat(model["logp"][w.slots], w.begin, axis=0).astype(np.float64)
    s = np.where(model["seen"][w.scripts], s, -np.inf)
    return np.maximum(s - s.max(axis=1, keepdims=True), -CLIP) if len(s) else s


def best_path(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """The label of each word on its text's best path; text i has words first[i]:first[i + 1]."""
    n_words, langs = np.diff(first), scores.shape[1]
    if langs == 1 or not len(scores):
        return np.zeros(len(scores), np.int64)
    pieces = -(-n_words // chunk)
    doc = np.repeat(np.arange(len(n_words)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = first[:-1][doc] + nth * chunk
    size = np.minimum(first[1:][doc] - lo, chunk)
    at = lo[:, None] + np.arange(chunk)
    used = np.arange(chunk) < size[:, None]
    padded = np.where(used[:, :, None], scores[np.minimum(at, len(scores) - 1)], 0.0)      # chunks x words x languages
    t = np.where(np.eye(langs, dtype=bool), 0.0, -np.inf)[None].repeat(len(doc), 0)        # chunks x entry x exit
    for k in range(chunk):
        step = np.maximum(t, t.max(axis=2, keepdims=True) - switch) + padded[:, k, None, :]
        t = np.where(used[:, k, None, None], step, t)
    # Chain the chunks of each text, all texts at once.
    entry = np.zeros(len(doc), np.int64)
    leave = np.zeros(len(doc), np.int64)
    value = np.zeros((len(n_words), langs))
    came = np.zeros((len(doc), langs), np.int64)
    start = np.cumsum(pieces) - pieces
    for k in range(int(pieces.max())):
        live = np.flatnonzero(pieces > k)
        c = start[live] + k
        total = value[live][:, :, None] + t[c]
        came[c] = total.argmax(axis=1)
        value[live] = total.max(axis=1)
    state = value.argmax(axis=1)
    for k in range(int(pieces.max()) - 1, -1, -1):
        live = np.flatnonzero(pieces > k)
        c = start[live] + k
        leave[c] = state[live]
        entry[c] = state[live] = came[c, state[live]]
    # Trace each chunk between its known ends.
    v = np.full((len(doc), langs), -np.inf)
    rows = np.arange(len(doc))
    v[rows, entry] = 0.0
    back = np.zeros((chunk, len(doc), langs), np.uint8 if langs < 256 else np.int64)
    for k in range(chunk):
        top = v.argmax(axis=1)
        jump = v[rows, top][:, None] - switch
        stay = v >= jump
        back[k] = np.where(stay, np.arange(langs), top[:, None])
        v = np.where(used[:, k, None], np.where(stay, v, jump) + padded[:, k], v)
    out = np.zeros((len(doc), chunk), np.int64)
    state = leave.copy()
    for k in range(chunk - 1, -1, -1):
        out[:, k] = state
        state = np.where(used[:, k], back[k, rows, state], state)
    return out[used]


def _spans(w: Words, labels: np.ndarray, langs: list[str], data: np.ndarray) -> list[list[dict]]:
    """Per text the runs of one label, in code points of the text."""
    chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    out = []
    for d in range(len(w.first) - 1):
        a, b = w.first[d], w.first[d + 1]
        cut = np.concatenate([[a], a + 1 + np.flatnonzero(labels[a + 1:b] != labels[a:b - 1]), [b]]) if b > a else np.array([a])
        base = chars[w.off[d]]
        out.append([{"start": int(chars[w.starts[i] - d - 1] - base), "end": int(chars[w.ends[j - 1] - d - 1] - base), "lang": langs[labels[i]]}
                    for i, j in zip(cut, cut[1:])])
    return out


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False,
             switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if asked for, the labelled spans of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb, data, off in text_slices(batches):
            lettered = pc.match_substring_regex(rb.column("text").fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            pred = np.full(len(off) - 1, UNDETERMINED, object)
            score = np.zeros(len(off) - 1)
            parts: list[list[dict]] = [[] for _ in pred]
            if m is not None:
                w = Words(data, off)
                labels = best_path(word_scores(w, m), w.first, switch)
                doc = np.repeat(np.arange(len(pred)), np.diff(w.first))
                votes = np.bincount(doc * len(m["langs"]) + labels, minlength=len(pred) * len(m["langs"])).reshape(len(pred), -1)
                top = votes.argmax(axis=1)
                pred = np.where(lettered, np.array(m["langs"], object)[top], pred)
                score = np.where(lettered, votes[np.arange(len(pred)), top] / np.maximum(votes.sum(axis=1), 1), 0.0)
                if spans:
                    parts = [p if ok else [] for p, ok in zip(_spans(w, labels, m["langs"], data), lettered)]
            cols = [rb.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)] + ([pa.array(parts, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans"][:len(cols)])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans)
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), *out.columns[1:])
