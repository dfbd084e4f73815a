"""Counts and statistics of whole texts, over bounded slices of documents."""

from __future__ import annotations

import numpy as np

from shoplens.llm.arrow import mix64, span_hashes, word_bounds

WINDOW = 8
_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(WINDOW)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of a document's flags are set; document i has flags off[i]:off[i + 1]."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values, added up within the document only."""
    out = np.zeros(len(first) - 1, np.float64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values[:first[-1]], first[some])
    return out


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen: set[bytes] = set()
    lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            seen.add(line)
    return lines, lines - len(seen)


def repeated_words(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document the words covered by windows of ``window`` words that occur at least twice in it.

    ``words`` are 64-bit word hashes. Windows meet by a combined hash; those that
    meet are compared word by word.
    """
    n = len(words)
    covered = np.zeros(n, bool)
    if n >= window:
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        key = np.zeros(n - window + 1, np.uint64)
        for k in range(window):
            key += words[k:n - window + 1 + k] * _FACTORS[k]
        at = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
        key = mix64(key[at]) ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        meet = np.flatnonzero(key[1:] == key[:-1])
        a, b = at[meet], at[meet + 1]
        same = doc[a] == doc[b]
        for k in range(window):
            same &= words[a + k] == words[b + k]
        if same.all():
            hits = np.concatenate([a, b])
        else:                                          # different windows met: group them by their words
            groups: dict[tuple, list[int]] = {}
            for i in set(np.concatenate([a, b]).tolist()):
                groups.setdefault((int(doc[i]), words[i:i + window].tobytes()), []).append(i)
            hits = np.array([i for g in groups.values() if len(g) > 1 for i in g], np.int64)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, hits, 1)
        np.minimum(mark, 1, out=mark)
        sums = np.cumsum(mark)
        covered = (sums[:n] - np.concatenate([np.zeros(window, np.int64), sums[:max(0, n - window)]])[:n]) > 0
    return per_doc(covered, first)


class Slice:
    """Word positions and hashes of one slice of documents, computed once."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.starts, self.ends, self.first = word_bounds(data, off)
        self.words = span_hashes(data, self.starts, self.ends)
        self.raw = data.tobytes()

    def counts(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per document."""
        b, off = self.data, self.off
        visible = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
        lines = np.array([duplicate_lines(self.raw[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())], np.int64).reshape(-1, 2)
        return {"n_words": np.diff(self.first), "word_chars": per_doc(visible & (b & 0xC0 != 0x80), off),
                "n_symbols": per_doc(_SYMBOL[b], off), "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1],
                "n_repeat_words": repeated_words(self.words, self.first)}

    def statistics(self) -> dict[str, np.ndarray]:
        """Shares and means that describe a text; 0 where a text has no word."""
        b, off, first = self.data, self.off, self.first
        c = self.counts()
        n_words = c["n_words"]
        chars = np.maximum(per_doc(b & 0xC0 != 0x80, off), 1)
        words = np.maximum(n_words, 1)
        doc = np.repeat(np.arange(len(first) - 1), n_words).astype(np.uint64)
        keys = np.sort(doc << np.uint64(44) | self.words >> np.uint64(20))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=len(n_words))
        again = np.zeros(len(self.words), bool)
        again[1:] = (self.words[1:] == self.words[:-1]) & (doc[1:] == doc[:-1])
        upper = (b >= 65) & (b <= 90)
        upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        last = b[self.ends - 1] if len(b) else np.zeros(0, np.uint8)
        head = b[self.starts] if len(b) else np.zeros(0, np.uint8)
        share = {"upper_share": per_doc(upper, off) / chars, "digit_share": per_doc((b >= 48) & (b <= 57), off) / chars,
                 "punct_share": per_doc(_PUNCT[b], off) / chars, "symbol_share": c["n_symbols"] / chars,
                 "exclaim_share": per_doc(b == 33, off) / chars, "bar_share": per_doc(b == 124, off) / chars,
                 "ascii_share": per_doc(b < 128, off) / np.maximum(np.diff(off), 1),
                 "mean_word_chars": c["word_chars"] / words, "distinct_share": distinct / words,
                 "again_share": per_doc(again, first) / words, "repeat_share": c["n_repeat_words"] / words,
                 "dup_line_share": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
                 "words_per_line": n_words / np.maximum(c["n_lines"], 1),
                 "punct_end_share": per_doc(_PUNCT[last], first) / words, "symbol_end_share": per_doc(_SYMBOL[last], first) / words,
                 "capital_share": per_doc((head >= 65) & (head <= 90), first) / words,
                 "log_words": np.log1p(n_words)}
        return {k: v.astype(np.float64) for k, v in share.items()}


STATISTICS = ("upper_share", "digit_share", "punct_share", "symbol_share", "exclaim_share", "bar_share", "ascii_share",
              "mean_word_chars", "distinct_share", "again_share", "repeat_share", "dup_line_share", "words_per_line",
              "punct_end_share", "symbol_end_share", "capital_share", "log_words")
