"""Simple-8b: varying counts of integers in 64-bit words, for numpy.

The top four bits of a word select how many values its other 60 bits hold and
how wide each is; the first of a word's values lies lowest. A value of more
than 30 bits is an escape: it has a word of its own (selector 15, 60 bits).
Encoding is greedy: each word takes as many of the next values as fit.
"""

from __future__ import annotations

import numpy as np

# FIXED VALUES: values per word and bits per value, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_LIMITS = np.uint64(1) << WIDTHS[1:15].astype(np.uint64)      # a value below _LIMITS[i] fits the i-th width
_LEVELS = np.arange(-1, 15)
_PART = 1 << 17


def _choose(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where words begin, and their selectors."""
    n = len(values)
    pick = np.full(n, 15, np.uint8)
    todo = np.ones(n, bool)
    level = np.searchsorted(_LIMITS, values, "right").astype(np.uint8)      # the first width that holds a value
    lowest = int(level.min())
    wide = np.zeros(n + 1, np.int32)
    for s in range(1, 15):
        if _LEVELS[s] < lowest:
            continue
        np.cumsum(level > _LEVELS[s], out=wide[1:])
        for t in ((0, 1) if s == 1 else (s,)):
            k = int(COUNTS[t])
            if n >= k:
                fits = wide[k:] == wide[:n + 1 - k]
                fits &= todo[:n + 1 - k]
                pick[:n + 1 - k][fits] = t
                todo[:n + 1 - k][fits] = False
    ahead = (np.arange(n) + COUNTS[pick]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = ahead[i]
    at = np.array(starts, np.int64)
    return at, pick[at].astype(np.int64)


def encode(values: np.ndarray) -> np.ndarray:
    """Words (uint64) of the values (unsigned, below 2**60)."""
    out = []
    values = values.astype(np.uint64)
    if len(values) and int(values.max()) >> 60:
        raise ValueError("a value does not fit into 60 bits")
    for lo in range(0, len(values), _PART):
        part = values[lo:lo + _PART]
        at, pick = _choose(part)
        words = pick.astype(np.uint64) << np.uint64(60)
        for s in range(2, 16):
            mine = np.flatnonzero(pick == s)
            if len(mine):
                k, w = int(COUNTS[s]), int(WIDTHS[s])
                vals = part[at[mine][:, None] + np.arange(k)]
                words[mine] |= np.bitwise_or.reduce(vals << (np.arange(k, dtype=np.uint64) * np.uint64(w)), axis=1)
        out.append(words)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """The values (uint64) of the words; each selector's words are unpacked at once."""
    pick = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[pick])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(pick == s)
        if len(mine):
            k, w = int(COUNTS[s]), int(WIDTHS[s])
            vals = (words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
            out[(ends[mine] - k)[:, None] + np.arange(k)] = vals
    return out
