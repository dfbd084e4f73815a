"""A minimal acyclic transducer: words to numbers in a shared-suffix automaton.

States with the same right language are one state, so words share suffixes as
well as prefixes. Each arc carries an output; the outputs along a word's path
add up to the word's number in byte order, which indexes its id sequence. The
arcs lie in one open-addressing table of flat arrays, which tasks memory-map.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


def _minimal_states(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], int]:
    """Arcs and finality per state, and the root, of the minimal automaton of sorted distinct words."""
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[tuple[list, bool]] = [([], False)]      # open states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            out, fin = path.pop()
            key = (fin, tuple(out))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(fin)
            path[-1][0].append((last[len(path) - 1], state))

    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        path += [([], False) for _ in range(len(w) - k)]
        path[-1] = (path[-1][0], True)
        last = w
    close(0)
    arcs.append(path[0][0])
    final.append(path[0][1])
    return arcs, final, len(arcs) - 1


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Pack words and their id sequences; empty ``entries`` give a lexicon that holds nothing."""
    words = sorted(entries)
    arcs, final, root = _minimal_states(words)
    size = [0] * len(arcs)                             # words accepted from a state; children have smaller numbers
    for s, out in enumerate(arcs):
        size[s] = final[s] + sum(size[t] for _, t in out)
    n_arcs = sum(map(len, arcs))
    bits = max(4, (2 * n_arcs).bit_length())
    key = np.full(1 << bits, _EMPTY, np.int64)
    target = np.zeros(1 << bits, np.int32)
    output = np.zeros(1 << bits, np.int32)
    mask, shift = (1 << bits) - 1, 64 - bits
    for s, out in enumerate(arcs):
        before = int(final[s])
        for b, t in out:
            k = s * 256 + b
            at = ((k * int(_MIX)) & ((1 << 64) - 1)) >> shift
            while key[at] != _EMPTY:
                at = (at + 1) & mask
            key[at], target[at], output[at] = k, t, before
            before += size[t]
    ids = [entries[w] for w in words]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.uint32)
    parts = [key, target, output, np.array(final, np.uint8), offs, flat]
    head = np.array([bits, root, *map(len, parts)], np.int64)
    return head.tobytes() + b"".join(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in parts)


class Lexicon:
    """Vectorised look-up in a compiled lexicon, memory-mapped from an unlinked temporary file."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, np.int64, 8)
        self.shift, self.mask, self.root = np.uint64(64 - int(head[0])), (1 << int(head[0])) - 1, int(head[1])
        at, arrays = 64, []
        for n, kind in zip(head[2:], (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)):
            arrays.append(np.frombuffer(self._map, kind, int(n), at))
            at += -(-arrays[-1].nbytes // 8) * 8
        self.key, self.target, self.output, self.final, self.offs, self.ids = arrays

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word (a byte span of ``data``), -1 where it is not in the lexicon."""
        state = np.full(len(starts), self.root, np.int64)
        number = np.zeros(len(starts), np.int64)
        live = np.flatnonzero(ends > starts)
        at = starts.copy()
        while len(live):
            want = state[live] * 256 + data[at[live]]
            slot = ((want.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)
            open_ = np.flatnonzero((self.key[slot] != want) & (self.key[slot] != _EMPTY))
            while len(open_):
                slot[open_] = (slot[open_] + 1) & self.mask
                got = self.key[slot[open_]]
                open_ = open_[(got != want[open_]) & (got != _EMPTY)]
            hit = self.key[slot] == want
            number[live[hit]] += self.output[slot[hit]]
            state[live[hit]] = self.target[slot[hit]]
            state[live[~hit]] = -1
            at[live] += 1
            live = live[hit]
            live = live[at[live] < ends[live]]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, number, -1)
