"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are numbered by falling frequency and cut into classes of about equal square-root
mass; ``p(symbol | h) = p(class | h) * p(symbol | class, h)``, so a prediction costs about two
small softmaxes. The input layer gives each symbol its own gate inputs. Texts are laid
end to end in lanes that run side by side; the state is carried from window to window and
cleared where a text begins. Training propagates gradients back through one window
(truncated), with Adagrad steps.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASSES = 24
WINDOW = 16
TRAIN_LANES, SCORE_LANES, SCORE_WINDOW = 256, 512, 32
#: Training cuts longer texts into parts of so many symbols; scoring never does.
PART = 512
RATE = 0.08
_F = np.float32


def new_model(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 12) -> dict[str, np.ndarray]:
    """Weights for symbols with these counts (falling); it starts as the unigram model."""
    rng = np.random.RandomState(seed)
    k = len(counts)
    mass = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.unique(np.minimum((mass - mass[0]) / mass[-1] * classes, classes - 1).astype(np.int64), return_index=True)[1]
    bounds = np.append(cut, k).astype(np.int64)
    weight = counts + 0.5
    total = np.add.reduceat(weight, bounds[:-1])
    rand = lambda *s: (rng.standard_normal(s) * 0.1).astype(_F)
    return {"x": rand(k, 3 * hidden), "u": rand(hidden, 3 * hidden), "c": rand(hidden, len(total)) * _F(0.1), "bc": np.log(total / total.sum()).astype(_F),
            "w": rand(k, hidden) * _F(0.1), "bw": np.log(weight).astype(_F), "bounds": bounds}


#: What training changes.
TRAINED = ("x", "u", "c", "bc", "w", "bw")


def lanes(lens: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(lane, first step of each text, lanes): longest texts first, each to the shortest lane; lanes by falling length."""
    n = max(1, min(wide, len(lens)))
    heap = [(0, i) for i in range(n)]
    lane, start = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    for t in np.argsort(-lens, kind="stable").tolist():
        used, i = heapq.heappop(heap)
        lane[t], start[t] = i, used
        heapq.heappush(heap, (used + int(lens[t]), i))
    rank = np.zeros(n, np.int64)
    rank[[i for _, i in sorted(heap, key=lambda x: (-x[0], x[1]))]] = np.arange(n)
    return rank[lane], start, n


def _gates(m: dict, d: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Input and recurrent weights of each gate (update, reset, new state), each in one block."""
    return tuple([np.ascontiguousarray(m[k][:, i:i + d]) for i in (0, d, 2 * d)] for k in ("x", "u"))


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= _F(0.5)
    np.tanh(a, out=a)
    a *= _F(0.5)
    a += _F(0.5)
    return a


def _steps(m: dict, before: np.ndarray, clear: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of a window; ``keep`` takes what the way back needs: arrays over all steps."""
    d = h.shape[1]
    out, old = np.empty((*before.shape, d), _F), np.empty((*before.shape, d), _F)
    inputs, (uz, ur, un) = _gates(m, d)
    z_all, r_all, n_all = (x.take(before, axis=0) for x in inputs)
    g_all = np.empty_like(n_all)
    any_clear = clear.any(axis=1)
    for t in range(len(before)):
        h0, z, r, n, g = old[t], z_all[t], r_all[t], n_all[t], g_all[t]
        h0[...] = h
        if any_clear[t]:
            h0[clear[t]] = 0
        z += h0 @ uz
        r += h0 @ ur
        np.matmul(h0, un, out=g)
        _sigmoid(z)
        n += _sigmoid(r) * g
        np.tanh(n, out=n)
        h = np.subtract(h0, n, out=out[t])
        h *= z
        h += n
    if keep is not None:
        keep += [old, z_all, r_all, n_all, g_all]
    return out, h


def _by_value(a: np.ndarray, values: int) -> np.ndarray:
    """A stable order of numbers below ``values`` (few enough ones are sorted by their digits)."""
    return np.argsort(a.astype(np.uint16) if values <= 1 << 16 else a, kind="stable")


def _softmax(a: np.ndarray, own: np.ndarray, shares: bool) -> np.ndarray:
    """log of the share of row ``own`` in each column; with ``shares``, ``a`` becomes all shares."""
    a -= a.max(axis=0)
    picked = a[own, np.arange(a.shape[1])]
    np.exp(a, out=a)
    total = a.sum(axis=0)
    if shares:
        a /= total
    return picked - np.log(total)


def _predict(m: dict, h: np.ndarray, symbol: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """log p(symbol | h) of each row; with ``grads`` also the gradient of the states (of minus the sum).

    Rows are taken by symbol, so those of a class lie together; softmaxes run down columns.
    """
    bounds, learn = m["bounds"], grads is not None
    order = _by_value(symbol, int(bounds[-1]))
    hs, sym = h.take(order, axis=0), symbol.take(order)
    cls = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).take(sym)
    a = m["c"].T @ hs.T
    a += m["bc"][:, None]
    lp = _softmax(a, cls, learn).astype(np.float64)
    back = None
    if learn:
        a[cls, np.arange(len(hs))] -= 1
        grads["c"], grads["bc"] = (a @ hs).T, a.sum(axis=1)
        grads["w"], grads["bw"] = np.zeros_like(m["w"]), np.zeros_like(m["bw"])
        back = a.T @ m["c"].T
    ends = np.searchsorted(sym, bounds)
    for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(bounds) > 1)).tolist():
        lo, hi = bounds[c], bounds[c + 1]
        at = slice(ends[c], ends[c + 1])
        hc, pick = hs[at], sym[at] - lo
        a = m["w"][lo:hi] @ hc.T
        a += m["bw"][lo:hi, None]
        lp[at] += _softmax(a, pick, learn)
        if learn:
            a[pick, np.arange(len(hc))] -= 1
            grads["w"][lo:hi], grads["bw"][lo:hi] = a @ hc, a.sum(axis=1)
            back[at] += a.T @ m["w"][lo:hi]
    out = np.empty(len(h))
    out[order] = lp
    if learn:
        sorted_back, back = back, np.empty_like(back)
        back[order] = sorted_back
    return out, back


class Laid:
    """Symbols of texts laid out in lanes, handed out a window of steps at a time."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, end: int, wide: int):
        lens = np.diff(first)
        lane, start, self.wide = lanes(lens, wide)
        at = np.repeat((start - first[:-1]).astype(np.int32), lens)
        at += np.arange(len(symbols), dtype=np.int32)
        self.col = np.repeat(lane.astype(np.int16), lens)
        self.height = int(at.max()) + 1 if len(at) else 0
        self.order = np.argsort(at, kind="stable").astype(np.int32)
        self.first_of = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=self.height))])
        self.step = at
        self.before = np.empty(len(symbols), np.int32)
        self.before[1:] = symbols[:-1]
        self.begins = np.zeros(len(symbols), bool)
        self.begins[first[:-1][lens > 0]] = True
        self.before[self.begins] = end                 # ``end`` opens a text

    def windows(self, size: int):
        """(places, whether there is one, the symbol before, whether a text begins): steps x live lanes.

        Lanes fall in length, so those that are still live come first.
        """
        for s in range(0, self.height, size):
            own = self.order[self.first_of[s]:self.first_of[min(s + size, self.height)]]
            live = int(self.first_of[s + 1] - self.first_of[s])
            place = np.zeros((min(size, self.height - s), live), np.int32)
            some = np.zeros(place.shape, bool)
            row, col = self.step[own] - s, self.col[own]
            place[row, col], some[row, col] = own, True
            yield place, some, np.where(some, self.before[place], 0), some & self.begins[place]


def score(m: dict, symbols: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of every symbol given all before it in its text; text i has symbols first[i]:first[i + 1]."""
    out = np.zeros(len(symbols))
    if not len(symbols):
        return out
    laid = Laid(symbols, first, end, SCORE_LANES)
    h = np.zeros((laid.wide, m["u"].shape[0]), _F)
    for place, some, before, clear in laid.windows(SCORE_WINDOW):
        states, h = _steps(m, before, clear, h[:place.shape[1]])
        own = place[some]
        out[own] = _predict(m, states[some], symbols[own])[0]
    return out


def train(m: dict, symbols: np.ndarray, first: np.ndarray, end: int, memory: dict | None = None, rate: float = RATE) -> dict:
    """Adagrad steps over all windows of the texts, in place; returns the sums of squares for the next call."""
    if memory is None:
        memory = {k: np.full_like(m[k], 0.02) for k in TRAINED}
    if not len(symbols):
        return memory
    first = np.concatenate([np.concatenate([np.arange(a, b, PART) for a, b in zip(first[:-1], first[1:])]), first[-1:]])
    laid = Laid(symbols, first, end, TRAIN_LANES)
    d = m["u"].shape[0]
    h = np.zeros((laid.wide, d), _F)
    for place, some, prev, clear in laid.windows(WINDOW):
        live = place.shape[1]
        kept: list = []
        states, h = _steps(m, prev, clear, h[:live], kept)
        grads: dict = {}
        _, back = _predict(m, states[some], symbols[place[some]], grads)
        dh_out = np.zeros_like(states)
        dh_out[some] = back
        h0, z, r, n, g = kept
        to_z, to_n, to_r = (h0 - n) * z * (1 - z), (1 - z) * (1 - n * n), g * r * (1 - r)
        _, (uz, ur, un) = _gates(m, d)
        dh = np.zeros((live, d), _F)
        for t in range(len(place) - 1, -1, -1):
            dh += dh_out[t]
            to_z[t] *= dh
            to_n[t] *= dh
            to_r[t] *= to_n[t]
            np.multiply(to_n[t], r[t], out=g[t])
            dh *= z[t]
            dh += to_z[t] @ uz.T
            dh += to_r[t] @ ur.T
            dh += g[t] @ un.T
            dh[clear[t]] = 0
        before = h0.reshape(-1, d).T
        grads["u"] = np.concatenate([before @ x.reshape(-1, d) for x in (to_z, to_r, g)], axis=1)
        size = _F(1.0 / max(1, int(some.sum())) ** 0.5)
        for k in ("u", "c", "bc", "w", "bw"):
            g = np.clip(grads[k] * size, -1, 1)
            memory[k] += g * g
            m[k] -= _F(rate) * g / np.sqrt(memory[k])
        ids = prev[some]
        order = _by_value(ids, len(m["x"]))
        ids, at = ids[order], np.flatnonzero(some)[order]
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        rows = ids[begin]
        dx = np.concatenate([x.reshape(-1, d).take(at, axis=0) for x in (to_z, to_r, to_n)], axis=1)
        g = np.clip(np.add.reduceat(dx, begin, axis=0) * size, -1, 1)
        memory["x"][rows] += g * g
        m["x"][rows] -= _F(rate) * g / np.sqrt(memory["x"][rows])
    return memory
