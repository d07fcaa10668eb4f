"""A small gated recurrent language model in numpy, trained by truncated backpropagation.

The output is factored: a softmax over classes of words of near frequency, then one over the words of the class. Classes of
frequent words are small and those of rare ones large, so most words cost little however large the vocabulary. Everything
outside the vocabulary is one class. Streams of documents run in parallel lanes; the state is carried from window to window
and reset where a document starts, so the log-likelihood of a document uses all of it.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Classes of one size and the size of the first ones: frequent words sit in small classes.
STEP, FIRST = 8, 16
EMBED, HIDDEN = 12, 24
F32 = np.float32
#: Largest logit, and the least sum of exponentials that a logarithm is taken of.
MOST, TINY = F32(60), F32(1e-37)


class Lanes:
    """Documents side by side in lanes, one behind the other in a lane; memory is in proportion to the tokens."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int):
        """Deal documents (target ids, end included) to lanes, longest first to the shortest lane; longer lanes come first."""
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (n + len(docs[d]), k))
        size = [sum(len(docs[d]) for d in h) for h in held]
        rank = sorted(range(lanes), key=lambda k: -size[k])
        self.order = [d for k in rank for d in held[k]]
        self.length = np.array([size[k] for k in rank])
        self.base = np.cumsum(self.length) - self.length
        self.target = np.concatenate([docs[d] for d in self.order])
        sizes = np.array([len(docs[d]) for d in self.order])
        self.first = np.cumsum(sizes) - sizes
        self.start = np.zeros(len(self.target), bool)
        self.start[self.first] = True
        self.steps, self.end = int(self.length[0]), end

    def live(self, lo: int) -> int:
        """Lanes that reach beyond step lo."""
        return int((self.length > lo).sum())

    def window(self, lo: int, size: int):
        """Targets, starts, places in the flat target and whether they are inside the lane, each [steps, lanes that go on]."""
        live = self.live(lo)
        step = np.arange(lo, min(lo + size, self.steps))[:, None]
        inside = step < self.length[None, :live]
        at = np.where(inside, self.base[None, :live] + step, 0)
        return np.where(inside, self.target[at], np.int32(self.end)), self.start[at] & inside, at, inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _rows(x: np.ndarray) -> np.ndarray:
    """[T, H, B] -> [T B, H]."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def _rows_and_one(x: np.ndarray) -> np.ndarray:
    """[T, H, B] -> [T B, H + 1], the last column 1: a matrix whose last row is a bias adds it within the product."""
    out = np.empty((x.shape[0], x.shape[2], x.shape[1] + 1), F32)
    out[..., :-1] = x.transpose(0, 2, 1)
    out[..., -1] = 1
    return out.reshape(-1, x.shape[1] + 1)


class Softmax:
    """Weights [H + 1, K], the last row the bias. Units are at most 1 in size, so the weights bound the logits; where that bound
    is above MOST, logits are cut there, which keeps the sum of their exponentials finite without a search for the largest."""

    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.cut = bool(len(weights[0])) and float((np.abs(weights[:-1]).sum(axis=0) + weights[-1]).max()) > MOST
        self.ones = np.ones(weights.shape[1], F32)

    def of(self, states, lo=0, hi=None):
        """Logits of columns lo to hi, as a new array."""
        return states @ self.w[:, lo:hi]

    def exp(self, x):
        """Exponentials, in place, and their sums by row."""
        if self.cut:
            np.minimum(x, MOST, out=x)
        np.exp(x, out=x)
        return np.maximum(x @ self.ones[: x.shape[1]], TINY)


def _pieces(docs: list[np.ndarray], most: int) -> list[np.ndarray]:
    """All tokens of the documents in pieces of at most `most`."""
    return [d[a : a + most] for d in docs for a in range(0, len(d), most)]


def class_edges(n: int) -> np.ndarray:
    """Bounds of the classes of n words: STEP classes of FIRST words, then STEP of twice as many, and so on."""
    edges, size = [0], FIRST
    while edges[-1] < n:
        for _ in range(STEP):
            if edges[-1] < n:
                edges.append(min(n, edges[-1] + size))
        size *= 2
    return np.array(edges)


class GRU:
    """Words are 0 .. n - 1, n is the unknown word; end is the id of the end token."""

    def __init__(self, freq: np.ndarray, unknown: float, end: int):
        """freq: counts of the n words, most frequent first; unknown: count of all others."""
        self.n, self.end = len(freq), end
        self.edges = class_edges(self.n)
        self.classes = len(self.edges) - 1
        self.class_of = np.append(np.repeat(np.arange(self.classes), np.diff(self.edges)), self.classes).astype(np.int16)
        rng = np.random.default_rng(5)
        freq = np.maximum(freq, 0.1)
        mass = np.append(np.add.reduceat(freq, self.edges[:-1]), max(unknown, 0.1))
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(F32)
        self.p = {
            "emb": small(self.n + 1, EMBED), "wx": small(EMBED, 3 * HIDDEN) * 3, "b": np.zeros(3 * HIDDEN, F32), "u": small(HIDDEN, 3 * HIDDEN),
            "wc": small(HIDDEN, self.classes + 1) * 0.1, "bc": np.log(mass / mass.sum()).astype(F32),
            "ww": small(self.n, HIDDEN) * 0.1, "bw": np.log(freq / mass[self.class_of[:-1]]).astype(F32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.array(flat[at : at + v.size], F32).reshape(v.shape)
            at += v.size

    def _run(self, given, start, h, keep=False):
        """States [T, H, B] after the given words [T, B] from h [H, B], the last state, and with keep what backpropagation needs.

        Units come before lanes, so that the parts of a gate are whole blocks of memory.
        """
        p, H = self.p, HIDDEN
        x = np.ascontiguousarray((p["emb"] @ p["wx"] + p["b"]).take(given, axis=0).transpose(0, 2, 1))
        u = np.ascontiguousarray(p["u"].T)
        out = np.empty((len(given), H, given.shape[1]), F32)
        before, inner = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
        fresh = start.any(axis=1)
        for t in range(len(given)):
            if fresh[t]:
                h = np.where(start[t], F32(0), h)
            g = u @ h
            gates, c = x[t, : 2 * H], x[t, 2 * H :]
            gates += g[: 2 * H]
            _sigmoid(gates)
            if keep:
                before[t], inner[t] = h, g[2 * H :]
            g[2 * H :] *= gates[H:]
            c += g[2 * H :]
            np.tanh(c, out=c)
            new = np.subtract(h, c, out=out[t])
            new *= gates[:H]
            new += c
            h = new
        return out, h, (before, x, inner)

    def _softmaxes(self) -> tuple[Softmax, Softmax]:
        p = self.p
        return Softmax(np.vstack([p["wc"], p["bc"]])), Softmax(np.vstack([p["ww"].T, p["bw"]]))

    def _sorted(self, target):
        """The class of each target, the order of the rows by class, and where each class begins and ends in it."""
        kind = self.class_of[target]
        order = np.argsort(kind, kind="stable")
        kind = kind.take(order)
        edge = np.searchsorted(kind, np.arange(self.classes + 1))
        return kind, order, [(k, edge[k], edge[k + 1]) for k in range(self.classes) if edge[k + 1] > edge[k]]

    def logp(self, states, target) -> np.ndarray:
        """Natural log probability of the targets [N] after the states and a one [N, H + 1]; the unknown word as one."""
        kind, order, parts = self._sorted(target)
        states, target = states.take(order, axis=0), target.take(order)
        kinds, words = self._softmaxes()
        logit = kinds.of(states)
        got = logit[np.arange(len(target)), kind]
        got -= np.log(kinds.exp(logit))
        for k, a, b in parts:
            lo, hi = self.edges[k], self.edges[k + 1]
            inner = words.of(states[a:b], lo, hi)
            got[a:b] += inner[np.arange(b - a), target[a:b] - lo]
            got[a:b] -= np.log(words.exp(inner))
        out = np.empty_like(got)
        out[order] = got
        return out

    def score(self, docs: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each whole document. A window has more steps where few lanes go on."""
        if not docs:
            return np.zeros(0)
        dealt = Lanes(docs, lanes, self.end)
        got = np.zeros(len(dealt.target), np.float64)
        h = np.zeros((HIDDEN, len(dealt.length)), F32)
        last = np.full(len(dealt.length), self.end, np.int32)
        lo = 0
        while lo < dealt.steps:
            t, start, at, inside = dealt.window(lo, min(32 * window, lanes * window // dealt.live(lo)))
            lo += len(t)
            live = t.shape[1]
            given = np.where(start, np.int32(self.end), np.vstack([last[None, :live], t[:-1]]))
            states, h, _ = self._run(given, start, h[:, :live])
            got[at[inside]] = self.logp(_rows_and_one(states), t.ravel()).reshape(t.shape)[inside]
            last = t[-1]
        out = np.zeros(len(docs))
        out[dealt.order] = np.add.reduceat(got, dealt.first)
        return out

    def _output_gradients(self, flat, target, w, grad):
        """Gradients of the two softmaxes into grad; returns those of the states. flat: states and a one [N, H + 1]; w: the weight of each row."""
        H = HIDDEN
        kind, order, parts = self._sorted(target)
        flat, target, w = flat.take(order, axis=0), target.take(order), w.take(order)
        kinds, words = self._softmaxes()
        e = kinds.of(flat)
        e *= (w / kinds.exp(e))[:, None]
        e[np.arange(len(kind)), kind] -= w
        g = flat.T @ e
        grad["wc"], grad["bc"] = g[:H], g[H]
        dh = e @ self.p["wc"].T
        grad["ww"], grad["bw"] = np.zeros_like(self.p["ww"]), np.zeros_like(self.p["bw"])
        for k, a, b in parts:
            lo, hi = self.edges[k], self.edges[k + 1]
            e = words.of(flat[a:b], lo, hi)
            e *= (w[a:b] / words.exp(e))[:, None]
            e[np.arange(b - a), target[a:b] - lo] -= w[a:b]
            g = e.T @ flat[a:b]
            grad["ww"][lo:hi], grad["bw"][lo:hi] = g[:, :H], g[:, H]
            dh[a:b] += e @ self.p["ww"][lo:hi]
        out = np.empty_like(dh)
        out[order] = dh
        return out

    def train(self, docs: list[np.ndarray], rate: float, lanes: int = 256, window: int = 32) -> None:
        """One pass of Adam over the documents, with backpropagation through windows and the state carried between them.

        A document longer than the mean lane goes on in further lanes, from the state of a start, so that every step learns from
        all lanes instead of from the longest documents alone.
        """
        if not docs:
            return
        dealt = Lanes(_pieces(docs, -(-sum(map(len, docs)) // lanes)), lanes, self.end)
        p, H = self.p, HIDDEN
        if not hasattr(self, "m"):
            self.m, self.v, self.step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        h = np.zeros((H, len(dealt.length)), F32)
        last = np.full(len(dealt.length), self.end, np.int32)
        for lo in range(0, dealt.steps, window):
            t, start, _, inside = dealt.window(lo, window)
            live = t.shape[1]
            given = np.where(start, np.int32(self.end), np.vstack([last[None, :live], t[:-1]]))
            states, h, (before, x, inner) = self._run(given, start, h[:, :live], keep=True)
            weight = inside.astype(F32)
            weight /= weight.sum()
            grad = {}
            dh = self._output_gradients(_rows_and_one(states), t.ravel(), weight.ravel(), grad)
            dh = np.ascontiguousarray(dh.reshape(len(t), live, H).transpose(0, 2, 1))
            # What each step's error is multiplied by, for all steps at once.
            z, r, c = x[:, :H], x[:, H : 2 * H], x[:, 2 * H :]
            rest = np.subtract(F32(1), z)
            to_z = before - c
            to_z *= z
            to_z *= rest
            to_c = np.multiply(c, c, out=c)
            np.subtract(F32(1), to_c, out=to_c)
            to_c *= rest
            to_r = np.multiply(inner, r, out=inner)
            to_r *= np.subtract(F32(1), r, out=rest)
            da, dg = np.empty_like(x), np.empty_like(x)
            carry, fresh = np.zeros((H, live), F32), start.any(axis=1)
            for s in reversed(range(len(t))):
                d = dh[s]
                d += carry
                np.multiply(d, to_z[s], out=da[s, :H])
                dc = np.multiply(d, to_c[s], out=da[s, 2 * H :])
                np.multiply(dc, to_r[s], out=da[s, H : 2 * H])
                dg[s, : 2 * H] = da[s, : 2 * H]
                np.multiply(dc, r[s], out=dg[s, 2 * H :])
                carry = p["u"] @ dg[s]
                d *= z[s]
                carry += d
                if fresh[s]:
                    carry[:, start[s]] = 0
            # Step by step with lanes last, as they are held: nothing is copied into rows.
            lanes_first = da.transpose(0, 2, 1)
            grad["u"], grad["b"] = (before @ dg.transpose(0, 2, 1)).sum(axis=0), da.sum(axis=(0, 2))
            grad["wx"] = (p["emb"].take(given, axis=0).transpose(0, 2, 1) @ lanes_first).sum(axis=0)
            de, g = p["wx"] @ da, given.ravel()
            grad["emb"] = np.stack([np.bincount(g, de[:, k].ravel(), self.n + 1) for k in range(EMBED)], axis=1).astype(F32)
            norm = np.sqrt(sum(float(np.vdot(x, x)) for x in grad.values()))
            clip = min(1.0, 1.0 / max(norm, 1e-9))
            self.step += 1
            fix = rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for k, x in grad.items():
                m, v = self.m[k], self.v[k]
                x = x * F32(clip)
                by = x * x
                x -= m
                x *= F32(0.1)
                m += x
                by -= v
                by *= F32(0.001)
                v += by
                np.sqrt(v, out=by)
                by += F32(1e-6)
                np.divide(m, by, out=by)
                by *= F32(fix)
                p[k] -= by
            last = t[-1]
