"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASS_SIZE, CLASS_MASS = 32, 40, 1 / 32
WINDOW, TRAIN_LANES, SCORE_LANES = 32, 256, 384
RATE, CLIP = 8e-3, 1.0
#: In training, longer documents are taken as stretches of so many tokens, so that lanes end together;
#: a stretch starts with a new state and the token before it.
STRETCH = 512
#: Steps that a call takes at least, in fewer lanes if need be.
LEAST_WINDOWS = 32


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place in it) of each id: ids by falling count, cut at a share or a size."""
    order = np.argsort(-counts, kind="stable")
    share = counts / counts.sum()
    cls, pos, c, size, mass = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), 0, 0, 0.0
    for i in order.tolist():
        if size and (size == CLASS_SIZE or mass >= CLASS_MASS):
            c, size, mass = c + 1, 0, 0.0
        cls[i], pos[i] = c, size
        size, mass = size + 1, mass + share[i]
    return cls, pos


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(lane, start) of each document, laid end to end in lanes of about one length; and the lanes'
    lengths, which fall."""
    n = max(1, min(most, len(lengths)))
    heap = [(0, k) for k in range(n)]
    lane, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[i], start[i] = k, used
        heapq.heappush(heap, (used + int(lengths[i]), k))
    heap.sort(key=lambda x: (-x[0], x[1]))
    rank = np.empty(n, np.int64)
    rank[[k for _, k in heap]] = np.arange(n)
    return rank[lane], start, np.array([u for u, _ in heap])


class Model:
    """Parameters: input rows X for the three gates, recurrences U (update, reset) and N (candidate),
    class outputs C with bias c, and outputs W of each class with bias w."""

    NAMES = ("X", "U", "N", "C", "c", "W", "w")

    def __init__(self, counts: np.ndarray, end: int, seed: int = 11):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.end, (self.cls, self.pos) = end, classes(counts)
        n = int(self.cls.max()) + 1
        self.single = np.bincount(self.cls, minlength=n) == 1
        mass = np.bincount(self.cls, counts, n)
        w = np.full((n, CLASS_SIZE), -1e9)
        w[self.cls, self.pos] = np.log(counts / mass[self.cls])
        f = lambda *s: rng.normal(0, 1 / np.sqrt(h), s).astype(np.float32)
        self.p = {"X": 0.3 * f(len(counts), 3 * h), "U": f(h, 2 * h), "N": f(h, h), "C": 0.1 * f(h, n), "c": np.log(mass / mass.sum()).astype(np.float32), "W": 0.1 * f(n, h, CLASS_SIZE), "w": w.astype(np.float32)}
        self.reset()

    def reset(self) -> None:
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return self

    def run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, record: bool):
        """States after each of the inputs x (steps, lanes); keep is 0 where the state starts anew. Also the last
        state, and if recorded for the way back: states before, both gates, reset states and candidates of all steps.
        All that a window needs is small enough for a core's share of the cache."""
        p, H, kind = self.p, HIDDEN, h.dtype
        steps, n = x.shape
        for_gates, for_new = (np.ascontiguousarray(part) for part in np.split(p["X"], [2 * H], axis=1))
        states, a, b = np.empty((steps, n, H), kind), np.empty((n, 2 * H), kind), np.empty((n, H), kind)
        before, reset, new = (np.empty((steps if record else 1, n, H), kind) for _ in range(3))
        gates = np.empty((steps if record else 1, n, 2 * H), kind)
        for t in range(steps):
            k, out = t if record else 0, states[t]
            old, g, r, c = before[k], gates[k], reset[k], new[k]
            np.take(for_gates, x[t], axis=0, out=a, mode="clip")
            np.take(for_new, x[t], axis=0, out=b, mode="clip")
            np.multiply(h, keep[t][:, None], out=old)
            np.matmul(old, p["U"], out=g)
            g += a
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:, H:], old, out=r)
            np.matmul(r, p["N"], out=c)
            c += b
            c *= -2  # tanh x = 2 / (1 + exp(-2 x)) - 1
            np.minimum(c, 80, out=c)
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            np.subtract(old, c, out=out)
            out *= g[:, :H]
            out += c
            h = out
        return states, h, (before, gates, reset, new)

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log P of targets y after states h; with grads, also the gradient of -log P by h, over a full window's tokens."""
        p, n = self.p, len(y)
        order = np.argsort(self.cls[y].astype(np.int16), kind="stable")  # a radix sort: tokens of one class lie together
        h, y = h[order], y[order]
        cls, pos, rows = self.cls[y], self.pos[y], np.arange(n)
        e = h @ p["C"]
        e += p["c"]
        np.minimum(e, 60, out=e)  # far above what logits are; no exponential overflows, so none is shifted
        at = e[rows, cls]
        np.exp(e, out=e)
        total = e.sum(1)
        logp = (at - np.log(total)).astype(np.float64)
        dh = None
        scale = h.dtype.type(1 / (TRAIN_LANES * WINDOW))
        if grads is not None:
            e *= (scale / total)[:, None]
            e[rows, cls] -= scale
            grads["C"], grads["c"] = h.T @ e, e.sum(0)
            dh = e @ p["C"].T
            grads["W"], grads["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
        edges = np.searchsorted(cls, np.arange(len(p["c"]) + 1)).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a == b or self.single[k]:
                continue
            hk, pk, some = h[a:b], pos[a:b], rows[: b - a]
            e = hk @ p["W"][k]
            e += p["w"][k]
            np.minimum(e, 60, out=e)
            at = e[some, pk]
            np.exp(e, out=e)
            total = e.sum(1)
            logp[a:b] += at - np.log(total)
            if grads is not None:
                e *= (scale / total)[:, None]
                e[some, pk] -= scale
                grads["W"][k], grads["w"][k] = hk.T @ e, e.sum(0)
                dh[a:b] += e @ p["W"][k].T
        out = np.empty(n)
        out[order] = logp
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def back(self, x: np.ndarray, keep: np.ndarray, kept: tuple, dstates: np.ndarray, grads: dict) -> None:
        """Gradients of X, U and N from those of the states, through the steps of the window. What was kept of gates
        and candidates makes room for their gradients."""
        p, H = self.p, HIDDEN
        before, gates, reset, new = kept
        steps, n = x.shape
        back_n, back_u = np.ascontiguousarray(p["N"].T), np.ascontiguousarray(p["U"].T)
        carry, dreset, one, dz, dr = (np.zeros((n, H), new.dtype) for _ in range(5))
        for t in range(steps - 1, -1, -1):
            old, z, r, c = before[t], gates[t, :, :H], gates[t, :, H:], new[t]
            carry += dstates[t]
            np.subtract(old, c, out=dz)  # to dz: d (h - c) z (1 - z)
            dz *= carry
            dz *= z
            np.subtract(1, z, out=one)
            dz *= one
            one *= carry  # to c: d (1 - z) (1 - c c)
            c *= c
            np.subtract(1, c, out=c)
            c *= one
            np.matmul(c, back_n, out=dreset)
            np.multiply(dreset, reset[t], out=dr)  # to dr: dreset h r (1 - r)
            np.subtract(1, r, out=one)
            dr *= one
            carry *= z
            dreset *= r
            carry += dreset
            gates[t, :, :H], gates[t, :, H:] = dz, dr
            carry += gates[t] @ back_u
            carry *= keep[t][:, None]
        flat = gates.reshape(-1, 2 * H), new.reshape(-1, H)
        grads["U"], grads["N"] = before.reshape(-1, H).T @ flat[0], reset.reshape(-1, H).T @ flat[1]
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        ids = x.ravel()[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        grads["X"] = np.zeros_like(p["X"])
        grads["X"][ids[first], : 2 * H] = np.add.reduceat(flat[0][order], first)
        grads["X"][ids[first], 2 * H :] = np.add.reduceat(flat[1][order], first)

    def update(self, grads: dict) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, CLIP / max(norm, 1e-12))
        self.t += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g *= np.float32(scale)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.999)
            v += np.float32(0.001) * g
            np.sqrt(v, out=g)
            g += np.float32(1e-7)
            np.divide(m, g, out=g)
            g *= rate
            self.p[k] -= g

    def windows(self, docs: list[np.ndarray], most: int, before: list[int] | None = None):
        """Documents in lanes: (inputs, targets, document of each target or -1, keep) for each window.
        before: the token that precedes each document, if not the end."""
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        lane, start, used = lanes(lengths, most)
        n, size = len(used), int(used[0])
        y, of = np.full((n, size), self.end, np.int64), np.full((n, size), -1, np.int64)
        fresh, first = np.zeros((n, size), bool), np.full(len(docs), self.end) if before is None else np.array(before)
        for i, d in enumerate(docs):
            y[lane[i], start[i] : start[i] + len(d)] = d
            of[lane[i], start[i] : start[i] + len(d)] = i
            fresh[lane[i], start[i]] = True
        x = np.concatenate([np.full((n, 1), self.end, np.int64), y[:, :-1]], 1)
        x[lane, start] = first
        keep = (~fresh).astype(np.float32)
        for at in range(0, size, WINDOW):
            part, live = slice(at, at + WINDOW), int((used > at).sum())
            yield x[:live, part].T, y[:live, part].T, of[:live, part].T, keep[:live, part].T

    def train(self, docs: list[np.ndarray]) -> None:
        h = None
        before = [int(d[i - 1]) if i else self.end for d in docs for i in range(0, len(d), STRETCH)]
        docs = [d[i : i + STRETCH] for d in docs for i in range(0, len(d), STRETCH)]
        few = sum(map(len, docs)) // (WINDOW * LEAST_WINDOWS)
        for x, y, of, keep in self.windows(docs, max(8, min(TRAIN_LANES, few)), before):
            h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
            states, h, kept = self.run(x, keep, h, True)
            real, grads = of >= 0, {}
            if real.all():
                d = self.outputs(states.reshape(-1, HIDDEN), y.ravel(), grads)[1].reshape(states.shape)
            else:
                d = np.zeros_like(states)
                d[real] = self.outputs(states[real], y[real], grads)[1]
            self.back(x, keep, kept, d, grads)
            self.update(grads)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log P of each whole document, its state carried from window to window."""
        h, out = None, np.zeros(len(docs))
        for x, y, of, keep in self.windows(docs, SCORE_LANES):
            h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
            states, h, _ = self.run(x, keep, h, False)
            real = of >= 0
            out += np.bincount(of[real], self.outputs(states[real], y[real])[0], len(docs))
        return out
