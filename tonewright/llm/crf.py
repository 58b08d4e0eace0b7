"""Two-label linear-chain conditional random field on ragged batches of chains, in numpy.

Chains of a batch advance together, longest first, so a batch costs as many array steps
as its longest chain has items.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Layout of a batch: ``first`` has n + 1 item offsets; chains without items are allowed."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        self.order = np.argsort(-length, kind="stable")
        self.begin, self.length = first[:-1][self.order], length[self.order]
        self.steps = int(length.max()) if len(length) else 0
        self.active = np.searchsorted(-self.length, -np.arange(self.steps), "left")  # chains longer than t
        self.n = int(first[-1]) if len(first) else 0


class Crf:
    """Emission x.w + b for label 1 against 0, 2 x 2 transitions, start scores."""

    def __init__(self, n_features: int):
        self.w, self.b = np.zeros(n_features), 0.0
        self.t, self.s = np.zeros((2, 2)), np.zeros(2)
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def emission(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w + self.b

    def _forward(self, e: np.ndarray, c: Chains) -> np.ndarray:
        a = np.zeros((c.n, 2))
        for k in range(c.steps):
            at = c.begin[: c.active[k]] + k
            if k == 0:
                a[at, 0], a[at, 1] = self.s[0], self.s[1] + e[at]
            else:
                p = a[at - 1]
                a[at, 0] = np.logaddexp(p[:, 0] + self.t[0, 0], p[:, 1] + self.t[1, 0])
                a[at, 1] = np.logaddexp(p[:, 0] + self.t[0, 1], p[:, 1] + self.t[1, 1]) + e[at]
        return a

    def _backward(self, e: np.ndarray, c: Chains) -> np.ndarray:
        b = np.zeros((c.n, 2))
        for k in range(c.steps - 2, -1, -1):
            at = c.begin[: c.active[k + 1]] + k
            q0, q1 = b[at + 1, 0], b[at + 1, 1] + e[at + 1]
            b[at, 0] = np.logaddexp(q0 + self.t[0, 0], q1 + self.t[0, 1])
            b[at, 1] = np.logaddexp(q0 + self.t[1, 0], q1 + self.t[1, 1])
        return b

    def marginals(self, x: np.ndarray, c: Chains) -> np.ndarray:
        """P(label 1) of every item by forward-backward."""
        e = self.emission(x)
        d = self._forward(e, c) + self._backward(e, c)
        return 1 / (1 + np.exp(np.clip(d[:, 0] - d[:, 1], -700, 700)))

    def viterbi(self, x: np.ndarray, c: Chains) -> np.ndarray:
        """The most probable labels of every chain."""
        e = self.emission(x)
        a, back = np.zeros((c.n, 2)), np.zeros((c.n, 2), np.int8)
        for k in range(c.steps):
            at = c.begin[: c.active[k]] + k
            if k == 0:
                a[at, 0], a[at, 1] = self.s[0], self.s[1] + e[at]
            else:
                p = a[at - 1]
                for y in (0, 1):
                    two = p + self.t[:, y]
                    back[at, y] = two[:, 1] > two[:, 0]
                    a[at, y] = two.max(1) + (e[at] if y else 0)
        out = np.zeros(c.n, np.int8)
        for k in range(c.steps - 1, -1, -1):
            at = c.begin[: c.active[k]] + k
            ends = c.length[: c.active[k]] == k + 1
            going = at[~ends]
            out[at[ends]] = a[at[ends], 1] > a[at[ends], 0]
            out[going] = back[going + 1, out[going + 1]]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 300, rate: float = 0.1, l2: float = 1e-3, warm: bool = False) -> "Crf":
        """Maximum conditional likelihood, mean over chains, by Adam on the whole sample; warm: from the
        weights at hand."""
        if not len(x):
            return self
        if not warm:
            self.mean, self.scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
        z, c = self.standard(x), Chains(first)
        n_chains = max(1, int((c.length > 0).sum()))
        starts = c.begin[: c.active[0]]
        inner = np.ones(len(x), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)  # items with one before them
        gold_t = np.zeros((2, 2))
        np.add.at(gold_t, (y[inner - 1], y[inner]), 1)
        gold_s = np.bincount(y[starts], minlength=2)
        theta = np.concatenate([self.w, [self.b], self.t.ravel(), self.s]) if warm else np.zeros(len(self.w) + 7)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, rounds + 1):
            self.w, self.b, self.t, self.s = theta[:-7], theta[-7], theta[-6:-2].reshape(2, 2), theta[-2:]
            e = z @ self.w + self.b
            a, b = self._forward(e, c), self._backward(e, c)
            whole = np.logaddexp(*(a + b).T)
            p = np.exp(a + b - whole[:, None])
            exp_t = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    exp_t[i, j] = np.exp(a[inner - 1, i] + self.t[i, j] + e[inner] * j + b[inner, j] - whole[inner]).sum()
            d = y - p[:, 1]
            g = np.concatenate([z.T @ d, [d.sum()], (gold_t - exp_t).ravel(), gold_s - p[starts].sum(0)]) / n_chains - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        self.w, self.b, self.t, self.s = theta[:-7], float(theta[-7]), theta[-6:-2].reshape(2, 2), theta[-2:]
        return self
