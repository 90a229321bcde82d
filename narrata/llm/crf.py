"""A small linear-chain conditional random field on numpy.

A position has a fixed number of feature slots, each an id in one table of weights; its
score for a label is the sum over its slots.  Training maximises the penalised conditional
log-likelihood by Adam on padded batches; decoding is Viterbi on padded batches of many
sequences at once.
"""

from __future__ import annotations

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Crf:
    def __init__(self, features: int, labels: int):
        self.w = np.zeros((features, labels))
        self.trans = np.zeros((labels, labels))
        self.begin, self.end = np.zeros(labels), np.zeros(labels)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.w[ids[:, 0]]
        for f in range(1, ids.shape[1]):
            out = out + self.w[ids[:, f]]
        return out

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 64, rate: float = 0.05, l2: float = 1e-4, seed: int = 1) -> Crf:
        """sequences: (ids of shape positions x slots, labels)."""
        params = [self.w, self.trans, self.begin, self.end]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(seed)
        by_length = sorted((s for s in sequences if len(s[1])), key=lambda s: len(s[1]))
        groups = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                grads, step = self._gradient(groups[g]), step + 1
                for i, (p, d) in enumerate(zip(params, grads)):
                    d = d / len(groups[g]) - l2 * p
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, group) -> list[np.ndarray]:
        """Of the log-likelihood: observed minus expected counts."""
        b, t, n = len(group), max(len(y) for _, y in group), self.w.shape[1]
        lens = np.array([len(y) for _, y in group])
        e = np.zeros((b, t, n))
        for i, (x, y) in enumerate(group):
            e[i, : len(y)] = self.scores(x)
        alpha, beta = np.zeros((b, t, n)), np.zeros((b, t, n))
        alpha[:, 0] = self.begin + e[:, 0]
        for j in range(1, t):
            step = _logsum(alpha[:, j - 1, :, None] + self.trans, 1) + e[:, j]
            alpha[:, j] = np.where((j < lens)[:, None], step, alpha[:, j - 1])
        z = _logsum(alpha[:, -1] + self.end, 1)
        beta[:] = self.end
        for j in range(t - 2, -1, -1):
            step = _logsum(self.trans + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where((j < lens - 1)[:, None], step, self.end)
        p = np.exp(alpha + beta - z[:, None, None])
        gw, gt, gb, ge = np.zeros_like(self.w), np.zeros_like(self.trans), np.zeros(n), np.zeros(n)
        for i, (x, y) in enumerate(group):
            k = len(y)
            d = -p[i, :k]
            d[np.arange(k), y] += 1
            for f in range(x.shape[1]):
                np.add.at(gw, x[:, f], d)
            gb += np.eye(n)[y[0]] - p[i, 0]
            ge += np.eye(n)[y[-1]] - p[i, k - 1]
            np.add.at(gt, (y[:-1], y[1:]), 1)
            if k > 1:
                q = alpha[i, : k - 1, :, None] + self.trans + (e[i, 1:k] + beta[i, 1:k])[:, None, :] - z[i]
                gt -= np.exp(q).sum(0)
        return [gw, gt, gb, ge]

    def viterbi(self, e: np.ndarray, first: np.ndarray, count: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
        """Best labels of sequences laid end to end in e; left, right: of each sequence, the added score of its first and last label."""
        out = np.zeros(len(e), np.int64)
        n = e.shape[1]
        left = np.tile(self.begin, (len(first), 1)) if left is None else left
        right = np.tile(self.end, (len(first), 1)) if right is None else right
        order = np.flatnonzero(count > 0)
        order = order[np.argsort(count[order], kind="stable")]
        at = 0
        while at < len(order):
            t = int(count[order[at]])
            size = max(1, 2_000_000 // max(t, 1))
            g = order[at : at + size]
            g = g[count[g] <= max(2 * t, 16)]
            at += len(g)
            lens, t = count[g], int(count[g].max())
            pick = np.minimum(first[g][:, None] + np.arange(t), len(e) - 1)
            x = e[pick]
            best, back = left[g] + x[:, 0], np.zeros((len(g), t, n), np.int8)
            for j in range(1, t):
                step = best[:, :, None] + self.trans
                back[:, j] = step.argmax(1)
                best = np.where((j < lens)[:, None], step.max(1) + x[:, j], best)
            label = (best + right[g]).argmax(1)
            rows = np.arange(len(g))
            for j in range(t - 1, -1, -1):
                here = j < lens
                out[first[g[here]] + j] = label[here]
                label = np.where(here, back[rows, j, label], label)
        return out

    def decode(self, e: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """As viterbi, and exactly its result up to ties, but skips positions that must have label 0.

        Giving one position another label changes the other terms by at most twice the spread of
        the transition scores; where label 0 leads by more, every best path has it, and the
        sequence falls into independent parts.
        """
        t = np.concatenate([self.trans.ravel(), self.begin, self.end])
        sure = e[:, 0] - e[:, 1:].max(1) > 2 * (t.max() - t.min()) if len(e) else np.zeros(0, bool)
        out = np.zeros(len(e), np.int64)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        doc = np.repeat(np.arange(len(first)), count)
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])
        starts = open_[new]
        sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
        ends = starts + sizes - 1
        at_begin = starts == first[doc[starts]]
        at_end = ends == first[doc[ends]] + count[doc[ends]] - 1
        left = np.where(at_begin[:, None], self.begin, self.trans[0])
        right = np.where(at_end[:, None], self.end, self.trans[:, 0])
        got = self.viterbi(e, starts, sizes, left, right)
        out[open_] = got[open_]
        return out
