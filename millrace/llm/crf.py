"""Linear-chain conditional random fields in numpy: training by gradient ascent, decoding by Viterbi in padded batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Padded cells (steps times sequences) that are decoded at once.
CELLS = 1 << 16


class Crf:
    """Features are strings; each position has the same number of them. Unseen and empty ones have weight zero."""

    def __init__(self, tags: Sequence[str]):
        self.tags = list(tags)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, len(self.tags)))
        self.step = np.zeros((len(self.tags), len(self.tags)))
        self.first = np.zeros(len(self.tags))

    def ids(self, features: list[list[str]]) -> np.ndarray:
        """[position, feature] rows of weights; 0 is the unseen one."""
        return np.array([[self.index.get(f, 0) for f in row] for row in features], np.int64)

    def fit(self, sequences: list[tuple[list[list[str]], list[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> "Crf":
        """Adagrad on the penalised log-likelihood of all (features, tags); deterministic."""
        for feats, _ in sequences:
            for row in feats:
                for f in filter(None, row):
                    self.index.setdefault(f, len(self.index) + 1)
        k = len(self.tags)
        self.weights = np.zeros((len(self.index) + 1, k))
        data = [(self.ids(f), np.array([self.tags.index(t) for t in y])) for f, y in sequences if f]
        params = [self.weights, self.step, self.first]
        seen = [np.full_like(p, 1e-8) for p in params]
        for _ in range(rounds):
            grads = [-decay * len(data) * p for p in params]
            for ids, y in data:
                self._gradient(ids, y, grads)
            for p, g, s in zip(params, grads, seen):
                s += g * g
                p += rate * g / np.sqrt(s)
            self.weights[0] = 0
        return self

    def _gradient(self, ids: np.ndarray, y: np.ndarray, grads: list[np.ndarray]) -> None:
        n, k = len(y), len(self.tags)
        e = self.weights[ids].sum(1)
        a, b = np.empty((n, k)), np.zeros((n, k))
        a[0] = self.first + e[0]
        for t in range(1, n):
            a[t] = e[t] + _logsum(a[t - 1][:, None] + self.step, 0)
        for t in range(n - 2, -1, -1):
            b[t] = _logsum(self.step + (e[t + 1] + b[t + 1])[None], 1)
        z = _logsum(a[-1], 0)
        own = -np.exp(a + b - z)
        own[np.arange(n), y] += 1
        np.add.at(grads[0], ids, own[:, None])
        grads[2] += own[0]
        for t in range(1, n):
            grads[1] -= np.exp(a[t - 1][:, None] + self.step + (e[t] + b[t])[None] - z)
            grads[1][y[t - 1], y[t]] += 1

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence's ids its best tags, as numbers. Ties go to the earlier tag."""
        out: list = [np.empty(0, np.int64)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        while order:
            longest = len(sequences[order[-1]])
            take = max(1, min(len(order), CELLS // longest))
            some, order = order[-take:], order[:-take]
            for i, tags in zip(some, self._viterbi([sequences[i] for i in some])):
                out[i] = tags
        return out

    def _viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """seqs by rising length; a sequence's last score is carried unchanged past its end."""
        sizes = np.array([len(s) for s in seqs])
        n, k, m = sizes.max(), len(self.tags), len(seqs)
        e = np.zeros((n, m, k))
        for j, s in enumerate(seqs):
            e[: len(s), j] = self.weights[s].sum(1)
        back = np.empty((n, m, k), np.int8)
        score = self.first + e[0]
        for t in range(1, n):
            live = np.searchsorted(sizes, t, "right")
            options = score[live:, :, None] + self.step
            back[t, live:] = best = options.argmax(1)
            score[live:] = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + e[t, live:]
        tags = np.zeros((n, m), np.int64)
        at = score.argmax(1)
        for t in range(n - 1, -1, -1):
            inside = sizes > t
            tags[t, inside] = at[inside]
            if t:
                at = np.where(inside, back[t, np.arange(m), at], at)
        return [tags[: sizes[j], j] for j in range(m)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
