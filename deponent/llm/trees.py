"""Gradient-boosted trees for a few classes on binned columns, with numpy."""

from __future__ import annotations

import numpy as np


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class BoostedTrees:
    """One tree per class and round, each a full tree of ``depth`` levels; ``scale`` and ``shift`` calibrate the scores."""

    def __init__(self, cuts: list[np.ndarray], trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], base: np.ndarray, depth: int):
        self.cuts, self.trees, self.base, self.depth = cuts, trees, base, depth
        self.scale, self.shift = 1.0, np.zeros(len(base))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 48, l2: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        n, m = codes.shape
        flat = codes + np.arange(m) * (bins + 1)
        hot = np.eye(classes)[y]
        base = np.log(np.maximum(hot.mean(0), 1e-3))
        score = np.tile(base, (n, 1))
        trees: list = []
        for _ in range(rounds):
            p = _softmax(score)
            for k in range(classes):
                g, h = p[:, k] - hot[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins + 1)
                node = np.zeros(n, int)
                for level in range(depth):
                    start, count = 2**level - 1, 2**level
                    key = ((node - start)[:, None] * (m * (bins + 1)) + flat).ravel()
                    size = count * m * (bins + 1)
                    sg = np.bincount(key, np.repeat(g, m), size).reshape(count, m, bins + 1).cumsum(2)
                    sh = np.bincount(key, np.repeat(h, m), size).reshape(count, m, bins + 1).cumsum(2)
                    tg, th = sg[:, :, -1:], sh[:, :, -1:]
                    gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                    gain[(sh < 1e-3) | (th - sh < 1e-3)] = 0
                    best = gain.reshape(count, -1).argmax(1)
                    good = gain.reshape(count, -1).max(1) > 1e-6
                    feature[start : start + count] = np.where(good, best // (bins + 1), 0)
                    cut[start : start + count] = np.where(good, best % (bins + 1), bins + 1)
                    node = 2 * node + 1 + (codes[np.arange(n), feature[node]] > cut[node])
                leaf = node - (2**depth - 1)
                value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
                score[:, k] += value[leaf]
                trees.append((k, feature, cut, value))
        return cls(cuts, trees, base, depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)
        out, rows = np.tile(self.base, (len(x), 1)), np.arange(len(x))
        for k, feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
            out[:, k] += value[node - (2**self.depth - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, one column per class."""
        return _softmax(self.scores(x) * self.scale + self.shift)


def calibrate(model: BoostedTrees, x: np.ndarray, y: np.ndarray, weight: float = 0.02, steps: int = 400) -> BoostedTrees:
    """Sets the temperature and the shifts of the classes at which the log loss on held-out labelled rows is least.

    ``weight`` draws both to no change, so that few rows cannot move them far.
    """
    z, hot, log_scale, shift = model.scores(x), np.eye(len(model.base))[y], 0.0, np.zeros(len(model.base))
    for _ in range(steps):
        d = (_softmax(z * np.exp(log_scale) + shift) - hot) / max(1, len(y))
        log_scale -= 0.5 * (np.clip((d * z).sum() * np.exp(log_scale), -1, 1) + weight * log_scale)
        shift -= 2.0 * (d.sum(0) + weight * shift)
    model.scale, model.shift = float(np.exp(log_scale)), shift - shift[0]
    return model


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """The mean gap between probability and share of right answers over equal bins of the top probability, weighted by rows."""
    top, right = p.max(1), p.argmax(1) == y
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[at == k].mean() - right[at == k].mean()) * (at == k).mean() for k in range(bins) if (at == k).any()))
