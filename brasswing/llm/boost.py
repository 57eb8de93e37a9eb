"""Gradient-boosted trees on the logistic loss, small enough to train on the driver.

Trees grow on quantile bins with Newton leaves. A feature may be constrained
to act in one direction only: a split that would break it is not taken, and
the middle of a constrained split bounds all values below it. A trained model
is flat node arrays, scored for all rows of a batch at once, or SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = -1


@dataclass
class Trees:
    """``feature[n]`` is ``LEAF`` at leaves; rows with ``x[feature] <= threshold`` go to ``left``. ``roots``: one a tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees for every row of ``x``."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f != LEAF
                below = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def to_sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over feature columns ``names``."""

        def node(n: int) -> str:
            if self.feature[n] == LEAF:
                return f"{self.value[n]!r}D" if not isinstance(self.value[n], np.floating) else f"{float(self.value[n])!r}D"
            low, high = node(self.left[n]), node(self.right[n])
            return f"(CASE WHEN {names[self.feature[n]]} <= {float(self.threshold[n])!r}D THEN {low} ELSE {high} END)"

        return " + ".join([f"{float(self.base)!r}D", *(node(r) for r in self.roots)])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 8, monotone: dict[int, int] | None = None) -> Trees:
    """Fit 0/1 labels. ``monotone``: feature to +1 (never lowers the score as it grows) or -1."""
    monotone = monotone or {}
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, width = x.shape
    mean = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def add(v: float) -> int:
        for store, item in ((feature, LEAF), (threshold, 0.0), (left, 0), (right, 0), (value, v)):
            store.append(item)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = add(float(np.clip(rate * -total_g / (total_h + l2), low, high)))
        if level == depth or len(rows) < 2 * least:
            return here
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j in range(width):
            k = len(cuts[j]) + 1
            if k < 2:
                continue
            b = binned[rows, j]
            sg, sh, sn = (np.bincount(b, w, k).cumsum()[:-1] for w in (g[rows], h[rows], None))
            gain = sg**2 / (sh + l2) + (total_g - sg) ** 2 / (total_h - sh + l2) - total_g**2 / (total_h + l2)
            vl, vr = (np.clip(rate * -a / (c + l2), low, high) for a, c in ((sg, sh), (total_g - sg, total_h - sh)))
            allowed = (sn >= least) & (len(rows) - sn >= least) & (monotone.get(j, 0) * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(vl[i]), float(vr[i]))
        _, j, i, vl, vr = best
        if j < 0:
            return here
        goes_left = binned[rows, j] <= i
        way, middle = monotone.get(j, 0), (vl + vr) / 2
        feature[here], threshold[here] = j, float(cuts[j][i])
        left[here] = grow(rows[goes_left], g, h, level + 1, middle if way < 0 else low, middle if way > 0 else high)
        right[here] = grow(rows[~goes_left], g, h, level + 1, middle if way > 0 else low, middle if way < 0 else high)
        return here

    def flat() -> Trees:
        return Trees(base, np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), depth)

    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        start = len(feature)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
        one = flat()
        margin += Trees(0.0, np.array([start]), *(getattr(one, k) for k in ("feature", "threshold", "left", "right", "value")), depth).margin(x)
    return flat()


def threshold_keeping(scores: np.ndarray, y: np.ndarray, share: float) -> float:
    """The highest cut at which at least ``share`` of the rows with label 1 score no less."""
    good = np.sort(scores[y == 1])
    return float(good[int((1 - share) * len(good))]) if len(good) else 0.0
