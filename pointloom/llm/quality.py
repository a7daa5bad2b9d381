"""Quality: naive Bayes support vectors, n-gram indicators scaled by class log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pointloom.llm import ngrams

COST = 0.003
#: Value of the constant feature: the larger, the less the bias is penalised.
CONSTANT = 3.0
EPOCHS = 30


def descend(starts, columns, ratios, y, rows: np.ndarray, cost: float = COST) -> np.ndarray:
    """Dual coordinate descent for the hinge loss over some rows; weights with the bias last."""
    w = np.zeros(len(ratios) + 1)
    alpha = np.zeros(len(y))
    sign = np.where(y > 0, 1.0, -1.0)
    squares = ratios * ratios
    norm = np.array([squares[columns[starts[i] : starts[i + 1]]].sum() + CONSTANT * CONSTANT for i in range(len(y))])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(rows):
            c = columns[starts[i] : starts[i + 1]]
            v = ratios[c]
            slack = sign[i] * (v @ w[c] + CONSTANT * w[-1]) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost)
            if change := (new - alpha[i]) * sign[i]:
                alpha[i] = new
                w[c] += change * v
                w[-1] += CONSTANT * change
                moved = max(moved, abs(change))
        if moved < 1e-4 * cost:
            break
    return w


def margins(starts, columns, ratios, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scaled = w[:-1] * ratios
    return np.array([scaled[columns[starts[i] : starts[i + 1]]].sum() for i in rows]) + CONSTANT * w[-1]


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of a margin, by Newton steps on targets smoothed by the class counts."""
    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.stack([margin, np.ones_like(margin)])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        h = (x * np.maximum(s * (1 - s), 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (s - t))
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def hinge(starts, columns, ratios, y):
    """Weights from all rows; the map from margin to score from fifths that their own model didn't see."""
    n = len(y)
    fold = np.random.default_rng(11).permutation(n) % 5
    out = np.zeros(n)
    for k in range(5):
        w = descend(starts, columns, ratios, y, np.flatnonzero(fold != k))
        out[fold == k] = margins(starts, columns, ratios, w, np.flatnonzero(fold == k))
    slope, shift = calibrated(out, y)
    w = descend(starts, columns, ratios, y, np.arange(n))
    return w[:-1], float(CONSTANT * w[-1]), slope, shift


def train(docs: DataFrame, labels: DataFrame, sample: int = ngrams.SAMPLE) -> ngrams.Linear:
    """Model from the texts of ``docs`` and the ``quality`` column of ``labels``, on ``sample`` labelled rows at most."""
    return ngrams.fitted(docs, labels, "quality", hinge, sample)


def score(docs: DataFrame, model: ngrams.Linear, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; see ngrams.scored."""
    return ngrams.scored(docs, model, threshold)
