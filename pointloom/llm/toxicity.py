"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pointloom.llm import ngrams

RIDGE = 3.0
STEPS = 30


def newton(starts: np.ndarray, columns: np.ndarray, ratios: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
    """Weights and bias of ridge logistic regression by Newton steps with conjugate gradients.

    The bias is the last weight and is hardly penalised. Returned with slope 1 and shift 0.
    """
    n, width, values = len(y), len(ratios), ratios[columns]
    row = np.repeat(np.arange(n), np.diff(starts))
    penalty = np.append(np.full(width, ridge), 1e-6)
    times = lambda w: np.bincount(row, values * w[columns], n) + w[-1]
    back = lambda u: np.append(np.bincount(columns, values * u[row], width), u.sum())
    loss = lambda w, m: np.logaddexp(0, np.where(y > 0, -m, m)).sum() + 0.5 * (penalty * w * w).sum()
    w = np.zeros(width + 1)
    margin = times(w)
    now = loss(w, margin)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        gradient = back(p - y) + penalty * w
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        first = rr
        for _ in range(40):
            if rr <= 1e-4 * first or rr < 1e-12:
                break
            hd = back(curve * times(d)) + penalty * d
            a = rr / (d @ hd)
            step, r = step + a * d, r - a * hd
            rr, before = r @ r, rr
            d = r + rr / before * d
        length = 1.0
        while length > 1e-4 and loss(w + length * step, times(w + length * step)) > now:
            length /= 2
        w = w + length * step
        margin = times(w)
        now, last = loss(w, margin), now
        if last - now < 1e-6 * abs(last):
            break
    return w[:-1], float(w[-1]), 1.0, 0.0


def train(docs: DataFrame, labels: DataFrame, sample: int = ngrams.SAMPLE) -> ngrams.Linear:
    """Model from the texts of ``docs`` and the ``toxic`` column of ``labels``, on ``sample`` labelled rows at most."""
    return ngrams.fitted(docs, labels, "toxic", newton, sample)


def score(docs: DataFrame, model: ngrams.Linear, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; see ngrams.scored."""
    return ngrams.scored(docs, model, threshold)
