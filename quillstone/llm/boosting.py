"""Gradient-boosted regression trees for a binary label, in numpy, for samples of bounded size."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 4, 0.3, 32, 2.0, 1.0


def _bins(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of fixed depth over quantile bins, each fitted to the gradient of the logistic loss.

    A tree is stored as its inner nodes in heap order: the feature and the
    threshold that a row must exceed to go right, then the leaves' values.
    """
    edges = _bins(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    inner = 2**DEPTH - 1
    features = np.zeros((TREES, inner), np.int32)
    thresholds = np.full((TREES, inner), np.inf)
    leaves = np.zeros((TREES, inner + 1))
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            place = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = place * (len(e) + 1) + binned[:, f]
                gs, hs = (np.bincount(cell, w, width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1) for w in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k] = gain[k, at[k]]
                    features[t, first + k], thresholds[t, first + k] = f, e[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, w, inner + 1) for w in (g, h))
        leaves[t] = RATE * gs / (hs + RIDGE)
        margin += leaves[t, leaf]
    return {"start": start, "features": features, "thresholds": thresholds, "leaves": leaves}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """The log odds of the label for each row."""
    out = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    inner = 2**DEPTH - 1
    for f, c, leaf in zip(model["features"], model["thresholds"], model["leaves"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, f[node]] > c[node])
        out += leaf[node - inner]
    return out
