"""Small boosted regression trees in numpy, fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


class Node:
    """A split (``feature``, ``threshold``; left takes values up to it) or a leaf (``value``)."""

    def __init__(self, value: float):
        self.value, self.feature, self.threshold, self.left, self.right = value, -1, 0.0, None, None


def _grow(x, cuts, g, h, rows, depth, least):
    node = Node(float(g[rows].sum() / (h[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best, gs, hs = 1e-6, g[rows].sum(), h[rows].sum()
    base = gs * gs / (hs + 1.0)
    for f, points in enumerate(cuts):
        if not len(points):
            continue
        side = np.searchsorted(points, x[rows, f], side="left")
        n = np.bincount(side, minlength=len(points) + 1).cumsum()[:-1]
        gl = np.bincount(side, g[rows], minlength=len(points) + 1).cumsum()[:-1]
        hl = np.bincount(side, h[rows], minlength=len(points) + 1).cumsum()[:-1]
        gain = gl * gl / (hl + 1.0) + (gs - gl) ** 2 / (hs - hl + 1.0) - base
        gain[(n < least) | (len(rows) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.threshold = gain[k], f, float(points[k])
    if node.feature >= 0:
        left = x[rows, node.feature] <= node.threshold
        node.left = _grow(x, cuts, g, h, rows[left], depth - 1, least)
        node.right = _grow(x, cuts, g, h, rows[~left], depth - 1, least)
    return node


def _values(node, x):
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.threshold
    return np.where(left, _values(node.left, x), _values(node.right, x))


def boost(x, y, n_trees=30, depth=3, rate=0.2, least=5, share=0.6, seed=7):
    """Newton boosting of the logistic loss; the base logit and the trees, leaf values scaled by ``rate``."""
    rng = np.random.default_rng(seed)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    # Cuts halfway between the quantiles' values: a threshold on a value itself would depend on rounding.
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))
        cuts.append((v[1:] + v[:-1]) / 2)
    logit, trees = np.full(len(y), base), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-logit))
        rows = np.flatnonzero(rng.random(len(y)) < share)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        tree = _grow(x, cuts, y - p, p * (1 - p), rows, depth, least)
        if tree.feature < 0:
            continue
        scale(tree, rate)
        logit = logit + _values(tree, x)
        trees.append(tree)
    return base, trees


def scale(node, by):
    node.value *= by
    if node.feature >= 0:
        scale(node.left, by)
        scale(node.right, by)


def predict(base, trees, x):
    """Logits."""
    return base + sum((_values(t, x) for t in trees), np.zeros(len(x)))


def paths(node, so_far=()):
    """Every path from the root to a node below it, as ((feature, threshold, goes right), ...)."""
    if node.feature < 0:
        return
    for right, child in ((False, node.left), (True, node.right)):
        path = (*so_far, (node.feature, node.threshold, right))
        yield path
        yield from paths(child, path)
