"""Small gradient-boosted trees for two classes: fitted in numpy, read as numpy or Spark columns.

Logistic loss with Newton leaf values; splits are searched over the quantiles of each feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    """A sum of trees; ``score`` is the probability of class 1."""

    bias: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for tree in self.trees:
            _add(tree, x, np.arange(len(x)), total)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def column(self, features: list[Column]) -> Column:
        """The score as an expression over feature columns, in the order of the fit."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + _column(tree, features)
        return 1 / (1 + F.exp(-total))


def _add(node: Node, x: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
    if node.feature < 0:
        total[rows] += node.value
        return
    low = x[rows, node.feature] <= node.threshold
    _add(node.left, x, rows[low], total)
    _add(node.right, x, rows[~low], total)


def _column(node: Node, features: list[Column]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    low = features[node.feature] <= F.lit(node.threshold)
    return F.when(low, _column(node.left, features)).otherwise(_column(node.right, features))


def _grow(x, g, h, rows, depth, cuts, shrink, ridge, least) -> Node:
    node = Node(value=float(-shrink * g[rows].sum() / (h[rows].sum() + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    whole, best = g[rows].sum() ** 2 / (h[rows].sum() + ridge), (1e-9, -1, 0.0)
    for k, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[rows, k], side="left")
        gs = np.cumsum(np.bincount(bins, weights=g[rows], minlength=len(edges) + 1))
        hs = np.cumsum(np.bincount(bins, weights=h[rows], minlength=len(edges) + 1))
        ns = np.cumsum(np.bincount(bins, minlength=len(edges) + 1))
        gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - whole
        gain[(ns < least) | (ns[-1] - ns < least)] = 0
        at = int(gain[:-1].argmax())
        if gain[at] > best[0]:
            best = (gain[at], k, float(edges[at]))
    if best[1] < 0:
        return node
    low = x[rows, best[1]] <= best[2]
    args = (depth - 1, cuts, shrink, ridge, least)
    node.feature, node.threshold = best[1], best[2]
    node.left, node.right = _grow(x, g, h, rows[low], *args), _grow(x, g, h, rows[~low], *args)
    return node


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, shrink: float = 0.3, ridge: float = 1.0, least: int = 5
) -> Boosted:
    """Boosted trees of the rows x with classes y; without both classes, the constant rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(bias=float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        return model
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, 33)[:-1])) for col in x.T]
    total = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(x)), depth, cuts, shrink, ridge, least)
        _add(tree, x, np.arange(len(x)), total)
        model.trees.append(tree)
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Least score from which on at least ``precision`` of held-out rows are of class 1; 2.0 if none."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # ties stand or fall together
    good = np.flatnonzero((hits >= precision) & last) if len(y) else []
    return float(scores[order][good[-1]]) if len(good) else 2.0
