"""Gradient-boosted trees for small labelled sets, as SQL expressions over named features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

Row = Mapping[str, float]


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: str = ""
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def at(self, row: Row) -> float:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value

    def sql(self, prefix: str) -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {prefix}{self.feature} <= {self.cut!r}D THEN {self.low.sql(prefix)} ELSE {self.high.sql(prefix)} END"


def _grow(rows: Sequence[Row], grad: Sequence[float], hess: Sequence[float], at: list[int], depth: int, ridge: float) -> Node:
    g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
    leaf = Node(value=round(-g / (h + ridge), 6))
    best, where = 1e-6, None
    for name in sorted(rows[at[0]]) if depth else ():
        sums: dict[float, list[float]] = {}
        for i in at:
            s = sums.setdefault(rows[i][name], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        gl = hl = 0.0
        values = sorted(sums)
        for v, w in zip(values, values[1:], strict=False):
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best:
                best, where = gain, (name, (v + w) / 2)
    if where is None:
        return leaf
    name, cut = where
    low, high = [i for i in at if rows[i][name] <= cut], [i for i in at if rows[i][name] > cut]
    return Node(feature=name, cut=cut, low=_grow(rows, grad, hess, low, depth - 1, ridge), high=_grow(rows, grad, hess, high, depth - 1, ridge))


@dataclass(frozen=True)
class Boosted:
    """Log-odds are the sum of the trees."""

    trees: tuple[Node, ...]

    @classmethod
    def fit(cls, rows: Sequence[Row], labels: Sequence[int], trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
        score, grown = [0.0] * len(rows), []
        for _ in range(trees):
            p = [1 / (1 + math.exp(-s)) for s in score]
            tree = _grow(rows, [a - b for a, b in zip(p, labels, strict=True)], [a * (1 - a) for a in p], list(range(len(rows))), depth, ridge)
            grown.append(tree)
            score = [s + rate * tree.at(r) for s, r in zip(score, rows, strict=True)]
        return cls(tuple(_scaled(t, rate) for t in grown))

    def score(self, row: Row) -> float:
        return sum(t.at(row) for t in self.trees)

    def sql(self, prefix: str = "") -> str:
        return " + ".join(f"({t.sql(prefix)})" for t in self.trees)

    def threshold(self, rows: Sequence[Row], labels: Sequence[int], precision: float) -> float:
        """The least log-odds above which held-out rows are right with this precision."""
        scored = sorted(zip(map(self.score, rows), labels, strict=True), reverse=True)
        best, right = math.inf, 0
        for k, (s, y) in enumerate(scored, 1):
            right += y
            if right >= precision * k and (k == len(scored) or scored[k][0] < s):
                best = (s + scored[k][0]) / 2 if k < len(scored) else s - 1e-6
        return best


def _scaled(node: Node, rate: float) -> Node:
    if node.low is None:
        return Node(value=round(node.value * rate, 6))
    return Node(feature=node.feature, cut=node.cut, low=_scaled(node.low, rate), high=_scaled(node.high, rate))
