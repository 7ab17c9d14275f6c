"""Queries as score expressions: nearest, recommend, discover, context, relevance feedback.

Example vectors are literals by the time they come here, so every query is one narrow expression over the
vector column, whatever the number of examples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import fast_sigmoid, max_sim, raw_score, reported, scaled_fast_sigmoid, sparse_dot

EPSILON = 1.1920929e-07


class Similarity:
    """Raw, larger-better similarity of a vector column to a literal example."""

    def __init__(self, column: Column, kind: str, distance: str, unit: bool = False, own: Column | None = None):
        self.column, self.kind, self.distance, self.unit, self.own = column, kind, distance, unit, own

    def __call__(self, example) -> Column:
        if self.kind == "sparse":
            return F.coalesce(sparse_dot(self.column, example), F.lit(0.0))
        if self.kind == "multi":
            return max_sim(self.column, example, self.distance)
        return raw_score(self.column, example, self.distance, self.unit, self.own)

    def nearest(self, example) -> Column:
        """The reported score; null for a sparse vector that shares no index."""
        if self.kind == "sparse":
            return sparse_dot(self.column, example)
        return self(example) if self.kind == "multi" else reported(self(example), self.distance)


def average(positives: list, negatives: list):
    """2 mean(positives) - mean(negatives); without negatives the mean of the positives."""
    if not positives:
        raise ValueError("the average needs a positive example")
    kinds = {type(x) for x in positives + negatives}
    if len(kinds) > 1:
        raise ValueError("examples of different kinds")
    if isinstance(positives[0], dict):
        mean = lambda xs: {i: sum(x.get(i, 0.0) for x in xs) / len(xs) for i in sorted({i for x in xs for i in x})}
        p, n = mean(positives), mean(negatives) if negatives else None
        return p if n is None else {i: 2 * p.get(i, 0.0) - n.get(i, 0.0) for i in sorted({*p, *n})}
    if isinstance(positives[0][0], list):
        return [r for x in positives for r in x] + [[-v for v in r] for x in negatives for r in x]
    mean = lambda xs: [sum(c) / len(xs) for c in zip(*xs, strict=True)]
    p = mean(positives)
    return p if not negatives else [a + a - b for a, b in zip(p, mean(negatives), strict=True)]


def best_score(s: Similarity, positives: list, negatives: list) -> Column:
    low = F.lit(float("-inf"))
    p = reduce(F.greatest, map(s, positives), low) if positives else low
    n = reduce(F.greatest, map(s, negatives), low) if negatives else low
    return F.when(p > n, _bounded(p)).otherwise(-_bounded(n))


def _bounded(x: Column) -> Column:
    return F.when(x == float("-inf"), F.lit(0.0)).otherwise(scaled_fast_sigmoid(x))


def sum_scores(s: Similarity, positives: list, negatives: list) -> Column:
    return reduce(lambda a, b: a + b, [s(p) for p in positives] + [-s(n) for n in negatives], F.lit(0.0))


def discover(s: Similarity, target, pairs: list) -> Column:
    ranks = [F.signum(s(p) - s(n)) for p, n in pairs]
    return reduce(lambda a, b: a + b, ranks, F.lit(0.0)) + scaled_fast_sigmoid(s(target))


def context(s: Similarity, pairs: list) -> Column:
    losses = [fast_sigmoid(F.least(s(p) - s(n) - EPSILON, F.lit(0.0))) for p, n in pairs]
    return reduce(lambda a, b: a + b, losses, F.lit(0.0))


def feedback(s: Similarity, target, scored: list[tuple], a: float, b: float, c: float) -> Column:
    """scored: (example, score). Every pair with a larger and a smaller score counts."""
    out = s(target) * a
    for x, high in scored:
        for y, low in scored:
            if high > low:
                out = out + (s(x) - s(y)) * ((high - low) ** b * c)
    return out
