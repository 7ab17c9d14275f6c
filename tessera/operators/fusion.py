"""Fusion of ranked lists, and diversity re-ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(larger: bool = True) -> list[Column]:
    """Equal scores: the larger id first if larger scores are better, else the smaller."""
    return [F.desc("score"), F.desc("id")] if larger else [F.asc("score"), F.asc("id")]


def _tagged(sources: list[tuple[DataFrame, bool]]) -> DataFrame:
    parts = [df.select("id", "score", F.lit(i).alias("source"), F.lit(larger).alias("larger")) for i, (df, larger) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def rrf(sources: list[tuple[DataFrame, bool]], k: float = 2, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists, each with its own direction."""
    weights = weights or [1.0] * len(sources)
    if len(weights) != len(sources):
        raise ValueError("as many weights as sources")
    rows = _tagged(sources)
    signed = F.when(F.col("larger"), -F.col("score")).otherwise(F.col("score"))
    # one direction for each list; ids of any type that has an order
    tie = [F.when(F.col("larger"), F.col("id")).desc(), F.when(~F.col("larger"), F.col("id")).asc()]
    position = F.row_number().over(Window.partitionBy("source").orderBy(signed, *tie))  # lists are as long as their limits
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("source") + 1)
    part = F.when(w <= 0, F.lit(0.0)).otherwise(1.0 / (position / w + k - 1.0))
    return rows.withColumn("part", part).groupBy("id").agg(F.sum("part").alias("score"))


def dbsf(sources: list[tuple[DataFrame, bool]]) -> DataFrame:
    """Distribution-based score fusion: three deviations either side of a list's mean become 0 and 1."""
    w = Window.partitionBy("source")
    mean, dev = F.avg("score").over(w), F.stddev_samp("score").over(w)
    unit = F.when(dev.isNull() | (dev == 0), F.lit(0.5)).otherwise((F.col("score") - (mean - 3 * dev)) / (6 * dev))
    signed = F.when(F.col("larger"), unit).otherwise(1.0 - unit)
    return _tagged(sources).withColumn("part", signed).groupBy("id").agg(F.sum("part").alias("score"))


def min_max(df: DataFrame, by: str) -> DataFrame:
    """Scores of each list between 0 and 1."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("score", F.when(high == low, F.lit(0.5)).otherwise((F.col("score") - low) / (high - low)))


def mmr(candidates: list[tuple[int, float, list[float]]], similarity, diversity: float = 0.5, limit: int = 10) -> list[tuple[int, float]]:
    """Maximal marginal relevance over the few candidates of a request: (id, score, vector) by falling
    relevance. similarity(matrix) gives all pairs. Returns ids with their own scores, in the order chosen;
    equal marginal relevance goes to the smaller id."""
    if not candidates:
        return []
    trade = 1.0 - diversity
    ids = [c[0] for c in candidates]
    relevance = np.array([c[1] for c in candidates])
    pairs = similarity(np.array([c[2] for c in candidates], dtype=np.float64))
    left, chosen = list(range(len(ids))), []
    nearest = np.full(len(ids), -np.inf)
    while left and len(chosen) < limit:
        gain = {i: relevance[i] if not chosen else trade * relevance[i] - (1 - trade) * nearest[i] for i in left}
        best = min(left, key=lambda i: (-gain[i], ids[i]))
        left.remove(best)
        chosen.append(best)
        nearest = np.maximum(nearest, pairs[best])
    return [(ids[i], float(relevance[i])) for i in chosen]
