"""Search on quantised codes: a cheap pass over narrow code columns keeps `oversampling` times the limit,
an exact pass rescores these."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import binary_code, binary_code_of, dot, hamming, normalised, product_codes, scalar_codes, scalar_dot
from tessera.operators.fusion import ordering
from tessera.operators.routing import kmeans


def bounds(df: DataFrame, vector: str, quantile: float | None = None) -> tuple[float, float]:
    """Least and largest component, or the quantiles that leave (1 - quantile) / 2 on either side."""
    flat = df.select(F.explode(vector).alias("x"))
    if quantile is None:
        row = flat.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
        return float(row["a"]), float(row["b"])
    rest = (1 - quantile) / 2
    a, b = flat.agg(F.percentile_approx("x", [rest, 1 - rest], 100_000).alias("q")).first()["q"]
    return float(a), float(b)


def _rescored(df: DataFrame, id_col: str, vector: str, coarse: DataFrame, q: list[float], limit: int) -> DataFrame:
    rows = df.join(F.broadcast(coarse.select(id_col)), id_col).select(F.col(id_col).alias("id"), dot(F.col(vector), q).alias("score"))
    return rows.orderBy(*ordering()).limit(limit)


def scalar_search(df: DataFrame, id_col: str, vector: str, query: list[float], limit: int = 10, oversampling: float = 2.0, quantile: float | None = None, low_high: tuple[float, float] | None = None) -> DataFrame:
    q = normalised(query)
    low, high = low_high or bounds(df, vector, quantile)
    coded = df.select(id_col, scalar_codes(F.col(vector), low, high).alias("codes"))
    coarse = coded.select(id_col, scalar_dot(F.col("codes"), q, low, high).alias("s")).orderBy(F.desc("s"), F.desc(id_col)).limit(int(limit * oversampling))
    return _rescored(df, id_col, vector, coarse, q, limit)


def binary_search(df: DataFrame, id_col: str, vector: str, query: list[float], limit: int = 10, oversampling: float = 4.0) -> DataFrame:
    q = normalised(query)
    coded = df.select(id_col, binary_code(F.col(vector), len(q)).alias("code"))
    coarse = coded.select(id_col, hamming(F.col("code"), binary_code_of(q)).alias("s")).orderBy(F.asc("s"), F.desc(id_col)).limit(int(limit * oversampling))
    return _rescored(df, id_col, vector, coarse, q, limit)


def product_books(sample: np.ndarray, chunk: int, size: int = 256, seed: int = 0) -> list[list[list[float]]]:
    """For each chunk of the vectors its centroids, trained on a bounded sample."""
    return [kmeans(sample[:, s : s + chunk], size, seed=seed).tolist() for s in range(0, sample.shape[1], chunk)]


def product_search(df: DataFrame, id_col: str, vector: str, query: list[float], books: list[list[list[float]]], limit: int = 10, oversampling: float = 4.0) -> DataFrame:
    """The query's product with each centroid is a table of literals; a code's score is a look-up for each chunk.
    Equal codes have equal scores to nine places, of which the larger ids stay."""
    q = normalised(query)
    parts, at = [], 0
    for book in books:
        wide = len(book[0])
        parts.append([float(np.dot(q[at : at + wide], c)) for c in book])
        at += wide
    coded = df.select(id_col, product_codes(F.col(vector), books).alias("codes"))
    score = reduce(lambda a, b: a + b, [F.array(*map(F.lit, table))[F.col("codes")[i]] for i, table in enumerate(parts)])
    coarse = coded.select(id_col, F.round(score, 9).alias("s")).orderBy(F.desc("s"), F.desc(id_col)).limit(int(limit * oversampling))
    return _rescored(df, id_col, vector, coarse, q, limit)
