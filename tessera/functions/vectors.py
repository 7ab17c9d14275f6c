"""Similarities of dense, multi and sparse vectors, and quantisers, as column expressions.

Raw scores are larger-better for every distance; `reported` turns them into what a user sees. One example
is scored by higher-order functions in the JVM (measured three times as fast as an unrolled sum, whose
code is too large to be compiled well); many examples at once by one matrix product for each Arrow batch.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("Cosine", "Dot", "Euclid", "Manhattan")
#: With more examples than this a scan is scored in Arrow batches.
BY_MATRIX = 3


def larger_better(distance: str) -> bool:
    return distance in ("Cosine", "Dot")


def normalised(vector: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in vector))
    return [x / n for x in vector] if n else list(vector)


def _sum(terms: list[Column]) -> Column:
    """A balanced tree: a chain of thousands of additions would nest too deeply."""
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i : i + 8]) for i in range(0, len(terms), 8)]
    return terms[0] if terms else F.lit(0.0)


def _literal(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b, f), F.lit(0.0), lambda t, x: t + x)


def _against(v: Column, q, f) -> Column:
    """Sum of f(v_i, q_i); q is a list of numbers or a column."""
    return _fold(v, q.cast("array<double>") if isinstance(q, Column) else _literal(q), f)


def dot(v: Column, q) -> Column:
    return _against(v, q, lambda a, b: a * b)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x))


def raw_score(v: Column, q, distance: str, unit: bool = False, own: Column | None = None) -> Column:
    """unit: v is stored with length 1 (cosine collections normalise when they write). own: a column with
    the length of v, for plans that score several examples."""
    if distance == "Dot":
        return dot(v, q)
    if distance == "Cosine":
        if isinstance(q, Column):
            n = norm(q)
            s = dot(v, q) / F.when(n == 0, F.lit(1.0)).otherwise(n)
        else:
            s = dot(v, normalised(q))
        if unit:
            return s
        own = norm(v) if own is None else own
        return s / F.when(own == 0, F.lit(1.0)).otherwise(own)
    if distance == "Euclid":
        return -_against(v, q, lambda a, b: (a - b) * (a - b))
    if distance == "Manhattan":
        return -_against(v, q, lambda a, b: F.abs(a - b))
    raise ValueError(f"unknown distance {distance}")


def reported(raw: Column, distance: str) -> Column:
    return {"Euclid": F.sqrt(F.abs(raw)), "Manhattan": F.abs(raw)}.get(distance, raw)


def scores_of_many(v: Column, queries: list[list[float]], distance: str) -> Column:
    """Raw scores against all queries as one array, a matrix product for each Arrow batch."""
    m = np.array([normalised(q) if distance == "Cosine" else q for q in queries], dtype=np.float64)

    @F.arrow_udf("array<double>")
    def score(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m.shape[1])
        if distance in ("Cosine", "Dot"):
            s = x @ m.T
            if distance == "Cosine":
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = s / np.where(n == 0, 1.0, n)
        else:
            power = 2 if distance == "Euclid" else 1
            s = np.stack([-(np.abs(x - q) ** power).sum(1) for q in m], axis=1)
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(m))
        return pa.ListArray.from_arrays(ends, pa.array(s.ravel()))

    return score(v)


def max_sim(rows: Column, query: list[list[float]], distance: str = "Dot") -> Column:
    """Late interaction: for each row of the query the best row of the point, summed."""
    return _sum([F.array_max(F.transform(rows, _scored(q, distance))) for q in query])


def _scored(q: list[float], distance: str):
    return lambda v: raw_score(v, q, distance)


def sparse_dot(v: Column, query: dict[int, float]) -> Column:
    """Null if no index is shared. v: struct of indices and values."""
    q = F.create_map(*[F.lit(x) for i, w in sorted(query.items()) for x in (int(i), float(w))])
    pairs = F.filter(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("w")), lambda p: F.array_contains(F.array(*[F.lit(int(i)) for i in sorted(query)]), p["i"].cast("int")))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda t, p: t + p["w"].cast("double") * F.element_at(q, p["i"].cast("int"))))


def sparse_combine(a: Column, b: Column, op) -> Column:
    """Maps of index to value, over the union of their indices; a missing value counts as 0."""
    return F.map_zip_with(a, b, lambda k, x, y: op(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def fast_sigmoid(x: Column) -> Column:
    return x / (F.lit(1.0) + F.abs(x))


def scaled_fast_sigmoid(x: Column) -> Column:
    return (fast_sigmoid(x) + 1.0) * 0.5


# quantisers


def scalar_codes(v: Column, low: float, high: float) -> Column:
    """127 steps between two bounds."""
    step = (high - low) / 127.0
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(127), F.round((x.cast("double") - low) / step).cast("int"))))


def scalar_dot(codes: Column, q: list[float], low: float, high: float) -> Column:
    step = (high - low) / 127.0
    return _against(codes, q, lambda c, x: (c * step + low) * x)


def binary_code(v: Column, dim: int) -> Column:
    """One bit for each component, set if it is positive; 63 bits to a long."""
    words = []
    for s in range(0, dim, 63):
        words.append(_sum([F.when(v[i] > 0, F.lit(1 << (i - s))).otherwise(F.lit(0)).cast("long") for i in range(s, min(s + 63, dim))]))
    return F.array(*words)


#: Smaller deviations count as none: the step between 32-bit numbers at 1.
SMALLEST = 2.0**-23


def two_bit_code(v: Column, means: list[float], deviations: list[float], fold: bool = False) -> Column:
    """Two bits for each component: none up to two thirds of a deviation below its mean, both from two
    thirds above it on, else the first. Without a deviation the first says whether the component is positive.
    `fold` halves the second bits by joining neighbours (one and a half bits)."""
    level = [(v[i].cast("double") - m) / s if s >= SMALLEST else None for i, (m, s) in enumerate(zip(means, deviations, strict=True))]
    first = [v[i] > 0 if x is None else x > -2 / 3 for i, x in enumerate(level)]
    second = [F.lit(False) if x is None else x >= 2 / 3 for x in level]
    if fold:
        second = [second[i] | second[i + 1] if i + 1 < len(second) else second[i] for i in range(0, len(second), 2)]
    bits = first + second
    return F.array(*[_sum([F.when(b, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, b in enumerate(bits[s : s + 63])]) for s in range(0, len(bits), 63)])


def hamming(a: Column, b) -> Column:
    """Bits in which two codes differ; b is a column or a list of longs."""
    if isinstance(b, Column):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return _sum([F.bit_count(a[i].bitwiseXOR(F.lit(int(x)))) for i, x in enumerate(b)])


def binary_code_of(q: list[float]) -> list[int]:
    return [sum(1 << (i - s) for i in range(s, min(s + 63, len(q))) if q[i] > 0) for s in range(0, len(q), 63)]


def product_codes(v: Column, books: list[list[list[float]]]) -> Column:
    """books: for each chunk of the vector its centroids; the nearest one's number for each chunk, the first in
    case of ties; null stays null. A matrix product for each chunk and Arrow batch, so that the plan does not
    grow with the books."""
    chunks = [np.array(b, dtype=np.float64) for b in books]
    starts = np.cumsum([0, *[c.shape[1] for c in chunks]])

    @F.arrow_udf("array<int>")
    def codes(batch: pa.Array) -> pa.Array:
        held = batch.drop_null()
        x = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, starts[-1])
        near = [np.argmin((c**2).sum(1) - 2 * x[:, a:b] @ c.T, axis=1) for c, a, b in zip(chunks, starts[:-1], starts[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(chunks)), pa.array(np.stack(near, axis=1).ravel().astype(np.int32)))
        valid = batch.is_valid().to_numpy(zero_copy_only=False)
        return lists.take(pa.array(np.cumsum(valid) - 1, pa.int64(), mask=~valid))

    return codes(v)
