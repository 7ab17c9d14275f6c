"""Partitioning of points and routing of queries to partitions.

Routes are decided on the driver from a bounded table (centroids, sampled nodes) and become literal
partition predicates, so that Spark never lists or reads the other partitions.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import scores_of_many


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def select_shards(shards: list, keys: list | None = None, fallback=None) -> list:
    """All shards, those of the keys, or a fallback where a key has none."""
    if keys is None:
        return list(shards)
    found = [k for k in keys if k in shards]
    if len(found) < len(keys):
        if fallback is None:
            raise KeyError(f"no shards {sorted(set(keys) - set(shards), key=str)}")
        found.append(fallback)
    return list(dict.fromkeys(found))


def nearest_centroid(v: Column, centroids: np.ndarray) -> Column:
    """Index of the nearest centroid, the first in case of ties; a matrix product for each Arrow batch."""

    @F.arrow_udf("int")
    def nearest(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centroids.shape[1])
        return pa.array(np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1), pa.int32())

    return nearest(v)


def within_alpha(df: DataFrame, v: str, centroids: np.ndarray, alpha: float) -> DataFrame:
    """A row for each shard whose squared distance is at most alpha^2 times the least: adds shard."""
    full = F.transform(scores_of_many(F.col(v), centroids.tolist(), "Euclid"), lambda x: -x)
    near = F.transform("__d", lambda x, i: F.when(x <= F.array_min("__d") * alpha**2, i))
    return df.withColumn("__d", full).withColumn("shard", F.explode(F.filter(near, lambda i: i.isNotNull()))).drop("__d")


def route_nprobe(query: list[float], centroids: np.ndarray, nprobe: int, cosine: bool = True) -> list[int]:
    """The nprobe nearest centroids by squared distance, ties to the smaller shard."""
    q = np.array(query, dtype=np.float64)
    n = np.linalg.norm(q)
    q = q / n if cosine and n else q
    d = ((centroids - q) ** 2).sum(1)
    return np.lexsort((np.arange(len(d)), d))[:nprobe].tolist()


def route_two_tier(query: list[float], nodes: np.ndarray, members: list[list[int]], upper_k: int, base: int, factor: int) -> tuple[list[int], dict[int, int]]:
    """The shards of the upper_k nearest sampled nodes (cosine), and for each shard base + factor * hits."""
    q = np.array(query, dtype=np.float64)
    s = nodes @ q / np.maximum(np.linalg.norm(nodes, axis=1) * np.linalg.norm(q), 1e-30)
    top = np.lexsort((np.arange(len(s)), -s))[:upper_k]
    hits: dict[int, int] = {}
    for i in top:
        for shard in members[i]:
            hits[shard] = hits.get(shard, 0) + 1
    return sorted(hits), {s: base + factor * n for s, n in hits.items()}


def may_route(request: dict, routed: str) -> bool:
    """Only a plain nearest query on the routed dense vector goes to few shards."""
    q = request.get("query")
    plain = isinstance(q, (int, list)) or (isinstance(q, dict) and set(q) == {"nearest"})
    return plain and not any(request.get(k) for k in ("filter", "prefetch", "lookup_from")) and request.get("using", "") == routed and not (request.get("params") or {}).get("exact")


def kmeans(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k-means++ and Lloyd's algorithm on a bounded sample; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(1, min(k, len(sample))):
        d = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() else sample[rng.integers(len(sample))])
    centres = np.array(centres)
    for _ in range(rounds):
        of = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = sample[of == c].mean(0)
    return centres


def balanced(sample: np.ndarray, centroids: np.ndarray, cap: float = 1.5) -> np.ndarray:
    """Greedy assignment by globally rising distance, no cluster above cap times the mean size."""
    d = ((sample[:, None] - centroids[None]) ** 2).sum(2)
    most = int(np.ceil(cap * len(sample) / len(centroids)))
    out, size = np.full(len(sample), -1), np.zeros(len(centroids), int)
    for flat in np.argsort(d, axis=None, kind="stable"):
        i, c = divmod(int(flat), len(centroids))
        if out[i] < 0 and size[c] < most:
            out[i], size[c] = c, size[c] + 1
    return out


def converge(neighbours: np.ndarray, shards: np.ndarray, rounds: int = 10, frozen: int = 0) -> np.ndarray:
    """Majority votes of each sampled node's neighbours until nothing moves; shards of `frozen` nodes or
    fewer keep theirs. Ties stay, then go to the smaller shard."""
    shards = shards.copy()
    for _ in range(rounds):
        size = np.bincount(shards)
        moved = shards.copy()
        for i, near in enumerate(neighbours):
            if size[shards[i]] <= frozen:
                continue
            votes = np.bincount(shards[near], minlength=len(size))
            if votes.max(initial=0) > votes[shards[i]]:
                moved[i] = int(votes.argmax())
        if (moved == shards).all():
            break
        shards = moved
    return shards


def shards_by_votes(votes: DataFrame, delta: int = 1) -> DataFrame:
    """From (id, shard, votes): the shards within delta of an id's most votes, if these are two or more;
    else the best one, ties to the smaller shard."""
    best = votes.groupBy("id").agg(F.max("votes").alias("most"), F.max(F.struct("votes", (-F.col("shard")).alias("s"))).alias("b"))
    near = (F.col("votes") >= F.col("most") - delta) & (F.col("most") >= 2)
    return votes.join(best, "id").where(near | (F.col("shard") == -F.col("b.s"))).select("id", "shard")


def node_weights(near: DataFrame, shard_of: DataFrame, delta: int = 0) -> DataFrame:
    """The load of sampled nodes. near: (id, place, node), the nodes nearest to each point in order; shard_of:
    (node, shard). Of each shard that holds a point by votes, the first of its nodes counts the point."""
    voted = near.join(shard_of, "node")
    first = voted.groupBy("id", "shard").agg(F.count("*").alias("votes"), F.min_by("node", "place").alias("node"))
    kept = first.join(shards_by_votes(first.select("id", "shard", "votes"), delta), ["id", "shard"])
    counted = kept.groupBy("node").agg(F.count("*").alias("weight"))
    return shard_of.select("node").join(counted, "node", "left").select("node", F.coalesce("weight", F.lit(0)).alias("weight"))


def lloyd_step(df: DataFrame, v: str, centroids: np.ndarray) -> DataFrame:
    """One step over all rows: (shard, v), the mean of the rows nearest to each centroid. Sums are combined in
    the map tasks, so that a task sends a vector for each shard."""
    of = df.select(nearest_centroid(F.col(v), centroids).alias("shard"), F.posexplode(v).alias("i", "x"))
    means = of.groupBy("shard", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return means.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("v"))


def split_large(shards: np.ndarray, points: np.ndarray, cap: float = 1.5, least: float = 0.3, seed: int = 0) -> np.ndarray:
    """Splits shards above cap times the ideal size in two, if both parts keep `least` of it."""
    shards = shards.copy()
    ideal = len(shards) / max(1, len(np.unique(shards)))
    for s in np.unique(shards):
        own = np.flatnonzero(shards == s)
        if len(own) > cap * ideal:
            c = kmeans(points[own], 2, seed=seed)
            half = ((points[own] - c[0]) ** 2).sum(1) > ((points[own] - c[-1]) ** 2).sum(1)
            if min(half.sum(), (~half).sum()) >= least * ideal:
                shards[own[half]] = shards.max() + 1
    return shards


def place(loads: np.ndarray, peers: int) -> list[int]:
    """Greedy placement of shards on peers: loads (queries, shards); each shard, heaviest first, goes where
    the mean of the largest peer load grows least."""
    held, out = np.zeros((len(loads), peers)), [0] * loads.shape[1]
    for s in np.argsort(-loads.sum(0), kind="stable"):
        cost = []
        for p in range(peers):
            new = held.copy()
            new[:, p] += loads[:, s]
            cost.append((new.max(1).mean(), held[:, p].sum(), p))
        out[s] = min(cost)[2]
        held[:, out[s]] += loads[:, s]
    return out


def without_copies(found: DataFrame, block: int, larger: bool = True) -> DataFrame:
    """Results whose ids are copies, id = copy * block + source + 1: the best copy of each source."""
    source = F.pmod(F.col("id") - 1, F.lit(block)).alias("id")
    best = F.max("score") if larger else F.min("score")
    return found.select(source, "score").groupBy("id").agg(best.alias("score"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id and the share of its k true ids that were found."""
    hits = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(k)).alias("recall"))


def checksum(artifact: dict) -> str:
    """Of everything in an artifact but the checksum itself."""
    return hashlib.sha256(json.dumps({k: v for k, v in artifact.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()


def validate(artifact: dict, shards: int) -> None:
    """A routing artifact names its schema, dense shard ids from 0, vectors of one width and, if it has one, the
    checksum of its contents."""
    if "checksum" in artifact and artifact["checksum"] != checksum(artifact):
        raise ValueError("the artifact does not fit its checksum")
    ids = sorted({s for m in artifact["members"] for s in m})
    if artifact.get("version") != 1 or ids != list(range(shards)):
        raise ValueError("the artifact is not of version 1, or its shards are not dense")
    if len({len(v) for v in artifact["nodes"]}) > 1 or len(artifact["nodes"]) != len(artifact["members"]):
        raise ValueError("the artifact's nodes differ in width or number")
