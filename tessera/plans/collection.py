"""Collections: a DataFrame of points with typed or variant payload, and every query over it.

`Collection.query` takes a request as a dict and composes one lazy DataFrame: leaves score and cut (id,
score) rows, stages rescore or fuse them, payload and vectors are joined to the final ids only. The driver
holds nothing but what a request names: example vectors, limits, and the candidates of a diversity query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.formula import Formula
from tessera.functions.paths import parse, project
from tessera.functions.text import Tokenizer
from tessera.functions.times import parsed
from tessera.functions.vectors import BY_MATRIX, larger_better, norm, normalised, reported, scores_of_many
from tessera.operators import fusion
from tessera.plans import scoring
from tessera.plans.predicates import Context, compile_filter, merge

LIMIT, GROUP_SIZE, DEPTH = 10, 3, 64
#: Up to this many ids are joined by broadcast.
BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class Vector:
    """kind: dense, multi or sparse. unit: stored vectors have length 1."""

    column: str
    distance: str = "Cosine"
    kind: str = "dense"
    unit: bool = False


@dataclass(frozen=True)
class Collection:
    points: DataFrame
    id: str
    vectors: dict[str, Vector] = field(default_factory=dict)
    payload: str | None = None  # a struct or VARIANT column; None: all other columns
    tokenizers: dict[str, Tokenizer] = field(default_factory=dict)
    null_indexed: frozenset[str] = frozenset()
    shard: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def context(self) -> Context:
        schema = self.points.schema
        root = variant = None
        if self.payload:
            kind = schema[self.payload].dataType
            if isinstance(kind, T.VariantType):
                variant, schema = F.col(self.payload), T.StructType()
            else:
                root, schema = F.col(self.payload), kind
        vectors = {n: F.col(v.column) for n, v in self.vectors.items()}
        return Context(schema, F.col(self.id), root, variant, vectors, self.tokenizers, set(self.null_indexed))

    # filters, counts, lists

    def where(self, spec: dict | None, shards: list | None = None) -> DataFrame:
        df = self.points
        if shards is not None:  # a partition column: other shards are never read
            df = df.where(F.col(self.shard).isin(shards))
        return df.where(compile_filter(spec, self.context())) if spec else df

    def count(self, spec: dict | None = None) -> DataFrame:
        return self.where(spec).agg(F.count("*").alias("count"))

    def count_estimate(self, spec: dict | None = None, bits: int = 7, seed: int = 0) -> DataFrame:
        """An approximate count from the points whose hashed id begins with `bits` zero bits (1 of 2^bits): count,
        and low and high at two standard errors. The filter is evaluated on these only."""
        ids = F.col(self.id).cast("string")
        drawn = F.substring(F.md5(F.concat_ws(":", ids, F.lit(str(seed)))), 1, 8) < F.lit(f"{1 << (32 - bits):08x}")
        n, share = F.count("*").cast("double"), 2.0**-bits
        error = 2 * F.sqrt(n * (1 - share)) / share
        found = self.narrowed(points=self.points.where(drawn)).where(spec)
        return found.agg((n / share).alias("count"), F.greatest(F.lit(0.0), n / share - error).alias("low"), (n / share + error).alias("high"))

    def retrieve(self, ids: list, with_payload=True, with_vector=False) -> DataFrame:
        """The points with these ids; missing ones are absent, repeated ids come once."""
        found = self._by_ids(self.points, list(dict.fromkeys(ids)))
        return self._dressed(found.select(F.col(self.id).alias("id")), with_payload, with_vector, len(ids))

    def _by_ids(self, df: DataFrame, ids: list) -> DataFrame:
        if len(ids) <= 1000:
            return df.where(F.col(self.id).isin(ids) if ids else F.lit(False))
        keys = self.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(self.id, self.points.schema[self.id].dataType)]))
        return df.join(F.broadcast(keys) if len(ids) <= BROADCAST_IDS else keys, self.id, "left_semi")

    def scroll(self, spec: dict | None = None, limit: int = LIMIT, offset=None, order_by: dict | str | None = None, with_payload=True, with_vector=False) -> DataFrame:
        """A page of points by id, from `offset` on, or by a payload value. One row more than the page tells
        the next offset: see next_page."""
        if limit < 1:
            raise ValueError("limit is 1 at least")
        df = self.where(spec)
        if order_by is None:
            df = df.where(F.col(self.id) >= offset) if offset is not None else df
            return self._dressed(df.select(F.col(self.id).alias("id")).orderBy("id").limit(limit), with_payload, with_vector, limit).orderBy("id")
        if offset is not None:
            raise ValueError("order_by has start_from, no offset")
        page, asc = self._ordered(df, order_by)
        page = page.orderBy(*self._direction(asc)).limit(limit)
        return self._dressed(page, with_payload, with_vector, limit).orderBy(*self._direction(asc))

    def next_page(self, spec: dict | None, limit: int, offset=None):
        """The id with which the next page begins, or None."""
        df = self.where(spec)
        df = df.where(F.col(self.id) >= offset) if offset is not None else df
        rows = df.select(F.col(self.id).alias("id")).orderBy("id").limit(limit + 1).collect()
        return rows[limit]["id"] if len(rows) > limit else None

    @staticmethod
    def _direction(asc: bool) -> list[Column]:
        return [F.asc("order_value"), F.asc("id")] if asc else [F.desc("order_value"), F.desc("id")]

    def _ordered(self, df: DataFrame, order_by: dict | str) -> tuple[DataFrame, bool]:
        """A row for each value of the field: id, order_value."""
        spec = {"key": order_by} if isinstance(order_by, str) else order_by
        values = self.context().values(spec["key"])
        kind = values.value_type
        if isinstance(kind, T.VariantType):
            read = lambda v: F.try_variant_get(v, "$", "double")
            rows = df.select(F.col(self.id).alias("id"), F.explode(F.coalesce(F.try_variant_get(values.one, "$", "array<variant>"), F.array(values.one))).alias("v")).select("id", read(F.col("v")).alias("order_value"))
        elif isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            column = values.one
            if column is not None and not isinstance(values.type, T.ArrayType):
                rows = df.select(F.col(self.id).alias("id"), column.alias("order_value"))
            else:
                rows = df.select(F.col(self.id).alias("id"), F.explode(values.array()).alias("order_value"))
        else:
            raise ValueError(f"{spec['key']} has neither numbers nor times")
        asc = spec.get("direction", "asc") == "asc"
        rows = rows.where(F.col("order_value").isNotNull())
        if (start := spec.get("start_from")) is not None:
            start = parsed(F.lit(start)) if isinstance(start, str) else F.lit(start)
            rows = rows.where(F.col("order_value") >= start if asc else F.col("order_value") <= start)
        return rows, asc

    def facet(self, key: str, spec: dict | None = None, limit: int | None = LIMIT) -> DataFrame:
        """Values and the number of points that have them, each point once for a value."""
        values = self.context().values(key)
        kind = values.value_type
        if isinstance(kind, T.VariantType):
            flat = F.explode(F.array_distinct(F.transform(F.coalesce(F.try_variant_get(values.one, "$", "array<variant>"), F.array(values.one)), lambda v: F.when(F.schema_of_variant(v).isin("STRING", "BIGINT", "BOOLEAN"), F.try_variant_get(v, "$", "string")))))
        elif isinstance(kind, (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            plain = values.one is not None and not isinstance(values.type, T.ArrayType)
            flat = values.one if plain else F.explode(F.array_distinct(values.array()))
        else:
            raise ValueError(f"{key} has no values to count")
        counted = self.where(spec).select(flat.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("count"))
        counted = counted.orderBy(F.desc("count"), F.asc("value"))
        return counted if limit is None else counted.limit(limit)

    # queries

    def query(self, request: dict) -> DataFrame:
        """id, score and what else the request asks for, best first; a limit of None asks for all rows."""
        narrow, order = self._query(request)
        limit, offset = request.get("limit", LIMIT), request.get("offset", 0)
        if self._kind(request) == "sample":
            offset = 0
        narrow = narrow.orderBy(*order)
        narrow = narrow.offset(offset) if offset else narrow
        narrow = narrow if limit is None else narrow.limit(limit)
        return self._dressed(narrow, request.get("with_payload", False), request.get("with_vector", False), limit).orderBy(*order)

    def query_batch(self, requests: list[dict]) -> DataFrame:
        """The results of independent requests, with query_id. Nearest queries that differ only in their
        vector share one scan."""
        shared = [r for r in requests if self._kind(r) == "nearest" and not r.get("prefetch") and not r.get("with_payload") and not r.get("with_vector") and "score_threshold" not in r]
        alike = {repr((r.get("filter"), r.get("using"), r.get("limit"), r.get("offset"), r.get("lookup_from"))) for r in shared}
        if len(shared) == len(requests) and len(alike) == 1:
            return self._shared_scan(requests)
        return reduce(DataFrame.unionByName, [self.query(r).select(F.lit(i).alias("query_id"), "id", "score") for i, r in enumerate(requests)])

    def _shared_scan(self, requests: list[dict]) -> DataFrame:
        first = requests[0]
        v = self._vector(first)
        s = self._similarity(v)
        inputs = [self._nearest_input(r) for r in requests]
        examples = self._resolve(inputs, first)
        rows = self._measured(self.where(first.get("filter")), v)
        if v.kind == "dense" and len(examples) > BY_MATRIX:
            rows = rows.select(F.col(self.id), scores_of_many(F.col(v.column), examples, v.distance).alias("__raw"))
            each = [reported(F.col("__raw")[i], v.distance) for i in range(len(examples))]
        else:
            each = [s.nearest(e) for e in examples]
        scored = [F.struct(F.lit(i).alias("query_id"), (F.when(F.col(self.id) != x, score) if self._is_id(x) else score).alias("score")) for i, (x, score) in enumerate(zip(inputs, each, strict=True))]
        rows = rows.select(F.col(self.id).alias("id"), F.explode(F.array(*scored)).alias("q")).select("id", "q.query_id", "q.score").where("score is not null")
        larger = larger_better(v.distance) or v.kind != "dense"
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.ordering(larger)))  # cut in each map task first
        offset = first.get("offset", 0)
        top, limit = rows.withColumn("rank", rank), first.get("limit", LIMIT)
        top = top if limit is None else top.where(F.col("rank") <= offset + limit)
        return top.where(F.col("rank") > offset).select("query_id", "id", "score", (F.col("rank") - offset).alias("rank"))

    def _kind(self, request: dict) -> str:
        q = request.get("query")
        if q is None:
            return "fusion-needed" if request.get("prefetch") else "scroll"
        if isinstance(q, dict):
            for k in ("nearest", "recommend", "discover", "context", "relevance_feedback", "order_by", "fusion", "rrf", "formula", "sample"):
                if k in q:
                    return k
            if "indices" in q:
                return "nearest"
            raise ValueError(f"no query of this kind: {sorted(q)}")
        return "nearest"

    def _vector(self, request: dict) -> Vector:
        return self.vectors[request.get("using", "")]

    def _measured(self, rows: DataFrame, v: Vector) -> DataFrame:
        """Rows with the vector; for cosine its length as a column, so that no example computes it again."""
        rows = rows.where(F.col(v.column).isNotNull())
        return rows.withColumn("__length", norm(F.col(v.column))) if v.distance == "Cosine" and v.kind == "dense" and not v.unit else rows

    def _similarity(self, v: Vector) -> scoring.Similarity:
        own = F.col("__length") if v.distance == "Cosine" and v.kind == "dense" and not v.unit else None
        return scoring.Similarity(F.col(v.column), v.kind, v.distance, v.unit, own)

    @staticmethod
    def _is_id(x) -> bool:
        return isinstance(x, (int, str)) and not isinstance(x, bool)

    def _nearest_input(self, request: dict):
        q = request["query"]
        return q["nearest"] if isinstance(q, dict) and "nearest" in q else q

    def _examples(self, request: dict) -> list:
        """All examples that a query names."""
        q, kind = request.get("query"), self._kind(request)
        if kind == "nearest":
            return [self._nearest_input(request)]
        if kind == "recommend":
            return list(q[kind].get("positive", [])) + list(q[kind].get("negative", []))
        pairs = lambda c: [x for p in (c if isinstance(c, list) else [c]) for x in (p["positive"], p["negative"])]
        if kind == "discover":
            return [q[kind]["target"], *pairs(q[kind].get("context", []))]
        if kind == "context":
            return pairs(q[kind])
        if kind == "relevance_feedback":
            return [q[kind]["target"], *[f["example"] for f in q[kind]["feedback"]]]
        return []

    def _resolve(self, inputs: list, request: dict) -> list:
        """Vectors for examples; ids are looked up once, in this collection or another."""
        v = self._vector(request)
        ids = [x for x in inputs if self._is_id(x)]
        found = {}
        if ids:
            source, column = self, v.column
            if look := request.get("lookup_from"):
                source = look["collection"]
                column = source.vectors[look.get("vector", request.get("using", ""))].column
            rows = source._by_ids(source.points, list(dict.fromkeys(ids))).select(F.col(source.id).alias("id"), F.col(column).alias("v")).collect()  # the examples of one request
            found = {r["id"]: r["v"] for r in rows if r["v"] is not None}
            if missing := [i for i in ids if i not in found]:
                raise KeyError(f"no vector for points {missing}")

        def clean(x):
            x = found[x] if self._is_id(x) else x
            if v.kind == "sparse":
                pairs = zip(x["indices"], x["values"], strict=True) if "indices" in x else x.items()
                return {int(i): float(w) for i, w in pairs}
            if v.kind == "multi":
                return [[float(c) for c in r] for r in x]
            x = [float(c) for c in x]
            return normalised(x) if v.distance == "Cosine" else x

        return [clean(x) for x in inputs]

    def _named_ids(self, request: dict) -> list:
        """Referenced points of this collection, which are no results; also those of prefetches."""
        own = [] if request.get("lookup_from") else [x for x in self._examples(request) if self._is_id(x)]
        return own + [i for p in self._prefetches(request) for i in self._named_ids(p)]

    @staticmethod
    def _prefetches(request: dict) -> list[dict]:
        p = request.get("prefetch") or []
        return [p] if isinstance(p, dict) else p

    def _query(self, request: dict) -> tuple[DataFrame, list[Column]]:
        return self._ranked(request)[:2]

    def _ranked(self, request: dict) -> tuple[DataFrame, list[Column], bool]:
        """The rows, their order, and whether that begins with the largest."""
        named = list(dict.fromkeys(self._named_ids(request)))
        without = {"must_not": [{"has_id": named}]} if named else None
        df, larger = self._stage(request, merge(request.get("filter"), without), 0)
        if larger is None:
            return df, [F.col("place").asc()] if "place" in df.columns else [F.asc("id")], False
        if "order_value" in df.columns:
            return df, self._direction(not larger), larger
        return df, fusion.ordering(larger), larger

    def _stage(self, request: dict, spec: dict | None, depth: int) -> tuple[DataFrame, bool | None]:
        """(id, score) rows that are not cut yet, and whether larger is better (None: as they come)."""
        if depth > DEPTH:
            raise ValueError("prefetches are nested too deeply")
        kind, prefetches = self._kind(request), self._prefetches(request)
        threshold = request.get("score_threshold")
        if threshold is not None and kind in ("order_by", "scroll"):
            raise ValueError("this query has no score to cut")
        sources = []
        for p in prefetches:
            df, larger = self._stage(p, merge(p.get("filter"), spec), depth + 1)
            order = self._direction(not larger) if "order_value" in df.columns else [F.asc("place")] if "place" in df.columns else fusion.ordering(larger) if larger is not None else [F.asc("id")]
            limit = p.get("limit", LIMIT)
            cut = df if limit is None else df.orderBy(*order).limit(limit + (request.get("offset", 0) if depth == 0 else 0))
            sources.append((cut, True if larger is None else larger))
        q = request.get("query")
        if kind in ("fusion", "rrf"):
            if not sources:
                raise ValueError("a fusion needs prefetches")
            if kind == "fusion" and q["fusion"] == "dbsf":
                out = fusion.dbsf(sources)
            else:
                params = q.get("rrf") or {}
                out = fusion.rrf(sources, params.get("k", 2), params.get("weights"))
            return (out if threshold is None else out.where(F.col("score") >= threshold)), True
        if kind == "formula":
            if not sources:
                raise ValueError("a formula needs prefetches")
            out = self._formula(q, sources)
            return (out if threshold is None else out.where(F.col("score") >= threshold)), True
        if kind == "fusion-needed":
            raise ValueError("several prefetches need a query that joins them")
        rows = self.where(spec)
        if sources:
            ids = reduce(DataFrame.union, [d.select("id") for d, _ in sources]).distinct()
            rows = rows.join(ids.withColumnRenamed("id", "__id"), F.col(self.id) == F.col("__id"), "left_semi")
        if kind == "scroll":
            return rows.select(F.col(self.id).alias("id"), F.lit(1.0).alias("score")), None
        if kind == "sample":
            seed = q.get("seed")
            key = F.rand() if seed is None else F.md5(F.concat_ws(":", F.col(self.id).cast("string"), F.lit(str(seed))))  # as in matrix_pairs
            return rows.select(F.col(self.id).alias("id"), F.lit(1.0).alias("score"), key.alias("place")), None
        if kind == "order_by":
            page, asc = self._ordered(rows, q["order_by"])
            return page.withColumn("score", F.lit(0.0)), not asc
        v = self._vector(request)
        score, larger = self._score(request, v)
        scored = self._measured(rows, v).select(F.col(self.id).alias("id"), score.alias("score"))
        if v.kind == "sparse" and kind == "nearest":
            scored = scored.where("score is not null")
        if threshold is not None:
            # the distance's direction, whatever the query
            scored = scored.where(F.col("score") > threshold if larger_better(v.distance) or v.kind == "sparse" else F.col("score") < threshold)
        if kind == "nearest" and isinstance(q, dict) and q.get("mmr") is not None:
            return self._mmr(scored, larger, q, v, request), None
        return scored, larger

    def _score(self, request: dict, v: Vector) -> tuple[Column, bool]:
        q, kind, s = request["query"], self._kind(request), self._similarity(v)
        examples = self._resolve(self._examples(request), request)
        if kind == "nearest":
            return s.nearest(examples[0]), larger_better(v.distance) or v.kind != "dense"
        if kind == "recommend":
            n = len(q[kind].get("positive", []))
            positives, negatives = examples[:n], examples[n:]
            strategy = q[kind].get("strategy", "average_vector")
            if strategy == "average_vector":
                return s.nearest(scoring.average(positives, negatives)), larger_better(v.distance) or v.kind != "dense"
            if not examples:
                raise ValueError("recommend needs examples")
            return {"best_score": scoring.best_score, "sum_scores": scoring.sum_scores}[strategy](s, positives, negatives), True
        pairs = lambda xs: list(zip(xs[::2], xs[1::2], strict=True))
        if kind == "discover":
            return scoring.discover(s, examples[0], pairs(examples[1:])), True
        if kind == "context":
            return scoring.context(s, pairs(examples)), True
        f = q[kind]
        naive = f["strategy"]["naive"]
        scored = list(zip(examples[1:], [x["score"] for x in f["feedback"]], strict=True))
        return scoring.feedback(s, examples[0], scored, naive["a"], naive["b"], naive["c"]), True

    def _formula(self, q: dict, sources: list[tuple[DataFrame, bool]]) -> DataFrame:
        joined = None
        for i, (df, _) in enumerate(sources):
            one = df.groupBy("id").agg(F.max("score").alias(f"__score{i}"))
            joined = one if joined is None else joined.join(one, "id", "full")
        rows = joined.withColumnRenamed("id", "__id").join(self.points, F.col("__id") == F.col(self.id))
        f = Formula(self.context(), [F.col(f"__score{i}") for i in range(len(sources))], q.get("defaults"))
        return rows.select(F.col(self.id).alias("id"), f.column(q["formula"]).alias("score"))

    def _mmr(self, scored: DataFrame, larger: bool, q: dict, v: Vector, request: dict) -> DataFrame:
        params = q["mmr"] or {}
        if request.get("limit", LIMIT) is None:
            raise ValueError("a diversity query needs a limit")
        limit = request.get("limit", LIMIT) + request.get("offset", 0)
        many = params.get("candidates_limit", request.get("limit", LIMIT)) or limit
        top = scored.orderBy(*fusion.ordering(larger)).limit(many)
        rows = top.join(self.points.select(F.col(self.id).alias("id"), F.col(v.column).alias("v")), "id").orderBy(*fusion.ordering(larger)).collect()  # candidates_limit rows

        def similarity(m: np.ndarray) -> np.ndarray:
            if v.distance == "Cosine":
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(n == 0, 1, n)
            if v.distance in ("Cosine", "Dot"):
                return m @ m.T
            diff = m[:, None] - m[None]
            return -(diff**2).sum(2) if v.distance == "Euclid" else -np.abs(diff).sum(2)

        raw = {"Euclid": lambda x: -x * x, "Manhattan": lambda x: -x}.get(v.distance, lambda x: x)
        back = {r["id"]: r["score"] for r in rows}
        chosen = fusion.mmr([(r["id"], raw(r["score"]), list(r["v"])) for r in rows], similarity, params.get("diversity", 0.5) if params.get("diversity") is not None else 0.5, limit)
        kind = self.points.schema[self.id].dataType
        schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("place", T.LongType())])
        return self.spark.createDataFrame([(i, float(back[i]), n) for n, (i, _) in enumerate(chosen)], schema)

    # groups, matrices

    def query_groups(self, request: dict, group_by: str, group_size: int = GROUP_SIZE, limit: int = LIMIT, with_lookup: Collection | None = None) -> DataFrame:
        """The best `limit` groups and `group_size` hits of each: group_id, group_rank, hit_rank, id, score.
        A point with several keys is in several groups; keys are strings or integers."""
        narrow, order, larger = self._ranked({**request, "limit": None})
        values = self.context().values(group_by)
        kind = values.value_type
        if isinstance(kind, T.VariantType):
            array = F.coalesce(F.try_variant_get(values.one, "$", "array<variant>"), F.array(values.one))
            good = F.forall(array, lambda x: F.schema_of_variant(x).isin("STRING", "BIGINT"))
            keys = F.when(good, F.transform(array, lambda x: F.try_variant_get(x, "$", "string")))
        elif isinstance(kind, (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            keys = values.array()
        else:
            raise ValueError(f"{group_by} is no key to group by")
        keyed = self.points.select(F.col(self.id).alias("id"), F.array_distinct(keys).alias("keys"))
        hits = narrow.join(keyed, "id").select("id", "score", F.explode("keys").alias("group_id")).where("group_id is not null")
        return self.groups(hits, larger, group_size, limit, with_lookup)

    @staticmethod
    def groups(hits: DataFrame, larger: bool, group_size: int, limit: int, with_lookup: Collection | None = None) -> DataFrame:
        """From (group_id, id, score) rows. Ranked inside groups with the cut in each map task; then the
        groups, by their best hit, as a top-k of one row each."""
        inside = hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*fusion.ordering(larger)))).where(F.col("hit_rank") <= group_size)
        order = [*fusion.ordering(larger), F.asc("group_id")]
        best = inside.where("hit_rank = 1").select("group_id", "score", "id").orderBy(*order).limit(limit)
        ranked = best.withColumn("group_rank", F.row_number().over(Window.orderBy(*order))).select("group_id", "group_rank")  # limit rows
        out = inside.join(F.broadcast(ranked), "group_id").select("group_id", "group_rank", "hit_rank", "id", "score")
        if with_lookup is not None:
            look = with_lookup.points.select(F.col(with_lookup.id).alias("__key"), F.struct(*[c for c in with_lookup.points.columns if c != with_lookup.id]).alias("lookup"))
            out = out.join(look, F.col("group_id") == F.col("__key"), "left").drop("__key")
        return out

    def matrix_pairs(self, sample: int, limit: int = 3, using: str = "", spec: dict | None = None, seed: int | None = None) -> DataFrame:
        """Of a random sample of points, for each the `limit` nearest among the sample: a, b, score."""
        v = self.vectors[using]
        key = F.rand() if seed is None else F.md5(F.concat_ws(":", F.col(self.id).cast("string"), F.lit(str(seed))))
        drawn = self.where(spec).where(F.col(v.column).isNotNull()).select(F.col(self.id).alias("id"), F.col(v.column).alias("v"), key.alias("k")).orderBy("k", "id").limit(sample)
        rows = [(r["id"], [float(x) for x in r["v"]]) for r in drawn.collect()]  # the sample of one request
        schema = T.StructType([T.StructField("a", self.points.schema[self.id].dataType), T.StructField("b", self.points.schema[self.id].dataType), T.StructField("score", T.DoubleType())])
        if len(rows) < 2:
            return self.spark.createDataFrame([], schema)
        ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        if v.distance == "Cosine":
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n == 0, 1, n)
        out = []
        for i in range(len(ids)):
            s = m @ m[i] if larger_better(v.distance) else np.sqrt(((m - m[i]) ** 2).sum(1)) if v.distance == "Euclid" else np.abs(m - m[i]).sum(1)
            better = -s if larger_better(v.distance) else s
            tie = -ids if larger_better(v.distance) else ids
            order = [j for j in np.lexsort((tie, better)) if j != i][:limit]
            out += [(ids[i].item(), ids[j].item(), float(s[j])) for j in order]
        return self.spark.createDataFrame(out, schema)

    @staticmethod
    def matrix_offsets(pairs: DataFrame) -> DataFrame:
        """The pairs in coordinate form: places in the list of sampled ids, ascending."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        places = ids.withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)  # the sample
        row, col = places.toDF("a", "offset_row"), places.toDF("b", "offset_col")
        return pairs.join(F.broadcast(row), "a").join(F.broadcast(col), "b").select("a", "b", "offset_row", "offset_col", "score")

    # late materialisation

    def _dressed(self, narrow: DataFrame, with_payload, with_vector, limit: int | None) -> DataFrame:
        """Adds payload and vectors to the final ids, broadcast only if the limit bounds them; ids that are
        gone are dropped."""
        fields = self._payload_columns(with_payload)
        names = [n for n in self.vectors if with_vector is True or (isinstance(with_vector, list) and n in with_vector)]
        vectors = [F.col(self.vectors[n].column).alias(f"vector_{n}" if n else "vector") for n in names]
        if not fields and not vectors:
            return narrow
        rest = self.points.select(F.col(self.id).alias("__id"), *fields, *vectors)
        small = limit is not None and limit <= BROADCAST_IDS
        return rest.join(F.broadcast(narrow) if small else narrow, F.col("__id") == F.col("id")).select(*narrow.columns, *rest.columns[1:])

    def _payload_columns(self, selector) -> list[Column]:
        if not selector:
            return []
        include, exclude = None, []
        if isinstance(selector, list):
            include = [parse(p) for p in selector]
        elif isinstance(selector, dict):
            include = [parse(p) for p in selector["include"]] if selector.get("include") else None
            exclude = [parse(p) for p in selector.get("exclude", [])]
        own = {self.id, *[v.column for v in self.vectors.values()]}
        schema, root = self.points.schema, None
        if self.payload:
            if isinstance(schema[self.payload].dataType, T.VariantType):
                return [F.col(self.payload)] if include is None and not exclude else [_selected(F.col(self.payload), selector).alias(self.payload)]
            schema, root, own = schema[self.payload].dataType, F.col(self.payload), set()
        out = []
        for f in schema.fields:
            if f.name in own:
                continue
            c = project(f.dataType, F.col(f"`{f.name}`") if root is None else root[f.name], include, exclude, (f.name,))
            if c is not None:
                out.append(c.alias(f.name))
        return out

    def narrowed(self, **changes) -> Collection:
        return replace(self, **changes)


def _selected(variant: Column, selector) -> Column:
    """Selection inside a variant, on its JSON text by Arrow batches: no expression rebuilds a variant."""
    from tessera.streaming.payloads import select_json

    return F.parse_json(select_json(F.to_json(variant), selector))
