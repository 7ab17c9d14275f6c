"""Registered queries of the engine over the driver's tables, each with DuckDB SQL for the same rows.

Scores are rounded to four places on both sides; ties go by id as the engine defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.text import ENGLISH_STOPWORDS, Tokenizer, bm25_search, bm25_terms
from tessera.functions.vectors import binary_code, max_sim, scalar_codes, sparse_dot
from tessera.operators import fusion, quantized, routing
from tessera.plans.collection import Collection, Vector
from tessera.plans.predicates import compile_filter
from tessera.streaming.oplog import latest, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> Collection:
    v = {d.lower(): Vector("embedding", d) for d in ("Cosine", "Dot", "Euclid", "Manhattan")}
    return Collection(table(spark, sf_dir, "embeddings"), "vec_id", v)


def rows_of(spark: SparkSession, sf_dir: str, name: str, id_col: str, **more) -> Collection:
    return Collection(table(spark, sf_dir, name), id_col, **more)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns or ("score",)})


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds the rank in a list that a limit has already cut."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# pieces of SQL

E = "embedding::DOUBLE[]"


def _vec(i: int) -> str:
    return f"(SELECT {E} FROM embeddings WHERE vec_id = {i})"


def _raw(distance: str, q: str, e: str = E) -> str:
    return {
        "Cosine": f"list_dot_product({e}, {q}) / (sqrt(list_dot_product({e}, {e})) * sqrt(list_dot_product({q}, {q})))",
        "Dot": f"list_dot_product({e}, {q})",
        "Euclid": f"-(list_distance({e}, {q}) ** 2)",
        "Manhattan": f"-list_sum(list_transform(list_zip({e}, {q}), lambda z: abs(z[1] - z[2])))",
    }[distance]


def _reported(distance: str, q: str) -> str:
    raw = _raw(distance, q)
    return {"Euclid": f"sqrt(abs({raw}))", "Manhattan": f"abs({raw})"}.get(distance, raw)


def _top(score: str, where: str, limit: int = 10, offset: int = 0, larger: bool = True, more: str = "", source: str = "embeddings", key: str = "vec_id") -> str:
    way = "DESC" if larger else "ASC"
    return (
        f"WITH s AS (SELECT {key} AS id{more}, {score} AS score FROM {source} WHERE {where}), "
        f"r AS (SELECT *, row_number() OVER (ORDER BY score {way}, id {way}) AS n FROM s) "
        f"SELECT id{', ' + more.split(' AS ')[-1] if ' AS ' in more else more}, round(score, 4) AS score, CAST(n - {offset} AS INT) AS rank FROM r WHERE n > {offset} AND n <= {offset + limit}"
    )


# nearest neighbours


def _knn(request: dict, larger: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir).query(request)
        return rounded(ranked(df, *fusion.ordering(larger)))

    return run


for _d in ("Cosine", "Dot", "Euclid", "Manhattan"):
    _larger = _d in ("Cosine", "Dot")
    register(f"knn_{_d.lower()}", _top(_reported(_d, _vec(0)), "vec_id <> 0", larger=_larger))(_knn({"query": 0, "using": _d.lower(), "limit": 10}, _larger))

_filtered = {"query": 0, "using": "cosine", "limit": 10, "filter": {"must": [{"key": "label", "match": {"any": [1, 2, 3]}}]}, "with_payload": ["label"]}
register("knn_cosine_filtered", _top(_raw("Cosine", _vec(0)), "vec_id <> 0 AND label IN (1, 2, 3)", more=", label"))(_knn(_filtered))
register("knn_threshold", f"SELECT vec_id AS id, round({_raw('Dot', _vec(3))}, 4) AS score, CAST(row_number() OVER (ORDER BY {_raw('Dot', _vec(3))} DESC, vec_id DESC) AS INT) AS rank FROM embeddings WHERE vec_id <> 3 AND {_raw('Dot', _vec(3))} > 0.2")(
    _knn({"query": 3, "using": "dot", "limit": None, "score_threshold": 0.2})
)
register("knn_offset", _top(_raw("Cosine", _vec(5)), "vec_id <> 5", limit=5, offset=5))(_knn({"query": 5, "using": "cosine", "limit": 5, "offset": 5}))


@register(
    "knn_batch",
    f"WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, {_raw('Cosine', 'q.embedding::DOUBLE[]', 'p.embedding::DOUBLE[]')} AS score FROM embeddings p, (SELECT * FROM embeddings WHERE vec_id < 10) q WHERE p.vec_id <> q.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS n FROM s) SELECT CAST(query_id AS INT) AS query_id, id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM r WHERE n <= 5",
)
def knn_batch(spark, sf_dir):
    """Ten requests in one scan."""
    return rounded(embeddings(spark, sf_dir).query_batch([{"query": i, "using": "cosine", "limit": 5} for i in range(10)]))


# recommend, discover, context, feedback


def _avg(ids: list[int]) -> str:
    unit = f"SELECT vec_id, unnest({E}) / sqrt(list_dot_product({E}, {E})) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IN ({', '.join(map(str, ids))})"
    return f"(SELECT list(a ORDER BY i) FROM (SELECT i, avg(x) AS a FROM ({unit}) GROUP BY i))"


def _cos(i: int) -> str:
    return f"({_raw('Cosine', _vec(i))})"


def _sig(x: str) -> str:
    return f"(({x}) / (1 + abs({x})) + 1) * 0.5"


register("reco_avg", f"WITH q AS (SELECT list_transform(list_zip(p, n), lambda z: 2 * z[1] - z[2]) AS v FROM (SELECT {_avg([1, 2])} AS p, {_avg([3])} AS n)), " + _top(_raw("Cosine", "(SELECT v FROM q)"), "vec_id NOT IN (1, 2, 3)").removeprefix("WITH "))(
    _knn({"query": {"recommend": {"positive": [1, 2], "negative": [3]}}, "using": "cosine", "limit": 10})
)
_p, _n = f"greatest({_cos(1)}, {_cos(2)})", f"greatest({_cos(3)}, {_cos(4)})"
register("reco_best_score", _top(f"CASE WHEN {_p} > {_n} THEN {_sig(_p)} ELSE -({_sig(_n)}) END", "vec_id NOT IN (1, 2, 3, 4)"))(
    _knn({"query": {"recommend": {"positive": [1, 2], "negative": [3, 4], "strategy": "best_score"}}, "using": "cosine", "limit": 10})
)
register("reco_sum_scores", _top(f"{_cos(1)} + {_cos(2)} - {_cos(3)}", "vec_id NOT IN (1, 2, 3)"))(_knn({"query": {"recommend": {"positive": [1, 2], "negative": [3], "strategy": "sum_scores"}}, "using": "cosine", "limit": 10}))
register("discover", _top(f"sign({_cos(1)} - {_cos(2)}) + sign({_cos(3)} - {_cos(4)}) + {_sig(_cos(0))}", "vec_id > 4"))(
    _knn({"query": {"discover": {"target": 0, "context": [{"positive": 1, "negative": 2}, {"positive": 3, "negative": 4}]}}, "using": "cosine", "limit": 10})
)


def _loss(p: int, n: int) -> str:
    x = f"least({_cos(p)} - {_cos(n)} - 1.1920929e-07, 0.0)"
    return f"({x}) / (1 + abs({x}))"


register("context", f"SELECT vec_id AS id, round({_loss(1, 2)} + {_loss(3, 4)}, 4) AS score FROM embeddings WHERE vec_id NOT IN (1, 2, 3, 4)")(
    lambda spark, sf_dir: rounded(embeddings(spark, sf_dir).query({"query": {"context": [{"positive": 1, "negative": 2}, {"positive": 3, "negative": 4}]}, "using": "cosine", "limit": None}))
)
register("feedback_naive", _top(f"0.8 * {_cos(0)} + pow(0.9 - 0.4, 1.5) * 2.0 * ({_cos(1)} - {_cos(2)}) + pow(0.9 - 0.1, 1.5) * 2.0 * ({_cos(1)} - {_cos(3)}) + pow(0.4 - 0.1, 1.5) * 2.0 * ({_cos(2)} - {_cos(3)})", "vec_id > 3"))(
    _knn({"query": {"relevance_feedback": {"target": 0, "feedback": [{"example": 1, "score": 0.9}, {"example": 2, "score": 0.4}, {"example": 3, "score": 0.1}], "strategy": {"naive": {"a": 0.8, "b": 1.5, "c": 2.0}}}}, "using": "cosine", "limit": 10})
)


# fusion and prefetches

_SOURCES = [{"query": 0, "using": "cosine", "limit": 20}, {"query": 1, "using": "euclid", "limit": 20}]


def _lists(*lists: tuple[str, int, int, bool], hidden: str) -> str:
    parts = []
    for i, (distance, q, limit, larger) in enumerate(lists):
        way = "DESC" if larger else "ASC"
        parts.append(f"SELECT * FROM (SELECT {i} AS src, vec_id AS id, {_reported(distance, _vec(q))} AS score, row_number() OVER (ORDER BY {_reported(distance, _vec(q))} {way}, vec_id {way}) AS n FROM embeddings WHERE vec_id NOT IN ({hidden})) WHERE n <= {limit}")
    return "WITH l AS (" + " UNION ALL ".join(parts) + ")"


def _fused(part: str, limit: int = 10) -> str:
    return _lists(("Cosine", 0, 20, True), ("Euclid", 1, 20, False), hidden="0, 1") + f", {part}, r AS (SELECT id, sum(p) AS score FROM f GROUP BY id), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM r) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM t WHERE n <= {limit}"


register("rrf", _fused("f AS (SELECT id, 1.0::DOUBLE / (n + 1) AS p FROM l)"))(_knn({"prefetch": _SOURCES, "query": {"fusion": "rrf"}, "limit": 10}))
register("rrf_weighted", _fused("f AS (SELECT id, 1.0::DOUBLE / (n / (CASE src WHEN 0 THEN 3.0 ELSE 1.0 END) + 59) AS p FROM l)"))(_knn({"prefetch": _SOURCES, "query": {"rrf": {"k": 60, "weights": [3.0, 1.0]}}, "limit": 10}))
_unit = "(score - (avg(score) OVER (PARTITION BY src) - 3 * stddev_samp(score) OVER (PARTITION BY src))) / (6 * stddev_samp(score) OVER (PARTITION BY src))"
register("dbsf", _fused(f"f AS (SELECT id, CASE WHEN src = 0 THEN {_unit} ELSE 1 - {_unit} END AS p FROM l)"))(_knn({"prefetch": _SOURCES, "query": {"fusion": "dbsf"}, "limit": 10}))
register("prefetch_rescore", _lists(("Euclid", 1, 30, False), hidden="0, 1") + f", s AS (SELECT vec_id AS id, {_cos(0)} AS score FROM embeddings WHERE vec_id IN (SELECT id FROM l)), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM t WHERE n <= 10")(
    _knn({"prefetch": {"query": 1, "using": "euclid", "limit": 30}, "query": 0, "using": "cosine", "limit": 10})
)
register("prefetch_nested", _lists(("Dot", 2, 60, True), hidden="0, 1, 2") + f", m AS (SELECT * FROM (SELECT vec_id, row_number() OVER (ORDER BY {_reported('Manhattan', _vec(1))}, vec_id) AS n FROM embeddings WHERE vec_id IN (SELECT id FROM l)) WHERE n <= 25), s AS (SELECT vec_id AS id, {_cos(0)} AS score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM m)), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM t WHERE n <= 8")(
    _knn({"prefetch": {"prefetch": {"query": 2, "using": "dot", "limit": 60}, "query": 1, "using": "manhattan", "limit": 25}, "query": 0, "using": "cosine", "limit": 8})
)


# formulas


def _formula(name: str, formula, sql: str, defaults: dict | None = None):
    base = _lists(("Cosine", 0, 30, True), hidden="0")
    register(name, base + f", s AS (SELECT id, {sql} AS score FROM l JOIN embeddings ON vec_id = id), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM t WHERE n <= 10")(
        _knn({"prefetch": {"query": 0, "using": "cosine", "limit": 30}, "query": {"formula": formula, "defaults": defaults or {}}, "limit": 10})
    )


_formula("formula_arith", {"sum": [{"mult": [10.0, "$score"]}, {"div": {"left": "label", "right": {"sum": ["label", 1.0]}}}, {"neg": {"sqrt": {"abs": "$score"}}}, {"pow": {"base": "label", "exponent": 0.5}}, {"ln": {"exp": 0.25}}, {"log10": 10.0}]},
         "10 * score + label / (label + 1.0::DOUBLE) - sqrt(abs(score)) + pow(label, 0.5) + 0.25 + 1")
_formula("formula_decay_exp", {"exp_decay": {"x": "label", "target": 4.0, "scale": 2.0, "midpoint": 0.5}}, "exp(ln(0.5) / 2 * abs(label - 4))")
_formula("formula_decay_gauss", {"sum": ["$score", {"gauss_decay": {"x": "label", "target": 4.0, "scale": 2.0, "midpoint": 0.3}}]}, "score + exp(ln(0.3) / 4 * (label - 4) * (label - 4))")
_formula("formula_decay_lin", {"sum": ["$score", {"lin_decay": {"x": "label", "target": 4.0, "scale": 3.0}}]}, "score + greatest(0, 1 - 0.5 / 3 * abs(label - 4))")
_formula("formula_condition", {"sum": ["$score", {"mult": [0.5, {"key": "label", "match": {"any": [1, 2, 3]}}]}, {"must_not": [{"key": "label", "range": {"gte": 5}}]}]}, "score + 0.5 * (label IN (1, 2, 3))::INT + (label < 5)::INT")


@register(
    "formula_datetime",
    "WITH l AS (SELECT event_id, value, ts FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id DESC LIMIT 200), s AS (SELECT event_id AS id, exp(ln(0.5) / 86400 * abs(epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-05 00:00:00') / 1e6)) * 100 AS score FROM l), "
    "t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score FROM t WHERE n <= 200",
)
def formula_datetime(spark, sf_dir):
    c = rows_of(spark, sf_dir, "events", "event_id")
    moment = {"mult": [100.0, {"exp_decay": {"x": {"datetime_key": "ts"}, "target": {"datetime": "2024-01-05T00:00:00Z"}, "scale": 86400}}]}
    return rounded(c.query({"prefetch": {"query": {"order_by": {"key": "value", "direction": "desc"}}, "limit": 200, "filter": {"must": [{"key": "event_type", "match": {"value": "purchase"}}]}}, "query": {"formula": moment}, "limit": 200}))


@register("mmr")
def mmr(spark, sf_dir):
    """Greedy selection: tested against plain numpy."""
    return rounded(embeddings(spark, sf_dir).query({"query": {"nearest": 0, "mmr": {"diversity": 0.6, "candidates_limit": 50}}, "using": "cosine", "limit": 10}))


_DRAWN = "d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(concat_ws(':', vec_id, '7')), vec_id LIMIT 40)"
_PAIRS = f"WITH {_DRAWN}, s AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) AS score FROM d x JOIN d y ON x.id <> y.id), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS n FROM s) WHERE n <= 3)"


@register("distance_matrix_pairs", _PAIRS + " SELECT a, b, round(score, 4) AS score FROM p")
def distance_matrix_pairs(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).matrix_pairs(40, 3, "cosine", seed=7))


@register("distance_matrix_offsets", _PAIRS + ", i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT a AS id FROM p UNION SELECT b FROM p)) SELECT a, b, CAST(r.place AS INT) AS offset_row, CAST(c.place AS INT) AS offset_col, round(score, 4) AS score FROM p JOIN i r ON r.id = a JOIN i c ON c.id = b")
def distance_matrix_offsets(spark, sf_dir):
    c = embeddings(spark, sf_dir)
    return rounded(c.matrix_offsets(c.matrix_pairs(40, 3, "cosine", seed=7)))


@register("sample_random", "SELECT c_custkey AS id, 1.0::DOUBLE AS score, md5(concat_ws(':', c_custkey, '3')) AS place FROM customer ORDER BY place, id LIMIT 100")
def sample_random(spark, sf_dir):
    return rows_of(spark, sf_dir, "customer", "c_custkey").query({"query": {"sample": "random", "seed": 3}, "limit": 100})


# filters


def _filter(name: str, source: str, key: str, spec: dict, where: str, columns: str):
    def run(spark, sf_dir):
        return rows_of(spark, sf_dir, source, key).where(spec).select(*columns.split(", "))

    register(name, f"SELECT {columns} FROM {source} WHERE {where}")(run)


def _c(key: str, **predicate) -> dict:
    return {"key": key, **predicate}


_LINE = "l_orderkey, l_linenumber, l_quantity"
_filter("filter_must_should_mustnot", "lineitem", "l_orderkey", {"must": [_c("l_quantity", range={"gte": 10, "lt": 40})], "should": [_c("l_returnflag", match={"value": "R"}), _c("l_linestatus", match={"value": "O"})], "must_not": [_c("l_linenumber", match={"any": [1, 2]})]},
        "l_quantity >= 10 AND l_quantity < 40 AND (l_returnflag = 'R' OR l_linestatus = 'O') AND l_linenumber NOT IN (1, 2)", _LINE)
_filter("filter_min_should", "lineitem", "l_orderkey", {"min_should": {"min_count": 2, "conditions": [_c("l_quantity", range={"gt": 25}), _c("l_returnflag", match={"value": "A"}), _c("l_discount", range={"lte": 0.03})]}},
        "(l_quantity > 25)::INT + (l_returnflag = 'A')::INT + (l_discount <= 0.03)::INT >= 2", _LINE)
_filter("filter_nested_bool", "orders", "o_orderkey", {"must": [{"should": [_c("o_orderstatus", match={"value": "F"}), {"must": [_c("o_totalprice", range={"gt": 100000}), _c("o_orderpriority", match={"value": "1-URGENT"})]}]}], "must_not": [{"must": [_c("o_orderstatus", match={"value": "F"}), _c("o_totalprice", range={"lt": 50000})]}]},
        "(o_orderstatus = 'F' OR (o_totalprice > 100000 AND o_orderpriority = '1-URGENT')) AND NOT (o_orderstatus = 'F' AND o_totalprice < 50000)", "o_orderkey, o_totalprice")
_filter("match_value", "part", "p_partkey", {"must": [_c("p_size", match={"value": 15})]}, "p_size = 15", "p_partkey, p_size")
_filter("match_any", "customer", "c_custkey", {"must": [_c("c_mktsegment", match={"any": ["BUILDING", "MACHINERY"]})]}, "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_custkey, c_mktsegment")
_filter("match_except", "customer", "c_custkey", {"must": [_c("c_mktsegment", match={"except": ["BUILDING", "MACHINERY"]})]}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_custkey, c_mktsegment")
_filter("match_strict_type", "part", "p_partkey", {"should": [_c("p_retailprice", match={"value": 900}), _c("p_brand", match={"value": 1}), _c("p_size", match={"any": [7, 9]})]}, "p_size IN (7, 9)", "p_partkey, p_size")
_filter("range_number", "lineitem", "l_orderkey", {"must": [_c("l_extendedprice", range={"gt": 30000.0, "lte": 60000.0})]}, "l_extendedprice > 30000 AND l_extendedprice <= 60000", _LINE)
_filter("range_datetime", "lineitem", "l_orderkey", {"must": [_c("l_shipdate", range={"gte": "1995-01-01T00:00:00Z", "lt": "1996-01-01"})]}, "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'", _LINE)
_filter("has_id", "orders", "o_orderkey", {"should": [{"has_id": [1, 2, 3, 5, 7, 99]}, _c("o_orderstatus", match={"value": "P"})]}, "o_orderkey IN (1, 2, 3, 5, 7, 99) OR o_orderstatus = 'P'", "o_orderkey, o_orderstatus")


@register("json_path_match", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 3, 5) OR CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def json_path_match(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("payload"))
    c = Collection(points, "event_id", payload="payload")
    return c.where({"should": [_c("k", match={"any": [1, 3, 5]}), _c("k", range={"gt": 90})]}).select("event_id", F.try_variant_get("payload", "$.k", "bigint").alias("k"))


# arrays: the lines of each customer's orders


def _customers(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))).alias("orders"), F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", "orders", "priorities")


_ARRAYS = "WITH a AS (SELECT c_custkey, o.orders, o.priorities FROM customer LEFT JOIN (SELECT o_custkey, list({'price': o_totalprice, 'status': o_orderstatus}) AS orders, list(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1) o ON c_custkey = o_custkey) SELECT c_custkey FROM a WHERE "


def _arrays(name: str, spec: dict, where: str):
    register(name, _ARRAYS + where)(lambda spark, sf_dir: Collection(_customers(spark, sf_dir), "c_custkey").where(spec).select("c_custkey"))


_arrays("values_count", {"must": [_c("orders", values_count={"gte": 3, "lt": 12})]}, "len(orders) >= 3 AND len(orders) < 12")
_arrays("is_empty", {"must": [{"is_empty": {"key": "orders"}}]}, "orders IS NULL OR len(orders) = 0")
_arrays("is_null", {"must_not": [{"is_null": {"key": "orders"}}]}, "orders IS NOT NULL")
_arrays("array_any", {"must": [_c("priorities", match={"any": ["1-URGENT"]}), _c("priorities", match={"except": ["1-URGENT", "5-LOW"]})]}, "list_contains(priorities, '1-URGENT') AND len(list_filter(priorities, lambda p: p NOT IN ('1-URGENT', '5-LOW'))) > 0")
_arrays("nested_elements", {"must": [{"nested": {"key": "orders", "filter": {"must": [_c("price", range={"gt": 200000}), _c("status", match={"value": "F"})]}}}]}, "len(list_filter(orders, lambda o: o.price > 200000 AND o.status = 'F')) > 0")
_arrays("wildcard_path", {"must": [_c("orders[].price", range={"gt": 250000}), _c("orders[0].status", match={"any": ["F", "O", "P"]})]}, "len(list_filter(orders, lambda o: o.price > 250000)) > 0")


@register("has_vector", "SELECT d.doc_id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def has_vector(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return Collection(docs, "doc_id", {"e": Vector("embedding")}).where({"must": [{"has_vector": "e"}]}).select("doc_id")


# geography: places made from customer keys

_LON, _LAT = "((c_custkey * 37) % 3600) / 10.0 - 180", "((c_custkey * 91) % 1700) / 10.0 - 85"


def _places(spark, sf_dir) -> Collection:
    lon, lat = ((F.col("c_custkey") * 37) % 3600) / 10.0 - 180, ((F.col("c_custkey") * 91) % 1700) / 10.0 - 85
    return Collection(table(spark, sf_dir, "customer").select("c_custkey", F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")).alias("location")), "c_custkey")


def _geo(name: str, predicate: dict, where: str):
    register(name, f"WITH p AS (SELECT c_custkey, ({_LON})::DOUBLE AS lon, ({_LAT})::DOUBLE AS lat FROM customer) SELECT c_custkey FROM p WHERE {where}")(lambda spark, sf_dir: _places(spark, sf_dir).where({"must": [{"key": "location", **predicate}]}).select("c_custkey"))


_HAV = f"2 * {geo.RADIUS} * asin(sqrt(pow(sin((radians(lat) - radians(48.2)) / 2), 2) + cos(radians(lat)) * cos(radians(48.2)) * pow(sin((radians(lon) - radians(16.37)) / 2), 2)))"
_geo("geo_bbox", {"geo_bounding_box": {"top_left": {"lon": 150.05, "lat": 60.05}, "bottom_right": {"lon": -120.05, "lat": -30.05}}}, "(lon > 150.05 OR lon < -120.05) AND lat < 60.05 AND lat > -30.05")
_geo("geo_radius", {"geo_radius": {"center": {"lon": 16.37, "lat": 48.2}, "radius": 3_000_000.0}}, f"{_HAV} < 3000000")
_ring = lambda *xy: [{"lon": x, "lat": y} for x, y in xy]
_geo("geo_polygon", {"geo_polygon": {"exterior": {"points": _ring((-100.05, -50.05), (100.05, -50.05), (100.05, 50.05), (-100.05, 50.05), (-100.05, -50.05))}, "interiors": [{"points": _ring((-20.05, -20.05), (20.05, -20.05), (20.05, 20.05), (-20.05, 20.05), (-20.05, -20.05))}]}},
     "lon > -100.05 AND lon < 100.05 AND lat > -50.05 AND lat < 50.05 AND NOT (lon >= -20.05 AND lon <= 20.05 AND lat >= -20.05 AND lat <= 20.05)")


@register("geo_distance_formula", f"WITH p AS (SELECT c_custkey AS id, ({_LON})::DOUBLE AS lon, ({_LAT})::DOUBLE AS lat FROM customer), s AS (SELECT id, -({_HAV}) / 1000 AS score FROM p), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score FROM t WHERE n <= 50")
def geo_distance_formula(spark, sf_dir):
    f = {"neg": {"div": {"left": {"geo_distance": {"origin": {"lon": 16.37, "lat": 48.2}, "to": "location"}}, "right": 1000.0}}}
    return rounded(_places(spark, sf_dir).query({"prefetch": {"limit": None}, "query": {"formula": f}, "limit": 50}))


# counts, facets, groups, lists


@register("count_exact", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def count_exact(spark, sf_dir):
    return rows_of(spark, sf_dir, "orders", "o_orderkey").count({"must": [_c("o_orderstatus", match={"value": "F"}), _c("o_totalprice", range={"gt": 100000})]})


def _facet(name: str, source: str, key: str, path: str, sql: str, spec: dict | None = None, limit: int = 10):
    register(name, sql)(lambda spark, sf_dir: rows_of(spark, sf_dir, source, key).facet(path, spec, limit))


_facet("facet_keyword", "documents", "doc_id", "source", "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_facet("facet_int", "part", "p_partkey", "p_size", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_facet("facet_filtered", "orders", "o_orderkey", "o_orderpriority", "SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", {"must": [_c("o_orderstatus", match={"value": "O"})]})
register("facet_array", "SELECT o_orderpriority AS value, count(DISTINCT o_custkey) AS count FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda spark, sf_dir: Collection(_customers(spark, sf_dir), "c_custkey").facet("priorities"))
register("unique_values", "SELECT DISTINCT p_brand AS value FROM part")(lambda spark, sf_dir: rows_of(spark, sf_dir, "part", "p_partkey").facet("p_brand", limit=None).select("value"))


def _grouped(source: str, key: str, score: str, where: str, groups: int, size: int) -> str:
    return (
        f"WITH s AS (SELECT {key} AS group_id, vec_id AS id, {score} AS score FROM {source} WHERE {where}), h AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id DESC) AS hit_rank FROM s), "
        f"g AS (SELECT group_id, row_number() OVER (ORDER BY score DESC, id DESC, group_id) AS group_rank FROM h WHERE hit_rank = 1) "
        f"SELECT group_id, CAST(group_rank AS INT) AS group_rank, CAST(hit_rank AS INT) AS hit_rank, id, round(score, 4) AS score FROM h JOIN g USING (group_id) WHERE group_rank <= {groups} AND hit_rank <= {size}"
    )


@register("group_topn", _grouped("embeddings", "label", _cos(0), "vec_id <> 0", 5, 3))
def group_topn(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).query_groups({"query": 0, "using": "cosine"}, "label", 3, 5))


@register("group_topn_multi_key", _grouped("(SELECT *, unnest(list_distinct([CAST(label AS INT), CAST(vec_id % 3 AS INT)])) AS k FROM embeddings)", "k", _cos(0), "vec_id <> 0", 4, 2))
def group_topn_multi_key(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").withColumn("keys", F.array("label", (F.col("vec_id") % 3).cast("int")))
    return rounded(Collection(points, "vec_id", {"": Vector("embedding")}).query_groups({"query": 0}, "keys", 2, 4))


@register("group_with_lookup", f"SELECT x.*, n.n_name FROM ({_grouped('embeddings', 'label', _cos(0), 'vec_id <> 0', 5, 1)}) x LEFT JOIN nation n ON n.n_nationkey = x.group_id")
def group_with_lookup(spark, sf_dir):
    nations = rows_of(spark, sf_dir, "nation", "n_nationkey")
    found = embeddings(spark, sf_dir).query_groups({"query": 0, "using": "cosine"}, "label", 1, 5, nations)
    return rounded(found.withColumn("n_name", F.col("lookup.n_name")).drop("lookup"))


@register("group_orders_by_customer", "WITH h AS (SELECT o_custkey AS group_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS hit_rank FROM orders), g AS (SELECT group_id, row_number() OVER (ORDER BY score DESC, id DESC, group_id) AS group_rank FROM h WHERE hit_rank = 1) SELECT group_id, CAST(group_rank AS INT) AS group_rank, CAST(hit_rank AS INT) AS hit_rank, id, round(score, 4) AS score FROM h JOIN g USING (group_id) WHERE group_rank <= 20 AND hit_rank <= 3")
def group_orders_by_customer(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return rounded(Collection.groups(hits, True, 3, 20))


def _ordered(name: str, spec: dict | str, sql_order: str, where: str = "true"):
    def run(spark, sf_dir):
        return rows_of(spark, sf_dir, "orders", "o_orderkey").scroll(limit=25, order_by=spec, with_payload=["o_orderstatus"])

    register(name, f"SELECT o_orderkey AS id, o_totalprice AS order_value, o_orderstatus FROM orders WHERE {where} ORDER BY {sql_order} LIMIT 25")(run)


_ordered("order_by_asc", "o_totalprice", "o_totalprice, o_orderkey")
_ordered("order_by_desc", {"key": "o_totalprice", "direction": "desc"}, "o_totalprice DESC, o_orderkey DESC")
_ordered("order_by_start_from", {"key": "o_totalprice", "direction": "desc", "start_from": 150000.0}, "o_totalprice DESC, o_orderkey DESC", "o_totalprice <= 150000")


@register("order_by_datetime", "SELECT o_orderkey AS id, o_orderdate AS order_value FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def order_by_datetime(spark, sf_dir):
    return rows_of(spark, sf_dir, "orders", "o_orderkey").scroll(limit=25, order_by={"key": "o_orderdate", "start_from": "1996-06-01T00:00:00Z"}, with_payload=False)


@register("order_by_multi_value", "SELECT o_custkey AS id, o_totalprice AS order_value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) ORDER BY o_totalprice, o_custkey LIMIT 40")
def order_by_multi_value(spark, sf_dir):
    return Collection(_customers(spark, sf_dir), "c_custkey").scroll(limit=40, order_by="orders[].price", with_payload=False)


@register("scroll_page", "SELECT c_custkey AS id, c_name, c_mktsegment FROM customer WHERE c_custkey >= 100 AND c_mktsegment <> 'BUILDING' ORDER BY c_custkey LIMIT 20")
def scroll_page(spark, sf_dir):
    return rows_of(spark, sf_dir, "customer", "c_custkey").scroll({"must_not": [_c("c_mktsegment", match={"value": "BUILDING"})]}, limit=20, offset=100, with_payload={"exclude": ["c_nationkey", "c_acctbal"]})


@register("retrieve", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (1, 5, 9, 77)")
def retrieve(spark, sf_dir):
    return rows_of(spark, sf_dir, "customer", "c_custkey").retrieve([1, 5, 5, 9, 77, 10**12])


# text

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')"


def _text(name: str, predicate: dict, where: str, tokenizer: Tokenizer | None):
    def run(spark, sf_dir):
        c = rows_of(spark, sf_dir, "documents", "doc_id", tokenizers={"text": tokenizer} if tokenizer else {})
        return c.where({"must": [_c("text", match=predicate)]}).select("doc_id", "lang")

    register(name, f"SELECT doc_id, lang FROM documents WHERE {where}")(run)


_text("text_match_all", {"text": "the and With"}, f"list_has_all({_WORDS}, ['the', 'and', 'with'])", Tokenizer())
_text("text_match_any", {"text_any": "une nicht"}, f"list_has_any({_WORDS}, ['une', 'nicht'])", Tokenizer())
_text("text_phrase", {"phrase": "of the"}, f"contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')", Tokenizer())
_text("text_substring", {"text": "License"}, "contains(text, 'License')", None)
_text("text_any_substring", {"text_any": "License reserved"}, "contains(text, 'License') OR contains(text, 'reserved')", None)


def _bm25(query: list[str], idf: bool) -> str:
    words = ", ".join(f"'{w}'" for w in query)
    weight = "(tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / 256.0::DOUBLE))"
    return (
        f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM d), m AS (SELECT doc_id, length, token, count(*) AS tf FROM t WHERE token IN ({words}) GROUP BY ALL), "
        f"f AS (SELECT token, count(*) AS df FROM m GROUP BY 1), s AS (SELECT doc_id AS id, round(sum({weight}{' * ln((n - df + 0.5) / (df + 0.5) + 1)' if idf else ''}), 9) AS score FROM m JOIN f USING (token), (SELECT count(*) AS n FROM documents) GROUP BY 1), "
        "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS k FROM s) SELECT id, round(score, 4) AS score, CAST(k AS INT) AS rank FROM r WHERE k <= "
    )


def _bm25_top(spark, sf_dir: str, query: str, limit: int, use_idf: bool = True) -> DataFrame:
    """The best documents by score in nine places: SQL adds a score's terms in any order."""
    found = bm25_search(table(spark, sf_dir, "documents"), "doc_id", "text", query, use_idf=use_idf)
    return found.withColumn("score", F.round("score", 9)).orderBy(*fusion.ordering()).limit(limit)


@register("bm25_search", _bm25(["from", "only", "license"], False) + "20")
def bm25(spark, sf_dir):
    return rounded(ranked(_bm25_top(spark, sf_dir, "from only license", 20, use_idf=False), *fusion.ordering()))


@register("sparse_idf", _bm25(["from", "only", "license"], True) + "20")
def sparse_idf(spark, sf_dir):
    return rounded(ranked(_bm25_top(spark, sf_dir, "from only license", 20), *fusion.ordering()))


@register("token_facet", f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n FROM t WHERE token NOT IN ({', '.join(repr(w) for w in ENGLISH_STOPWORDS)}) GROUP BY 1 ORDER BY df DESC, token LIMIT 30")
def token_facet(spark, sf_dir):
    """Document frequencies of tokens, without stopwords: the rows behind idf."""
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(Tokenizer(stopwords=ENGLISH_STOPWORDS).document(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return terms.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).orderBy(F.desc("df"), "token").limit(30)


@register("bm25_vectors", f"WITH d AS (SELECT item_id, {_WORDS} AS w FROM benchmark), t AS (SELECT item_id, len(w) AS length, unnest(w) AS token FROM d) SELECT item_id, token, round((count(*) * 2.2) / (count(*) + 1.2 * (0.25 + 0.75 * length / 256.0::DOUBLE)), 4) AS weight FROM t GROUP BY item_id, length, token")
def bm25_vectors(spark, sf_dir):
    return rounded(bm25_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "weight")


def _sparse(spark, sf_dir) -> DataFrame:
    """Embeddings as sparse vectors: the components above 0.1 in size."""
    pairs = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("long").alias("i"), x.cast("double").alias("w"))), lambda p: F.abs(p["w"]) > 0.1)
    v = F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["w"]).alias("values"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))


_SPARSE_Q = {3: 1.5, 10: -0.5, 40: 2.0}


@register("sparse_dot", "WITH s AS (SELECT vec_id AS id, " + " + ".join(f"CASE WHEN abs(embedding[{i + 1}]::DOUBLE) > 0.1 THEN embedding[{i + 1}]::DOUBLE * {w} ELSE 0 END" for i, w in _SPARSE_Q.items()) + " AS score FROM embeddings WHERE " + " OR ".join(f"abs(embedding[{i + 1}]::DOUBLE) > 0.1" for i in _SPARSE_Q) + "), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM s) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM r WHERE n <= 15")
def sparse_nearest(spark, sf_dir):
    c = Collection(_sparse(spark, sf_dir), "vec_id", {"": Vector("v", "Dot", "sparse")})
    found = c.query({"query": {"indices": list(_SPARSE_Q), "values": list(_SPARSE_Q.values())}, "limit": 15})
    return rounded(ranked(found, *fusion.ordering()))


@register("sparse_postings", "WITH p AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings) SELECT dim, count(*) AS df FROM p WHERE w > 0.1 GROUP BY 1")
def sparse_postings(spark, sf_dir):
    """Posting lengths of the exploded vectors."""
    return _sparse(spark, sf_dir).select(F.explode("v.indices").alias("dim")).groupBy("dim").agg(F.count("*").alias("df"))


@register(
    "hybrid_rrf",
    _bm25(["the", "from", "only"], True).rsplit("r AS (", 1)[0]
    + f"b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id DESC) AS k FROM s), e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_cos(0)} DESC, vec_id DESC) AS k FROM embeddings WHERE vec_id <> 0), "
    "l AS (SELECT * FROM b WHERE k <= 50 UNION ALL SELECT * FROM e WHERE k <= 50), q AS (SELECT id, sum(1.0::DOUBLE / (k + 1)) AS score FROM l GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS n FROM q) SELECT id, round(score, 4) AS score, CAST(n AS INT) AS rank FROM z WHERE n <= 20",
)
def hybrid_rrf(spark, sf_dir):
    text = _bm25_top(spark, sf_dir, "the from only", 50)
    dense = embeddings(spark, sf_dir).query({"query": 0, "using": "cosine", "limit": 50})
    return rounded(ranked(fusion.rrf([(text, True), (dense, True)]).orderBy(*fusion.ordering()).limit(20), *fusion.ordering()))


@register("maxsim", f"WITH m AS (SELECT label, max({_cos(0).replace(E, E)}) AS a, max({_cos(1)}) AS b FROM embeddings GROUP BY label), s AS (SELECT label AS id, a + b AS score FROM m) SELECT id, round(score, 4) AS score FROM s")
def maxsim(spark, sf_dir):
    """Late interaction over the embeddings of a label as one multi-vector."""
    rows = table(spark, sf_dir, "embeddings")
    queries = [list(r["embedding"]) for r in rows.where(F.col("vec_id").isin(0, 1)).orderBy("vec_id").select("embedding").collect()]  # the two rows of the query
    points = rows.groupBy("label").agg(F.collect_list("embedding").alias("rows"))
    return rounded(points.select(F.col("label").alias("id"), max_sim(F.col("rows"), queries, "Cosine").alias("score")))


# quantisation


@register("scalar_codes", "WITH b AS (SELECT min(x) AS low, (max(x) - min(x)) / 127 AS step FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: greatest(0, least(127, CAST(round((x::DOUBLE - low) / step) AS INT))))) AS BIGINT) AS code_sum FROM embeddings, b")
def scalar_code_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    low, high = quantized.bounds(rows, "embedding")
    return rows.select("vec_id", F.aggregate(scalar_codes(F.col("embedding"), low, high), F.lit(0).cast("long"), lambda t, x: t + x).alias("code_sum"))


@register("binary_codes", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS ones FROM embeddings")
def binary_codes(spark, sf_dir):
    code = binary_code(F.col("embedding"), 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.bit_count(code[0]) + F.bit_count(code[1])).cast("long").alias("ones"))


def _first_vector(df: DataFrame) -> list[float]:
    return [float(x) for x in df.where("vec_id = 0").first()["embedding"]]


_OTHERS = f"FROM embeddings, (SELECT {_vec(0)} AS q)"


@register(
    "quantized_scalar_rescore",
    "WITH b AS (SELECT min(x) AS low, (max(x) - min(x)) / 127 AS step FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id <> 0)), c AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, "
    + _vec(0) + "), lambda z: (greatest(0, least(127, round((z[1]::DOUBLE - low) / step))) * step + low) * z[2])) AS s FROM embeddings, b WHERE vec_id <> 0), "
    "k AS (SELECT vec_id FROM c ORDER BY round(s, 9) DESC, vec_id DESC LIMIT 40), " + _top(_raw("Dot", _vec(0)), "vec_id IN (SELECT vec_id FROM k)").removeprefix("WITH "),
)
def quantized_scalar_rescore(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = quantized.scalar_search(rows.where("vec_id <> 0"), "vec_id", "embedding", _first_vector(rows), 10, 4.0)
    return rounded(ranked(found, *fusion.ordering()))


@register(
    "quantized_binary_rescore",
    "WITH c AS (SELECT vec_id, len(list_filter(list_zip(embedding, " + _vec(0) + "), lambda z: (z[1] > 0) <> (z[2] > 0))) AS s FROM embeddings WHERE vec_id <> 0), k AS (SELECT vec_id FROM c ORDER BY s, vec_id DESC LIMIT 80), "
    + _top(_raw("Dot", _vec(0)), "vec_id IN (SELECT vec_id FROM k)").removeprefix("WITH "),
)
def quantized_binary_rescore(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = quantized.binary_search(rows.where("vec_id <> 0"), "vec_id", "embedding", _first_vector(rows), 10, 8.0)
    return rounded(ranked(found, *fusion.ordering()))


# changes: events as an operation log of users


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "event_type", "value")


@register("upsert_latest_version", "SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest_version(spark, sf_dir):
    return latest(_log(spark, sf_dir))


_HALF = "(SELECT max(event_id) // 2 FROM events)"
_OLD = f"SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= {_HALF} GROUP BY 1"
_NEW = _OLD.replace("<=", ">")


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The state after the first half of the log, and the second half's own."""
    log = _log(spark, sf_dir).select("id", "version", F.to_json(F.struct("event_type")).alias("payload"))
    half = log.agg(F.floor(F.max("version") / 2).alias("half"))
    log = log.join(F.broadcast(half))
    return latest(log.where("version <= half").drop("half")), latest(log.where("version > half").drop("half"))


def _typed(df: DataFrame) -> DataFrame:
    return df.select("id", "version", F.get_json_object("payload", "$.event_type").alias("event_type"))


@register("conditional_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.event_type = 'click') THEN n.version ELSE o.version END AS version, CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.event_type = 'click') THEN n.event_type ELSE o.event_type END AS event_type FROM o FULL JOIN n ON o.id = n.id")
def conditional_upsert(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    return _typed(upsert(old, new, spec={"must": [_c("event_type", match={"value": "click"})]}))


@register("insert_only", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_only(spark, sf_dir):
    return _typed(upsert(*_states(spark, sf_dir), mode="insert_only"))


@register("update_only", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.id, coalesce(n.version, o.version) AS version, coalesce(n.event_type, o.event_type) AS event_type FROM o LEFT JOIN n ON o.id = n.id")
def update_only(spark, sf_dir):
    return _typed(upsert(*_states(spark, sf_dir), mode="update_only"))


@register("delete_by_filter", f"SELECT * FROM ({_OLD}) WHERE event_type NOT IN ('click', 'view')")
def delete_by_filter(spark, sf_dir):
    from tessera.streaming.oplog import apply_op

    old, _ = _states(spark, sf_dir)
    return _typed(apply_op(old, 1 << 40, "delete", {"filter": {"must": [_c("event_type", match={"any": ["click", "view"]})]}}))


@register("payload_merge", f"SELECT id, CASE WHEN event_type = 'click' THEN {1 << 40} ELSE version END AS version, event_type, CASE WHEN event_type = 'click' THEN 'yes' END AS seen FROM ({_OLD})")
def payload_merge(spark, sf_dir):
    from tessera.streaming.oplog import apply_op

    old, _ = _states(spark, sf_dir)
    now = apply_op(old, 1 << 40, "set_payload", {"payload": {"seen": "yes", "gone": None}, "filter": {"must": [_c("event_type", match={"value": "click"})]}})
    return now.select("id", "version", F.get_json_object("payload", "$.event_type").alias("event_type"), F.get_json_object("payload", "$.seen").alias("seen"))


def _op(name: str, kind: str, body: dict, sql: str):
    """One operation on the state of the first half of the log."""

    @register(name, sql)
    def run(spark, sf_dir):
        from tessera.streaming.oplog import apply_op

        old, _ = _states(spark, sf_dir)
        return _typed(apply_op(old, 1 << 40, kind, body))


_CLICKS = {"filter": {"must": [_c("event_type", match={"value": "click"})]}}
_ON_CLICKS = f"SELECT id, CASE WHEN event_type = 'click' THEN {1 << 40} ELSE version END AS version, CASE WHEN event_type = 'click' THEN %s ELSE event_type END AS event_type FROM ({_OLD})"
_op("delete_by_ids", "delete", {"ids": list(range(0, 40, 2))}, f"SELECT * FROM ({_OLD}) WHERE id NOT IN (SELECT * FROM range(0, 40, 2))")
_op("overwrite_payload", "overwrite_payload", {"payload": {"event_type": "new"}, **_CLICKS}, _ON_CLICKS % "'new'")
_op("clear_payload", "clear_payload", _CLICKS, _ON_CLICKS % "NULL")
_op("delete_payload_keys", "delete_payload", {"keys": ["event_type", "absent"], **_CLICKS}, _ON_CLICKS % "NULL")
_op("update_batch", "batch", {"operations": [{"kind": "overwrite_payload", "body": {"payload": {"event_type": "new"}, **_CLICKS}}, {"kind": "delete", "body": {"filter": {"must": [_c("event_type", match={"value": "view"})]}}}]}, f"SELECT * FROM ({_ON_CLICKS % repr('new')}) WHERE event_type <> 'view'")


def _vector_op(name: str, kind: str, body: dict, first: str, version: str):
    """One operation on points with the vectors of embeddings, at version 1."""

    @register(name, f"SELECT vec_id AS id, CAST({version} AS BIGINT) AS version, {first} AS first FROM embeddings")
    def run(spark, sf_dir):
        from tessera.streaming.oplog import apply_op

        rows = table(spark, sf_dir, "embeddings")
        payload = F.to_json(F.struct("label"))
        state = rows.select(F.col("vec_id").cast("long").alias("id"), F.lit(1).cast("long").alias("version"), payload.alias("payload"), F.col("embedding").cast("array<float>").alias("vector_"))
        now = apply_op(state, 7, kind, body)
        return now.select("id", "version", F.round(F.try_element_at("vector_", F.lit(1)).cast("double"), 4).alias("first"))


_FIRST = "round(embedding[1]::DOUBLE, 4)"
_vector_op("update_vectors", "update_vectors", {"points": [{"id": i, "vector": [i + 0.5, 1.0]} for i in (3, 5, 8)]}, f"CASE WHEN vec_id IN (3, 5, 8) THEN vec_id + 0.5::DOUBLE ELSE {_FIRST} END", "CASE WHEN vec_id IN (3, 5, 8) THEN 7 ELSE 1 END")
_vector_op("delete_vectors", "delete_vectors", {"vectors": [""], "filter": {"must": [_c("label", match={"any": [1, 2]})]}}, f"CASE WHEN label IN (1, 2) THEN NULL ELSE {_FIRST} END", "CASE WHEN label IN (1, 2) THEN 7 ELSE 1 END")


# routing

_CENTRES = "c AS (SELECT label AS shard, list(a ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


def _centroids(rows: DataFrame):
    import numpy as np

    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    got = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("v")).orderBy("label").collect()  # one row for each shard
    return [r["label"] for r in got], np.array([r["v"] for r in got])


@register("centroid_assign", f"WITH {_CENTRES}, d AS (SELECT vec_id, shard, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], v), shard) AS n FROM embeddings, c) SELECT vec_id, shard FROM d WHERE n = 1")
def centroid_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    labels, centres = _centroids(rows)
    return rows.select("vec_id", F.array(*map(F.lit, labels))[routing.nearest_centroid(F.col("embedding"), centres)].alias("shard"))


@register("alpha_assign", f"WITH {_CENTRES}, d AS (SELECT vec_id, shard, list_distance(embedding::DOUBLE[], v) ** 2 AS s FROM embeddings, c) SELECT vec_id, CAST(shard AS INT) AS shard FROM d QUALIFY s <= 1.0025 * min(s) OVER (PARTITION BY vec_id)")
def alpha_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    labels, centres = _centroids(rows)
    found = routing.within_alpha(rows, "embedding", centres, 1.0025**0.5)
    return found.select("vec_id", F.array(*map(F.lit, labels))[F.col("shard")].cast("int").alias("shard"))


@register("centroid_nprobe_route", f"WITH {_CENTRES}, p AS (SELECT shard FROM c ORDER BY list_distance(v, {_vec(0)}), shard LIMIT 3), " + _top(_raw("Cosine", _vec(0)), "vec_id <> 0 AND label IN (SELECT shard FROM p)").removeprefix("WITH "))
def centroid_nprobe_route(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    labels, centres = _centroids(rows)
    shards = [labels[i] for i in routing.route_nprobe(_first_vector(rows), centres, 3)]
    c = Collection(rows, "vec_id", {"": Vector("embedding")}, shard="label")
    found = c.narrowed(points=c.where(None, shards)).query({"query": _first_vector(rows), "limit": 10, "filter": {"must_not": [{"has_id": [0]}]}})
    return rounded(ranked(found, *fusion.ordering()))


@register("two_tier_route", "WITH u AS (SELECT label, " + _raw("Cosine", _vec(0)) + " AS s, vec_id FROM (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 100)), p AS (SELECT DISTINCT label FROM (SELECT label FROM u ORDER BY s DESC, vec_id LIMIT 4)), " + _top(_raw("Cosine", _vec(0)), "vec_id <> 0 AND label IN (SELECT label FROM p)").removeprefix("WITH "))
def two_tier_route(spark, sf_dir):
    """The upper tier is a sample of a hundred points with the shards that they belong to."""
    import numpy as np

    rows = table(spark, sf_dir, "embeddings")
    upper = sorted(rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(100).collect(), key=lambda r: r["vec_id"])  # the sample
    shards, _ = routing.route_two_tier(_first_vector(rows), np.array([r["embedding"] for r in upper], dtype=np.float64), [[r["label"]] for r in upper], 4, 48, 14)
    c = Collection(rows, "vec_id", {"": Vector("embedding")}, shard="label")
    found = c.narrowed(points=c.where(None, shards)).query({"query": _first_vector(rows), "limit": 10, "filter": {"must_not": [{"has_id": [0]}]}})
    return rounded(ranked(found, *fusion.ordering()))


@register(
    "routing_recall",
    f"WITH {_CENTRES}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 10), p AS (SELECT * FROM (SELECT query_id, shard, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(c.v, q.v), shard) AS n FROM q, c) WHERE n <= 3), "
    "s AS (SELECT query_id, vec_id AS id, label, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q WHERE vec_id <> query_id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 10), "
    "f AS (SELECT s.* FROM s JOIN p ON p.query_id = s.query_id AND p.shard = s.label QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, id DESC) <= 10) SELECT CAST(t.query_id AS INT) AS query_id, sum(CASE WHEN f.id IS NULL THEN 0 ELSE 1 END) / 10.0::DOUBLE AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.id = t.id GROUP BY 1",
)
def routing_recall(spark, sf_dir):
    from functools import reduce

    c = embeddings(spark, sf_dir)
    labels, centres = _centroids(c.points)
    truth = c.query_batch([{"query": i, "using": "dot", "limit": 10} for i in range(10)])
    examples = {r["vec_id"]: r["embedding"] for r in c.points.where("vec_id < 10").collect()}  # the ten queries
    parts = []
    for i, v in sorted(examples.items()):
        shards = [labels[j] for j in routing.route_nprobe([float(x) for x in v], centres, 3)]
        hidden = {"must": [_c("label", match={"any": shards})], "must_not": [{"has_id": [i]}]}
        parts.append(c.query({"query": [float(x) for x in v], "using": "dot", "limit": 10, "filter": hidden}).select(F.lit(i).alias("query_id"), "id"))
    return routing.recall(reduce(DataFrame.unionByName, parts), truth, 10)


@register("filter_on_documents", "SELECT lang AS value, count(*) AS count FROM documents WHERE n_chars >= 1000 AND NOT contains(text, 'License') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def filter_on_documents(spark, sf_dir):
    spec = {"must": [_c("n_chars", range={"gte": 1000})], "must_not": [_c("text", match={"text": "License"})]}
    return rows_of(spark, sf_dir, "documents", "doc_id").facet("lang", spec)


@register("filter_predicate_column", "SELECT o_orderkey, (o_totalprice > 200000 OR o_orderstatus = 'P') AS hot FROM orders")
def filter_predicate_column(spark, sf_dir):
    c = rows_of(spark, sf_dir, "orders", "o_orderkey")
    spec = {"should": [_c("o_totalprice", range={"gt": 200000}), _c("o_orderstatus", match={"value": "P"})]}
    return c.points.select("o_orderkey", compile_filter(spec, c.context()).alias("hot"))


@register("sparse_functions", "SELECT vec_id, round(coalesce(" + " + ".join(f"CASE WHEN abs(embedding[{i + 1}]::DOUBLE) > 0.1 THEN embedding[{i + 1}]::DOUBLE * {w} ELSE 0 END" for i, w in _SPARSE_Q.items()) + ", 0), 4) AS score FROM embeddings")
def sparse_functions(spark, sf_dir):
    """A sparse score of 0 where no index is shared, as custom queries have it."""
    return _sparse(spark, sf_dir).select("vec_id", F.round(F.coalesce(sparse_dot(F.col("v"), _SPARSE_Q), F.lit(0.0)), 4).alias("score"))


_VOTES = "WITH v AS (SELECT l_partkey AS id, CAST(l_suppkey % 5 AS INT) AS shard, count(*) AS votes FROM lineitem GROUP BY 1, 2)"


@register("placement_votes", _VOTES + " SELECT id, shard FROM v WINDOW w AS (PARTITION BY id) QUALIFY (votes >= max(votes) OVER w - 1 AND max(votes) OVER w >= 2) OR row_number() OVER (PARTITION BY id ORDER BY votes DESC, shard) = 1")
def placement_votes(spark, sf_dir):
    from tessera.operators.routing import shards_by_votes

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 5).cast("int").alias("shard"))
    return shards_by_votes(lines.groupBy("id", "shard").agg(F.count("*").alias("votes")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["knn_cosine_filtered"](spark, sf_dir)


from tessera.plans import queries_stored  # noqa: E402, F401  registers its own queries
