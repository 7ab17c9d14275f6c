"""Registered queries of what is stored and changed: the operation log, catalog, indexes, points of several
forms, older request shapes, and the rest of the routing and quantising operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import Tokenizer
from tessera.functions.times import parsed
from tessera.functions.vectors import product_codes, sparse_combine, two_bit_code
from tessera.operators import fusion, quantized, routing
from tessera.plans import legacy
from tessera.plans.collection import Collection, Vector
from tessera.plans.predicates import merge
from tessera.plans.queries import (
    _CENTRES, _HALF, _OLD, _SPARSE_Q, ORACLE_SQL, _c, _centroids, _cos, _lists, _raw, _sparse, _states, _top, _typed, _vec, embeddings, ranked, register, rounded, rows_of, table,
)
from tessera.sources import indexes, points
from tessera.sources.catalog import Catalog, Config
from tessera.sources.files import shared_folder
from tessera.streaming.oplog import OpLog, apply_op, newest_ops, pending, replay_log, state_schema

# ids that are UUIDs


def _uuid(x: Column) -> Column:
    return points.canonical_id(F.md5(x.cast("string")))


_UUID = "regexp_replace(md5({}::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_BY_UUID = f"(SELECT {_UUID.format('vec_id')} AS uid, vec_id, embedding, label FROM embeddings)"


def _by_uuid(spark, sf_dir) -> Collection:
    rows = table(spark, sf_dir, "embeddings").withColumn("uid", _uuid(F.col("vec_id")))
    return Collection(rows, "uid", {d.lower(): Vector("embedding", d) for d in ("Cosine", "Euclid")})


def _uid(i: int) -> str:
    import hashlib

    return points.point_id(hashlib.md5(str(i).encode()).hexdigest())


@register("knn_uuid", _top(_raw("Cosine", _vec(0)), "vec_id <> 0", source=_BY_UUID, key="uid"))
def knn_uuid(spark, sf_dir):
    return rounded(ranked(_by_uuid(spark, sf_dir).query({"query": _uid(0), "using": "cosine", "limit": 10}), *fusion.ordering()))


@register("rrf_uuid", ORACLE_SQL["rrf"].replace("vec_id AS id", "uid AS id").replace(" DESC, vec_id DESC", " DESC, uid DESC").replace(" ASC, vec_id ASC", " ASC, uid ASC").replace(" FROM embeddings WHERE vec_id NOT", f" FROM {_BY_UUID} WHERE vec_id NOT"))
def rrf_uuid(spark, sf_dir):
    sources = [{"query": _uid(0), "using": "cosine", "limit": 20}, {"query": _uid(1), "using": "euclid", "limit": 20}]
    return rounded(ranked(_by_uuid(spark, sf_dir).query({"prefetch": sources, "query": {"fusion": "rrf"}, "limit": 10}), *fusion.ordering()))


# the operation log


def _upsert_log(spark, sf_dir, uuids: bool) -> DataFrame:
    """Every event as an upsert of its user; after half of the log clicks are deleted."""
    events = table(spark, sf_dir, "events")
    own = _uuid(F.col("user_id")) if uuids else F.col("user_id")
    point = F.struct(own.alias("id"), F.struct("event_type").alias("payload"), F.array(F.lit(0.5), F.lit(1.0)).alias("vector"))
    ops = events.select(F.col("event_id").alias("op_num"), F.lit("upsert").alias("kind"), F.to_json(F.struct(F.array(point).alias("points"))).alias("body"))
    half = events.agg(F.floor(F.max("event_id") / 2).alias("op_num"))
    drop = '{"filter": {"must": [{"key": "event_type", "match": {"value": "click"}}]}}'
    # the deletion shares a number with an upsert that comes before it
    return ops.where("op_num <> 0").unionByName(half.select("op_num", F.lit("delete").alias("kind"), F.lit(drop).alias("body")))


def _log_sql(uid: str) -> str:
    last = "SELECT {} AS id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <> 0 AND event_id {} GROUP BY 1"
    early, late = last.format(uid, f"< {_HALF}"), last.format(uid, f">= {_HALF}")
    return f"WITH o AS (SELECT * FROM ({early}) WHERE event_type <> 'click'), n AS ({late}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)"


@register("oplog_replay", _log_sql("user_id"))
def oplog_replay(spark, sf_dir):
    """Two runs of upserts around a deletion, by two joins."""
    log = _upsert_log(spark, sf_dir, False)
    return _typed(replay_log(spark.createDataFrame([], state_schema([""])), log))


@register("oplog_stream_uuid", _log_sql(_UUID.format("user_id")))
def oplog_stream_uuid(spark, sf_dir):
    """The same on UUIDs, from log files by a stream that ends."""
    where = shared_folder(spark, "oplog")
    _upsert_log(spark, sf_dir, True).write.json(f"{where}/log")
    log = OpLog(spark, f"{where}/state", [""], "string")
    log.stream(f"{where}/log", f"{where}/checkpoint").awaitTermination()
    return _typed(log.state())


@register("log_range", f"SELECT event_id AS op_num, event_type AS kind FROM events WHERE event_id > {_HALF}")
def log_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return pending(events.select(F.col("event_id").alias("op_num"), F.col("event_type").alias("kind")), half)


@register("duplicate_ops", "SELECT user_id, event_type, min(event_id) AS op_num FROM events GROUP BY 1, 2")
def duplicate_ops(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).alias("tick"), F.col("event_id").alias("op_num"))
    return newest_ops(ops, "user_id", "event_type").drop("tick")


@register("stale_op", f"SELECT id, version, CASE WHEN version < {_HALF} // 2 THEN 'new' ELSE event_type END AS event_type FROM ({_OLD})".replace("SELECT id, version,", f"SELECT id, CASE WHEN version < {_HALF} // 2 THEN {_HALF} // 2 ELSE version END AS version,", 1))
def stale_op(spark, sf_dir):
    """An operation changes only points that are older than it."""
    old, _ = _states(spark, sf_dir)
    number = table(spark, sf_dir, "events").agg(F.floor(F.floor(F.max("event_id") / 2) / 2)).first()[0]
    return _typed(apply_op(old, number, "overwrite_payload", {"payload": {"event_type": "new"}, "filter": {}}))


@register("sync_range", f"SELECT id, CASE WHEN id = 2 THEN {1 << 40} ELSE version END AS version, CASE WHEN id = 2 THEN 'new' ELSE event_type END AS event_type FROM ({_OLD}) WHERE id NOT BETWEEN 0 AND 7 OR id = 2 UNION ALL SELECT 2, {1 << 40}, 'new' WHERE 2 NOT IN (SELECT id FROM ({_OLD}))")
def sync_range(spark, sf_dir):
    old, _ = _states(spark, sf_dir)
    return _typed(apply_op(old, 1 << 40, "sync", {"from": 0, "to": 7, "points": [{"id": 2, "payload": {"event_type": "new"}}]}))


_CLICK = {"filter": {"must": [_c("event_type", match={"value": "click"})]}}


@register("payload_at_path", f"SELECT id, CASE WHEN event_type = 'click' THEN {(1 << 40) + 1} ELSE version END AS version, CASE WHEN event_type = 'click' THEN 'yes' END AS seen, CAST(NULL AS VARCHAR) AS gone FROM ({_OLD})")
def payload_at_path(spark, sf_dir):
    """Sets below a path, then deletes one of the keys by its path."""
    old, _ = _states(spark, sf_dir)
    now = apply_op(old, 1 << 40, "set_payload", {"payload": {"seen": "yes", "gone": 1}, "key": "meta.deep", **_CLICK})
    now = apply_op(now, (1 << 40) + 1, "delete_payload", {"keys": ["meta.deep.gone"], **_CLICK})
    at = lambda k: F.get_json_object("payload", f"$.meta.deep.{k}").alias(k)
    return now.select("id", "version", at("seen"), at("gone"))


# points of several forms


@register("points_from_columns", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 4) AS first, label FROM embeddings")
def points_from_columns(spark, sf_dir):
    """Batches of parallel arrays."""
    rows = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 97).alias("batch")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("embedding").alias("vs"), F.collect_list(F.struct("label")).alias("ps"))
    got = points.from_columns(rows, "ids", "vs", "ps")
    return got.select("id", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.col("payload.label").alias("label"))


@register("bulk_import", "SELECT vec_id AS id, CAST(vec_id % 3 AS INT) AS shard, len(embedding) AS dim FROM embeddings")
def bulk_import(spark, sf_dir):
    where, rows = shared_folder(spark, "import"), table(spark, sf_dir, "embeddings")
    rows.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("shard")).write.json(f"{where}/assignment")
    rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).write.parquet(f"{where}/vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    got = points.import_shards(spark, {"points": size["n"], "dim": size["dim"], "shards": 3}, f"{where}/assignment", f"{where}/vectors")
    return got.select("id", "shard", F.size("vector").cast("long").alias("dim"))


@register("catalog_lifecycle", "SELECT vec_id AS id, label FROM embeddings WHERE label <> 1 AND vec_id < 1000")
def catalog_lifecycle(spark, sf_dir):
    """Created with a shard key, aliased, snapshot, restored, a key dropped, queried by its alias."""
    catalog = Catalog(spark, shared_folder(spark, "catalog"))
    rows = table(spark, sf_dir, "embeddings").withColumn("key", F.col("label"))
    catalog.create("a", rows, Config("vec_id", {"": {"column": "embedding"}}, shard="key", strict={"unindexed_filtering": False}))
    catalog.create_shard_key("a", 1)
    catalog.declare("a", "label", "integer")
    catalog.declare("a", "vec_id", "integer")
    catalog.restore(catalog.snapshot("a"), "b")
    catalog.drop_shard_key("b", 1)
    catalog.aliases([{"create": {"alias": "c", "collection": "a"}}, {"rename": {"old": "c", "new": "d"}}, {"delete": {"alias": "d"}}, {"create": {"alias": "d", "collection": "b"}}])
    catalog.drop("a")
    found = catalog.query("d", {"filter": {"must": [_c("vec_id", range={"lt": 1000})]}, "limit": None, "with_payload": ["label"]})
    return found.select("id", "label")


@register("reshard", "SELECT count(*) AS points, count(DISTINCT vec_id) AS ids, CAST(3 AS BIGINT) AS shards FROM embeddings")
def reshard(spark, sf_dir):
    """By the hash of the id; every point is in one shard."""
    catalog = Catalog(spark, shared_folder(spark, "catalog"))
    catalog.create("a", table(spark, sf_dir, "embeddings"), Config("vec_id"))
    catalog.reshard("a", 3)
    return catalog.open("a").points.agg(F.count("*").alias("points"), F.countDistinct("vec_id").alias("ids"), F.countDistinct("_shard").alias("shards"))


# selection, filters, counts


@register("payload_exclude", "SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders WHERE o_orderkey <= 400")
def payload_exclude(spark, sf_dir):
    c = rows_of(spark, sf_dir, "orders", "o_orderkey")
    every = {"exclude": ["o_totalprice", "o_orderdate", "o_orderpriority"]}
    return c.query({"filter": {"must": [_c("o_orderkey", range={"lte": 400})]}, "limit": None, "with_payload": every}).drop("score")


@register("payload_include_nested", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey = 7")
def payload_include_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("inner"), F.lit(1).alias("other")).alias("outer"))
    c = Collection(rows, "o_orderkey")
    found = c.query({"filter": {"must": [_c("o_custkey", match={"value": 7})]}, "limit": None, "with_payload": ["outer.inner.status"]})
    return found.select("id", "outer.inner.*")


@register("with_vector", "SELECT vec_id AS id, len(embedding) AS dim FROM embeddings WHERE label = 2")
def with_vector(spark, sf_dir):
    found = embeddings(spark, sf_dir).query({"filter": {"must": [_c("label", match={"value": 2})]}, "limit": None, "with_vector": ["dot"]})
    return found.select("id", F.size("vector_dot").cast("long").alias("dim"))


@register("filter_merge", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 50000 AND o_custkey <= 900 AND (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT o_orderpriority = '5-LOW'")
def filter_merge(spark, sf_dir):
    """Clause by clause: alternatives of both become one list of alternatives."""
    one = {"must": [_c("o_totalprice", range={"gt": 50000})], "should": [_c("o_orderstatus", match={"value": "F"})]}
    two = {"must": [_c("o_custkey", range={"lte": 900})], "should": [_c("o_orderstatus", match={"value": "O"})], "must_not": [_c("o_orderpriority", match={"value": "5-LOW"})]}
    return rows_of(spark, sf_dir, "orders", "o_orderkey").count(merge(one, two))


@register("lookup_from", _top(_raw("Cosine", "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1005 - 1000)"), "true"))
def lookup_from(spark, sf_dir):
    """The example is a point of another collection, so no point here is left out."""
    c = embeddings(spark, sf_dir)
    other = Collection(c.points.withColumn("vec_id", F.col("vec_id") + 1000), "vec_id", {"v": Vector("embedding")})
    found = c.query({"query": 1005, "using": "cosine", "limit": 10, "lookup_from": {"collection": other, "vector": "v"}})
    return rounded(ranked(found, *fusion.ordering()))


@register("facet_bool", "SELECT o_totalprice > 150000 AS value, count(*) AS count FROM orders GROUP BY 1")
def facet_bool(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("dear", F.col("o_totalprice") > 150000)
    return Collection(rows, "o_orderkey").facet("dear")


@register("count_estimate", "WITH n AS (SELECT count(*)::DOUBLE AS n FROM lineitem WHERE substr(md5(concat_ws(':', l_orderkey, '5')), 1, 8) < '10000000' AND l_quantity >= 25) SELECT n * 16 AS count, round(greatest(0, n * 16 - 32 * sqrt(n * 15 / 16)), 4) AS low, round(n * 16 + 32 * sqrt(n * 15 / 16), 4) AS high FROM n")
def count_estimate(spark, sf_dir):
    c = Collection(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return rounded(c.count_estimate({"must": [_c("l_quantity", range={"gte": 25})]}, bits=4, seed=5), "low", "high")


# stored indexes


@register("sparse_index_search", ORACLE_SQL["sparse_dot"])
def sparse_index_search(spark, sf_dir):
    where = shared_folder(spark, "postings")
    indexes.write_sparse(_sparse(spark, sf_dir), "vec_id", "v", where, 8)
    found = indexes.search_sparse(spark, where, _SPARSE_Q, 8)
    return rounded(ranked(found.orderBy(*fusion.ordering()).limit(15), *fusion.ordering()))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _text_index(name: str, mode: str, sql: str):
    @register(name, f"WITH w AS (SELECT item_id AS id, {_WORDS} AS ws FROM benchmark) SELECT id FROM w WHERE {sql}")
    def run(spark, sf_dir):
        where, tokenizer = shared_folder(spark, "text"), Tokenizer()
        indexes.write_text(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), tokenizer, where, 8)
        return indexes.match_text(spark, where, tokenizer.query("to the"), mode, 8)


_text_index("text_index_all", "all", "list_contains(ws, 'to') AND list_contains(ws, 'the')")
_text_index("text_index_any", "any", "list_contains(ws, 'to') OR list_contains(ws, 'the')")
_text_index("text_index_phrase", "phrase", "contains(' ' || list_aggregate(ws, 'string_agg', ' ') || ' ', ' to the ')")


# older shapes


def _old(name: str, call, body: dict, sql: str):
    @register(name, sql)
    def run(spark, sf_dir):
        return rounded(ranked(call(embeddings(spark, sf_dir), body), *fusion.ordering()))


_old("legacy_search", legacy.search, {"vector": {"name": "cosine", "vector": [0.5] * 64}, "limit": 10, "filter": {"must": [_c("label", match={"any": [1, 2]})]}}, _top(_raw("Cosine", "[0.5::DOUBLE for _ in range(64)]"), "label IN (1, 2)"))
_old("legacy_recommend", legacy.recommend, {"positive": [1, 2], "negative": [3], "using": "cosine", "limit": 10}, ORACLE_SQL["reco_avg"])
_old("legacy_discover", legacy.discover, {"target": 0, "context": [{"positive": 1, "negative": 2}, {"positive": 3, "negative": 4}], "using": "cosine", "limit": 10}, ORACLE_SQL["discover"])


@register("legacy_search_groups", f"WITH s AS (SELECT vec_id AS id, label AS group_id, {_raw('Cosine', '[0.5::DOUBLE for _ in range(64)]')} AS score FROM embeddings), h AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id DESC) AS hit_rank FROM s), g AS (SELECT group_id, row_number() OVER (ORDER BY score DESC, id DESC, group_id) AS group_rank FROM h WHERE hit_rank = 1) SELECT group_id, CAST(group_rank AS INT) AS group_rank, CAST(hit_rank AS INT) AS hit_rank, id, round(score, 4) AS score FROM h JOIN g USING (group_id) WHERE hit_rank <= 2 AND group_rank <= 4")
def legacy_search_groups(spark, sf_dir):
    body = {"vector": {"name": "cosine", "vector": [0.5] * 64}, "group_by": "label", "group_size": 2, "limit": 4}
    return rounded(legacy.search_groups(embeddings(spark, sf_dir), body))


# vectors


@register("sparse_combine", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) > 0.1 THEN x::DOUBLE ELSE 0 END)) + 1.5 - 0.5 + 2.0, 4) AS total, CAST(len(list_filter(list_zip(embedding, range(len(embedding))), lambda z: abs(z[1]::DOUBLE) > 0.1 OR z[2] IN (3, 10, 40))) AS INT) AS n FROM embeddings")
def sparse_sum(spark, sf_dir):
    """The sum with another sparse vector, over the indices of both."""
    other = F.create_map(*[F.lit(x) for i, w in _SPARSE_Q.items() for x in (i, w)]).cast("map<bigint,double>")
    rows = _sparse(spark, sf_dir).select("vec_id", sparse_combine(F.map_from_arrays("v.indices", "v.values"), other, lambda a, b: a + b).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda t, x: t + x)
    return rows.select("vec_id", F.round(total, 4).alias("total"), F.size("m").alias("n"))


@register("two_bit_codes", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x::DOUBLE > -0.1)) AS BIGINT) AS first, CAST(len(list_filter(embedding, lambda x: x::DOUBLE >= 0.1)) AS BIGINT) AS second FROM embeddings")
def two_bit_codes(spark, sf_dir):
    """How many first and second bits are set. The deviation is chosen so that two thirds of it are 0.1."""
    code = two_bit_code(F.col("embedding"), [0.0] * 64, [0.15] * 64)
    bits = F.concat(*[F.reverse(F.lpad(F.bin(code[i]), 63 if i < 2 else 2, "0")) for i in range(3)])
    ones = lambda s: F.length(F.replace(s, F.lit("0"), F.lit(""))).cast("long")
    return table(spark, sf_dir, "embeddings").select("vec_id", ones(F.substring(bits, 1, 64)).alias("first"), ones(F.substring(bits, 65, 64)).alias("second"))


_CHUNK = 16
_BOOK = " UNION ALL ".join(f"SELECT {c} AS chunk, vec_id AS n, list_slice(embedding, {c * _CHUNK + 1}, {(c + 1) * _CHUNK})::DOUBLE[] AS b FROM embeddings WHERE vec_id < 4" for c in range(4))


def _books(rows: DataFrame) -> list:
    """Four centroids for each chunk: the chunks of the first four vectors."""
    first = [r["embedding"] for r in rows.where("vec_id < 4").orderBy("vec_id").collect()]  # four rows
    return [[[float(x) for x in v[c * _CHUNK : (c + 1) * _CHUNK]] for v in first] for c in range(4)]


_CODES = f"b AS ({_BOOK}), d AS (SELECT vec_id, chunk, n, row_number() OVER (PARTITION BY vec_id, chunk ORDER BY list_distance(list_slice(embedding, chunk * {_CHUNK} + 1, chunk * {_CHUNK} + {_CHUNK})::DOUBLE[], b), n) AS r FROM (SELECT x.vec_id, x.embedding, b.* FROM embeddings x, b))"


@register("product_codes", f"WITH {_CODES} SELECT vec_id, string_agg(n, ',' ORDER BY chunk) AS codes FROM d WHERE r = 1 GROUP BY 1")
def product_code_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.concat_ws(",", product_codes(F.col("embedding"), _books(rows)).cast("array<string>")).alias("codes"))


@register("product_rescore", f"WITH {_CODES}, k AS (SELECT vec_id, sum(list_dot_product(b, list_slice({_vec(0)}, chunk * {_CHUNK} + 1, chunk * {_CHUNK} + {_CHUNK}))) AS s FROM d JOIN b USING (chunk, n) WHERE r = 1 AND vec_id <> 0 GROUP BY 1 ORDER BY round(s, 9) DESC, vec_id DESC LIMIT 80), " + _top(_raw("Dot", _vec(0)), "vec_id IN (SELECT vec_id FROM k)").removeprefix("WITH "))
def product_rescore(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    query = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    return rounded(ranked(quantized.product_search(rows.where("vec_id <> 0"), "vec_id", "embedding", query, _books(rows), 10, 8.0), *fusion.ordering()))


@register("quantile_bounds", "SELECT round(quantile_disc(x, 0.05), 2) AS low, round(quantile_disc(x, 0.95), 2) AS high FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def quantile_bounds(spark, sf_dir):
    low, high = quantized.bounds(table(spark, sf_dir, "embeddings"), "embedding", 0.9)
    return spark.createDataFrame([(round(low, 2), round(high, 2))], "low double, high double")


@register("min_max", _lists(("Cosine", 0, 20, True), ("Euclid", 1, 20, False), hidden="0, 1") + " SELECT CAST(src AS INT) AS src, id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) AS score FROM l WINDOW w AS (PARTITION BY src)")
def min_max(spark, sf_dir):
    c, hidden = embeddings(spark, sf_dir), {"must_not": [{"has_id": [0, 1]}]}
    one = c.query({"query": 0, "using": "cosine", "limit": 20, "filter": hidden}).select(F.lit(0).alias("src"), "id", "score")
    two = c.query({"query": 1, "using": "euclid", "limit": 20, "filter": hidden}).select(F.lit(1).alias("src"), "id", "score")
    return rounded(fusion.min_max(one.unionByName(two), "src"))


# text and times


@register("datetime_parse", "SELECT event_id, ts::DATE::TIMESTAMP AS day, date_trunc('minute', ts) AS minute, date_trunc('second', ts) AS second FROM events")
def datetime_parse(spark, sf_dir):
    """Strings in three of the accepted forms, one of them with a zone."""
    rows = table(spark, sf_dir, "events")
    text = lambda form: F.date_format(F.col("ts"), form)
    second = F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    forms = {"day": text("yyyy-MM-dd"), "minute": text("yyyy-MM-dd HH:mm"), "second": second}
    return rows.select("event_id", *[parsed(v).cast("timestamp_ntz").alias(k) for k, v in forms.items()])


@register("prefix_tokens", f"WITH w AS (SELECT unnest({_WORDS}) AS w FROM benchmark), p AS (SELECT substr(w, 1, unnest(range(2, least(length(w), 4) + 1))) AS token FROM w) SELECT token, count(*) AS n FROM p GROUP BY 1")
def prefix_tokens(spark, sf_dir):
    tokens = Tokenizer("prefix", min_len=2, max_len=4).document(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# routing


@register("shard_selection", "SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 3)")
def shard_selection(spark, sf_dir):
    """Shards by key, one of them by its fallback."""
    c = Collection(table(spark, sf_dir, "embeddings"), "vec_id", shard="label")
    return c.where(None, routing.select_shards([0, 1, 2, 3], [1, 99], fallback=3)).select(F.col("vec_id").alias("id"), "label")


@register("copies_dedupe", "SELECT vec_id AS id, round(max(score), 4) AS score FROM (SELECT (vec_id % 100) AS vec_id, " + _raw("Dot", _vec(0)) + " AS score FROM embeddings) GROUP BY 1")
def copies_dedupe(spark, sf_dir):
    """Ids above a block are copies of those in it."""
    found = embeddings(spark, sf_dir).query({"query": [float(x) for x in _example(spark, sf_dir)], "using": "dot", "limit": None})
    return rounded(routing.without_copies(found.select((F.col("id") + 1).alias("id"), "score"), 100))


def _example(spark, sf_dir) -> list:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_NEAREST = "row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], v), shard)"


@register("lloyd_step", f"WITH {_CENTRES}, d AS (SELECT vec_id, embedding, shard, {_NEAREST} AS n FROM embeddings, c), u AS (SELECT shard, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM d WHERE n = 1), m AS (SELECT shard, i, avg(x) AS a FROM u GROUP BY 1, 2) SELECT CAST(shard AS INT) AS shard, round(sqrt(sum(a * a)), 4) AS length FROM m GROUP BY 1")
def lloyd_step(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    labels, centres = _centroids(rows)
    moved = routing.lloyd_step(rows, "embedding", centres)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    return moved.select(F.array(*map(F.lit, labels))[F.col("shard")].cast("int").alias("shard"), F.round(length, 4).alias("length"))


_NEAR = "WITH e AS (SELECT l_partkey AS id, l_suppkey AS node, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS place, CAST(l_suppkey % 5 AS INT) AS shard FROM lineitem), f AS (SELECT id, shard, count(*) AS votes, arg_min(node, place) AS node FROM e GROUP BY 1, 2), k AS (SELECT * FROM f WINDOW w AS (PARTITION BY id) QUALIFY (votes >= max(votes) OVER w - 1 AND max(votes) OVER w >= 2) OR row_number() OVER (PARTITION BY id ORDER BY votes DESC, shard) = 1)"


@register("node_weights", _NEAR + " SELECT s_suppkey AS node, count(k.id) AS weight FROM supplier LEFT JOIN k ON k.node = s_suppkey GROUP BY 1")
def node_weights(spark, sf_dir):
    """Parts as points, their suppliers as sampled nodes in the order of the orders."""
    place = F.struct("l_orderkey", "l_linenumber").alias("place")
    near = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), place, F.col("l_suppkey").alias("node"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 5).cast("int").alias("shard"))
    return routing.node_weights(near, nodes, delta=1)


#: Greedy diversity in SQL: the rows chosen so far are a list that each step extends.
_MMR = (
    "WITH RECURSIVE c AS MATERIALIZED (SELECT vec_id AS id, score, v FROM (SELECT vec_id, " + _raw("Cosine", _vec(0)) + " AS score, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE vec_id <> 0) ORDER BY score DESC, id DESC LIMIT 50), "
    "p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.score, list_dot_product(a.v, b.v) AS s FROM c a, c b), "
    "g AS (SELECT 1 AS n, [(SELECT id FROM c ORDER BY score DESC, id LIMIT 1)] AS chosen UNION ALL "
    "SELECT n + 1, list_append(chosen, (SELECT a FROM p WHERE list_contains(g.chosen, b) AND NOT list_contains(g.chosen, a) GROUP BY a ORDER BY 0.4 * any_value(score) - 0.6 * max(s) DESC, a LIMIT 1)) FROM g WHERE n < 10) "
    "SELECT id, round(score, 4) AS score, CAST(list_position((SELECT chosen FROM g WHERE n = 10), id) - 1 AS BIGINT) AS place FROM c WHERE list_contains((SELECT chosen FROM g WHERE n = 10), id)"
)
ORACLE_SQL["mmr"] = _MMR
