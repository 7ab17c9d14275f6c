"""Semantics that the tables do not show, on small fixtures with results worked out by hand."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, text, vectors
from tessera.functions.formula import Formula
from tessera.functions.paths import ANY, parse
from tessera.operators import fusion, quantized, routing
from tessera.plans import scoring
from tessera.plans.collection import Collection, Vector
from tessera.plans.predicates import Context, compile_filter, merge, two_valued
from tessera.sources import points as sources
from tessera.sources.catalog import Catalog, Config, StrictMode
from tessera.streaming import oplog, payloads

DOCS = [
    (1, '{"a": 1, "t": "the quick brown fox", "n": {"x": [1, 2, 3]}, "cities": [{"name": "B", "pop": 3}, {"name": "C", "pop": 9}]}'),
    (2, '{"a": 1.0, "t": "quick", "n": {"x": []}, "cities": [{"name": "B", "pop": 9}]}'),
    (3, '{"a": "1", "n": {"x": null}, "d": "2024-05-01"}'),
    (4, '{"a": true, "n": {}, "d": "2024-05-01T12:00:00+02:00"}'),
    (5, '{"a": null, "k": ["a", "b"], "loc": {"lon": 0.5, "lat": 0.5}}'),
    (6, '{"a": [1, "x"], "k": [null]}'),
    (7, "{}"),
]


@pytest.fixture(scope="module")
def variants(spark):
    df = spark.createDataFrame(DOCS, "id long, payload string").withColumn("payload", F.parse_json("payload"))
    return Collection(df, "id", payload="payload")


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def hits(c, **condition):
    return ids(c.where({"must": [condition]}))


def test_paths():
    assert parse('a.b[0].c[]."x.y"') == ["a", "b", 0, "c", ANY, "x.y"]
    for bad in ("", ".a", "a..b", "[0]", "a[", "a."):
        with pytest.raises(ValueError):
            parse(bad)


def test_strict_types(variants):
    assert hits(variants, key="a", match={"value": 1}) == [1, 6]
    assert hits(variants, key="a", match={"value": "1"}) == [3]
    assert hits(variants, key="a", match={"value": True}) == [4]
    assert hits(variants, key="a", range={"gte": 1}) == [1, 2, 6]
    assert hits(variants, key="a", match={"any": ["x", "1"]}) == [3, 6]
    assert hits(variants, key="a", match={"except": [1]}) == [2, 3, 4, 6]
    assert hits(variants, key="k", match={"except": ["a"]}) == [5]


def test_arrays_and_paths(variants):
    assert hits(variants, key="n.x", match={"value": 2}) == [1]
    assert hits(variants, key="n.x[1]", match={"value": 2}) == [1]
    assert hits(variants, key="cities[].pop", range={"gt": 5}) == [1, 2]
    assert hits(variants, nested={"key": "cities", "filter": {"must": [{"key": "name", "match": {"value": "B"}}, {"key": "pop", "range": {"gt": 5}}]}}) == [2]
    assert hits(variants, nested={"key": "cities", "filter": {"must_not": [{"has_id": [1]}, {"key": "name", "match": {"value": "B"}}]}}) == [1]


def test_empty_null_count(variants):
    assert hits(variants, is_empty={"key": "n.x"}) == [2, 3, 4, 5, 6, 7]
    assert hits(variants, is_null={"key": "n.x"}) == [3]
    assert hits(variants, is_null={"key": "k"}) == []
    assert hits(variants, key="k", is_null=True) == [6]
    assert hits(variants, key="n.x", values_count={"lt": 1}) == [2, 3]
    assert hits(variants, key="n.x", values_count={"gte": 1}) == [1]
    assert hits(variants, key="n.x", is_empty=False) == [1]


def test_times_geo_text(variants):
    assert hits(variants, key="d", range={"gte": "2024-05-01T10:00:00Z"}) == [4]
    assert hits(variants, key="d", range={"lt": "2024-05-01 10:00"}) == [3]
    assert hits(variants, key="loc", geo_radius={"center": {"lon": 0, "lat": 0}, "radius": 78_627}) == [5]
    assert hits(variants, key="loc", geo_radius={"center": {"lon": 0, "lat": 0}, "radius": 78_626}) == []
    assert hits(variants, key="t", match={"text": "quick brown"}) == [1]
    assert hits(variants, key="t", match={"text_any": "slow quick"}) == [1, 2]
    tokens = variants.narrowed(tokenizers={"t": text.Tokenizer()})
    assert hits(tokens, key="t", match={"text": "fox quick"}) == [1]
    assert hits(tokens, key="t", match={"phrase": "quick brown"}) == [1]
    assert hits(tokens, key="t", match={"phrase": "brown quick"}) == []
    assert hits(tokens, key="t", match={"text": "!"}) == []


def test_clauses(variants):
    everything = [1, 2, 3, 4, 5, 6, 7]
    one, two = {"has_id": [1, 2]}, {"has_id": [2, 3]}
    assert ids(variants.where({"must": [], "should": []})) == everything
    assert ids(variants.where({"min_should": {"conditions": [one, two], "min_count": 2}})) == [2]
    assert ids(variants.where({"min_should": {"conditions": [one], "min_count": 0}})) == everything
    assert ids(variants.where({"min_should": {"conditions": [one], "min_count": 2}})) == []
    assert ids(variants.where(merge({"should": [one]}, {"should": [two], "must_not": [{"has_id": [1]}]}))) == [2, 3]
    with pytest.raises(ValueError):
        variants.where({"must": [{"key": "a", "range": {"gt": 1}, "match": {"value": 1}}]})


_leaf = st.sampled_from([{"key": "a", "match": {"value": 1}}, {"key": "a", "range": {"lt": 2}}, {"is_empty": {"key": "k"}}, {"has_id": [1, 5]}, {"key": "k", "match": {"except": ["a"]}}])
_spec = st.recursive(_leaf, lambda c: st.fixed_dictionaries({}, optional={"must": st.lists(c, max_size=2), "should": st.lists(c, max_size=2), "must_not": st.lists(c, max_size=2)}), max_leaves=5)


@settings(max_examples=12, deadline=None)
@given(spec=_spec)
def test_not_is_the_complement(variants, spec):
    assert sorted(ids(variants.where({"must": [spec]})) + ids(variants.where({"must_not": [spec]}))) == [1, 2, 3, 4, 5, 6, 7]


def test_pushdown(spark):
    c = Collection(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_orderkey")
    plan = c.where({"must": [{"key": "l_quantity", "range": {"gt": 10}}]}).select("l_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hand_computed_scores(spark):
    s = lambda x: F.lit(x)  # noqa: E731  a similarity that is its example
    assert value(spark, scoring.best_score(s, [0.8], [0.2])) == pytest.approx(0.7222, abs=1e-4)
    assert value(spark, scoring.best_score(s, [0.2], [0.8])) == pytest.approx(-0.7222, abs=1e-4)
    assert value(spark, scoring.best_score(s, [0.5], [0.5])) == pytest.approx(-0.6667, abs=1e-4)
    assert value(spark, scoring.sum_scores(s, [0.8, 0.1], [0.3])) == pytest.approx(0.6)
    assert scoring.average([[1.0, 0.0]], [[0.0, 1.0]]) == [2.0, -1.0]
    assert value(spark, scoring.discover(s, 0.5, [(0.9, 0.1)])) == pytest.approx(1.6667, abs=1e-4)
    assert value(spark, scoring.context(s, [(0.1, 0.9)])) == pytest.approx(-0.4444, abs=1e-4)
    assert value(spark, scoring.context(s, [(0.9, 0.1)])) == 0
    assert value(spark, scoring.feedback(s, 0.3, [(0.6, 0.9), (0.2, 0.4)], 1.0, 1.0, 2.0)) == pytest.approx(0.7)
    assert value(spark, vectors.reported(F.lit(-4.0), "Euclid")) == 2
    assert value(spark, text.idf(F.lit(10), F.lit(1))) == pytest.approx(1.9924, abs=1e-4)
    assert value(spark, text.bm25_weight(F.lit(2), F.lit(256))) == pytest.approx(1.375)
    assert value(spark, geo.distance(F.lit(0.0), F.lit(0.0), 0.5, 0.5)) == pytest.approx(78_626.29627999, abs=1e-6)
    assert text.murmur3_32(b"hello") == 613153351


def test_polygon(spark):
    ring = [{"lon": x, "lat": y} for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    hole = [{"lon": x / 2, "lat": y / 2} for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    inside = lambda x, y, holes=(): value(spark, geo.in_polygon(F.lit(float(x)), F.lit(float(y)), ring, holes))
    assert inside(0.9, 0) and not inside(1, 0) and not inside(2, 0)
    assert inside(0.75, 0, [hole]) and not inside(0, 0, [hole]) and not inside(0.5, 0.5, [hole])
    with pytest.raises(ValueError):
        geo.in_polygon(F.lit(0.0), F.lit(0.0), ring[:3])


def test_formula(spark):
    df = spark.createDataFrame([(1, [1.2], 5.0)], "id int, p array<double>, q double")
    run = lambda spec, defaults=None, scores=(0.25,): df.select(Formula(Context(df.schema), [F.lit(x) for x in scores], defaults).column(spec).alias("x")).first()["x"]
    assert run({"sum": ["p", "$score", "$score[1]"]}) == pytest.approx(1.45)
    assert run("missing", {"missing": 85}) == 85
    assert run({"div": {"left": 0.0, "right": 0.0}}) == 0
    assert run({"div": {"left": 1.0, "right": 0.0, "by_zero_default": 7}}) == 7
    assert run({"mult": [0.0, {"ln": -1.0}]}) == 0
    for decay in ("exp_decay", "gauss_decay", "lin_decay"):
        assert run({decay: {"x": "q", "target": 3.0, "scale": 2.0}}) == pytest.approx(0.5)
    assert run({"lin_decay": {"x": "q", "target": 1.0, "scale": 2.0}}) == 0
    assert run({"key": "q", "range": {"gt": 1}}) == 1
    for bad in ("missing", {"ln": -1.0}, {"div": {"left": 1.0, "right": 0.0}}):
        with pytest.raises(Exception, match="value|zero"):
            run(bad)


def test_fusion(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id long, score double")
    a, b = mk([(1, 0.9), (2, 0.8)]), mk([(2, 5.0)])
    got = {r["id"]: r["score"] for r in fusion.rrf([(a, True), (b, True)], weights=[1.0, 3.0]).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(1 / 3 + 0.75)
    assert {r["score"] for r in fusion.rrf([(b, True)], weights=[0.0]).collect()} == {0.0}
    norm = {r["id"]: r["score"] for r in fusion.dbsf([(mk([(1, 1.0), (2, 2.0), (3, 3.0)]), True), (mk([(4, 9.0)]), True)]).collect()}
    assert norm == {1: pytest.approx(1 / 3), 2: 0.5, 3: pytest.approx(2 / 3), 4: 0.5}
    with pytest.raises(ValueError):
        fusion.rrf([(a, True)], weights=[1.0, 2.0])


def test_mmr():
    vectors_ = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]]
    found = fusion.mmr([(1, 0.9, vectors_[0]), (2, 0.89, vectors_[1]), (3, 0.5, vectors_[2])], lambda m: m @ m.T, 0.5, 2)
    assert [i for i, _ in found] == [1, 3]


def test_mmr_query(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(20)]
    c = Collection(spark.createDataFrame(rows, "id long, v array<double>"), "id", {"": Vector("v")})
    got = [r["id"] for r in c.query({"query": {"nearest": 0, "mmr": {"diversity": 0.7, "candidates_limit": 8}}, "limit": 4}).collect()]
    q = np.array(rows[0][1])
    top = sorted(((float(np.dot(q, v)), i) for i, v in rows[1:]), key=lambda x: (-x[0], -x[1]))[:8]
    want = fusion.mmr([(i, s, rows[i][1]) for s, i in top], lambda m: m @ m.T, 0.7, 4)
    assert got == [i for i, _ in want]


def test_scaled_and_zero_vectors(spark):
    c = Collection(spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.5]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>"), "id", {"": Vector("v")})
    got = {r["id"]: round(r["score"], 6) for r in c.query({"query": [2.0, 0.0], "limit": 9}).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    assert ids(c.where({"must": [{"has_vector": ""}]})) == [1, 2, 3]


def test_multi_and_sparse(spark):
    multi = Collection(spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.5, 0.5]])], "id long, v array<array<double>>"), "id", {"": Vector("v", "Dot", "multi")})
    assert [(r["id"], r["score"]) for r in multi.query({"query": {"nearest": [[1.0, 0.0], [0.0, 2.0]]}}).collect()] == [(1, 3.0), (2, 1.5)]
    rows = [(1, ([5, 2], [1.0, -2.0])), (2, ([7], [1.0])), (3, ([2], [0.0]))]
    sparse = Collection(spark.createDataFrame(rows, "id long, v struct<indices: array<long>, values: array<double>>"), "id", {"": Vector("v", "Dot", "sparse")})
    assert [(r["id"], r["score"]) for r in sparse.query({"query": {"indices": [2, 5], "values": [1.0, 1.0]}}).collect()] == [(3, 0.0), (1, -1.0)]


def test_groups_of_mixed_keys(spark):
    rows = [(1, '"a"', 0.9), (2, '["a", 7]', 0.8), (3, '["b", 1.5]', 0.7), (4, "null", 0.6), (5, "7", 0.5), (6, "[]", 0.4)]
    df = spark.createDataFrame(rows, "id long, k string, s double").select("id", F.array("s").alias("v"), F.parse_json(F.concat(F.lit('{"k":'), "k", F.lit("}"))).alias("payload"))
    c = Collection(df, "id", {"": Vector("v", "Dot")}, payload="payload")
    got = [(r["group_id"], r["id"]) for r in c.query_groups({"query": [1.0]}, "k", 2, 5).orderBy("group_rank", "hit_rank").collect()]
    assert got == [("a", 1), ("a", 2), ("7", 2), ("7", 5)]


def test_order_scroll_pages(spark):
    c = Collection(spark.createDataFrame([(i, [float(i % 3), 9.0] if i % 2 else None) for i in range(6)], "id long, v array<double>"), "id")
    got = [(r["id"], r["order_value"]) for r in c.scroll(limit=4, order_by="v", with_payload=False).collect()]
    assert got == [(3, 0.0), (1, 1.0), (5, 2.0), (1, 9.0)]
    assert c.next_page(None, 4) == 4 and c.next_page(None, 10) is None
    with pytest.raises(ValueError):
        c.scroll(limit=0)


def test_tokenizers(spark):
    df = spark.createDataFrame([("Ünïted  Stàtes, of-the",)], "t string")
    run = lambda tok: df.select(tok.document(F.col("t")).alias("x")).first()["x"]
    assert run(text.Tokenizer()) == ["ünïted", "stàtes", "of", "the"]
    assert run(text.Tokenizer(kind="whitespace", lowercase=False)) == ["Ünïted", "Stàtes,", "of-the"]
    assert run(text.Tokenizer(ascii_folding=True, stopwords=("of", "the"))) == ["united", "states"]
    assert run(text.Tokenizer(kind="prefix", min_len=2, max_len=3, ascii_folding=True)) == ["un", "uni", "st", "sta", "of", "th", "the"]
    assert text.Tokenizer(kind="prefix", max_len=3).query("United of") == ["uni", "of"]


def test_quantisers(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [-1.0, 0.5, 1.0])], "id long, v array<double>")
    codes = {r["id"]: r["c"] for r in df.select("id", vectors.scalar_codes(F.col("v"), -1.0, 2.0).alias("c")).collect()}
    assert codes == {1: [42, 85, 127], 2: [0, 64, 85]}
    assert vectors.binary_code_of([1.0, -1.0, 2.0]) == [5]
    books = [[[0.0], [1.0]], [[0.0, 0.0], [1.0, 1.0]]]
    assert df.select(vectors.product_codes(F.col("v"), books).alias("c")).collect()[0]["c"] == [0, 1]
    got = quantized.scalar_search(df, "id", "v", [0.0, 0.0, 1.0], 1).first()
    assert got["id"] == 1 and got["score"] == pytest.approx(2.0)


def test_routing():
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    assert routing.route_nprobe([5.0, 1.0], centres, 2) == [0, 1]
    shards, ef = routing.route_two_tier([1.0, 0.1], centres, [[0], [0, 1], [2]], 2, 48, 14)
    assert shards == [0, 1] and ef == {0: 76, 1: 62}
    assert np.bincount(routing.balanced(np.zeros((6, 2)), centres, 1.0)).max() == 2
    assert routing.converge(np.array([[1, 2], [0, 2], [0, 1]]), np.array([0, 1, 1])).tolist() in ([1, 1, 1], [1, 0, 0], [0, 1, 1], [1, 1, 0])
    assert routing.select_shards([1, 2, 3], [2, 9], fallback=1) == [2, 1]
    assert routing.may_route({"query": 1}, "") and not routing.may_route({"query": 1, "filter": {"must": []}, "prefetch": [1]}, "")
    assert len(set(routing.place(np.ones((4, 6)), 3))) == 3


def test_votes_and_copies(spark):
    votes = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 1), (2, 0, 1), (2, 3, 1)], "id long, shard int, votes int")
    assert sorted((r["id"], r["shard"]) for r in routing.shards_by_votes(votes).collect()) == [(1, 0), (1, 1), (2, 0)]
    found = spark.createDataFrame([(3, 0.5), (13, 0.9), (4, 0.1)], "id long, score double")
    assert sorted((r["id"], r["score"]) for r in routing.without_copies(found, 10).collect()) == [(2, 0.9), (3, 0.1)]


def test_payload_changes():
    assert payloads.merged({"a": 1, "b": 2}, {"b": None, "c": 3}) == {"a": 1, "c": 3}
    assert payloads.set_at({"a": {"b": 1}}, parse("a.c"), {"d": 2}) == {"a": {"b": 1, "c": {"d": 2}}}
    assert payloads.set_at({"l": [{"x": 1}, {}]}, parse("l[]"), {"y": 2}) == {"l": [{"x": 1, "y": 2}, {"y": 2}]}
    assert payloads.set_at({"l": [{}]}, parse("l[3]"), {"y": 2}) == {"l": [{}]}
    assert payloads.delete_at({"a": {"b": 1, "c": 2}}, parse("a.b")) == {"a": {"c": 2}}
    assert payloads.delete_at({"l": [1, 2]}, parse("l[]")) == {"l": []}
    assert payloads.delete_at({"l": [1, 2]}, parse("l[0]")) == {"l": [1, 2]}
    assert payloads.selected({"a": {"b": 1, "c": 2}, "d": 3}, [parse("a.b")], []) == {"a": {"b": 1}}
    assert payloads.selected({"a": {"b": 1, "c": 2}, "d": 3}, None, [parse("a.b")]) == {"a": {"c": 2}, "d": 3}


OPS = [
    (1, "upsert", {"points": [{"id": 1, "vector": [1.0], "payload": {"c": "x"}}, {"id": 2, "vector": {"": [2.0]}, "payload": {"c": "y"}}, {"id": 2, "vector": [3.0]}]}),
    (2, "set_payload", {"ids": [1, 2], "payload": {"k": 1, "c": None}}),
    (3, "upsert", {"batch": {"ids": [3, 1], "vectors": [[5.0], [6.0]], "payloads": [{"z": 1}, None]}, "mode": "insert_only"}),
    (4, "delete_vectors", {"filter": {"must": [{"key": "z", "match": {"value": 1}}]}, "vectors": [""]}),
    (5, "update_vectors", {"points": [{"id": 1, "vector": [9.0]}]}),
    (6, "batch", {"operations": [{"kind": "set_payload", "body": {"ids": [1], "payload": {"q": 1}}}, {"kind": "delete_payload", "body": {"ids": [1], "keys": ["k"]}}]}),
    (7, "upsert", {"points": [{"id": 2, "payload": {"new": 1}}], "update_filter": {"must": [{"key": "k", "match": {"value": 2}}]}}),
    (8, "delete", {"ids": [77]}),
]
FINAL = {1: (6, {"q": 1}, [9.0]), 2: (2, {"k": 1}, [3.0]), 3: (4, {"z": 1}, None)}


def contents(df):
    return {r["id"]: (r["version"], json.loads(r["payload"]), r["vector_"]) for r in df.collect()}


def test_replay(spark):
    empty = spark.createDataFrame([], oplog.state_schema([""]))
    state = oplog.replay(empty, OPS)
    assert contents(state) == FINAL
    assert contents(oplog.apply_op(state, 1, "delete", {"ids": [1, 2, 3]})) == FINAL  # stale
    synced = oplog.apply_op(state, 9, "sync", {"from": 1, "to": 2, "points": [{"id": 1, "vector": [9.0], "payload": {"q": 1}}]})
    assert contents(synced) == {1: FINAL[1], 3: FINAL[3]}  # equal points keep their version


def test_streamed_log(spark, tmp_path):
    log = oplog.OpLog(spark, str(tmp_path / "state"), [""])
    (tmp_path / "log").mkdir()
    for n, part in enumerate((OPS[:3], OPS[2:6], OPS[6:])):  # one operation comes twice
        (tmp_path / "log" / f"{n}.json").write_text("".join(json.dumps({"op_num": o, "kind": k, "body": json.dumps(b)}) + "\n" for o, k, b in part))
        log.stream(str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert contents(log.state()) == FINAL and log.current()[1] == 8


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    points = spark.createDataFrame([(i, [float(i)], "x" if i % 2 else "y", f"word{i} text") for i in range(6)], "id long, v array<float>, s string, t string")
    catalog.create("c", points, Config("id", {"": {"column": "v", "distance": "Dot"}}, strict={"max_query_limit": 5, "unindexed_filtering": False}))
    catalog.aliases([{"create": {"alias": "d", "collection": "c"}}, {"rename": {"old": "d", "new": "e"}}])
    assert [r["id"] for r in catalog.query("e", {"query": [1.0], "limit": 2}).collect()] == [5, 4]
    with pytest.raises(ValueError):
        catalog.query("c", {"query": [1.0], "limit": 6})
    with pytest.raises(ValueError):
        catalog.query("c", {"query": [1.0], "limit": 2, "filter": {"must": [{"key": "s", "match": {"value": "x"}}]}})
    catalog.declare("c", "s", "keyword")
    catalog.declare("c", "t", "text")
    assert [r["id"] for r in catalog.query("c", {"query": [1.0], "limit": 2, "filter": {"must": [{"key": "s", "match": {"value": "y"}}]}}).collect()] == [4, 2]
    assert ids(catalog.open("c").where({"must": [{"key": "t", "match": {"text": "TEXT word3"}}]})) == [3]
    key = catalog.snapshot("c")
    catalog.replace("c", points.where("id < 2"))
    assert catalog.open("e").points.count() == 2
    catalog.restore(key, "old")
    assert catalog.open("old").points.count() == 6 and catalog.names() == ["c", "old"]
    catalog.reshard("old", 3)
    shards = catalog.open("old")
    plan = shards.where(None, [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_shard" in plan
    catalog.drop_shard_key("old", 0)
    assert catalog.open("old").points.where("_shard = 0").count() == 0
    catalog.drop("c")
    assert catalog.names() == ["old"]


def test_strict_mode_counts_conditions():
    with pytest.raises(ValueError):
        StrictMode(max_conditions=1).check({"filter": {"must": [{"key": "a"}, {"should": [{"key": "b"}]}]}})


def test_requests_without_a_limit(spark):
    from tessera.plans.queries import QUERIES

    c = Collection(spark.range(30).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")), "id", {"": Vector("v", "Dot")})
    first = {"query": [1.0, 0.0], "limit": None}
    assert c.query(first).count() == 30 and c.query({**first, "offset": 4}).count() == 26
    assert c.query_batch([first, first]).count() == 60 and c.facet("id", limit=None).count() == 30
    assert c.query({"prefetch": first, "query": {"formula": "$score"}, "limit": 20}).count() == 20
    with pytest.raises(ValueError):
        StrictMode(max_query_limit=5).check(first)
    for name in ("knn_threshold", "context", "unique_values", "geo_distance_formula"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("GlobalLimit") == (name == "geo_distance_formula"), plan


def test_sources(spark, tmp_path):
    made = sources.from_rows(spark, [{"id": 1, "vector": [1.0], "payload": {"a": 1}}, {"id": 2}])
    assert [r["vector_"] for r in made.orderBy("id").collect()] == [[1.0], None]
    with pytest.raises(ValueError):
        sources.from_rows(spark, [{"id": 1 << 63}])
    batch = spark.createDataFrame([([1, 2], [[1.0], [2.0]], ["a", "b"])], "i array<long>, v array<array<double>>, p array<string>")
    assert ids(sources.from_columns(batch, "i", "v", "p")) == [1, 2]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "shard": 0}\n{"id": 2, "shard": 1}\n')
    spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<double>").write.parquet(str(tmp_path / "v"))
    good = {"points": 2, "dim": 1, "shards": 2}
    assert sources.import_shards(spark, good, str(tmp_path / "a.jsonl"), str(tmp_path / "v")).count() == 2
    with pytest.raises(ValueError):
        sources.import_shards(spark, {**good, "dim": 3}, str(tmp_path / "a.jsonl"), str(tmp_path / "v"))


def test_projection(spark):
    df = spark.createDataFrame([(1, ("x", [("B", 1)], 5))], "id long, p struct<a: string, l: array<struct<n: string, m: int>>, z: int>")
    c = Collection(df, "id", payload="p")
    assert c.retrieve([1], ["a", "l[].n"]).first().asDict(True) == {"id": 1, "a": "x", "l": [{"n": "B"}]}
    assert c.retrieve([1], {"exclude": ["l[].m", "z"]}).first().asDict(True) == {"id": 1, "a": "x", "l": [{"n": "B"}]}


def test_two_valued(spark):
    df = spark.createDataFrame([(None,), (1,)], "a int")
    context = Context(df.schema)
    spec = {"must": [{"key": "a", "match": {"value": 1}}]}
    assert [r[0] for r in df.select(two_valued(compile_filter(spec, context))).collect()] == [False, True]
    assert isinstance(df.schema["a"].dataType, T.IntegerType)


def test_bm25_does_not_depend_on_partitions(spark):
    """The same scores to the last bit, however the documents are dealt out, and no shuffle of rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = set()
    for n in (1, 4, 7):
        found = text.bm25_search(docs.repartition(n), "doc_id", "text", "the from only license")
        seen.add(tuple(sorted((r["id"], r["score"]) for r in found.collect())))
    assert len(seen) == 1 and len(next(iter(seen))) > 50
    plan = text.bm25_search(docs, "doc_id", "text", "the from")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert text.bm25_search(docs, "doc_id", "text", "...").count() == 0


def test_two_bit_edges(spark):
    """Both bits from exactly two thirds of a deviation on; without a deviation the sign alone counts."""
    rows = spark.createDataFrame([([2.0 / 3, -2.0 / 3, 0.5, -0.5],), ([0.7, -0.6, -0.5, 0.0],)], "v array<double>")
    codes = [r[0][0] for r in rows.select(vectors.two_bit_code(F.col("v"), [0.0] * 4, [1.0, 1.0, 0.0, 0.0])).collect()]
    assert codes == [0b0001_0101, 0b0001_0011]


def test_fusion_of_string_ids(spark):
    one = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "id string, score double")
    two = spark.createDataFrame([("c", 1.0), ("b", 2.0), ("a", 2.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in fusion.rrf([(one, True), (two, False)]).collect()}
    assert got == pytest.approx({"b": 1 / 2 + 1 / 4, "a": 1 / 3 + 1 / 3, "c": 1 / 4 + 1 / 2})


def test_files_are_replaced(spark, tmp_path):
    from tessera.sources.files import replace_file

    for text in ("one", "two", "three"):
        replace_file(spark, f"{tmp_path}/CURRENT", text)
        assert (tmp_path / "CURRENT").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["CURRENT"]


def test_replayed_log_is_the_replay(spark):
    log = spark.createDataFrame([(o, k, json.dumps(b)) for o, k, b in OPS], oplog.LOG_SCHEMA)
    empty = spark.createDataFrame([], oplog.state_schema([""]))
    assert contents(oplog.replay_log(empty, log)) == FINAL
    # several points of one id in one operation: the last one; named vectors; a payload of nested values
    points = [{"id": 1, "vector": {"a": [1.0]}}, {"id": 1, "vector": {"a": [2.0], "b": [3.0]}, "payload": {"x": {"y": [1, None]}}}, {"id": 2}]
    named = spark.createDataFrame([], oplog.state_schema(["a", "b"]))
    one = spark.createDataFrame([(5, "upsert", json.dumps({"points": points}))], oplog.LOG_SCHEMA)
    for state in (oplog.replay_log(named, one), oplog.replay(named, [(5, "upsert", {"points": points})])):
        rows = {r["id"]: (r["version"], json.loads(r["payload"]), r["vector_a"], r["vector_b"]) for r in state.collect()}
        assert rows == {1: (5, {"x": {"y": [1, None]}}, [2.0], [3.0]), 2: (5, {}, None, None)}


def test_uuid_points(spark):
    from tessera.sources.points import canonical_id, from_rows, point_id

    plain = "936da01f-9abd-4d9d-80c7-02af85c822a8"
    forms = [plain, plain.replace("-", ""), f"urn:uuid:{plain}", plain.upper(), "{" + plain + "}"]
    assert {point_id(x) for x in forms} == {plain}
    df = spark.createDataFrame([(x,) for x in [*forms, "007"]], "x string")
    assert [r[0] for r in df.select(canonical_id(F.col("x"))).collect()] == [plain] * 5 + ["7"]
    with pytest.raises(ValueError):
        point_id("neither")
    rows = from_rows(spark, [{"id": 1, "vector": [1.0]}, {"id": forms[3], "vector": [2.0]}])
    assert sorted(r["id"] for r in rows.collect()) == ["1", plain]
    state = oplog.replay(spark.createDataFrame([], oplog.state_schema([""], "string")), [(1, "upsert", {"points": [{"id": forms[1], "vector": [1.0]}, {"id": 3}]}), (2, "delete", {"ids": [3]}), (3, "set_payload", {"payload": {"a": 1}, "ids": [forms[3]]})])
    assert [(r["id"], r["version"], json.loads(r["payload"])) for r in state.collect()] == [(plain, 3, {"a": 1})]


def test_absent_points_are_errors_of_requests(spark):
    state = oplog.replay(spark.createDataFrame([], oplog.state_schema([""])), [(1, "upsert", {"points": [{"id": 1, "vector": [1.0]}]})])
    for kind, body in (("set_payload", {"payload": {}, "ids": [1, 2]}), ("update_vectors", {"points": [{"id": 2, "vector": [1.0]}]}), ("clear_payload", {"ids": [2]})):
        with pytest.raises(KeyError, match="2"):
            oplog.apply_op(state, 2, kind, body, strict=True)
    assert oplog.apply_op(state, 2, "delete", {"ids": [2]}, strict=True).count() == 1


def test_limits_and_manifests(spark, tmp_path):
    from tessera.sources.catalog import Rate

    with pytest.raises(ValueError):
        StrictMode(max_batch=1).check_batch([{}, {}])
    with pytest.raises(ValueError):
        StrictMode(max_upsert=1).check_update("upsert", {"batch": {"ids": [1, 2]}})
    now = [0.0]
    rate = Rate(60, lambda: now[0])
    rate.take(60)
    with pytest.raises(RuntimeError):
        rate.take()
    now[0] = 1.0
    rate.take()
    catalog = Catalog(spark, str(tmp_path))
    catalog.create("c", spark.range(5), Config("id", strict={"read_rate": 1}))
    first = catalog.manifest("c")
    assert first and catalog.partial_snapshot("c", first) == {"fetch": [], "drop": []}
    catalog.query("c", {})
    with pytest.raises(RuntimeError):
        catalog.query("c", {})
    catalog.replace("c", spark.range(3))
    assert catalog.partial_snapshot("c", first) == {"fetch": sorted(catalog.manifest("c")), "drop": sorted(first)}
    artifact = {"version": 1, "members": [[0], [1]], "nodes": [[1.0], [2.0]]}
    routing.validate({**artifact, "checksum": routing.checksum(artifact)}, 2)
    with pytest.raises(ValueError):
        routing.validate({**artifact, "checksum": "0"}, 2)


def test_stored_indexes(spark, tmp_path):
    from tessera.functions.text import Tokenizer
    from tessera.sources import indexes

    texts = ["a b a b c", "b a", "the the end", None, "", "c c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    indexes.write_text(df, "id", F.col("t"), Tokenizer(), str(tmp_path / "t"), 4)
    ask = lambda q, mode: sorted(r["id"] for r in indexes.match_text(spark, str(tmp_path / "t"), q.split(), mode, 4).collect())
    assert ask("a b", "all") == [0, 1] and ask("a b", "phrase") == [0] and ask("b a b", "phrase") == [0]
    assert ask("the the", "phrase") == [2] and ask("c c", "phrase") == [5] and ask("c end", "any") == [0, 2, 5]
    assert ask("", "all") == ask("", "any") == ask("", "phrase") == ask("absent", "all") == []
    plan = indexes.match_text(spark, str(tmp_path / "t"), ["a"], "all", 4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(bucket#" in plan and "EqualTo(token,a)" in plan
    v = spark.createDataFrame([(1, ([0, 5], [1.0, 2.0])), (2, ([], [])), (3, None), (4, ([5], [-1.0]))], "id long, v struct<indices: array<long>, values: array<double>>")
    indexes.write_sparse(v, "id", "v", str(tmp_path / "v"), 4)
    assert {r["id"]: r["score"] for r in indexes.search_sparse(spark, str(tmp_path / "v"), {5: 2.0, 0: 1.0}, 4).collect()} == {1: 5.0, 4: -2.0}
    assert indexes.search_sparse(spark, str(tmp_path / "v"), {}, 4).count() == 0


def test_product_codes_of_nulls_and_training(spark):
    from tessera.operators import quantized

    books = quantized.product_books(np.random.default_rng(0).normal(size=(200, 6)), 2, 8)
    assert [np.shape(b) for b in books] == [(8, 2)] * 3
    x = [float(c) for c in books[0][3] + books[1][1] + books[2][7]]
    df = spark.createDataFrame([(0, x), (1, None), (2, x)], "id int, v array<double>").coalesce(1)
    assert [r["c"] for r in df.select(vectors.product_codes(F.col("v"), books).alias("c")).collect()] == [[3, 1, 7], None, [3, 1, 7]]


def test_older_shapes():
    from tessera.plans import legacy

    assert legacy.search_request({"vector": {"name": "a", "vector": [1.0]}, "limit": 3}) == {"query": {"nearest": [1.0]}, "using": "a", "limit": 3}
    assert legacy.search_request({"vector": {"indices": [1], "values": [2.0]}})["query"] == {"nearest": {"indices": [1], "values": [2.0]}}
    assert legacy.discover_request({"context": []})["query"] == {"context": []}
