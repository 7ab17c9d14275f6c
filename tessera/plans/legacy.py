"""The older request shapes: search, recommend, discover and their groups, as requests of `Collection.query`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.plans.collection import GROUP_SIZE, LIMIT, Collection

_SAME = ("filter", "params", "limit", "offset", "with_payload", "with_vector", "score_threshold", "using", "lookup_from")


def _same(body: dict) -> dict:
    return {k: body[k] for k in _SAME if body.get(k) is not None}


def search_request(body: dict) -> dict:
    """vector: a list, or {name, vector} where the vector is a list or {indices, values}."""
    v = body["vector"]
    if isinstance(v, dict) and "name" in v:
        return {**_same(body), "query": {"nearest": v["vector"]}, "using": v["name"]}
    return {**_same(body), "query": {"nearest": v}}


def recommend_request(body: dict) -> dict:
    what = {"positive": body.get("positive", []), "negative": body.get("negative", [])}
    return {**_same(body), "query": {"recommend": {**what, "strategy": body.get("strategy") or "average_vector"}}}


def discover_request(body: dict) -> dict:
    """With a target a discovery, without one a search by context."""
    context = body.get("context") or []
    if body.get("target") is None:
        return {**_same(body), "query": {"context": context}}
    return {**_same(body), "query": {"discover": {"target": body["target"], "context": context}}}


def search(c: Collection, body: dict) -> DataFrame:
    return c.query(search_request(body))


def search_batch(c: Collection, bodies: list[dict]) -> DataFrame:
    return c.query_batch([search_request(b) for b in bodies])


def recommend(c: Collection, body: dict) -> DataFrame:
    return c.query(recommend_request(body))


def recommend_batch(c: Collection, bodies: list[dict]) -> DataFrame:
    return c.query_batch([recommend_request(b) for b in bodies])


def discover(c: Collection, body: dict) -> DataFrame:
    return c.query(discover_request(body))


def discover_batch(c: Collection, bodies: list[dict]) -> DataFrame:
    return c.query_batch([discover_request(b) for b in bodies])


def _groups(c: Collection, request: dict, body: dict, with_lookup: Collection | None) -> DataFrame:
    request.pop("limit", None)
    return c.query_groups(request, body["group_by"], body.get("group_size", GROUP_SIZE), body.get("limit", LIMIT), with_lookup)


def search_groups(c: Collection, body: dict, with_lookup: Collection | None = None) -> DataFrame:
    return _groups(c, search_request(body), body, with_lookup)


def recommend_groups(c: Collection, body: dict, with_lookup: Collection | None = None) -> DataFrame:
    return _groups(c, recommend_request(body), body, with_lookup)
