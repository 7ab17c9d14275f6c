"""Changes to JSON payloads: merge, set at a path, delete a path, select. Arrow batches over JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.paths import ANY, excludes, includes, parse


def merged(old: dict, new: dict) -> dict:
    """Shallow; null deletes a key."""
    out = {**old, **new}
    return {k: v for k, v in out.items() if v is not None}


def set_at(doc: dict, path: list, value: dict) -> dict:
    """Merges value into the objects at a path. Objects on the way are made; an index must exist; the
    wildcard means every element."""

    def go(node, i: int):
        if i == len(path):
            return merged(node if isinstance(node, dict) else {}, value)
        step = path[i]
        if isinstance(step, str):
            node = dict(node) if isinstance(node, dict) else {}
            node[step] = go(node.get(step), i + 1)
            return node
        if not isinstance(node, list):
            return [] if step is ANY else node
        if step is ANY:
            return [go(x, i + 1) for x in node]
        return [go(x, i + 1) if j == step else x for j, x in enumerate(node)]

    return go(doc, 0)


def delete_at(doc, path: list):
    """Object keys are removed; a final wildcard empties an array; a final index changes nothing."""
    step = path[0]
    if isinstance(step, str):
        if not isinstance(doc, dict) or step not in doc:
            return doc
        if len(path) == 1:
            return {k: v for k, v in doc.items() if k != step}
        return {k: delete_at(v, path[1:]) if k == step else v for k, v in doc.items()}
    if not isinstance(doc, list):
        return doc
    if len(path) == 1:
        return [] if step is ANY else doc
    return [delete_at(x, path[1:]) if step is ANY or j == step else x for j, x in enumerate(doc)]


def selected(doc, include: list[list] | None, exclude: list[list], path: tuple = ()):
    """What selectors leave of a document; None for nothing."""
    if path and any(excludes(p, list(path)) for p in exclude):
        return None
    if include is not None and path and not any(includes(p, list(path)) for p in include):
        return None
    if isinstance(doc, dict):
        kept = {k: selected(v, include, exclude, (*path, k)) for k, v in doc.items()}
        return {k: v for k, v in kept.items() if v is not None or doc[k] is None}
    if isinstance(doc, list):
        return [x for x in (selected(v, include, exclude, (*path, ANY)) for v in doc) if x is not None]
    return doc


def _mapped(f):
    @F.pandas_udf("string")
    def run(old: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(f(json.loads(o) if o else {}, json.loads(b) if b else {}), ensure_ascii=False, separators=(",", ":")) for o, b in zip(old, body, strict=True)], dtype=object)

    return run


def merge_json(old: Column, new: Column, key: str | None = None) -> Column:
    if key is None:
        return _mapped(merged)(old, new)
    path = parse(key)
    return _mapped(lambda o, b: set_at(o, path, b))(old, new)


def delete_json(old: Column, keys: list[str]) -> Column:
    paths = [parse(k) for k in keys]

    def run(doc: dict, _) -> dict:
        for p in paths:
            doc = delete_at(doc, p)
        return doc

    return _mapped(run)(old, F.lit("{}"))


def select_json(doc: Column, selector) -> Column:
    include = [parse(p) for p in (selector if isinstance(selector, list) else selector.get("include") or [])] or None
    exclude = [] if isinstance(selector, list) else [parse(p) for p in selector.get("exclude", [])]
    return _mapped(lambda d, _: selected(d, include, exclude) or {})(doc, F.lit("{}"))
