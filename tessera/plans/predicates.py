"""Filters: nested dicts of must, should, min_should and must_not, compiled to boolean columns.

Missing values are never unknown: a filter is true or false. Where a null counts as false anyway (below AND
and OR at the top of a WHERE) a leaf stays a bare comparison, so that it reaches the Parquet scan; below
NOT and in sums it is wrapped. Literal filters become literals, not joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, text
from tessera.functions.paths import Values, resolve
from tessera.functions.times import parsed

_PREDICATES = ("match", "range", "geo_bounding_box", "geo_radius", "geo_polygon", "values_count", "is_empty", "is_null")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Context:
    """Where a filter finds its values.

    schema: of the row, or of `root` (a struct column); variant: a VARIANT payload column instead.
    tokenizers: path -> Tokenizer, for paths with a declared text schema, whose text matches by tokens.
    null_indexed: paths for which is_null also looks inside arrays.
    """

    schema: T.StructType
    id: Column | None = None
    root: Column | None = None
    variant: Column | None = None
    vectors: dict[str, Column] = field(default_factory=dict)
    tokenizers: dict[str, text.Tokenizer] = field(default_factory=dict)
    null_indexed: set[str] = field(default_factory=set)
    nested: bool = False

    def values(self, path: str) -> Values:
        return resolve(path, self.schema, self.root, self.variant)


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def compile_filter(spec: dict | None, context: Context) -> Column:
    """A column that is true where the filter holds (false or null elsewhere)."""
    if not spec:
        return F.lit(True)
    unknown = set(spec) - {"must", "should", "must_not", "min_should"}
    if unknown:
        raise ValueError(f"not clauses of a filter: {sorted(unknown)}")
    parts = []
    if spec.get("must"):
        parts.append(reduce(lambda a, b: a & b, [condition(c, context) for c in _list(spec["must"])]))
    if spec.get("should"):
        parts.append(reduce(lambda a, b: a | b, [condition(c, context) for c in _list(spec["should"])]))
    if spec.get("min_should"):
        least = spec["min_should"]["min_count"]
        of = spec["min_should"]["conditions"]
        if least > 0:
            parts.append(reduce(lambda a, b: a + b, [two_valued(condition(c, context)).cast("int") for c in of]) >= least if of else F.lit(False))
    if spec.get("must_not"):
        parts += [~two_valued(condition(c, context)) for c in _list(spec["must_not"])]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def merge(a: dict | None, b: dict | None) -> dict | None:
    """Clause by clause: lists are joined (should lists become one OR); min_should joins its conditions and
    takes the larger count."""
    if not a or not b:
        return a or b
    out = {k: _list(a.get(k) or []) + _list(b.get(k) or []) for k in ("must", "should", "must_not") if a.get(k) or b.get(k)}
    least = [x["min_should"] for x in (a, b) if x.get("min_should")]
    if least:
        out["min_should"] = {"conditions": [c for m in least for c in m["conditions"]], "min_count": max(m["min_count"] for m in least)}
    return out


def condition(spec: dict, context: Context) -> Column:
    if not spec or set(spec) & {"must", "should", "must_not", "min_should"}:
        return compile_filter(spec, context)
    if "has_id" in spec:
        ids = spec["has_id"]
        return F.lit(False) if context.nested or context.id is None or not ids else context.id.isin(ids)
    if "has_vector" in spec:
        v = context.vectors.get(spec["has_vector"])
        return F.lit(False) if context.nested or v is None else v.isNotNull()
    if "nested" in spec:
        return _nested(spec["nested"]["key"], spec["nested"]["filter"], context)
    if "is_empty" in spec and isinstance(spec["is_empty"], dict):
        return _is_empty(context.values(spec["is_empty"]["key"]))
    if "is_null" in spec and isinstance(spec["is_null"], dict):
        path = spec["is_null"]["key"]
        return _is_null(context.values(path), path in context.null_indexed)
    if "key" not in spec:
        raise ValueError(f"not a condition: {sorted(spec)}")
    kinds = [k for k in _PREDICATES if spec.get(k) is not None]
    if len(kinds) != 1:
        raise ValueError(f"a condition on {spec['key']} has {len(kinds)} predicates; give it one")
    values, kind = context.values(spec["key"]), kinds[0]
    arg = spec[kind]
    if kind == "is_empty":
        c = two_valued(_is_empty(values))
        return c if arg else ~c
    if kind == "is_null":
        c = two_valued(_is_null(values, True))
        return c if arg else ~c
    if kind == "values_count":
        return _values_count(values, arg)
    if kind == "match":
        return _match(values, arg, context.tokenizers.get(spec["key"]))
    if kind == "range":
        return _range(values, arg)
    return _geo(values, kind, arg)


# leaves: strict about types


def _as(x: Column, kind: T.DataType, want: str) -> Column | None:
    """x as integer, number, string, boolean or object; None (or null, for variants) if it is of another type."""
    if isinstance(kind, T.VariantType):
        own = F.schema_of_variant(x)
        if want == "integer":
            return F.when(own == "BIGINT", F.try_variant_get(x, "$", "bigint"))
        if want == "number":
            return F.when((own == "BIGINT") | (own == "DOUBLE") | own.startswith("DECIMAL"), F.try_variant_get(x, "$", "double"))
        if want == "string":
            return F.when(own == "STRING", F.try_variant_get(x, "$", "string"))
        if want == "boolean":
            return F.when(own == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        return F.when(own.startswith("OBJECT"), x)
    ok = {"integer": _WHOLE, "number": _WHOLE + _REAL, "string": (T.StringType,), "boolean": (T.BooleanType,), "object": (T.StructType,)}[want]
    return x if isinstance(kind, ok) else None


def _if(x: Column | None, test) -> Column:
    return F.lit(False) if x is None else test(x)


def _type_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, str):
        return "string"
    raise ValueError(f"match compares strings, integers and booleans, not {value!r}")


def _match(values: Values, arg: dict, tokenizer: text.Tokenizer | None) -> Column:
    if len(arg) != 1:
        raise ValueError("a match has one of value, any, except, text, text_any, phrase")
    ((kind, given),) = arg.items()
    if kind == "value":
        return values.any(lambda x, t: _if(_as(x, t, _type_of(given)), lambda v: v == F.lit(given)))
    if kind in ("any", "except"):
        types = {_type_of(g) for g in given}
        if len(types) > 1 or "boolean" in types:
            raise ValueError(f"match.{kind} takes strings or integers")
        want = types.pop() if types else "string"
        if kind == "any":
            return values.any(lambda x, t: _if(_as(x, t, want), lambda v: v.isin(given) if given else F.lit(False)))

        def other(x: Column, t: T.DataType) -> Column:
            v = _as(x, t, want)
            real = ~F.is_variant_null(x) if isinstance(t, T.VariantType) else F.lit(True)
            if v is None or not given:
                return x.isNotNull() & real
            return x.isNotNull() & real & ~two_valued(v.isin(given))

        return values.any(other)
    if kind not in ("text", "text_any", "phrase"):
        raise ValueError(f"no match of this name: {kind}")
    if tokenizer is None:
        if kind == "text_any":
            words = given.split()
            return values.any(lambda x, t: _if(_as(x, t, "string"), lambda v: reduce(lambda a, b: a | b, [F.contains(v, F.lit(w)) for w in words]) if words else F.lit(False)))
        return values.any(lambda x, t: _if(_as(x, t, "string"), lambda v: F.contains(v, F.lit(given))))
    query = tokenizer.query(given)
    test = {"text": text.has_all, "text_any": text.has_any, "phrase": text.has_phrase}[kind]
    return values.any(lambda x, t: _if(_as(x, t, "string"), lambda v: tokenizer.may_hold(v, query) & test(tokenizer.document(v), query)))


_COMPARE = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def _bounds(x: Column, arg: dict, literal) -> Column:
    tests = [_COMPARE[k](x, literal(v)) for k, v in arg.items() if v is not None]
    return reduce(lambda a, b: a & b, tests) if tests else x.isNotNull()


def _range(values: Values, arg: dict) -> Column:
    if any(isinstance(v, str) for v in arg.values()):
        moment = lambda v: parsed(F.lit(v))

        def test(x: Column, t: T.DataType) -> Column:
            if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                return _bounds(x, arg, moment)
            return _if(_as(x, t, "string"), lambda v: _bounds(parsed(v), arg, moment))

        return values.any(test)
    return values.any(lambda x, t: _if(_as(x, t, "number"), lambda v: _bounds(v, arg, F.lit)))


def _geo(values: Values, kind: str, arg: dict) -> Column:
    def test(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            lon, lat = F.try_variant_get(x, "$.lon", "double"), F.try_variant_get(x, "$.lat", "double")
        elif isinstance(t, T.StructType) and {"lon", "lat"} <= set(t.names):
            lon, lat = x["lon"].cast("double"), x["lat"].cast("double")
        else:
            return F.lit(False)
        if kind == "geo_bounding_box":
            return geo.in_box(lon, lat, arg["top_left"], arg["bottom_right"])
        if kind == "geo_radius":
            return geo.in_circle(lon, lat, arg["center"], arg["radius"])
        return geo.in_polygon(lon, lat, arg["exterior"]["points"], [i["points"] for i in arg.get("interiors") or []])

    return values.any(test)


def _values_count(values: Values, arg: dict) -> Column:
    """Null counts 0, an array its values, anything else 1; a missing field satisfies no bound."""

    def test(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            array = F.try_variant_get(x, "$", "array<variant>")
            n = F.when(F.is_variant_null(x), 0).when(array.isNotNull(), F.size(array)).when(x.isNotNull(), 1)
        elif isinstance(t, T.ArrayType):
            n = F.coalesce(F.size(x), F.lit(0)) if values.many is None else F.size(x)
            n = F.when(x.isNull(), 0).otherwise(n)
        else:
            n = F.when(x.isNull(), 0).otherwise(1)
        return _bounds(n, arg, F.lit)

    return values.whole(test)


def _blank(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.VariantType):
        return x.isNull() | F.is_variant_null(x) | (F.schema_of_variant(x) == "ARRAY<VOID>") & (F.size(F.try_variant_get(x, "$", "array<variant>")) == 0)
    return (x.isNull() | (F.size(x) == 0)) if isinstance(t, T.ArrayType) else x.isNull()


def _is_empty(values: Values) -> Column:
    """All values are null or []; also when there are none."""
    if values.type is None:
        return F.lit(True)
    if values.many is None:
        return _blank(values.one, values.type)
    return F.forall(values.many, lambda v: _blank(v, values.type))


def _is_null(values: Values, inside: bool) -> Column:
    """Some value is null. In typed rows a null column is a null value."""

    def test(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            out = F.coalesce(F.is_variant_null(x), F.lit(False))
            return out | F.exists(F.try_variant_get(x, "$", "array<variant>"), F.is_variant_null) if inside else out
        out = x.isNull()
        return out | F.exists(x, lambda e: e.isNull()) if inside and isinstance(t, T.ArrayType) else out

    if values.many is not None:
        return F.exists(values.many, lambda v: F.coalesce(test(v, values.type), F.lit(False)))
    return values.whole(test)


def _nested(path: str, spec: dict, context: Context) -> Column:
    """Some object among the elements satisfies the whole filter by itself."""
    values = context.values(path if path.endswith("[]") else path + "[]")
    if values.type is None or values.many is None:
        return F.lit(False)
    if isinstance(values.type, T.VariantType):
        inside = lambda e: two_valued(F.schema_of_variant(e).startswith("OBJECT") & compile_filter(spec, Context(T.StructType(), variant=e, nested=True)))
    elif isinstance(values.type, T.StructType):
        inside = lambda e: e.isNotNull() & two_valued(compile_filter(spec, Context(values.type, root=e, nested=True)))
    else:
        return F.lit(False)
    return F.exists(values.many, inside)
