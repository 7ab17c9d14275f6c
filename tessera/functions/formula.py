"""Rescoring formulas: nested dicts compiled to one expression over source scores and payload values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.times import parsed
from tessera.plans.predicates import Context, condition, two_valued


class Formula:
    """scores: one column for each source. A payload value that is missing takes its default, or the query
    fails; so does a result that is not finite."""

    def __init__(self, context: Context, scores: list[Column], defaults: dict | None = None):
        self.context, self.scores, self.defaults = context, scores, defaults or {}

    def column(self, spec) -> Column:
        value = self._compile(spec)
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("the formula has no finite value")).cast("double")).otherwise(value)

    def _all(self, specs: list) -> list[Column]:
        return [self._compile(s) for s in specs]

    def _compile(self, spec) -> Column:
        if isinstance(spec, (int, float)) and not isinstance(spec, bool):
            return F.lit(float(spec))
        if isinstance(spec, str):
            return self._variable(spec)
        if len(spec) != 1 or next(iter(spec)) not in _OPERATIONS:
            return two_valued(condition(spec, self.context)).cast("double")
        ((name, arg),) = spec.items()
        return _OPERATIONS[name](self, arg)

    def _variable(self, name: str) -> Column:
        if name == "$score" or name.startswith("$score["):
            i = int(name[7:-1]) if "[" in name else 0
            default = float(self.defaults.get(name, 0.0))
            return F.coalesce(self.scores[i].cast("double"), F.lit(default)) if i < len(self.scores) else F.lit(default)
        return self._payload(name, self._number)

    def _payload(self, path: str, read) -> Column:
        values = self.context.values(path)
        found = F.lit(None).cast("double")
        if values.type is not None:
            kind, many = values.type, values.many
            if many is not None:
                found = F.when(F.size(many) == 1, read(many[0], kind))
            elif isinstance(kind, T.ArrayType):
                found = F.when(F.size(values.one) == 1, read(values.one[0], kind.elementType))
            else:
                found = read(values.one, kind)
        if path in self.defaults:
            return F.coalesce(found, read(F.lit(self.defaults[path]), T.StringType() if isinstance(self.defaults[path], str) else T.DoubleType()))
        return F.coalesce(found, F.raise_error(F.lit(f"no value for {path}")).cast("double"))

    @staticmethod
    def _number(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            array = F.try_variant_get(x, "$", "array<double>")
            return F.coalesce(F.try_variant_get(x, "$", "double"), F.when(F.size(array) == 1, array[0]))
        return x.cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double")

    @staticmethod
    def _moment(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.VariantType):
            x, t = F.try_variant_get(x, "$", "string"), T.StringType()
        if isinstance(t, T.TimestampNTZType):
            x = x.cast("timestamp")
        at = parsed(x) if isinstance(t, T.StringType) else x
        return F.unix_micros(at).cast("double") / 1e6

    def _mult(self, args: list) -> Column:
        """A zero factor hides what follows it."""
        return reduce(lambda rest, c: F.when(c == 0, F.lit(0.0)).otherwise(c * rest), reversed(self._all(args)), F.lit(1.0))

    def _div(self, arg: dict) -> Column:
        left, right = self._compile(arg["left"]), self._compile(arg["right"])
        by_zero = arg.get("by_zero_default")
        other = F.raise_error(F.lit("division by zero")).cast("double") if by_zero is None else F.lit(float(by_zero))
        return F.when(left == 0, F.lit(0.0)).when(right == 0, other).otherwise(left / right)

    def _decay(self, kind: str, arg: dict) -> Column:
        scale, midpoint = float(arg.get("scale", 1.0)), float(arg.get("midpoint", 0.5))
        if scale <= 0 or not 0 < midpoint < 1:
            raise ValueError("a decay has a positive scale and a midpoint between 0 and 1")
        off = F.abs(self._compile(arg["x"]) - self._compile(arg.get("target", 0.0)))
        if kind == "exp":
            return F.exp(off * (math.log(midpoint) / scale))
        if kind == "gauss":
            return F.exp(off * off * (math.log(midpoint) / scale**2))
        return F.greatest(F.lit(0.0), 1.0 - off * ((1.0 - midpoint) / scale))

    def _geo_distance(self, arg: dict) -> Column:
        def read(x: Column, t: T.DataType) -> Column:
            if isinstance(t, T.VariantType):
                return geo.distance(F.try_variant_get(x, "$.lon", "double"), F.try_variant_get(x, "$.lat", "double"), arg["origin"]["lon"], arg["origin"]["lat"])
            return geo.distance(x["lon"], x["lat"], arg["origin"]["lon"], arg["origin"]["lat"])

        if isinstance(default := self.defaults.get(arg["to"]), dict):
            own = Formula(self.context, self.scores, {})
            values = own.context.values(arg["to"])
            fixed = geo.distance(F.lit(float(default["lon"])), F.lit(float(default["lat"])), arg["origin"]["lon"], arg["origin"]["lat"])
            return fixed if values.type is None or values.one is None else F.coalesce(read(values.one, values.type), fixed)
        return self._payload(arg["to"], read)


_OPERATIONS = {
    "sum": lambda f, a: reduce(lambda x, y: x + y, f._all(a), F.lit(0.0)),
    "mult": lambda f, a: f._mult(a),
    "neg": lambda f, a: -f._compile(a),
    "abs": lambda f, a: F.abs(f._compile(a)),
    "div": lambda f, a: f._div(a),
    "sqrt": lambda f, a: F.sqrt(f._compile(a)),
    "pow": lambda f, a: F.pow(f._compile(a["base"]), f._compile(a["exponent"])),
    "exp": lambda f, a: F.exp(f._compile(a)),
    "ln": lambda f, a: F.log(f._compile(a)),
    "log10": lambda f, a: F.log10(f._compile(a)),
    "exp_decay": lambda f, a: f._decay("exp", a),
    "gauss_decay": lambda f, a: f._decay("gauss", a),
    "lin_decay": lambda f, a: f._decay("lin", a),
    "geo_distance": lambda f, a: f._geo_distance(a),
    "datetime": lambda f, a: f._moment(F.lit(a), T.StringType()),
    "datetime_key": lambda f, a: f._payload(a, f._moment),
}
