"""Payload paths: `key.key`, quoted keys, `[n]` and the wildcard `[]`, and their values as columns.

Payloads come in two modes. Typed: columns and struct fields, which keeps pruning and pushdown. Variant:
one VARIANT column, with JSON's own types. Both give a Values: all values that a path resolves to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = object()
_STEP = re.compile(r'\.?(?:"((?:[^"\\]|\\.)*)"|([^.\[\]"]+))|\[(\d*)\]')


def parse(path: str) -> list:
    """Steps: str for a key, int for an index, ANY for the wildcard."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (at == 0 and (path[0] in ".[")) or (at and m.group(3) is None and path[at] != "."):
            raise ValueError(f"not a payload path: {path!r}")
        if m.group(3) is not None:
            steps.append(int(m.group(3)) if m.group(3) else ANY)
        else:
            steps.append(m.group(2) if m.group(1) is None else re.sub(r"\\(.)", r"\1", m.group(1)))
        at = m.end()
    if not steps:
        raise ValueError("an empty payload path")
    return steps


@dataclass
class Values:
    """What a path resolves to.

    one: the only value, where the path has no wildcard (null: missing or null), else None.
    many: an array of all values, where it has one.
    type: their type; T.VariantType for variants, None for a path that the schema does not have.
    """

    one: Column | None
    many: Column | None
    type: T.DataType | None

    def any(self, leaf) -> Column:
        """Whether a value satisfies leaf(value, type); arrays are flattened by one level."""
        if self.type is None:
            return F.lit(False)
        if isinstance(self.type, T.VariantType):
            flat = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
            each = lambda v: F.exists(flat(v), lambda x: F.coalesce(leaf(x, self.type), F.lit(False)))
        elif isinstance(self.type, T.ArrayType):
            inner = self.type.elementType
            each = lambda v: F.exists(v, lambda x: F.coalesce(leaf(x, inner), F.lit(False)))
        else:
            each = lambda v: leaf(v, self.type)
        if self.many is None:
            return each(self.one)
        return F.exists(self.many, lambda v: F.coalesce(each(v), F.lit(False)))

    def whole(self, test) -> Column:
        """Whether a value, arrays as they are, satisfies test(value, type)."""
        if self.type is None:
            return F.lit(False)
        if self.many is None:
            return test(self.one, self.type)
        return F.exists(self.many, lambda v: F.coalesce(test(v, self.type), F.lit(False)))

    def array(self) -> Column:
        """All values as one array, for exploding; arrays are flattened by one level."""
        if self.type is None:
            return F.array()
        if self.many is not None:
            return F.flatten(self.many) if isinstance(self.type, T.ArrayType) else self.many
        return F.coalesce(self.one, F.array()) if isinstance(self.type, T.ArrayType) else F.array(self.one)

    @property
    def value_type(self) -> T.DataType | None:
        return self.type.elementType if isinstance(self.type, T.ArrayType) else self.type


def resolve(path: str, schema: T.StructType, root: Column | None = None, variant: Column | None = None) -> Values:
    """The values of a path in a row of `schema` (of `root`, if it is a struct column), or in a variant."""
    steps = parse(path)
    if variant is not None:
        return _resolve_variant(steps, variant)
    column, kind, spread = None, schema, False
    for i, step in enumerate(steps):
        if isinstance(step, str):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return Values(None, None, None)
            field = kind[step].dataType
            if column is None:
                column = F.col(f"`{step}`") if root is None else root[step]
            elif spread:
                column = F.filter(F.transform(column, _get(step)), lambda x: x.isNotNull())
            else:
                column = column[step]
            kind = field
        else:
            if i == 0 or not isinstance(kind, T.ArrayType):
                return Values(None, None, None)
            kind = kind.elementType
            if step is ANY:
                column = F.flatten(column) if spread else F.coalesce(column, F.array().cast(T.ArrayType(kind)))
                spread = True
            elif spread:
                column = F.transform(column, _at(step))
            else:
                column = F.get(column, step)
    return Values(None, column, kind) if spread else Values(column, None, kind)


def _get(name: str):
    return lambda x: x[name]


def _at(index: int):
    return lambda x: F.get(x, index)


def _resolve_variant(steps: list, variant: Column) -> Values:
    def sub(path: str):
        return lambda v: F.try_variant_get(v, path, "variant")

    column, spread, pending = variant, False, ""

    def flush() -> None:
        nonlocal column, pending
        if pending:
            column = F.filter(F.transform(column, sub("$" + pending)), lambda x: x.isNotNull()) if spread else sub("$" + pending)(column)
            pending = ""

    for step in steps:
        if step is ANY:
            flush()
            if spread:
                column = F.flatten(F.transform(column, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
            else:
                column = F.coalesce(F.try_variant_get(column, "$", "array<variant>"), F.array().cast("array<variant>"))
            spread = True
        elif isinstance(step, int):
            pending += f"[{step}]"
        else:
            pending += "['" + step.replace("'", "\\'") + "']"
    flush()
    return Values(None, column, T.VariantType()) if spread else Values(column, None, T.VariantType())


def includes(pattern: list, path: list) -> bool:
    """Whether a selector keeps a path: one is the beginning of the other."""
    n = min(len(pattern), len(path))
    return all(a is ANY or a == b for a, b in zip(pattern[:n], path[:n], strict=True))


def excludes(pattern: list, path: list) -> bool:
    """Whether a selector drops a path: it is the beginning of it."""
    return len(pattern) <= len(path) and includes(pattern, path)


def project(kind: T.DataType, column: Column, include: list[list] | None, exclude: list[list], path: tuple = ()) -> Column | None:
    """The part of a value that the selectors leave, or None if nothing is left."""
    if any(excludes(p, list(path)) for p in exclude if len(p) <= len(path) and path):
        return None
    if include is not None and path and not any(includes(p, list(path)) for p in include):
        return None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(inner, T.StructType):
        return column
    deeper = (*path, ANY) if isinstance(kind, T.ArrayType) else path

    def rebuilt(value: Column) -> Column | None:
        kept = [(f.name, project(f.dataType, value[f.name], include, exclude, (*deeper, f.name))) for f in inner.fields]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.struct(*kept) if kept else None

    if isinstance(kind, T.ArrayType):
        if all(project(f.dataType, column[0][f.name], include, exclude, (*deeper, f.name)) is None for f in inner.fields):
            return None
        return F.transform(column, rebuilt)
    out = rebuilt(column)
    return None if out is None else F.when(column.isNotNull(), out)
