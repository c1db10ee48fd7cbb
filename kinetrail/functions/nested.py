"""Nested columns: a function over the leaves of a struct, structs merged into one, padding of the same shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _type(df: DataFrame, path: str) -> T.DataType:
    kind: T.DataType = df.schema
    for name in path.split("."):
        kind = kind[name].dataType
    return kind


def mapped(df: DataFrame, path: str, f: Callable[[Column, T.DataType], Column]) -> Column:
    """The struct at path (parts joined by dots) with f(leaf, its type) in place of each leaf; a path to a leaf gives f of it."""

    def one(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(one(column[x.name], x.dataType).alias(x.name) for x in kind.fields))
        return f(column, kind)

    return one(F.col(path), _type(df, path))


def merged(df: DataFrame, *paths: str) -> Column:
    """Structs as one: fields of all in order of appearance, later ones win, structs that meet are merged field by field."""

    def one(sides: list[tuple[Column, T.DataType]]) -> Column:
        if not isinstance(sides[-1][1], T.StructType):
            return sides[-1][0]
        fields: dict[str, list[tuple[Column, T.DataType]]] = {}
        for column, kind in sides:
            if isinstance(kind, T.StructType):
                for x in kind.fields:
                    fields.setdefault(x.name, []).append((column[x.name], x.dataType))
        return F.struct(*(one(x).alias(name) for name, x in fields.items()))

    return one([(F.col(p), _type(df, p)) for p in paths])


def padding(column: Column, kind: T.DataType) -> Column:
    """Zeros for numbers, empty texts for strings and bytes, and the same inside of arrays; any other type is an error."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: padding(x, kind.elementType))
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    raise ValueError(f"no padding for {kind.simpleString()}")
