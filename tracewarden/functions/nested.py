"""Nested documents: pruning, flattening and safe paths, driven by the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(parent: Column | None, name: str) -> Column:
    return F.col(f"`{name}`") if parent is None else parent.getField(name)


def _pruned(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        inner = F.filter(F.transform(value, lambda x: _pruned(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(inner) > 0, inner)
    if isinstance(kind, T.StructType):
        parts = {f.name: _pruned(_field(value, f.name), f.dataType) for f in kind}
        whole = F.struct(*[p.alias(n) for n, p in parts.items()])
        return F.when(F.coalesce(*[F.when(p.isNotNull(), F.lit(True)) for p in parts.values()], F.lit(False)), whole)
    return value


def prune_empty(df: DataFrame) -> DataFrame:
    """Empty strings, arrays and structs become null, at every depth; zero and false stay."""
    return df.select(*[_pruned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> dict[str, tuple[tuple[str, ...], T.DataType]]:
    """Dotted name of each leaf: its path and type. Only structs are entered; arrays are leaves."""
    out: dict[str, tuple[tuple[str, ...], T.DataType]] = {}
    for f in schema:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            out |= leaves(f.dataType, path)
        else:
            out[".".join(path)] = (path, f.dataType)
    return out


def at(path: tuple[str, ...]) -> Column:
    value = _field(None, path[0])
    for name in path[1:]:
        value = value.getField(name)
    return value


def flatten(df: DataFrame) -> DataFrame:
    """One column for each leaf, named by its dotted path."""
    return df.select(*[at(path).alias(name) for name, (path, _) in leaves(df.schema).items()])


def get(df: DataFrame, dotted: str) -> Column:
    """The value at a dotted path; null if there is no such path."""
    kind: T.DataType = df.schema
    value: Column | None = None
    for name in dotted.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None)
        value, kind = _field(value, name), kind[name].dataType
    return value
