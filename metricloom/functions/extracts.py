"""Rows as trees: structs, maps and lists of them, of which parts are read, put, kept or left out by paths.

A path is names with dots between them: fields of structs, keys of maps; a list is passed through to its elements. What is
kept is an expression over fields, so a scan of nested columns reads those fields only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

Tree = dict[str, Any]


def tree(paths: Iterable[str] | Mapping) -> Tree:
    """Paths as a tree of names; of a path and one that goes on from it the shorter one holds. A tree stays as it is."""
    if isinstance(paths, Mapping):
        return {k: tree(v) if v else {} for k, v in paths.items()}
    out: Tree = {}
    for path in sorted(set(paths), key=lambda p: p.count(".")):
        at, names = out, path.split(".")
        for i, name in enumerate(names):
            if name in at and not at[name]:
                break
            at = at.setdefault(name, {})
            if i == len(names) - 1:
                at.clear()
    return out


def merged(*trees: Iterable[str] | Mapping) -> Tree:
    """One tree that holds all that any of them holds."""
    out: Tree = {}
    for t in map(tree, trees):
        for name, below in t.items():
            out[name] = {} if not below or (name in out and not out[name]) else merged(out[name], below) if name in out else below
    return out


def _fields(kind: StructType, names: Iterable[str], where: str) -> None:
    missing = [n for n in names if n not in kind.fieldNames()]
    if missing:
        raise ValueError(f"there is no {', '.join(missing)} in {where}: {', '.join(kind.fieldNames())}")


def _kept(value: Column, kind: DataType, wanted: Tree, where: str) -> Column:
    if not wanted:
        return value
    if isinstance(kind, StructType):
        _fields(kind, wanted, where)
        parts = [_kept(value[f.name], f.dataType, wanted[f.name], f"{where}.{f.name}").alias(f.name) for f in kind.fields if f.name in wanted]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, MapType):
        out = F.map_filter(value, lambda k, _: k.cast("string").isin(*wanted))
        if not all(wanted.values()):
            return out
        below = merged(*wanted.values())  # values of a map are of one type
        return F.transform_values(out, lambda _, v: _kept(v, kind.valueType, below, f"{where}.{'|'.join(wanted)}"))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StructType) and not any(wanted.values()):
            _fields(kind.elementType, wanted, where)
            return _zipped(value, [n for n in kind.elementType.fieldNames() if n in wanted])
        return F.transform(value, lambda x: _kept(x, kind.elementType, wanted, where))
    raise ValueError(f"{where} has no parts")


def _zipped(value: Column, names: list[str]) -> Column:
    """A list of structs with some of their fields, as lists of fields put together: a scan reads these alone."""
    return F.arrays_zip(*(value[n].alias(n) for n in names))


def _without(value: Column, kind: DataType, unwanted: Tree, where: str) -> Column:
    if isinstance(kind, StructType):
        _fields(kind, unwanted, where)
        parts = [(_without(value[f.name], f.dataType, unwanted[f.name], f"{where}.{f.name}") if unwanted.get(f.name) else value[f.name]).alias(f.name) for f in kind.fields if unwanted.get(f.name, True)]
        if not parts:
            raise ValueError(f"nothing is left of {where}")
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, MapType):
        gone = [n for n, below in unwanted.items() if not below]
        out = F.map_filter(value, lambda k, _: ~k.cast("string").isin(*gone)) if gone else value

        def left(k: Column, v: Column) -> Column:
            new = v
            for name, below in unwanted.items():
                if below:
                    new = F.when(k.cast("string") == name, _nulled(v, kind.valueType, below, f"{where}.{name}")).otherwise(new)
            return new

        return F.transform_values(out, left) if any(unwanted.values()) else out
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StructType) and not any(unwanted.values()) and (left := [n for n in kind.elementType.fieldNames() if n not in unwanted]):
            _fields(kind.elementType, unwanted, where)
            return _zipped(value, left)
        return F.transform(value, lambda x: _without(x, kind.elementType, unwanted, where))
    raise ValueError(f"{where} has no parts")


def _nulled(value: Column, kind: DataType, unwanted: Tree, where: str) -> Column:
    """The value with nulls for its unwanted parts."""
    if not isinstance(kind, StructType):
        return _without(value, kind, unwanted, where)
    _fields(kind, unwanted, where)
    parts = []
    for f in kind.fields:
        old = value[f.name]
        new = old if f.name not in unwanted else _nulled(old, f.dataType, unwanted[f.name], f"{where}.{f.name}") if unwanted[f.name] else F.lit(None).cast(f.dataType)
        parts.append(new.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*parts))


def include(df: DataFrame, paths: Iterable[str] | Mapping) -> DataFrame:
    """The parts at the paths, in their places; a null struct stays null, a key that a map doesn't have is no error.

    Values of a map are of one type: below its keys the parts that any of the paths names are kept. A null among the structs
    of a list becomes a struct of nulls.
    """
    wanted = tree(paths)
    _fields(df.schema, wanted, "the row")
    return df.select(*(_kept(F.col(f"`{f.name}`"), f.dataType, wanted[f.name], f.name).alias(f.name) for f in df.schema.fields if f.name in wanted))


def exclude(df: DataFrame, paths: Iterable[str] | Mapping) -> DataFrame:
    """All but the parts at the paths; below a key of a map, whose values are of one type, they become null."""
    unwanted = tree(paths)
    _fields(df.schema, unwanted, "the row")
    return df.select(*((_without(F.col(f"`{f.name}`"), f.dataType, unwanted[f.name], f.name).alias(f.name) if unwanted.get(f.name) else F.col(f"`{f.name}`")) for f in df.schema.fields if unwanted.get(f.name, True)))


def get(df: DataFrame, path: str) -> Column:
    """The part at a path; null where a struct on the way is null or a map has no such key. Of a list: each element's part."""

    def below(value: Column, kind: DataType, names: list[str]) -> Column:
        if not names:
            return value
        if isinstance(kind, StructType):
            _fields(kind, names[:1], path)
            return below(value[names[0]], kind[names[0]].dataType, names[1:])
        if isinstance(kind, MapType):
            return below(F.try_element_at(value, F.lit(names[0]).cast(kind.keyType)), kind.valueType, names[1:])
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: below(x, kind.elementType, names))
        raise ValueError(f"{path}: {names[0]} is a part of what has no parts")

    first, *rest = path.split(".")
    _fields(df.schema, [first], "the row")
    return below(F.col(f"`{first}`"), df.schema[first].dataType, rest)


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """The rows with a value at a path: a field or key that is there changes, one that isn't is added, with the structs to it."""

    def below(old: Column | None, kind: DataType | None, names: list[str]) -> Column:
        if not names:
            return value
        if kind is None:
            return F.struct(below(None, None, names[1:]).alias(names[0]))
        if isinstance(kind, StructType):
            fields = {f.name: old[f.name] for f in kind.fields}
            fields[names[0]] = below(fields.get(names[0]), kind[names[0]].dataType if names[0] in fields else None, names[1:])
            return F.struct(*(c.alias(n) for n, c in fields.items()))
        if isinstance(kind, MapType):
            if len(names) > 1 and not isinstance(kind.valueType, StructType | MapType):
                raise ValueError(f"{path}: values of the map have no parts")
            new = below(F.try_element_at(old, F.lit(names[0]).cast(kind.keyType)), kind.valueType, names[1:])
            rest = F.map_filter(F.coalesce(old, F.create_map().cast(kind)), lambda k, _: k.cast("string") != names[0])
            return F.map_concat(rest, F.create_map(F.lit(names[0]).cast(kind.keyType), new.cast(kind.valueType)))
        raise ValueError(f"{path}: {names[0]} cannot be put into what has no parts")

    first, *rest = path.split(".")
    there = first in df.columns
    return df.withColumn(first, below(F.col(f"`{first}`") if there else None, df.schema[first].dataType if there else None, rest))
