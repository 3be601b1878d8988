"""Slices: grouping sets by feature columns, with values, with many values in a row, and by SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "array<struct<key: string, value: string>>"


@dataclass(frozen=True)
class SlicingSpec:
    """``keys``: columns to slice by; ``values``: column to required value, part of the slice's key; or ``sql``.

    Neither keys nor values nor SQL is the slice of all rows.
    """

    keys: tuple[str, ...] = ()
    values: tuple[tuple[str, object], ...] = field(default=())
    sql: str | None = None

    def __post_init__(self) -> None:
        values = dict(self.values)
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "values", tuple(sorted(values.items())))
        if set(self.keys) & set(values):
            raise ValueError("a column is a slice key or has a value, not both")
        if self.sql and (self.keys or values):
            raise ValueError("SQL stands alone in a slicing spec")

    def columns(self) -> set[str]:
        return set(re.findall(r"\bexample\.(\w+)", self.sql)) if self.sql else {*self.keys, *dict(self.values)}


OVERALL = SlicingSpec()


def _is_array(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def _values(df: DataFrame, name: str) -> Column:
    """Sorted distinct values of a row's feature as strings; none if it is null."""
    c = F.col(f"`{name}`")
    if _is_array(df, name):
        return F.transform(F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast(df.schema[name].dataType)), lambda x: x.isNotNull()))), lambda x: x.cast("string"))
    return F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(F.array().cast("array<string>"))


def _matches(df: DataFrame, name: str, value: object) -> Column:
    """Equality with the value, or with its text."""
    c = F.col(f"`{name}`")
    text = F.lit(str(value))
    if _is_array(df, name):
        return F.coalesce(F.exists(c, lambda x: x.cast("string") == text), F.lit(False))
    same = c.cast("string") == text
    return F.coalesce(same | (c == F.lit(value)) if isinstance(value, int | float) and df.schema[name].dataType.typeName() != "string" else same, F.lit(False))


def _product(keys: Column, name: str, choices: Column) -> Column:
    """Each key followed by each choice."""
    return F.flatten(F.transform(keys, lambda k: F.transform(choices, lambda v: F.concat(k, F.array(F.struct(F.lit(name).alias("key"), v.alias("value")))))))


def slice_keys_of(df: DataFrame, spec: SlicingSpec) -> Column:
    """The keys of the slices of one spec that a row belongs to: a row with a missing column or value has none."""
    if spec.sql:
        return sql_slice_keys(spec.sql)
    keys = F.array(F.array().cast(KEY)).cast(f"array<{KEY}>")
    for name in sorted({*spec.keys, *dict(spec.values)}):
        choices = F.array(F.lit(str(dict(spec.values)[name]))) if name in dict(spec.values) else _values(df, name)
        keys = _product(keys, name, choices)
    held = F.lit(True)
    for name, value in spec.values:
        held = held & _matches(df, name, value)
    return F.when(held, keys).otherwise(F.array().cast(f"array<{KEY}>"))


def sql_slice_keys(sql: str) -> Column:
    """Keys by ``SELECT STRUCT(expr [AS name], ...) [FROM example.list [, ...]] [WHERE condition]``.

    ``example`` is the row; a list in FROM gives a slice for each of its elements; ``x IN UNNEST(example.list)`` asks for
    an element. A null value gives no slice.
    """
    m = re.fullmatch(r"(?is)\s*SELECT\s+STRUCT\s*\((?P<fields>.*?)\)\s*(?:FROM\s+(?P<source>(?:example\.\w+\s*,?\s*)+?))?\s*(?:WHERE\s+(?P<where>.*?))?;?\s*", sql)
    if not m:
        raise ValueError(f"this SQL doesn't tell slices: {sql}")

    def plain(text: str) -> str:
        text = re.sub(r"(?i)([\w.']+)\s+NOT\s+IN\s+UNNEST\s*\(\s*([\w.]+)\s*\)", r"NOT array_contains(\2, \1)", text)
        text = re.sub(r"(?i)([\w.']+)\s+IN\s+UNNEST\s*\(\s*([\w.]+)\s*\)", r"array_contains(\2, \1)", text)
        return re.sub(r"\bexample\.", "", text)

    fields = []
    for part in re.split(r",(?![^()]*\))", m["fields"]):
        named = re.fullmatch(r"(?is)\s*(.+?)(?:\s+AS\s+(\w+))?\s*", part)
        text = plain(named[1])
        fields.append((named[2] or text.split(".")[-1], text))
    made = "array(" + ", ".join(f"struct('{n}' AS key, CAST({e} AS STRING) AS value)" for n, e in sorted(fields)) + ")"
    where = plain(m["where"]) if m["where"] else "true"
    names = re.findall(r"example\.(\w+)", m["source"] or "")
    out = f"filter(array(IF(coalesce({where}, false), {made}, null)), k -> k IS NOT NULL AND NOT exists(k, s -> s.value IS NULL))"
    for name in reversed(names):  # the element's name hides the list's within
        out = f"flatten(transform({name}, {name} -> {out}))"
    return F.coalesce(F.expr(out).cast(f"array<{KEY}>"), F.array().cast(f"array<{KEY}>"))


def slice_keys(df: DataFrame, specs: Sequence[SlicingSpec]) -> Column:
    """The distinct slices of a row over all specs; the slice of all rows without any spec."""
    return F.array_distinct(F.concat(*(slice_keys_of(df, s) for s in specs or (OVERALL,))))


def slice_name(key: Column) -> Column:
    """``a_X_b:v1_X_v2``, or ``Overall``."""
    return F.when(F.size(key) == 0, F.lit("Overall")).otherwise(F.concat(F.concat_ws("_X_", F.transform(key, lambda s: s["key"])), F.lit(":"), F.concat_ws("_X_", F.transform(key, lambda s: s["value"]))))


def fan_out(df: DataFrame, specs: Sequence[SlicingSpec]) -> DataFrame:
    """A row for each slice of each row, with its ``slice_key``."""
    return df.withColumn("slice_key", F.explode(slice_keys(df, specs)))


def applies(key: Column, spec: SlicingSpec) -> Column:
    """Whether a slice's key belongs to a spec: its values and columns, and nothing else."""
    values = dict(spec.values)
    out = F.size(key) == len(spec.keys) + len(values)
    pairs = F.transform(key, lambda s: F.concat_ws("=", s["key"], s["value"]))
    for name in spec.keys:
        out = out & F.array_contains(F.transform(key, lambda s: s["key"]), name)
    for name, value in spec.values:
        out = out & F.array_contains(pairs, f"{name}={value}")
    return out


#: Columns of all specs up to which rows are first summed by all of them together.
TOGETHER = 3


def grouped_sums(df: DataFrame, specs: Sequence[SlicingSpec], states: dict[str, Column], by: Sequence[str] = (), kinds: dict[str, str] | None = None) -> DataFrame:
    """Sums (or ``min``, ``max`` by ``kinds``) of the states for each slice and the values of ``by``.

    Rows are first summed by the columns that slices need, then each of these few groups fans out to its slices: what
    fans out is as large as the groups, not as the rows. Specs over few columns share one grouping. Many columns together
    would make nearly as many groups as rows; then each set of columns that specs use is a grouping set of its own, and
    its groups fan out to its own specs only.
    """
    kinds = kinds or {}
    specs = tuple(dict.fromkeys(specs or (OVERALL,)))
    total = lambda name, c: getattr(F, kinds.get(name, "sum"))(c).alias(name)
    needed = sorted({c for s in specs for c in s.columns()} - set(by))
    quoted = lambda names: [f"`{c}`" for c in names]
    sets = list(dict.fromkeys(tuple(sorted(s.columns() - set(by))) for s in specs))
    if len(needed) <= TOGETHER or len(sets) == 1 or any(s.sql for s in specs):  # two specs by SQL may name one slice
        first = df.groupBy(*quoted([*needed, *by])).agg(*(total(n, c) for n, c in states.items()))
        return fan_out(first, specs).groupBy("slice_key", *by).agg(*(total(n, F.col(f"`{n}`")) for n in states))
    columns = [*needed, *by]
    first = df.select(*quoted(columns), *(c.alias(n) for n, c in states.items())).groupingSets([quoted([*s, *by]) for s in sets], *quoted(columns))
    first = first.agg(*(total(n, F.col(f"`{n}`")) for n in states), F.grouping_id().alias("__set"))
    place = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    keys = None
    for own in sets:  # a grouping's number has a bit for each column that is not in it
        number = sum(p for c, p in place.items() if c not in own and c not in by)
        mine = slice_keys(first, [s for s in specs if tuple(sorted(s.columns() - set(by))) == own])
        keys = F.when(F.col("__set") == number, mine) if keys is None else keys.when(F.col("__set") == number, mine)
    return first.withColumn("slice_key", F.explode(keys)).groupBy("slice_key", *by).agg(*(total(n, F.col(f"`{n}`")) for n in states))


def hide_small(results: DataFrame, counts: DataFrame, least: int, value: str = "value") -> DataFrame:
    """Values of slices with fewer than ``least`` rows become null, with an ``error``; the slice of all rows stays.

    ``counts``: ``slice_key, n``.
    """
    joined = results.join(counts.select("slice_key", F.col("n").alias("__n")), "slice_key", "left")
    small = (F.coalesce("__n", F.lit(0)) < least) & (F.size("slice_key") > 0)
    message = F.lit(f"hidden: fewer than {least} rows")
    return joined.withColumn(value, F.when(~small, F.col(value))).withColumn("error", F.when(small, message)).drop("__n")


def slice_pairs(results: DataFrame, baseline: SlicingSpec, comparisons: Sequence[SlicingSpec], on: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """``*on, baseline_key, base, comparison_key, other``: the values of two slices side by side.

    Without comparisons everything that isn't the baseline is compared. There are as many rows as baseline slices times
    comparison slices times what ``on`` tells apart: slices are few, and Spark joins them by that.
    """
    base = results.where(applies(F.col("slice_key"), baseline)).select(*on, F.col("slice_key").alias("baseline_key"), F.col(value).alias("base"))
    wanted = ~applies(F.col("slice_key"), baseline) if not comparisons else F.lit(False)
    for spec in comparisons:
        wanted = wanted | applies(F.col("slice_key"), spec)
    other = results.where(wanted).select(*on, F.col("slice_key").alias("comparison_key"), F.col(value).alias("other"))
    return base.join(other, list(on)).where("baseline_key != comparison_key")


def cross_slices(results: DataFrame, baseline: SlicingSpec, comparisons: Sequence[SlicingSpec], on: Sequence[str] = ("metric",)) -> DataFrame:
    """``baseline_key, comparison_key``, the shared metrics and baseline minus comparison."""
    return slice_pairs(results, baseline, comparisons, on).withColumn("value", F.col("base") - F.col("other")).drop("base", "other")
