"""Counts that are taken while a plan runs: rows and bytes that go in, slices and values that come out.

They are observed on the running plan, so no row is read again for them; they are known once an action has run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, FloatType, IntegerType, MapType, NullType, ShortType, StringType, StructType

from metricloom.plans.config import EvalConfig
from metricloom.plans.evaluate import evaluate

WIDTHS = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, DateType: 4, DecimalType: 16, NullType: 0}


def bytes_of(value: Column, kind: DataType) -> Column:
    """Bytes of a value: of text as UTF-8, of numbers by their width (8 but for smaller kinds), of parts together; null is 0."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, StructType):
        size = F.lit(0).cast("long")
        for f in kind.fields:
            size = size + bytes_of(value[f.name], f.dataType)
    elif isinstance(kind, MapType):
        size = bytes_of(F.map_keys(value), ArrayType(kind.keyType)) + bytes_of(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, ArrayType):
        size = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + bytes_of(x, kind.elementType))
    else:
        size = F.lit(WIDTHS.get(type(kind), 8)).cast("long")
    return F.when(value.isNotNull(), size).otherwise(F.lit(0).cast("long"))


def row_bytes(df: DataFrame) -> Column:
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        out = out + bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return out


@dataclass
class Counters:
    """Counts by name, after an action on the results that they came with."""

    inputs: Observation
    outputs: Observation

    def get(self) -> dict[str, int]:
        return {**self.inputs.get, **self.outputs.get}


def counted(df: DataFrame, config: EvalConfig) -> tuple[dict[str, DataFrame], Counters]:
    """The results of a configuration of metrics over sums, and ``rows``, ``bytes``, ``slices``, ``values`` and ``undefined``.

    The rows are read once by such metrics, and counted there; a configuration that reads them more often is an error.
    """
    from metricloom.operators.metrics import CrossSlice, Derived, Metric
    from metricloom.plans.evaluate import items

    found = items(config)
    if config.options.min_slice_size > 1 or any(not isinstance(i.made, Metric | Derived | CrossSlice) or i.config.keyed for i in found):
        raise ValueError("counts are for metrics over sums, which read the rows once")
    seen, made = Observation("inputs"), Observation("outputs")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"))
    results = evaluate(observed, config)
    metrics, first = results["metrics"], config.models[-1]
    name = next(i.name for i in found if isinstance(i.made, Metric) and not i.name.startswith("_"))
    one = (F.col("metric") == name) & (F.col("model") == first.name)
    if "output" in metrics.columns:
        one = one & (F.col("output") == first.output)
    none = F.col("value").isNull() | F.isnan("value")
    results["metrics"] = metrics.observe(made, F.count(F.when(one, 1)).alias("slices"), F.count(F.lit(1)).alias("values"), F.count(F.when(none, 1)).alias("undefined"))
    return results, Counters(seen, made)
