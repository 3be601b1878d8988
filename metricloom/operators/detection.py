"""Object detection: boxes are matched within each image, the rest are metrics over the matched rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metricloom.functions import boxes
from metricloom.functions.scalars import numbers
from metricloom.operators.confidence import Sampling
from metricloom.operators.slicing import SlicingSpec


def matched(df: DataFrame, truth: str = "truth", found: str = "found", iou: Sequence[float] = (0.5,), classes: Sequence[int | None] = (None,), area: tuple[float, float] | None = None, most: int | None = None, weight: str | None = None) -> DataFrame:
    """The other columns with ``iou, class_id, label, prediction, weight`` for each matched or unmatched box.

    ``truth``: arrays of [left, top, right, bottom, class]; ``found`` also ends with a score. Images go through one
    function in batches; no image meets another.
    """

    rest = [c for c in df.columns if c not in (truth, found, "iou", "class_id", "label", "prediction", "weight")]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    given = df.select(*(f"`{c}`" for c in rest), w.alias("weight"), F.col(truth).cast("array<array<double>>").alias("__t"), F.col(found).cast("array<array<double>>").alias("__d"))
    out = given.drop("__t", "__d")
    steps = sorted(set(map(float, iou)))
    schema = out.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("class_id", "int"), ("label", "double"), ("prediction", "double"), ("__first", "int"), ("__n", "int")))).schema
    fields, names = to_arrow_schema(schema), out.columns

    def flat(column: pa.Array, width: int) -> tuple:
        """All boxes as rows of numbers, and the image of each."""
        filled = pa.array(column.to_pylist(), column.type) if column.offset else column
        outer = np.where(filled.is_null().to_numpy(zero_copy_only=False), 0, filled.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        inner = filled.flatten()
        numbers = inner.flatten().to_numpy(zero_copy_only=False)
        if len(numbers) != width * len(inner):
            raise ValueError(f"a box has {width} numbers here")
        return numbers.reshape(-1, width), np.repeat(np.arange(len(column)), outer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, t_of = flat(batch.column("__t"), 5)
            d, d_of = flat(batch.column("__d"), 6)
            for c in classes:
                for at, label, score, first, n in boxes.matched(t, t_of, d, d_of, len(batch), steps, c, area, most):
                    if len(at):
                        kept = batch.select(names).take(pa.array(at))
                        new = (pa.array(np.full(len(at), c)) if c is not None else pa.nulls(len(at)), pa.array(label), pa.array(score), pa.array(first), pa.array(n))
                        yield pa.RecordBatch.from_arrays([*kept.columns, *(x.cast(f.type) for x, f in zip(new, list(fields)[-5:], strict=True))], schema=fields)

    # a run of thresholds with the same matches leaves Python as one row
    each = F.explode(F.slice(F.lit(steps).cast("array<double>"), F.col("__first") + 1, F.col("__n"))).alias("iou")
    return given.mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in out.columns), each, "class_id", "label", "prediction")


def stacked(columns: Sequence[str], count: str | None = None):
    """One array of boxes from a column for each coordinate; ``count`` cuts off padding."""
    rows = F.transform(F.arrays_zip(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))), lambda z: F.array(*(z[f"c{i}"].cast("double") for i in range(len(columns)))))
    return rows if count is None else F.slice(rows, 1, F.col(count))


def curve(rows: DataFrame, specs: Sequence[SlicingSpec] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, iou, class_id, threshold, tp, fp, positives``: at each distinct score of a slice, IoU and class.

    Scores are summed first; the running sums then go over distinct scores to four places at most, as a histogram.
    """
    states = {
        "t": F.when(F.col("prediction") > 0, F.col("weight") * F.col("label")).otherwise(0.0), "f": F.col("weight") * (1 - F.col("label")), "l": F.col("weight") * F.col("label"),
    }
    placed = rows.withColumn("threshold", F.floor(F.col("prediction") * 10_000) / 10_000)
    binned = (sampling or Sampling()).sums(placed, specs, states, ["iou", "class_id", "threshold"])
    keys = _keys(sampling)
    group = Window.partitionBy(*keys)
    down = group.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return binned.select(*keys, "threshold", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"), F.sum("l").over(group).alias("positives"))


def _keys(sampling: Sampling | None) -> list[str]:
    return ["slice_key", "iou", "class_id", *(["__b"] if sampling else [])]


def average_precision(rows: DataFrame, recalls: Sequence[float] = tuple(i / 100 for i in range(101)), specs: Sequence[SlicingSpec] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, iou, class_id, value, recall``: the mean over recalls of the best precision at that recall or more,
    and the greatest recall; null without positives."""
    reached = F.size(F.filter(numbers(list(map(float, recalls))), lambda r: r <= F.col("recall")))
    points = curve(rows, specs, sampling).withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "positives")}).withColumn("reached", F.coalesce(reached, F.lit(0)))
    own = Window.partitionBy(*_keys(sampling))
    # the best precision at a recall or more is that at a threshold or less
    best = F.coalesce(F.max("precision").over(own.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    steps = points.withColumn("part", best * (F.col("reached") - F.coalesce(F.lag("reached").over(own.orderBy(F.desc("threshold"))), F.lit(0))))
    return steps.groupBy(*_keys(sampling)).agg(F.when(F.max("positives") > 0, F.sum("part") / len(recalls)).alias("value"), F.max("recall").alias("recall"))


def average_recall(rows: DataFrame, specs: Sequence[SlicingSpec] = (), sampling: Sampling | None = None) -> DataFrame:
    """``slice_key, iou, class_id, value``: the greatest recall; null without positives."""
    return curve(rows, specs, sampling).groupBy(*_keys(sampling)).agg(F.try_divide(F.max("tp"), F.max("positives")).alias("value"))


def mean_over(values: DataFrame, by: Sequence[str] = ("slice_key",)) -> DataFrame:
    """The mean of the values that there are: over IoU thresholds, over classes, or both."""
    return values.groupBy(*by).agg(F.avg("value").alias("value"))


#: The IoU thresholds of the mean metrics: 0.50 to 0.95 by 0.05.
IOUS = tuple(0.5 + 0.05 * i for i in range(10))

