"""Thresholds on results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.slicing import OVERALL, SlicingSpec, applies


@dataclass(frozen=True)
class Threshold:
    """Bounds on a metric's value, or, with a direction (``higher`` or ``lower`` is better), on its change against the
    baseline model: absolute, or relative to the baseline."""

    metric: str
    lower: float | None = None
    upper: float | None = None
    direction: str | None = None
    absolute: float | None = None
    relative: float | None = None
    spec: SlicingSpec = OVERALL
    model: str = ""


def _passes(t: Threshold, value: Column, change: Column) -> Column:
    ok = F.lit(True)
    if t.lower is not None:
        ok = ok & (value >= t.lower)
    if t.upper is not None:
        ok = ok & (value <= t.upper)
    if t.direction:
        sign = 1 if t.direction == "higher" else -1
        before = value - change
        if t.absolute is not None:
            ok = ok & (sign * change >= sign * t.absolute)
        if t.relative is not None:  # a baseline of 0 has no ratio and fails
            ok = ok & (F.abs(before) > 1e-9) & (sign * F.try_divide(change, before) >= sign * t.relative)
    return F.coalesce(ok & ~F.isnan(value), F.lit(False))


def validate(results: DataFrame, thresholds: Sequence[Threshold]) -> DataFrame:
    """``metric, model, threshold, slice_key, value, ok, message``: a row for each slice of each threshold's spec, and one
    for each threshold that meets no slice or no metric.

    ``results``: ``slice_key, metric, model, value`` and, for changes, ``change`` against the baseline model. Each result
    is held against all thresholds at once, so the results are read once, and once more for thresholds that met none.
    """
    if not thresholds:
        raise ValueError("no thresholds: everything would pass unseen")
    if "change" not in results.columns:
        results = results.withColumn("change", F.lit(None).cast("double"))
    tests = []
    for i, t in enumerate(thresholds):
        here = (F.col("metric") == t.metric) & (F.col("model") == t.model) & applies(F.col("slice_key"), t.spec)
        tests.append(F.when(here, F.struct(F.lit(i).alias("threshold"), _passes(t, F.col("value"), F.col("change")).alias("ok"))))
    met = results.select("metric", "model", "slice_key", "value", F.inline(F.array_compact(F.array(*tests))))
    met = met.select("metric", "model", "threshold", "slice_key", "value", "ok", F.when(~F.col("ok"), F.lit("the value breaks the threshold")).alias("message"))
    seen = met.agg(F.collect_set("threshold").alias("seen"))
    wanted = F.array(*(F.struct(F.lit(t.metric).alias("metric"), F.lit(t.model).alias("model"), F.lit(i).alias("threshold")) for i, t in enumerate(thresholds)))
    missing = seen.select(F.inline(F.filter(wanted, lambda w: ~F.array_contains("seen", w["threshold"])))).select(
        "metric", "model", "threshold", F.lit(None).cast(results.schema["slice_key"].dataType).alias("slice_key"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("ok"),
        F.lit("no result for this threshold").alias("message"),
    )
    return met.unionAll(missing)


def missing_slices(results: DataFrame, specs: Sequence[SlicingSpec]) -> DataFrame:
    """``spec``: numbers of the specs to which no slice of the results belongs."""
    belongs = F.filter(F.array(*(F.struct(F.lit(i).alias("spec"), applies(F.col("slice_key"), s).alias("in")) for i, s in enumerate(specs))), lambda x: x["in"])
    seen = results.select(F.explode(F.transform(belongs, lambda x: x["spec"])).alias("spec")).agg(F.collect_set("spec").alias("seen"))
    return seen.select(F.explode(F.array_except(F.array(*map(F.lit, range(len(specs)))), "seen")).alias("spec"))


def verdict(validations: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """One row: whether all passed, how many did not, and how many thresholds met no result.

    ``missing``: specs without a slice, of ``missing_slices``; each one counts as missing, and nothing has passed then.
    """
    out = validations.agg(F.bool_and("ok").alias("ok"), F.count(F.when(~F.col("ok"), 1)).alias("failures"), F.count(F.when(F.col("slice_key").isNull(), 1)).alias("missing"))
    if missing is None:
        return out
    gone = missing.agg(F.count("*").alias("__gone"))
    return out.join(gone, F.lit(True)).select((F.col("ok") & (F.col("__gone") == 0)).alias("ok"), "failures", (F.col("missing") + F.col("__gone")).alias("missing"))


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Verdicts of several runs as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.bool_and("ok").alias("ok"), F.sum("failures").alias("failures"), F.sum("missing").alias("missing"))
