"""Plots and tables of cells by configuration: many values of one metric, each with where it stands.

Each takes rows with ``__label``, ``__prediction`` and ``__weight``, the slices, its parameters and a sampling, and gives
``slice_key, __b, point, measure, value``; ``point`` is a list of names and numbers, such as the threshold. Intervals are
by point and measure, as those of metrics are by metric."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import div_far
from metricloom.operators import curves, multiclass
from metricloom.operators.confidence import Sampling
from metricloom.operators.metrics import Row, cell
from metricloom.operators.slicing import SlicingSpec

Specs = Sequence[SlicingSpec]
RATES = ("precision", "recall", "f1", "accuracy", "false_positive_rate", "false_omission_rate")


def _at(*columns: str) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns)).alias("point")


def _measures(frame: DataFrame, point: Sequence[str], measures: Sequence[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    return frame.select("slice_key", "__b", _at(*point), F.inline(each))


def _histogram(df: DataFrame, specs: Specs, sampling: Sampling) -> DataFrame:
    w, l, p = (F.col(c).cast("double") for c in ("__weight", "__label", "__prediction"))
    return sampling.parts(curves.bucketed(df, "__prediction"), specs, {"w": w, "wl": w * l, "wp": w * F.nanvl(p, F.lit(0.0))}, ["bucket"])


def _cells(df: DataFrame, specs: Specs, sampling: Sampling, steps: int) -> DataFrame:
    cells = curves.matrices(_histogram(df, specs, sampling), [-1e-6, *(i / steps for i in range(steps + 1))], by=["__b"])
    return sampling.samples_of(cells, ["slice_key", "threshold"], curves.CELLS)


def _confusion(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    return _measures(curves.with_rates(_cells(df, specs, sampling, params.get("num_thresholds", 1000))), ["threshold"], [*curves.CELLS, *RATES])


def _calibration(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    found = curves.calibration_plot(_histogram(df, specs, sampling), points=params.get("num_buckets", 1000), by=["__b"])
    each = sampling.samples_of(found, ["slice_key", "lower", "upper"], ["w", "wl", "wp"])
    return _measures(each, ["lower", "upper"], ["w", "wl", "wp"])


def _score_distribution(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    cells = _cells(df, specs, sampling, params.get("num_thresholds", 1000))
    return _measures(cells.withColumns({"above": F.col("tp") + F.col("fp"), "below": F.col("tn") + F.col("fn")}), ["threshold"], ["above", "below"])


def _multi_class(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    rows = multiclass.confusion_rows(df, params.get("thresholds", (0.5,)), "__label", "__prediction")
    found = sampling.sums(rows, specs, {"w": F.col("__weight")}, ["threshold", "actual", "predicted"])
    return _measures(found, ["threshold", "actual", "predicted"], ["w"])


def _multi_label(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    rows, states = multiclass.multi_label_rows(df, params.get("thresholds", (0.5,)), "__label", "__prediction", "__weight")
    return _measures(sampling.sums(rows, specs, states, ["threshold", "actual", "predicted"]), ["threshold", "actual", "predicted"], list(states))


def _at_thresholds(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    """Cells counted row by row, with rates."""
    row = Row(*(F.col(c).cast("double") for c in ("__label", "__prediction", "__weight")))
    bounds = [float(t) for t in params["thresholds"]]
    sums = sampling.sums(df, specs, {f"{kind}{i}": cell(kind, t)[1](row) for i, t in enumerate(bounds) for kind in curves.CELLS})
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{kind}{i}").alias(kind) for kind in curves.CELLS)) for i, t in enumerate(bounds)))
    return _measures(curves.with_rates(sums.select("slice_key", "__b", F.inline(each))), ["threshold"], [*curves.CELLS, *RATES])


def _segmentation(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    """Cells of each class over pixels; pixels whose truth is ``ignore`` count in no cell of negatives."""
    pixels = df.select("*", F.explode(F.arrays_zip(F.col("__label").alias("t"), F.col("__prediction").alias("p"))).alias("__z"))
    ignore = params.get("ignore")
    by_class = pixels.withColumn("class_id", F.explode(F.lit(list(params["classes"])).cast("array<int>")))
    t, p = F.col("__z.t") == F.col("class_id"), F.col("__z.p") == F.col("class_id")
    real = F.lit(True) if ignore is None else F.col("__z.t") != ignore
    amount = lambda c: F.when(c, F.col("__weight")).otherwise(0.0)
    states = {"tp": amount(t & p), "fp": amount(~t & p & real), "fn": amount(t & ~p), "tn": amount(~t & ~p & real)}
    return _measures(sampling.sums(by_class, specs, states, ["class_id"]), ["class_id"], list(states))


def _attributions(absolute: bool, mean: bool) -> Callable[[DataFrame, Specs, dict, Sampling], DataFrame]:
    """A map's values by key, the features: totals, or means over the weight of all rows; with ``class_id`` of arrays by class."""

    def rows(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
        parts = df.select("*", F.explode(F.expr(params["column"])).alias("__feature", "__a"))
        a = F.col("__weight") * (F.element_at("__a", params["class_id"] + 1) if "class_id" in params else F.col("__a")).cast("double")
        found = sampling.sums(parts, specs, {"value": F.abs(a) if absolute else a}, ["__feature"])
        if mean:
            counts = sampling.sums(df, specs, {"__n": F.col("__weight")})
            found = found.join(counts, ["slice_key", "__b"]).withColumn("value", div_far(F.col("value"), F.col("__n")))
        nowhere = F.array().cast("array<struct<key: string, value: double>>").alias("point")
        return found.select("slice_key", "__b", nowhere, F.col("__feature").alias("measure"), "value")

    return rows


#: Names of metrics that are tables by feature.
ATTRIBUTIONS = {"TotalAttributions": (False, False), "TotalAbsoluteAttributions": (True, False), "MeanAttributions": (False, True), "MeanAbsoluteAttributions": (True, True)}

#: Names of plots, with the parameters that they take.
PLOTS: dict[str, tuple[Callable[[DataFrame, Specs, dict, Sampling], DataFrame], tuple[str, ...]]] = {
    "ConfusionMatrixPlot": (_confusion, ("num_thresholds",)),
    "ConfusionMatrixAtThresholds": (_at_thresholds, ("thresholds", "example_id", "example_count")),
    "CalibrationPlot": (_calibration, ("num_buckets",)),
    "ScoreDistributionPlot": (_score_distribution, ("num_thresholds",)),
    "MultiClassConfusionMatrixPlot": (_multi_class, ("thresholds",)),
    "MultiLabelConfusionMatrixPlot": (_multi_label, ("thresholds",)),
    "SemanticSegmentationConfusionMatrix": (_segmentation, ("classes", "ignore")),
    **{name: (_attributions(*how), ("column", "class_id")) for name, how in ATTRIBUTIONS.items()},
}


def plot_rows(df: DataFrame, config, found: Sequence, sampling: Sampling) -> DataFrame | None:
    """``slice_key, model, output, metric, sub_key, point, measure, __b, value`` of all configured plots."""
    from metricloom.plans.evaluate import _row

    out = None
    for item in found:
        if item.config.name in PLOTS:
            draw, known = PLOTS[item.config.name]
            unknown = set(item.config.params) - set(known)
            if unknown:
                raise ValueError(f"{item.config.name} has no parameter {', '.join(sorted(unknown))}")
            for model in config.models:
                row = _row(model, None)
                rows = df.withColumns({"__label": row.label, "__prediction": row.prediction, "__weight": row.weight})
                one = draw(rows, config.slices, item.config.params, sampling)
                one = one.withColumns({"model": F.lit(model.name), "output": F.lit(model.output), "metric": F.lit(item.name), "sub_key": F.lit(None).cast("string")})
                out = one if out is None else out.unionByName(one)
    return out


def example_rows(df: DataFrame, config, found: Sequence) -> DataFrame | None:
    """``slice_key, model, output, threshold, cell, ids``: ids of rows in each cell, where a configured matrix asks for them."""
    from metricloom.plans.evaluate import _row

    out = None
    for item in found:
        params = item.config.params
        if item.config.name == "ConfusionMatrixAtThresholds" and "example_id" in params:
            for model in config.models:
                row = _row(model, None)
                rows = df.withColumns({"__label": row.label, "__prediction": row.prediction, "__example": F.expr(params["example_id"])})
                one = curves.cell_examples(rows, params["thresholds"], "__example", params.get("example_count", 100), config.slices, "__label", "__prediction")
                one = one.withColumns({"model": F.lit(model.name), "output": F.lit(model.output)})
                out = one if out is None else out.unionByName(one)
    return out
