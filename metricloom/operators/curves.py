"""Curves over thresholds from a histogram of predictions: AUC, metrics under a constraint, and plots.

Rows are summed into buckets of the prediction; all that follows works on a bounded number of buckets for each slice."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import above, div, numbers
from metricloom.operators.slicing import SlicingSpec, fan_out

EPS = 1e-7
#: The four sums of a confusion matrix.
CELLS = ("tp", "fp", "fn", "tn")


def histogram(df: DataFrame, specs: Sequence[SlicingSpec] = (), buckets: int = 10_000, left: float = 0.0, right: float = 1.0, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """``slice_key, *by, bucket`` and the sums ``w, wl, wp`` of rows whose prediction falls into a bucket.

    Bucket 0 lies below ``left`` and holds NaN, which is above no threshold; bucket ``buckets + 1`` holds ``right`` and
    above. Rows without a prediction are left out; a NaN adds nothing to ``wp``. Rows are summed before they fan out.
    """
    needed = sorted({c for s in specs for c in s.columns()} - set(by))
    w, l, p = (F.col(c).cast("double") for c in (weight, label, prediction))
    placed = bucketed(df, prediction, buckets, left, right)
    first = placed.groupBy(*(f"`{c}`" for c in needed), *by, "bucket").agg(F.sum(w).alias("w"), F.sum(w * l).alias("wl"), F.sum(w * F.nanvl(p, F.lit(0.0))).alias("wp"))
    return fan_out(first, specs).groupBy("slice_key", *by, "bucket").agg(*(F.sum(c).alias(c) for c in ("w", "wl", "wp")))


def bucketed(df: DataFrame, prediction: str = "prediction", buckets: int = 10_000, left: float = 0.0, right: float = 1.0) -> DataFrame:
    """The rows with a prediction, with its ``bucket``."""
    bucket = F.when(F.isnan(F.col(prediction).cast("double")), F.lit(0).cast("long")).otherwise(F.expr(f"width_bucket(CAST(`{prediction}` AS DOUBLE), {left}D, {right}D, {buckets})"))
    return df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())


def exact_matrices(df: DataFrame, thresholds: Sequence[float], specs: Sequence[SlicingSpec] = (), by: Sequence[str] = (), label: str = "label", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """``slice_key, *by, threshold, tp, fp, fn, tn`` counted row by row at a few thresholds: positive strictly above."""
    from metricloom.operators.metrics import Row, cell
    from metricloom.operators.slicing import grouped_sums

    row = Row(F.col(label).cast("double"), F.col(prediction).cast("double"), F.col(weight).cast("double"))
    states = {f"{kind}{i}": cell(kind, t)[1](row) for i, t in enumerate(thresholds) for kind in ("tp", "fp", "fn", "tn")}
    sums = grouped_sums(df, specs, states, by)
    cells = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{kind}{i}").alias(kind) for kind in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds)))
    return sums.select("slice_key", *by, F.inline(cells))


def cell_examples(df: DataFrame, thresholds: Sequence[float], identity: str, size: int = 100, specs: Sequence[SlicingSpec] = (), label: str = "label", prediction: str = "prediction", order: Column | None = None) -> DataFrame:
    """``slice_key, threshold, cell, ids``: at most ``size`` rows' ids of each cell at each of a few thresholds.

    The first by a hash of the id (or by ``order``, then the id), so the same rows give the same ids. Rows are put between
    thresholds; of each such bin and class only the first ids leave a task, and go on from one grouping of slices to all of
    them: a cell's first ids are among the first of its bins. A label between 0 and 1 belongs to either class; repeated
    ids count once; a null id is no example.
    """
    bounds = sorted(set(map(float, thresholds)))
    needed = sorted({c for s in specs for c in s.columns()})
    p, l = F.col(prediction).cast("double"), F.col(label).cast("double")
    passed = F.when(F.isnan(p), 0).when(p.isNotNull(), F.size(F.filter(numbers(bounds), lambda t: t < p)))
    classes = F.array_compact(F.array(F.when(l > 0, True), F.when(l < 1, False)))
    rows = df.select(*(f"`{c}`" for c in needed), F.col(identity).alias("__id"), passed.alias("__bin"), F.explode(classes).alias("__on"), (F.xxhash64(identity) if order is None else order).alias("__o"))
    rows = rows.where("__bin IS NOT NULL AND __id IS NOT NULL")

    def first(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        own = Window.partitionBy(*by).orderBy("__o", "__id")
        # equal ids stand together: a rank without gaps counts each once
        return frame.withColumn("__r", F.dense_rank().over(own)).where(F.col("__r") <= size).drop("__r").distinct()

    kept = first(fan_out(first(rows, [*(f"`{c}`" for c in needed), "__bin", "__on"]), specs).select("slice_key", "__bin", "__on", "__id", "__o"), ["slice_key", "__bin", "__on"])
    each = kept.select("*", F.posexplode(numbers(bounds)).alias("__i", "threshold"))
    up = F.col("__bin") > F.col("__i")
    cell = F.when(up, F.when(F.col("__on"), "tp").otherwise("fp")).otherwise(F.when(F.col("__on"), "fn").otherwise("tn"))
    found = first(each.select("slice_key", "threshold", cell.alias("cell"), "__id", "__o"), ["slice_key", "threshold", "cell"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__o", "__id"))), lambda x: x["__id"])
    return found.groupBy("slice_key", "threshold", "cell").agg(ids.alias("ids"))


def interpolated_thresholds(n: int) -> list[float]:
    """Just below 0, evenly between, just above 1."""
    return [-EPS, *((i + 1) / (n - 1) for i in range(n - 2)), 1 + EPS]


def matrices(hist: DataFrame, thresholds: Sequence[float], buckets: int = 10_000, left: float = 0.0, right: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *by, threshold, tp, fp, fn, tn``: a bucket counts as above the thresholds that lie below its start.

    Buckets are put between thresholds first; sums from the end run over at most one row for each threshold.
    """
    ordered = sorted(set(thresholds))
    points = numbers([float(t) for t in ordered])
    # how many thresholds lie at or below each bucket's start
    before = [0, *(bisect_right(ordered, left + b * ((right - left) / buckets) + 1e-12) for b in range(buckets + 1))]
    binned = hist.withColumn("at", F.element_at(numbers(before, "int"), F.col("bucket").cast("int") + 1)).groupBy("slice_key", *by, "at").agg(F.sum("w").alias("w"), F.sum("wl").alias("wl"))
    groups = binned.groupBy("slice_key", *by).agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("w", "wl")))).alias("m"))
    every = groups.select("slice_key", *by, "m", F.posexplode(points).alias("i", "threshold"))
    amount = lambda name, lo, hi: F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at("m", k)[name], F.lit(0.0)))
    if len(ordered) <= 64:
        above = every.select("slice_key", *by, "threshold", *(amount(n, F.col("i") + 1, F.lit(len(ordered))).alias(f"{n}_above") for n in ("w", "wl")), *(amount(n, F.lit(0), F.col("i")).alias(f"{n}_below") for n in ("w", "wl")))
    else:
        value = lambda name, k: F.coalesce(F.try_element_at("m", k)[name], F.lit(0.0))
        flat = every.select("slice_key", *by, "threshold", "i", *(value(n, F.col("i") + 1).alias(n) for n in ("w", "wl")), *(value(n, F.lit(0)).alias(f"{n}_first") for n in ("w", "wl")))
        own = Window.partitionBy("slice_key", *by)
        end, before = own.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0), own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        above = flat.select("slice_key", *by, "threshold", *(F.sum(n).over(end).alias(f"{n}_above") for n in ("w", "wl")), *((F.col(f"{n}_first") + F.coalesce(F.sum(n).over(before), F.lit(0.0))).alias(f"{n}_below") for n in ("w", "wl")))
    return above.select(
        "slice_key", *by, "threshold", F.col("wl_above").alias("tp"), (F.col("w_above") - F.col("wl_above")).alias("fp"), F.col("wl_below").alias("fn"), (F.col("w_below") - F.col("wl_below")).alias("tn")
    )


def with_rates(cells: DataFrame) -> DataFrame:
    """Precision (1 without positives predicted), recall (0 without positives), F1, accuracy and the false rates."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns(
        {
            "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
            "f1": div(2 * tp, 2 * tp + fp + fn),
            "accuracy": div(tp + tn, tp + tn + fp + fn),
            "false_positive_rate": div(fp, fp + tn),
            "false_omission_rate": div(fn, fn + tn),
        }
    )


def _area(curve: str, method: str) -> Column:
    """The area of one step, to the cells ``*_next`` of the next threshold; null where it is undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tp2, fp2, fn2, tn2 = (F.col(f"{c}_next") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    if curve == "PR" and method == "interpolation":
        gone_tp, gone = tp - tp2, (tp + fp) - (tp2 + fp2)
        slope = F.coalesce(ratio(gone_tp, gone), F.lit(0.0))
        cut = tp2 - slope * (tp2 + fp2)
        log = F.when((tp + fp > 0) & (tp2 + fp2 > 0), F.log((tp + fp) / (tp2 + fp2))).otherwise(0.0)
        return F.when(tp2 + fn2 > 0, slope * (gone_tp + cut * log) / (tp2 + fn2))
    if curve == "ROC":
        x, x2, y, y2 = ratio(fp, fp + tn), ratio(fp2, fp2 + tn2), ratio(tp, tp + fn), ratio(tp2, tp2 + fn2)
    else:
        x, x2, y, y2 = ratio(tp, tp + fn), ratio(tp2, tp2 + fn2), ratio(tp, tp + fp), ratio(tp2, tp2 + fp2)
    both = y.isNotNull() & y2.isNotNull()
    return (x - x2) * {"interpolation": (y + y2) / 2, "minoring": F.when(both, F.least(y, y2)), "majoring": F.when(both, F.greatest(y, y2))}[method]


#: Metrics that take the most of one rate where another one meets a bound: dependent rate, bounded rate, whether at least.
CONSTRAINED = {
    "SensitivityAtSpecificity": ("tpr", "tnr", True),
    "SpecificityAtSensitivity": ("tnr", "tpr", True),
    "PrecisionAtRecall": ("precision", "tpr", True),
    "RecallAtPrecision": ("tpr", "precision", True),
    "RecallAtFalsePositiveRate": ("tpr", "fpr", False),
    "ThresholdAtRecall": ("threshold", "tpr", True),
}


def _best(name: str, bound: float) -> Column:
    """The most of the dependent rate over thresholds that meet the bound; 0 where none does."""
    most, held, at_least = CONSTRAINED[name]
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"tpr": div(tp, tp + fn), "tnr": div(tn, tn + fp), "fpr": div(fp, fp + tn), "precision": div(tp, tp + fp), "threshold": F.col("threshold")}
    d, c = rates[most], rates[held]
    return F.coalesce(F.max(F.when(~F.isnan(c) & ~F.isnan(d) & ((c >= bound) if at_least else (c <= bound)), d)), F.lit(0.0))


def summary(cells: DataFrame, areas: Mapping[str, tuple[str, str]] | None = None, bounds: Mapping[str, tuple[str, float]] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *by`` and a column for each area (curve, method) and each metric under a constraint (name, bound).

    All of them are one aggregation over the cells: sums over the steps between thresholds and maxima over thresholds.
    Areas are by trapezoids, or by the lesser or greater end of each step; PR by interpolation follows the log-slope
    between points. Undefined terms count as none.
    """
    areas, bounds = areas or {}, bounds or {}
    steps = cells
    if areas:
        order = Window.partitionBy("slice_key", *by).orderBy("threshold")
        steps = cells.withColumns({f"{c}_next": F.lead(c).over(order) for c in ("tp", "fp", "fn", "tn")})
    found = [F.coalesce(F.sum(F.when(F.col("tp_next").isNotNull(), _area(*a))), F.lit(0.0)).alias(n) for n, a in areas.items()]
    return steps.groupBy("slice_key", *by).agg(*found, *(_best(*b).alias(n) for n, b in bounds.items()))


def unpivot(frame: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *keep, metric, value``: a row for each named column."""
    return frame.select("slice_key", *keep, F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names))))


def jackknife(cells: DataFrame, areas: Mapping[str, tuple[str, str]] | None = None, bounds: Mapping[str, tuple[str, float]] | None = None, samples: int = 20) -> DataFrame:
    """``slice_key, metric, value, ...`` with intervals, from cells by a row's bucket ``__b``: a sample is the cells of all
    rows less those of a bucket, so no row is looked at again."""
    from metricloom.operators.confidence import Sampling, intervals

    sampling, names = Sampling("jackknife", samples), [*(areas or {}), *(bounds or {})]
    each = sampling.samples_of(cells, ["slice_key", "threshold"], CELLS)
    return intervals(unpivot(summary(each, areas, bounds, ["__b"]), names, ["__b"]), sampling, ["slice_key", "metric"])


def auc(cells: DataFrame, curve: str = "ROC", method: str = "interpolation", by: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *by, value``: one area."""
    return summary(cells, {"value": (curve, method)}, by=by)


def constrained(cells: DataFrame, name: str, bound: float | Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``slice_key, *by, bound, value``: 0 where no threshold meets the bound."""
    bounds = [bound] if isinstance(bound, int | float) else list(bound)
    out = summary(cells, bounds={f"v{i}": (name, v) for i, v in enumerate(bounds)}, by=by)
    pairs = F.array(*(F.struct(F.lit(float(v)).alias("bound"), F.col(f"v{i}").alias("value")) for i, v in enumerate(bounds)))
    return out.select("slice_key", *by, F.inline(pairs))


def confusion_plot(hist: DataFrame, thresholds: int = 1000, buckets: int = 10_000) -> DataFrame:
    """Matrices with rates at just below 0, at 0 and at each of so many even steps to 1."""
    return with_rates(matrices(hist, [-1e-6, *(i / thresholds for i in range(thresholds + 1))], buckets))


def calibration_plot(hist: DataFrame, buckets: int = 10_000, points: int = 1000, left: float = 0.0, right: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """``slice_key, lower, upper, w, wl, wp``: the histogram's buckets put together to so many, and all outside at the ends."""
    each = buckets // points
    group = F.when(F.col("bucket") == 0, -1).when(F.col("bucket") == buckets + 1, points).otherwise(F.floor((F.col("bucket") - 1) / each)).cast("int")
    width = (right - left) / points
    bounds = (F.when(F.col("g") < 0, float("-inf")).otherwise(F.lit(left) + F.col("g") * width).alias("lower"), F.when(F.col("g") < 0, left).when(F.col("g") >= points, float("inf")).otherwise(F.lit(left) + (F.col("g") + 1) * width).alias("upper"))
    return hist.withColumn("g", group).groupBy("slice_key", *by, "g").agg(*(F.sum(c).alias(c) for c in ("w", "wl", "wp"))).select("slice_key", *by, *bounds, "w", "wl", "wp")


def score_distribution(hist: DataFrame, thresholds: int = 1000, buckets: int = 10_000) -> DataFrame:
    """``slice_key, threshold, above, below``: weight of predictions on either side of each threshold."""
    cells = matrices(hist, [-1e-6, *(i / thresholds for i in range(thresholds + 1))], buckets)
    return cells.select("slice_key", "threshold", (F.col("tp") + F.col("fp")).alias("above"), (F.col("tn") + F.col("fn")).alias("below"))


def feature_sample(df: DataFrame, feature: str, wrong: str, threshold: float = 0.5, size: int = 10, specs: Sequence[SlicingSpec] = (), order: Column | None = None) -> DataFrame:
    """``slice_key, values``: at most ``size`` feature values of false positives (``fp``) or false negatives (``fn``).

    The first by a hash of the value, so that the sample is the same for the same rows; each task keeps ``size`` values.
    """
    hit = above(F.col("prediction"), threshold) & (F.col("label") <= threshold) if wrong == "fp" else ~above(F.col("prediction"), threshold) & (F.col("label") > threshold)
    ranked = fan_out(df.where(hit), specs).groupBy("slice_key", feature).agg(F.count("*").alias("n")).withColumn("o", order if order is not None else F.xxhash64(feature))
    first = Window.partitionBy("slice_key").orderBy("o", feature)
    return ranked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size).groupBy("slice_key").agg(F.array_sort(F.collect_list(feature)).alias("values"))
