"""Several classes: confusion matrices, averages over classes, sets, pixels and totals of attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import div, div_far, numbers
from metricloom.operators.slicing import SlicingSpec, fan_out


def _needed(specs: Sequence[SlicingSpec], *more: str) -> list[str]:
    return [*sorted({c for s in specs for c in s.columns()} - set(more)), *more]


def _sliced(df: DataFrame, specs: Sequence[SlicingSpec], by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums by ``by`` for each slice, summed before rows fan out."""
    first = df.groupBy(*(f"`{c}`" for c in _needed(specs, *by))).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return fan_out(first, specs).groupBy("slice_key", *by).agg(*(F.sum(n).alias(n) for n in sums))


def confusion(df: DataFrame, thresholds: Sequence[float] = (0.5,), specs: Sequence[SlicingSpec] = (), label: str = "label", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """``slice_key, threshold, actual, predicted, w``: predicted is the first best class, or -1 if it isn't above the threshold.

    ``label``: the class, or a dense array whose first best is the class.
    """
    return _sliced(confusion_rows(df, thresholds, label, prediction), specs, ["threshold", "actual", "predicted"], {"w": F.col(weight).cast("double")})


def confusion_rows(df: DataFrame, thresholds: Sequence[float], label: str, prediction: str) -> DataFrame:
    """Each row with its ``actual`` and ``predicted`` class at each threshold."""
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    actual = best(F.col(label)) if df.schema[label].dataType.typeName() == "array" else F.col(label).cast("int")
    rows = df.withColumns({"actual": actual, "__best": best(F.col(prediction)), "__top": F.array_max(prediction)})
    return rows.withColumn("threshold", F.explode(numbers(list(map(float, thresholds))))).withColumn("predicted", F.when(F.col("__top") > F.col("threshold"), F.col("__best")).otherwise(-1))


def multi_label(df: DataFrame, thresholds: Sequence[float] = (0.5,), specs: Sequence[SlicingSpec] = (), label: str = "label", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """``slice_key, threshold, actual, predicted`` and weights ``tp, fp, fn, tn`` of each class in rows of each actual class."""
    rows, states = multi_label_rows(df, thresholds, label, prediction, weight)
    return _sliced(rows, specs, ["threshold", "actual", "predicted"], states)


def multi_label_rows(df: DataFrame, thresholds: Sequence[float], label: str, prediction: str, weight: str) -> tuple[DataFrame, dict[str, Column]]:
    """A row for each class of each actual class of each row at each threshold, and its share in the four cells."""
    rows = df.withColumn("threshold", F.explode(numbers(list(map(float, thresholds)))))
    rows = rows.select("*", F.posexplode(label).alias("actual", "__on")).where("__on > 0")
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.col(label).alias("l"), F.col(prediction).alias("p"))).alias("predicted", "__z"))
    on, above, w = F.col("__z.l") > 0, F.col("__z.p") > F.col("threshold"), F.col(weight).cast("double")
    amount = lambda c: F.when(c, w).otherwise(0.0)
    return rows, {"tp": amount(on & above), "fp": amount(~on & above), "fn": amount(on & ~above), "tn": amount(~on & ~above)}


def class_cells(df: DataFrame, threshold: float = 0.5, specs: Sequence[SlicingSpec] = (), label: str = "label", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """``slice_key, class_id, tp, fp, fn, tn``: each class against the rest, at a threshold, from dense arrays."""
    from metricloom.functions.inputs import class_rows

    rows = class_rows(df, label, prediction, weight)
    w, l, above = F.col(weight).cast("double"), F.col(label).cast("double"), F.col(prediction) > threshold
    amount = lambda c, x: F.when(c, w * x).otherwise(0.0)
    return _sliced(rows, specs, ["class_id"], {"tp": amount(above, l), "fp": amount(above, 1 - l), "fn": amount(~above, l), "tn": amount(~above, 1 - l)})


def average(cells: DataFrame, value: Column, how: str = "macro", class_weights: dict[int, float] | None = None, name: str = "value") -> DataFrame:
    """``slice_key`` and a metric of the cells averaged over classes.

    ``macro``: the mean, or weighted by ``class_weights``; ``weighted_macro``: weights are also the classes' shares of
    positives; ``micro``: the metric of the summed cells, each weighted by its class. Classes without a weight count 0;
    without any weight the average is NaN.
    """
    table = F.create_map(*(F.lit(x) for pair in class_weights.items() for x in pair)) if class_weights else None
    weight = F.lit(1.0) if table is None else F.coalesce(F.try_element_at(table, F.col("class_id")).cast("double"), F.lit(0.0))
    if how == "micro":
        return cells.groupBy("slice_key").agg(*(F.sum(F.col(c) * weight).alias(c) for c in ("tp", "fp", "fn", "tn"))).select("slice_key", value.alias(name))
    share = weight * (F.col("tp") + F.col("fn")) if how == "weighted_macro" else weight
    valued = cells.select("slice_key", value.alias("__v"), share.alias("__w"))
    return valued.groupBy("slice_key").agg(F.sum(F.when(F.col("__w") != 0, F.col("__v") * F.col("__w")).otherwise(0.0)).alias("s"), F.sum("__w").alias("w")).select("slice_key", div(F.col("s"), F.col("w")).alias(name))


def output_average(results: DataFrame, weights: dict[str, float], by: Sequence[str] = ("slice_key", "metric")) -> DataFrame:
    """A metric's values by ``output`` put together with the outputs' weights."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    weighted = results.withColumn("__w", F.coalesce(F.try_element_at(table, F.col("output")).cast("double"), F.lit(0.0)))
    return weighted.groupBy(*by).agg(div(F.sum(F.col("value") * F.col("__w")), F.sum("__w")).alias("value"))


def set_matches(df: DataFrame, labels: str = "labels", classes: str = "classes", scores: str = "scores", weight: str = "weight", top_k: int | None = None, class_weights: str | None = None) -> DataFrame:
    """Rows ``label, prediction, weight, item`` beside the other columns: true positives with their scores, labels that
    are not predicted with minus infinity, predictions that are no label as negatives.

    ``top_k`` keeps the best predictions only; ``class_weights`` names a map column from item to weight, 1 by default.
    """
    pairs = F.arrays_zip(F.col(classes).alias("c"), F.col(scores).alias("s"))
    if top_k is not None:
        order = F.array_sort(F.transform(pairs, lambda z, i: F.struct((-z["s"]).alias("n"), i.alias("i"), z.alias("z"))))
        pairs = F.transform(F.slice(order, 1, top_k), lambda x: x["z"])
    known = F.col(labels)
    hits = F.transform(pairs, lambda z: F.struct(F.when(F.array_contains(known, z["c"]), 1.0).otherwise(0.0).alias("l"), z["s"].cast("double").alias("p"), z["c"].alias("item")))
    missed = F.transform(F.array_except(known, F.transform(pairs, lambda z: z["c"])), lambda c: F.struct(F.lit(1.0).alias("l"), F.lit(float("-inf")).alias("p"), c.alias("item")))
    out = df.withColumn("__m", F.explode(F.concat(hits, missed)))
    own = F.col(weight).cast("double")
    if class_weights:
        own = own * F.coalesce(F.try_element_at(class_weights, F.col("__m.item")), F.lit(1.0))
    return out.withColumns({"label": F.col("__m.l"), "prediction": F.col("__m.p"), "item": F.col("__m.item"), "weight": own}).drop("__m")


def segmentation(df: DataFrame, classes: Sequence[int], truth: str = "truth", predicted: str = "predicted", ignore: int | None = None, specs: Sequence[SlicingSpec] = (), weight: str | None = None) -> DataFrame:
    """``slice_key, class_id, tp, fp, fn, tn`` of pixels (arrays of class ids): pixels whose truth is ``ignore`` count
    in no cell of negatives."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pixels = df.select("*", F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("__z")).withColumns({"__t": F.col("__z.t"), "__p": F.col("__z.p"), "__w": w})
    few = pixels.groupBy(*(f"`{c}`" for c in _needed(specs)), "__t", "__p").agg(F.sum("__w").alias("__w"))  # at most classes squared for each group
    by_class = few.withColumn("class_id", F.explode(F.lit(list(classes)).cast("array<int>")))
    t, p, w, real = F.col("__t") == F.col("class_id"), F.col("__p") == F.col("class_id"), F.col("__w"), F.lit(True) if ignore is None else F.col("__t") != ignore
    amount = lambda c: F.when(c, w).otherwise(0.0)
    return _sliced(by_class, specs, ["class_id"], {"tp": amount(t & p), "fp": amount(~t & p & real), "fn": amount(t & ~p), "tn": amount(~t & ~p & real)})


def attributions(df: DataFrame, column: str, absolute: bool = False, mean: bool = False, class_id: int | None = None, specs: Sequence[SlicingSpec] = (), weight: str | None = None) -> DataFrame:
    """``slice_key, feature, value``: totals, or means over the weight of all rows, of a map from feature to attribution.

    With ``class_id`` the map holds arrays by class.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.withColumn("__w", w)
    parts = rows.select("*", F.explode(column).alias("feature", "__a"))
    a = F.element_at("__a", class_id + 1) if class_id is not None else F.col("__a")
    a = F.col("__w") * a.cast("double")
    totals = _sliced(parts, specs, ["feature"], {"value": F.abs(a) if absolute else a})
    if not mean:
        return totals
    counts = _sliced(rows, specs, [], {"n": F.col("__w")})
    return totals.join(counts, "slice_key").select("slice_key", "feature", div_far(F.col("value"), F.col("n")).alias("value"))


def fixed_sample(df: DataFrame, column: str, size: int, specs: Sequence[SlicingSpec] = (), weight: str | None = None, seed: int = 0, identity: Sequence[str] = (), uniform: Column | None = None) -> DataFrame:
    """``slice_key, values``: a uniform sample of ``size`` values, or by weight (the greatest u^(1/w)), for each slice.

    The random number of a row, in (0, 1), is ``uniform`` or a hash of ``identity`` (all columns by default) and the seed;
    of equal ones the lesser value comes first. Each task keeps the best ``size`` rows of a slice before rows move.
    """
    from pyspark.sql import Window

    names = identity or [c for c, t in df.dtypes if not t.startswith("map")]
    u = uniform if uniform is not None else (F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in names)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ranked = fan_out(df.withColumn("__o", F.when(w > 0, F.pow(u, 1 / w))).where("__o is not null"), specs).select("slice_key", F.col(column).alias("__v"), "__o")
    order = Window.partitionBy("slice_key").orderBy(F.desc("__o"), "__v")
    return ranked.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).groupBy("slice_key").agg(F.sort_array(F.collect_list("__v")).alias("values"))
