"""Labels, predictions and weights as metrics want them: single numbers for each row, or rows for each class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a prediction struct that count as the prediction, in this order.
PREDICTION_FIELDS = ("scores", "outputs", "predictions", "logistic", "probabilities", "logits")


def resolve_prediction(df: DataFrame, name: str, key: str | None = None) -> Column:
    """The prediction of a plain column, or of a struct by ``key`` or by the known field names."""
    kind = df.schema[name].dataType
    if kind.typeName() != "struct":
        return F.col(name)
    fields = kind.fieldNames()
    for field in [key] if key else PREDICTION_FIELDS:
        if field in fields:
            return F.col(name)[field]
    raise ValueError(f"no prediction in {name}: {', '.join(fields)}")


def weight_or_one(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))


def class_index(label: Column, vocabulary: Sequence[str]) -> Column:
    """Place of a string label in the vocabulary; -1 if it isn't there."""
    return (F.array_position(F.array(*map(F.lit, vocabulary)), label) - 1).cast("int")


def one_hot(label: Column, size: Column) -> Column:
    """Zeros and a one at the label; all zeros for a label out of range."""
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: (i == label.cast("int")).cast("double"))


def sparse_to_dense(ids: Column, size: Column) -> Column:
    """Zeros and ones at all labels of a list."""
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.array_contains(ids, i).cast("double"))


def at_class(values: Column, class_id: int) -> Column:
    """The value of one class of a dense array; an error out of range."""
    return F.element_at(values, class_id + 1)


def ranked(predictions: Column) -> Column:
    """Class places, best prediction first; equal predictions in their order."""
    pairs = F.transform(predictions, lambda p, i: F.struct((-p).alias("n"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def gather(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.element_at(values, i.cast("int") + 1))


def kth(predictions: Column, labels: Column, k: int) -> tuple[Column, Column]:
    """The k-th best prediction and the label of its class."""
    place = F.element_at(ranked(predictions), k).cast("int") + 1
    return F.element_at(predictions, place), F.element_at(labels, place)


def keep_top_k(predictions: Column, k: int) -> Column:
    """Predictions outside the best k become minus infinity."""
    best = F.slice(ranked(predictions), 1, k)
    return F.transform(predictions, lambda p, i: F.when(F.array_contains(best, i), p).otherwise(F.lit(float("-inf"))))


def top_k(predictions: Column, labels: Column, k: int) -> tuple[Column, Column]:
    """The best k predictions and their labels, best first."""
    best = F.slice(ranked(predictions), 1, k)
    return gather(predictions, best), gather(labels, best)


def padded(values: Column, size: int, pad: float) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def class_rows(df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str = "weight", class_weights: dict[int, float] | None = None) -> DataFrame:
    """One row for each class: arrays become ``class_id``, ``label``, ``prediction``; with class weights the weight is
    multiplied, by 0 for a class without one."""
    out = df.select("*", F.posexplode(F.arrays_zip(F.col(label).alias("l"), F.col(prediction).alias("p"))).alias("class_id", "__z"))
    out = out.withColumn(label, F.col("__z.l")).withColumn(prediction, F.col("__z.p")).drop("__z")
    if class_weights is None:
        return out
    table = F.create_map(*(F.lit(x) for pair in class_weights.items() for x in pair)) if class_weights else F.create_map().cast("map<int,double>")
    return out.withColumn(weight, F.col(weight) * F.coalesce(F.try_element_at(table, F.col("class_id")), F.lit(0.0)))


def check_fractional(label: Column) -> Column:
    """The label, or an error outside 0 to 1."""
    return F.when(label.isNull() | ((label >= 0) & (label <= 1)), label).otherwise(F.raise_error(F.lit("fractional labels must lie in [0, 1]")).cast("double"))


def invert_log2(value: Column, most: float | None = None) -> Column:
    """The inverse of log2(1 + x), held within 0 and ``most`` if that is given."""
    out = F.pow(F.lit(2.0), value) - 1
    return out if most is None else F.least(F.lit(most), F.greatest(F.lit(0.0), out))
