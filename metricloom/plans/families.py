"""Metrics by configuration that are no functions of sums of rows: rankings, texts, sets of labels, boxes.

Each takes rows with ``__label``, ``__prediction`` and ``__weight``, the slices, its parameters and a sampling, and gives
``slice_key, metric, __b, value``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import curves, detection, multiclass, ranking, textscores
from metricloom.operators.confidence import Sampling
from metricloom.operators.metrics import Row, make
from metricloom.operators.slicing import SlicingSpec

Specs = Sequence[SlicingSpec]


@dataclass(frozen=True)
class Family:
    """``rows`` of a metric's values, the ``names`` that they have for some parameters, and the parameters that there are."""

    rows: Callable[[DataFrame, Specs, dict, Sampling], DataFrame]
    names: Callable[[dict], list[str]]
    params: tuple[str, ...]


def _only(own: Family, name: str) -> Family:
    def rows(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
        unknown = set(params) - set(own.params)
        if unknown:
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        return own.rows(df, specs, params, sampling)

    return Family(rows, own.names, own.params)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select("slice_key", "__b", F.lit(name).alias("metric"), "value")


# --- rankings and texts -----------------------------------------------------------------------------------------------


def _ndcg(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    found = ranking.ndcg(df, params["query"], params["gain"], tuple(params.get("ks", (1,))), "__prediction", "__weight", specs, params.get("order", ()), sampling)
    return found.select("slice_key", "__b", F.concat(F.lit("NDCG@"), F.col("k").cast("string")).alias("metric"), "value")


def _min_label_position(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    return _named(ranking.min_label_position(df, params["query"], "__label", "__prediction", "__weight", specs, params.get("order", ()), sampling), "MinLabelPosition")


STATISTICS = ["total_queries", "total_documents", "min_documents", "max_documents"]


def _query_statistics(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    return curves.unpivot(ranking.query_statistics(df, params["query"], "__weight", specs, sampling), STATISTICS, ["__b"])


def _bleu(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    return _named(textscores.bleu(df, "__label", "__prediction", specs, sampling=sampling, **params), "BLEU")


def _rouge_names(params: dict) -> list[str]:
    return [f"{params.get('rouge_type', 'rouge1')}/{c}" for c in ("precision", "recall", "fmeasure")]


def _rouge(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
    found = textscores.rouge(df, params.get("rouge_type", "rouge1"), "__label", "__prediction", specs, "__weight", sampling)
    names = _rouge_names(params)
    return curves.unpivot(found.select("slice_key", "__b", *(F.col(n.split("/")[1]).alias(n) for n in names)), names, ["__b"])


# --- rows of sets and boxes, then metrics over them -------------------------------------------------------------------


def _point(rows: DataFrame, specs: Specs, sampling: Sampling, kind: str, threshold: float, name: str) -> DataFrame:
    """A metric of the four cells over rows with ``label, prediction, weight``."""
    metric = make(kind, threshold=threshold)
    row = Row(F.col("label"), F.col("prediction"), F.col("weight"))
    sums = sampling.sums(rows, specs, {n: amount(row) for n, amount in metric.states.items()})
    return sums.select("slice_key", "__b", F.lit(name).alias("metric"), metric.value({n: F.col(f"`{n}`") for n in metric.states}).alias("value"))


def _constrained(rows: DataFrame, specs: Specs, sampling: Sampling, kind: str, bound: float, thresholds: int, name: str) -> DataFrame:
    """A metric under a constraint over rows with ``label, prediction, weight``."""
    w, l = F.col("weight"), F.col("label")
    hist = sampling.parts(curves.bucketed(rows), specs, {"w": w, "wl": w * l}, ["bucket"])
    # boxes that are not found have no score above any threshold
    cells = curves.matrices(hist, [1e-12, *((i + 1) / thresholds for i in range(thresholds))], by=["__b"])
    each = sampling.samples_of(cells, ["slice_key", "threshold"], curves.CELLS)
    return _named(curves.summary(each, bounds={"value": (kind, bound)}, by=["__b"]), name)


def _set_rows(df: DataFrame, params: dict) -> DataFrame:
    given = df.withColumns({"__classes": F.col("__prediction.classes"), "__scores": F.col("__prediction.scores"), "weight": F.col("__weight")})
    return multiclass.set_matches(given, "__label", "__classes", "__scores", "weight", params.get("top_k"), params.get("class_weights"))


def _set_name(name: str, params: dict) -> str:
    top = f"[top_k={params['top_k']}]" if params.get("top_k") else ""
    return name + top + (f"@{params['threshold']:g}" if "threshold" in params else "")


def _set_metric(name: str, kind: str) -> Family:
    def rows(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
        return _point(_set_rows(df, params), specs, sampling, kind, params.get("threshold", 0.01), _set_name(name, params))

    return Family(rows, lambda params: [_set_name(name, params)], ("threshold", "top_k", "class_weights"))


BOXES = ("class_id", "area", "most")


def _box_rows(df: DataFrame, params: dict, iou: Sequence[float], classes: Sequence[int | None]) -> DataFrame:
    area = tuple(params["area"]) if params.get("area") else None
    return detection.matched(df, "__label", "__prediction", iou, classes, area, params.get("most"), "__weight")


def _box_name(name: str, params: dict, key: str) -> str:
    more = [f"{k}={params[k]}" for k in ("iou", "class_id", "area", "most") if params.get(k) is not None]
    return name + (f"@{params[key]:g}" if key in params else "") + (f"[{','.join(more)}]" if more else "")


def _box_metric(name: str, kind: str, key: str) -> Family:
    """A metric of matched boxes at a threshold of the score, or under a bound."""

    def rows(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
        matched, called = _box_rows(df, params, (params.get("iou", 0.5),), (params.get("class_id"),)), _box_name(name, params, key)
        if key == "bound":
            return _constrained(matched, specs, sampling, kind, params["bound"], params.get("num_thresholds", 100), called)
        return _point(matched, specs, sampling, kind, params.get("threshold", 0.5) if name != "ObjectDetectionMaxRecall" else 1e-12, called)

    return Family(rows, lambda params: [_box_name(name, params, key)], ("iou", *BOXES, *((key, "num_thresholds") if key == "bound" else (key,) if name != "ObjectDetectionMaxRecall" else ())))


def _coco_metric(name: str, recall: bool, mean: bool) -> Family:
    """Average precision or recall for each overlap and class, or their mean over both."""

    def called(params: dict) -> str:
        return f"{name}[{','.join(f'{k}={params[k]}' for k in ('area', 'most') if params.get(k) is not None)}]" if params.get("area") or params.get("most") else name

    def places(params: dict) -> tuple[list[float], list[int | None]]:
        return list(params.get("ious", detection.IOUS if mean or recall else (0.5,))), list(params.get("class_ids", (None,)))

    def names(params: dict) -> list[str]:
        ious, classes = places(params)
        if mean:
            return [called(params)]
        at = [""] if recall else [f"@{i:g}" for i in ious]
        return [called(params) + i + ("" if c is None else f"/class:{c}") for i in at for c in classes]

    def rows(df: DataFrame, specs: Specs, params: dict, sampling: Sampling) -> DataFrame:
        ious, classes = places(params)
        boxes = _box_rows(df, params, ious, classes)
        found = detection.average_recall(boxes, specs, sampling) if recall else detection.average_precision(boxes, params.get("recalls", tuple(i / 100 for i in range(101))), specs, sampling)
        if mean:
            return _named(detection.mean_over(found, ("slice_key", "__b")), called(params))
        kind = F.when(F.col("class_id").isNull(), "").otherwise(F.concat(F.lit("/class:"), F.col("class_id").cast("string")))
        if recall:  # over overlaps
            each = detection.mean_over(found, ("slice_key", "__b", "class_id"))
            return each.select("slice_key", "__b", F.concat(F.lit(called(params)), kind).alias("metric"), "value")
        at = F.lit("@" + f"{ious[-1]:g}")
        for i in ious[:-1]:
            at = F.when(F.col("iou") == float(i), F.lit(f"@{i:g}")).otherwise(at)
        return found.select("slice_key", "__b", F.concat(F.lit(called(params)), at, kind).alias("metric"), "value")

    return Family(rows, names, ("ious", "class_ids", "area", "most", *(() if recall else ("recalls",))))


#: Names of metrics.
FAMILIES: dict[str, Family] = {
    "NDCG": Family(_ndcg, lambda p: [f"NDCG@{k}" for k in p.get("ks", (1,))], ("query", "gain", "ks", "order")),
    "MinLabelPosition": Family(_min_label_position, lambda p: ["MinLabelPosition"], ("query", "order")),
    "QueryStatistics": Family(_query_statistics, lambda p: STATISTICS, ("query",)),
    "BLEU": Family(_bleu, lambda p: ["BLEU"], ("tokenize", "lowercase", "smooth", "smooth_value", "effective_order")),
    "ROUGE": Family(_rouge, _rouge_names, ("rouge_type",)),
    "SetMatchPrecision": _set_metric("SetMatchPrecision", "Precision"),
    "SetMatchRecall": _set_metric("SetMatchRecall", "Recall"),
    "ObjectDetectionPrecision": _box_metric("ObjectDetectionPrecision", "Precision", "threshold"),
    "ObjectDetectionRecall": _box_metric("ObjectDetectionRecall", "Recall", "threshold"),
    "ObjectDetectionMaxRecall": _box_metric("ObjectDetectionMaxRecall", "Recall", "threshold"),
    "ObjectDetectionPrecisionAtRecall": _box_metric("ObjectDetectionPrecisionAtRecall", "PrecisionAtRecall", "bound"),
    "ObjectDetectionThresholdAtRecall": _box_metric("ObjectDetectionThresholdAtRecall", "ThresholdAtRecall", "bound"),
    "COCOAveragePrecision": _coco_metric("COCOAveragePrecision", False, False),
    "COCOMeanAveragePrecision": _coco_metric("COCOMeanAveragePrecision", False, True),
    "COCOAverageRecall": _coco_metric("COCOAverageRecall", True, False),
    "COCOMeanAverageRecall": _coco_metric("COCOMeanAverageRecall", True, True),
}
FAMILIES = {n: _only(f, n) for n, f in FAMILIES.items()}
