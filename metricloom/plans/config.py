"""What to evaluate: models, slices, metrics, thresholds and options, as plain data that JSON can hold."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from metricloom.operators.slicing import OVERALL, SlicingSpec
from metricloom.operators.validation import Threshold


@dataclass(frozen=True)
class ModelSpec:
    """Columns (or SQL expressions) of a model's label, prediction and weight."""

    label: str = "label"
    prediction: str = "prediction"
    weight: str | None = None
    name: str = ""
    is_baseline: bool = False
    #: Of a model with several outputs: which one this is; its outputs are specs of the same name.
    output: str = ""


@dataclass(frozen=True)
class MetricConfig:
    """A metric; for dense arrays of labels and predictions also how classes become rows.

    ``class_ids``: each class against the rest; ``ks``: the k-th best prediction; ``top_ks``: the best k predictions.
    ``average`` puts the values of ``class_ids`` together (``macro``, ``weighted_macro`` by positives, ``micro``), weighted
    by ``class_weights`` if they are given.

    ``alias``: the name in the results; one that begins with a single underscore is used by other metrics and not shown.
    ``intervals``: whether it has them if the options ask for any. ``output_weights``: an average over outputs, with these
    weights, beside each output's value.
    """

    name: str
    params: dict = field(default_factory=dict)
    class_ids: tuple[int, ...] = ()
    ks: tuple[int, ...] = ()
    top_ks: tuple[int, ...] = ()
    average: str | None = None
    class_weights: dict = field(default_factory=dict)
    alias: str | None = None
    intervals: bool = True
    output_weights: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("class_ids", "ks", "top_ks"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "class_weights", {int(k): float(v) for k, v in self.class_weights.items()})
        if self.average and (self.average not in ("macro", "weighted_macro", "micro") or not self.class_ids or self.ks or self.top_ks):
            raise ValueError("an average is macro, weighted_macro or micro, over class_ids")
        if self.class_weights and not self.average:
            raise ValueError("class weights are for averages")

    @property
    def keyed(self) -> bool:
        return bool(self.class_ids or self.ks or self.top_ks)


@dataclass(frozen=True)
class CrossSlicingSpec:
    baseline: SlicingSpec
    comparisons: tuple[SlicingSpec, ...] = ()


@dataclass(frozen=True)
class Options:
    min_slice_size: int = 1
    #: ``jackknife``, ``bootstrap`` or nothing.
    intervals: str | None = None
    samples: int = 20
    #: Columns that identify a row, for reproducible samples; all columns if there are none.
    identity: tuple[str, ...] = ()
    seed: int = 0
    #: SQL that tells a row's bucket for the jackknife, 0 to ``samples`` - 1, instead of a hash.
    bucket: str | None = None


@dataclass(frozen=True)
class EvalConfig:
    models: tuple[ModelSpec, ...] = (ModelSpec(),)
    slices: tuple[SlicingSpec, ...] = (OVERALL,)
    metrics: tuple[MetricConfig, ...] = ()
    cross_slices: tuple[CrossSlicingSpec, ...] = ()
    thresholds: tuple[Threshold, ...] = ()
    options: Options = Options()

    def verified(self) -> EvalConfig:
        """The configuration if it makes sense."""
        names, keys = {m.name for m in self.models}, [(m.name, m.output) for m in self.models]
        if not self.models:
            raise ValueError("there must be a model")
        if len(set(keys)) != len(keys) or (len(names) > 1 and "" in names):
            raise ValueError("several models need distinct names, and a model's outputs too")
        if len({m.name for m in self.models if m.is_baseline}) > 1:
            raise ValueError("only one model can be the baseline")
        outputs = {m.output for m in self.models}
        if any(set(w.output_weights) - outputs for w in self.metrics):
            raise ValueError("an average is over outputs that there are")
        if self.options.bucket and self.options.intervals != "jackknife":
            raise ValueError("buckets are for the jackknife")
        if self.options.samples < 2:
            raise ValueError("an interval takes two samples or more")
        if self.options.intervals not in (None, "jackknife", "bootstrap"):
            raise ValueError("intervals are by jackknife or bootstrap")
        if any(t.direction and not self.baseline for t in self.thresholds):
            raise ValueError("a change threshold needs a baseline model")
        return self

    @property
    def baseline(self) -> ModelSpec | None:
        return next((m for m in self.models if m.is_baseline), None)

    def baseline_of(self, model: ModelSpec) -> ModelSpec | None:
        """The baseline model, with the same output."""
        return next((m for m in self.models if m.is_baseline and m.output == model.output), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> EvalConfig:
        d = json.loads(text)
        spec = lambda s: SlicingSpec(tuple(s["keys"]), tuple(map(tuple, s["values"])), s["sql"])
        return EvalConfig(
            tuple(ModelSpec(**m) for m in d["models"]), tuple(map(spec, d["slices"])), tuple(MetricConfig(**m) for m in d["metrics"]),
            tuple(CrossSlicingSpec(spec(c["baseline"]), tuple(map(spec, c["comparisons"]))) for c in d["cross_slices"]),
            tuple(Threshold(**{**t, "spec": spec(t["spec"])}) for t in d["thresholds"]), Options(**{**d["options"], "identity": tuple(d["options"]["identity"])}),
        )


def binary_metrics() -> tuple[MetricConfig, ...]:
    """A usual set for two classes."""
    return tuple(MetricConfig(n) for n in ("ExampleCount", "BinaryCrossEntropy", "BinaryAccuracy", "Precision", "Recall", "F1Score", "Calibration", "MeanLabel", "MeanPrediction"))


def regression_metrics() -> tuple[MetricConfig, ...]:
    return tuple(MetricConfig(n) for n in ("ExampleCount", "MeanAbsoluteError", "MeanSquaredError", "MeanAbsolutePercentageError", "SquaredPearsonCorrelation", "Calibration", "MeanLabel", "MeanPrediction"))


def multiclass_metrics() -> tuple[MetricConfig, ...]:
    return tuple(MetricConfig(n) for n in ("ExampleCount", "SparseCategoricalAccuracy"))
